"""Exact n-gram Jaccard join over whole texts with a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import byte_class, shingle_sets
from .components import connected_components
from .runtime import cut, release, sweep, tidy
from .token_maps import is_set, token_maps

#: Words: runs of bytes other than space and the five ASCII controls from tab to carriage return.
WORD_BYTES = byte_class(b" \t\n\x0b\x0c\r")
_U = np.uint64
_QUERY_BLOCK, _MEMBER_BLOCK = 128, 256
_NEEDED = 1 << 24  # bits of the map of documents whose texts are compared: 2 MB
_SALTS = 64


@dataclass(frozen=True)
class Similarity:
    """Jaccard >= num/den over sets of ``width``-word shingles."""

    width: int = 5
    num: int = 75
    den: int = 100

    def prefix(self, n: int) -> int:
        """Two sets that reach the threshold share one of their first ``prefix`` tokens in any common order."""
        return n - -(-self.num * n // self.den) + 1 if n else 0


def _fingerprint(s: np.ndarray) -> int:
    if not len(s):
        return 0
    mixed, total = np.bitwise_xor.reduce(s * _U(0x9E3779B97F4A7C15) ^ (s >> _U(31))), int(s.sum(dtype=np.uint64))
    return (int(mixed) ^ (total * 0xD1B54A32D192ED03)) & (2**63 - 1)


def _set_rows(sim: Similarity):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp = [], []
            for s in shingle_sets(batch.column(1), WORD_BYTES, sim.width):
                n.append(len(s))
                fp.append(_fingerprint(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp, pa.int64()), pa.array(n, pa.int64())], names=["doc", "copy", "fp", "n"])

    return tidy(rows)


def _probe_rows(sim: Similarity, maps):
    """The first core tokens of each set, frequent ones last: (token, often, fp, n, r).

    The core are the tokens of a set that the map allows to another document. Links lie in it, so a set needs at
    least the overlap with the smallest partner there; sets with less are not indexed. r counts the core's tokens from
    this one on: no more than r are shared with a set whose first common token this is.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, twice = maps.value
        for batch in batches:
            parts, rests, sets = [], [], []
            for s in shingle_sets(batch.column(0), WORD_BYTES, sim.width):
                core = s[is_set(s, twice)]
                p = sim.prefix(len(s)) - (len(s) - len(core))
                if p > 0:
                    often = is_set(core, frequent)
                    parts.append(np.concatenate([core[~often], core[often]])[:p])
                    rests.append(np.arange(len(core), len(core) - p, -1))
                    sets.append((_fingerprint(s), len(s)))
            if parts:
                fp, n = np.repeat(np.array(sets, np.int64), [len(x) for x in parts], axis=0).T
                r = np.concatenate(rests)
                tokens = np.concatenate(parts)
                for lo in range(0, len(tokens), 1 << 18):
                    t = tokens[lo : lo + (1 << 18)]
                    own = slice(lo, lo + len(t))
                    yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(is_set(t, frequent)), pa.array(fp[own]), pa.array(n[own].astype(np.int32)), pa.array(r[own].astype(np.int32))], names=["token", "often", "fp", "n", "r"])

    return tidy(rows)


def _verified(sim: Similarity):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [
                sim.den * (both := len(np.intersect1d(a, b, assume_unique=True))) >= sim.num * (len(a) + len(b) - both)
                for a, b in zip(shingle_sets(batch.column(2), WORD_BYTES, sim.width), shingle_sets(batch.column(3), WORD_BYTES, sim.width))
            ]
            yield batch.select([0, 1]).filter(pa.array(links, pa.bool_()))

    return tidy(rows)


def _fits(sim: Similarity, n, m, core):
    """Whether sets of sizes n and m can reach the threshold if they share ``core`` tokens at most."""
    return (n * sim.den >= m * sim.num) & (m * sim.den >= n * sim.num) & (core * (sim.num + sim.den) >= (n + m) * sim.num)


def _flagged(docs: DataFrame, owners: DataFrame, *keys: str) -> DataFrame:
    """``docs`` with ``flag``: false for most of the rows that ``owners`` lacks, true for all that it has.

    The owners' hashes set bits in 512 maps of 4 KB: 2 MB, whatever their number; what is flagged still needs a join.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(_NEEDED))
    maps = owners.select(at.alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("map"))
    found = docs.withColumn("h", at).withColumns({"bucket": F.expr("bitmap_bucket_number(h)"), "bit": F.expr("bitmap_bit_position(h)")}).join(F.broadcast(maps), "bucket", "left")
    byte = F.expr("cast(conv(hex(substring(map, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)")
    return found.select(*docs.columns, F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False)).alias("flag"))


class TokenGroupJoin:
    """The stages of the join over ``df``; see :func:`jaccard_groups`."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, sim: Similarity):
        self.sim = sim
        self.spark = df.sparkSession
        # a row is known by its id and its text's hash, so that repeated ids keep apart
        self.docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("copy"))

    def sets(self) -> DataFrame:
        """(doc, copy, fp, n): equal fingerprints are equal sets, one node of all that follows."""
        return cut(self.docs.mapInArrow(_set_rows(self.sim), "doc long, copy long, fp long, n long"))

    def probes(self, sets: DataFrame) -> DataFrame:
        """(token, fp, n, r, p_fp, p_n, p_r): each set under its first tokens, with the token's pivot.

        The pivot is the set with the fewest tokens of its own, so of a group of near copies the one that most others
        are near to. Rows of tokens that only one set has are gone. The rows of a frequent token are dealt over salts,
        each with its own pivot, and these pivots meet in a second, small window.
        """
        tokens = int(sets.agg(F.sum("n")).first()[0] or 0)
        texts = self.docs.select("text")
        width = self.sim.width
        maps = self.spark.sparkContext.broadcast(token_maps(texts, tokens, lambda batch: shingle_sets(batch.column(0), WORD_BYTES, width)))
        rows = texts.mapInArrow(_probe_rows(self.sim, maps), "token long, often boolean, fp long, n int, r int")
        salted = rows.withColumn("salt", F.when(F.col("often"), F.pmod(F.col("fp"), F.lit(_SALTS))).otherwise(F.lit(0)).cast("int"))
        # the less of a set is its own and the earlier the token comes, the more of it is left: r / n
        me = F.struct((F.col("r") / F.col("n") * -1).alias("own"), "n", "fp", "r")
        columns = ["token", "often", "fp", "n", "r", F.col("p.fp").alias("p_fp"), F.col("p.n").alias("p_n"), F.col("p.r").alias("p_r")]

        def to_pivot(frame: DataFrame, *keys: str) -> DataFrame:
            w = Window.partitionBy(*keys).orderBy(me)
            seen = frame.withColumns({"p": F.first(me).over(w), "prev": F.lag(me).over(w)})
            return seen.where(F.col("prev").isNull() | (F.col("prev") != me)).drop("prev")

        first = cut(to_pivot(salted, "token", "salt").where(F.col("often") | (F.col("p") != me)).select(*columns))
        heads = first.where("often").select("token", "often", F.col("p_fp").alias("fp"), F.col("p_n").alias("n"), F.col("p_r").alias("r")).distinct()
        second = cut(to_pivot(heads, "token").select(*columns))
        maps.destroy()  # what needed them is stored
        release()
        return first.unionByName(second).where("fp <> p_fp").drop("often")

    def texts(self, needed: DataFrame, reps: DataFrame) -> DataFrame:
        """(u, text) of the nodes ``needed(u)``."""
        owners = reps.join(needed.distinct(), reps.fp == needed.u).select("u", "doc", "copy")
        return owners.join(_flagged(self.docs.where("doc is not null"), owners, "doc", "copy").where("flag"), ["doc", "copy"]).select("u", "text")

    def opened_links(self, opened: DataFrame, inside: DataFrame, reps: DataFrame) -> DataFrame:
        """(u, v): links between sets and members of the groups that they open.

        Queries and members of a group meet in blocks of bounded size, one task each, so that neither a large group
        nor many queries gather in one; texts move once for each block of the other side.
        """
        own = inside.join(opened.select("other").distinct(), "other", "left_semi")
        sizes = opened.groupBy("other").agg(F.ceil(F.count("*") / _QUERY_BLOCK).alias("nq")).join(own.groupBy("other").agg(F.ceil(F.count("*") / _MEMBER_BLOCK).alias("nm")), "other")
        spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        q = opened.join(sizes, "other").select("other", F.col("fp").alias("u"), F.pmod(F.xxhash64("fp"), F.col("nq")).alias("qb"), spread("nm").alias("mb"))
        m = own.join(sizes, "other").select("other", F.col("s").alias("u"), F.pmod(F.xxhash64("s"), F.col("nm")).alias("mb"), spread("nq").alias("qb"))
        texts = self.texts(q.select("u").unionByName(m.select("u")), reps)
        keys = ["other", "qb", "mb"]
        sides = [x.join(texts, "u").select(*[F.col(k).alias(k) for k in keys], F.col("u").alias("fp"), F.col("text").alias("text")).groupBy(*keys) for x in (q, m)]
        return sides[0].cogroup(sides[1]).applyInArrow(_opened_links(self.sim), "u long, v long")

    def links(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Those of ``pairs(u, v)`` whose whole sets reach the threshold. Each pair meets the texts of its two nodes."""
        with_text = self.texts(pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))), reps)
        a = with_text.withColumnRenamed("text", "a")
        b = with_text.select(F.col("u").alias("v"), F.col("text").alias("b"))
        return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_verified(self.sim), "u long, v long")


def _members(probes: DataFrame) -> DataFrame:
    """(token, fp, n, r): every set under each of its first tokens that another set has too."""
    return probes.select("token", "fp", "n", "r").unionByName(probes.select("token", F.col("p_fp").alias("fp"), F.col("p_n").alias("n"), F.col("p_r").alias("r"))).distinct()


def _allowed(sim: Similarity, shared: str, n, lo, hi):
    """Whether ``shared`` first tokens leave room for the threshold between sets of size n and of sizes from lo to hi.

    Behind its first tokens a set of size x has ``rest(x)`` more core tokens, and one of the two sets ends first: the
    overlap is at most ``shared`` plus the larger rest. The room is monotone in the other size below n and above it.
    """
    rest = lambda x: F.ceil(x * sim.num / sim.den) - 1
    need = lambda x: F.ceil((n + x) * sim.num / (sim.num + sim.den)) - F.greatest(rest(n), rest(x))
    return (lo <= hi) & (F.col(shared) >= F.least(need(lo), need(hi), need(F.least(F.greatest(n, lo), hi))))


def _possible(pairs: DataFrame, members: DataFrame, sim: Similarity) -> DataFrame:
    """Those of ``pairs(u, v)`` that their shared first tokens allow; the others never move a text."""
    a = members.select(F.col("fp").alias("u"), "token", F.col("n").cast("long").alias("n_u"))
    b = members.select(F.col("fp").alias("v"), "token", F.col("n").cast("long").alias("n_v"))
    counts = pairs.join(a, "u").join(b, ["v", "token"]).groupBy("u", "v", "n_u", "n_v").agg(F.count("*").alias("shared"))
    return counts.where(_allowed(sim, "shared", F.col("n_u"), F.col("n_v"), F.col("n_v"))).select("u", "v")


def _openings(members: DataFrame, groups: DataFrame, sim: Similarity) -> tuple[DataFrame, DataFrame]:
    """The token-group matrix: (opened, inside), the sets ``fp`` that open a group, and the groups' members.

    ``groups(node, root)`` are the groups of sets already linked; a set without a row is its own group. A group's
    column is the union of its members' first tokens, with the sizes and the rests that stand behind each token: what
    follows a token in the set and in some member bounds their overlap from there on. A query set opens a group only
    if some token leaves room for the threshold at a size between the least and the largest member there. The shared
    tokens of a query and a group are not summed: that takes a row for each of them, which grows with the square of a
    large group's size.
    """
    grouped = members.join(groups, members.fp == groups.node, "left").select("token", "fp", F.col("n").cast("long").alias("n"), F.col("r").cast("long").alias("r"), F.coalesce("root", "fp").alias("g"))
    open_tokens = grouped.groupBy("token").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b").select("token")
    grouped = cut(grouped.join(open_tokens, "token"))
    union = grouped.groupBy("token", F.col("g").alias("other")).agg(F.min("n").alias("t_lo"), F.max("n").alias("t_hi"), F.max("r").alias("t_r"))
    n = F.col("n")
    lo, hi = F.ceil(n * sim.num / sim.den), F.floor(n * sim.den / sim.num)
    least = F.greatest(F.col("t_lo"), lo)
    meets = (F.col("g") > F.col("other")) & (least <= F.least(F.col("t_hi"), hi)) & (F.least("r", "t_r") * (sim.num + sim.den) >= (n + least) * sim.num)
    opened = grouped.join(union, "token").where(meets).select("fp", "other").distinct()
    return cut(opened), grouped.select(F.col("g").alias("other"), F.col("fp").alias("s")).distinct()


def _opened_links(sim: Similarity):
    """Sets of one block of queries against one block of a group's members: one link a query is enough."""

    def reduce(queries: pa.Table, members: pa.Table) -> pa.Table:
        fps, texts = members.column("fp").to_pylist(), members.column("text")
        sets = list(shingle_sets(texts, WORD_BYTES, sim.width))
        u, v = [], []
        for q, a in zip(queries.column("fp").to_pylist(), shingle_sets(queries.column("text"), WORD_BYTES, sim.width)):
            for s, b in zip(fps, sets):
                if sim.den * min(len(a), len(b)) >= sim.num * max(len(a), len(b)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if sim.den * both >= sim.num * (len(a) + len(b) - both):
                        u.append(max(q, s))
                        v.append(min(q, s))
                        break
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return reduce


def jaccard_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sim: Similarity = Similarity()) -> DataFrame:
    """One row per input row: id, n_shingles and component_id, the least id reachable by links.

    Two documents link when the Jaccard similarity of their sets of distinct ``width``-word shingles is at least
    num/den, over whole texts; A-Z are lower-cased. A text with fewer words is one shingle; without words it has no
    set, links with nothing and is its own component. No link is lost:

    1. Documents of equal sets are one node (a group of copies costs one node, whatever its size).
    2. Token counts over all documents fill two maps of fixed size. By them a set's own tokens, which link nothing, are
       set apart and frequent tokens come last; each set is indexed under its first tokens in that order, of which two
       similar sets share one at least.
    3. Each set is compared with its tokens' pivots: linear in the index. Linked sets form the groups of similar
       documents. Texts move only for pairs whose shared first tokens allow a link.
    4. The token-group matrix holds each group's token union; a set outside opens only the groups in which, at some
       token of the union, what follows it there and in the set allows the overlap, and is compared with their members.

    Null texts have no words; null ids keep their row, with themselves alone as component (null); rows of one id are
    rows of their own that share the id's component. Empty tables give no rows; other columns are ignored.
    """
    join = TokenGroupJoin(df, id_col, text_col, sim)
    sets = join.sets()
    reps = cut(sets.where("n > 0 and doc is not null").groupBy("fp").agg(F.min(F.struct("doc", "copy")).alias("r")).select("fp", "r.doc", "r.copy"))
    probes = join.probes(sets)
    sweep(join.spark)
    members = _members(probes)
    near = probes.where(_fits(sim, F.col("n"), F.col("p_n"), F.least("r", "p_r"))).select(F.greatest("fp", "p_fp").alias("u"), F.least("fp", "p_fp").alias("v")).distinct()
    possible = cut(_possible(near, members, sim))
    sweep(join.spark)
    links = cut(join.links(possible, reps))
    groups = cut(connected_components(links))
    opened, inside = _openings(members, groups, sim)
    sweep(join.spark)
    links = links.unionByName(cut(join.opened_links(opened, inside, reps)))
    sweep(join.spark)
    # rows of one id also hang together: the ids are what is returned
    class_of = sets.where("n > 0 and doc is not null").join(reps.select("fp", F.col("doc").alias("rep")), "fp").select("doc", "rep")
    names = reps.select("fp", "doc")
    edges = links.join(names.select(F.col("fp").alias("u"), F.col("doc").alias("a")), "u").join(names.select(F.col("fp").alias("v"), F.col("doc").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    twice = class_of.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc")
    edges = edges.unionByName(class_of.join(twice, "doc").select(F.col("doc").alias("u"), F.col("rep").alias("v")).where("u <> v").distinct())
    roots = connected_components(edges)
    # a row's node is its class's first document; that one's root is the component
    named = names.join(roots, names.doc == roots.node, "left").select("fp", F.coalesce("root", "doc").alias("component"))
    placed = sets.join(named, (sets.fp == named.fp) & (sets.n > 0), "left").select(sets.doc, sets.n.alias("n_shingles"), F.coalesce("component", sets.doc).alias("component_id"))
    return placed.select(F.col("doc").alias(id_col), "n_shingles", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each_group(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sim: Similarity = Similarity()) -> DataFrame:
    """``df`` with one row of each group of linked documents: the one with the least id, nulls last.

    A document is a row by its id and text together, so rows of one id with unlike texts all stay, and rows
    without an id take part like others. Of rows with the same id and text an arbitrary one stays; texts without words
    link with nothing and all stay. Only rows that go, or of whose kind several are there, move: the others are told
    apart by a map of fixed size. Columns are unchanged, whatever their names; an empty table gives no rows.
    """
    row = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    i = df.columns.index(id_col)
    found = jaccard_groups(df.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text")), id_col="key", text_col="text", sim=sim)
    ids = row.select("key", F.col(f"row.c{i}").alias("id")).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    known = cut(found.where("n_shingles > 0").select("key", "component_id").distinct().join(ids, "key").select("key", "component_id", "rows", F.struct(F.col("id").isNull(), "id", "key").alias("rank")))
    heads = known.groupBy("component_id").agg(F.min("rank").alias("least"))
    # a small table for most inputs: what goes, and what is there more than once
    touched = cut(known.join(heads, "component_id").where((F.col("rank") != F.col("least")) | (F.col("rows") > 1)).select("key", (F.col("rank") == F.col("least")).alias("stays")))
    told = _flagged(row, touched, "key")
    asked = told.where("flag").join(touched, "key", "left")
    again = asked.where("stays").select("key", "row").dropDuplicates(["key"]).select("row")
    return told.where("NOT flag").select("row").unionByName(asked.where("stays IS NULL").select("row")).unionByName(again).select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(df.columns)])
