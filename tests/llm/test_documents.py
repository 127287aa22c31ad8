"""Sharding, line dedup, decontamination and the Jaccard join against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from tidegauge.llm import queries
from tidegauge.llm.decontaminate import decontaminate, positional_index, proximity_matches, without_leaks
from tidegauge.llm.jaccard_join import jaccard_groups
from tidegauge.llm.line_dedup import apply_keep_bitmaps, line_keep_bitmaps
from tidegauge.llm.sharding import byte_shards

SCHEMA = "doc_id long, text string, shard string, row string, keep int"


def corpus(seed: int = 3, n: int = 260) -> list[tuple]:
    """Texts with copies, near copies, shared lines and passages, nulls, empties, odd spaces, ties and long texts."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéßÑ") for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    para = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    common, passage = ["Common Line here", "  common line HERE\t", "x"], para(60)
    texts: list[str | None] = [None, "", " ", "\n\n", "one", "One two", "one two", "a b c d e", "a b c d e f", "\x1c odd\xa0space x", "A" * 3000]
    base = para(120)
    for i in range(n):
        kind = i % 9
        if kind == 0:
            texts.append(base)
        elif kind == 1:
            w = base.split()
            for _ in range(rnd.randint(0, 9)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(para(30) + "\n" + rnd.choice(common) + "\n" + para(5))
        elif kind == 3:
            texts.append(para(rnd.randint(20, 60)) + " " + passage)
        elif kind == 4:
            texts.append(para(rnd.randint(1, 9)))
        elif kind == 5 and texts[-30:]:
            w = (rnd.choice(texts[-30:]) or "q").split(" ")
            w[len(w) // 2] = "Z"
            texts.append(" ".join(w))
        else:
            texts.append("\n".join(para(rnd.randint(1, 40)) for _ in range(rnd.randint(1, 6))))
    texts.append(para(40_000))
    return [(i * 3 + 1, t, "s", "r", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def shards_brute(rows, shards):
    """{(id, text): shard}, one row after the other."""
    size = lambda t: len((t or "").encode()) + 16
    key = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + 2**63) % 2**64 - 2**63
    total, groups = sum(size(t) for _, t in rows), defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    bytes_of = {t: size(t) * len(ids) for t, ids in groups.items()}
    heavy = {t for t, n in bytes_of.items() if n * shards * 64 >= total >= n * shards}
    loads, out = [0] * shards, {}
    for t in sorted(heavy, key=lambda t: (-bytes_of[t], key(t))):
        s = loads.index(min(loads))
        loads[s] += bytes_of[t]
        out |= {(i, t): s for i in groups[t]}
    light = total - sum(loads)
    level = min(x for k, load in enumerate(sorted(loads)) if (x := (sum(sorted(loads)[: k + 1]) + light) / (k + 1)) >= load)
    edges, end = [], 0.0
    for load in loads:
        end += max(0.0, level - load)
        edges.append(end)
    at = 0
    for t in sorted(groups.keys() - heavy, key=key):
        for i in sorted(groups[t], key=lambda i: (i is not None, i)):
            middle = at + size(t) / 2 if bytes_of[t] * shards > total else at + bytes_of[t] / 2
            out[i, t] = min(shards - 1, sum(e <= middle for e in edges))
            at += size(t) if bytes_of[t] * shards > total else 0
        at += 0 if bytes_of[t] * shards > total else bytes_of[t]
    return out


@pytest.mark.parametrize("shards", [1, 3, 6, 40])
def test_byte_shards(spark, docs, rows, shards):
    hot = "a text that a third of all bytes are of " * 4
    pairs = [(r[0], r[1]) for r in rows] + [(90_000 + k, hot) for k in range(sum(len((r[1] or "").encode()) + 16 for r in rows) // (2 * len(hot)))]
    df = spark.createDataFrame([(i, t, "s", "r", 7) for i, t in pairs], SCHEMA).repartition(7)
    got = byte_shards(df, shards=shards).collect()
    text = dict(pairs)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs)
    want = shards_brute(pairs, shards)
    assert {(r.doc_id, text[r.doc_id] or ""): r.shard for r in got} == {(i, t): s for (i, t), s in want.items()}
    slots, of_text, bytes_of = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        of_text[text[r.doc_id] or ""].add(r.shard)
        bytes_of[text[r.doc_id] or ""] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(r.size for r in got)
    assert all(len(s) == 1 for t, s in of_text.items() if bytes_of[t] * shards <= total)  # groups are whole
    if shards <= 6:
        load = Counter()
        for r in got:
            load[r.shard] += r.size
        most = max([n for t, n in bytes_of.items() if n * shards <= total and n * shards * 64 < total], default=0) + max(r.size for r in got if bytes_of[text[r.doc_id] or ""] * shards > total or shards > 1 and bytes_of[text[r.doc_id] or ""] * shards * 64 < total) if shards > 1 else total
        assert max(load.values()) - min(load[k] for k in range(shards)) <= 2 * most
    assert byte_shards(df.limit(0), shards=shards).count() == 0


def test_byte_shards_hot_id_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "x")] * 5 + [(7, None)] * 150 + [(7, "")] * 150 + [(8, "yy")] * 5, "doc_id long, text string")
    got = byte_shards(df, shards=4).collect()
    assert Counter((r.doc_id, r.size) for r in got) == {(None, 17): 5, (7, 16): 300, (8, 18): 5}
    assert max(Counter(r.shard for r in got).values()) <= 81 and len({r.shard for r in got if r.doc_id == 8}) == 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(4))


def test_op5_columns(spark, tmp_path):
    """The query's own columns over a table in a folder."""
    spark.createDataFrame([(i, "word " * (i % 7)) for i in range(300)] + [(None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_byte_sharding(spark, str(tmp_path)).collect()
    assert len(got) == 301 and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and all(0 <= r.shard < 40 for r in got)


def lines_brute(rows, min_docs, min_chars=1):
    seen = defaultdict(set)
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(d)
    bad = {k for k, v in seen.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = {}
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if key(x) not in bad]
        out[d] = (len(ls), len(ls) - len(stay), "\n".join(stay))
    return out


@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (10, 1), (3, 4)])
def test_line_dedup(docs, rows, min_docs, min_chars):
    got = apply_keep_bitmaps(docs, line_keep_bitmaps(docs, min_docs=min_docs, min_chars=min_chars)).collect()
    want = lines_brute(rows, min_docs, min_chars)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got} == {d: (a, b, hashlib.sha256(c.encode()).hexdigest()) for d, (a, b, c) in want.items()}
    assert len(got) == len(rows) and any(b for _, b, _ in want.values())


def test_line_dedup_keeps_first_and_columns(spark):
    df = spark.createDataFrame([(i, f"Same\nown {i}\n same ", "a", "b", i) for i in range(400)] + [(None, None, "a", "b", 0)], SCHEMA)
    got = apply_keep_bitmaps(df, line_keep_bitmaps(df, min_docs=2, keep="first"), output="text")
    assert got.columns == ["doc_id", "shard", "row", "keep", "n_lines", "n_dropped", "kept"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].kept == "Same\nown 0" and by[5].kept == "own 5" and by[399].n_dropped == 2 and len(by) == 401
    assert by[None].n_lines == 1


@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_dedup_runs_over_batches_and_partitions(spark, keep):
    """A key below min_docs that spans partitions and Arrow batches keeps all its lines; one at min_docs loses them."""
    texts = ["once\n" + "rare line\n" * 400 + "frequent line", *["rare line\n" * 30 + f"own {i}\nfrequent line" for i in range(2)], *["frequent line\n" * 40 for _ in range(3)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        got = {r.doc_id: r.n_dropped for r in apply_keep_bitmaps(df, line_keep_bitmaps(df, min_docs=4, keep=keep)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {i: t.split("\n").count("frequent line") for i, t in enumerate(texts)}
    want[0] -= keep == "first"
    assert got == want


def test_line_dedup_empty(docs):
    assert apply_keep_bitmaps(docs.limit(0), line_keep_bitmaps(docs.limit(0))).count() == 0


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))


def hits_brute(rows, items, width=10):
    out = {}
    for d, t, *_ in rows:
        w = item_words(t)
        hit, found = set(), set()
        for i, x in items:
            v = item_words(x)
            size = min(width, len(v))
            for a in range(len(v) - size + 1) if v else ():
                win = v[a : a + size]
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == win:
                        hit.update(range(p, p + size))
                        found.add(i)
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_decontaminate(spark, docs, rows):
    t = [r[1] for r in rows if r[1] and 20 < len(r[1].split()) < 200]
    items = [(1, " ".join(t[3].split()[2:30])), (2, "one two"), (3, None), (4, "..."), (5, t[10].upper()), (6, "x"), (20, " ".join(t[40].split()[:12])), (21, " ".join(t[40].split()[:12])), (30, "nowhere at all to be found in any of these texts of ours")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = hits_brute(rows, items)
    assert sum(1 for v in want.values() if v[1]) > 5
    for chunk in (4_000_000, 20):
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate(docs, bench, chunk_words=chunk).collect()}
        assert got == want
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate(docs, bench.limit(0)).collect())


def test_without_leaks_keeps_all_columns(spark, rows):
    t = [r[1] for r in rows if r[1] and 20 < len(r[1].split()) < 200]
    items = [(1, " ".join(t[3].split()[2:30])), (2, "one two"), (3, None), (5, t[10].upper())]
    clean = {i for i, v in hits_brute(rows, items).items() if not v[1]}
    df = spark.createDataFrame([(*r[:2], "a", None, 3) for r in rows] * 2, "doc_id long, text string, leak string, items string, n_hit int").repartition(3)
    for chunk in (4_000_000, 20):
        out = without_leaks(df, spark.createDataFrame(items, "item_id long, text string"), chunk_words=chunk)
        assert out.columns == df.columns
        assert Counter(r.doc_id for r in out.collect()) == {i: 2 for i in clean}


def near_brute(rows, items, slack):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
    out = set()
    for d, t, *_ in rows:
        w = words(t)
        for item, text in items:
            need = set(words(text))
            span = len(words(text)) + slack
            at = next((p for p in range(len(w)) if need and w[p] in need and need <= set(w[p : p + span])), None)
            if at is not None:
                out.add((d, item, at))
    return out


def test_proximity(spark, rows):
    short = [(1, "a x b y c"), (2, "a " + "q " * 60 + "b c"), (3, "c b a"), (None, "b a c"), (4, None), (5, ""), (6, "a a a b " + "z " * 9 + "c")]
    df = spark.createDataFrame(short, "doc_id long, text string").repartition(2)
    bench = [(9, "a b c"), (10, None), (11, "...")]
    for slack in (0, 2, 8, 70):
        for chunk in (4_000_000, 2):
            got = proximity_matches(positional_index(df), spark.createDataFrame(bench, "item_id long, text string"), slack=slack, chunk_words=chunk)
            assert {(r.doc, r.item, r.position) for r in got.collect()} == near_brute(short, bench, slack)
    t = [r[1] for r in rows if r[1] and 20 < len(r[1].split()) < 200]
    items = [(k, " ".join(reversed(x.split()[4:12]))) for k, x in enumerate(t[:40])] + [(90, t[3].split()[0])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    got = {(r.doc, r.item, r.position) for r in proximity_matches(positional_index(docs), spark.createDataFrame(items, "item_id long, text string"), slack=5).collect()}
    assert got == near_brute(rows, items, 5) and len(got) > 40


def jaccard_brute(rows):
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, n = sorted(sets), 0
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                n += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}, n


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_groups(spark, seed):
    rows = corpus(seed)
    want, n = jaccard_brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(df).collect()}
    assert n > 100 and got == want


def test_jaccard_chain_of_borderline_pairs(spark):
    """Neighbours link, others don't: every link matters for the component."""
    rnd = random.Random(1)
    rows, w = [], [f"w{i}" for i in range(60)]
    for i in range(120):
        rows.append((1000 - i, " ".join(w), "s", "r", 0))
        at = rnd.randrange(0, 50)
        w = [*w[:at], f"n{i}", *w[at:]] if i % 2 else [*w[1:], f"m{i}"]
    want, _ = jaccard_brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_jaccard_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, None), (2, "A b c d e f"), (2, "A b c d e f"), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_groups(df).collect())
    assert got == [(0, 2, None), (1, 0, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert jaccard_groups(df.limit(0)).count() == 0
