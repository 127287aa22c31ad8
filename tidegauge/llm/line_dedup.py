"""Corpus-wide line deduplication that moves line fingerprints, never texts, and answers with keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import blocks, text_buffer
from .runtime import cut, shuffle_partitions, tidy

_SPACE = b" \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]


def _line_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(2))
            raw = memoryview(np.ascontiguousarray(buf))
            ids = batch.select([0, 1])
            for lo, hi in blocks(offsets):
                at, pos, digests = [], [], []
                for i in range(lo, hi):
                    for k, line in enumerate(bytes(raw[offsets[i] : offsets[i + 1]]).split(b"\n")):
                        key = line.strip(_SPACE)
                        if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                            at.append(i)
                            pos.append(k)
                            digests.append(xxhash.xxh3_128_digest(key.lower()))
                if at:
                    h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    own = ids.take(pa.array(at, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), own.column(0), own.column(1), pa.array(pos, pa.int32())], names=["h1", "h2", "doc", "copy", "pos"])

    return tidy(rows)


def _dropped(min_docs: int, keep: str, spanning):
    """Streams a partition sorted by key, document and position; yields the lines to drop.

    Only the open run waits, and only while it is undecided: below ``min_docs`` documents.
    """

    def run_starts(h: np.ndarray) -> np.ndarray:
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]).any(axis=1)
        return new

    def decide(t: pa.Table, known: tuple | None, known_first: bool) -> pa.Table:
        """known: the key of a run already decided, whose first line has passed if known_first; frequent unless spanning says how many documents it has."""
        h = np.column_stack([t.column(c).to_numpy() for c in _KEY])
        new = run_starts(h)
        run = np.cumsum(new) - 1
        doc, copy = t.column("doc").fill_null(-1).to_numpy(), t.column("copy").to_numpy()
        isnull = t.column("doc").is_null().to_numpy()
        fresh = new.copy()
        fresh[1:] |= (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (isnull[1:] != isnull[:-1])
        docs = np.bincount(run, weights=fresh)
        heads = np.flatnonzero(new)
        part = int(t.column("part")[0].as_py())
        first_here = np.ones(len(heads), bool)
        for k in {0, len(heads) - 1}:
            key = tuple(h[heads[k]].tolist())
            if key in spanning.value:
                docs[k], first_part = spanning.value[key]
                first_here[k] = first_part == part
            elif key == known:
                docs[k] = max(docs[k], min_docs)
            if key == known:
                first_here[k] &= not known_first
        drop = (docs >= min_docs)[run]
        if keep == "first":
            drop[heads[first_here]] = False
        return t.select(["doc", "copy", "pos"]).filter(pa.array(drop))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        known: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if waiting is not None:
                t = pa.concat_tables([waiting, t])
            h = np.column_stack([t.column(c).to_numpy() for c in _KEY])
            last = int(np.flatnonzero(run_starts(h))[-1])
            if last:
                yield from decide(t.slice(0, last), known, True).to_batches()
                known = None
            tail = t.slice(last)
            key = tuple(h[last].tolist())
            distinct = len(set(zip(tail.column("doc").to_pylist(), tail.column("copy").to_pylist()))) if known != key else min_docs
            if known == key or key in spanning.value or distinct >= min_docs:
                yield from decide(tail, known if known == key else None, known == key).to_batches()
                known, waiting = key, None
            else:
                waiting = tail
        if waiting is not None:
            yield from decide(waiting, known, True).to_batches()

    return tidy(stream)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for drops in batch.column(2):
            at = np.array(drops.as_py(), np.int64)
            bits = np.ones(int(at.max()) + 1, np.uint8)
            bits[at] = 0
            out.append(zlib.compress(np.packbits(bits).tobytes() + bytes([len(bits) % 8])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc", "copy", "keep"])


def _kept_positions(keep: bytes | None, n: int) -> np.ndarray | None:
    """None: all lines stay. Lines after the bitmap's end stay."""
    if keep is None:
        return None
    raw = zlib.decompress(keep)
    bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
    size = len(bits) - (8 - raw[-1]) % 8
    full = np.ones(n, bool)
    full[: min(n, size)] = bits[: min(n, size)]
    return full


def _identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("copy"), F.col(text_col).alias("text"))


def line_keep_bitmaps(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep: str = "none", min_chars: int = 1) -> DataFrame:
    r"""(doc, copy, keep): a compressed bitmap for each document that loses lines; documents without a row keep all.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased, as a 128-bit fingerprint. Keys
    of at least ``min_chars`` code points in at least ``min_docs`` documents lose all lines (``keep="none"``) or all
    but the first by document and position (``keep="first"``). Fingerprints are range-partitioned by key, document
    and position, so a key with a third of all lines spreads over many partitions; the keys at partition edges (two
    a partition at most) are counted beforehand with partial aggregation, all others in one streamed pass.

    A document is an id with a text (``copy`` is the text's hash): repeated rows of both are one document. Null texts
    and empty texts have one empty line, which is never dropped; null ids are documents like others. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    if min_docs < 1 or min_chars < 1:
        raise ValueError("min_docs and min_chars must be positive")
    spark = df.sparkSession
    lines = _identified(df, id_col, text_col).mapInArrow(_line_rows(min_chars), "h1 long, h2 long, doc long, copy long, pos int")
    order = [*_KEY, "doc", "copy", "pos"]
    placed = cut(lines.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    key = F.struct(*_KEY)
    edges = placed.groupBy("part").agg(F.array(F.min(key), F.max(key)).alias("k")).select("part", F.explode("k").alias("k")).distinct()
    shared = edges.groupBy("k").agg(F.count("*").alias("parts")).where("parts > 1").select("k.h1", "k.h2")
    counts = (
        placed.join(F.broadcast(shared), _KEY)  # at most two keys a partition
        .groupBy(*_KEY, "doc", "copy").agg(F.min("part").alias("part"))
        .groupBy(*_KEY).agg(F.count("*").alias("docs"), F.min("part").alias("part"))
    )
    spanning = spark.sparkContext.broadcast({(r.h1, r.h2): (r.docs, r.part) for r in counts.collect()})
    drops = placed.mapInArrow(_dropped(min_docs, keep, spanning), "doc long, copy long, pos int").distinct()
    return drops.groupBy("doc", "copy").agg(F.collect_list("pos").alias("drops")).mapInArrow(_bitmaps, "doc long, copy long, keep binary")


def _applied(with_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            raw, keeps = memoryview(np.ascontiguousarray(buf)), batch.column(2).to_pylist()
            missing = batch.column(1).is_null().to_pylist() if with_text else None
            n_lines, n_dropped, out = [], [], []
            for i, keep in enumerate(keeps):
                text = bytes(raw[offsets[i] : offsets[i + 1]])
                n = text.count(b"\n") + 1
                stays = _kept_positions(keep, n)
                dropped = 0 if stays is None else int(n - stays.sum())
                if dropped:
                    text = b"\n".join([x for x, s in zip(text.split(b"\n"), stays.tolist()) if s])
                n_lines.append(n)
                n_dropped.append(dropped)
                out.append((None if missing[i] else text) if with_text else hashlib.sha256(text).hexdigest())
            last = pa.array(out, pa.binary()).cast(pa.string()) if with_text else pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), last], names=["row", "n_lines", "n_dropped", "kept"])

    return tidy(apply)


def apply_keep_bitmaps(df: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", output: str = "sha256") -> DataFrame:
    """Every input row's id with n_lines, n_dropped and ``kept``: the text that stays (``output="text"``) or its SHA-256.

    With ``output="text"`` all other columns of ``df`` follow unchanged, and a null text without dropped lines stays null.
    A document that loses all its lines keeps an empty text.
    """
    whole = output == "text"
    others = [c for c in df.columns if c != text_col]
    doc = _identified(df, id_col, text_col)
    if whole:  # the other columns travel under names of their own
        doc = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("copy"), F.col(text_col).alias("text"))
    b = bitmaps.select(F.col("doc").alias("b_doc"), F.col("copy").alias("b_copy"), "keep")
    joined = doc.join(b, F.col("doc").eqNullSafe(F.col("b_doc")) & (F.col("copy") == F.col("b_copy")), "left")
    if not whole:
        return joined.select(F.col("doc").alias("row"), "text", "keep").mapInArrow(_applied(False), "row long, n_lines long, n_dropped long, kept string").withColumnRenamed("row", id_col)
    kind = doc.schema["row"].dataType.simpleString()
    done = joined.select("row", F.col("text"), "keep").mapInArrow(_applied(True), f"row {kind}, n_lines long, n_dropped long, kept string")
    return done.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)], "n_lines", "n_dropped", "kept")


def drop_lines(df: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its own columns, whatever their names, and with ``text_col`` without the dropped lines; null stays null."""
    kept = apply_keep_bitmaps(df, bitmaps, id_col=id_col, text_col=text_col, output="text")
    # by position: a column of df may be named like one of the operator's
    others = [c for c in df.columns if c != text_col]
    named = kept.toDF(*[f"c{i}" for i in range(len(others))], "n_lines", "n_dropped", "kept")
    return named.select(*[F.col("kept" if c == text_col else f"c{others.index(c)}").alias(c) for c in df.columns])
