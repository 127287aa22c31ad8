"""WARC records and a Merkle fixity audit of their replicas, in DataFrame functions."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, shuffle_partitions

FANOUT = 64
_LEVEL_ROWS = 100_000  # rows of one partition of a level
_DIFFERENT = 32  # partitions of the nodes that differ
#: Ends a record; as Spark's line separator it makes text files of records valid WARC files.
RECORD_END = "\r\n\r\n"


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(key, record): one WARC/1.1 resource record per row, as text without its end mark.

    The record id is made of the row's key and address, the date is a parameter, so equal rows give equal records.
    Null bodies are empty, null addresses are absent, null keys stay null.
    """
    body, url = F.coalesce(F.col(body_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    digest = F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), url))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(F.col(id_col).cast("long").alias("key"), F.concat(head, body).alias("record"))


def write_warc(recs: DataFrame, path: str) -> None:
    """One WARC file per partition, in key order within the file."""
    recs.sortWithinPartitions("key").select("record").write.option("lineSep", RECORD_END).text(path)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = content.as_py()
            raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            at, rows = 0, []
            while at < len(raw):
                cut_at = raw.find(b"\r\n\r\n", at)
                size = re.search(rb"(?im)^content-length:\s*(\d+)", raw[at:cut_at]) if cut_at >= 0 else None
                if not raw.startswith(b"WARC/", at) or size is None:
                    rows.append((path, at, raw[at:], False))  # what can't be read is one damaged record to the end
                    break
                end = cut_at + 4 + int(size[1])
                rows.append((path, at, raw[at:end], end <= len(raw)))
                at = end + 4
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.binary(), pa.bool_()))], names=["path", "offset", "record", "whole"])


def read_warc(files: DataFrame) -> DataFrame:
    """(path, offset, record, whole) of the files of a ``binaryFile`` frame, plain or gzip; a torn tail is not whole."""
    return files.select("path", "content").mapInArrow(_parsed, "path string, offset long, record binary, whole boolean")


def layout(recs: DataFrame) -> DataFrame:
    """(key, nth, offset, length, digest): the records in key order as one stream, with their place in it.

    One range exchange of small rows; partition totals (one row a partition) carry the sums over partitions.
    """
    raw = F.col("record").cast("binary")
    rows = recs.select("key", (F.octet_length(raw).cast("long") + len(RECORD_END)).alias("length"), F.sha2(raw, 256).alias("digest"), F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange(shuffle_partitions(recs.sparkSession), "key", "digest", "tie").sortWithinPartitions("key", "digest", "tie")
    placed = cut(ordered.select("key", "length", "digest", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part").agg(F.sum("length").alias("b"), F.count("*").alias("n"))
    bases = sums.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    w = Window.partitionBy("part").orderBy("at")
    return placed.withColumns({"run": F.sum("length").over(w), "k": F.row_number().over(w)}).join(F.broadcast(bases), "part").select(
        "key", (F.col("n") + F.col("k") - 1).alias("nth"), (F.col("b") + F.col("run") - F.col("length")).alias("offset"), "length", "digest"
    )


def merkle_tree(placed: DataFrame) -> list[DataFrame]:
    """(level, node, first, last, hash) by level: level 0 has the records, each upper node the hash of up to 64 below it.

    A leaf's hash covers the record's offset, length and digest, so a tree vouches for an ordered range of offsets.
    The number of levels follows from the number of records; the last has the root alone. Without records: no rows.
    """
    leaf = placed.select("nth", "offset", "length", F.sha2(F.concat_ws(":", "offset", "length", "digest").cast("binary"), 256).alias("hash"))
    n = placed.count()
    width = lambda rows: max(1, rows // _LEVEL_ROWS)
    level = cut(leaf.select(F.lit(0).alias("level"), F.col("nth").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), "hash").coalesce(width(n)))
    k, tree = 0, [level]
    while n > 1:
        k += 1
        hashes = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: c["hash"])
        level = level.groupBy(F.expr(f"node div {FANOUT}").alias("node")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(F.array_join(hashes, "").cast("binary"), 256).alias("hash"))
        n = -(-n // FANOUT)
        # small levels are one partition, and then need no exchange
        level = cut(level.select(F.lit(k).alias("level"), "node", "first", "last", "hash").coalesce(width(n)))
        tree.append(level)
    return tree


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def audit(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """(node, left_first, left_last, right_first, right_last): the leaves in which two trees differ.

    Roots are compared first, then only the children of nodes that differ, level by level; equal trees end at the
    root. A node that one tree lacks differs (its other side is null). Trees of unlike height are compared from the
    lower one's root level on.
    """
    level = min(len(left), len(right)) - 1

    def compared(k: int, parents: DataFrame | None) -> DataFrame:
        side = []
        for name, t in (("left", left), ("right", right)):
            own = t[k].select("node", F.col("first").alias(f"{name}_first"), F.col("last").alias(f"{name}_last"), F.col("hash").alias(f"{name}_hash"))
            side.append(own if parents is None else own.withColumn("up", F.expr(f"node div {FANOUT}")).join(parents, "up", "left_semi").drop("up"))
        return side[0].join(side[1], "node", "full").where(_differs("left_hash", "right_hash"))

    bad = compared(level, None)
    while level:
        level -= 1
        bad = cut(compared(level, bad.select(F.col("node").alias("up"))).coalesce(_DIFFERENT))
    return bad.drop("left_hash", "right_hash")


def fixity(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per record of ``left`` and per record only ``right`` has: key, offset, length, digest, status.

    ``left`` and ``right`` are layouts. Status: ``intact``; ``corrupt`` (same key, other bytes), ``moved`` (same bytes
    at another offset, after a record that grew or shrank), ``missing`` (not in right) or ``extra`` (only there). The
    trees find the leaves that differ; only these are looked at. Ties and repeated rows are records of their own,
    null keys come first, empty tables give no rows.
    """
    bad = audit(merkle_tree(left), merkle_tree(right)).select(F.col("node").alias("nth"))
    ours = left.join(bad, "nth", "left_semi")
    theirs = right.join(bad, "nth", "left_semi")
    nth = lambda t: t.withColumn("copy", F.row_number().over(Window.partitionBy("key", "digest").orderBy("nth")))
    a = nth(ours).select(F.col("nth").alias("a_nth"), F.col("key").alias("a_key"), F.col("digest").alias("a_digest"), "copy")
    b = nth(theirs).select(F.col("key").alias("b_key"), F.col("offset").alias("b_offset"), F.col("length").alias("b_length"), F.col("digest").alias("b_digest"), F.col("copy").alias("b_copy"))
    same = F.col("a_key").eqNullSafe(F.col("b_key")) & (F.col("a_digest") == F.col("b_digest")) & (F.col("copy") == F.col("b_copy"))
    moved = a.join(b, same, "left_semi").select(F.col("a_nth").alias("nth"), F.lit("moved").alias("status"))
    lost, found = a.join(b, same, "left_anti"), b.join(a, same, "left_anti")
    keys = found.select(F.col("b_key").alias("k")).distinct()
    hurt = lost.join(keys, F.col("a_key").eqNullSafe(F.col("k")), "left").select(F.col("a_nth").alias("nth"), F.when(F.col("k").isNotNull(), "corrupt").otherwise("missing").alias("status"))
    # a null key that is found again can't be told from one that isn't by k alone
    extra = found.join(lost.select("a_key").distinct(), F.col("b_key").eqNullSafe(F.col("a_key")), "left_anti").select(F.col("b_key").alias("key"), F.col("b_offset").alias("offset"), F.col("b_length").alias("length"), F.col("b_digest").alias("digest"), F.lit("extra").alias("status"))
    told = left.join(moved.unionByName(hurt), "nth", "left").select("key", "offset", "length", "digest", F.coalesce("status", F.lit("intact")).alias("status"))
    return told.unionByName(extra)
