"""Contiguous shards of near-equal bytes from global prefix sums, in DataFrame functions only; equal texts stay together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, shuffle_partitions

#: A group of this part of a shard or more is heavy: at most ``shards * _PART`` groups are.
_PART = 64
_GROUP = ("h", "size", "text_crc32")


def _dealt(heavy: DataFrame, shards: int) -> DataFrame:
    """(h, size, text_crc32, shard): heavy groups, the largest first, each to the shard that has the least of them so far."""
    listed = heavy.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), *_GROUP))).alias("g"))
    zeros = F.array_repeat(F.lit(0).cast("long"), shards)

    def put(state, g):
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads = F.transform(state["loads"], lambda x, i: F.when(i == at, x - g["less"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["shards"], F.array(at)).alias("shards"))

    start = F.struct(zeros.alias("loads"), F.array().cast("array<int>").alias("shards"))
    folded = listed.select("g", F.aggregate("g", start, put)["shards"].alias("s"))
    return folded.select(F.explode(F.arrays_zip("g", "s")).alias("x")).select(*[F.col(f"x.g.{c}").alias(c) for c in _GROUP], F.col("x.s").alias("heavy_shard"))


def _edges(heavy: DataFrame, dealt: DataFrame, light_bytes: int, shards: int) -> DataFrame:
    """One row: ``edges``, where each shard's share of the light rows' bytes ends, and ``light``, all of them.

    Shards are filled up to one level, as water fills a vessel with steps; shards that heavy groups lift above it get
    nothing more.
    """
    spark = heavy.sparkSession
    loads = (
        spark.range(0, shards, 1, 1).select(F.col("id").cast("int").alias("shard"))
        .join(dealt.join(heavy.select(*_GROUP, "bytes"), list(_GROUP)).groupBy(F.col("heavy_shard").alias("shard")).agg(F.sum("bytes").alias("load")), "shard", "left")
        .select("shard", F.coalesce("load", F.lit(0)).alias("load"))
    )
    rising = Window.orderBy("load", "shard")
    level = loads.select("load", ((F.sum("load").over(rising) + light_bytes) / F.row_number().over(rising)).alias("level")).where("level >= load").agg(F.min("level").alias("level"))
    room = loads.crossJoin(F.broadcast(level)).select("shard", F.greatest(F.lit(0.0), F.col("level") - F.col("load")).alias("room"))
    ends = room.select("shard", F.sum("room").over(Window.orderBy("shard")).alias("end"))
    return ends.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("edges"))


def byte_shards(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, overhead: int = 16) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard and slot (gapless from 0 in each shard).

    Rows are put in the order of their text's hash by one range exchange of a few numbers a row (texts don't move), each
    partition's rows are numbered and summed, and the totals of the partitions before it are added: a table of one
    row per partition. The order is cut at the shards' targets.

    Groups of equal texts stay whole: a group goes where its middle byte falls. So that shards are near equal all the
    same, groups of a 64th of a shard or more (2,560 at most for 40 shards) are dealt out first, the largest first,
    and the others fill each shard up to one level: shards differ by about a 64th, and by more only where whole groups
    forbid it. A group larger than a shard can't stay whole without breaking that law: it is spread like any rows,
    so that a text with a third of all rows fills its share of shards.

    Null text: no bytes, checksum 0, a group with the empty text. Null ids come first in their group. Repeated rows and
    ties of the id stay separate rows in an arbitrary but fixed order (the range keys end in a row number, so that a
    hot text spreads over partitions). An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + F.lit(overhead).cast("long")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [*_GROUP, "id", "tie"]
    ordered = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut(ordered.select(*_GROUP, "id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))

    total = placed.agg(F.sum("size")).first()[0] or 0
    groups = placed.groupBy(*_GROUP).agg(F.sum(F.col("size")).alias("bytes"))
    heavy = cut(groups.where((F.col("bytes") * (shards * _PART) >= total) & (F.col("bytes") * shards <= total)))
    dealt = cut(_dealt(heavy, shards))
    light_bytes = total - (heavy.agg(F.sum("bytes")).first()[0] or 0)
    marked = placed.join(F.broadcast(dealt), list(_GROUP), "left").withColumn("light_size", F.when(F.col("heavy_shard").isNull(), F.col("size")).otherwise(0))

    # one row for each partition, however large the table
    def bases(frame: DataFrame, *sums: str) -> DataFrame:
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = frame.groupBy("part").agg(*[F.sum(c).alias(c) for c in sums])
        return parts.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums])

    inside = Window.partitionBy("part").orderBy("at")
    own = Window.partitionBy("part", *_GROUP)
    summed = marked.withColumn("ahead", F.sum("light_size").over(inside) - F.col("light_size")).join(F.broadcast(bases(marked, "light_size")), "part")
    started = summed.withColumn("start", F.col("ahead") + F.col("light_size_before"))
    local = started.withColumns({"g_start": F.min("start").over(own), "g_bytes": F.sum("light_size").over(own)})
    # a group that goes on in other partitions: one at each border at most
    ends = placed.groupBy("part").agg(F.array(F.min(F.struct(*_GROUP)), F.max(F.struct(*_GROUP))).alias("k")).select("part", F.explode("k").alias("k")).distinct()
    across = ends.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k.*")
    wide = started.join(F.broadcast(across), list(_GROUP)).groupBy(*_GROUP).agg(F.min("start").alias("w_start"), F.sum("light_size").alias("w_bytes"))
    known = local.join(F.broadcast(wide), list(_GROUP), "left")
    g_start, g_bytes = F.coalesce("w_start", "g_start"), F.coalesce("w_bytes", "g_bytes")
    # the rows of a group that is larger than a shard go where their own middle byte falls
    middle = F.when(g_bytes * shards > total, F.col("start") + F.col("size") / 2).otherwise(g_start + g_bytes / 2)
    edge = F.broadcast(_edges(heavy, dealt, light_bytes, shards))
    shard = F.coalesce(F.col("heavy_shard"), F.least(F.lit(shards - 1), F.size(F.filter("edges", lambda e: e <= middle))))
    cast = known.crossJoin(edge).select("id", "size", "text_crc32", "part", "at", shard.cast("int").alias("shard"))
    in_shard = Window.partitionBy("part", "shard").orderBy("at")
    counts = cast.groupBy("part", "shard").agg(F.count("*").alias("n"))
    first = counts.select("part", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    # in all a row for each partition, shard and heavy group, and as many again at their borders
    numbered = cast.withColumn("nth", F.row_number().over(in_shard) - 1).join(F.broadcast(first), ["part", "shard"])
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))
