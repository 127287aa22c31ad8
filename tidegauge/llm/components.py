"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

_ROUNDS = 60
_ONE_TASK = 100_000  # edges that one task holds with ease: such a table needs no exchange


def _with_least(edges: DataFrame, one_task: bool) -> DataFrame:
    """``edges(u, v)`` with m, the least v of each u. A window needs no exchange of one partition; a join would."""
    if one_task:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; the root is the least node of the component.

    Each step is a minimum per node (combined before the exchange) and an equi-join, so hubs are no single task's
    load; the edges stay distributed, unless they are so few that one task does it without an exchange. Ends when a
    round changes no edge; a round's edges are cut from their lineage.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    one_task = e.count() <= _ONE_TASK
    sums = None
    for _ in range(_ROUNDS):
        if one_task:
            e = e.coalesce(1)
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = _with_least(both, one_task).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        small = _with_least(large, one_task).select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.expr("cast(xxhash64(v, u) as decimal(38,0))")).alias("s")).first()
        if now == sums:
            break
        sums = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
