"""The stored tables' queries: queues, latest rows, pairs for fits, term pivots, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT, SCORE_LIMIT = 5_000, 10_000, 500


def clamp_limit(limit: int | None) -> int:
    if limit is None:
        return DEFAULT_LIMIT
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return min(limit, MAX_LIMIT)


def tracked_markets(markets: DataFrame, *, unsettled: bool = False) -> DataFrame:
    kept = markets.where("tracked")
    return (kept.where("status <> 'settled'") if unsettled else kept).orderBy("market_id")


def resolution_queue(markets: DataFrame, now: Column) -> DataFrame:
    return markets.where("tracked AND status <> 'settled' AND close_time IS NOT NULL").where(F.col("close_time") <= now).orderBy("close_time", "market_id")


def between(df: DataFrame, *, on: str, since=None, until=None, **equal) -> DataFrame:
    """Rows from since to until with the given values; what is None filters nothing, so only real predicates reach the scan."""
    for value, test in ((since, lambda v: F.col(on) >= v), (until, lambda v: F.col(on) <= v)):
        df = df if value is None else df.where(test(value))
    for name, value in equal.items():
        df = df if value is None else df.where(F.col(name) == value)
    return df


def unscored_posts(posts: DataFrame, stances: DataFrame, model_version: str, limit: int | None = None) -> DataFrame:
    """Posts without a stance of this model, newest first."""
    done = stances.where(F.col("model_version") == model_version).select("post_id", "market_id", "created_at")
    left = posts.join(done, ["post_id", "market_id", "created_at"], "left_anti").orderBy(F.desc("created_at"), "post_id")
    return left if limit is None else left.limit(limit)


def scored_posts(posts: DataFrame, stances: DataFrame, model_version: str, **window) -> DataFrame:
    """The columns that a signal needs, of accepted posts, in order of time."""
    done = stances.where(F.col("model_version") == model_version).select("post_id", "market_id", "created_at", "stance")
    kept = between(posts.where("filter_verdict = 'accepted'"), on="created_at", **window)
    return kept.join(done, ["post_id", "market_id", "created_at"]).select("market_id", "created_at", "stance", "followers", "engagements").orderBy("created_at")


def latest(df: DataFrame, *, by: list[str], on: str, tie: list[str] | None = None) -> DataFrame:
    """The last row of each key: one hash aggregation."""
    order = F.struct(F.col(on).alias("_0"), *[F.col(t) for t in tie or []])
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def resolved_pairs(markets: DataFrame, signals: DataFrame, *, on: str = "ts") -> DataFrame:
    """(market_id, s_t, outcome): each settled market's last signal at or before its close."""
    done = markets.where("status = 'settled'").select("market_id", "close_time", F.col("resolved_outcome").alias("outcome"))
    seen = signals.join(done, "market_id").where(F.col("close_time").isNull() | (F.col(on) <= F.col("close_time")))
    return latest(seen.select("market_id", on, "s_t", "outcome"), by=["market_id"], on=on).select("market_id", "s_t", "outcome")


def latest_run(results: DataFrame, *, computed: str = "computed_at") -> DataFrame:
    """The rows of the run computed last, by adjusted p."""
    newest = results.agg(F.max_by("run_id", computed).alias("_run"))
    return results.join(F.broadcast(newest), F.col("run_id") == F.col("_run")).drop("_run").orderBy("p_value_adj", "p_value")


def query_lists(queries: DataFrame) -> DataFrame:
    """(market_id, one sorted array of terms for each type): one pass, not one query a market."""
    kinds = {"keywords": "keyword", "hashtags": "hashtag", "entities": "entity", "excludes": "exclude"}
    return queries.groupBy("market_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("term_type") == kind, F.col("term")))).alias(name) for name, kind in kinds.items()])


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table; counts of stored tables come from their metadata."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def topk_per_key(df: DataFrame, *, by: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")
