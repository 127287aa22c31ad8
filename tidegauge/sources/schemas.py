"""Table schemas as Spark DDL, and the constraints that their rows must meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tables of the domain.
TABLES: dict[str, str] = {
    "markets": "market_id string, venue string, ticker string, series_ticker string, title string, target string, open_time timestamp_ntz, close_time timestamp_ntz, status string, resolved_outcome int, resolution_time timestamp_ntz, tracked boolean",
    "market_queries": "market_id string, term_type string, term string",
    "posts": "post_id string, market_id string, created_at timestamp_ntz, ingested_at timestamp_ntz, author_id string, author_created_at timestamp_ntz, followers int, engagements int, lang string, text string, minhash array<bigint>, lsh_bucket string, filter_verdict string, filter_reason string, source string",
    "stances": "post_id string, market_id string, created_at timestamp_ntz, model_version string, stance double, confidence double, disagreement double",
    "signals": "market_id string, ts timestamp_ntz, model_version string, s_t double, p_hat double, calibration string, n_posts int, weight_sum double, half_life_seconds double",
    "market_prices": "market_id string, ts timestamp_ntz, source string, yes_price double, yes_bid double, yes_ask double, spread double, depth_bid double, depth_ask double, volume double, fetched_at timestamp_ntz",
    "sim_prices": "market_id string, ts timestamp_ntz, run_id string, sim_price double, b double, q_yes double, q_no double, cost double, trade_size double, signal double",
    "ledger_fills": "fill_id bigint, market_id string, ts timestamp_ntz, strategy string, side string, action string, quantity double, price double, cash_flow double, signal double, note string",
    "positions": "market_id string, strategy string, qty_yes double, qty_no double, cash double, realized_pnl double, settled boolean",
    "scores": "market_id string, model_version string, computed_at timestamp_ntz, n_obs int, calibration string, brier_signal double, brier_market double, bss double, resolved_outcome int, window_start timestamp_ntz, window_end timestamp_ntz, final boolean",
    "granger_results": "run_id string, market_id string, model_version string, direction string, lag_order int, n_obs int, f_stat double, p_value double, p_value_adj double, significant boolean",
    "read_budget": "day date, service string, reads_used int",
}

#: Keys, and what must hold in each row.
KEYS: dict[str, tuple[str, ...]] = {
    "markets": ("market_id",),
    "market_queries": ("market_id", "term_type", "term"),
    "posts": ("post_id", "market_id", "created_at"),
    "stances": ("post_id", "market_id", "model_version", "created_at"),
    "signals": ("market_id", "ts", "model_version"),
    "market_prices": ("market_id", "ts", "source"),
    "sim_prices": ("market_id", "ts", "run_id"),
    "ledger_fills": ("fill_id", "ts"),
    "positions": ("market_id", "strategy"),
    "scores": ("market_id", "model_version", "computed_at"),
    "granger_results": ("run_id", "market_id", "model_version", "direction"),
    "read_budget": ("day", "service"),
}
CHECKS: dict[str, tuple[str, ...]] = {
    "markets": ("venue IN ('kalshi', 'polymarket')", "status IN ('open', 'closed', 'settled')", "resolved_outcome IS NULL OR resolved_outcome IN (0, 1)", "(status = 'settled') = (resolved_outcome IS NOT NULL)", "market_id = concat(venue, ':', ticker)"),
    "market_queries": ("term_type IN ('keyword', 'hashtag', 'entity', 'exclude')",),
    "posts": ("followers >= 0", "engagements >= 0", "filter_verdict IN ('accepted', 'bot', 'duplicate', 'low_quality', 'off_topic')", "source IN ('x', 'fixture')"),
    "stances": ("stance BETWEEN -1 AND 1", "confidence BETWEEN 0 AND 1", "disagreement IS NULL OR disagreement >= 0"),
    "signals": ("s_t BETWEEN -1 AND 1", "p_hat IS NULL OR p_hat BETWEEN 0 AND 1", "half_life_seconds > 0", "(p_hat IS NULL) = (calibration IS NULL)"),
    "market_prices": ("yes_price IS NULL OR yes_price BETWEEN 0 AND 1", "yes_bid IS NULL OR yes_bid BETWEEN 0 AND 1", "yes_ask IS NULL OR yes_ask BETWEEN 0 AND 1", "coalesce(least(spread, depth_bid, depth_ask, volume), 0) >= 0", "source = 'book' OR (depth_bid IS NULL AND depth_ask IS NULL)"),
    "sim_prices": ("b > 0", "sim_price BETWEEN 0 AND 1"),
    "ledger_fills": ("side IN ('yes', 'no')", "action IN ('buy', 'sell', 'settle')", "quantity > 0", "price BETWEEN 0 AND 1"),
    "positions": (),
    "scores": ("n_obs > 0", "brier_signal BETWEEN 0 AND 1", "brier_market BETWEEN 0 AND 1"),
    "granger_results": ("lag_order > 0", "p_value BETWEEN 0 AND 1", "p_value_adj IS NULL OR p_value_adj BETWEEN 0 AND 1"),
    "read_budget": ("reads_used >= 0",),
}


def read_table(spark, path: str, name: str) -> DataFrame:
    """A stored table with its declared schema: nothing is inferred."""
    return spark.read.schema(TABLES[name]).parquet(path)


def violations(df: DataFrame, name: str) -> DataFrame:
    """(check, n): how many rows break each constraint that any row breaks, repeated or null keys among them; one pass each."""
    key = KEYS[name]
    present = [c for c in CHECKS[name] if set(df.columns) >= {w for w in df.sparkSession.createDataFrame([], TABLES[name]).columns if w in c.replace("(", " ").replace(",", " ").replace(")", " ").split()}]
    sums = [F.sum(F.when(F.coalesce(F.expr(c), F.lit(False)), 0).otherwise(1)).alias(f"c{i}") for i, c in enumerate(present)]
    sums.append(F.sum(F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in (*key, key[0])]) > 0, 1).otherwise(0)).alias("nulls"))
    one = df.agg(*sums)
    pairs = [F.struct(F.lit(c).alias("check"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n")) for i, c in enumerate(present)]
    pairs.append(F.struct(F.lit(f"key {', '.join(key)} is not null").alias("check"), F.coalesce(F.col("nulls"), F.lit(0)).alias("n")))
    rows = one.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    twice = df.groupBy(*key).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit(f"key {', '.join(key)} is unique").alias("check"), "n")
    return rows.unionByName(twice).where("n > 0")
