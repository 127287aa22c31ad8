"""The domain's tables made from the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST_MODEL, SECOND_MODEL = "lex-1", "lex-2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("kalshi:"), F.upper("event_type")).alias("market_id"), "user_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("event_id") % 10 == 0, "duplicate").when(F.col("event_id") % 14 == 0, "low_quality").otherwise("accepted")
    return _events(spark, sf_dir).where("event_id % 2 = 0").select(
        F.col("event_id").cast("string").alias("post_id"), "market_id", F.col("ts").alias("created_at"),
        F.col("user_id").cast("string").alias("author_id"), F.col("user_id").cast("int").alias("followers"),
        F.col("k").alias("engagements"), verdict.alias("filter_verdict"),
    )


def stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _events(spark, sf_dir).where("event_id % 2 = 0")
    first = (F.col("k") - 50) / 50.0
    second = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 245) / 245.0))
    both = []
    for version, stance, some in ((FIRST_MODEL, first, F.lit(True)), (SECOND_MODEL, second, F.col("event_id") % 6 != 0)):
        both.append(base.where(some).select(F.col("event_id").cast("string").alias("post_id"), "market_id", F.col("ts").alias("created_at"), F.lit(version).alias("model_version"), stance.alias("stance"), F.abs(stance).alias("confidence")))
    return both[0].unionByName(both[1])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("event_id") % 50 != 25, F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("value") / 200.0)))
    book = F.col("event_id") % 4 == 3
    return _events(spark, sf_dir).where("event_id % 2 = 1").select(
        F.col("event_id").alias("tick_id"), "market_id", "ts", F.when(book, "book").otherwise("candle").alias("source"), price.alias("yes_price"),
        F.when(book, price - 0.01).alias("yes_bid"), F.when(book, price + 0.01).alias("yes_ask"),
        F.when(book, 10.0 * F.col("user_id")).alias("depth_bid"), F.when(book, 10.0 * F.col("k")).alias("depth_ask"),
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each kind of event: a handful, whatever the number of events."""
    one = _events(spark, sf_dir).groupBy("market_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    nth = one.withColumn("r", F.row_number().over(Window.orderBy("market_id")))
    settled = F.col("r") % 2 == 1
    return nth.select(
        "market_id", F.lit("kalshi").alias("venue"), F.substring("market_id", 8, 1000).alias("ticker"), F.initcap(F.substring("market_id", 8, 1000)).alias("title"),
        (F.col("last") - F.expr("make_interval(0, 0, 0, r)")).alias("close_time"), F.when(settled, "settled").when(F.col("r") == 2, "open").otherwise("closed").alias("status"),
        F.when(settled, (F.col("n") % 2).cast("int")).alias("resolved_outcome"), (F.col("r") != 3).alias("tracked"),
    )


#: The same tables in SQL, to put before a query.
PRELUDE = """
WITH ev AS (SELECT event_id, ts, 'kalshi:' || upper(event_type) AS market_id, user_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
posts AS (
  SELECT CAST(event_id AS VARCHAR) AS post_id, market_id, ts AS created_at, CAST(user_id AS VARCHAR) AS author_id, CAST(user_id AS INTEGER) AS followers, k AS engagements,
         CASE WHEN event_id % 10 = 0 THEN 'duplicate' WHEN event_id % 14 = 0 THEN 'low_quality' ELSE 'accepted' END AS filter_verdict
  FROM ev WHERE event_id % 2 = 0),
stances AS (
  SELECT CAST(event_id AS VARCHAR) AS post_id, market_id, ts AS created_at, 'lex-1' AS model_version, CAST(k - 50 AS DOUBLE) / 50 AS stance, abs(CAST(k - 50 AS DOUBLE) / 50) AS confidence FROM ev WHERE event_id % 2 = 0
  UNION ALL
  SELECT CAST(event_id AS VARCHAR), market_id, ts, 'lex-2', greatest(-1.0, least(1.0, (value - 245) / 245)), abs(greatest(-1.0, least(1.0, (value - 245) / 245))) FROM ev WHERE event_id % 2 = 0 AND event_id % 6 <> 0),
tk AS (SELECT *, CASE WHEN event_id % 50 <> 25 THEN least(0.99::DOUBLE, greatest(0.01::DOUBLE, value / 200)) END AS price, event_id % 4 = 3 AS book FROM ev WHERE event_id % 2 = 1),
ticks AS (
  SELECT event_id AS tick_id, market_id, ts, CASE WHEN book THEN 'book' ELSE 'candle' END AS source, price AS yes_price,
         CASE WHEN book THEN price - 0.01::DOUBLE END AS yes_bid, CASE WHEN book THEN price + 0.01::DOUBLE END AS yes_ask,
         CASE WHEN book THEN 10.0::DOUBLE * user_id END AS depth_bid, CASE WHEN book THEN 10.0::DOUBLE * k END AS depth_ask FROM tk),
mk AS (SELECT market_id, count(*) AS n, max(ts) AS last, row_number() OVER (ORDER BY market_id) AS r FROM ev GROUP BY market_id),
markets AS (
  SELECT market_id, 'kalshi' AS venue, substr(market_id, 8) AS ticker, last - to_days(CAST(r AS INTEGER)) AS close_time,
         CASE WHEN r % 2 = 1 THEN 'settled' WHEN r = 2 THEN 'open' ELSE 'closed' END AS status, CASE WHEN r % 2 = 1 THEN CAST(n % 2 AS INTEGER) END AS resolved_outcome, r <> 3 AS tracked FROM mk),
mids AS (SELECT *, coalesce((yes_bid + yes_ask) / 2, yes_price) AS mid FROM ticks)
"""
