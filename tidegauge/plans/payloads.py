"""Queries over venue payloads: the driver's rows written as the venues' JSON and parsed again, with SQL that never saw JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks, venues
from ..sources.adapters import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def text(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def payload(*fields, keys: list[str] | None = None) -> list:
    return [*(keys or []), F.to_json(F.struct(*fields)).alias("payload")]


def listed(*fields):
    return F.collect_list(F.struct(*fields))


def nth(values: list, at) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def seconds(day: str) -> F.Column:
    return F.datediff(F.to_date(day), F.lit("1970-01-01").cast("date")).cast("long") * 86_400


_STATUS = ["unopened", "Open", "active", "initialized", "closed", "determined", "settled", "finalized", "odd"]
_CLOSE = "CAST('2024-01-' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0') || ' 12:30:00' AS VARCHAR)"


def _close_time():
    return F.concat(F.lit("2024-01-"), F.lpad(text(1 + F.col("p_partkey") % 28), 2, "0"), F.lit("T12:30:00Z"))


@query(f"""
WITH m AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS o, CASE WHEN p_partkey % 9 IN (4, 5) THEN 'closed' WHEN p_partkey % 9 IN (6, 7) THEN 'settled' ELSE 'open' END AS s FROM part)
SELECT 'kalshi:P' || p_partkey AS market_id, 'kalshi' AS venue, 'P' || p_partkey AS ticker, p_name AS title, {_CLOSE} AS close_time,
       CASE WHEN o IS NOT NULL THEN 'settled' WHEN s = 'settled' THEN 'closed' ELSE s END AS status, CAST(o AS INTEGER) AS resolved_outcome FROM m""")
def kalshi_markets(spark, d):
    p = table(spark, d, "part")
    raw = p.select(*payload(F.concat(F.lit("P"), text("p_partkey")).alias("ticker"), F.col("p_name").alias("title"), nth(_STATUS, F.col("p_partkey") % 9).alias("status"), nth(["yes", "No", "", None], F.col("p_partkey") % 4).alias("result"), _close_time().alias("close_time")))
    m = venues.kalshi_markets(raw)
    return m.select("market_id", "venue", "ticker", "title", F.date_format("close_time", "yyyy-MM-dd HH:mm:ss").alias("close_time"), "status", F.col("resolved_outcome").cast("int").alias("resolved_outcome"))


@query("""
WITH c AS (SELECT 'kalshi:' || o_custkey AS market_id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 AS ts, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 90) / 100.0::DOUBLE END AS yes_price,
                  (o_orderkey % 50) / 100.0::DOUBLE AS yes_bid, (o_orderkey % 61) / 100.0::DOUBLE AS yes_ask, CAST(o_orderkey % 1000 AS DOUBLE) AS volume FROM orders)
SELECT market_id, ts, 'candle' AS source, round(yes_price, 6) AS yes_price, round(yes_bid, 6) AS yes_bid, round(yes_ask, 6) AS yes_ask, volume, round(CASE WHEN yes_ask >= yes_bid THEN yes_ask - yes_bid END, 6) AS spread FROM c""")
def kalshi_candles(spark, d):
    key = F.col("o_orderkey")
    dollars = lambda c: F.struct(text(c / 100.0).alias("close_dollars"))
    one = F.struct(seconds("o_orderdate").alias("end_period_ts"), dollars(key % 50).alias("yes_bid"), dollars(key % 61).alias("yes_ask"), F.when(key % 6 != 0, dollars(key % 90)).alias("price"), text(key % 1000).alias("volume"))
    raw = table(spark, d, "orders").groupBy(F.concat(F.lit("kalshi:"), text("o_custkey")).alias("market_id")).agg(F.collect_list(one).alias("candlesticks"))
    return rounded(venues.kalshi_candles(raw.select(*payload("candlesticks", keys=["market_id"]))).withColumn("ts", F.unix_seconds("ts")))


_BEST = "max(l_quantity) FILTER (l_discount = b)"


@query(f"""
WITH w AS (SELECT *, max(l_discount) OVER (PARTITION BY l_orderkey) AS b, max(l_tax) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
q AS (SELECT 'kalshi:' || l_orderkey AS market_id, any_value(b) AS yes_bid, 1 - any_value(n) AS yes_ask, {_BEST} AS depth_bid, max(l_quantity) FILTER (l_tax = n) AS depth_ask FROM w GROUP BY l_orderkey)
SELECT market_id, 'book' AS source, round(yes_bid, 6) AS yes_bid, round(yes_ask, 6) AS yes_ask, depth_bid, depth_ask, round((yes_bid + yes_ask) / 2, 6) AS yes_price, round(CASE WHEN yes_ask - yes_bid >= 0 THEN yes_ask - yes_bid END, 6) AS spread FROM q""")
def kalshi_book(spark, d):
    level = lambda p: F.collect_list(F.array(text(p), text("l_quantity")))
    raw = table(spark, d, "lineitem").groupBy(F.concat(F.lit("kalshi:"), text("l_orderkey")).alias("market_id")).agg(level("l_discount").alias("yes_dollars"), level("l_tax").alias("no_dollars"))
    raw = raw.select(*payload(F.struct("yes_dollars", "no_dollars").alias("orderbook_fp"), keys=["market_id"]), F.lit(0).alias("fetched_at"))
    return rounded(venues.kalshi_book(raw).drop("ts"))


@query("""
WITH l AS (SELECT l_orderkey, l_discount AS bid, CASE WHEN l_orderkey % 5 <> 0 THEN 0.1::DOUBLE + l_tax END AS ask, l_quantity AS s FROM lineitem),
w AS (SELECT *, max(bid) OVER (PARTITION BY l_orderkey) AS b, min(ask) OVER (PARTITION BY l_orderkey) AS a FROM l),
q AS (SELECT 'polymarket:' || l_orderkey AS market_id, any_value(b) AS yes_bid, any_value(a) AS yes_ask, max(s) FILTER (bid = b) AS depth_bid, max(s) FILTER (ask = a) AS depth_ask FROM w GROUP BY l_orderkey)
SELECT market_id, 'book' AS source, round(yes_bid, 6) AS yes_bid, round(yes_ask, 6) AS yes_ask, depth_bid, depth_ask, round(coalesce((yes_bid + yes_ask) / 2, 0.4::DOUBLE), 6) AS yes_price, round(CASE WHEN yes_ask - yes_bid >= 0 THEN yes_ask - yes_bid END, 6) AS spread FROM q""")
def polymarket_book(spark, d):
    size = text("l_quantity").alias("size")
    asks = F.collect_list(F.when(F.col("l_orderkey") % 5 != 0, F.struct(text(F.lit(0.1) + F.col("l_tax")).alias("price"), size)))
    raw = table(spark, d, "lineitem").groupBy(F.concat(F.lit("polymarket:"), text("l_orderkey")).alias("market_id")).agg(listed(text("l_discount").alias("price"), size).alias("bids"), asks.alias("asks"))
    raw = raw.select(*payload("bids", "asks", F.lit("0.4").alias("last_trade_price"), keys=["market_id"]), F.lit(0).alias("fetched_at"))
    return rounded(venues.polymarket_book(raw).drop("ts"))


@query("""
SELECT 'polymarket:' || o_custkey AS market_id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 AS ts, 'candle' AS source, (o_orderkey % 100) / 100.0::DOUBLE AS yes_price FROM orders WHERE o_orderkey % 7 <> 0""")
def polymarket_history(spark, d):
    point = F.struct(seconds("o_orderdate").alias("t"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 100) / 100.0).alias("p"))
    raw = table(spark, d, "orders").groupBy(F.concat(F.lit("polymarket:"), text("o_custkey")).alias("market_id")).agg(F.collect_list(point).alias("history"))
    return rounded(venues.polymarket_history(raw.select(*payload("history", keys=["market_id"]))).withColumn("ts", F.unix_seconds("ts")))


_PRICES = ['["1", "0"]', '["0", "1"]', '["0.995", "0.005"]', '["0.5", "0.5"]', None]


def _poly(spark, d) -> DataFrame:
    p, key = table(spark, d, "part"), F.col("p_partkey")
    quote = lambda c, unless: F.when(key % unless != 0, text(c / 100.0))
    fields = [
        F.concat(F.lit("0x"), text("p_partkey")).alias("conditionId"), F.col("p_name").alias("question"), (key % 3 == 0).alias("closed"),
        nth(['["Yes", "No"]', '["No", " yes "]'], key % 2).alias("outcomes"), nth(_PRICES, key % 5).alias("outcomePrices"),
        F.concat(F.lit('["a'), text("p_partkey"), F.lit('", "b'), text("p_partkey"), F.lit('"]')).alias("clobTokenIds"), _close_time().alias("endDate"),
        quote(key % 50, 11).alias("bestBid"), quote(key % 61, 13).alias("bestAsk"), quote(key % 70, 17).alias("lastTradePrice"), F.when(key % 19 == 0, F.lit("0.02")).alias("spread"),
    ]
    return p.select(*payload(*fields), F.lit(0).alias("fetched_at"))


@query(f"""
WITH m AS (SELECT *, p_partkey % 3 = 0 AS closed, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0.995 WHEN 3 THEN 0.5 END AS first FROM part),
y AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN first ELSE 1 - first END AS p FROM m),
o AS (SELECT *, CASE WHEN closed AND p >= 0.99 THEN 1 WHEN closed AND p <= 0.01 THEN 0 END AS o FROM y)
SELECT 'polymarket:0x' || p_partkey AS market_id, 'polymarket' AS venue, '0x' || p_partkey AS ticker, p_name AS title, {_CLOSE} AS close_time,
       CASE WHEN o IS NOT NULL THEN 'settled' WHEN closed THEN 'closed' ELSE 'open' END AS status, CAST(o AS INTEGER) AS resolved_outcome FROM o""")
def polymarket_markets(spark, d):
    m = venues.polymarket_markets(_poly(spark, d))
    return m.withColumns({"close_time": F.date_format("close_time", "yyyy-MM-dd HH:mm:ss"), "resolved_outcome": F.col("resolved_outcome").cast("int")})


@query("SELECT '0x' || p_partkey AS ticker, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END || p_partkey AS token_id FROM part")
def polymarket_yes_token(spark, d):
    return venues.yes_token(_poly(spark, d))


@query("""
WITH q AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey % 50) / 100.0::DOUBLE END AS b, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 61) / 100.0::DOUBLE END AS a, CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey % 70) / 100.0::DOUBLE END AS t FROM part)
SELECT 'polymarket:0x' || p_partkey AS market_id, 'quote' AS source, b AS yes_bid, a AS yes_ask, round(coalesce((b + a) / 2, t), 6) AS yes_price, round(CASE WHEN p_partkey % 19 = 0 THEN 0.02 WHEN a - b >= 0 THEN a - b END, 6)::DOUBLE AS spread FROM q""")
def polymarket_quotes(spark, d):
    return rounded(venues.polymarket_quotes(_poly(spark, d)).drop("ts"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS post_id, strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id), '%Y-%m-%d %H:%M:%S') AS created_at, CAST(doc_id % 7 AS VARCHAR) AS author_id,
       CASE WHEN doc_id % 7 = 6 THEN 0 ELSE CAST(doc_id % 7 * 10 AS INTEGER) END AS followers, CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE doc_id % 5 END + doc_id % 3 + doc_id % 11 + doc_id % 13 AS INTEGER) AS engagements, lang, md5(text) AS digest FROM documents""")
def x_posts(spark, d):
    """Search pages of 40 posts each; the seventh author is missing from a page's users."""
    key = F.col("doc_id")
    count = lambda n: (key % n).cast("int")
    time = F.date_format(F.timestamp_add("SECOND", key, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    metrics = F.struct(F.when(key % 2 != 0, count(5)).alias("like_count"), count(3).alias("retweet_count"), count(11).alias("reply_count"), count(13).alias("quote_count"))
    post = F.struct(text("doc_id").alias("id"), time.alias("created_at"), text(key % 7).alias("author_id"), "lang", "text", metrics.alias("public_metrics"))
    user = F.when(key % 7 != 6, F.struct(text(key % 7).alias("id"), F.lit("2020-05-01T00:00:00Z").alias("created_at"), F.struct((count(7) * 10).alias("followers_count")).alias("public_metrics")))
    pages = table(spark, d, "documents").groupBy(F.expr("doc_id div 40")).agg(F.collect_list(post).alias("data"), F.collect_set(user).alias("users"))
    p = venues.x_posts(pages.select(*payload("data", F.struct("users").alias("includes"))))
    return p.select("post_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "author_id", "followers", F.col("engagements").cast("int").alias("engagements"), "lang", F.md5("text").alias("digest"))


@query("""
SELECT CAST(event_id AS VARCHAR) AS post_id, TIMESTAMP '2025-06-01' - ((SELECT max(ts) FROM events) - ts) AS created_at FROM events""")
def replay_anchored(spark, d):
    """Stored posts moved so that the newest is at a given time."""
    posts = table(spark, d, "events").select(text("event_id").alias("post_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"))
    return venues.replay(posts, anchor=F.expr("TIMESTAMP_NTZ '2025-06-01 00:00:00'")).select("post_id", "created_at")


@query("""
SELECT c_custkey, c_nationkey, 'old' AS side FROM customer WHERE c_nationkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, 1, 'new' FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey % 2 = 1)""")
def replaced_groups(spark, d):
    """Customers of odd nations go out for one new row of each buying customer, of the nations 1, 3, 5, ..."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("c_nationkey"), F.lit("old").alias("side"))
    buying = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumns({"c_nationkey": F.lit(1), "side": F.lit("new")})
    odd = c.withColumn("parity", F.col("c_nationkey") % 2)
    return sinks.replace_groups(odd, buying.withColumn("parity", F.lit(1)), group=["parity"]).drop("parity")
