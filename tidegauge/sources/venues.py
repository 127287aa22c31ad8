"""Readers of posts and market configs, and projections of the venues' JSON payloads.

Fetching is left to the caller: each function takes a frame with a column of raw payloads, so a poll's answers can be
stored as text and parsed again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import micros, parse_time, string_array

#: Fixed values of the payloads.
POST = "post_id string, id string, created_at string, author_id string, author_created_at string, followers int, engagements int, lang string, text string"
STATUS = {"unopened": "open", "open": "open", "active": "open", "initialized": "open", "closed": "closed", "determined": "closed", "settled": "settled", "finalized": "settled"}
KALSHI_MARKET = "struct<ticker:string,title:string,status:string,result:string,open_time:string,close_time:string,expiration_time:string>"
KALSHI_CANDLES = "struct<candlesticks:array<struct<end_period_ts:bigint,yes_bid:struct<close_dollars:string>,yes_ask:struct<close_dollars:string>,price:struct<close_dollars:string>,volume:string>>>"
KALSHI_BOOK = "struct<orderbook_fp:struct<yes_dollars:array<array<string>>,no_dollars:array<array<string>>>>"
POLY_MARKET = "struct<conditionId:string,question:string,closed:boolean,outcomes:string,outcomePrices:string,clobTokenIds:string,endDate:string,bestBid:string,bestAsk:string,lastTradePrice:string,spread:string>"
POLY_BOOK = "struct<bids:array<struct<price:string,size:string>>,asks:array<struct<price:string,size:string>>,last_trade_price:string>"
POLY_HISTORY = "struct<history:array<struct<t:bigint,p:double>>>"
X_PAGE = "struct<data:array<struct<id:string,created_at:string,author_id:string,lang:string,text:string,public_metrics:struct<like_count:int,retweet_count:int,reply_count:int,quote_count:int>>>,includes:struct<users:array<struct<id:string,created_at:string,public_metrics:struct<followers_count:int>>>>>"
OBSERVATION = "timestamp bigint, signal double, market_price double, yes_bid double, yes_ask double, depth_bid double, depth_ask double"


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of posts; blank lines and lines of ``//`` are skipped, a line that isn't an object is dropped, bad JSON raises with its file."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file")).where("line <> '' AND NOT startswith(line, '//')")
    parsed = lines.withColumn("v", F.expr("try_parse_json(line)"))
    checked = parsed.where(F.when(F.col("v").isNull(), F.raise_error(F.concat(F.col("file"), F.lit(": not JSON: "), F.substring("line", 1, 80))).cast("boolean")).otherwise(F.startswith("line", F.lit("{"))))
    p = checked.select(F.from_json("line", POST).alias("p")).select("p.*")
    time = lambda c: F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(F.col(c), "T", " "), r"(Z|[+-]00:?00)$", ""))
    return p.select(F.coalesce("post_id", "id").alias("post_id"), time("created_at").alias("created_at"), "author_id", time("author_created_at").alias("author_created_at"), F.coalesce("followers", F.lit(0)).alias("followers"), F.coalesce("engagements", F.lit(0)).alias("engagements"), "lang", "text")


def replay(posts: DataFrame, *, anchor: Column | None = None, start: Column | None = None, limit: int | None = None, oldest_first: bool = False) -> DataFrame:
    """Stored posts moved in time so that the newest is at ``anchor``; the newest ``limit`` from ``start`` on.

    Author times stay as they are. Newest first, or oldest first.
    """
    out = posts
    if anchor is not None:
        newest = posts.agg(F.max("created_at").alias("_newest"))  # one row
        shift = micros(anchor) - micros("_newest")
        out = posts.join(F.broadcast(newest)).withColumn("created_at", F.timestamp_add("MICROSECOND", shift, F.col("created_at"))).drop("_newest")
    out = out if start is None else out.where(F.col("created_at") >= start)
    out = out.orderBy(F.desc("created_at"), "post_id")
    out = out if limit is None else out.limit(limit)
    return out.orderBy("created_at", "post_id") if oldest_first else out


def x_posts(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Posts of search pages with their authors' data; engagements are likes, reposts, replies and quotes."""
    page = pages.select(F.from_json(payload, X_PAGE).alias("p"))
    users = F.map_from_entries(F.transform(F.array_distinct(F.coalesce("p.includes.users", F.array().cast(X_PAGE[X_PAGE.index("users:") + 6 : -2]))), lambda u: F.struct(u["id"], u)))
    rows = page.select(F.explode("p.data").alias("d"), users.alias("u"))
    who, m = F.try_element_at("u", F.col("d.author_id")), F.col("d.public_metrics")
    total = sum((F.coalesce(m[c], F.lit(0)) for c in ("like_count", "retweet_count", "reply_count", "quote_count")), F.lit(0))
    return rows.select(F.col("d.id").alias("post_id"), parse_time("d.created_at").alias("created_at"), F.col("d.author_id").alias("author_id"), parse_time(who["created_at"]).alias("author_created_at"), F.coalesce(who["public_metrics"]["followers_count"], F.lit(0)).alias("followers"), total.alias("engagements"), F.col("d.lang").alias("lang"), F.col("d.text").alias("text"))


def _settled(status: Column, outcome: Column) -> tuple[Column, Column]:
    """Settled and an outcome go together: without the one the other is taken back, or makes it so."""
    return F.when(outcome.isNotNull(), "settled").when(status == "settled", "closed").otherwise(status), outcome


def kalshi_markets(raw: DataFrame, payload: str = "payload") -> DataFrame:
    m = raw.select(F.from_json(payload, KALSHI_MARKET).alias("m")).select("m.*")
    known = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    outcome = F.when(F.lower("result") == "yes", 1).when(F.lower("result") == "no", 0)
    status, outcome = _settled(F.coalesce(F.try_element_at(known, F.lower("status")), F.lit("open")), outcome)
    return m.select(F.concat(F.lit("kalshi:"), "ticker").alias("market_id"), F.lit("kalshi").alias("venue"), "ticker", "title", parse_time("open_time").alias("open_time"), parse_time("close_time").alias("close_time"), status.alias("status"), outcome.alias("resolved_outcome"))


def _money(c: Column) -> Column:
    """A decimal string as a double; anything else is null."""
    return F.trim(c).try_cast("double")


def kalshi_candles(raw: DataFrame, payload: str = "payload", market: str = "market_id") -> DataFrame:
    """Candle ticks in order of time: no depth; a spread only where the ask is not below the bid."""
    c = raw.select(market, F.explode(F.from_json(payload, KALSHI_CANDLES)["candlesticks"]).alias("c"))
    p = c.select(market, F.timestamp_seconds("c.end_period_ts").alias("ts"), F.lit("candle").alias("source"), *[_money(F.col(f"c.{k}.close_dollars")).alias(n) for k, n in (("price", "yes_price"), ("yes_bid", "yes_bid"), ("yes_ask", "yes_ask"))], _money(F.col("c.volume")).alias("volume"))
    return p.withColumn("spread", F.when(F.col("yes_ask") >= F.col("yes_bid"), F.col("yes_ask") - F.col("yes_bid"))).orderBy(market, "ts")


def kalshi_book(raw: DataFrame, payload: str = "payload", market: str = "market_id", ts: str = "fetched_at") -> DataFrame:
    """A book tick from bids on both sides: the highest price of each counts, and the yes ask is one less the best no bid."""
    best = lambda side: F.array_max(F.transform(F.col(f"o.orderbook_fp.{side}"), lambda x: F.struct(_money(x[0]).alias("p"), _money(x[1]).alias("s"))))
    b = raw.select(market, F.col(ts).alias("ts"), F.from_json(payload, KALSHI_BOOK).alias("o")).select(market, "ts", best("yes_dollars").alias("y"), best("no_dollars").alias("n"))
    quotes = b.select(market, "ts", F.lit("book").alias("source"), F.col("y.p").alias("yes_bid"), (1 - F.col("n.p")).alias("yes_ask"), F.col("y.s").alias("depth_bid"), F.col("n.s").alias("depth_ask"))
    return _with_price(quotes, None)


def _with_price(quotes: DataFrame, last: Column | None) -> DataFrame:
    both = (F.col("yes_bid") + F.col("yes_ask")) / 2.0
    gap = F.col("yes_ask") - F.col("yes_bid")
    return quotes.withColumns({"yes_price": both if last is None else F.coalesce(both, last), "spread": F.when(gap >= 0, gap)})


def _yes_index(names: Column) -> Column:
    return F.array_position(F.transform(names, lambda n: F.lower(F.trim(n))), "yes")


def polymarket_markets(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Closed markets settle by the price of the outcome named yes: from .99 it won, to .01 it lost, else it's pending."""
    m = raw.select(F.from_json(payload, POLY_MARKET).alias("m")).select("m.*").withColumns({"names": string_array("outcomes"), "prices": string_array("outcomePrices")})
    at = _yes_index(F.col("names"))
    p = F.when(at > 0, _money(F.get("prices", (at - 1).cast("int"))))
    outcome = F.when(F.col("closed") & (p >= 0.99), 1).when(F.col("closed") & (p <= 0.01), 0)
    status, outcome = _settled(F.when(F.col("closed"), "closed").otherwise("open"), outcome)
    return m.select(F.concat(F.lit("polymarket:"), "conditionId").alias("market_id"), F.lit("polymarket").alias("venue"), F.col("conditionId").alias("ticker"), F.col("question").alias("title"), parse_time("endDate").alias("close_time"), status.alias("status"), outcome.alias("resolved_outcome"))


def yes_token(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(ticker, token_id) of the outcome named yes, wherever it stands; lists of unlike length, or none so named, raise."""
    m = raw.select(F.from_json(payload, POLY_MARKET).alias("m")).select("m.conditionId", string_array("m.outcomes").alias("names"), string_array("m.clobTokenIds").alias("tokens"))
    at = _yes_index(F.col("names"))
    bad = (F.size("tokens") == 0) | (F.size("names") != F.size("tokens")) | (at == 0)
    token = F.when(bad, F.raise_error(F.concat(F.lit("no yes token: "), "conditionId"))).otherwise(F.get("tokens", (at - 1).cast("int")))
    return m.select(F.col("conditionId").alias("ticker"), token.alias("token_id"))


def polymarket_quotes(raw: DataFrame, payload: str = "payload", ts: str = "fetched_at") -> DataFrame:
    q = raw.select(F.col(ts).alias("ts"), F.from_json(payload, POLY_MARKET).alias("m")).select("ts", F.concat(F.lit("polymarket:"), "m.conditionId").alias("market_id"), F.lit("quote").alias("source"), _money(F.col("m.bestBid")).alias("yes_bid"), _money(F.col("m.bestAsk")).alias("yes_ask"), _money(F.col("m.lastTradePrice")).alias("_last"), _money(F.col("m.spread")).alias("_spread"))
    return _with_price(q, F.col("_last")).withColumn("spread", F.coalesce("_spread", "spread")).drop("_last", "_spread")


def polymarket_book(raw: DataFrame, payload: str = "payload", market: str = "market_id", ts: str = "fetched_at") -> DataFrame:
    """A book tick: the highest bid and the lowest ask, in whatever order the levels come."""
    level = lambda side: F.transform(F.col(f"o.{side}"), lambda x: F.struct(_money(x["price"]).alias("p"), _money(x["size"]).alias("s")))
    b = raw.select(market, F.col(ts).alias("ts"), F.from_json(payload, POLY_BOOK).alias("o"))
    lowest = F.array_min(F.transform(level("asks"), lambda x: F.struct(x["p"].alias("p"), (-x["s"]).alias("s"))))
    b = b.select(market, "ts", F.array_max(level("bids")).alias("b"), lowest.alias("a"), _money(F.col("o.last_trade_price")).alias("_last"))
    q = b.select(market, "ts", F.lit("book").alias("source"), F.col("b.p").alias("yes_bid"), F.col("a.p").alias("yes_ask"), F.col("b.s").alias("depth_bid"), (-F.col("a.s")).alias("depth_ask"), "_last")
    return _with_price(q, F.col("_last")).drop("_last")


def polymarket_history(raw: DataFrame, payload: str = "payload", market: str = "market_id") -> DataFrame:
    h = raw.select(market, F.explode(F.from_json(payload, POLY_HISTORY)["history"]).alias("h")).where("h.t IS NOT NULL AND h.p IS NOT NULL")
    return h.select(market, F.timestamp_seconds("h.t").alias("ts"), F.lit("candle").alias("source"), F.col("h.p").alias("yes_price")).orderBy(market, "ts")


def ticks_of(*frames: DataFrame) -> DataFrame:
    """Candles and books together; columns that one side lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of backtest rows; signal and market_price must be there."""
    df = spark.read.schema(OBSERVATION).option("multiLine", True).json(path)
    whole = F.col("signal").isNotNull() & F.col("market_price").isNotNull()
    return df.where(F.when(whole, True).otherwise(F.raise_error(F.lit("an observation lacks signal or market_price")).cast("boolean")))


def market_config(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """(markets, market_queries) of a parsed config, checked: version 1, ids of venue and ticker, once each, with a term."""
    if config.get("version") != 1:
        raise ValueError("config version must be 1")
    markets, terms, seen = [], [], set()
    defaults = (config.get("defaults") or {}).get("adaptive") or {}
    for m in config.get("markets") or []:
        own = f"{m['venue']}:{m['ticker']}"
        if m.get("id", own) != own or not re.match(r"^(kalshi|polymarket):.+$", own) or own in seen:
            raise ValueError(f"market id {m.get('id')!r} is not {own!r}, or comes twice")
        seen.add(own)
        query = m.get("query") or {}
        lists = {"keyword": query.get("keywords") or [], "hashtag": query.get("tickers") or [], "entity": [*(query.get("entities") or []), *(query.get("aliases") or [])]}
        if not any(lists.values()):
            raise ValueError(f"{own} has no positive term")
        adaptive = {**defaults, **(m.get("adaptive") or {})}
        markets.append((own, m["venue"], m["ticker"], m.get("title"), m.get("target"), bool(m.get("tracked", True)), float(adaptive.get("base_half_life_hours", 6)) * 3600, float(adaptive.get("min_half_life_hours", 0.5)) * 3600))
        terms += [(own, kind, t) for kind, ts in [*lists.items(), ("exclude", query.get("exclude") or [])] for t in ts]
    return (
        spark.createDataFrame(markets, "market_id string, venue string, ticker string, title string, target string, tracked boolean, base_half_life_s double, min_half_life_s double"),
        spark.createDataFrame(terms, "market_id string, term_type string, term string").distinct(),
    )


def resolve(markets: DataFrame, name: str) -> DataFrame:
    """The market of an id, or of a ticker that only one market has."""
    hit = markets.where((F.col("market_id") == name) | (F.col("ticker") == name))
    n = hit.count()
    if n != 1:
        raise LookupError(f"{name!r} names {n} markets")
    return hit

