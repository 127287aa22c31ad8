"""Venue payloads, stored posts, configs, stance models, and streams against their batch forms."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import posts, stance
from tidegauge.sources import sinks, venues
from tidegauge.streaming import pipeline

NOW = dt.datetime(2024, 5, 1)


def raw(spark, *payloads, market="kalshi:A"):
    return spark.createDataFrame([(market, NOW, p if isinstance(p, str) else json.dumps(p)) for p in payloads], "market_id string, fetched_at timestamp_ntz, payload string")


def test_kalshi(spark):
    m = {r.ticker: (r.status, r.resolved_outcome) for r in venues.kalshi_markets(raw(spark, {"ticker": "A", "status": "active"}, {"ticker": "B", "status": "settled"}, {"ticker": "C", "status": "closed", "result": "yes"}, {"ticker": "D", "status": "finalized", "result": "no"})).collect()}
    assert m == {"A": ("open", None), "B": ("closed", None), "C": ("settled", 1), "D": ("settled", 0)}
    book = venues.kalshi_book(raw(spark, {"orderbook_fp": {"yes_dollars": [["0.10", "5"], ["0.30", "93"]], "no_dollars": [["0.60", "70"], ["0.20", "1"]]}}, {"orderbook_fp": {"yes_dollars": [["0.10", "5"]], "no_dollars": []}})).orderBy("yes_bid").collect()
    assert (book[1].yes_bid, round(book[1].yes_ask, 9), book[1].depth_bid, book[1].depth_ask, round(book[1].yes_price, 9)) == (0.3, 0.4, 93, 70, 0.35)
    assert book[0].yes_ask is None and book[0].yes_price is None
    c = venues.kalshi_candles(raw(spark, {"candlesticks": [{"end_period_ts": 7200, "yes_bid": {"close_dollars": "0.5"}, "yes_ask": {"close_dollars": "0.4"}}, {"end_period_ts": 3600, "yes_bid": {"close_dollars": "0.2"}, "yes_ask": {"close_dollars": "0.3"}, "price": {"close_dollars": "bad"}}]})).collect()
    assert [(r.ts.hour if r.ts else None, r.yes_price, r.spread and round(r.spread, 9)) for r in c] == [(1, None, 0.1), (2, None, None)]


def test_polymarket(spark):
    names = {"outcomes": '["No", " YES "]', "clobTokenIds": '["n", "y"]'}
    rows = raw(spark, {"conditionId": "1", "closed": True, "outcomePrices": '["0.005","0.995"]', **names}, {"conditionId": "2", "closed": True, "outcomePrices": '["0.5","0.5"]', **names}, {"conditionId": "3", "closed": False, "outcomePrices": "oops", **names})
    assert {r.ticker: (r.status, r.resolved_outcome) for r in venues.polymarket_markets(rows).collect()} == {"1": ("settled", 1), "2": ("closed", None), "3": ("open", None)}
    assert {r.token_id for r in venues.yes_token(rows).collect()} == {"y"}
    with pytest.raises(Exception, match="no yes token"):
        venues.yes_token(raw(spark, {"conditionId": "4", "outcomes": '["A"]', "clobTokenIds": '["a"]'})).collect()
    b = venues.polymarket_book(raw(spark, {"bids": [{"price": "0.1", "size": "9"}, {"price": "0.2", "size": "3"}], "asks": [{"price": "0.9", "size": "1"}, {"price": "0.3", "size": "4"}]}, {"bids": [], "asks": [], "last_trade_price": "0.7"})).orderBy("yes_price").collect()
    assert (b[0].yes_bid, b[0].yes_ask, b[0].depth_bid, b[0].depth_ask, b[0].yes_price) == (0.2, 0.3, 3, 4, 0.25) and b[1].yes_price == 0.7
    q = venues.polymarket_quotes(raw(spark, {"conditionId": "1", "bestBid": "0.4", "bestAsk": "0.5", "lastTradePrice": "0.9"})).first()
    assert round(q.yes_price, 9) == 0.45 and round(q.spread, 9) == 0.1
    h = venues.polymarket_history(raw(spark, {"history": [{"t": 20, "p": 0.5}, {"t": 10}, {"t": 5, "p": 0.4}]})).collect()
    assert [r.yes_price for r in h] == [0.4, 0.5]


def test_search_pages(spark):
    page = {"data": [{"id": "1", "created_at": "2024-05-01T00:00:00.000Z", "author_id": "u", "lang": "en", "text": "hi", "public_metrics": {"like_count": 1, "retweet_count": 2, "reply_count": 3, "quote_count": 4}}, {"id": "2", "created_at": "2024-05-01T01:00:00.000Z", "author_id": "gone", "text": "x"}], "includes": {"users": [{"id": "u", "created_at": "2020-01-01T00:00:00Z", "public_metrics": {"followers_count": 7}}]}}
    got = {r.post_id: (r.followers, r.engagements) for r in venues.x_posts(raw(spark, page)).collect()}
    assert got == {"1": (7, 10), "2": (0, 0)}


def test_stored_posts_and_replay(spark, tmp_path):
    f = tmp_path / "p.jsonl"
    f.write_text('// note\n\n{"post_id":"a","created_at":"2024-01-01T00:00:00Z","text":"x"}\n{"id":"b","created_at":"2024-01-01T05:00:00Z","text":"y","followers":3}\n[1]\n')
    df = venues.read_posts(spark, str(f))
    assert {r.post_id for r in df.collect()} == {"a", "b"}
    moved = venues.replay(df, anchor=F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")).collect()
    assert [(r.post_id, r.created_at) for r in moved] == [("b", dt.datetime(2024, 2, 1)), ("a", dt.datetime(2024, 1, 31, 19))]
    assert [r.post_id for r in venues.replay(df, limit=1, oldest_first=True).collect()] == ["b"]
    f.write_text('{"post_id": \n')
    with pytest.raises(Exception, match="not JSON"):
        venues.read_posts(spark, str(f)).collect()


def test_observations_and_config(spark, tmp_path):
    f = tmp_path / "o.json"
    f.write_text(json.dumps([{"timestamp": 1, "signal": 0.1, "market_price": 0.5}, {"timestamp": 2, "signal": 0.2, "market_price": 0.6, "yes_bid": None}]))
    assert venues.read_observations(spark, str(f)).count() == 2
    config = {"version": 1, "defaults": {"adaptive": {"min_half_life_hours": 1}}, "markets": [{"venue": "kalshi", "ticker": "A", "query": {"keywords": ["x", "x"]}, "adaptive": {"base_half_life_hours": 2}}, {"venue": "polymarket", "ticker": "B", "query": {"entities": ["y"]}}]}
    markets, terms = venues.market_config(spark, config)
    assert {(r.market_id, r.base_half_life_s, r.min_half_life_s) for r in markets.collect()} == {("kalshi:A", 7200, 3600), ("polymarket:B", 21600, 3600)} and terms.count() == 2
    assert venues.resolve(markets, "B").first().market_id == "polymarket:B"
    with pytest.raises(LookupError):
        venues.resolve(markets, "Z")
    for bad in ({"version": 2}, {"version": 1, "markets": [{"venue": "kalshi", "ticker": "A", "query": {}}]}, {"version": 1, "markets": [{"venue": "x", "ticker": "A", "query": {"keywords": ["k"]}}]}):
        with pytest.raises(ValueError):
            venues.market_config(spark, bad)


def test_stance_models(spark):
    df = spark.createDataFrame([("1", "m", NOW, "bullish and likely"), ("2", "m", NOW, "bad, weak and not likely"), ("3", "m", NOW, None)], "post_id string, market_id string, created_at timestamp_ntz, text string")
    first = stance.score_posts(df, stance.build_model("lexicon"), "t")
    s = {r.post_id: r.stance for r in first.collect()}
    assert s["1"] > 0 > s["2"] and s["3"] == 0
    model = stance.EntailmentModel("nli-1", lambda: lambda pairs: [{"ENTAILMENT": 0.7, "neutral": 0.2, "Contradiction": 0.1} for _ in pairs])
    second = stance.score_posts(df, model, "a cut")
    both = stance.ensemble(first, second).where("post_id = '3'").first()
    assert both.model_version == "tide-lexicon-1+nli-1" and both.disagreement == pytest.approx(0.6)
    with pytest.raises(ValueError):
        stance.build_model("none")


def test_stream_dedup_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    base = [rnd.choice(words) for _ in range(12)]
    rows = []
    for i in range(60):
        w = list(base) if i % 2 else [rnd.choice(words) for _ in range(12)]
        if i % 4 == 3:
            w[3] = rnd.choice(words)
        rows.append((f"{i:03d}", f"m{i % 3 % 2}", NOW + dt.timedelta(hours=i), " ".join(w)))
    schema = "post_id string, market_id string, created_at timestamp_ntz, text string"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # files are taken in the order of their times
    import os
    for k, f in enumerate(sorted((tmp_path / "in").glob("part-*"), key=lambda p: p.stat().st_mtime_ns)):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    found = pipeline.near_duplicates(pipeline.parquet_stream(spark, str(tmp_path / "in"), schema), capacity=16)
    q = found.writeStream.format("memory").queryName("twins").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = {r.post_id: (r.original_id, round(r.similarity, 9)) for r in spark.table("twins").collect()}
    batch = posts.near_duplicates(posts.prepared(spark.createDataFrame(rows, schema)), capacity=16)
    assert got == {r.post_id: (r.original_id, round(r.similarity, 9)) for r in batch.collect()} and len(got) > 10


def test_stream_upserts_and_counts(spark, tmp_path):
    schema = "market_id string, ts timestamp_ntz, source string, yes_price double"
    for k in range(2):
        spark.createDataFrame([("kalshi:A", NOW + dt.timedelta(hours=h), "book", 0.1 * (k + 1)) for h in range(3 + k)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = sinks.ParquetStore(spark, str(tmp_path / "db"))
    q = pipeline.upsert_batches(pipeline.parquet_stream(spark, str(tmp_path / "in"), schema), store, "market_prices", str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None and store.read("market_prices").count() == 4
    m = spark.createDataFrame([("signals:kalshi:A", "{}"), ("sim:kalshi:A", "{}")], "channel string, payload string")
    assert pipeline.subscribe(m, "signals:*").count() == 1


def test_a_store_keeps_its_version_when_a_write_stops_before_the_name_moves(spark, tmp_path, monkeypatch):
    from tidegauge.sources import schemas
    from tidegauge.sources.sinks import ParquetStore

    store = ParquetStore(spark, str(tmp_path))
    empty = spark.createDataFrame([], schemas.TABLES["markets"])
    store.write("markets", empty)
    first = store._current("markets")

    def stop(self, table, version):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(ParquetStore, "_point", stop)
        with pytest.raises(OSError):
            store.write("markets", empty)
    assert store._current("markets") == first and store.read("markets").count() == 0
    store.write("markets", empty)
    assert store._current("markets") != first
