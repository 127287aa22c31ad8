"""Joins in time, grids, the post filter, the ledger and the sinks on small tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import text as T
from tidegauge.operators import ledger, posts, temporal
from tidegauge.sources import schemas, sinks

T0 = dt.datetime(2024, 1, 1)
hours = lambda h: T0 + dt.timedelta(hours=h)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 7200])
def test_asof_against_scan(spark, direction, tolerance):
    rnd = random.Random(5)
    left = [(rnd.choice("ab"), hours(rnd.randint(0, 400) / 2), i) for i in range(120)] + [("z", hours(1), 999)]
    right = [(rnd.choice("ab"), hours(rnd.randint(0, 400) / 2), i, float(i) if i % 5 else None) for i in range(150)]
    l = spark.createDataFrame(left, "k string, t timestamp_ntz, id int")  # noqa: E741
    r = spark.createDataFrame(right, "k string, ts timestamp_ntz, rid int, v double")
    got = {x.id: (x.rid, x.v) for x in temporal.asof_join(l, r, by=["k"], left_on="t", right_on="ts", values=["rid", "v"], tie=["rid"], tolerance_s=tolerance, direction=direction, bucket_s=86_400).collect()}
    for k, t, i in left:
        mine = [x for x in right if x[0] == k and (tolerance is None or abs((x[1] - t).total_seconds()) <= tolerance)]
        back = max((x for x in mine if x[1] <= t), key=lambda x: (x[1], x[2]), default=None)
        ahead = min((x for x in mine if x[1] >= t), key=lambda x: (x[1], x[2]), default=None)
        want = {"backward": back, "forward": ahead}.get(direction)
        if direction == "nearest":
            want = back if ahead is None or (back and t - back[1] <= ahead[1] - t) else ahead
        assert got[i] == ((want[2], want[3]) if want else (None, None))


def test_grids_do_not_bridge_gaps(spark):
    price = spark.createDataFrame([("m", hours(0), 0.3), ("m", hours(1), 0.31), ("m", hours(10), 0.5)], "market_id string, ts timestamp_ntz, price double")
    signal = spark.createDataFrame([("m", hours(h), 0.1) for h in range(11)], "market_id string, ts timestamp_ntz, signal double")
    base = (T0 - dt.datetime(1970, 1, 1)).days * 24
    union = temporal.align_union_span(price, signal, by=["market_id"]).collect()
    assert sorted(r.bar - base for r in union) == [0, 1, 2, 10]
    assert len(temporal.align_each_span(price, signal, by=["market_id"]).collect()) <= 4


@pytest.mark.parametrize("values,limit,want", [([1, None, None, 4], 1, [1, 1, None, 4]), ([1, None, None, 4], 2, [1, 1, 1, 4]), ([None, 2, None], 1, [None, 2, 2])])
def test_carry_forward(spark, values, limit, want):
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)], "k string, i int, v int")
    assert [r.v for r in temporal.carry_forward(df, by=["k"], order="i", value="v", limit=limit).orderBy("i").collect()] == want


def fnv(b):
    h = 0xCBF29CE484222325
    for x in b:
        h = ((h ^ x) * 0x100000001B3) % 2**64
    return h


def test_signatures_are_exact():
    p = 2**61 - 1
    sets = [["a b c", "é ü", "x" * 100], [], ["one"]]
    coefficients = T.permutations(16)
    assert all(1 <= int(a) < p and 0 <= int(b) < p for a, b in coefficients)
    got = T.signatures(sets, coefficients, 4)
    assert got[1] is None
    for s, g in zip(sets, got):
        if s:
            want = [min((int(a) * (fnv(x.encode()) % p) + int(b)) % p for x in s) for a, b in coefficients]
            assert g[0] == want
            assert g[1] == [f"r4:{k}:{fnv(bytes([k]) + b''.join(v.to_bytes(8, 'little', signed=True) for v in want[4 * k : 4 * k + 4])):016x}" for k in range(4)]


def test_normal_form_and_shingles(spark):
    df = spark.createDataFrame([("FOMC's   cut!! $SPY @me #x https://t.co/1 — Yes",), ("",), ("two words",)], "t string")
    n = T.normalize(F.col("t"))
    got = df.select(n.alias("n"), T.shingles(n).alias("s")).collect()
    assert [r.n for r in got] == ["fomc's cut yes", "", "two words"]
    assert [r.s for r in got] == [["fomc's cut yes"], [], ["two words"]]


def test_spam_ring_and_first_match(spark):
    ring = ["FOMC FOMC FOMC rate cut incoming", "FOMC FOMC FOMC rate cut incoming!", "fomc fomc fomc rate cut incoming $SPY"]
    rows = [(f"r{i}", "m", hours(i), t, 100, hours(-24 * 400)) for i, t in enumerate(ring)]
    rows += [("s", "m", hours(5), "Use my PROMO CODE for a giveaway today", 100, hours(0)), ("b", "m", hours(6), "A calm and long enough opinion here", 3, hours(6 - 24 * 3)), ("o", "m", hours(7), "A different long enough opinion, older", 3, hours(7 - 24 * 14)), ("x", "m", hours(8), "short", 9, None), ("y", "m", hours(9), "!!!!!!!!!!!!!!!???", 9, None), ("n", "other", hours(10), ring[0], 100, None)]
    df = spark.createDataFrame(rows, "post_id string, market_id string, created_at timestamp_ntz, text string, followers int, author_created_at timestamp_ntz")
    got = {r.post_id: (r.filter_verdict, r.filter_reason) for r in posts.filter_posts(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {"r0": "accepted", "r1": "duplicate", "r2": "duplicate", "s": "low_quality", "b": "bot", "o": "accepted", "x": "low_quality", "y": "low_quality", "n": "accepted"}
    assert 'marker "promo code"' in got["s"][1] and "5 chars" in got["x"][1] and "3d old" in got["b"][1]


def test_near_duplicates_equal_one_at_a_time(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    base = [rnd.choice(words) for _ in range(14)]
    rows = []
    for i in range(150):
        w = list(base) if i % 3 else [rnd.choice(words) for _ in range(14)]
        if i % 2:
            w[rnd.randrange(14)] = rnd.choice(words)
        rows.append((f"{i:04d}", "m", hours(i), " ".join(w)))
    df = spark.createDataFrame(rows, "post_id string, market_id string, created_at timestamp_ntz, text string")
    signed = posts.prepared(df).cache()
    got = {r.post_id: (r.original_id, round(r.similarity, 9)) for r in posts.near_duplicates(signed, capacity=20).collect()}
    window, want = [], {}
    for r in signed.orderBy("seq").collect():
        best = None
        for q, sig, buckets in window:
            if set(buckets) & set(r.buckets):
                sim = sum(a == b for a, b in zip(sig, r.signature)) / len(sig)
                if sim >= 0.8 and (best is None or sim > best[1]):
                    best = (q, sim)
        if best:
            want[r.post_id] = (best[0], round(best[1], 9))
        window = [*window, (r.post_id, r.signature, r.buckets)][-20:]
    assert got == want and len(want) > 20


def test_sizing_valuation_and_settlement(spark):
    pts = spark.createDataFrame([("m", hours(0), 0.8, 0.3), ("m", hours(1), 0.72, 0.70), ("m", hours(2), None, 0.5), ("n", hours(0), 0.72, 0.70)], "market_id string, ts timestamp_ntz, p_hat double, price double")
    fills = ledger.rebalance(pts)
    assert [(r.market_id, r.action, round(r.quantity, 9), round(r.cash_flow, 9)) for r in fills.orderBy("ts").collect()] == [("m", "buy", 50.0, -15.0), ("m", "sell", 50.0, 35.0)]
    pos = spark.createDataFrame([("a", "s", 50.0, 0.0, -20.0, 0.0, False), ("b", "s", 10.0, 0.0, -4.0, 1.0, False)], "market_id string, strategy string, qty_yes double, qty_no double, cash double, realized_pnl double, settled boolean")
    marked = {r.market_id: r for r in ledger.mark_to_market(pos, spark.createDataFrame([("a", 0.6)], "market_id string, mark double")).collect()}
    assert (marked["a"].value, marked["a"].unrealized) == (30, 10) and marked["b"].unrealized == 0 and marked["b"].total == 1
    markets = spark.createDataFrame([("a", "settled", 1), ("b", "open", None)], "market_id string, status string, resolved_outcome int")
    paid, after = ledger.settle(pos, markets)
    assert [(r.side, r.quantity, r.cash_flow) for r in paid.collect()] == [("yes", 50, 50)]
    assert {r.market_id: (r.qty_yes, r.cash, r.realized_pnl, r.settled) for r in after.collect()} == {"a": (0, 30, 50, True), "b": (10, -4, 1, False)}


def test_store_is_idempotent(spark, tmp_path):
    store = sinks.ParquetStore(spark, str(tmp_path))
    m = spark.createDataFrame([("kalshi:A", "kalshi", "A", "first", "open", True)], "market_id string, venue string, ticker string, title string, status string, tracked boolean")
    store.upsert("markets", m)
    store.upsert("markets", m.withColumn("title", F.lit("second")).withColumn("ticker", F.lit("B")))
    store.upsert("markets", m.withColumn("title", F.lit("second")))
    assert [(r.title, r.ticker) for r in store.read("markets").collect()] == [("second", "A")]
    p = spark.createDataFrame([("1", "kalshi:A", hours(0), 5)], "post_id string, market_id string, created_at timestamp_ntz, followers int")
    assert store.insert("posts", p) == 1 and store.insert("posts", p) == 0
    assert schemas.violations(store.read("markets"), "markets").count() == 0


def test_messages_hold_the_schema(spark):
    good = spark.createDataFrame([("kalshi:A", hours(1), "v", 0.5, None, None, 3, 2.0, 60.0)], "market_id string, ts timestamp_ntz, model_version string, s_t double, p_hat double, calibration string, n_posts int, weight_sum double, half_life_seconds double")
    r = sinks.messages(good, "signals").first()
    assert r.channel == "signals:kalshi:A" and '"ts":"2024-01-01T01:00:00Z"' in r.payload and '"p_hat":null' in r.payload
    with pytest.raises(Exception, match="s_t BETWEEN"):
        sinks.messages(good.withColumn("s_t", F.lit(2.0)), "signals").collect()


def test_budget_is_a_fold(spark):
    df = spark.createDataFrame([("d", "x", i, n) for i, n in enumerate([60, 50, 40, -30, 20, 11])], "day string, service string, request_id int, reads int")
    got = [(r.granted, r.reads_used) for r in ledger.reserve_reads(df, ceiling=100).orderBy("request_id").collect()]
    assert got == [(True, 60), (False, 60), (True, 100), (True, 70), (True, 90), (False, 90)]
