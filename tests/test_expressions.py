"""Scalar expressions and the market maker against fixed values, to 1e-9."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import expr as X
from tidegauge.operators import lmsr, signal, stats

TOLERANCE = 1e-9


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first().v


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize(
    "q,b,cost",
    [((0, 0), 100, 69.31471805599453), ((100, 0), 100, 131.32616875182228), ((-250, 125), 40, 125.00339258553532), ((50000, 0), 100, 50000.0), ((0, 0, 0, 0), 50, 69.31471805599453), ((10, -5, 30), 12.5, 32.915718712443784)],
)
def test_cost(value, q, b, cost):
    assert value(X.lmsr_cost(arr(*q), b)) == pytest.approx(cost, abs=TOLERANCE)
    assert sum(value(X.lmsr_prices(arr(*q), b))) == pytest.approx(1, abs=TOLERANCE)


def test_prices_trades_and_shares(value):
    assert value(X.lmsr_prices(arr(100, 0), 100)) == pytest.approx([0.7310585786300049, 0.2689414213699951], abs=TOLERANCE)
    assert value(X.lmsr_prices(arr(50000, 0), 100))[1] == pytest.approx(7.124576406741286e-218, rel=1e-9)
    assert value(X.lmsr_trade_cost(arr(0, 0), arr(50, 0), 100)) == pytest.approx(28.092980362016135, abs=TOLERANCE)
    assert value(X.lmsr_trade_cost(arr(120, 30), arr(-60, 0), 75)) == pytest.approx(-41.27004112035591, abs=TOLERANCE)
    for (y, n, b), p in (((0, 0, 100), 0.5), ((137, -12, 55), 0.9375609512265242), ((-900, 100, 250), 0.017986209962091555)):
        assert value(X.lmsr_price_yes(y, n, b)) == pytest.approx(p, abs=TOLERANCE)
    for (a, z, b), s in (((0.5, 0.8, 140), 194.0812105567847), ((0.2, 0.26, 800), 272.2606447497624), ((0.97, 0.03, 60), -417.1318427802327)):
        assert value(X.lmsr_shares_to_move(a, z, b)) == pytest.approx(s, abs=TOLERANCE)
    assert value(X.lmsr_worst_case_subsidy(100, 2)) == pytest.approx(100 * math.log(2))


@pytest.mark.parametrize(
    "depths,quote,side,b",
    [((500, 500), (0.30, 0.35), "mean", 2190.497471445959), ((40, 69298.61), (0.03, 0.04), "mean", 116322.43904369048), ((40, 69298.61), (0.03, 0.04), "bid", 134.20798489463863), ((40, 69298.61), (0.03, 0.04), "ask", 232510.67010248633), ((100, 100), (0.6, 0.4), "mean", 100.0), ((0, 0), (0.3, 0.4), "mean", 100.0)],
)
def test_liquidity(value, depths, quote, side, b):
    assert value(X.lmsr_b_from_depth(*depths, *quote, side=side)) == pytest.approx(b, abs=1e-8)


@pytest.mark.parametrize("n,rate,move,hl", [(5, 5, 0, 21600), (90, 5, 0, 3600), (0, 5, 0.2, 5400), (60, 5, 0.3, 3600.0000000000005), (100000, 1, 0.9, 1800)])
def test_half_life(value, n, rate, move, hl):
    assert value(X.effective_half_life(n, rate, move)) == pytest.approx(hl, abs=TOLERANCE)


def test_probabilities(value):
    assert value(X.logit(0.001)) == pytest.approx(-6.906754778648554, abs=TOLERANCE)
    assert value(X.sigmoid(-30)) == pytest.approx(9.3576229688393e-14, rel=1e-9)
    for s in (-1, -0.75, -0.3, 0, 0.25, 0.6, 1):
        assert value(X.affine_probability(s)) == (s + 1) / 2
    with pytest.raises(Exception):
        value(X.affine_probability(1.5))
    assert value(X.lsh_retrieval_probability(0.8)) == pytest.approx(0.947, abs=1e-3)
    assert value(X.lsh_retrieval_probability(0.8, 8, 16)) == pytest.approx(0.204, abs=1e-3)


@pytest.mark.parametrize(
    "posts,hl,s,n,w",
    [
        ([(10800, 0.42, 50, 0)], 21600, 0.42, 1, 2.7802205673424583),
        ([(3600, 0.8, 1000, 10), (43200, -0.9, 1000, 10)], 21600, 0.4274866530722828, 2, 86.70408418833344),
        ([(299.88, 1, 500, 5), (86400, -1, 500, 5)], 21600, 0.8812828624859066, 2, 39.273643834784565),
        ([(2592000, 0.5, 100, 1)], 1800, 0.5, 1, 0.0),
        ([(900, 0.9, 8000, 120), (5400, -0.7, 12000, 40)], 3600, 0.6926453511474819, 2, 1050.6005243739091),
        ([(1800 * i, (0.5 + i / 40) * (1 if i % 2 == 0 else -1), 1000 + 100 * i, i) for i in range(20)], 21600, -0.031608094410495106, 20, 802.7004040029491),
    ],
)
def test_signal_values(spark, posts, hl, s, n, w):
    rows = spark.createDataFrame([("m", round(age * 1e6), float(x), f, e) for age, x, f, e in posts], "market_id string, age long, stance double, followers int, engagements int")
    at = F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'")
    contrib = rows.select("market_id", F.timestamp_add("MICROSECOND", -F.col("age"), at).alias("created_at"), "stance", X.post_weight("followers", "engagements").alias("weight"))
    got = signal.signal_at(contrib, at, half_life_s=hl, max_age_s=None).first()
    assert got.s_t == pytest.approx(s, abs=TOLERANCE) and got.n_posts == n and got.weight_sum == pytest.approx(w, abs=TOLERANCE)


def test_signal_edges(spark):
    rows = spark.createDataFrame([("a", 3600, 0.5, 1.0), ("a", -60, -1.0, 5.0), ("b", 60, 1.0, 0.0), ("c", 90000, 1.0, 2.0)], "market_id string, age int, stance double, weight double")
    at = F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'")
    contrib = rows.select("market_id", F.timestamp_add("SECOND", -F.col("age"), at).alias("created_at"), "stance", "weight")
    got = {r.market_id: (r.s_t, r.n_posts) for r in signal.signal_at(contrib, at, max_age_s=86_400).collect()}
    assert got == {"a": (0.5, 1)}


def test_walk_forward_on_a_sine(spark):
    n = 300
    rows = [("m", i, math.sin((i + 3) / 12), 0.5 + 0.2 * math.sin(i / 12), 0.49 + 0.2 * math.sin(i / 12), 0.51 + 0.2 * math.sin(i / 12), 500.0, 500.0) for i in range(n)]
    obs = spark.createDataFrame(rows, "market_id string, bar int, signal double, price double, yes_bid double, yes_ask double, depth_bid double, depth_ask double")
    got = lmsr.walk_forward(obs).orderBy("window").collect()
    assert [(r.window, r.train_start, r.test_start, r.n_test) for r in got] == [(k, 24 * k, 24 * k + 72, 24) for k in range(9)]
    logit = lambda p: math.log(min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p))))

    def path(xs, r):
        level, out = logit(xs[0][3]), []
        for x in xs:
            level += r * (logit((x[2] + 1) / 2) - level)
            out.append(1 / (1 + math.exp(-level)))
        return out

    for r in got:
        tr, te = rows[r.train_start : r.test_start], rows[r.test_start : r.test_start + 24]
        mse = lambda p, xs: sum((a - x[3]) ** 2 for a, x in zip(p, xs)) / len(xs)
        best = min(lmsr.GRID, key=lambda g: (mse(path(tr, g), tr), lmsr.GRID.index(g)))
        assert r.responsiveness == best and r.mse == pytest.approx(mse(path(te, best), te), abs=1e-12)
        assert r.correlation == pytest.approx(np.corrcoef(np.diff(path(te, best)), np.diff([x[3] for x in te]))[0, 1], abs=1e-9)
    assert lmsr.walk_forward(obs.limit(10)).count() == 0


def test_distribution_tails():
    assert stats.f_tail(4.0, 1, 10) == pytest.approx(0.0734, abs=1e-4)
    assert stats.f_tail(1.003, 7, 24) == pytest.approx(0.4535, abs=5e-3)
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert stats._constant_p(-2.86) == pytest.approx(0.05, abs=1e-3)


def test_granger_finds_the_lead():
    rng = np.random.default_rng(3)
    s, p = [0.0], [0.0]
    for _ in range(399):
        s.append(0.5 * s[-1] + rng.normal(0, 0.3))
        p.append(0.4 * p[-1] + 0.6 * s[-2] + rng.normal(0, 0.1))
    s, p = np.array(s), np.array(p)
    lag = stats.var_lag_order(np.column_stack([s, p]))
    assert stats.granger(s, p, lag)[1] < 0.01 and stats.granger(p, s, lag)[1] > 0.01
    assert stats.adf(s)[1] < 0.05 and stats.adf(np.cumsum(rng.normal(size=400)))[1] > 0.01 and stats.adf(np.ones(50)) is None
    thin = np.zeros(500)
    for i in range(1, 500):
        thin[i] = 0.85 * thin[i - 1] + rng.normal()
    a, b = np.roll(thin, 1) + rng.normal(0, 0.5, 500), np.roll(thin, 2) + rng.normal(0, 0.5, 500)
    assert stats.granger(a, b, 2, np.column_stack([thin, np.roll(thin, 1), np.roll(thin, 2)]))[1] > stats.granger(a, b, 2)[1]


def test_platt_of_separable_data(spark):
    s, y = [-0.9, -0.5, -0.2, 0.4, 0.6, 0.8, 0.95, 0.1], [0, 0, 0, 1, 1, 1, 1, 0]
    a, b, loss = stats.platt(np.array(s), np.array(y))
    assert abs(b) < 20 and 1 / (1 + math.exp(-(a + b))) < 0.999
    got = stats.platt_fit(spark.createDataFrame(list(zip(s, y)), "s_t double, outcome int"))
    assert got == pytest.approx((a, b, loss, 8), abs=1e-8)
    assert stats.platt(np.array(s), np.ones(8)) is None
    with pytest.raises(ValueError):
        stats.platt_fit(spark.createDataFrame([(0.1, 1), (0.2, 1)], "s_t double, outcome int"))


def test_cross_correlation_guards(spark):
    rng = np.random.default_rng(1)
    pinned = [("p", i, float(rng.normal()), 0.015 if i % 2 else 1 - 0.985) for i in range(60)]
    sig = rng.normal(size=400)
    lead = [("l", i, float(sig[i]), float(sig[i - 3] + rng.normal(0, 0.1)) if i >= 3 else 0.0) for i in range(400)]
    df = spark.createDataFrame(pinned + lead, "market_id string, bar int, signal double, price double")
    ccf = stats.cross_correlation(df, by=["market_id"], max_lag=6)
    assert ccf.where("market_id = 'p' AND correlation IS NOT NULL").count() == 0
    best = stats.strongest_lag(ccf, by=["market_id"]).collect()
    assert [(r.market_id, r.lag, r.interpretation) for r in best] == [("l", 3, "signal leads")]
