"""The stance signal S(t): weighted, time-decayed, per bar, with half-lives that follow bursts of posts and price moves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import BASE_HALF_LIFE_S, MIN_HALF_LIFE_S, affine_probability, bar_of, bar_start, decay_lambda, effective_half_life, micros, mid, post_weight
from .temporal import asof_join, dense_bars

HOUR = 3600
MAX_AGE_S = 7 * 86_400
TOLERANCE_S = 3600
BASELINE_HOURS = 24
_SAFE_EXPONENT = 600.0  # exp(-600) is an ordinary double


def contributions(posts: DataFrame, stances: DataFrame, model_version: str) -> DataFrame:
    """Accepted posts with a stance of the model and a positive weight: (market_id, created_at, stance, weight).

    The sums of followers and engagements overflow nothing; posts without followers carry no weight and leave here.
    """
    scored = stances.where(F.col("model_version") == model_version).select("post_id", "market_id", "created_at", "stance")
    weight = post_weight("followers", "engagements")
    return posts.where("filter_verdict = 'accepted'").select("post_id", "market_id", "created_at", weight.alias("weight")).where("weight > 0").join(scored, ["post_id", "market_id", "created_at"]).select("market_id", "created_at", "stance", "weight")


def _columns(s_t: Column, n: Column, total: Column) -> list[Column]:
    return [F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s_t)).alias("s_t"), n.cast("long").alias("n_posts"), total.alias("weight_sum")]


def signal_at(contrib: DataFrame, at: Column, *, half_life_s: float = BASE_HALF_LIFE_S, max_age_s: float | None = MAX_AGE_S, by: list[str] | None = None) -> DataFrame:
    """S(t) per key at one time ``at``; keys without a weighted post at or before it have no row.

    Sums are taken against each key's largest log-weight, so ages beyond the range of doubles keep their ratio;
    ``weight_sum`` may then be 0 while the signal is defined.
    """
    by = by or ["market_id"]
    age = (micros(at) - micros("created_at")) / 1e6
    seen = contrib.withColumn("_age", age).where("_age >= 0 AND weight > 0")
    if max_age_s is not None:
        seen = seen.where(F.col("_age") <= max_age_s)
    seen = seen.withColumn("_lt", F.ln("weight") - F.col("_age") * decay_lambda(half_life_s))
    # the peak of each key first: one row a key, joined back
    peaks = seen.groupBy(*by).agg(F.max("_lt").alias("_peak"))
    e = F.exp(F.col("_lt") - F.col("_peak"))
    sums = seen.join(peaks, by).groupBy(*by).agg(F.sum(F.col("stance") * e).alias("_a"), F.sum(e).alias("_b"), F.count("*").alias("_n"), F.max("_peak").alias("_p"))
    return sums.select(*by, *_columns(F.col("_a") / F.col("_b"), F.col("_n"), F.exp("_p") * F.col("_b")))


def bars_of_posts(posts: DataFrame, end: Column | None = None) -> DataFrame:
    """(market_id, bar): from the hour after the first post's to the last post's or ``end``'s; bars count hours."""
    last = F.max(bar_of("created_at"))
    return dense_bars(posts, by=["market_id"], first=F.min(bar_of("created_at")) + 1, last=last if end is None else F.greatest(last, F.max(bar_of(end)))).where("bar IS NOT NULL")


def hourly_counts(posts: DataFrame) -> DataFrame:
    """(market_id, hour, c, e): posts in each clock hour, and those exactly on it."""
    on_the_hour = micros("created_at") % (HOUR * 1_000_000) == 0
    return posts.groupBy("market_id", bar_of("created_at").alias("hour")).agg(F.count("*").alias("c"), F.sum(F.when(on_the_hour, 1).otherwise(0)).alias("e"))


def activity(posts: DataFrame, bars: DataFrame) -> DataFrame:
    """(market_id, bar, recent, baseline): posts in (t - 1 h, t], and the median of the 24 hourly counts before t.

    Empty hours count; a post exactly at t belongs to the last bucket. The counts are of hours, so the windows run
    over a row per hour however many posts there are.
    """
    counts = hourly_counts(posts).withColumnRenamed("hour", "bar")
    span = bars.groupBy("market_id").agg((F.min("bar") - BASELINE_HOURS).alias("a"), F.max("bar").alias("b")).select("market_id", F.explode(F.sequence("a", "b")).alias("bar"))
    grid = span.join(counts, ["market_id", "bar"], "left").fillna(0, ["c", "e"])
    w = Window.partitionBy("market_id").orderBy("bar")
    before = F.collect_list("c").over(w.rowsBetween(-BASELINE_HOURS, -1))
    # the newest bucket also holds the posts exactly at t
    buckets = F.array_sort(F.concat(F.slice(before, 1, BASELINE_HOURS - 1), F.array(F.element_at(before, -1) + F.col("e"))))
    median = (F.element_at(buckets, BASELINE_HOURS // 2) + F.element_at(buckets, BASELINE_HOURS // 2 + 1)) / 2.0
    recent = F.lag("c").over(w) - F.lag("e").over(w) + F.col("e")
    seen = grid.withColumns({"recent": recent, "_n": F.size(before), "_m": F.when(F.size(before) == BASELINE_HOURS, median)})
    return seen.join(bars, ["market_id", "bar"], "left_semi").select("market_id", "bar", F.col("recent").cast("double").alias("recent"), F.col("_m").alias("baseline"))


def price_moves(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """(market_id, bar, move): the mid as of the bar minus the mid as of the bar before, each at most an hour old."""
    quotes = ticks.withColumn("mid", mid())
    at = lambda shift, name: asof_join(bars.withColumn("_at", bar_start(F.col("bar") - shift)), quotes, by=["market_id"], left_on="_at", right_on="ts", values=["mid"], tie=["tick_id"], tolerance_s=TOLERANCE_S).select("market_id", "bar", F.col("mid").alias(name))
    return at(0, "now").join(at(1, "before"), ["market_id", "bar"]).select("market_id", "bar", (F.col("now") - F.col("before")).alias("move"))


def half_lives(posts: DataFrame, ticks: DataFrame, bars: DataFrame, **settings) -> DataFrame:
    """(market_id, bar, recent, baseline, move, half_life_seconds); a missing price moves nothing."""
    both = activity(posts, bars).join(price_moves(ticks, bars), ["market_id", "bar"], "left")
    return both.withColumn("half_life_seconds", effective_half_life("recent", "baseline", F.coalesce("move", F.lit(0.0)), **settings))


def signal_series(contrib: DataFrame, bars: DataFrame, half_life: DataFrame | float = BASE_HALF_LIFE_S, *, max_age_s: int = MAX_AGE_S, least_half_life_s: float = MIN_HALF_LIFE_S) -> DataFrame:
    """(market_id, bar, s_t, n_posts, weight_sum, half_life_seconds) for the bars at which S(t) is defined.

    With one half-life for all bars, a post's decayed weight to the end of its hour is all that later bars need: posts
    are summed per hour first, and only these sums are spread over the bars they reach. With a half-life per bar each
    post meets the bars of the next ``max_age_s``; both sums combine before the exchange, on (market, bar). Posts older
    than the last full hour of the age limit are settled one by one in either case.
    """
    hours = max_age_s // HOUR
    age = (F.col("bar") * HOUR * 1_000_000 - micros("created_at")) / 1e6
    first = F.ceil(micros("created_at") / (HOUR * 1_000_000)).cast("long")
    if isinstance(half_life, DataFrame):
        if max_age_s * math.log(2) / least_half_life_s > _SAFE_EXPONENT:
            raise ValueError("ages of so many half-lives leave the range of doubles")
        spread = contrib.withColumn("bar", F.explode(F.sequence(first, first + hours))).withColumn("_age", age).where(F.col("_age") <= max_age_s)
        hl = half_life.select("market_id", "bar", "half_life_seconds")
        e = F.col("weight") * F.exp(-F.col("_age") * decay_lambda("half_life_seconds"))
        sums = spread.join(hl, ["market_id", "bar"]).groupBy("market_id", "bar").agg(F.sum(F.col("stance") * e).alias("_a"), F.sum(e).alias("_b"), F.count("*").alias("_n"), F.first("half_life_seconds").alias("half_life_seconds"))
    else:
        lam = math.log(2) / half_life
        # to the first bar at or after the post
        aged = contrib.withColumn("_w", F.col("weight") * F.exp(-((first * HOUR * 1_000_000 - micros("created_at")) / 1e6) * lam)).withColumn("hour", first)
        whole = aged.groupBy("market_id", "hour").agg(F.sum(F.col("stance") * F.col("_w")).alias("a"), F.sum("_w").alias("b"), F.count("*").alias("n"))
        # at the last bar only posts exactly on their hour are within the age
        exact = aged.where(micros("created_at") % (HOUR * 1_000_000) == 0).groupBy("market_id", "hour").agg(F.sum(F.col("stance") * F.col("_w")).alias("a"), F.sum("_w").alias("b"), F.count("*").alias("n"))
        reach = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("h")).unionByName(exact.withColumn("h", F.lit(hours)))
        d = F.exp(-F.col("h") * HOUR * lam)
        sums = reach.groupBy("market_id", (F.col("hour") + F.col("h")).alias("bar")).agg(F.sum(F.col("a") * d).alias("_a"), F.sum(F.col("b") * d).alias("_b"), F.sum("n").alias("_n"))
        sums = sums.join(bars, ["market_id", "bar"], "left_semi").withColumn("half_life_seconds", F.lit(float(half_life)))
    return sums.select("market_id", "bar", *_columns(F.col("_a") / F.col("_b"), F.col("_n"), F.col("_b")), "half_life_seconds")


def with_probability(signals: DataFrame) -> DataFrame:
    return signals.withColumns({"p_hat": affine_probability("s_t"), "calibration": F.lit("affine")})
