"""Forecast scores: Brier, Brier skill, log loss, calibration curves, and the frozen score of a resolved market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bar_of, clamp_probability, mid


def brier(p: Column, outcome: Column) -> Column:
    return F.avg(F.pow(p - outcome, F.lit(2.0)))


def brier_skill(signal: Column, market: Column) -> Column:
    """1 - signal / market of two Brier scores; against a perfect market 0 or minus infinity."""
    return F.when(market == 0, F.when(signal == 0, 0.0).otherwise(F.lit(float("-inf")))).otherwise(1.0 - F.try_divide(signal, market))


def score_markets(pairs: DataFrame, *, by: list[str], p: str = "p_hat", market: str = "price", outcome: str = "outcome") -> DataFrame:
    """(by, n_obs, brier_signal, brier_market, bss, beats_market) over rows with both forecasts."""
    both = pairs.where(F.col(p).isNotNull() & F.col(market).isNotNull() & F.col(outcome).isNotNull())
    s = both.groupBy(*by).agg(F.count("*").alias("n_obs"), brier(F.col(p), F.col(outcome)).alias("brier_signal"), brier(F.col(market), F.col(outcome)).alias("brier_market"))
    return s.withColumn("bss", brier_skill(F.col("brier_signal"), F.col("brier_market"))).withColumn("beats_market", F.col("bss") > 0)


def log_loss(p: Column, outcome: Column) -> Column:
    q = clamp_probability(p)
    return F.avg(-(outcome * F.ln(q) + (1 - outcome) * F.ln(1 - q)))


def calibration_curve(df: DataFrame, *, p: str, outcome: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, bin, mean_forecast, observed, n): equal right-closed bins, the first with 0; empty bins are left out.

    The bin is the first whose upper edge k / bins is at or above the forecast.
    """
    if bins < 1:
        raise ValueError("bins must be positive")
    edge = F.filter(F.sequence(F.lit(1), F.lit(bins)), lambda k: F.col(p) <= k / F.lit(float(bins)))
    return df.where(F.col(p).between(0, 1) & F.col(outcome).isNotNull()).groupBy(*(by or []), F.element_at(edge, 1).alias("bin")).agg(F.avg(p).alias("mean_forecast"), F.avg(outcome).alias("observed"), F.count("*").alias("n"))


def hourly_pairs(signals: DataFrame, ticks: DataFrame, *, key: str = "market_id") -> DataFrame:
    """Signals with the last mid that isn't null in their hour; other signals have none and leave."""
    hourly = ticks.withColumn("mid", mid()).where("mid IS NOT NULL").groupBy(key, bar_of("ts").alias("bar")).agg(F.max_by("mid", F.struct("ts", "tick_id")).alias("price"))
    return signals.join(hourly, [key, "bar"])


def frozen_pairs(signals: DataFrame, ticks: DataFrame, *, key: str = "market_id") -> DataFrame:
    """Like :func:`hourly_pairs`, but the last row of the hour counts even without a price, and yes_price goes before the mid."""
    last = F.max_by(F.struct("yes_price", "yes_bid", "yes_ask"), F.struct("ts", "tick_id"))
    hourly = ticks.groupBy(key, bar_of("ts").alias("bar")).agg(last.alias("t"))
    price = F.coalesce("t.yes_price", (F.col("t.yes_bid") + F.col("t.yes_ask")) / 2.0)
    return signals.join(hourly.select(key, "bar", price.alias("price")), [key, "bar"]).where("price IS NOT NULL")


def freeze_scores(signals: DataFrame, ticks: DataFrame, markets: DataFrame) -> DataFrame:
    """Final score rows of the settled markets; the window covers all their signals, scored or not."""
    done = markets.where("status = 'settled'").select("market_id", F.col("resolved_outcome").alias("outcome"))
    scores = score_markets(frozen_pairs(signals.where("p_hat IS NOT NULL"), ticks).join(done, "market_id"), by=["market_id", "outcome"])
    span = signals.groupBy("market_id").agg(F.min("bar").alias("window_start"), F.max("bar").alias("window_end"), F.max_by("calibration", F.when(F.col("calibration").isNotNull(), F.col("bar"))).alias("calibration"))
    return scores.join(span, "market_id")


def verdict(bss: Column) -> Column:
    return F.when(bss.isNull(), "not scored").when(bss > 0, "beats the market").when(bss < 0, "worse than the market").otherwise("equal to the market")
