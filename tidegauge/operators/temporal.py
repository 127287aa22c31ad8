"""As-of joins, resampling on bars, grid alignment and bounded carry-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bar_of, micros

_DAY = 86_400


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], left_on: str, right_on: str, values: list[str], tie: list[str] | None = None, tolerance_s: float | None = None, direction: str = "backward", bucket_s: int = _DAY) -> DataFrame:
    """Each left row with ``values`` of the right row as of its time; no right row: nulls.

    ``backward`` takes the last right row at or before the left time (of equal times the greatest by ``tie``), whatever
    its values; ``forward`` the first at or after; ``nearest`` the closer of both, backward if equal. A row further
    away than ``tolerance_s`` counts as none. Right times travel along as ``asof_ts``.

    Keys and buckets of time share the work, so one busy key spreads over its buckets: inside a bucket one sorted
    window over both sides, across buckets the last right row of each, a row per key and bucket.
    """
    if direction == "nearest":
        back = _one_way(left.withColumn("_row", F.monotonically_increasing_id()), right, by, left_on, right_on, values, tie, tolerance_s, False, bucket_s, "_b")
        both = _one_way(back, right, by, left_on, right_on, values, tie, tolerance_s, True, bucket_s, "_f")
        t, b, f = micros(left_on), micros("_b.asof_ts"), micros("_f.asof_ts")
        pick = F.when(F.col("_f").isNull() | (t - b <= f - t), F.col("_b")).otherwise(F.col("_f"))
        return both.withColumn("_p", pick).select(*left.columns, *[F.col(f"_p.{v}").alias(v) for v in values], F.col("_p.asof_ts").alias("asof_ts"))
    found = _one_way(left, right, by, left_on, right_on, values, tie, tolerance_s, direction == "forward", bucket_s, "_b")
    return found.select(*left.columns, *[F.col(f"_b.{v}").alias(v) for v in values], F.col("_b.asof_ts").alias("asof_ts"))


def _one_way(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], tie: list[str] | None, tolerance_s: float | None, forward: bool, bucket_s: int, out: str) -> DataFrame:
    sign = -1 if forward else 1
    keys = [f"_k{i}" for i in range(len(by))]
    record = F.struct(*[F.col(v) for v in values], F.col(right_on).alias("asof_ts"))
    order = F.struct(*[F.col(t) for t in tie or [right_on]])
    r = right.where(F.col(right_on).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], bar_of(right_on, bucket_s).alias("_bucket"), (micros(right_on) * sign).alias("_t"), F.lit(0).alias("_side"), order.alias("_tie"), record.alias(out))
    l = left.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], bar_of(left_on, bucket_s).alias("_bucket"), (micros(left_on) * sign).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))  # noqa: E741
    # in the forward direction a tie goes to the first right row, in the backward one to the last
    ties = F.col("_tie").asc() if not forward else F.col("_tie").desc()
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side", ties).rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l, allowMissingColumns=True).withColumn("_in", F.last(out, ignorenulls=True).over(inside)).where("_side = 1")

    pick = F.max_by if not forward else F.min_by
    place = F.struct((F.col("_t") * sign).alias("t"), "_tie")
    tails = r.groupBy(*keys, "_bucket").agg(pick(out, place).alias("_tail"))
    buckets = l.select(*keys, "_bucket").distinct().unionByName(tails, allowMissingColumns=True).groupBy(*keys, "_bucket").agg(F.first("_tail", ignorenulls=True).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy(F.col("_bucket") * sign).rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("_carry", F.last("_tail", ignorenulls=True).over(across)).select(*[F.col(k).alias(f"c{k}") for k in keys], F.col("_bucket").alias("c_bucket"), "_carry")
    on = [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in keys] + [F.col("_bucket") == F.col("c_bucket")]
    hit = F.coalesce("_in", "_carry")
    joined = both.join(carried, on, "left").withColumn(out, hit)
    if tolerance_s is not None:
        away = F.abs(micros(f"{out}.asof_ts") * sign - F.col("_t"))
        joined = joined.withColumn(out, F.when(away <= int(tolerance_s * 1_000_000), F.col(out)))
    return joined.select(*[F.col("_left").getField(c).alias(c) for c in left.columns], out)


def last_in_bar(df: DataFrame, *, by: list[str], on: str, value: str, seconds: int = 3600, tie: list[str] | None = None) -> DataFrame:
    """(by, bar, value): the value of the last row in each bar, null or not; combined before the exchange."""
    order = F.struct(micros(on).alias("t"), *[F.col(t) for t in tie or []])
    return df.groupBy(*by, bar_of(on, seconds).alias("bar")).agg(F.max_by(value, order).alias(value))


def dense_bars(df: DataFrame, *, by: list[str], first: Column, last: Column) -> DataFrame:
    """(by, bar): every bar from first to last of each key; bars are hours of history, not rows of input."""
    return df.groupBy(*by).agg(first.alias("_a"), last.alias("_b")).select(*by, F.explode(F.sequence("_a", "_b")).alias("bar"))


def carry_forward(df: DataFrame, *, by: list[str], order: str, value: str, limit: int, out: str | None = None) -> DataFrame:
    """``value`` of at most ``limit`` rows before where it is null; nulls at the start stay."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-limit, 0)
    return df.withColumn(out or value, F.last(value, ignorenulls=True).over(w))


def _bars(df: DataFrame, by: list[str], on: str, value: str, seconds: int, tie: list[str] | None) -> DataFrame:
    return last_in_bar(df.where(F.col(value).isNotNull()), by=by, on=on, value=value, seconds=seconds, tie=tie)


def align_each_span(prices: DataFrame, signals: DataFrame, *, by: list[str], price: str = "price", signal: str = "signal", price_on: str = "ts", signal_on: str = "ts", seconds: int = 3600, fill: int = 1, price_tie: list[str] | None = None, signal_tie: list[str] | None = None) -> DataFrame:
    """(by, bar, price, signal): each series on the bars of its own span, carried ``fill`` bars, joined where both are."""
    sides = []
    for df, on, value, tie in ((prices, price_on, price, price_tie), (signals, signal_on, signal, signal_tie)):
        bars = _bars(df, by, on, value, seconds, tie)
        grid = dense_bars(bars, by=by, first=F.min("bar"), last=F.max("bar"))
        sides.append(carry_forward(grid.join(bars, [*by, "bar"], "left"), by=by, order="bar", value=value, limit=fill).where(F.col(value).isNotNull()))
    return sides[0].join(sides[1], [*by, "bar"])


def align_union_span(prices: DataFrame, signals: DataFrame, *, by: list[str], price: str = "price", signal: str = "signal", price_on: str = "ts", signal_on: str = "ts", seconds: int = 3600, fill: int = 1, price_tie: list[str] | None = None, signal_tie: list[str] | None = None) -> DataFrame:
    """Like :func:`align_each_span` on one grid over both spans: a series may be carried past its own last bar."""
    p, s = _bars(prices, by, price_on, price, seconds, price_tie), _bars(signals, by, signal_on, signal, seconds, signal_tie)
    spans = p.select(*by, "bar").unionByName(s.select(*by, "bar"))
    both = p.select(*by).distinct().join(s.select(*by).distinct(), by, "left_semi")
    grid = dense_bars(spans.join(both, by, "left_semi"), by=by, first=F.min("bar"), last=F.max("bar"))
    joined = grid.join(p, [*by, "bar"], "left").join(s, [*by, "bar"], "left")
    for value in (price, signal):
        joined = carry_forward(joined, by=by, order="bar", value=value, limit=fill)
    return joined.where(F.col(price).isNotNull() & F.col(signal).isNotNull())
