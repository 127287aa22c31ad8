"""Column expressions: decay weights, probabilities, the logarithmic scoring rule, sizing, parsing."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the domain.
EPSILON = 1e-6
BASE_HALF_LIFE_S = 21_600.0
MIN_HALF_LIFE_S = 1_800.0
VOLUME_MULTIPLE = 3.0
PRICE_THRESHOLD = 0.05
B_MIN, B_MAX, B_FALLBACK = 1.0, 1_000_000.0, 100.0
RESPONSIVENESS = 0.35
EDGE_THRESHOLD, POSITION_CAP = 0.05, 100.0
READ_COST_USD = 0.005
FLAT = 1e-9

ColumnLike = Column | str | float | int


def col(x: ColumnLike) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


# --- time -----------------------------------------------------------------------------------------------------------

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros(ts: ColumnLike) -> Column:
    """Microseconds since the epoch of a zoneless time."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), col(ts))


def seconds_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    return F.timestamp_diff("MICROSECOND", col(earlier), col(later)) / 1e6


def bar_of(ts: ColumnLike, seconds: int = 3600) -> Column:
    """Number of the bar that holds ``ts``, counted from the epoch."""
    return F.floor(micros(ts) / (seconds * 1_000_000)).cast("long")


def bar_start(bar: ColumnLike, seconds: int = 3600) -> Column:
    return F.timestamp_add("SECOND", (col(bar) * seconds).cast("long"), F.expr(_EPOCH))


def freq_seconds(freq: str) -> int:
    """Seconds of '15 min', '1 hour', 'day', ..."""
    m = re.fullmatch(r"\s*(\d+)?\s*(sec(?:ond)?|min(?:ute)?|hour|day|week)s?\s*", freq.lower())
    if not m:
        raise ValueError(f"unknown frequency {freq!r}")
    unit = {"sec": 1, "min": 60, "hou": 3600, "day": 86_400, "wee": 604_800}[m[2][:3]]
    n = int(m[1] or 1)
    if n < 1:
        raise ValueError("a frequency must be positive")
    return n * unit


def account_age_days(author_created: ColumnLike, created: ColumnLike) -> Column:
    """Whole days, toward zero; null if the account's age is unknown."""
    return F.timestamp_diff("DAY", col(author_created), col(created))


# --- signal ---------------------------------------------------------------------------------------------------------


def decay_lambda(half_life_s: ColumnLike) -> Column:
    h = col(half_life_s)
    return F.when(h > 0, F.lit(math.log(2.0)) / h).otherwise(F.raise_error(F.lit("half-life must be positive")).cast("double"))


def post_weight(followers: ColumnLike, engagements: ColumnLike) -> Column:
    f, e = col(followers), col(engagements)
    return F.when((f < 0) | (e < 0), F.raise_error(F.lit("followers and engagements must not be negative")).cast("double")).otherwise(F.log1p(f.cast("double")) * (1.0 + e))


def effective_half_life(recent: ColumnLike, baseline: ColumnLike, move: ColumnLike, *, base: float = BASE_HALF_LIFE_S, least: float = MIN_HALF_LIFE_S, multiple: float = VOLUME_MULTIPLE, threshold: float = PRICE_THRESHOLD, enabled: bool = True) -> Column:
    """The base half-life, shortened by bursts of posts and by price moves; a non-positive setting turns its trigger off."""
    if not enabled:
        return F.lit(float(base))
    speedups = [F.lit(1.0)]
    if multiple > 0:
        speedups.append(col(recent) / (F.greatest(col(baseline).cast("double"), F.lit(1.0)) * multiple))
    if threshold > 0:
        speedups.append(F.coalesce(F.abs(col(move)), F.lit(0.0)) / threshold)
    fastest = F.greatest(*speedups) if len(speedups) > 1 else speedups[0]
    return F.greatest(F.lit(float(least)), F.lit(float(base)) / fastest)


# --- probabilities --------------------------------------------------------------------------------------------------


def sigmoid(x: ColumnLike) -> Column:
    x = col(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def clamp_probability(p: ColumnLike, eps: float = EPSILON) -> Column:
    p = col(p)
    return F.when(p.isNotNull(), F.least(F.lit(1.0 - eps), F.greatest(F.lit(eps), p)))


def logit(p: ColumnLike, eps: float = EPSILON) -> Column:
    q = clamp_probability(p, eps)
    return F.ln(q / (1.0 - q))


def affine_probability(s: ColumnLike) -> Column:
    s = col(s)
    return F.when((s < -1) | (s > 1), F.raise_error(F.lit("a signal must be from -1 to 1")).cast("double")).otherwise((s + 1.0) / 2.0)


def platt_probability(s: ColumnLike, a: ColumnLike, b: ColumnLike) -> Column:
    return sigmoid(col(a) + col(b) * col(s))


def lsh_retrieval_probability(s: ColumnLike, bands: int = 16, rows: int = 8) -> Column:
    return 1.0 - F.pow(1.0 - F.pow(col(s), F.lit(float(rows))), F.lit(float(bands)))


# --- logarithmic market scoring rule ----------------------------------------------------------------------------------


def log_sum_exp(values: ColumnLike) -> Column:
    v = col(values)
    top = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.when(F.size(v) == 0, F.raise_error(F.lit("log-sum-exp of nothing")).cast("double")).when(top == float("-inf"), top).otherwise(top + F.ln(total))


def _checked_b(b: Column) -> Column:
    return F.when((b > 0) & (b < float("inf")), b).otherwise(F.raise_error(F.lit("b must be positive and finite")).cast("double"))


def lmsr_cost(q: ColumnLike, b: ColumnLike) -> Column:
    q, b = col(q), _checked_b(col(b))
    scaled = F.transform(q, lambda x: x / b)
    return F.when(F.size(q) < 2, F.raise_error(F.lit("two outcomes at least")).cast("double")).otherwise(b * log_sum_exp(scaled))


def lmsr_prices(q: ColumnLike, b: ColumnLike) -> Column:
    q, b = col(q), _checked_b(col(b))
    top = F.array_max(q)
    e = F.transform(q, lambda x: F.exp((x - top) / b))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def lmsr_price_yes(q_yes: ColumnLike, q_no: ColumnLike, b: ColumnLike) -> Column:
    return sigmoid((col(q_yes) - col(q_no)) / _checked_b(col(b)))


def lmsr_trade_cost(q: ColumnLike, dq: ColumnLike, b: ColumnLike) -> Column:
    return lmsr_cost(F.zip_with(col(q), col(dq), lambda x, d: x + d), b) - lmsr_cost(q, b)


def lmsr_shares_to_move(p_from: ColumnLike, p_to: ColumnLike, b: ColumnLike) -> Column:
    return _checked_b(col(b)) * (logit(p_to) - logit(p_from))


def lmsr_worst_case_subsidy(b: ColumnLike, outcomes: int = 2) -> Column:
    if outcomes < 2:
        raise ValueError("two outcomes at least")
    return _checked_b(col(b)) * math.log(outcomes)


def lmsr_b_from_depth(depth_bid: ColumnLike, depth_ask: ColumnLike, bid: ColumnLike, ask: ColumnLike, side: str = "mean", fallback: float = B_FALLBACK) -> Column:
    """Liquidity from the top of the book; the fallback where the quote is missing, crossed, locked or empty."""
    db, da, lo, hi = col(depth_bid), col(depth_ask), col(bid), col(ask)
    live = lambda d: F.when(d > 0, d)
    both = F.coalesce((live(db) + live(da)) / 2.0, live(db), live(da))
    depth = {"bid": live(db), "ask": live(da), "mean": both}[side]
    quoted = (lo > 0) & (hi < 1) & (hi > lo) & depth.isNotNull()
    return F.when(F.coalesce(quoted, F.lit(False)), F.least(F.lit(B_MAX), F.greatest(F.lit(B_MIN), depth / (logit(hi) - logit(lo))))).otherwise(F.lit(float(fallback)))


# --- prices, sizing, text, parsing ------------------------------------------------------------------------------------


def mid(bid: ColumnLike = "yes_bid", ask: ColumnLike = "yes_ask", last: ColumnLike = "yes_price") -> Column:
    return F.coalesce((col(bid) + col(ask)) / 2.0, col(last))


def target_position(p_hat: ColumnLike, price: ColumnLike, *, threshold: float = EDGE_THRESHOLD, cap: float = POSITION_CAP) -> Column:
    edge = col(p_hat) - col(price)
    return F.when(F.abs(edge) < threshold, F.lit(0.0)).otherwise(F.greatest(F.lit(-cap), F.least(F.lit(cap), edge * cap)))


def interpretation(lag: ColumnLike) -> Column:
    lag = col(lag)
    return F.when(lag > 0, "signal leads").when(lag < 0, "price leads").otherwise("contemporaneous")


def market_id(venue: ColumnLike, ticker: ColumnLike) -> Column:
    return F.concat_ws(":", col(venue), col(ticker))


def parse_money(text: ColumnLike, default: float | None = None) -> Column:
    value = F.expr(f"try_cast(trim({text if isinstance(text, str) else 'value'}) AS double)")
    ok = F.when(~F.isnan(value), value)
    return F.coalesce(ok, F.lit(default).cast("double")) if default is not None else ok


def parse_time(text: ColumnLike) -> Column:
    """ISO 8601, with or without Z or an offset; bad text is null."""
    return F.try_to_timestamp(F.trim(col(text)))


def string_array(text: ColumnLike) -> Column:
    """A JSON array of strings inside a string; bad text is empty."""
    return F.coalesce(F.from_json(col(text), "array<string>"), F.array().cast("array<string>"))


def redact(url: ColumnLike) -> Column:
    return F.regexp_replace(col(url), r"(://[^:/@]+):[^@]*@", "$1:***@")


def symbol_ratio(text: ColumnLike) -> Column:
    t = col(text)
    return F.when(F.length(t) == 0, 1.0).otherwise(F.length(F.regexp_replace(t, r"[\p{L}\p{N}\p{Z}\s]", "")) / F.length(t))


def query_terms(*lists: ColumnLike) -> Column:
    """All terms of the lists, each once, in the order first seen."""
    return F.array_distinct(F.concat(*[F.coalesce(col(x), F.array().cast("array<string>")) for x in lists]))


def query_string(terms: ColumnLike, exclusions: ColumnLike | None = None, lang: str | None = None, extra: str | None = None) -> Column:
    """(a OR "b c") -x -is:retweet lang:en"""
    quoted = lambda xs: F.transform(xs, lambda t: F.when(t.contains(" "), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
    parts = [F.concat(F.lit("("), F.array_join(quoted(col(terms)), " OR "), F.lit(")"))]
    if exclusions is not None:
        some = F.coalesce(col(exclusions), F.array().cast("array<string>"))
        parts.append(F.when(F.size(some) > 0, F.array_join(F.transform(quoted(some), lambda t: F.concat(F.lit("-"), t)), " ")))
    parts.append(F.lit("-is:retweet"))
    parts += [F.lit(f"lang:{lang}")] * bool(lang) + [F.lit(extra)] * bool(extra)
    return F.concat_ws(" ", *parts)
