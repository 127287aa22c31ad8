"""Lead-lag statistics: cross-correlation, unit roots, lag orders, Granger tests, false-discovery control, Platt fits.

Cross-correlation and the corrections are DataFrame work. The tests on one market's aligned bars are grouped Arrow
functions on numpy: a market's series has a row per bar.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EPSILON, affine_probability, interpretation, logit

VARIATION = 1e-9
MIN_GRANGER, MIN_ADF = 20, 10


# --- distributions ----------------------------------------------------------------------------------------------------


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if not 0.0 < x < 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), tiny) * (1 if 1.0 - (a + b) * x / (a + 1.0) >= 0 else -1)
    h = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return min(1.0, max(0.0, front * h))


def f_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f) with d1 and d2 degrees of freedom."""
    return 1.0 if f <= 0 else incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


#: Response surface of the Dickey-Fuller distribution with a constant (MacKinnon 1994), and critical
#: values with a constant and a trend (Banerjee et al. 1993) by sample size, for p of .01 .025 .05 .10 .90 .95 .975 .99.
_MACKINNON_SMALL = (2.1659, 1.4412, 0.038269)
_MACKINNON_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
_MACKINNON_STAR, _MACKINNON_MIN, _MACKINNON_MAX = -1.61, -18.83, 2.74
_TREND_P = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)
_TREND_N = (25, 50, 100, 250, 500, 100_000)
_TREND = (
    (-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15),
    (-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24),
    (-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28),
    (-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31),
    (-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32),
    (-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33),
)


def _constant_p(t: float) -> float:
    if t > _MACKINNON_MAX:
        return 1.0
    if t < _MACKINNON_MIN:
        return 0.0
    c = _MACKINNON_SMALL if t <= _MACKINNON_STAR else _MACKINNON_LARGE
    z = sum(k * t**i for i, k in enumerate(c))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _trend_p(t: float, n: int) -> float:
    row = [np.interp(n, _TREND_N, [r[k] for r in _TREND]) for k in range(len(_TREND_P))]
    return float(np.interp(t, row, _TREND_P))


# --- tests on one series ------------------------------------------------------------------------------------------------


def has_variation(x: np.ndarray) -> bool:
    return len(x) > 0 and bool(np.nanmax(x) - np.nanmin(x) > VARIATION)


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares, and the diagonal of (X'X)^-1."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ beta
    return beta, float(r @ r), np.diag(np.linalg.pinv(x.T @ x))


def _adf_regression(x: np.ndarray, lags: int, trend: bool, start: int) -> tuple[float, float, int, int]:
    """(t of the level, Akaike, rows, parameters) of dx on level, ``lags`` differences, constant (and trend), from row ``start``."""
    d = np.diff(x)
    rows = np.arange(start, len(d))
    parts = [x[rows], *[d[rows - k] for k in range(1, lags + 1)], np.ones(len(rows))]
    if trend:
        parts.append(rows + 1.0)
    m = np.column_stack(parts)
    beta, rss, inv = _ols(d[rows], m)
    n, k = m.shape
    se = math.sqrt(max(rss, 1e-300) / max(1, n - k) * inv[0])
    aic = n * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / n) + 1) + 2 * k
    return float(beta[0] / se), aic, n, k


def adf(series: np.ndarray, *, mode: str = "constant") -> tuple[float, float, int, int] | None:
    """(statistic, p, lag, rows) of the augmented Dickey-Fuller test, or None for short or constant series.

    ``constant``: lag by Akaike's criterion on a common sample, then refitted on all rows, p from MacKinnon's surface.
    ``trend``: constant and trend, lag trunc((n - 1)^(1/3)), p interpolated in the published table, from .01 to .99.
    """
    x = np.asarray(series, float)
    x = x[np.isfinite(x)]
    n = len(x)
    if n < MIN_ADF or not has_variation(x):
        return None
    if mode == "trend":
        lag = int((n - 1) ** (1 / 3))
        t, _, rows, _ = _adf_regression(x, lag, True, lag)
        return t, _trend_p(t, n), lag, rows
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    lag = min(range(most + 1), key=lambda k: (_adf_regression(x, k, False, most)[1], k))
    t, _, rows, _ = _adf_regression(x, lag, False, lag)
    return t, _constant_p(t), lag, rows


def var_lag_order(data: np.ndarray, *, max_lags: int = 12, criterion: str = "aic") -> int:
    """Order of a vector autoregression by an information criterion on a common sample; 1 at least."""
    if criterion not in ("aic", "bic"):
        raise ValueError("criterion is 'aic' or 'bic'")
    n, k = data.shape
    most = max(1, min(max_lags, (n - 2) // 4))
    t = n - most
    best = None
    for p in range(most + 1):
        y = data[most:]
        x = np.column_stack([np.ones(t), *[data[most - j : n - j] for j in range(1, p + 1)]])
        if t <= x.shape[1]:
            break
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        r = y - x @ beta
        sign, logdet = np.linalg.slogdet(r.T @ r / t)
        if sign <= 0 or not np.isfinite(logdet):
            break
        penalty = 2.0 if criterion == "aic" else math.log(t)
        score = logdet + penalty / t * (p * k * k + k)
        if best is None or score < best[0]:
            best = (score, p)
    return max(1, best[1]) if best else 1


def granger(cause: np.ndarray, effect: np.ndarray, lag: int, controls: np.ndarray | None = None) -> tuple[float, float, int, int]:
    """(F, p, d1, d2): whether lags of ``cause`` help lags of ``effect``; controls enter both models at the same time."""
    n = len(effect)
    t = n - lag
    own = [effect[lag - j : n - j] for j in range(1, lag + 1)]
    other = [cause[lag - j : n - j] for j in range(1, lag + 1)]
    extra = [] if controls is None or not controls.size else [controls[lag:]]
    base = np.column_stack([np.ones(t), *own, *extra])
    y = effect[lag:]
    _, restricted, _ = _ols(y, base)
    _, full, _ = _ols(y, np.column_stack([base, *other]))
    d2 = t - base.shape[1] - lag
    if d2 < 1 or full <= 0:
        return float("nan"), float("nan"), lag, d2
    f = ((restricted - full) / lag) / (full / d2)
    return f, f_tail(f, lag, d2), lag, d2


def platt(signals: np.ndarray, outcomes: np.ndarray, *, rounds: int = 100, tolerance: float = 1e-9) -> tuple[float, float, float] | None:
    """(a, b, log loss) of sigmoid(a + b s) fitted to smoothed labels by Newton steps; None without both outcomes.

    Smoothing keeps the fit of separable data finite; the loss is against the raw labels.
    """
    s, y = np.asarray(signals, float), np.asarray(outcomes, float)
    if len(s) < 2 or not np.isfinite(s).all() or (np.abs(s) > 1).any() or len(np.unique(y)) < 2:
        return None
    up, down = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (up + 1.0) / (up + 2.0), 1.0 / (down + 2.0))
    theta, x = np.array([0.0, 2.0]), np.column_stack([np.ones_like(s), s])
    prob = lambda th: np.clip(1 / (1 + np.exp(-(x @ th))), EPSILON, 1 - EPSILON)
    for _ in range(rounds):
        p = prob(theta)
        hess = x.T @ (x * (p * (1 - p))[:, None])
        if abs(np.linalg.det(hess)) < 1e-12:
            break
        move = np.linalg.solve(hess, x.T @ (p - goal))
        theta = theta - move
        if np.abs(move).max() < tolerance:
            break
    p = prob(theta)
    return float(theta[0]), float(theta[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


# --- over markets ---------------------------------------------------------------------------------------------------------


def cross_correlation(aligned: DataFrame, *, by: list[str], signal: str = "signal", price: str = "price", on: str = "bar", max_lag: int = 12) -> DataFrame:
    """(by, lag, correlation, n_obs, interpretation): the signal ``lag`` rows before against the price now.

    Lags count rows, not hours. Fewer than three pairs, or a side whose range is at most 1e-9, have no correlation.
    The pairs come from shifted windows over each market's bars, one sort for all lags; moments about the first
    values keep their digits.
    """
    if max_lag < 1:
        raise ValueError("max_lag must be at least 1")
    w = Window.partitionBy(*by).orderBy(on)
    lags = range(-max_lag, max_lag + 1)
    shifted = aligned.withColumn("_xs", F.array(*[F.struct(F.lit(k).alias("lag"), (F.lag(signal, k) if k >= 0 else F.lead(signal, -k)).over(w).alias("x")) for k in lags]))
    pairs = shifted.select(*by, F.col(price).alias("y"), F.explode("_xs").alias("p")).select(*by, "p.lag", F.when(F.col("p.x").isNotNull() & F.col("y").isNotNull(), F.col("p.x")).alias("x"), F.when(F.col("p.x").isNotNull(), F.col("y")).alias("y"))
    varies = lambda c: F.max(c) - F.min(c) > VARIATION
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    out = pairs.groupBy(*by, "lag").agg(F.count(F.when(F.col("y").isNotNull(), F.col("x"))).alias("n_obs"), r.alias("_r"), (varies("x") & varies("y")).alias("_ok"))
    return out.select(*by, "lag", F.when((F.col("n_obs") > 2) & F.col("_ok"), F.col("_r")).alias("correlation"), "n_obs", interpretation("lag").alias("interpretation"))


def strongest_lag(ccf: DataFrame, *, by: list[str]) -> DataFrame:
    """The lag of the largest absolute correlation; of equal ones the smallest lag."""
    best = ccf.where("correlation IS NOT NULL").groupBy(*by).agg(F.max_by(F.struct("lag", "correlation", "n_obs", "interpretation"), F.struct(F.abs("correlation").alias("r"), (-F.col("lag")).alias("l"))).alias("b"))
    return best.select(*by, "b.*")


def first_difference_correlation(aligned: DataFrame, *, by: list[str], a: str = "signal", b: str = "price", on: str = "bar") -> DataFrame:
    """(by, n, correlation) of first differences; 0 for fewer than three rows or no variance."""
    w = Window.partitionBy(*by).orderBy(on)
    d = aligned.select(*by, (F.col(a) - F.lag(a).over(w)).alias("x"), (F.col(b) - F.lag(b).over(w)).alias("y"))
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return d.groupBy(*by).agg(F.count("*").alias("n"), r.alias("_r")).select(*by, "n", F.when(F.col("n") >= 3, F.coalesce("_r", F.lit(0.0))).otherwise(0.0).alias("correlation"))


def benjamini_hochberg(results: DataFrame, *, p: str = "p_value", alpha: float = 0.05, batch: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """``results`` with p_value_adj and significant, corrected over each batch; null p stay null and not significant.

    A batch is the tests of one run: a few for each market.
    """
    keys = [*(batch or []), F.col(p).isNull()]
    tested = Window.partitionBy(*keys)
    rank = F.row_number().over(tested.orderBy(p, *(tie or [])))
    m = F.count("*").over(tested)
    raw = results.withColumn("_q", F.when(F.col(p).isNotNull(), F.col(p) * m / rank))
    from_above = tested.orderBy(F.col(p).desc(), *[F.col(t).desc() for t in tie or []]).rowsBetween(Window.unboundedPreceding, 0)
    adj = raw.withColumn("p_value_adj", F.least(F.lit(1.0), F.min("_q").over(from_above))).drop("_q")
    adj = adj.withColumn("p_value_adj", F.when(F.col(p).isNotNull(), F.col("p_value_adj")))
    return adj.withColumn("significant", F.coalesce(F.col("p_value_adj") < alpha, F.lit(False)))


def _grouped(df: DataFrame, key: str, fn, schema: str) -> DataFrame:
    return df.groupBy(key).applyInPandas(fn, schema)


def in_logits(aligned: DataFrame) -> DataFrame:
    return aligned.withColumns({"signal": logit(affine_probability("signal")), "price": logit("price")})


def adf_by_market(aligned: DataFrame, *, key: str = "market_id", value: str = "signal", on: str = "bar", mode: str = "constant") -> DataFrame:
    def run(t: pd.DataFrame) -> pd.DataFrame:
        got = adf(t.sort_values(on)[value].to_numpy(), mode=mode)
        return pd.DataFrame([(t[key].iloc[0], *got)] if got else [], columns=[key, "statistic", "p_value", "lag", "n_obs"])

    return _grouped(aligned.select(key, on, value), key, run, f"{key} string, statistic double, p_value double, lag int, n_obs int")


def lag_order_by_market(aligned: DataFrame, *, key: str = "market_id", on: str = "bar", max_lags: int = 12, criterion: str = "aic") -> DataFrame:
    def run(t: pd.DataFrame) -> pd.DataFrame:
        x = t.sort_values(on)[["signal", "price"]].dropna().to_numpy(float)
        return pd.DataFrame([(t[key].iloc[0], var_lag_order(x, max_lags=max_lags, criterion=criterion), len(x))] if len(x) > 3 else [], columns=[key, "lag_order", "n_obs"])

    return _grouped(in_logits(aligned).select(key, on, "signal", "price"), key, run, f"{key} string, lag_order int, n_obs int")


def granger_by_market(aligned: DataFrame, *, key: str = "market_id", on: str = "bar", max_lags: int = 12, criterion: str = "aic", alpha: float = 0.05, controls: tuple[str, ...] = (), run_id: str = "run") -> DataFrame:
    """Both directions for every market with 20 aligned rows or more, corrected over the whole run.

    Markets that can't be tested are left out. Controls are those of ``controls`` that the frame has; constant ones
    are dropped market by market, and rows with a gap in any series don't count.
    """
    extra = [c for c in controls if c in aligned.columns]

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(on)[[key, "signal", "price", *extra]].dropna()
        rows = []
        if len(t) >= MIN_GRANGER and has_variation(t["signal"].to_numpy()) and has_variation(t["price"].to_numpy()):
            s, p = t["signal"].to_numpy(float), t["price"].to_numpy(float)
            kept = [c for c in extra if has_variation(t[c].to_numpy(float))]
            z = t[kept].to_numpy(float) if kept else None
            lag = var_lag_order(np.column_stack([s, p]), max_lags=max_lags, criterion=criterion)
            roots = [adf(x) for x in (s, p)]
            for direction, cause, effect in (("signal_to_price", s, p), ("price_to_signal", p, s)):
                f, pv, *_ = granger(cause, effect, lag, z)
                if math.isfinite(f):
                    rows.append((t[key].iloc[0], direction, lag, len(t), f, pv, *[r[1] if r else None for r in roots], bool(kept)))
        return pd.DataFrame(rows, columns=[key, "direction", "lag_order", "n_obs", "f_stat", "p_value", "adf_p_signal", "adf_p_price", "controlled"])

    schema = f"{key} string, direction string, lag_order int, n_obs int, f_stat double, p_value double, adf_p_signal double, adf_p_price double, controlled boolean"
    tested = _grouped(in_logits(aligned).select(key, on, "signal", "price", *extra), key, run, schema).withColumn("run_id", F.lit(run_id))
    return benjamini_hochberg(tested, alpha=alpha, batch=["run_id"], tie=[key, "direction"])


def platt_fit(pairs: DataFrame, *, signal: str = "s_t", outcome: str = "outcome", rounds: int = 100, tolerance: float = 1e-9) -> tuple[float, float, float, int]:
    """(a, b, log loss, n) over all rows: each Newton step is one aggregation of six sums, so the rows never gather."""
    x, y = F.col(signal), F.col(outcome).cast("double")
    rows = pairs.where(x.isNotNull() & y.isNotNull())
    n, up, bad = rows.agg(F.count("*"), F.sum(y), F.sum(F.when(x.between(-1, 1) & y.isin(0.0, 1.0), 0).otherwise(1))).first()
    if n < 2 or bad or up in (0, n):
        raise ValueError("a fit needs signals from -1 to 1 and both outcomes")
    goal = F.when(y == 1, (up + 1.0) / (up + 2.0)).otherwise(1.0 / (n - up + 2.0))
    a, b = 0.0, 2.0
    prob = lambda: F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), 1.0 / (1.0 + F.exp(-(F.lit(a) + F.lit(b) * x)))))
    for _ in range(rounds):
        p = prob()
        w = p * (1 - p)
        g0, g1, h0, h1, h2 = rows.agg(F.sum(p - goal), F.sum((p - goal) * x), F.sum(w), F.sum(w * x), F.sum(w * x * x)).first()
        det = h0 * h2 - h1 * h1
        if abs(det) < 1e-12:
            break
        da, db = (h2 * g0 - h1 * g1) / det, (h0 * g1 - h1 * g0) / det
        a, b = a - da, b - db
        if max(abs(da), abs(db)) < tolerance:
            break
    p = prob()
    loss = rows.agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))).first()[0]
    return a, b, loss, n
