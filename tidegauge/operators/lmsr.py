"""Simulation of a market maker with the logarithmic scoring rule, and walk-forward backtests of it.

With no limit on shares the log-odds L of the price follow L' = L + r (logit p - L) whatever the liquidity b, and the
state is q_yes = b L, q_no = 0. Series have a row per bar and market, so a market's series fits one ordered fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import B_FALLBACK, RESPONSIVENESS, affine_probability, lmsr_b_from_depth, logit, mid, sigmoid
from .temporal import asof_join

GRID = (0.1, 0.2, 0.35, 0.5, 0.75, 1.0)
TRAIN, TEST = 72, 24


def softplus_cost(b: Column, level: Column) -> Column:
    """b ln(1 + e^L), without overflow."""
    return b * (F.greatest(level, F.lit(0.0)) + F.log1p(F.exp(-F.abs(level))))


def simulate(signals: DataFrame, ticks: DataFrame, *, run_id: str = "run", responsiveness: float = RESPONSIVENESS, initial_price: float | None = None, on: str = "ts", max_shares: float | None = None, key: str = "market_id") -> DataFrame:
    """(market_id, ts, run_id, sim_price, b, q_yes, q_no, cost, trade_size, signal) for each signal, in time order.

    ``signals`` has market_id, ts, s_t and p_hat (null: the affine map). The anchor is the initial price, else the last
    book's mid, else one half. Each step first takes the liquidity of the book as of its time (before any book: the
    first one's), holding the price, and then closes the share ``responsiveness`` of the gap in log-odds, by at most
    ``max_shares``. Markets without books simulate at the fallback liquidity.
    """
    books = ticks.where("source = 'book'").withColumns({"mid": mid(), "b": lmsr_b_from_depth("depth_bid", "depth_ask", "yes_bid", "yes_ask")})
    ends = books.groupBy(F.col(key).alias("_m")).agg(F.max_by("mid", F.struct("ts", "tick_id")).alias("_last_mid"), F.min_by("b", F.struct("ts", F.col("tick_id") * -1)).alias("_first_b"))
    at = asof_join(signals, books, by=[key], left_on=on, right_on="ts", values=["b"], tie=["tick_id"]).join(ends, F.col(key) == F.col("_m"), "left")
    anchor = F.lit(float(initial_price)) if initial_price is not None else F.coalesce(F.col("_last_mid"), F.lit(0.5))
    steps = at.select(key, F.col(on).alias("ts"), F.col("s_t").alias("signal"), logit(F.coalesce("p_hat", affine_probability("s_t"))).alias("goal"), F.coalesce("b", "_first_b", F.lit(B_FALLBACK)).alias("b"), logit(anchor).alias("anchor"))
    path = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "signal", "goal", "b"))).alias("xs"), F.first("anchor").alias("anchor"))

    def step(acc: Column, x: Column) -> Column:
        # the level survives a change of b; the cap is on shares
        wish = (x["goal"] - acc["level"]) * responsiveness * x["b"]
        trade = wish if max_shares is None else F.greatest(F.lit(-float(max_shares)), F.least(F.lit(float(max_shares)), wish))
        level = acc["level"] + (wish if max_shares is None else trade) / x["b"]
        row = F.struct(x["ts"].alias("ts"), level.alias("level"), x["b"].alias("b"), trade.alias("trade"), x["signal"].alias("signal"))
        return F.struct(level.alias("level"), F.concat(acc["out"], F.array(row)).alias("out"))

    kind = "array<struct<ts:timestamp_ntz,level:double,b:double,trade:double,signal:double>>"
    out = path.select(key, F.explode(F.aggregate("xs", F.struct(F.col("anchor").alias("level"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])).alias("r"))
    level, b = F.col("r.level"), F.col("r.b")
    return out.select(key, F.col("r.ts").alias("ts"), F.lit(run_id).alias("run_id"), sigmoid(level).alias("sim_price"), b.alias("b"), (b * level).alias("q_yes"), F.lit(0.0).alias("q_no"), softplus_cost(b, level).alias("cost"), F.col("r.trade").alias("trade_size"), F.col("r.signal").alias("signal"))


def simulate_path(obs: Column, responsiveness: Column) -> Column:
    """Simulated prices over an ordered array of (signal, price) structs, anchored at the first price."""
    start = F.struct(logit(F.element_at(obs, 1)["price"]).alias("level"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        level = acc["level"] + responsiveness * (logit(affine_probability(x["signal"])) - acc["level"])
        return F.struct(level.alias("level"), F.concat(acc["out"], F.array(sigmoid(level))).alias("out"))

    return F.aggregate(obs, start, step, lambda a: a["out"])


def _path_mse(obs: Column, responsiveness: float) -> Column:
    start = F.struct(logit(F.element_at(obs, 1)["price"]).alias("level"), F.lit(0.0).alias("sse"))

    def step(acc: Column, x: Column) -> Column:
        level = acc["level"] + responsiveness * (logit(affine_probability(x["signal"])) - acc["level"])
        return F.struct(level.alias("level"), (acc["sse"] + F.pow(sigmoid(level) - x["price"], F.lit(2.0))).alias("sse"))

    return F.aggregate(obs, start, step, lambda a: a["sse"]) / F.size(obs)


def mean_squared_error(a: Column, b: Column) -> Column:
    """Null for empty arrays or arrays of unlike length."""
    sse = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), sse / F.size(a))


def difference_correlation(a: Column, b: Column) -> Column:
    """Pearson's r of the first differences; 0 for fewer than three values or no variance."""
    steps = lambda x: F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(1))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(1))), lambda p, q: p - q)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, d: s + d)
    da, db = steps(a), steps(b)
    n = F.size(da)
    centre = lambda x: F.transform(x, lambda d: d - total(x) / n)
    ca, cb = centre(da), centre(db)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    r = F.try_divide(dot(ca, cb), F.sqrt(dot(ca, ca) * dot(cb, cb)))
    return F.when((F.size(a) >= 3) & (F.size(a) == F.size(b)), F.coalesce(r, F.lit(0.0))).otherwise(0.0)


def walk_forward(observations: DataFrame, *, key: str = "market_id", on: str = "bar", train: int = TRAIN, test: int = TEST, step: int | None = None, grid: tuple[float, ...] = GRID, fallback_b: float = B_FALLBACK) -> DataFrame:
    """One row per market and window: responsiveness fitted on the train part, errors on the test part after it.

    ``observations`` has signal and price, and null or not yes_bid, yes_ask, depth_bid, depth_ask. Each row goes to
    the windows that hold it, and a window of train + test rows is evaluated by itself; of equal train errors the first
    of the grid wins. Liquidity comes from the last quoted row of the train part. The test path starts at its own
    first price while the baseline holds the last train price. Short series have no window.
    """
    step = test if step is None else step
    if min(train, test, step) < 1 or not grid:
        raise ValueError("train, test and step must be positive and the grid not empty")
    size = train + test
    w = Window.partitionBy(key).orderBy(on)
    rows = observations.withColumns({"i": (F.row_number().over(w) - 1).cast("long"), "n": F.count("*").over(Window.partitionBy(key))}).where(F.col("n") >= size)
    lo = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step)).cast("long")
    hi = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - size) / step)).cast("long")
    placed = rows.withColumn("window", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    one = F.struct("i", "signal", "price", "yes_bid", "yes_ask", "depth_bid", "depth_ask")
    packed = placed.groupBy(key, "window").agg(F.array_sort(F.collect_list(one)).alias("xs"))
    parts = packed.select(key, "window", F.slice("xs", 1, train).alias("tr"), F.slice("xs", train + 1, test).alias("te"))
    quoted = F.filter("tr", lambda x: x["yes_bid"].isNotNull() & x["yes_ask"].isNotNull())
    fits = F.array(*[F.struct(_path_mse(F.col("tr"), r).alias("mse"), F.lit(k).alias("k"), F.lit(float(r)).alias("r")) for k, r in enumerate(grid)])
    finite = F.filter(fits, lambda f: f["mse"].isNotNull() & ~F.isnan(f["mse"]) & (f["mse"] < float("inf")))
    chosen = parts.withColumns({"q": F.element_at(F.when(F.size(quoted) > 0, quoted), -1), "responsiveness": F.coalesce(F.array_min(finite)["r"], F.lit(float(grid[0])))})
    run = chosen.withColumns({"path": simulate_path(F.col("te"), F.col("responsiveness")), "actual": F.transform("te", lambda x: x["price"]), "last": F.element_at("tr", -1)["price"]})
    return run.select(
        key, "window", (F.col("window") * step).alias("train_start"), (F.col("window") * step + train).alias("test_start"),
        F.when(F.col("q").isNotNull(), lmsr_b_from_depth("q.depth_bid", "q.depth_ask", "q.yes_bid", "q.yes_ask", fallback=fallback_b)).otherwise(F.lit(float(fallback_b))).alias("b"),
        "responsiveness", mean_squared_error(F.col("path"), F.col("actual")).alias("mse"),
        mean_squared_error(F.transform("actual", lambda _: F.col("last")), F.col("actual")).alias("mse_baseline"),
        difference_correlation(F.col("path"), F.col("actual")).alias("correlation"), F.size("te").cast("long").alias("n_test"),
    )


def backtest_summary(windows: DataFrame, *, key: str = "market_id") -> DataFrame:
    """Per market: mean errors, windows beating the baseline, the spread of b, and the two warnings of the report."""
    out = windows.groupBy(key).agg(
        F.count("*").alias("n_windows"), F.avg("mse").alias("mean_mse"), F.avg("mse_baseline").alias("mean_baseline_mse"),
        F.sum(F.when(F.col("mse") < F.col("mse_baseline"), 1).otherwise(0)).alias("beating_baseline"),
        F.min("b").alias("b_min"), F.max("b").alias("b_max"), F.avg("b").alias("b_mean"), F.try_divide(F.stddev_pop("b"), F.avg("b")).alias("b_cv"),
    )
    return out.withColumns({"b_unstable": F.col("b_cv") > 0.5, "no_skill": 2 * F.col("beating_baseline") <= F.col("n_windows")})

