"""Queries over the driver's tables, one or more for each operator, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import text as T
from ..operators import ledger, lmsr, posts, repository, scoring, signal, stats, temporal
from ..sources import adapters, sinks
from ..sources.adapters import FIRST_MODEL, SECOND_MODEL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6)
    return out.alias(name) if name else out


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c, c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- shared inputs ------------------------------------------------------------------------------------------------------


def accepted(spark, d) -> DataFrame:
    return adapters.posts(spark, d).where("filter_verdict = 'accepted'")


def contributions(spark, d, version: str = FIRST_MODEL) -> DataFrame:
    return signal.contributions(adapters.posts(spark, d), adapters.stances(spark, d), version)


def fixed_series(spark, d) -> DataFrame:
    return signal.signal_series(contributions(spark, d), signal.bars_of_posts(accepted(spark, d)))


def aligned(spark, d) -> DataFrame:
    """(market_id, bar, price, signal) on one hourly grid."""
    quotes = adapters.ticks(spark, d).withColumn("price", X.mid())
    series = fixed_series(spark, d).select("market_id", X.bar_start("bar").alias("ts"), F.col("s_t").alias("signal"))
    return temporal.align_union_span(quotes, series, by=["market_id"], price_tie=["tick_id"])


def observations(spark, d) -> DataFrame:
    last = F.max_by(F.struct("yes_bid", "yes_ask", "depth_bid", "depth_ask"), F.struct("ts", "tick_id"))
    books = adapters.ticks(spark, d).where("source = 'book'").groupBy("market_id", X.bar_of("ts").alias("bar")).agg(last.alias("b"))
    return aligned(spark, d).join(books.select("market_id", "bar", "b.*"), ["market_id", "bar"], "left")


def points(spark, d) -> DataFrame:
    """(market_id, bar, ts, s_t, p_hat, price): the signal with its hour's mid."""
    series = signal.with_probability(fixed_series(spark, d))
    quotes = adapters.ticks(spark, d)
    hourly = quotes.withColumn("price", X.mid()).where("price IS NOT NULL").groupBy("market_id", X.bar_of("ts").alias("bar")).agg(F.max_by("price", F.struct("ts", "tick_id")).alias("price"))
    return series.join(hourly, ["market_id", "bar"], "left").withColumn("ts", X.bar_start("bar"))


def paper_fills(spark, d) -> DataFrame:
    return ledger.rebalance(points(spark, d))


def positions(spark, d) -> DataFrame:
    return ledger.apply_fills(None, ledger.fill_deltas(paper_fills(spark, d)))


def marks(spark, d) -> DataFrame:
    last = repository.latest(adapters.ticks(spark, d).withColumn("mark", X.mid()).select("market_id", "ts", "tick_id", "mark"), by=["market_id"], on="ts", tie=["tick_id"])
    return last.select("market_id", "mark")


# --- signal ---------------------------------------------------------------------------------------------------------------


@query
def signal_latest(spark, d):
    end = adapters.posts(spark, d).agg(F.max("created_at").alias("at"))
    contrib = contributions(spark, d).join(F.broadcast(end))  # one row
    return rounded(signal.signal_at(contrib, F.col("at")).withColumn("p_hat", X.affine_probability("s_t")))


@query
def signal_series_fixed(spark, d):
    return rounded(signal.with_probability(fixed_series(spark, d)).drop("calibration"))


@query
def signal_series_adaptive(spark, d):
    kept = accepted(spark, d)
    bars = signal.bars_of_posts(kept)
    hl = signal.half_lives(kept, adapters.ticks(spark, d), bars)
    return rounded(signal.signal_series(contributions(spark, d), bars, hl))


@query
def half_life_adaptive(spark, d):
    kept = accepted(spark, d)
    return rounded(signal.half_lives(kept, adapters.ticks(spark, d), signal.bars_of_posts(kept)))


@query
def baseline_rate_median(spark, d):
    kept = accepted(spark, d)
    return rounded(signal.activity(kept, signal.bars_of_posts(kept)))


@query
def post_weight(spark, d):
    return adapters.posts(spark, d).select("post_id", r6(X.post_weight("followers", "engagements"), "weight"))


@query
def p_hat_affine(spark, d):
    return adapters.stances(spark, d).select("post_id", "model_version", r6(X.affine_probability("stance"), "p_hat"), r6(X.platt_probability("stance", -0.1, 2.5), "p_platt"), r6(X.logit(X.affine_probability("stance")), "log_odds"))


@query
def ensemble_disagreement(spark, d):
    s = adapters.stances(spark, d)
    first, second = (s.where(F.col("model_version") == v) for v in (FIRST_MODEL, SECOND_MODEL))
    both = first.join(second.select("post_id", F.col("stance").alias("other")), "post_id")
    gap = F.abs(F.col("stance") - F.col("other"))
    return both.select("post_id", F.lit(f"{FIRST_MODEL}+{SECOND_MODEL}").alias("model_version"), r6("stance", "stance"), r6(gap, "disagreement"), (r6(gap) > 0.5).alias("flagged"))


@query
def hourly_mean_stance(spark, d):
    s = adapters.stances(spark, d).where(F.col("model_version") == FIRST_MODEL)
    return s.groupBy("market_id", F.window("created_at", "1 hour").getField("start").alias("hour")).agg(r6(F.avg("stance"), "mean_stance"), F.count("*").alias("n"))


# --- joins in time -----------------------------------------------------------------------------------------------------------


@query
def asof_price_tol(spark, d):
    quotes = adapters.ticks(spark, d).withColumn("mid", X.mid())
    hit = temporal.asof_join(accepted(spark, d).select("post_id", "market_id", "created_at"), quotes, by=["market_id"], left_on="created_at", right_on="ts", values=["mid", "tick_id"], tie=["tick_id"], tolerance_s=3600)
    return hit.select("post_id", "tick_id", r6("mid", "mid"))


@query
def asof_book(spark, d):
    books = adapters.ticks(spark, d).where("source = 'book'")
    hit = temporal.asof_join(accepted(spark, d).select("post_id", "market_id", "created_at"), books, by=["market_id"], left_on="created_at", right_on="ts", values=["tick_id", "depth_bid", "depth_ask"], tie=["tick_id"])
    return hit.select("post_id", "tick_id", "depth_bid", "depth_ask")


@query
def opening_book(spark, d):
    books = adapters.ticks(spark, d).where("source = 'book'")
    first = fixed_series(spark, d).groupBy("market_id").agg(X.bar_start(F.min("bar")).alias("ts0"))
    hit = temporal.asof_join(first, books, by=["market_id"], left_on="ts0", right_on="ts", values=["tick_id"], tie=["tick_id"])
    earliest = books.groupBy("market_id").agg(F.min_by("tick_id", F.struct("ts", "tick_id")).alias("first_id"))
    return hit.join(earliest, "market_id").select("market_id", F.coalesce("tick_id", "first_id").alias("tick_id"))


@query
def asof_nearest(spark, d):
    quotes = adapters.ticks(spark, d)
    hit = temporal.asof_join(accepted(spark, d).select("post_id", "market_id", "created_at"), quotes, by=["market_id"], left_on="created_at", right_on="ts", values=["tick_id"], tie=["tick_id"], tolerance_s=7200, direction="nearest")
    return hit.select("post_id", F.round(F.abs(X.seconds_between("created_at", "asof_ts")), 3).alias("away_s"))


@query
def grid_align_py(spark, d):
    quotes = adapters.ticks(spark, d).withColumn("price", X.mid())
    series = fixed_series(spark, d).select("market_id", X.bar_start("bar").alias("ts"), F.col("s_t").alias("signal"))
    return rounded(temporal.align_each_span(quotes, series, by=["market_id"], price_tie=["tick_id"]))


@query
def grid_align_union(spark, d):
    return rounded(aligned(spark, d))


@query
def carry_forward(spark, d):
    bars = temporal.last_in_bar(adapters.ticks(spark, d).withColumn("mid", X.mid()), by=["market_id"], on="ts", value="mid", tie=["tick_id"])
    grid = temporal.dense_bars(bars, by=["market_id"], first=F.min("bar"), last=F.max("bar")).join(bars, ["market_id", "bar"], "left")
    one = temporal.carry_forward(grid, by=["market_id"], order="bar", value="mid", limit=1, out="carried_1")
    return rounded(temporal.carry_forward(one, by=["market_id"], order="bar", value="mid", limit=2, out="carried_2"))


@query
def bar_last(spark, d):
    return rounded(temporal.last_in_bar(adapters.ticks(spark, d).withColumn("mid", X.mid()), by=["market_id"], on="ts", value="mid", tie=["tick_id"]))


@query
def hourly_pairs(spark, d):
    return rounded(scoring.hourly_pairs(fixed_series(spark, d).select("market_id", "bar", "s_t"), adapters.ticks(spark, d)))


# --- statistics ----------------------------------------------------------------------------------------------------------------


@query
def ccf_lags(spark, d):
    return rounded(stats.cross_correlation(aligned(spark, d), by=["market_id"], max_lag=12))


@query
def ccf_strongest(spark, d):
    ccf = rounded(stats.cross_correlation(aligned(spark, d), by=["market_id"], max_lag=6))
    return stats.strongest_lag(ccf, by=["market_id"])


@query
def first_diff_corr(spark, d):
    return rounded(stats.first_difference_correlation(aligned(spark, d), by=["market_id"]))


@query
def bh_adjust(spark, d):
    tests = table(spark, d, "orders").select(F.col("o_orderkey").alias("test_id"), F.col("o_orderpriority").alias("run_id"), F.when(F.col("o_orderkey") % 7 != 0, F.round(F.col("o_totalprice") / 1_000_000, 6)).alias("p_value"))
    return rounded(stats.benjamini_hochberg(tests, batch=["run_id"], tie=["test_id"]))


@query
def adf(spark, d):
    return rounded(stats.adf_by_market(aligned(spark, d)))


@query
def adf_trend(spark, d):
    return rounded(stats.adf_by_market(aligned(spark, d), value="price", mode="trend"))


@query
def var_lag_order(spark, d):
    return stats.lag_order_by_market(aligned(spark, d))


@query
def granger_both_dirs(spark, d):
    return rounded(stats.granger_by_market(observations(spark, d), controls=("depth_bid", "depth_ask")))


def _rated(spark, d) -> DataFrame:
    """A forecast from each labelled document's length, for scores that need many outcomes."""
    p = F.round((F.col("n_chars") % 1000) / 1000.0, 3)
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select("doc_id", "lang", F.col("quality").alias("outcome"), p.alias("p"), (2 * p - 1).alias("s_t"))


@query
def platt_fit(spark, d):
    a, b, loss, n = stats.platt_fit(_rated(spark, d))
    return spark.createDataFrame([(round(a, 6), round(b, 6), round(loss, 6), n)], "a double, b double, log_loss double, n_obs long")


# --- scores ------------------------------------------------------------------------------------------------------------------------


def _outcome_pairs(spark, d) -> DataFrame:
    done = adapters.markets(spark, d).where("status = 'settled'").select("market_id", F.col("resolved_outcome").alias("outcome"))
    return points(spark, d).join(done, "market_id")


@query
def brier_by_market(spark, d):
    return rounded(scoring.score_markets(_outcome_pairs(spark, d), by=["market_id"]).select("market_id", "n_obs", "brier_signal", "brier_market"))


@query
def bss_by_market(spark, d):
    s = scoring.score_markets(_outcome_pairs(spark, d), by=["market_id"])
    return rounded(s.select("market_id", "bss", "beats_market", scoring.verdict(F.col("bss")).alias("verdict")))


@query
def calibration_curve(spark, d):
    return rounded(scoring.calibration_curve(_rated(spark, d), p="p", outcome="outcome", bins=10))


@query
def score_freeze(spark, d):
    series = signal.with_probability(fixed_series(spark, d))
    return rounded(scoring.freeze_scores(series, adapters.ticks(spark, d), adapters.markets(spark, d)))


@query
def log_loss(spark, d):
    return rounded(_rated(spark, d).groupBy("lang").agg(scoring.log_loss(F.col("p"), F.col("outcome")).alias("log_loss"), F.sum("outcome").cast("long").alias("n_yes"), F.sum(1 - F.col("outcome")).cast("long").alias("n_no")))


# --- market maker --------------------------------------------------------------------------------------------------------------------


def _quantities(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_retailprice") / 10, F.col("p_size") * 3.0, F.col("p_size") - 30.0).alias("q"), (F.col("p_size") + 5.0).alias("b"))


@query
def lmsr_cost_prices(spark, d):
    p = X.lmsr_prices("q", "b")
    return rounded(_quantities(spark, d).select("id", X.lmsr_cost("q", "b").alias("cost"), p[0].alias("p0"), p[1].alias("p1"), p[2].alias("p2"), X.lmsr_price_yes(F.col("q")[0], F.col("q")[1], "b").alias("price_yes"), X.lmsr_worst_case_subsidy("b", 3).alias("subsidy")))


@query
def lmsr_trade_cost(spark, d):
    dq = F.array(F.lit(1.0), F.lit(-2.0), F.lit(0.5))
    price = F.col("b") / 60.0
    return rounded(_quantities(spark, d).select("id", X.lmsr_trade_cost("q", dq, "b").alias("cost"), X.lmsr_shares_to_move(price, F.lit(0.5), "b").alias("shares")))


@query
def lmsr_b_from_depth(spark, d):
    t = adapters.ticks(spark, d)
    b = {side: X.lmsr_b_from_depth("depth_bid", "depth_ask", "yes_bid", "yes_ask", side=side) for side in ("bid", "ask", "mean")}
    return t.select("tick_id", *[F.round(c, 4).alias(f"b_{side}") for side, c in b.items()])


def _simulated(spark, d) -> DataFrame:
    series = signal.with_probability(fixed_series(spark, d)).withColumn("ts", X.bar_start("bar"))
    return lmsr.simulate(series, adapters.ticks(spark, d))


@query
def lmsr_path(spark, d):
    return rounded(_simulated(spark, d).select("market_id", "ts", "sim_price", "signal"))


@query
def lmsr_state(spark, d):
    return _simulated(spark, d).select("market_id", "ts", *[F.round(c, 3).alias(c) for c in ("b", "q_yes", "q_no", "cost", "trade_size")])


@query
def walk_forward(spark, d):
    w = lmsr.walk_forward(observations(spark, d))
    return rounded(w).withColumn("b", F.round("b", 3))


@query
def backtest_summary(spark, d):
    s = lmsr.backtest_summary(lmsr.walk_forward(observations(spark, d)))
    return rounded(s).withColumns({c: F.round(c, 3) for c in ("b_min", "b_max", "b_mean")})


# --- stored tables ------------------------------------------------------------------------------------------------------------------------


@query
def unscored_posts_anti(spark, d):
    return repository.unscored_posts(adapters.posts(spark, d), adapters.stances(spark, d), SECOND_MODEL).select("post_id", "market_id", "created_at")


@query
def scored_posts_join(spark, d):
    return rounded(repository.scored_posts(adapters.posts(spark, d), adapters.stances(spark, d), FIRST_MODEL))


@query
def resolved_pairs_distinct_on(spark, d):
    series = fixed_series(spark, d).select("market_id", X.bar_start("bar").alias("ts"), "s_t")
    return rounded(repository.resolved_pairs(adapters.markets(spark, d), series))


@query
def latest_price(spark, d):
    return rounded(repository.latest(adapters.ticks(spark, d), by=["market_id"], on="ts", tie=["tick_id"]))


@query
def latest_run_granger(spark, d):
    runs = table(spark, d, "orders").select(F.concat(F.lit("run-"), F.year("o_orderdate")).alias("run_id"), F.col("o_orderkey").alias("test_id"), F.col("o_orderdate").alias("computed_at"), ((F.col("o_orderkey") % 9973).cast("double") / 10_000).alias("p_value"), ((F.col("o_orderkey") % 997).cast("double") / 1000).alias("p_value_adj"))
    return repository.latest_run(runs)


@query
def verdict_counts(spark, d):
    return posts.verdict_counts(adapters.posts(spark, d))


@query
def table_stats(spark, d):
    names = ("posts", "stances", "ticks", "markets")
    return repository.table_stats({n: getattr(adapters, n)(spark, d) for n in names})


@query
def resolution_queue(spark, d):
    m = adapters.markets(spark, d)
    now = m.agg(F.max("close_time").alias("now"))
    return repository.resolution_queue(m.join(F.broadcast(now)), F.col("now")).select("market_id", "status", "close_time")  # one row


@query
def tracked_open(spark, d):
    return repository.tracked_markets(adapters.markets(spark, d), unsettled=True).select("market_id", "status", "tracked")


@query
def newest_fills(spark, d):
    f = rounded(paper_fills(spark, d)).select("market_id", "ts", "action", "quantity")
    return f.orderBy(F.desc("ts"), "market_id").limit(repository.clamp_limit(100))


@query
def top_orders_per_customer(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return repository.topk_per_key(o, by=["o_custkey"], order=[F.desc("o_totalprice"), F.asc("o_orderkey")], k=3)


@query
def market_queries_pivot(spark, d):
    parts = table(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, ("keyword", "hashtag", "entity", "exclude"))), (F.col("p_size") % 4 + 1).cast("int"))
    lists = repository.query_lists(parts.select(F.col("p_brand").alias("market_id"), kind.alias("term_type"), F.col("p_type").alias("term")))
    return lists.select("market_id", *[F.array_join(c, "|").alias(c) for c in lists.columns if c != "market_id"])


@query
def query_string(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("a"), F.split("p_name", " ").alias("b"), F.array("p_brand").alias("x"))
    terms = X.query_terms(F.array_append("a", F.lit("rate cut")), "b")
    return p.select("p_partkey", X.query_string(terms, "x", lang="en").alias("q"))


@query
def keyed_merge(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = o.where("o_orderkey % 3 <> 0")
    new = o.where("o_orderkey % 3 <> 1").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") + 1).alias("o_totalprice"))
    return sinks.merge(old, new, key=["o_orderkey"], update=["o_totalprice"], keep_if_null=["o_totalprice"])


@query
def insert_missing(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return sinks.insert_missing(c.where("c_custkey % 2 = 0"), c.withColumn("c_name", F.upper("c_name")), key=["c_custkey"])


@query
def purge_before(spark, d):
    t = adapters.ticks(spark, d)
    cutoff = t.agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("cutoff"))
    kept, gone = sinks.purge(t.join(F.broadcast(cutoff)), on="ts", cutoff=F.col("cutoff"))  # one row
    return kept.agg(F.count("*").alias("kept")).join(gone.agg(F.count("*").alias("purged")))  # one row each


@query
def read_budget_fold(spark, d):
    e = table(spark, d, "events")
    requests = e.select(F.col("event_id").alias("request_id"), F.to_date("ts").alias("day"), F.col("event_type").alias("service"), F.when(F.col("event_id") % 20 == 0, -(F.col("user_id") % 7)).otherwise(F.col("user_id") % 40).cast("long").alias("reads"))
    return rounded(ledger.reserve_reads(requests, ceiling=200))


# --- ledger --------------------------------------------------------------------------------------------------------------------------------


@query
def target_position(spark, d):
    return points(spark, d).select("market_id", "bar", r6(X.target_position(r6("p_hat"), r6("price")), "target"))


@query
def rebalance_deltas(spark, d):
    # prices and targets of few decimals make sums that end in a 5; a billionth keeps them off the edge of the rounding
    return rounded(paper_fills(spark, d).withColumn("cash_flow", F.col("cash_flow") + 1e-9))


@query
def positions_cumulative(spark, d):
    return rounded(ledger.running_positions(paper_fills(spark, d)).select("market_id", "ts", "qty_yes", "cash"))


@query
def mark_to_market(spark, d):
    return rounded(ledger.mark_to_market(positions(spark, d), marks(spark, d)))


@query
def portfolio(spark, d):
    return rounded(ledger.portfolio(ledger.mark_to_market(ledger.open_positions(positions(spark, d)), marks(spark, d))))


@query
def settlement(spark, d):
    return rounded(ledger.settle(positions(spark, d), adapters.markets(spark, d))[1])


@query
def settlement_fills(spark, d):
    return rounded(ledger.settle(positions(spark, d), adapters.markets(spark, d))[0])


# --- texts -----------------------------------------------------------------------------------------------------------------------------------


def _texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query
def text_normalize(spark, d):
    return _texts(spark, d).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest"))


@query
def shingles(spark, d):
    return _texts(spark, d).select("doc_id", F.size(T.shingles(T.normalize(F.col("text")))).cast("long").alias("n_shingles"))


@query
def exact_jaccard_pairs(spark, d):
    """Near-duplicate verdicts' pairs with the exact similarity of their shingles beside the estimate."""
    signed = posts.prepared(_posts_of_documents(spark, d))
    pairs = posts.near_duplicates(signed)
    a = signed.select("post_id", F.col("shingles").alias("x"))
    b = signed.select(F.col("post_id").alias("original_id"), F.col("shingles").alias("y"))
    return pairs.join(a, "post_id").join(b, "original_id").select("post_id", "original_id", r6("similarity", "estimate"), r6(T.jaccard(F.col("x"), F.col("y")), "jaccard"))


@query
def lines_jaccard_pairs(spark, d):
    """Exact Jaccard similarity by words of each document with the first of those that share its first line."""
    words = F.array_distinct(F.filter(F.split(F.translate(F.lower("text"), "\n", " "), " "), lambda w: w != ""))
    x = _texts(spark, d).select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("head"), words.alias("w")).where("size(w) > 0")
    first = x.groupBy("head").agg(F.min_by(F.struct("doc_id", "w"), "doc_id").alias("f"))
    pairs = x.join(first, "head").where("doc_id > f.doc_id")
    return pairs.select(F.col("f.doc_id").alias("left_id"), F.col("doc_id").alias("right_id"), r6(T.jaccard(F.col("f.w"), F.col("w")), "jaccard"))


@query
def symbol_ratio(spark, d):
    return _texts(spark, d).select("doc_id", r6(X.symbol_ratio("text"), "ratio"))


@query
def heuristic_verdict(spark, d):
    base = _texts(spark, d).select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("Big GIVEAWAY now: "), F.col("text"))).otherwise(F.col("text")).alias("text"), (F.col("n_chars") % 90).alias("followers"), (F.col("doc_id") % 30).alias("age"))
    v = posts.heuristic(age_days=F.col("age"))
    return base.select("doc_id", v["verdict"].alias("verdict"), v["reason"].alias("reason"))


@query
def parse_money(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.lit("n/a")).when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))).alias("value"))
    return rounded(p.select("p_partkey", X.parse_money("value").alias("price"), X.parse_money("value", default=0.0).alias("price_or_zero")))


def _posts_of_documents(spark, d) -> DataFrame:
    """Documents as posts of a market for each language, arriving in the order of their ids."""
    return _texts(spark, d).select(F.format_string("%012d", "doc_id").alias("post_id"), F.col("lang").alias("market_id"), F.timestamp_add("SECOND", F.col("doc_id"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).alias("created_at"), "text", (F.col("n_chars") % 300).cast("int").alias("followers"))


@query
def minhash_signature(spark, d):
    s = posts.prepared(_posts_of_documents(spark, d))
    return s.select("post_id", F.size("signature").alias("n"), F.element_at("buckets", 1).alias("lsh_bucket"))


@query
def lsh_candidates(spark, d):
    return rounded(posts.near_duplicates(posts.prepared(_posts_of_documents(spark, d))))


@query
def near_dup_verdict(spark, d):
    v = posts.filter_posts(_posts_of_documents(spark, d))
    return v.select("post_id", "market_id", "lsh_bucket", "filter_verdict", "filter_reason")


@query
def lsh_retrieval(spark, d):
    s = table(spark, d, "part").select("p_size").distinct()
    return rounded(s.select("p_size", X.lsh_retrieval_probability(F.col("p_size") / 50.0).alias("p_16x8"), X.lsh_retrieval_probability(F.col("p_size") / 50.0, 8, 16).alias("p_8x16")))


@query
def running_value(spark, d):
    """Running sums and first differences over each user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events")
    return rounded(e.select("event_id", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), (F.col("value") - F.lag("value").over(w)).alias("step"), (~F.col("ts").eqNullSafe(F.lag("ts").over(w))).alias("fresh")))
