"""DuckDB twins of the catalog's queries."""

from __future__ import annotations

from ..operators.posts import SPAM_MARKERS
from ..sources.adapters import PRELUDE

_BAR = "CAST(floor(epoch_us({0}) / 3600000000.0) AS BIGINT)"
_TS = "(TIMESTAMP '1970-01-01' + to_seconds({0} * 3600))"
_LOGIT = "ln(least(1 - 1e-6, greatest(1e-6, {0})) / (1 - least(1 - 1e-6, greatest(1e-6, {0}))))"
_SIG = "(CASE WHEN {0} >= 0 THEN 1 / (1 + exp(-{0})) ELSE exp({0}) / (1 + exp({0})) END)"

ACCEPTED = """, acc AS (SELECT * FROM posts WHERE filter_verdict = 'accepted'),
contrib AS (SELECT a.market_id, a.created_at, s.stance, ln(1 + a.followers::DOUBLE) * (1 + a.engagements) AS w FROM acc a JOIN stances s USING (post_id, market_id, created_at) WHERE model_version = 'lex-1' AND a.followers > 0)
"""
BARS = f""", bars AS (SELECT market_id, unnest(range(a + 1, b + 1)) AS bar FROM (SELECT market_id, {_BAR.format('min(created_at)')} AS a, {_BAR.format('max(created_at)')} AS b FROM acc GROUP BY 1)),
bt AS (SELECT market_id, bar, {_TS.format('bar')} AS t FROM bars)
"""
SIGNAL = """, aged AS (SELECT b.market_id, b.bar, b.t, c.stance, c.w, (epoch_us(b.t) - epoch_us(c.created_at)) / 1e6 AS age FROM bt b JOIN contrib c ON c.market_id = b.market_id AND c.created_at <= b.t AND c.created_at >= b.t - INTERVAL 7 DAY),
sig AS (SELECT market_id, bar, any_value(t) AS t, greatest(-1, least(1, sum(stance * w * exp(-age * ln(2) / 21600)) / sum(w * exp(-age * ln(2) / 21600)))) AS s_t, count(*) AS n_posts, sum(w * exp(-age * ln(2) / 21600)) AS weight_sum FROM aged GROUP BY 1, 2)
"""
ACTIVITY = """, near AS (SELECT b.market_id, b.bar, b.t, a.created_at FROM bt b JOIN acc a ON a.market_id = b.market_id AND a.created_at >= b.t - INTERVAL 24 HOUR AND a.created_at <= b.t),
recent AS (SELECT b.market_id, b.bar, count(n.created_at) FILTER (WHERE n.created_at > b.t - INTERVAL 1 HOUR) AS recent FROM bt b LEFT JOIN near n USING (market_id, bar) GROUP BY 1, 2),
hourly AS (SELECT market_id, bar, least(23, CAST(floor((epoch_us(created_at) - epoch_us(t - INTERVAL 24 HOUR)) / 3600000000.0) AS BIGINT)) AS h, count(*) AS c FROM near GROUP BY 1, 2, 3),
act AS (
  SELECT r.market_id, r.bar, CAST(r.recent AS DOUBLE) AS recent, m.baseline FROM recent r JOIN (
    SELECT b.market_id, b.bar, median(coalesce(c, 0)) AS baseline FROM bt b CROSS JOIN (SELECT unnest(range(24)) AS h) x LEFT JOIN hourly y ON y.market_id = b.market_id AND y.bar = b.bar AND y.h = x.h GROUP BY 1, 2) m USING (market_id, bar))
"""
HALF_LIFE = f""", q AS (SELECT market_id, ts, last(mid ORDER BY tick_id) AS mid FROM mids GROUP BY 1, 2),
px AS (
  SELECT x.market_id, x.bar, x.k, CASE WHEN x.at - q.ts <= INTERVAL 1 HOUR THEN q.mid END AS p
  FROM (SELECT market_id, bar, k, t - to_hours(CAST(k AS INTEGER)) AS at FROM bt CROSS JOIN (SELECT unnest([0, 1]) AS k)) x ASOF LEFT JOIN q ON q.market_id = x.market_id AND x.at >= q.ts),
moves AS (SELECT a.market_id, a.bar, a.p - b.p AS move FROM px a JOIN px b ON a.market_id = b.market_id AND a.bar = b.bar AND a.k = 0 AND b.k = 1),
hl AS (SELECT market_id, bar, recent, baseline, move, greatest(1800.0, 21600.0 / greatest(1.0, recent / (greatest(baseline, 1.0) * 3.0), abs(coalesce(move, 0.0)) / 0.05)) AS half_life_seconds FROM act JOIN moves USING (market_id, bar))
"""
# last mid that isn't null in each bar; grids by span
HOURLY = f""", lastmid AS (SELECT market_id, {_BAR.format('ts')} AS bar, arg_max(mid, (ts, tick_id)) AS price FROM mids WHERE mid IS NOT NULL GROUP BY 1, 2)
"""
ALIGNED = """, spans AS (SELECT market_id, min(bar) AS a, max(bar) AS b FROM (SELECT market_id, bar FROM lastmid UNION ALL SELECT market_id, bar FROM sig) GROUP BY 1),
grid AS (SELECT market_id, unnest(range(a, b + 1)) AS bar FROM spans WHERE market_id IN (SELECT market_id FROM lastmid) AND market_id IN (SELECT market_id FROM sig)),
al AS (
  SELECT g.market_id, g.bar, coalesce(p0.price, p1.price) AS price, coalesce(s0.s_t, s1.s_t) AS signal
  FROM grid g LEFT JOIN lastmid p0 ON p0.market_id = g.market_id AND p0.bar = g.bar LEFT JOIN lastmid p1 ON p1.market_id = g.market_id AND p1.bar = g.bar - 1
  LEFT JOIN sig s0 ON s0.market_id = g.market_id AND s0.bar = g.bar LEFT JOIN sig s1 ON s1.market_id = g.market_id AND s1.bar = g.bar - 1
  WHERE coalesce(p0.price, p1.price) IS NOT NULL AND coalesce(s0.s_t, s1.s_t) IS NOT NULL)
"""
POINTS = """, pts AS (SELECT s.market_id, s.bar, s.t AS ts, s.s_t, (s.s_t + 1) / 2 AS p_hat, m.price FROM sig s LEFT JOIN lastmid m USING (market_id, bar))
"""
FILLS = """, tgt AS (SELECT *, CASE WHEN abs(p_hat - price) < 0.05 THEN 0.0 ELSE greatest(-100.0, least(100.0, (p_hat - price) * 100.0)) END AS target FROM pts WHERE p_hat IS NOT NULL AND price IS NOT NULL),
dl AS (SELECT *, target - coalesce(lag(target) OVER (PARTITION BY market_id ORDER BY ts), 0) AS delta FROM tgt),
fills AS (SELECT market_id, ts, 'edge' AS strategy, 'yes' AS side, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS action, abs(delta) AS quantity, price, -delta * price AS cash_flow, delta FROM dl WHERE abs(delta) >= 1e-9),
pos AS (SELECT market_id, 'edge' AS strategy, sum(delta) AS qty_yes, 0.0::DOUBLE AS qty_no, sum(cash_flow) AS cash, 0.0::DOUBLE AS realized_pnl, false AS settled FROM fills GROUP BY 1),
marks AS (SELECT market_id, arg_max(coalesce(mid, -1), (ts, tick_id)) AS m FROM mids GROUP BY 1),
marked AS (SELECT p.*, CASE WHEN m >= 0 THEN m END AS mark, CASE WHEN m >= 0 THEN (qty_yes - qty_no) * m ELSE 0.0 END AS value, CASE WHEN m >= 0 THEN (qty_yes - qty_no) * m + cash ELSE 0.0 END AS unrealized, realized_pnl + CASE WHEN m >= 0 THEN (qty_yes - qty_no) * m + cash ELSE 0.0 END AS total FROM pos p LEFT JOIN marks USING (market_id))
"""
RATED = """WITH rated AS (SELECT l.doc_id, d.lang, l.quality AS outcome, round((d.n_chars % 1000) / 1000.0, 3)::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id))
"""
_B = "least(1000000.0, greatest(1.0, {0} / (" + _LOGIT.format("yes_ask") + " - " + _LOGIT.format("yes_bid") + ")))"
_QUOTED = "yes_bid > 0 AND yes_ask < 1 AND yes_ask > yes_bid"
_MEAN = "coalesce((nullif(depth_bid, 0) + nullif(depth_ask, 0)) / 2, nullif(depth_bid, 0), nullif(depth_ask, 0))"


def _b(depth: str) -> str:
    return f"CASE WHEN {_QUOTED} AND {depth} IS NOT NULL THEN {_B.format(depth)} ELSE 100.0 END"


BOOKS = f""", books AS (SELECT *, {_b(_MEAN)} AS b FROM mids WHERE source = 'book'),
bk AS (SELECT market_id, ts, arg_max(b, tick_id) AS b FROM books GROUP BY 1, 2),
ends AS (SELECT market_id, arg_max(coalesce(mid, -1), (ts, tick_id)) AS last_mid, arg_min(b, (ts, tick_id)) AS first_b FROM books GROUP BY 1),
stp AS (
  SELECT s.market_id, s.t AS ts, s.s_t, {_LOGIT.format('(s.s_t + 1) / 2')} AS goal, coalesce(k.b, e.first_b, 100.0) AS b, {_LOGIT.format('(CASE WHEN e.last_mid >= 0 THEN e.last_mid ELSE 0.5 END)')} AS anchor,
         row_number() OVER (PARTITION BY s.market_id ORDER BY s.t) AS i
  FROM sig s ASOF LEFT JOIN bk k ON k.market_id = s.market_id AND s.t >= k.ts LEFT JOIN ends e ON e.market_id = s.market_id),
path AS (
  SELECT market_id, ts, s_t, b, i, 0.65 * anchor + 0.35 * goal AS level, 0.35 * (goal - anchor) AS gap FROM stp WHERE i = 1
  UNION ALL SELECT s.market_id, s.ts, s.s_t, s.b, s.i, p.level + 0.35 * (s.goal - p.level), 0.35 * (s.goal - p.level) FROM path p JOIN stp s ON s.market_id = p.market_id AND s.i = p.i + 1)
"""
WALK = f""", obs AS (
  SELECT a.market_id, a.bar, a.signal, a.price, l.yes_bid, l.yes_ask, l.depth_bid, l.depth_ask, row_number() OVER (PARTITION BY a.market_id ORDER BY a.bar) - 1 AS i, count(*) OVER (PARTITION BY a.market_id) AS n
  FROM al a LEFT JOIN (SELECT market_id, {_BAR.format('ts')} AS bar, unnest(arg_max(struct_pack(yes_bid := yes_bid, yes_ask := yes_ask, depth_bid := depth_bid, depth_ask := depth_ask), (ts, tick_id))) FROM ticks WHERE source = 'book' GROUP BY 1, 2) l USING (market_id, bar)),
win AS (SELECT market_id, unnest(range(0, CAST((any_value(n) - 96) // 24 + 1 AS BIGINT))) AS w FROM obs GROUP BY market_id HAVING any_value(n) >= 96),
wo AS (SELECT o.*, w.w, o.i - w.w * 24 AS j FROM obs o JOIN win w ON o.market_id = w.market_id AND o.i >= w.w * 24 AND o.i < w.w * 24 + 96),
wg AS (SELECT market_id, w, j, price, {_LOGIT.format('(signal + 1) / 2')} AS g, {_LOGIT.format('price')} AS lp FROM wo),
rs AS (SELECT unnest([0.1, 0.2, 0.35, 0.5, 0.75, 1.0]) AS r),
paths AS (
  SELECT a.market_id, a.w, rs.r, a.j, any_value(a.price) AS price,
         pow(1 - rs.r, a.j - (CASE WHEN a.j < 72 THEN 0 ELSE 72 END) + 1) * any_value(f.lp) + sum(rs.r * pow(1 - rs.r, a.j - b.j) * b.g) AS level
  FROM wg a JOIN wg b ON a.market_id = b.market_id AND a.w = b.w AND b.j <= a.j AND (b.j < 72) = (a.j < 72)
  JOIN wg f ON f.market_id = a.market_id AND f.w = a.w AND f.j = (CASE WHEN a.j < 72 THEN 0 ELSE 72 END) CROSS JOIN rs GROUP BY 1, 2, 3, 4),
sims AS (SELECT *, {_SIG.format('level')} AS sim FROM paths),
fit AS (SELECT market_id, w, arg_min(r, (mse, r)) AS r FROM (SELECT market_id, w, r, round(avg(pow(sim - price, 2)), 15) AS mse FROM sims WHERE j < 72 GROUP BY 1, 2, 3) GROUP BY 1, 2),
tst AS (SELECT s.*, s.sim - lag(s.sim) OVER o AS ds, s.price - lag(s.price) OVER o AS dp FROM sims s JOIN fit f ON f.market_id = s.market_id AND f.w = s.w AND f.r = s.r WHERE s.j >= 72 WINDOW o AS (PARTITION BY s.market_id, s.w ORDER BY s.j)),
wb AS (SELECT market_id, w, arg_max({_b(_MEAN)}, j) AS b FROM wo WHERE j < 72 AND yes_bid IS NOT NULL AND yes_ask IS NOT NULL GROUP BY 1, 2),
wf AS (
  SELECT t.market_id, t.w AS window, t.w * 24 AS train_start, t.w * 24 + 72 AS test_start, coalesce(any_value(wb.b), 100.0) AS b, any_value(t.r) AS responsiveness,
         avg(pow(t.sim - t.price, 2)) AS mse, avg(pow(l.price - t.price, 2)) AS mse_baseline,
         CASE WHEN stddev_pop(ds) * stddev_pop(dp) > 0 THEN covar_pop(ds, dp) / (stddev_pop(ds) * stddev_pop(dp)) ELSE 0 END AS correlation, count(*) AS n_test
  FROM tst t JOIN wg l ON l.market_id = t.market_id AND l.w = t.w AND l.j = 71 LEFT JOIN wb ON wb.market_id = t.market_id AND wb.w = t.w GROUP BY t.market_id, t.w)
"""
CCF = """, rn AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY bar) AS i FROM al),
lagged AS (SELECT p.market_id, l.lag, s.signal AS x, p.price AS y FROM rn p CROSS JOIN (SELECT unnest(range(-{0}, {0} + 1)) AS lag) l JOIN rn s ON s.market_id = p.market_id AND s.i = p.i - l.lag),
cc AS (
  SELECT m.market_id, k.lag, CASE WHEN count(x) > 2 AND max(x) - min(x) > 1e-9 AND max(y) - min(y) > 1e-9 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS correlation, count(x) AS n_obs,
         CASE WHEN k.lag > 0 THEN 'signal leads' WHEN k.lag < 0 THEN 'price leads' ELSE 'contemporaneous' END AS interpretation
  FROM (SELECT DISTINCT market_id FROM rn) m CROSS JOIN (SELECT unnest(range(-{0}, {0} + 1)) AS lag) k LEFT JOIN lagged USING (market_id, lag) GROUP BY m.market_id, k.lag)
"""
RECURSIVE = PRELUDE.replace("WITH ev", "WITH RECURSIVE ev", 1)
S = PRELUDE + ACCEPTED + BARS + SIGNAL
_NORMAL_WORD = "regexp_replace(w, '[^\\p{L}\\p{N}\\p{M}'']', '', 'g')"
_NORMAL = "array_to_string(list_filter([" + _NORMAL_WORD + " FOR w IN list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'), ' '), ' '), lambda w: NOT regexp_matches(w, '^(https?://|[@$#])'))], lambda w: w <> ''), ' ')"
_MARKERS = " ".join(f"WHEN contains(lower(t), '{m}') THEN 'contains promotional marker \"{m}\"'" for m in SPAM_MARKERS)

ORACLE: dict[str, str] = {
    "signal_latest": PRELUDE + ACCEPTED + """, e AS (SELECT max(created_at) AS last FROM posts), x AS (SELECT market_id, stance, w, (epoch_us(last) - epoch_us(created_at)) / 1e6 AS age FROM contrib, e),
y AS (SELECT market_id, sum(stance * w * exp(-age * ln(2) / 21600)) / sum(w * exp(-age * ln(2) / 21600)) AS s, count(*) AS n, sum(w * exp(-age * ln(2) / 21600)) AS t FROM x WHERE age BETWEEN 0 AND 604800 GROUP BY 1)
SELECT market_id, round(s, 6) AS s_t, n AS n_posts, round(t, 6) AS weight_sum, round((s + 1) / 2, 6) AS p_hat FROM y""",
    "signal_series_fixed": S + "SELECT market_id, bar, round(s_t, 6) AS s_t, n_posts, round(weight_sum, 6) AS weight_sum, 21600.0::DOUBLE AS half_life_seconds, round((s_t + 1) / 2, 6) AS p_hat FROM sig",
    "signal_series_adaptive": PRELUDE + ACCEPTED + BARS + SIGNAL + ACTIVITY + HALF_LIFE + """SELECT a.market_id, a.bar, round(sum(stance * w * exp(-age * ln(2) / half_life_seconds)) / sum(w * exp(-age * ln(2) / half_life_seconds)), 6) AS s_t, count(*) AS n_posts,
round(sum(w * exp(-age * ln(2) / half_life_seconds)), 6) AS weight_sum, round(any_value(half_life_seconds), 6) AS half_life_seconds FROM aged a JOIN hl USING (market_id, bar) GROUP BY 1, 2""",
    "half_life_adaptive": PRELUDE + ACCEPTED + BARS + ACTIVITY + HALF_LIFE + "SELECT market_id, bar, recent, round(baseline, 6) AS baseline, round(move, 6) AS move, round(half_life_seconds, 6) AS half_life_seconds FROM hl",
    "baseline_rate_median": PRELUDE + ACCEPTED + BARS + ACTIVITY + "SELECT market_id, bar, recent, baseline FROM act",
    "post_weight": PRELUDE + "SELECT post_id, round(ln(1 + followers::DOUBLE) * (1 + engagements), 6) AS weight FROM posts",
    "p_hat_affine": PRELUDE + f"SELECT post_id, model_version, round((stance + 1) / 2, 6) AS p_hat, round({_SIG.format('(-0.1 + 2.5 * stance)')}, 6) AS p_platt, round({_LOGIT.format('(stance + 1) / 2')}, 6) AS log_odds FROM stances",
    "ensemble_disagreement": PRELUDE + "SELECT a.post_id, 'lex-1+lex-2' AS model_version, round(a.stance, 6) AS stance, round(abs(a.stance - b.stance), 6) AS disagreement, round(abs(a.stance - b.stance), 6) > 0.5 AS flagged FROM stances a JOIN stances b USING (post_id) WHERE a.model_version = 'lex-1' AND b.model_version = 'lex-2'",
    "hourly_mean_stance": PRELUDE + "SELECT market_id, date_trunc('hour', created_at) AS hour, round(avg(stance), 6) AS mean_stance, count(*) AS n FROM stances WHERE model_version = 'lex-1' GROUP BY 1, 2",
    "asof_price_tol": PRELUDE + """, q AS (SELECT market_id, ts, max(tick_id) AS tick_id FROM ticks GROUP BY 1, 2), h AS (SELECT a.post_id, a.created_at, q.ts, q.tick_id FROM posts a ASOF LEFT JOIN q ON q.market_id = a.market_id AND a.created_at >= q.ts WHERE a.filter_verdict = 'accepted')
SELECT post_id, CASE WHEN created_at - h.ts <= INTERVAL 1 HOUR THEN h.tick_id END AS tick_id, round(CASE WHEN created_at - h.ts <= INTERVAL 1 HOUR THEN m.mid END, 6) AS mid FROM h LEFT JOIN mids m ON m.tick_id = h.tick_id""",
    "asof_book": PRELUDE + """, q AS (SELECT market_id, ts, max(tick_id) AS tick_id FROM ticks WHERE source = 'book' GROUP BY 1, 2), h AS (SELECT a.post_id, q.tick_id FROM posts a ASOF LEFT JOIN q ON q.market_id = a.market_id AND a.created_at >= q.ts WHERE a.filter_verdict = 'accepted')
SELECT post_id, h.tick_id, depth_bid, depth_ask FROM h LEFT JOIN ticks m ON m.tick_id = h.tick_id""",
    "opening_book": S + """, f AS (SELECT market_id, min(t) AS t FROM sig GROUP BY 1), bks AS (SELECT * FROM ticks WHERE source = 'book'),
a AS (SELECT f.market_id, arg_max(tick_id, (ts, tick_id)) AS id FROM f JOIN bks b ON b.market_id = f.market_id AND b.ts <= f.t GROUP BY 1), z AS (SELECT market_id, arg_min(tick_id, (ts, tick_id)) AS id FROM bks GROUP BY 1)
SELECT f.market_id, coalesce(a.id, z.id) AS tick_id FROM f JOIN z USING (market_id) LEFT JOIN a USING (market_id)""",
    "asof_nearest": PRELUDE + """, d AS (SELECT a.post_id, min(abs(epoch_us(a.created_at) - epoch_us(t.ts))) / 1e6 AS s FROM posts a LEFT JOIN ticks t ON t.market_id = a.market_id AND t.ts BETWEEN a.created_at - INTERVAL 2 HOUR AND a.created_at + INTERVAL 2 HOUR WHERE a.filter_verdict = 'accepted' GROUP BY 1)
SELECT post_id, round(s, 3) AS away_s FROM d""",
    "grid_align_py": S + HOURLY + """, ps AS (SELECT market_id, min(bar) AS a, max(bar) AS b FROM lastmid GROUP BY 1), ss AS (SELECT market_id, min(bar) AS a, max(bar) AS b FROM sig GROUP BY 1),
pg AS (SELECT g.market_id, g.bar, coalesce(x.price, y.price) AS price FROM (SELECT market_id, unnest(range(a, b + 1)) AS bar FROM ps) g LEFT JOIN lastmid x USING (market_id, bar) LEFT JOIN lastmid y ON y.market_id = g.market_id AND y.bar = g.bar - 1),
sg AS (SELECT g.market_id, g.bar, coalesce(x.s_t, y.s_t) AS signal FROM (SELECT market_id, unnest(range(a, b + 1)) AS bar FROM ss) g LEFT JOIN sig x USING (market_id, bar) LEFT JOIN sig y ON y.market_id = g.market_id AND y.bar = g.bar - 1)
SELECT market_id, bar, round(price, 6) AS price, round(signal, 6) AS signal FROM pg JOIN sg USING (market_id, bar) WHERE price IS NOT NULL AND signal IS NOT NULL""",
    "grid_align_union": S + HOURLY + ALIGNED + "SELECT market_id, bar, round(price, 6) AS price, round(signal, 6) AS signal FROM al",
    "carry_forward": PRELUDE + f""", lb AS (SELECT market_id, {_BAR.format('ts')} AS bar, nullif(arg_max(coalesce(mid, -1), (ts, tick_id)), -1) AS mid FROM mids GROUP BY 1, 2), sp AS (SELECT market_id, min(bar) AS a, max(bar) AS b FROM lb GROUP BY 1),
g AS (SELECT g.market_id, g.bar, mid FROM (SELECT market_id, unnest(range(a, b + 1)) AS bar FROM sp) g LEFT JOIN lb USING (market_id, bar))
SELECT g.market_id, g.bar, round(g.mid, 6) AS mid, round(coalesce(g.mid, x.mid), 6) AS carried_1, round(coalesce(g.mid, x.mid, y.mid), 6) AS carried_2 FROM g LEFT JOIN g x ON x.market_id = g.market_id AND x.bar = g.bar - 1 LEFT JOIN g y ON y.market_id = g.market_id AND y.bar = g.bar - 2""",
    "bar_last": PRELUDE + f"SELECT market_id, {_BAR.format('ts')} AS bar, round(nullif(arg_max(coalesce(mid, -1), (ts, tick_id)), -1), 6) AS mid FROM mids GROUP BY 1, 2",
    "hourly_pairs": S + HOURLY + "SELECT market_id, bar, round(s_t, 6) AS s_t, round(price, 6) AS price FROM sig JOIN lastmid USING (market_id, bar)",
    "ccf_lags": S + HOURLY + ALIGNED + CCF.replace("{0}", "12") + "SELECT market_id, lag, round(correlation, 6) AS correlation, n_obs, interpretation FROM cc",
    "ccf_strongest": S + HOURLY + ALIGNED + CCF.replace("{0}", "6") + ", r AS (SELECT market_id, lag, round(correlation, 6) AS correlation, n_obs, interpretation FROM cc WHERE correlation IS NOT NULL) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY abs(correlation) DESC, lag) = 1",
    "first_diff_corr": S + HOURLY + ALIGNED + """, dd AS (SELECT market_id, signal - lag(signal) OVER w AS x, price - lag(price) OVER w AS y FROM al WINDOW w AS (PARTITION BY market_id ORDER BY bar))
SELECT market_id, count(*) AS n, round(CASE WHEN count(*) >= 3 AND stddev_pop(x) * stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END, 6) AS correlation FROM dd GROUP BY 1""",
    "bh_adjust": """WITH t AS (SELECT o_orderkey AS test_id, o_orderpriority AS run_id, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice / 1000000, 6) END AS p_value FROM orders),
r AS (SELECT *, p_value * count(p_value) OVER (PARTITION BY run_id) / row_number() OVER (PARTITION BY run_id, p_value IS NULL ORDER BY p_value, test_id) AS q FROM t),
a AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1.0, min(q) OVER (PARTITION BY run_id, p_value IS NULL ORDER BY p_value DESC, test_id DESC ROWS UNBOUNDED PRECEDING)) END AS adj FROM r)
SELECT test_id, run_id, p_value, round(adj, 6) AS p_value_adj, coalesce(adj < 0.05, false) AS significant FROM a""",
    "brier_by_market": S + HOURLY + POINTS + "SELECT p.market_id, count(*) AS n_obs, round(avg(pow(p_hat - resolved_outcome, 2)), 6) AS brier_signal, round(avg(pow(price - resolved_outcome, 2)), 6) AS brier_market FROM pts p JOIN markets m USING (market_id) WHERE status = 'settled' AND price IS NOT NULL GROUP BY 1",
    "bss_by_market": S + HOURLY + POINTS + ", b AS (SELECT p.market_id, 1 - avg(pow(p_hat - resolved_outcome, 2)) / avg(pow(price - resolved_outcome, 2)) AS bss FROM pts p JOIN markets m USING (market_id) WHERE status = 'settled' AND price IS NOT NULL GROUP BY 1) SELECT market_id, round(bss, 6) AS bss, bss > 0 AS beats_market, CASE WHEN bss > 0 THEN 'beats the market' WHEN bss < 0 THEN 'worse than the market' ELSE 'equal to the market' END AS verdict FROM b",
    "calibration_curve": RATED + "SELECT bin, round(avg(p), 6) AS mean_forecast, round(avg(outcome), 6) AS observed, count(*) AS n FROM (SELECT *, (SELECT min(k) FROM range(1, 11) x(k) WHERE rated.p <= k / 10.0::DOUBLE)::INTEGER AS bin FROM rated) GROUP BY 1",
    "score_freeze": S + f""", h AS (SELECT market_id, {_BAR.format('ts')} AS bar, unnest(arg_max(struct_pack(yes_price := yes_price, yes_bid := yes_bid, yes_ask := yes_ask), (ts, tick_id))) FROM ticks GROUP BY 1, 2),
pr AS (SELECT s.market_id, (s_t + 1) / 2 AS p_hat, coalesce(yes_price, (yes_bid + yes_ask) / 2) AS price, resolved_outcome AS outcome FROM sig s JOIN h USING (market_id, bar) JOIN markets m USING (market_id) WHERE status = 'settled'),
sc AS (SELECT market_id, outcome, count(*) AS n_obs, avg(pow(p_hat - outcome, 2)) AS bs, avg(pow(price - outcome, 2)) AS bm FROM pr WHERE price IS NOT NULL GROUP BY 1, 2), sp AS (SELECT market_id, min(bar) AS window_start, max(bar) AS window_end FROM sig GROUP BY 1)
SELECT market_id, outcome, n_obs, round(bs, 6) AS brier_signal, round(bm, 6) AS brier_market, round(1 - bs / bm, 6) AS bss, 1 - bs / bm > 0 AS beats_market, window_start, window_end, 'affine' AS calibration FROM sc JOIN sp USING (market_id)""",
    "log_loss": RATED + ", c AS (SELECT *, least(1 - 1e-6, greatest(1e-6, p)) AS q FROM rated) SELECT lang, round(avg(-(outcome * ln(q) + (1 - outcome) * ln(1 - q))), 6) AS log_loss, sum(outcome)::BIGINT AS n_yes, sum(1 - outcome)::BIGINT AS n_no FROM c GROUP BY 1",
    "lmsr_cost_prices": f"""WITH q AS (SELECT p_partkey AS id, p_retailprice / 10 AS a, p_size * 3.0::DOUBLE AS b, p_size - 30.0::DOUBLE AS c, p_size + 5.0::DOUBLE AS l FROM part), m AS (SELECT *, greatest(a, b, c) AS t FROM q), e AS (SELECT *, exp((a - t) / l) AS ea, exp((b - t) / l) AS eb, exp((c - t) / l) AS ec FROM m)
SELECT id, round(t + l * ln(ea + eb + ec), 6) AS cost, round(ea / (ea + eb + ec), 6) AS p0, round(eb / (ea + eb + ec), 6) AS p1, round(ec / (ea + eb + ec), 6) AS p2, round({_SIG.format('((a - b) / l)')}, 6) AS price_yes, round(l * ln(3), 6) AS subsidy FROM e""",
    "lmsr_trade_cost": f"""WITH q AS (SELECT p_partkey AS id, p_retailprice / 10 AS a, p_size * 3.0::DOUBLE AS b, p_size - 30.0::DOUBLE AS c, p_size + 5.0::DOUBLE AS l FROM part), m AS (SELECT *, greatest(a, b, c) AS t, greatest(a + 1, b - 2, c + 0.5) AS u FROM q)
SELECT id, round((u + l * ln(exp((a + 1 - u) / l) + exp((b - 2 - u) / l) + exp((c + 0.5 - u) / l))) - (t + l * ln(exp((a - t) / l) + exp((b - t) / l) + exp((c - t) / l))), 6) AS cost, round(l * (0 - {_LOGIT.format('(l / 60.0::DOUBLE)')}), 6) AS shares FROM m""",
    "lmsr_b_from_depth": PRELUDE + f"SELECT tick_id, round({_b('nullif(depth_bid, 0)')}, 4) AS b_bid, round({_b('nullif(depth_ask, 0)')}, 4) AS b_ask, round({_b(_MEAN)}, 4) AS b_mean FROM ticks",
    "lmsr_path": RECURSIVE + ACCEPTED + BARS + SIGNAL + BOOKS + f"SELECT market_id, ts, round({_SIG.format('level')}, 6) AS sim_price, round(s_t, 6) AS signal FROM path",
    "lmsr_state": RECURSIVE + ACCEPTED + BARS + SIGNAL + BOOKS + "SELECT market_id, ts, round(b, 3) AS b, round(b * level, 3) AS q_yes, 0.0::DOUBLE AS q_no, round(b * (greatest(level, 0) + ln(1 + exp(-abs(level)))), 3) AS cost, round(b * gap, 3) AS trade_size FROM path",
    "walk_forward": S + HOURLY + ALIGNED + WALK + "SELECT market_id, \"window\", train_start, test_start, round(b, 3) AS b, responsiveness::DOUBLE AS responsiveness, round(mse, 6) AS mse, round(mse_baseline, 6) AS mse_baseline, round(correlation, 6) AS correlation, n_test FROM wf",
    "backtest_summary": S + HOURLY + ALIGNED + WALK + ", z AS (SELECT market_id, count(*) AS n_windows, avg(mse) AS a, avg(mse_baseline) AS c, count(*) FILTER (WHERE mse < mse_baseline) AS beating, min(b) AS lo, max(b) AS hi, avg(b) AS mean, stddev_pop(b) / avg(b) AS cv FROM wf GROUP BY 1) SELECT market_id, n_windows, round(a, 6) AS mean_mse, round(c, 6) AS mean_baseline_mse, beating AS beating_baseline, round(lo, 3) AS b_min, round(hi, 3) AS b_max, round(mean, 3) AS b_mean, round(cv, 6) AS b_cv, cv > 0.5 AS b_unstable, 2 * beating <= n_windows AS no_skill FROM z",
    "unscored_posts_anti": PRELUDE + "SELECT post_id, market_id, created_at FROM posts p WHERE NOT EXISTS (SELECT 1 FROM stances s WHERE s.post_id = p.post_id AND s.market_id = p.market_id AND s.created_at = p.created_at AND s.model_version = 'lex-2')",
    "scored_posts_join": PRELUDE + "SELECT market_id, created_at, round(stance, 6) AS stance, followers, engagements FROM posts p JOIN stances s USING (post_id, market_id, created_at) WHERE model_version = 'lex-1' AND filter_verdict = 'accepted'",
    "resolved_pairs_distinct_on": S + "SELECT DISTINCT ON (s.market_id) s.market_id, round(s_t, 6) AS s_t, resolved_outcome AS outcome FROM sig s JOIN markets m USING (market_id) WHERE status = 'settled' AND t <= close_time ORDER BY s.market_id, t DESC",
    "latest_price": PRELUDE + "SELECT DISTINCT ON (market_id) market_id, tick_id, ts, source, round(yes_price, 6) AS yes_price, round(yes_bid, 6) AS yes_bid, round(yes_ask, 6) AS yes_ask, depth_bid, depth_ask FROM ticks ORDER BY market_id, ts DESC, tick_id DESC",
    "latest_run_granger": "WITH r AS (SELECT 'run-' || year(o_orderdate) AS run_id, o_orderkey AS test_id, o_orderdate AS computed_at, CAST(o_orderkey % 9973 AS DOUBLE) / 10000 AS p_value, CAST(o_orderkey % 997 AS DOUBLE) / 1000 AS p_value_adj FROM orders) SELECT * FROM r WHERE run_id = (SELECT run_id FROM r ORDER BY computed_at DESC LIMIT 1)",
    "verdict_counts": PRELUDE + "SELECT filter_verdict AS verdict, count(*) AS n FROM posts GROUP BY 1",
    "table_stats": PRELUDE + "SELECT 'posts' AS table_name, count(*) AS n FROM posts UNION ALL SELECT 'stances', count(*) FROM stances UNION ALL SELECT 'ticks', count(*) FROM ticks UNION ALL SELECT 'markets', count(*) FROM markets",
    "resolution_queue": PRELUDE + "SELECT market_id, status, close_time FROM markets WHERE tracked AND status <> 'settled' AND close_time <= (SELECT max(close_time) FROM markets)",
    "tracked_open": PRELUDE + "SELECT market_id, status, tracked FROM markets WHERE tracked AND status <> 'settled'",
    "newest_fills": S + HOURLY + POINTS + FILLS + "SELECT market_id, ts, action, round(quantity, 6) AS quantity FROM fills ORDER BY ts DESC, market_id LIMIT 100",
    "top_orders_per_customer": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3",
    "market_queries_pivot": "SELECT p_brand AS market_id, " + ", ".join(f"coalesce(string_agg(DISTINCT p_type, '|' ORDER BY p_type) FILTER (WHERE p_size % 4 = {k}), '') AS {n}" for k, n in enumerate(("keywords", "hashtags", "entities", "excludes"))) + " FROM part GROUP BY 1",
    "query_string": """WITH t AS (SELECT p_partkey, p_brand, list_concat(list_append(string_split(p_type, ' '), 'rate cut'), string_split(p_name, ' ')) AS a FROM part), u AS (SELECT *, list_filter(a, lambda x, i: list_position(a, x) = i) AS d FROM t)
SELECT p_partkey, '(' || array_to_string([CASE WHEN contains(x, ' ') THEN '"' || x || '"' ELSE x END FOR x IN d], ' OR ') || ') -' || CASE WHEN contains(p_brand, ' ') THEN '"' || p_brand || '"' ELSE p_brand END || ' -is:retweet lang:en' AS q FROM u""",
    "keyed_merge": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE 'X' END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 1 OR (o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0) THEN o_totalprice WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 END AS o_totalprice FROM orders",
    "insert_missing": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) END AS c_name FROM customer",
    "purge_before": PRELUDE + "SELECT count(*) FILTER (WHERE ts >= c) AS kept, count(*) FILTER (WHERE ts < c) AS purged FROM ticks, (SELECT max(ts) - INTERVAL 10 DAY AS c FROM ticks)",
    "read_budget_fold": """WITH RECURSIVE r AS (SELECT event_id AS request_id, CAST(ts AS DATE) AS day, event_type AS service, CASE WHEN event_id % 20 = 0 THEN -(user_id % 7) ELSE user_id % 40 END AS reads, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY event_id) AS i FROM events),
f AS (SELECT r.*, r.reads <= 0 OR r.reads <= 200 AS granted, CASE WHEN r.reads <= 200 THEN greatest(0, r.reads) ELSE 0 END AS used FROM r WHERE i = 1
  UNION ALL SELECT r.*, r.reads <= 0 OR f.used + r.reads <= 200, CASE WHEN r.reads <= 0 OR f.used + r.reads <= 200 THEN greatest(0, f.used + r.reads) ELSE f.used END FROM f JOIN r ON r.day = f.day AND r.service = f.service AND r.i = f.i + 1)
SELECT day, service, request_id, reads, granted, used AS reads_used, round(used * 0.005::DOUBLE, 6) AS cost_usd FROM f""",
    "target_position": S + HOURLY + POINTS + ", e AS (SELECT market_id, bar, round(p_hat, 6) - round(price, 6) AS e FROM pts) SELECT market_id, bar, round(CASE WHEN abs(e) < 0.05 THEN 0 ELSE greatest(-100, least(100, e * 100)) END, 6) AS target FROM e",
    "rebalance_deltas": S + HOURLY + POINTS + FILLS + "SELECT market_id, ts, strategy, side, action, round(quantity, 6) AS quantity, round(price, 6) AS price, round(cash_flow + 1e-9, 6) AS cash_flow, round(delta, 6) AS delta FROM fills",
    "positions_cumulative": S + HOURLY + POINTS + FILLS + "SELECT market_id, ts, round(sum(delta) OVER w, 6) AS qty_yes, round(sum(cash_flow) OVER w, 6) AS cash FROM fills WINDOW w AS (PARTITION BY market_id ORDER BY ts ROWS UNBOUNDED PRECEDING)",
    "mark_to_market": S + HOURLY + POINTS + FILLS + "SELECT market_id, strategy, round(qty_yes, 6) AS qty_yes, qty_no, round(cash, 6) AS cash, realized_pnl, settled, round(mark, 6) AS mark, round(value, 6) AS value, round(unrealized, 6) AS unrealized, round(total, 6) AS total FROM marked",
    "portfolio": S + HOURLY + POINTS + FILLS + "SELECT count(*) AS n_positions, round(sum(realized_pnl), 6) AS realized, round(sum(unrealized), 6) AS unrealized, round(sum(total), 6) AS total FROM marked WHERE qty_yes <> 0",
    "settlement": S + HOURLY + POINTS + FILLS + ", z AS (SELECT p.*, m.status = 'settled' AND qty_yes <> 0 AS done, qty_yes * coalesce(resolved_outcome, 0) AS pay FROM pos p JOIN markets m USING (market_id)) SELECT market_id, strategy, round(CASE WHEN done THEN 0 ELSE qty_yes END, 6) AS qty_yes, qty_no, round(CASE WHEN done THEN cash + pay ELSE cash END, 6) AS cash, round(CASE WHEN done THEN pay ELSE 0 END, 6) AS realized_pnl, done AS settled FROM z",
    "settlement_fills": S + HOURLY + POINTS + FILLS + "SELECT market_id, strategy, 'yes' AS side, 'settle' AS action, round(abs(qty_yes), 6) AS quantity, resolved_outcome::DOUBLE AS price, round(qty_yes * resolved_outcome, 6) AS cash_flow FROM pos JOIN markets m USING (market_id) WHERE status = 'settled' AND qty_yes <> 0",
    "text_normalize": f"SELECT doc_id, md5({_NORMAL}) AS digest FROM documents",
    "shingles": f"WITH n AS (SELECT doc_id, {_NORMAL} AS t FROM documents), w AS (SELECT doc_id, t, string_split(t, ' ') AS ws FROM n) SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 WHEN len(ws) < 3 THEN 1 ELSE len(list_distinct([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, CAST(len(ws) - 1 AS BIGINT))])) END AS BIGINT) AS n_shingles FROM w",
    "lines_jaccard_pairs": """WITH x AS (SELECT doc_id, string_split(text, chr(10))[1] AS head, list_distinct(list_filter(string_split(translate(lower(text), chr(10), ' '), ' '), lambda w: w <> '')) AS w FROM documents),
f AS (SELECT head, min(doc_id) AS doc_id, arg_min(w, doc_id) AS w FROM x WHERE len(w) > 0 GROUP BY head)
SELECT f.doc_id AS left_id, x.doc_id AS right_id, round(len(list_intersect(f.w, x.w)) / (len(f.w) + len(x.w) - len(list_intersect(f.w, x.w)))::DOUBLE, 6) AS jaccard FROM x JOIN f USING (head) WHERE x.doc_id > f.doc_id AND len(x.w) > 0""",
    "symbol_ratio": "SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 1.0 ELSE length(regexp_replace(text, '[\\p{L}\\p{N}\\p{Z}\\s]', '', 'g')) / length(text)::DOUBLE END, 6) AS ratio FROM documents",
    "heuristic_verdict": f"""WITH b AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 11 = 0 THEN 'Big GIVEAWAY now: ' || text ELSE text END, '^\\s+|\\s+$', '', 'g') AS t, n_chars % 90 AS followers, doc_id % 30 AS age FROM documents),
s AS (SELECT *, CASE WHEN length(t) = 0 THEN 1.0 ELSE length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\p{{Z}}\\s]', '', 'g')) / length(t)::DOUBLE END AS r FROM b),
v AS (SELECT doc_id, CASE WHEN length(t) < 12 THEN 'text is ' || length(t) || ' chars, below the 12-char floor' WHEN r > 0.6 THEN printf('symbol ratio %.2f exceeds 0.60', r) {_MARKERS} END AS low, CASE WHEN age < 14 AND followers < 50 THEN 'account is ' || age || 'd old with ' || followers || ' followers (thresholds: 14d, 50)' END AS bot FROM s)
SELECT doc_id, CASE WHEN low IS NOT NULL THEN 'low_quality' WHEN bot IS NOT NULL THEN 'bot' END AS verdict, coalesce(low, bot) AS reason FROM v""",
    "parse_money": "WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS DOUBLE) END AS price FROM part) SELECT p_partkey, price, coalesce(price, 0.0) AS price_or_zero FROM v",
    "lsh_retrieval": "SELECT DISTINCT p_size, round(1 - pow(1 - pow(p_size / 50.0::DOUBLE, 8), 16), 6) AS p_16x8, round(1 - pow(1 - pow(p_size / 50.0::DOUBLE, 16), 8), 6) AS p_8x16 FROM part",
    "running_value": "SELECT event_id, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS running, round(value - lag(value) OVER w, 6) AS step, ts IS DISTINCT FROM lag(ts) OVER w AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
}
