"""Composite queries as SQL that reads alike in Spark and DuckDB.

``{bars}``, ``{daily}`` and ``{ticks}`` stand for hourly bars, daily bars and
ticks; names of tables stand for themselves. Every fraction is rounded with a
small offset, so that exact halves fall alike.
"""

from __future__ import annotations

from collections.abc import Callable

P = "PARTITION BY symbol ORDER BY ts"


def r(x: str, places: int = 6) -> str:
    return f"round({x} + 3.7e-10, {places})"


def rows(n: int, skip: int = 0) -> str:
    return f"OVER ({P} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


SHARED: dict[str, str | Callable[[str], str]] = {}

# Relative strength: the weighted mean of normalised distances between the price and three averages.
DAYS, PER_DAY, MAS, ATR_N = 5, 20, (10, 20, 30), 14
_N = DAYS * PER_DAY
RS_CTES = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM {{bars}}),
tail AS (SELECT symbol, ts, high, low, close, count(*) OVER (PARTITION BY symbol) - back AS i FROM numbered WHERE back <= {_N + MAS[2] + 1}),
ranged AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({P})), 0), coalesce(abs(low - lag(close) OVER ({P})), 0)) AS tr FROM tail),
means AS (SELECT symbol, i, close, avg(close) {rows(MAS[0])} AS a, avg(close) {rows(MAS[1])} AS b, avg(close) {rows(MAS[2])} AS c, avg(tr) {rows(ATR_N)} AS atr FROM ranged),
scored AS (SELECT symbol, ((close - a) + (close - b) + (close - c) + (a - b) + (a - c) + (b - c)) / nullif(atr, 0) AS n, power(4, CAST(i - {MAS[2]} AS DOUBLE) / {_N}) AS w FROM means WHERE i >= {MAS[2] + 1} AND atr > 0),
strength AS (SELECT symbol, sum(n * w) / nullif(sum(w), 0) AS rs_score, count(*) AS n_scored FROM scored GROUP BY symbol HAVING count(*) = {_N})"""
SHARED["rs_score"] = f"WITH {RS_CTES} SELECT symbol, {r('rs_score', 4)} AS rs_score, n_scored FROM strength"

SHARED["breadth_dma"] = f"""
WITH d AS (SELECT symbol, date_trunc('day', ts) AS ts, max_by(close, ts) AS close FROM {{bars}} GROUP BY symbol, date_trunc('day', ts)),
m AS (SELECT symbol, ts, close, avg(close) {rows(5)} AS dma, lag(close) OVER ({P}) AS before FROM d)
SELECT ts, count(*) AS n, count(CASE WHEN close > dma THEN 1 END) AS above, count(CASE WHEN close > before THEN 1 END) AS advances,
  count(CASE WHEN close < before THEN 1 END) AS declines, {r('100 * CAST(sum(CASE WHEN close > dma THEN 1 ELSE 0 END) AS DOUBLE) / count(*)')} AS pct_above FROM m GROUP BY ts"""

# A morning screen: gap, early return and volume, relative strength above the median, directional movement rising.
_SCREEN_DAY = """day_bars AS (SELECT symbol, date_trunc('day', ts) AS ts, min_by(open, ts) AS o, max_by(close, ts) AS c, max(high) AS h, min(low) AS l, sum(volume) AS v,
  sum(CASE WHEN hour(ts) < 10 THEN volume ELSE 0 END) AS v_early, max_by(CASE WHEN hour(ts) < 10 THEN close END, CASE WHEN hour(ts) < 10 THEN ts END) AS c_early,
  max(CASE WHEN hour(ts) < 10 THEN high END) AS h_early, min(CASE WHEN hour(ts) < 10 THEN low END) AS l_early FROM {bars} GROUP BY symbol, date_trunc('day', ts))"""
SHARED["screener"] = f"""
WITH {RS_CTES}, {_SCREEN_DAY},
feat AS (SELECT symbol, ts, o, c, 100 * (o / nullif(lag(c) OVER ({P}), 0) - 1) AS gap, 100 * (c_early / nullif(o, 0) - 1) AS early, (c_early - l_early) / nullif(h_early - l_early, 0) AS place,
  v_early / nullif(avg(v_early) {rows(14, 1)}, 0) AS times, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM day_bars),
early_ones AS (SELECT *, lag(early) OVER ({P}) AS early_before FROM feat),
flow AS (SELECT symbol, ts, sum(CASE WHEN c > before THEN v WHEN c < before THEN -v ELSE 0 END) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv FROM (SELECT *, lag(c) OVER ({P}) AS before FROM day_bars) x),
flow_ok AS (SELECT symbol, ts, obv > avg(obv) {rows(20)} AND obv > lag(obv, 5) OVER ({P}) AS rising FROM flow),
moves AS (SELECT symbol, ts, c, h - lag(h) OVER ({P}) AS up, lag(l) OVER ({P}) - l AS dn, greatest(h - l, coalesce(abs(h - lag(c) OVER ({P})), 0), coalesce(abs(l - lag(c) OVER ({P})), 0)) AS tr FROM day_bars),
past AS (SELECT * FROM moves WHERE ts < (SELECT max(ts) FROM day_bars)),
smooth AS (SELECT symbol, ts, c, avg(CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END) {rows(7)} AS p, avg(CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END) {rows(7)} AS m, avg(tr) {rows(7)} AS atr FROM past),
dx AS (SELECT symbol, ts, c, atr, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM smooth),
adx AS (SELECT symbol, ts, c, atr, avg(dx) {rows(7)} AS adx FROM dx),
last_adx AS (SELECT *, lag(adx) OVER ({P}) AS adx_before, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM adx)
SELECT e.symbol, e.ts, {r('e.gap', 3)} AS gap_pct, {r('e.early', 3)} AS early_pct, {r('e.times', 2)} AS times, {r('s.rs_score', 3)} AS rs_score, {r('a.adx', 3)} AS adx, {r('100 * a.atr / nullif(a.c, 0)', 2)} AS atr_pct,
  coalesce(s.rs_score > (SELECT median(rs_score) FROM strength), false) AS strong, coalesce(a.adx > a.adx_before, false) AS rising, coalesce(f.rising, false) AS flow_ok
FROM early_ones e LEFT JOIN strength s ON e.symbol = s.symbol LEFT JOIN flow_ok f ON f.symbol = e.symbol AND f.ts = e.ts LEFT JOIN last_adx a ON a.symbol = e.symbol AND a.back = 1
WHERE e.back = 1 AND e.o >= 1"""

# Profiles: each bar's volume is shared equally by the price steps that it spans.
_STEP = 10


def profile(d: str) -> str:
    each = f"explode(sequence(CAST(floor(low / {_STEP} + 0.5) AS BIGINT), CAST(floor(high / {_STEP} + 0.5) AS BIGINT)))" if d == "spark" else f"unnest(range(CAST(floor(low / {_STEP} + 0.5) AS BIGINT), CAST(floor(high / {_STEP} + 0.5) AS BIGINT) + 1))"
    return f"""WITH spread AS (SELECT symbol, {each} AS step, volume / (floor(high / {_STEP} + 0.5) - floor(low / {_STEP} + 0.5) + 1) AS v FROM {{bars}}),
levels AS (SELECT symbol, step, sum(v) AS v FROM spread GROUP BY symbol, step)"""


SHARED["profile_volume"] = lambda d: f"{profile(d)} SELECT symbol, step * {_STEP} AS price, {r('v')} AS volume FROM levels"
SHARED["profile_poc"] = lambda d: (
    f"{profile(d)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(v, 6) DESC, step DESC) AS k, sum(v) OVER (PARTITION BY symbol) AS total FROM levels) "
    f"SELECT symbol, step * {_STEP} AS poc, {r('v')} AS volume, {r('total')} AS total FROM ranked WHERE k = 1"
)
SHARED["profile_low_nodes"] = lambda d: (
    f"{profile(d)}, near AS (SELECT *, lag(v) OVER (PARTITION BY symbol ORDER BY step) AS below, lead(v) OVER (PARTITION BY symbol ORDER BY step) AS above FROM levels) "
    f"SELECT symbol, step * {_STEP} AS price, {r('v')} AS volume FROM near WHERE v < below - 1e-9 AND v < above - 1e-9"
)
SHARED["profile_footprint"] = f"""
WITH side AS (SELECT symbol, date_trunc('hour', ts) AS ts, CAST(floor(price / {_STEP} + 0.5) AS BIGINT) AS step, volume, event_id % 2 = 0 AS bought FROM {{ticks}})
SELECT symbol, ts, step * {_STEP} AS price, sum(CASE WHEN bought THEN volume ELSE 0 END) AS ask_volume, sum(CASE WHEN bought THEN 0 ELSE volume END) AS bid_volume, sum(CASE WHEN bought THEN volume ELSE -volume END) AS delta FROM side GROUP BY symbol, ts, step"""
SHARED["profile_time_price"] = lambda d: (
    f"""WITH touched AS (SELECT symbol, date_trunc('day', ts) AS session, ts, {'explode(sequence(' if d == 'spark' else 'unnest(range('}CAST(floor(low / {_STEP} + 0.5) AS BIGINT), CAST(floor(high / {_STEP} + 0.5) AS BIGINT){'' if d == 'spark' else ' + 1'})) AS step FROM {{bars}})
SELECT symbol, session, step * {_STEP} AS price, count(DISTINCT ts) AS periods FROM touched GROUP BY symbol, session, step"""
)

# Seasonality of month-end closes
_MONTHS = "months AS (SELECT symbol, date_trunc('month', ts) AS ts, max_by(close, ts) AS close FROM {daily} GROUP BY symbol, date_trunc('month', ts)), returns AS (SELECT symbol, ts, 100 * (close / nullif(lag(close) OVER (" + P + "), 0) - 1) AS ret FROM months)"
SHARED["seasonality_matrix"] = f"WITH {_MONTHS} SELECT symbol, year(ts) AS year, " + ", ".join(f"{r(f'max(CASE WHEN month(ts) = {m} THEN ret END)', 4)} AS m{m}" for m in range(1, 13)) + " FROM returns GROUP BY symbol, year(ts)"
SHARED["seasonality_stats"] = f"WITH {_MONTHS} SELECT symbol, month(ts) AS month, {r('avg(ret)', 4)} AS mean_ret, {r('stddev_samp(ret)', 4)} AS sd_ret, {r('100 * CAST(count(CASE WHEN ret >= 0 THEN 1 END) AS DOUBLE) / nullif(count(ret), 0)', 4)} AS pct_positive FROM returns WHERE ret IS NOT NULL GROUP BY symbol, month(ts)"

# Gaps: expected hours without a bar, as runs
def _grid(d: str) -> str:
    if d == "spark":
        return "SELECT symbol, explode(sequence(lo, hi, interval 1 hour)) AS ts FROM span"
    return "SELECT symbol, unnest(generate_series(lo, hi, interval 1 hour)) AS ts FROM span"


_MISSING = "WITH span AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM {bars} GROUP BY symbol), grid AS (%s), missing AS (SELECT g.symbol, g.ts FROM grid g LEFT JOIN {bars} b ON g.symbol = b.symbol AND g.ts = b.ts WHERE b.ts IS NULL)"
SHARED["gap_missing"] = lambda d: f"{_MISSING % _grid(d)} SELECT symbol, ts FROM missing"
SHARED["gap_runs"] = lambda d: (
    f"{_MISSING % _grid(d)}, marked AS (SELECT symbol, ts, CASE WHEN lag(ts) OVER ({P}) + interval 1 hour = ts THEN 0 ELSE 1 END AS starts FROM missing), "
    f"runs AS (SELECT symbol, ts, sum(starts) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM marked) "
    "SELECT symbol, min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS n_missing FROM runs GROUP BY symbol, run"
)
SHARED["coverage_complete"] = lambda d: f"{_MISSING % _grid(d)} SELECT s.symbol, count(m.ts) AS n_missing, count(m.ts) = 0 AS complete FROM span s LEFT JOIN missing m ON s.symbol = m.symbol GROUP BY s.symbol"
SHARED["interval_merge"] = """
WITH spans AS (SELECT o_custkey AS k, o_orderdate AS lo, o_orderdate + interval 20 day AS hi FROM orders),
far AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spans),
marked AS (SELECT *, sum(CASE WHEN reached >= lo THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM far)
SELECT k, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM marked GROUP BY k, run"""

# Joins over the dimensions
SHARED["upsert_merge"] = "SELECT o_orderkey, o_totalprice, 'old' AS origin FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_orderkey = o.o_orderkey AND n.o_orderkey % 3 = 0) UNION ALL SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 'new' AS origin FROM orders WHERE o_orderkey % 3 = 0"
SHARED["universe_filter"] = "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"
SHARED["symbol_resolve"] = """SELECT c.c_custkey, CASE WHEN s.s_suppkey IS NOT NULL AND s.s_nationkey = c.c_nationkey THEN 'ok' WHEN s.s_suppkey IS NOT NULL THEN 'quarantine' WHEN n.n_nationkey IS NOT NULL AND n.n_nationkey % 2 = 0 THEN 'rename' ELSE 'quarantine' END AS status
FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"""
SHARED["delisted_filter"] = "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)"
_ACTIONS = "actions AS (SELECT DISTINCT l_returnflag AS symbol, CAST(2 AS DOUBLE) AS ratio, TIMESTAMP '1995-06-01 00:00:00' AS ex_ts FROM lineitem WHERE l_returnflag <> 'N')"
SHARED["corp_action_adjust"] = f"WITH {_ACTIONS} SELECT b.symbol, b.ts, {r('b.close / coalesce(a.ratio, 1)')} AS adjusted FROM {{daily}} b LEFT JOIN actions a ON a.symbol = b.symbol"
SHARED["corp_action_adjust_asof"] = f"WITH {_ACTIONS} SELECT b.symbol, b.ts, {r('b.close / coalesce(a.ratio, 1)')} AS adjusted FROM {{daily}} b LEFT JOIN actions a ON a.symbol = b.symbol AND b.ts < a.ex_ts"

# Signals
_CROSS = "CASE WHEN lag({a}) OVER (" + P + ") <= lag({b}) OVER (" + P + ") AND {a} > {b} THEN 'BUY' WHEN lag({a}) OVER (" + P + ") >= lag({b}) OVER (" + P + ") AND {a} < {b} THEN 'SELL' END"
SMA_CROSS = f"WITH m AS (SELECT *, CASE WHEN count(*) {rows(5)} = 5 THEN avg(close) {rows(5)} END AS fast, CASE WHEN count(*) {rows(20)} = 20 THEN avg(close) {rows(20)} END AS slow FROM {{bars}}), sig AS (SELECT *, {_CROSS.format(a='fast', b='slow')} AS side, lead(open) OVER ({P}) AS next_open, lead(ts) OVER ({P}) AS next_ts FROM m)"
SHARED["signals_sma_cross"] = f"{SMA_CROSS} SELECT symbol, ts, side FROM sig WHERE side IS NOT NULL"
SHARED["signals_bollinger_breakout"] = f"WITH m AS (SELECT *, avg(close) {rows(20)} AS m, stddev_pop(close) {rows(20)} AS s, count(*) {rows(20)} AS n FROM {{bars}}) SELECT symbol, ts, CASE WHEN close > m + 2 * s THEN 'BUY' ELSE 'SELL' END AS side FROM m WHERE n = 20 AND (close > m + 2 * s + 1e-9 OR close < m - 2 * s - 1e-9)"
SHARED["signals_mean_reversion"] = f"""
WITH d AS (SELECT *, close - lag(close) OVER ({P}) AS d FROM {{bars}}), m AS (SELECT *, avg(greatest(d, 0)) {rows(14)} AS u, avg(greatest(-d, 0)) {rows(14)} AS n, count(d) {rows(14)} AS k FROM d),
z AS (SELECT *, CASE WHEN k < 14 THEN 0 WHEN 100 * u / nullif(u + n, 0) > 70 THEN 1 WHEN 100 * u / nullif(u + n, 0) < 30 THEN -1 ELSE 0 END AS zone FROM m),
e AS (SELECT *, lag(zone) OVER ({P}) AS before FROM z) SELECT symbol, ts, CASE WHEN zone = 1 THEN 'SELL' ELSE 'BUY' END AS side FROM e WHERE zone <> 0 AND zone <> before"""
SHARED["signals_buy_and_hold"] = f"SELECT symbol, ts, 'BUY' AS side FROM (SELECT *, row_number() OVER ({P}) AS rn FROM {{bars}}) x WHERE rn = 1"

# Fills, fees and accounts
SHARED["fills_next_open"] = f"{SMA_CROSS} SELECT symbol, ts AS signal_ts, next_ts AS fill_ts, side, next_open AS price, next_open IS NULL AS unfilled FROM sig WHERE side IS NOT NULL"
_FILLS = "fills AS (SELECT l_suppkey AS symbol, l_orderkey, l_linenumber, l_shipdate AS ts, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS sgn, l_quantity AS qty, l_extendedprice / l_quantity AS price FROM lineitem)"
SHARED["position_running"] = f"WITH {_FILLS} SELECT symbol, l_orderkey, l_linenumber, sum(sgn * qty) OVER w AS position, {r('sum(-sgn * qty * price) OVER w', 4)} AS cash FROM fills WINDOW w AS (PARTITION BY symbol ORDER BY ts, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SHARED["portfolio_totals"] = f"WITH {_FILLS}, p AS (SELECT symbol, sum(sgn * qty) AS position, max_by(price, ts) AS mark FROM (SELECT symbol, sgn, qty, max(price) AS price, ts FROM fills GROUP BY symbol, sgn, qty, ts) x GROUP BY symbol) SELECT {r('sum(abs(position))', 2)} AS gross, {r('sum(position)', 2)} AS net, count(*) AS n FROM p"

# Statistics of returns
_RETURNS = f"ret AS (SELECT symbol, ts, close, close / nullif(lag(close) OVER ({P}), 0) - 1 AS x, ln(close / nullif(lag(close) OVER ({P}), 0)) AS lx FROM {{daily}})"
SHARED["sharpe"] = f"WITH {_RETURNS} SELECT symbol, {r('avg(x) / nullif(stddev_samp(x), 0) * sqrt(252)')} AS sharpe FROM ret GROUP BY symbol"
SHARED["sortino"] = f"WITH {_RETURNS} SELECT symbol, {r('avg(x) / nullif(sqrt(sum(CASE WHEN x < 0 THEN x * x ELSE 0 END) / count(x)), 0) * sqrt(252)')} AS sortino, {r('avg(x) / nullif(sqrt(sum(CASE WHEN x < 0 THEN x * x ELSE 0 END) / nullif(count(CASE WHEN x < 0 THEN 1 END), 0)), 0) * sqrt(252)')} AS sortino_downside FROM ret GROUP BY symbol"
SHARED["realized_vol"] = f"WITH {_RETURNS} SELECT symbol, {r('stddev_samp(lx) * sqrt(252)')} AS vol FROM ret GROUP BY symbol"
SHARED["drawdown"] = f"WITH d AS (SELECT symbol, ts, close / nullif(max(close) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - 1 AS dd FROM {{daily}}) SELECT symbol, {r('min(dd)')} AS max_drawdown FROM d GROUP BY symbol"
SHARED["tearsheet"] = f"WITH {_RETURNS} SELECT symbol, count(x) AS n, {r('max_by(close, ts) / nullif(min_by(close, ts), 0) - 1')} AS total_return, {r('CAST(count(CASE WHEN x > 0 THEN 1 END) AS DOUBLE) / nullif(count(x), 0)')} AS win_rate, {r('sum(CASE WHEN x > 0 THEN x ELSE 0 END) / nullif(-sum(CASE WHEN x < 0 THEN x ELSE 0 END), 0)')} AS profit_factor FROM ret GROUP BY symbol"
SHARED["walk_forward_folds"] = f"""
WITH numbered AS (SELECT symbol, ts, close, row_number() OVER ({P}) - 1 AS i FROM {{daily}}), folds AS (SELECT *, floor(i / 60) AS fold FROM numbered)
SELECT symbol, CAST(fold AS BIGINT) AS fold, min(ts) AS test_start, max(ts) AS test_end, count(*) AS n, {r('max_by(close, ts) / nullif(min_by(close, ts), 0) - 1')} AS ret FROM folds WHERE fold >= 1 GROUP BY symbol, fold HAVING count(*) >= 30"""
_GRID = "params AS (SELECT f.n AS fast, s.n AS slow FROM (SELECT 3 AS n UNION ALL SELECT 5 AS n UNION ALL SELECT 8 AS n) f JOIN (SELECT 13 AS n UNION ALL SELECT 21 AS n) s ON f.n < s.n)"
SHARED["grid_search_sma"] = f"""
WITH means AS (SELECT symbol, ts, lead(close) OVER ({P}) / nullif(close, 0) - 1 AS nxt, avg(close) {rows(3)} AS m3, avg(close) {rows(5)} AS m5, avg(close) {rows(8)} AS m8, avg(close) {rows(13)} AS m13, avg(close) {rows(21)} AS m21 FROM {{daily}}), {_GRID},
pos AS (SELECT p.fast, p.slow, m.symbol, CASE WHEN (CASE p.fast WHEN 3 THEN m3 WHEN 5 THEN m5 ELSE m8 END) > (CASE p.slow WHEN 13 THEN m13 ELSE m21 END) + 1e-9 THEN nxt ELSE 0 END AS x FROM means m CROSS JOIN params p WHERE nxt IS NOT NULL)
SELECT fast, slow, symbol, {r('coalesce(avg(x) / nullif(stddev_samp(x), 0), 0) * sqrt(252)')} AS score FROM pos GROUP BY fast, slow, symbol"""

# Order flow and feed checks
SHARED["cvd"] = f"SELECT symbol, ts, event_id, sum(CASE WHEN event_id % 2 = 0 THEN volume ELSE -volume END) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cvd FROM {{ticks}}"
SHARED["imbalance"] = f"SELECT symbol, date_trunc('hour', ts) AS ts, {r('coalesce(sum(CASE WHEN event_id % 2 = 0 THEN volume ELSE -volume END) / nullif(sum(volume), 0), 0)')} AS imbalance FROM {{ticks}} GROUP BY symbol, date_trunc('hour', ts)"
SHARED["aggressor"] = "SELECT symbol, event_id, CASE WHEN price > before THEN 'BUY' WHEN price < before THEN 'SELL' ELSE 'NONE' END AS side FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS before FROM {ticks}) x"
SHARED["feed_integrity"] = "SELECT symbol, count(*) AS n, count(CASE WHEN ts > before + interval 1 hour THEN 1 END) AS jumps, count(CASE WHEN ts = before THEN 1 END) AS repeats, count(CASE WHEN ts < reached THEN 1 END) AS out_of_order FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY event_id) AS before, max(ts) OVER (PARTITION BY symbol ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {ticks}) x GROUP BY symbol"
SHARED["cadence_gaps"] = f"SELECT symbol, before AS quiet_from, ts AS quiet_to FROM (SELECT symbol, ts, lag(ts) OVER ({P}, event_id) AS before FROM {{ticks}}) x WHERE ts > before + interval 3 hour"
SHARED["closed_bar_gaps"] = f"SELECT symbol, ts FROM (SELECT symbol, ts, lag(ts) OVER ({P}) AS before FROM {{bars}}) x WHERE ts > before + interval 1 hour"
_ASOF = """WITH names AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS k FROM (SELECT DISTINCT symbol FROM {ticks}) x),
o AS (SELECT n.symbol, o_orderkey, TIMESTAMP '2024-01-01 00:00:00' + interval 1 hour * (o_orderkey % 700) AS ts FROM orders JOIN names n ON n.k = o_orderkey % 5),
u AS (SELECT symbol, ts, event_id, price AS mark, CAST(NULL AS BIGINT) AS o_orderkey FROM {ticks} UNION ALL SELECT symbol, ts, CAST(9223372036854775807 AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS mark, o_orderkey FROM o)"""
SHARED["mtm_asof"] = lambda d: _ASOF + f""",
f AS (SELECT symbol, o_orderkey, ts, {'last_value(mark) IGNORE NULLS' if d == 'spark' else 'last_value(mark IGNORE NULLS)'} OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark FROM u)
SELECT symbol, o_orderkey, ts, mark FROM f WHERE o_orderkey IS NOT NULL"""
