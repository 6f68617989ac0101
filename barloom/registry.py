"""Queries over the driver's tables, one for each operator, with their SQL."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom import operators, sources
from barloom.functions import bucket, in_session
from barloom.functions import indicators as windowed
from barloom.functions.sqlgen import nested
from barloom.operators import scans, transforms
from barloom.plans import backtest, breadth, execution, gaps, guard, market_profile, oracle, research, scanner, screens, signals, trades
from barloom.plans.shared import SHARED

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "resample_clock_1h"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PLACES = 6
#: Added before rounding, so that exact halves don't fall either way by an engine's order of sums.
NUDGE = 3.7e-10


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL if there is any."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return keep


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(F.col(c) + NUDGE, PLACES) for c in columns})


def _rounded_sql(columns: list[str]) -> str:
    return ", ".join(f"round({c} + {NUDGE!r}, {PLACES}) AS {c}" for c in columns)


#: Parameters under which every indicator is defined on a few hundred bars.
SHORTER = {"nvi": {"maLength": 30}, "pvi": {"maLength": 30}, "special-k": {"length1": 20, "length2": 20}, "ma-ribbon": {"ma4Length": 120}}


def _indicator_query(name: str, params: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = operators.indicator(sources.hour_bars(spark, sf_dir), name, **params)
        if name in ("nvi", "pvi", "mcginley-dynamic"):  # they compound; logarithms keep all places comparable
            found = found.withColumns({c: F.ln(c) for c in found.columns[2:]})
        return rounded(found, *found.columns[2:])

    return run


for _name in windowed.WINDOWED:
    _layers, _plots = windowed.build(_name, **SHORTER.get(_name, {}))
    _numbered = [{"rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts)"}, *_layers]
    query("ind_" + _name.replace("-", "_"), nested(oracle.HOUR_BARS, _numbered, f"SELECT symbol, ts, {_rounded_sql(_plots)} FROM {{last}}"))(_indicator_query(_name, SHORTER.get(_name, {})))
for _name in scans.SCANS:
    query("ind_" + _name.replace("-", "_"), oracle.scan_sql(_name, PLACES, NUDGE))(_indicator_query(_name, SHORTER.get(_name, {})))


# Bars and scans


def _resample(timeframe: str, grid: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sources.ticks(spark, sf_dir)
        return sources.ohlcv(rows, "symbol", bucket(F.col("ts"), timeframe, grid).alias("bucket"))

    return run


for _grid, _frames in (("clock", ("5m", "15m", "30m", "1h", "1d")), ("session", ("30m", "1h", "1d", "1w"))):
    for _tf in _frames:
        query(f"resample_{_grid}_{_tf}", oracle.resample(_tf, _grid))(_resample(_tf, _grid))


@query("scan_session_view", "SELECT event_type AS symbol, ts, event_id, value AS price FROM events WHERE hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) BETWEEN 33300 AND 55800")
def scan_session_view(spark, sf_dir):
    return sources.ticks(spark, sf_dir).filter(in_session(F.col("ts"))).select("symbol", "ts", "event_id", "price")


@query("list_symbols", "SELECT DISTINCT event_type AS symbol FROM events")
def list_symbols(spark, sf_dir):
    return sources.ticks(spark, sf_dir).select("symbol").distinct()


@query("date_range", "SELECT event_type AS symbol, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def date_range(spark, sf_dir):
    return sources.ticks(spark, sf_dir).groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# Composite queries: one text for both engines

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _text(body: str | Callable[[str], str], dialect: str) -> str:
    return body(dialect) if callable(body) else body


def _shared(body: str | Callable[[str], str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # tables are arguments of the statement, so no view of the caller's is touched
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", _text(body, "spark"))
        makers = {"bars": sources.hour_bars, "daily": sources.daily_bars, "ticks": sources.ticks}
        makers |= {name: lambda s, d, name=name: s.read.parquet(f"{d}/{name}.parquet") for name in TABLES}
        return spark.sql(text, **{k: make(spark, sf_dir) for k, make in makers.items() if f"{{{k}}}" in text})

    return run


for _name, _body in SHARED.items():
    _sql = _text(_body, "duck")
    for _key, _from in (("bars", oracle.HOUR_BARS), ("daily", oracle.DAILY_BARS), ("ticks", oracle.TICKS)):
        _sql = _sql.replace(f"{{{_key}}}", f"({_from})")
    query(_name, _sql)(_shared(_body))


# Ordered scans and research, checked by tests


def _transform(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = transforms.run(sources.hour_bars(spark, sf_dir), name)
        return rounded(made, "open", "high", "low", "close", "volume")

    return run


_HA = f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS n FROM ({oracle.HOUR_BARS})),
h AS (SELECT symbol, n, (open + close) / 2 AS o, (open + high + low + close) / 4 AS c FROM b WHERE n = 0
UNION ALL SELECT b.symbol, b.n, (h.o + h.c) / 2 AS o, (b.open + b.high + b.low + b.close) / 4 AS c FROM h JOIN b ON b.symbol = h.symbol AND b.n = h.n + 1)
SELECT b.symbol, b.n, CAST(epoch(b.ts) AS BIGINT) AS epoch, {', '.join(f"round({e} + {NUDGE!r}, 6) AS {c}" for c, e in (('open', 'h.o'), ('high', 'greatest(b.high, h.o, h.c)'), ('low', 'least(b.low, h.o, h.c)'), ('close', 'h.c'), ('volume', 'b.volume')))} FROM b JOIN h ON b.symbol = h.symbol AND b.n = h.n"""
for _name in transforms.TRANSFORMS:
    query("tf_" + _name.replace("-", "_"), _HA if _name == "heikin-ashi" else oracle.transform_sql(_name))(_transform(_name))


@query("dtw_similar")
def dtw_similar(spark, sf_dir):
    return research.find_similar(sources.daily_bars(spark, sf_dir), "A", exclude_overlap_days=5)


@query("walked_ticks")
def walked_ticks(spark, sf_dir):
    bars = sources.hour_bars(spark, sf_dir)
    both = [execution.walked_ticks(bars, method=m).withColumn("method", F.lit(m)) for m in ("anchored", "bridge")]
    return rounded(both[0].unionByName(both[1]), "price", "volume")


def _line_order() -> Column:
    """A number that orders lines; keys of lines repeat in these tables, so quantity and price break ties."""
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("long")
    return key * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sign = F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(-1)
    return lines.select(
        F.col("l_suppkey").cast("string").alias("symbol"), _line_order().alias("n"),
        (F.col("l_quantity") * sign).cast("decimal(20,4)").alias("quantity"), F.col("l_extendedprice").cast("decimal(20,4)").alias("price"),
    )


@query("position_ledger", oracle.LEDGER)
def position_ledger(spark, sf_dir):
    return _plain(research.position_ledger(_fills(spark, sf_dir)))


@query("round_trips_flat", oracle.FLAT_TRIPS)
def round_trips_flat(spark, sf_dir):
    return _plain(research.flat_to_flat(research.position_ledger(_fills(spark, sf_dir))))


@query("monte_carlo")
def monte_carlo(spark, sf_dir):
    returns = sources.daily_bars(spark, sf_dir).selectExpr("symbol", "close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS x")
    return rounded(research.monte_carlo(returns), "total")


@query("monte_carlo_summary")
def monte_carlo_summary(spark, sf_dir):
    returns = sources.daily_bars(spark, sf_dir).selectExpr("symbol", "close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS x")
    found = research.monte_carlo_summary(research.monte_carlo(returns))
    return rounded(found, "mean_return", "std_return", "ci_lower", "ci_upper")


# Breadth, scanners and trades


@query("advance_decline", oracle.ADVANCE_DECLINE)
def advance_decline(spark, sf_dir):
    return rounded(breadth.advance_decline(sources.hour_bars(spark, sf_dir)), "ratio")


@query("breadth_cumulative", oracle.BREADTH)
def breadth_cumulative(spark, sf_dir):
    return rounded(breadth.breadth_indicator(sources.hour_bars(spark, sf_dir)), "ratio", "log_cumulative")


@query("trin", oracle.TRIN)
def trin(spark, sf_dir):
    return rounded(breadth.trin(sources.hour_bars(spark, sf_dir)), "trin")


@query("technical_latest", oracle.TECHNICAL)
def technical_latest(spark, sf_dir):
    return rounded(scanner.technical_latest(sources.hour_bars(spark, sf_dir), 10, 30, 14), "sma_fast", "sma_slow", "rsi")


def _scanner(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(scanner.top(sources.daily_bars(spark, sf_dir), scanner.SCANNERS[name]), "score").drop("matched", "values")

    return run


for _name in scanner.SCANNERS:
    query(f"scanner_{_name}", oracle.SCANNERS[_name])(_scanner(_name))


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as fills of suppliers: odd line numbers buy, even ones sell; five strategies, one of them without a name."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sign = F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(-1)
    owner = F.col("l_orderkey") % 5
    return lines.select(
        F.when(owner > 0, owner.cast("string")).alias("strategy"), F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), (F.col("l_quantity") * sign).cast("decimal(20,4)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(20,4)").alias("price"), (F.col("l_tax") * 100).cast("decimal(20,4)").alias("cost"),
    )


def _plain(rows: DataFrame) -> DataFrame:
    """Decimals as doubles, for engines whose decimals differ in scale."""
    return rows.withColumns({c: F.col(c).cast("double") for c, kind in rows.dtypes if kind.startswith("decimal")})


@query("round_trips_fifo", oracle.ROUND_TRIPS)
def round_trips_fifo(spark, sf_dir):
    found = trades.round_trips(_trades(spark, sf_dir), "symbol")
    return _plain(found.drop("entry_ts", "exit_ts"))


@query("pnl_by_strategy", oracle.PNL_BY_STRATEGY)
def pnl_by_strategy(spark, sf_dir):
    return _plain(trades.pnl_by_strategy(_trades(spark, sf_dir)))


@query("strategy_statistics", oracle.STATISTICS)
def strategy_statistics(spark, sf_dir):
    named = _trades(spark, sf_dir).withColumn("strategy", F.coalesce("strategy", F.lit("none")))
    trips = trades.round_trips(named, "strategy", "symbol")
    days = trips.groupBy("strategy", F.col("exit_ts").alias("ts")).agg(F.sum("net_pnl").cast("double").alias("x"))
    so_far = Window.partitionBy("strategy").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    equity = days.select("strategy", "ts", (F.lit(1e7) + F.sum("x").over(so_far)).alias("value"))
    found = _plain(trades.statistics(trips, "strategy", equity=equity))
    return rounded(found, "win_rate", "loss_rate", "exposure", "profit_factor", "risk_reward", "max_drawdown", "max_drawdown_pct", "sharpe", "sortino")


@query("mae_mfe", oracle.MAE_MFE)
def mae_mfe(spark, sf_dir):
    sides = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    entries = signals.sma_cross(sources.hour_bars(spark, sf_dir)).filter("next_open IS NOT NULL").select(
        "symbol", F.col("next_ts").alias("ts"), F.unix_seconds(F.col("next_ts").cast("timestamp")).alias("n"), (sides * F.when(F.col("first"), 1).otherwise(2)).alias("quantity"),
        F.col("next_open").alias("price"), F.lit(None).cast("double").alias("cost"),
    )
    found = trades.with_excursions(trades.round_trips(entries, "symbol"), sources.hour_bars(spark, sf_dir), "symbol")
    return _plain(found.select("symbol", "side", "entry_n", "exit_n", "mae", "mfe"))


@query("fees_breakdown", oracle.FEES)
def fees_breakdown(spark, sf_dir):
    product = F.when(F.col("n") % 2 == 0, "DELIVERY").otherwise(F.when(F.col("n") % 3 == 0, "INTRADAY"))
    side = F.when(F.col("quantity") > 0, "BUY").otherwise("SELL")
    each = _trades(spark, sf_dir).select("symbol", trades.fees(side, F.abs("quantity"), F.col("price"), product).alias("f")).select("symbol", "f.*")
    found = each.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in each.columns[1:]))
    return _plain(found)


@query("stop_gap_prices", oracle.STOP_GAP)
def stop_gap_prices(spark, sf_dir):
    bars = sources.hour_bars(spark, sf_dir)
    level = (F.col("open") + F.col("close")) / 2
    found = bars.select("symbol", "ts", *(trades.stop_gap_price(F.lit(kind), F.lit(side), level, F.col("low"), F.col("high")).alias(f"{kind}_{side.lower()}") for kind in ("stop", "target") for side in ("BUY", "SELL")))
    return rounded(found, *found.columns[2:])


# Screens bounded in time


def _tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick as the shortest of bars."""
    rows = sources.ticks(spark, sf_dir)
    return rows.select("symbol", "ts", *(F.col("price").alias(c) for c in ("open", "high", "low", "close")), "volume")


@query("resample_bounded", oracle.RESAMPLE_BOUNDED)
def resample_bounded(spark, sf_dir):
    return screens.resample(_tick_bars(spark, sf_dir), "1h", "session", "2024-01-05 09:15:00", "2024-01-20 15:30:00", ["click", "view", "none"])


@query("rs_scores_bounded", oracle.RS_BOUNDED)
def rs_scores_bounded(spark, sf_dir):
    return screens.rs_scores(_tick_bars(spark, sf_dir), "2024-01-25 00:00:00", 5, 20, "1h", "clock", (4, 10, 20), 14).drop("raw")


@query("morning_screen", oracle.MORNING_SCREEN)
def morning_screen(spark, sf_dir):
    return screens.morning_screen(
        _tick_bars(spark, sf_dir), "2024-01-26 09:45:00", gap_min_pct=-1e6, vol_multiple=0.05, vol_lookback_days=7, pre30_min_pct=-1e6, adx_len=5, adx_min=1.0, atr_min_pct=0.5, atr_max_pct=1e6,
        prev_pre30_max_pct=1e9, min_open=0.001, days=5, bars_per_day=20, ma_lens=(4, 10, 20), timeframe="1h",
    )


@query("breadth_bounded", oracle.BREADTH_BOUNDED)
def breadth_bounded(spark, sf_dir):
    return screens.breadth_of_days(_tick_bars(spark, sf_dir), "2024-01-26 09:45:00", 10)


# Sessions


def _session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.resample(_tick_bars(spark, sf_dir), "1h", "session").withColumnRenamed("bucket", "ts")


def _sessions() -> gaps.Sessions:
    return gaps.Sessions(dt.datetime(2024, 1, 2, 10, 20), dt.datetime(2024, 1, 24, 13, 0), 3600, frozenset({dt.date(2024, 1, 8), dt.date(2024, 1, 17)}))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.ticks(spark, sf_dir).select("symbol").distinct().unionByName(spark.createDataFrame([("none",)], "symbol string"))


@query("session_gaps", oracle.SESSION_GAPS)
def session_gaps(spark, sf_dir):
    return gaps.scan(_session_bars(spark, sf_dir), _symbols(spark, sf_dir), _sessions())[0]


@query("session_gap_summary", oracle.SESSION_SUMMARY)
def session_gap_summary(spark, sf_dir):
    return gaps.scan(_session_bars(spark, sf_dir), _symbols(spark, sf_dir), _sessions(), min_gap_stamps=2)[1]


@query("repair_order", oracle.REPAIR_ORDER)
def repair_order(spark, sf_dir):
    found = gaps.scan(_session_bars(spark, sf_dir), _symbols(spark, sf_dir), _sessions(), include_open=True)[0]
    return gaps.repair_order(found, 3600)


@query("deflated_sharpe")
def deflated_sharpe(spark, sf_dir):
    return research.deflated_sharpe(QUERIES["grid_search_sma"](spark, sf_dir))


@query("param_stability", f"WITH g AS ({ORACLE_SQL['grid_search_sma']}) SELECT avg(CASE WHEN score >= (SELECT max(score) FROM g) - 1 THEN 1.0 ELSE 0.0 END) AS share FROM g")
def param_stability(spark, sf_dir):
    return research.parameter_stability(QUERIES["grid_search_sma"](spark, sf_dir))


@query("guarded_sql", f"SELECT symbol, count(*) AS n FROM ({oracle.HOUR_BARS}) GROUP BY symbol")
def guarded_sql(spark, sf_dir):
    return guard.guarded(spark, "WITH x AS (SELECT * FROM ohlcv) SELECT symbol, count(*) AS n FROM x GROUP BY symbol", {"ohlcv": sources.hour_bars(spark, sf_dir)})


@query("profile_value_area")
def profile_value_area(spark, sf_dir):
    found = market_profile.levels(sources.hour_bars(spark, sf_dir), 10, "symbol")
    return market_profile.value_area(found, 10, "symbol")


@query("profile_sessions")
def profile_sessions(spark, sf_dir):
    found = market_profile.sessions(sources.hour_bars(spark, sf_dir), 10)
    return rounded(found, "ib_high", "ib_low", "extension_up", "extension_down")


@query("profile_market")
def profile_market(spark, sf_dir):
    return market_profile.profiles(_tick_bars(spark, sf_dir), 5.0, 2, "day", 120, tail_edges=1).drop("developing", "levels", "single_prints", "buying_tail", "selling_tail")


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as quotes, with a bid and an ask around the price rounded to fives."""
    middle = F.round(F.col("price") / 5) * 5
    return sources.ticks(spark, sf_dir).select(
        "symbol", "ts", F.col("event_id").alias("n"), F.col("price").alias("ltp"), F.when(F.col("event_id") % 11 > 0, middle - 1).alias("bid"), F.when(F.col("event_id") % 13 > 0, middle + 1).alias("ask"),
        F.when(F.col("event_id") % 7 > 0, F.col("volume")).alias("volume"),
    )


@query("footprint_quotes", oracle.FOOTPRINT)
def footprint_quotes(spark, sf_dir):
    return market_profile.quote_footprint(_quotes(spark, sf_dir), "symbol")


@query("cvd_quotes", oracle.CVD)
def cvd_quotes(spark, sf_dir):
    return market_profile.cumulative_delta(_quotes(spark, sf_dir), "symbol").select("symbol", "n", "cvd")


@query(
    "synthetic_ticks",
    f"""WITH b AS ({oracle.HOUR_BARS}), p AS (SELECT *, unnest([0, 1, 2, 3]) AS n FROM b)
SELECT symbol, ts, CAST(n AS INTEGER) AS n, CASE n WHEN 0 THEN open WHEN 3 THEN close ELSE CASE WHEN (close >= open) = (n = 1) THEN low ELSE high END END AS price,
CASE n WHEN 0 THEN volume - 3 * floor(volume / 4) ELSE floor(volume / 4) END AS volume FROM p""",
)
def synthetic_ticks(spark, sf_dir):
    return execution.synthetic_ticks(sources.hour_bars(spark, sf_dir)).withColumn("volume", F.col("volume").cast("double"))


@query("risk_refusals", oracle.RISK)
def risk_refusals(spark, sf_dir):
    """A customer's orders under limits of order value, cash, position value and short sales."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    side = F.when(F.col("o_orderkey") % 3 == 0, "SELL").otherwise("BUY")
    rows = orders.select(
        F.col("o_custkey").cast("string").alias("account"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderkey").alias("n"), F.lit("X").alias("symbol"), side.alias("side"),
        F.lit(1.0).alias("quantity"), F.round("o_totalprice").alias("price"),
    )
    limits = execution.Limits(order_value=300_000, position_value=900_000, short_allowed=False)
    return execution.risk_checks(rows, 800_000, limits).select("account", "n", "refused", "cash", "position")


@query("backtest_events")
def backtest_events(spark, sf_dir):
    bars = sources.hour_bars(spark, sf_dir)
    entries = signals.run_strategy(bars, "bracket-breakout").filter("code < 3").select("symbol", "ts", "side", "stop", "target")
    return _plain(backtest.run(bars, entries, 100_000, 10))


@query("backtest_results")
def backtest_results(spark, sf_dir):
    bars = sources.hour_bars(spark, sf_dir)
    crosses = signals.sma_cross(bars).select("symbol", "ts", "side")
    return rounded(_plain(backtest.result(backtest.run(bars, crosses, 100_000, 10), "1h")), "total_return", "sharpe", "max_drawdown")


@query("wf_folds", oracle.FOLDS)
def wf_folds(spark, sf_dir):
    return execution.folds_of(sources.daily_bars(spark, sf_dir), train=120, test=60)


# Signals of recurrences


def _signal_sql(name: str, rule: str) -> str:
    return f"SELECT symbol, ts, side FROM (SELECT symbol, ts, {rule} AS side FROM ({oracle.scan_sql(name, 12, 0.0)}) x) y WHERE side IS NOT NULL"


def _before(x: str) -> str:
    return f"lag({x}) OVER (PARTITION BY symbol ORDER BY ts)"


@query("signals_macd_cross", _signal_sql("macd", f"CASE WHEN {_before('macd')} <= {_before('signal')} AND macd > signal THEN 'BUY' WHEN {_before('macd')} >= {_before('signal')} AND macd < signal THEN 'SELL' END"))
def signals_macd_cross(spark, sf_dir):
    return signals.macd_cross(sources.hour_bars(spark, sf_dir))


@query("signals_rsi_reversal", _signal_sql("rsi", f"CASE WHEN {_before('value')} <= 30 AND value > 30 THEN 'BUY' WHEN {_before('value')} >= 70 AND value < 70 THEN 'SELL' END"))
def signals_rsi_reversal(spark, sf_dir):
    return signals.rsi_reversal(sources.hour_bars(spark, sf_dir))


@query("signals_supertrend_flip", _signal_sql("supertrend", f"CASE WHEN {_before('direction')} < 0 AND direction > 0 THEN 'BUY' WHEN {_before('direction')} > 0 AND direction < 0 THEN 'SELL' END"))
def signals_supertrend_flip(spark, sf_dir):
    return signals.supertrend_flip(sources.hour_bars(spark, sf_dir))


def _strategy(name: str, *figures: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(signals.run_strategy(sources.hour_bars(spark, sf_dir), name), *figures)

    return run


for _name, _figures in (("ema-ribbon-pullback", ()), ("bracket-breakout", ("stop", "target")), ("supertrend-regime", ())):
    query("signals_" + _name.replace("-", "_"), oracle.strategy_sql(_name, PLACES, NUDGE))(_strategy(_name, *_figures))


@query("event_log_chain", oracle.CHAIN)
def event_log_chain(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return signals.event_chain(events.select(F.col("event_type").alias("key"), F.col("event_id").alias("n"), F.col("props").alias("payload")))


# Stores and selections


@query("dataset_fingerprint")
def dataset_fingerprint(spark, sf_dir):
    return sources.dataset_fingerprint(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("schema_of", "SELECT column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS kind FROM information_schema.columns WHERE table_name = 'events'")
def schema_of(spark, sf_dir):
    return sources.schema_of({"events": spark.read.parquet(f"{sf_dir}/events.parquet")}, "events")


@query("active_symbols", "SELECT DISTINCT event_type AS symbol FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE value > 490)")
def active_symbols(spark, sf_dir):
    rows = sources.ticks(spark, sf_dir)
    return sources.active(rows.select("symbol").distinct(), rows.filter("price > 490").select("symbol").distinct())


@query("atm_strike", "SELECT c_custkey, min(p_retailprice) AS strike FROM (SELECT c.c_custkey, p.p_retailprice, rank() OVER (PARTITION BY c.c_custkey ORDER BY abs(p.p_retailprice - c.c_acctbal)) AS k FROM customer c JOIN part p ON p.p_size = c.c_nationkey) x WHERE k = 1 GROUP BY c_custkey")
def atm_strike(spark, sf_dir):
    part, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "customer"))
    chain = part.select(F.col("p_size").cast("long").alias("underlying"), F.col("p_retailprice").alias("strike"))
    refs = customer.select(F.col("c_nationkey").cast("long").alias("underlying"), F.col("c_custkey").alias("n"), F.col("c_acctbal").alias("reference"))
    return sources.nearest_strikes(chain, refs).select(F.col("n").alias("c_custkey"), "strike")


@query(
    "otm_strikes",
    "SELECT underlying, strike, CAST(place AS INTEGER) AS place FROM (SELECT p_brand AS underlying, p_retailprice AS strike, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS place "
    "FROM (SELECT DISTINCT p_brand, p_retailprice FROM part WHERE p_retailprice > 500) d) x WHERE place <= 3",
)
def otm_strikes(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    chain = part.select(F.col("p_brand").alias("underlying"), F.col("p_retailprice").alias("strike"), F.lit("CALL").alias("right")).distinct()
    return sources.strikes(chain, F.lit(500.0), "CALL", 3).select("underlying", "strike", "place")
