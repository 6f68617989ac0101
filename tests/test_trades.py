"""Trades, breadth and scanners on small series worked out by hand."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.plans import breadth, research, scanner, signals, trades

T0 = dt.datetime(2026, 8, 5, 9, 15)
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
FILLS = "strategy string, symbol string, ts timestamp_ntz, n long, quantity double, price double, cost double"


def fills(spark, rows):
    return spark.createDataFrame([(s, "A", T0 + dt.timedelta(hours=i), i, q, p, c) for i, (s, q, p, c) in enumerate(rows)], FILLS)


def test_round_trips_match_first_in_first_out(spark):
    rows = fills(spark, [("x", 10.0, 100.0, 5.0), ("x", 5.0, 110.0, None), ("x", -12.0, 120.0, 6.0), ("x", -8.0, 90.0, None), ("x", 5.0, 80.0, None), ("x", 1.0, 70.0, None)])
    got = sorted((r.entry_n, r.exit_n, r.side, float(r.quantity), float(r.gross_pnl), float(r.costs)) for r in trades.round_trips(rows, "symbol").collect())
    # the fourth fill closes three and opens five short, which the fifth closes; the last one stays open
    assert got == [(0, 2, "LONG", 10.0, 200.0, 10.0), (1, 2, "LONG", 2.0, 20.0, 1.0), (1, 3, "LONG", 3.0, -60.0, 0.0), (3, 4, "SHORT", 5.0, 50.0, 0.0)]


def brute_trips(rows):
    lots, out = [], []
    for n, q, p in rows:
        while q and lots and (lots[0][1] > 0) != (q > 0):
            m = min(abs(q), abs(lots[0][1]))
            s = 1 if lots[0][1] > 0 else -1
            out.append((lots[0][0], n, m, round((p - lots[0][2]) * m * s, 2)))
            lots[0][1] -= s * m
            q += s * m
            if not lots[0][1]:
                lots.pop(0)
        if q:
            lots.append([n, q, p])
    return out


def test_round_trips_equal_a_queue_of_lots(spark):
    rng = np.random.default_rng(4)
    rows = [("x", float(rng.integers(-9, 10)), float(rng.integers(50, 150)), 0.0) for _ in range(400)]
    got = sorted((r.entry_n, r.exit_n, int(r.quantity), float(r.gross_pnl)) for r in trades.round_trips(fills(spark, rows), "symbol").collect())
    merged = {}
    for e, x, m, g in brute_trips([(i, int(q), int(p)) for i, (_, q, p, _) in enumerate(rows)]):
        merged[e, x] = (merged.get((e, x), (0, 0))[0] + m, merged.get((e, x), (0, 0))[1] + g)
    assert got == sorted((e, x, m, float(g)) for (e, x), (m, g) in merged.items())


def test_strategies_do_not_close_each_other(spark):
    rows = fills(spark, [("a", 1.0, 10.0, 0.0), (None, -1.0, 20.0, 0.0), ("a", -1.0, 12.0, 0.0), ("b", 1.0, 5.0, 0.0)])
    got = {r.strategy: (float(r.realised), r.n_trips) for r in trades.pnl_by_strategy(rows).collect()}
    assert got == {"a": (2.0, 1), None: (0.0, 0), "b": (0.0, 0)}


def test_statistics_of_trades(spark):
    rows = fills(spark, [("x", 1.0, 100.0, 0.0), ("x", -1.0, 110.0, 1.0), ("x", 1.0, 100.0, 0.0), ("x", -1.0, 94.0, 0.0)])
    equity = spark.createDataFrame([("x", T0 + dt.timedelta(days=i), v) for i, v in enumerate([100.0, 110.0, 99.0, 99.0])], "strategy string, ts timestamp_ntz, value double")
    r = trades.statistics(trades.round_trips(rows, "strategy", "symbol"), "strategy", equity=equity).first()
    assert (r.total_trades, r.winning_trades, r.losing_trades, float(r.net_profit), float(r.gross_profit), float(r.gross_loss), float(r.total_costs)) == (2, 1, 1, 3.0, 10.0, -6.0, 1.0)
    assert (r.win_rate, float(r.average_trade), float(r.average_winner), float(r.largest_loss), r.exposure) == (0.5, 1.5, 9.0, -6.0, pytest.approx(2 / 3))
    assert r.profit_factor == pytest.approx(10 / 6) and r.risk_reward == 1.5 and r.max_drawdown == pytest.approx(-0.1)
    x = np.array([0.1, -0.1, 0.0])
    assert r.sharpe == pytest.approx(x.mean() / x.std(ddof=1) * 252**0.5, abs=1e-9) and r.sortino == pytest.approx(x.mean() * 252 / (np.sqrt(0.01 / 3) * 252**0.5), abs=1e-9)
    assert trades.periods_per_year("15m") == 6300 and trades.periods_per_year("1w") == 52 and trades.periods_per_year("?") == 252


def test_time_held_may_leave_63_bits(spark):
    first, last = dt.datetime(1, 1, 2), dt.datetime(9999, 12, 30)
    rows = [("x", str(k), ts, n, q, 10.0, 0.0) for k in range(40) for n, (ts, q) in enumerate(((first, 1.0), (last, -1.0)))]
    r = trades.statistics(trades.round_trips(spark.createDataFrame(rows, FILLS), "strategy", "symbol"), "strategy").first()
    assert (r.total_trades, r.exposure) == (40, 40.0)


def test_units_of_tied_fills_take_turns(spark):
    # two fills of equal time and number, 3 at 100 and 2 at 200: A B A B A; two more are alike and count as one
    rows = [("x", "A", T0 + dt.timedelta(hours=h), h, q, p, 0.0) for h, q, p in ((0, 3.0, 100.0), (0, 2.0, 200.0), (1, -3.0, 300.0), (2, -2.0, 300.0), (3, 4.0, 10.0), (3, 4.0, 10.0), (4, -8.0, 11.0))]
    got = sorted((r.entry_n, float(r.entry_price), r.exit_n, float(r.quantity), float(r.gross_pnl)) for r in trades.round_trips(spark.createDataFrame(rows, FILLS), "symbol").collect())
    assert got == [(0, 100.0, 1, 2.0, 400.0), (0, 100.0, 2, 1.0, 200.0), (0, 200.0, 1, 1.0, 100.0), (0, 200.0, 2, 1.0, 100.0), (3, 10.0, 4, 8.0, 8.0)]


def test_tied_fills_of_many_or_broken_units_are_matched_whole(spark):
    rows = [("x", "A", T0 + dt.timedelta(hours=h), h, q, p, 0.0) for h, q, p in ((0, 2.5, 100.0), (0, 1.25, 200.0), (1, -3.75, 300.0), (2, 3e9, 10.0), (2, 1e9, 20.0), (3, -4e9, 30.0))]
    got = sorted((r.entry_n, float(r.entry_price), r.exit_n, float(r.quantity)) for r in trades.round_trips(spark.createDataFrame(rows, FILLS), "symbol").collect())
    assert got == [(0, 100.0, 1, 2.5), (0, 200.0, 1, 1.25), (2, 10.0, 3, 3e9), (2, 20.0, 3, 1e9)]


def test_excursions_between_entry_and_exit(spark):
    rows = [("A", T0 + dt.timedelta(days=d, hours=h), 100.0, 100.0 + 3 * d + h, 100.0 - 2 * d, 100.0, 1.0) for d in range(4) for h in range(3)]
    trip = trades.round_trips(fills(spark, [("x", 1.0, 100.0, 0.0)]).unionByName(fills(spark, [("x", -1.0, 101.0, 0.0)]).withColumns({"ts": F.lit(T0 + dt.timedelta(days=2, hours=1)), "n": F.lit(1).cast("long")})), "symbol")
    r = trades.with_excursions(trip, spark.createDataFrame(rows, BARS), "symbol").first()
    assert (r.mae, r.mfe) == (4.0, 7.0)  # the third day's first two hours; the day before gives 3 + 2
    none = trades.with_excursions(trip, spark.createDataFrame([], BARS), "symbol").first()
    assert none.mae is None and none.mfe is None


def test_fees_by_product(spark):
    def one(side, quantity, price, product):
        row = spark.range(1).select(trades.fees(F.lit(side), F.lit(quantity), F.lit(price), F.lit(product)).alias("f")).select("f.*").first()
        return {k: float(v) for k, v in row.asDict().items()}

    intraday = one("SELL", 100, 1000, None)
    assert intraday == {"brokerage": 20.0, "transaction_tax": 25.0, "exchange_fee": 3.45, "regulator_fee": 0.2, "stamp": 3.0, "service_tax": 4.26}
    assert one("BUY", 100, 1000, "INTRADAY")["transaction_tax"] == 0 and one("BUY", 100, 1000, "DELIVERY")["transaction_tax"] == 100
    with pytest.raises(Exception, match="no fee schedule"):
        one("BUY", 1, 1, "MARGIN")


def test_stops_fill_at_the_worse_price(spark):
    f = lambda kind, side, low, high: trades.stop_gap_price(F.lit(kind), F.lit(side), F.lit(1000.0), F.lit(low), F.lit(high))
    row = spark.range(1).select(f("stop", "BUY", 980.0, 1001.0).alias("a"), f("stop", "BUY", 999.0, 1001.0).alias("b"), f("stop", "SELL", 990.0, 1010.0).alias("c"), f("target", "BUY", 980.0, 1001.0).alias("d"), f("stop", "BUY", -5.0, 1.0).alias("e")).first()
    assert tuple(row) == (980.0, 997.5, 1010.0, 1000.0, 0.01)


def test_breadth_is_infinite_without_declines(spark):
    closes = {"A": [1, 2, 3, 2, 2], "B": [1, 2, 2, 3, 2]}
    rows = [(s, T0 + dt.timedelta(days=i), c, c, c, c, 10.0) for s, v in closes.items() for i, c in enumerate(map(float, v))]
    got = breadth.breadth_indicator(spark.createDataFrame(rows, BARS)).orderBy("ts").collect()
    inf = float("inf")
    assert [(r.advances, r.declines, r.ratio) for r in got] == [(0, 0, 0.0), (2, 0, inf), (1, 0, inf), (1, 1, 1.0), (0, 1, 0.0)]
    assert [r.log_cumulative for r in got] == [0.0, inf, inf, inf, inf]
    assert [r.trin for r in breadth.trin(spark.createDataFrame(rows, BARS)).orderBy("ts").collect()] == [inf, inf, inf, 1.0, inf]


def test_scanner_scores_ranks_and_leaves_unknown_values_out(spark):
    rows = [(s, T0 + dt.timedelta(days=i), c, c, c, c, 1.0) for s, v in {"UP": range(600, 640), "DOWN": range(640, 600, -1), "NEW": [700, 701], "LOW": [5, 6]}.items() for i, c in enumerate(map(float, v))]
    bars = spark.createDataFrame(rows, BARS)
    held = spark.createDataFrame([("DOWN", 7)], "symbol string, quantity int")
    got = {r.symbol: r for r in scanner.scan(bars, scanner.SCANNERS["pullback"], holdings=held).collect()}
    assert [(s, got[s].score, got[s].rank) for s in sorted(got, key=lambda s: got[s].rank)] == [("DOWN", 1.0, 1), ("NEW", 0.5, 2), ("UP", 0.5, 3)]
    assert "rsi" not in got["NEW"]["values"] and got["DOWN"].matched == ["close", "rsi"] and got["DOWN"].in_portfolio and not got["UP"].in_portfolio
    assert [r.symbol for r in scanner.top(bars, scanner.SCANNERS["pullback"], limit=1).collect()] == ["DOWN"]
    assert scanner.scan(bars, ()).count() == 4
    with pytest.raises(ValueError):
        scanner.scan(bars, (scanner.Condition("ichimoku", ">", 0.0),))


def test_technical_screen_is_wilder_s_index(spark):
    rng = np.random.default_rng(8)
    c = 100 + rng.normal(size=80).cumsum()
    bars = spark.createDataFrame([("A", T0 + dt.timedelta(hours=i), x, x, x, x, 1.0) for i, x in enumerate(map(float, c))], BARS)
    d = np.diff(c)
    up, down = np.maximum(d, 0)[:14].mean(), np.maximum(-d, 0)[:14].mean()
    for x in d[14:]:
        up, down = (up * 13 + max(x, 0)) / 14, (down * 13 + max(-x, 0)) / 14
    r = scanner.technical_latest(bars, 20, 50).first()
    assert r.rsi == pytest.approx(100 - 100 / (1 + up / down)) and r.sma_fast == pytest.approx(c[-20:].mean()) and r.sma_slow == pytest.approx(c[-50:].mean())


def test_bracket_holds_one_position_and_leaves_at_its_levels(spark):
    flat = [(100.0, 101.0, 99.0, 100.0)] * 21
    rows = flat + [(100.0, 104.0, 100.0, 103.0), (103.0, 120.0, 102.0, 119.0), (119.0, 119.0, 80.0, 81.0), (80.0, 80.0, 70.0, 71.0)]
    bars = spark.createDataFrame([("A", T0 + dt.timedelta(hours=i), *r, 1.0) for i, r in enumerate(rows)], BARS)
    got = [(r.ts.hour - T0.hour + 24 * (r.ts.day - T0.day), r.side, r.code) for r in signals.run_strategy(bars, "bracket-breakout").orderBy("ts").collect()]
    assert got == [(21, "BUY", 1), (22, "SELL", 4), (23, "SELL", 2)]


def test_regime_waits_after_a_loss():
    from barloom.operators import scans

    n = 60
    way = np.where(np.arange(n) // 4 % 2 == 0, 1.0, -1.0)  # a flip every four bars
    c = 100 + 0.1 * np.arange(n)  # the first trade is short, and loses
    b = scans.Bars(c, c, c, c, c, np.arange(n))
    before = scans.SCANS["supertrend"]
    scans.SCANS["supertrend"] = (lambda *_: {"direction": way}, *before[1:])
    try:
        codes = signals.STRATEGIES["supertrend-regime"][0](b, 10, 3.0, 5, 20)["code"]
    finally:
        scans.SCANS["supertrend"] = before
    at = np.flatnonzero(~np.isnan(codes))
    # in at 4, out at 8 with a loss on bar 9; five bars later, at 16, in again
    assert at[:4].tolist() == [4, 8, 16, 20]


def test_paths_and_their_summary(spark):
    returns = spark.createDataFrame([("A", 0.01)] * 5 + [("B", -0.01), ("B", 0.02)], "symbol string, x double")
    paths = research.monte_carlo(returns, paths=200, horizon=20).cache()
    assert paths.count() == 400 and paths.select("symbol", "path").distinct().count() == 400
    a, b = research.monte_carlo_summary(paths).orderBy("symbol").collect()
    assert a.mean_return == pytest.approx(1.01**20 - 1) and a.std_return == pytest.approx(0) and a.prob_profit == 1.0
    totals = sorted(r.total for r in paths.filter("symbol = 'B'").collect())
    assert (b.ci_lower, b.ci_upper, b.n_paths) == (pytest.approx(totals[10]), pytest.approx(totals[190]), 200)


def test_money_is_rounded_away_from_zero(spark):
    row = spark.range(1).select(*(trades.cents(F.lit(Decimal(x))).alias(f"c{i}") for i, x in enumerate(("0.005", "-0.005", "2.675")))).first()
    assert [str(x) for x in row] == ["0.01", "-0.01", "2.68"]


def test_similar_windows_do_not_overlap(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in "ABC":
        c = 100 + rng.normal(size=90).cumsum()
        rows += [(s, T0 + dt.timedelta(days=i), float(x)) for i, x in enumerate(c) if not (s == "B" and i == 40)]
    rows += [("NEW", T0 + dt.timedelta(days=i), 5.0) for i in range(80, 90)]
    daily = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    got = research.find_similar(daily, "A", window=10, horizon=3, top_k=8, exclude_overlap_days=4).collect()
    ends = {}
    for r in got:
        assert all(abs((r.ts - t).days) > 4 for t in ends.get(r.symbol, ()))
        ends.setdefault(r.symbol, []).append(r.ts)
    assert len(got) == 8 and "NEW" not in ends and len({r.baseline_median_fwd for r in got}) == 1
    assert not [r for r in got if r.symbol == "B" and 40 <= (r.ts - T0).days < 50]  # a date is missing in those windows
    plain = research.find_similar(daily, "A", window=10, horizon=3, top_k=5).collect()
    assert [r.dist for r in plain] == sorted(r.dist for r in plain) and plain[0].dist <= got[0].dist
    with pytest.raises(ValueError):
        research.find_similar(daily, "NEW", window=20)


def test_walked_ticks_stay_within_their_bar(spark):
    from barloom.plans import execution

    bars = spark.createDataFrame([("A", T0 + dt.timedelta(hours=i), 100.0, 106.0, 97.0, 103.0, 1000.0) for i in range(200)], BARS)
    for method in ("anchored", "bridge"):
        rows = execution.walked_ticks(bars, 10, method).collect()
        by_bar = {}
        for r in rows:
            by_bar.setdefault(r.ts, []).append(r)
        for own in by_bar.values():
            own.sort(key=lambda r: r.n)
            assert len(own) == 10 and own[0].price == 100.0 and own[-1].price == pytest.approx(103.0) and all(97 <= r.price <= 106 for r in own)
            assert sum(r.volume for r in own) == pytest.approx(1000.0, abs=1e-9) and own[0].volume == pytest.approx(2 * own[1].volume, abs=1e-5)
        assert len({r.price for r in rows if r.n == 5}) > 100
        assert sorted(map(tuple, rows)) == sorted(map(tuple, execution.walked_ticks(bars.repartition(7), 10, method).collect()))
