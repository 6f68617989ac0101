"""Backtests and risk checks on bars worked out by hand."""

import datetime as dt

import pytest

from barloom.plans import backtest, execution

T0 = dt.datetime(2026, 8, 3, 9, 15)
FREE = backtest.Costs(charged=False)


def bars(spark, rows):
    return spark.createDataFrame([("A", T0 + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(rows)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double")


def signals(spark, rows):
    return spark.createDataFrame([("A", T0 + dt.timedelta(days=i), side, stop, target) for i, side, stop, target in rows], "symbol string, ts timestamp_ntz, side string, stop double, target double")


def events(spark, prices, asked, costs=FREE, capital=1000.0, quantity=2.0, actions=None):
    return backtest.run(bars(spark, prices), signals(spark, asked), capital, quantity, costs, actions).orderBy("at").collect()


FLAT = (100, 101, 99, 100)


def test_signals_fill_at_the_next_open(spark):
    got = events(spark, [FLAT, (105, 110, 104, 108), (109, 112, 108, 111)], [(0, "BUY", None, None), (2, "SELL", None, None)])
    assert [(r.kind, r.side, r.price and float(r.price)) for r in got] == [("bar", None, None), ("fill", "BUY", 105.0), ("bar", None, None), ("bar", None, None), ("unfilled", "SELL", None)]
    assert [float(r.equity) for r in got if r.kind == "bar"] == [1000.0, 1006.0, 1012.0]


def test_stops_gap_and_targets_do_not(spark):
    stopped = events(spark, [FLAT, (100, 101, 99, 100), (97, 98, 90, 95)], [(0, "BUY", 95.0, 120.0)])
    assert [(r.reason, float(r.price)) for r in stopped if r.kind == "fill"] == [("signal", 100.0), ("stop", 90.0)]
    reached = events(spark, [FLAT, (100, 121, 99, 118)], [(0, "BUY", 95.0, 120.0)])
    assert [(r.reason, float(r.price)) for r in reached if r.kind == "fill"] == [("signal", 100.0), ("target", 120.0)]
    both = events(spark, [FLAT, (100, 121, 94.9, 118)], [(0, "BUY", 95.0, 120.0)])
    assert [(r.reason, float(r.price)) for r in both if r.kind == "fill"][1] == ("stop", 94.7625)
    invalid = events(spark, [FLAT, (100, 121, 90, 118)], [(0, "BUY", 105.0, 120.0)])
    assert [r.reason for r in invalid if r.kind == "fill"] == ["signal"]


def test_one_order_a_bar_and_no_overdraft(spark):
    got = events(spark, [FLAT, FLAT, FLAT, FLAT], [(0, "BUY", None, None), (0, "BUY", None, None)], capital=350.0)
    assert [(r.kind, r.ts.day) for r in got if r.kind != "bar"] == [("fill", 4), ("refused", 5)]
    assert float(got[-1].cash) == 150.0


def test_splits_and_dividends_reach_lots_that_were_held(spark):
    acts = spark.createDataFrame([("A", dt.date(2026, 8, 5), "SPLIT", 2.0, None), ("A", dt.date(2026, 8, 6), "DIVIDEND", None, 1.5), ("A", dt.date(2026, 8, 3), "SPLIT", 5.0, None)], "symbol string, ex_date date, action_type string, ratio double, amount double")
    prices = [FLAT, (100, 101, 99, 100), (50, 51, 49, 50), (50, 51, 44, 50), (50, 51, 49, 50)]
    got = events(spark, prices, [(0, "BUY", 90.0, 130.0)], actions=acts)
    last = got[-1]
    # the first split came before the lot; the stop of 90 is 45 after the second, and the fourth bar reaches it
    assert [(r.reason, float(r.position), float(r.average)) for r in got if r.kind == "action"] == [("SPLIT", 4.0, 50.0), ("DIVIDEND", 4.0, 50.0)]
    assert [(r.reason, float(r.quantity), float(r.price)) for r in got if r.kind == "fill"][1] == ("stop", 4.0, 44.0)
    assert float(last.cash) == 1000 - 200 + 6 + 176 and float(last.realised) == 6 - 24


def test_fees_and_slippage(spark):
    got = events(spark, [FLAT, FLAT], [(0, "BUY", None, None)], costs=backtest.Costs(slippage_pct=1.0, product="DELIVERY"), quantity=2.0)
    fill = next(r for r in got if r.kind == "fill")
    assert float(fill.price) == 101.0 and float(fill.fee) == pytest.approx(0.06 + 0.01 + 0.0 + 0.2 + 0.01 + 0.01)
    assert float(fill.cash) == pytest.approx(1000 - 202 - float(fill.fee))


def test_results_of_a_run(spark):
    run = backtest.run(bars(spark, [FLAT, (100, 111, 99, 110), (110, 110, 99, 99)]), signals(spark, [(0, "BUY", None, None)]), 1000.0, 2.0, FREE)
    r = backtest.result(run).first()
    assert (r.n_bars, r.n_fills, r.n_refused, r.n_unfilled, float(r.position), float(r.cash)) == (3, 1, 0, 0, 2.0, 800.0)
    assert r.total_return == pytest.approx(-0.002) and r.max_drawdown == pytest.approx(998 / 1020 - 1)


def test_adjusted_prices(spark):
    acts = spark.createDataFrame([("A", dt.date(2026, 8, 4), "SPLIT", 2.0), ("A", dt.date(2026, 8, 5), "BONUS", 3.0), ("A", dt.date(2026, 8, 4), "DIVIDEND", 9.0)], "symbol string, ex_date date, action_type string, ratio double")
    own = bars(spark, [(60, 60, 60, 60)] * 4)
    assert [round(r.close, 6) for r in backtest.split_adjusted(own, acts).collect()] == [10.0] * 4
    assert [round(r.close, 6) for r in backtest.split_adjusted(own, acts, point_in_time=True).orderBy("ts").collect()] == [10.0, 20.0, 60.0, 60.0]


def test_risk_checks_run_in_order_and_refused_orders_move_nothing(spark):
    rows = [("BUY", 6.0, 10.0), ("BUY", 1.0, 200.0), ("SELL", 8.0, 10.0), ("SELL", 6.0, 4.0), ("BUY", 1.0, 4.0), ("BUY", 1.0, 4.0)]
    orders = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=i), i, "A", s, q, p) for i, (s, q, p) in enumerate(rows)], "account string, ts timestamp_ntz, n long, symbol string, side string, quantity double, price double")
    limits = execution.Limits(short_allowed=False, order_value=150.0, daily_loss=100.0, drawdown=0.3, orders_per_minute=3)
    got = execution.risk_checks(orders, 100.0, limits).orderBy("n").collect()
    # the third sells more than is held; the fourth realises a loss of 36, which is a drawdown of more than 0.3 for the fifth and sixth
    assert [(r.refused, r.cash, r.position) for r in got] == [(None, 40.0, 6.0), ("order value", 40.0, 6.0), ("short", 40.0, 6.0), (None, 64.0, 0.0), ("drawdown", 64.0, 0.0), ("drawdown", 64.0, 0.0)]
    quick = execution.risk_checks(orders.filter("n in (0, 3, 4, 5)"), 100.0, execution.Limits(orders_per_minute=3)).orderBy("n").collect()
    assert [r.refused for r in quick] == [None, None, None, "order rate"]
