import datetime as dt

import numpy as np
import pytest

from barloom import operators
from barloom.operators import scans, transforms

DAY = dt.datetime(2026, 7, 15, 9, 15)


def bars(spark, n=120, seed=3, symbols=("A", "B")):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        close = 100 + rng.normal(size=n).cumsum()
        close[n // 3 : n // 2] = close[n // 3]  # a flat run
        for i, c in enumerate(close):
            wide = 0.0 if n // 3 <= i < n // 2 else abs(rng.normal())
            rows.append((s, DAY + dt.timedelta(minutes=i), float(c), float(c + wide), float(c - wide), float(c), 0.0 if i in (50, 51) else float(rng.integers(1000, 5000))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"), rows


def test_every_indicator_runs_and_keeps_rows(spark):
    df, rows = bars(spark, 60)
    for name in operators.indicator_ids():
        found = operators.indicator(df, name)
        assert found.count() == len(rows), name
        assert not [c for c in found.columns[2:] if found.filter(f"isnan(`{c}`)").count()] if name in ("cci", "rsi", "adx") else True


def test_sma_is_null_until_defined(spark):
    df, rows = bars(spark, 30, symbols=("A",))
    got = [r["value"] for r in operators.indicator(df, "sma", length=5).orderBy("ts").collect()]
    close = [r[5] for r in rows]
    assert got[:4] == [None] * 4
    assert np.allclose(got[4:], [np.mean(close[i - 4 : i + 1]) for i in range(4, 30)])


def test_ema_starts_with_the_mean(spark):
    df, rows = bars(spark, 30, symbols=("A",))
    got = [r["value"] for r in operators.indicator(df, "ema", length=6).orderBy("ts").collect()]
    close = [r[5] for r in rows]
    value = np.mean(close[:6])
    for i in range(6, 30):
        value += 2 / 7 * (close[i] - value)
        assert got[i] == pytest.approx(value)
    assert got[4] is None and got[5] == pytest.approx(np.mean(close[:6]))


def test_rsi_recovers_after_a_start_without_losses():
    x = np.concatenate([np.arange(20.0), [18, 17, 19, 16]])
    got = scans.rsi(x, 14)
    assert got[14] == 100 and got[19] == 100 and got[-1] < 100


def test_aroon_keeps_the_newest_of_equal_extremes(spark):
    rows = [("A", DAY + dt.timedelta(minutes=i), 5.0, 10.0, 1.0, 5.0, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    last = operators.indicator(df, "aroon", length=4).orderBy("ts").collect()[-1]
    assert last["up"] == 100 and last["down"] == 100


def test_parameters_are_checked(spark):
    df, _ = bars(spark, 5)
    for name in ("sma", "ema"):
        with pytest.raises(ValueError):
            operators.indicator(df, name, lenght=3)
    with pytest.raises(ValueError):
        operators.indicator(df, "nothing")
    assert operators.indicator(df, "sma", length=None).count() == 10


def test_scans_share_one_pass(spark):
    df, _ = bars(spark, 40)
    both = scans.run(df, {"ema": {"length": 5}, "rsi": {}})
    assert both.columns == ["symbol", "ts", "ema_value", "rsi_value"]


def test_transforms_keep_times_increasing(spark):
    df, _ = bars(spark, 120)
    for name in transforms.TRANSFORMS:
        rows = transforms.run(df, name).orderBy("symbol", "n").collect()
        assert rows
        for a, b in zip(rows, rows[1:]):
            if a["symbol"] == b["symbol"]:
                assert b["epoch"] > a["epoch"]
            assert a["high"] >= max(a["open"], a["close"]) and a["low"] <= min(a["open"], a["close"])


def test_renko_bricks_have_the_box(spark):
    df, _ = bars(spark, 120)
    assert all(abs(r["close"] - r["open"]) == 2.0 for r in transforms.run(df, "renko").collect())


def test_indicators_can_be_registered(spark):
    df, rows = bars(spark, 20, symbols=("A",))
    operators.register_indicator("doubled", lambda b, factor: {"value": factor * b.c}, ("value",), factor=2.0)
    try:
        got = [r["value"] for r in operators.indicator(df, "doubled", factor=3.0).orderBy("ts").collect()]
        assert np.allclose(got, [3 * r[5] for r in rows]) and {"id": "doubled", "parameters": {"factor": 2.0}, "plots": ["value"]} in operators.catalogue()
    finally:
        del scans.SCANS["doubled"]


def test_options_that_ask_for_recurrences_are_scans(spark):
    df, _ = bars(spark, 60, symbols=("A",))
    for name, params in (("obv", {"maType": "EMA"}), ("cci", {"maType": "SMMA (RMA)"}), ("ma-ribbon", {"ma1Type": "EMA"}), ("hull-suite", {"mode": "Ehma", "length": 9}), ("standard-error-bands", {"method": "Exponential"})):
        plain, other = operators.indicator(df, name), operators.indicator(df, name, **params)
        assert plain.columns == other.columns and other.filter(f"`{other.columns[-1 if name == 'hull-suite' else 2]}` is not null").count(), name
    bands = operators.indicator(df, "vwap", showBand2=True, bandMult2=3.0, offset=1).orderBy("ts").collect()
    assert bands[0]["value"] is None and bands[5]["upper2"] - bands[5]["value"] == pytest.approx(3 * (bands[5]["upper1"] - bands[5]["value"]))
    shown = operators.indicator(df, "cpr", pivotMode="manual", showWeekly=True, displayS1R1=True)
    assert len(shown.columns) == 29
