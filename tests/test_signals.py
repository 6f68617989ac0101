import datetime as dt

from barloom.plans import signals
from pyspark.sql import functions as F

T0 = dt.datetime(2026, 8, 5, 9)


def bars(spark, closes):
    rows = [("A", T0 + dt.timedelta(hours=i), c, c + 1, c - 1, c, 10.0) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_supertrend_flips_alternate(spark):
    closes = [100 + i for i in range(30)] + [130 - 2 * i for i in range(30)] + [70 + 2 * i for i in range(30)]
    sides = [r.side for r in signals.supertrend_flip(bars(spark, closes)).orderBy("ts").collect()]
    assert len(sides) >= 2 and all(a != b for a, b in zip(sides, sides[1:]))


def test_chain_finds_changes(spark):
    events = spark.createDataFrame([("k", i, f"p{i}") for i in range(10)], "key string, n long, payload string")
    chain = signals.event_chain(events).cache()
    assert signals.broken_links(chain).count() == 0
    assert [r.n for r in signals.broken_links(chain.withColumn("payload", F.when(F.col("n") == 4, "x").otherwise(F.col("payload")))).collect()] == [4]


def test_ribbon_needs_order(spark):
    rows = signals.run_strategy(bars(spark, [100 + i for i in range(60)] + [157]), "ema-ribbon-pullback", l1=3, l2=5, l3=8, l4=13).collect()
    assert [r.side for r in rows] == ["BUY"]
