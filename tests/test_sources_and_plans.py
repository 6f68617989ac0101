import datetime as dt
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom import functions as fn
from barloom import sources
from barloom.plans import guard, research
from barloom.streaming import deduplicated, revised_bars, tumbling_bars

SF = "/root/testdata/sf0.001"


def lake_rows(spark):
    day = dt.datetime(2026, 8, 5, 9, 15)
    rows = [(s, "NSE", "equity", "1m", day + dt.timedelta(days=d, minutes=m), 10.0, 11.0, 9.0, 10.5, 100 + m) for s in ("A", "B") for d in (0, 1) for m in range(30)]
    rows += [("A", "NSE", "equity", "1m", day.replace(hour=18), 9.0, 9.0, 9.0, 9.0, 1), ("A", "NSE", "equity", "1m", day.replace(hour=10), 10.0, 9.0, 11.0, 10.0, 1)]
    return spark.createDataFrame(rows, "symbol string, exchange string, kind string, timeframe string, timestamp timestamp_ntz, open double, high double, low double, close double, volume long")


def test_lake_round_trip(spark, tmp_path):
    root = str(tmp_path / "ohlcv")
    ready = sources.prepare(lake_rows(spark))
    assert ready.count() == 120  # neither the evening bar nor the one whose high is under its low
    sources.write_lake(ready, root)
    assert sources.read_lake(spark, root).count() == 120
    assert sources.read_lake(spark, root, symbols=["A"], start="2026-08-06 00:00:00", end="2026-08-06 09:20:00").count() == 6
    assert sources.read_lake(spark, root, symbols=[]).count() == 0
    plan = sources.read_lake(spark, root, symbols=["A"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan


def test_upsert_replaces_by_key_and_the_last_wins(spark):
    old = sources.prepare(lake_rows(spark))
    new = old.filter("symbol = 'A'").limit(1)
    twice = new.withColumn("volume", F.lit(7).cast("long")).unionByName(new.withColumn("volume", F.lit(8).cast("long"))).coalesce(1)
    merged = sources.upsert(old, twice)
    assert merged.count() == 120 and merged.filter("volume = 8").count() == 1 and merged.filter("volume = 7").count() == 0


def test_grids(spark):
    at = spark.sql("SELECT TIMESTAMP_NTZ '2026-08-05 09:20:00' AS ts")
    row = at.select(fn.bucket(F.col("ts"), "30m").alias("clock"), fn.bucket(F.col("ts"), "1w").alias("week"), "ts").withColumn("session", fn.bucket(F.col("ts"), "30m", "session")).first()
    assert (row.clock.minute, row.session.minute, row.week.day) == (0, 15, 3)
    with pytest.raises(ValueError):
        fn.bucket(F.col("ts"), "7m")


def test_conditions_never_match_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert df.filter(fn.compare(F.col("x"), ">", 0.5)).count() == 1
    assert df.filter(fn.compare(F.col("x"), "~", 0.5)).count() == 0 and df.filter(fn.compare(F.col("x"), ">", None)).count() == 0


def test_guard(spark):
    views = {"ohlcv": spark.range(5)}
    assert guard.answer(spark, "SELECT * FROM ohlcv", views, limit=3).truncated
    assert not guard.answer(spark, "SELECT * FROM (SELECT id FROM ohlcv) x", views).truncated
    for bad in ("DROP TABLE ohlcv", "SELECT * FROM other", "SELECT * FROM parquet.`/x`", "SELECT 1; SELECT 2", "SELECT (SELECT max(id) FROM secret) FROM ohlcv", "SELECT * FROM range(3)", "INSERT INTO ohlcv SELECT 1", "SELECT * FROM ohlcv, hidden"):
        with pytest.raises(guard.GuardError):
            guard.guarded(spark, bad, views)


def test_guard_resolves_names_by_scope_and_functions_by_list(spark):
    views = {"ohlcv": spark.range(5)}
    spark.range(1).createOrReplaceTempView("secret")
    hidden = "SELECT s.id FROM secret s, (WITH secret AS (SELECT 1 AS one) SELECT * FROM secret) x"
    calls = [f"SELECT {f} FROM ohlcv" for f in ("java_method('java.lang.System', 'getProperty', 'user.home')", "reflect('java.util.UUID', 'randomUUID')", "input_file_name()", "current_user()", "my_own(id)")]
    early = "WITH a AS (SELECT * FROM b), b AS (SELECT * FROM ohlcv) SELECT * FROM a"
    for bad in (hidden, early, *calls, "SELECT (SELECT max(id) FROM (WITH x AS (SELECT * FROM secret) SELECT * FROM x)) FROM ohlcv", "SELECT id FROM ohlcv WHERE length(reflect('java.util.UUID', 'randomUUID')) > 1"):
        with pytest.raises(guard.GuardError):
            guard.guarded(spark, bad, views)
    fine = "WITH a AS (SELECT id FROM ohlcv), b AS (SELECT max(id) AS m FROM a) SELECT a.id, round(b.m / 2.0, 1) AS h FROM a, b WHERE a.id IN (WITH c AS (SELECT id FROM a) SELECT id FROM c)"
    assert guard.guarded(spark, fine, views).count() == 5


def test_answers_count_all_rows_and_end_in_time(spark):
    views = {"ohlcv": spark.range(50)}
    cut = guard.answer(spark, "SELECT * FROM ohlcv", views, limit=3, fingerprint="f")
    assert (len(cut.rows), cut.truncated, cut.total, cut.fingerprint) == (3, True, 50, "f")
    whole = guard.answer(spark, "SELECT * FROM ohlcv", views)
    assert (len(whole.rows), whole.truncated, whole.total) == (50, False, 50)
    with pytest.raises(guard.GuardError, match="more than"):
        guard.answer(spark, "SELECT * FROM ohlcv", views, limit=3, require_complete=True)
    slow = {"ohlcv": spark.range(0, 1 << 40, 1, 4)}
    with pytest.raises(guard.GuardError, match="took more"):
        guard.answer(spark, "SELECT count(*) AS n FROM ohlcv WHERE sha2(CAST(id AS STRING), 256) = 'x'", slow, timeout=1.5)


def test_ledger_and_trips(spark):
    rows = [("A", 1, 10, 5), ("A", 2, 10, 7), ("A", 3, -5, 8), ("A", 4, -25, 9), ("A", 5, 10, 4)]
    fills = spark.createDataFrame(rows, "symbol string, n long, quantity int, price int").selectExpr("symbol", "n", "CAST(quantity AS decimal(20,4)) AS quantity", "CAST(price AS decimal(20,4)) AS price")
    got = [(float(r.position), float(r.average), float(r.realised)) for r in research.position_ledger(fills).orderBy("n").collect()]
    assert got == [(10, 5, 0), (20, 6, 0), (15, 6, 10), (-10, 9, 55), (0, 0, 105)]
    assert [float(r.pnl) for r in research.flat_to_flat(research.position_ledger(fills)).collect()] == [105.0]


def test_dtw():
    a = research.z_normal(np.arange(10.0))
    assert research.dtw(a, a, 2) == 0 and research.dtw(a, research.z_normal(5 * np.arange(10.0) + 3), 2) < 1e-12
    assert not research.z_normal(np.ones(4)).any()
    assert research.expected_best_sharpe(1, 1.0) is None and research.expected_best_sharpe(10, 1.0) > 1


def test_stream_equals_batch_on_closed_buckets(spark, tmp_path):
    base = dt.datetime(2026, 8, 5, 9, 15)
    rows = [{"event_id": i, "symbol": "AB"[i % 2], "ts": (base + dt.timedelta(minutes=7 * i)).isoformat() + "Z", "price": 100 + math.sin(i), "volume": 1.0} for i in range(100)]
    for k in range(4):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[25 * k : 25 * k + 25] + rows[25 * k : 25 * k + 3]))
        os.utime(tmp_path / f"{k}.json", (1000 + k, 1000 + k))  # files are read in this order
    schema = "event_id long, symbol string, ts timestamp, price double, volume double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = tumbling_bars(deduplicated(stream)).writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    batch = tumbling_bars(spark.read.schema(schema).json(str(tmp_path / "*.json")).dropDuplicates(["event_id"])).collect()
    got = spark.table("bars_out").collect()
    assert len(got) >= len(batch) - 4 and set(map(tuple, got)) <= set(map(tuple, batch))


def test_late_ticks_revise_then_expire(spark, tmp_path):
    day = dt.datetime(2026, 8, 5, 10)
    times = [(0, 1), (1800, 2), (3600, 3), (3550, 4), (3700, 5), (3580, 6)]
    lines = [json.dumps({"event_id": i, "symbol": "A", "ts": (day + dt.timedelta(seconds=s)).isoformat() + "Z", "price": float(p), "volume": 1.0}) for i, (s, p) in enumerate(times)]
    (tmp_path / "a.json").write_text("\n".join(lines))
    stream = spark.readStream.schema("event_id long, symbol string, ts timestamp, price double, volume double").json(str(tmp_path))
    q = revised_bars(stream).writeStream.format("memory").queryName("revised_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = sorted((r.revision, r.close, r.dropped or "") for r in spark.table("revised_out").collect())
    assert got == [(0, 2.0, ""), (0, 6.0, "window_expired"), (1, 4.0, "")]


def test_interval_merge_joins_equal_spans(spark, tmp_path):
    from barloom import registry

    rng, day, span = np.random.default_rng(5), dt.datetime(1999, 1, 1), dt.timedelta(days=20)
    orders = [(None if k == 0 else k, day + dt.timedelta(days=int(d))) for k in range(300) for d in rng.integers(0, 300, 8) for _ in range(int(rng.integers(1, 4)))]
    orders += [(400, day), (400, day + span), (400, day + span), (401, None), (401, None), (401, day)]  # ends that touch are one span, a missing date is one of its own
    spark.createDataFrame(orders, "o_custkey long, o_orderdate timestamp_ntz").repartition(7).write.parquet(str(tmp_path / "orders.parquet"))
    want = []
    for k, lo in sorted(orders, key=lambda o: (o[0] or 0, o[1] or dt.datetime.min)):
        if lo is None:
            want.append([k, None, None, 1])
        elif want and want[-1][0] == k and want[-1][2] and want[-1][2] >= lo:
            want[-1][2:] = [lo + span, want[-1][3] + 1]
        else:
            want.append([k, lo, lo + span, 1])
    got = registry.QUERIES["interval_merge"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(list, got))) == sorted(map(str, want))


def test_monte_carlo_has_all_its_paths(spark):
    from barloom import registry

    rows = registry.QUERIES["monte_carlo"](spark, SF).groupBy("symbol").count().collect()
    assert rows and {r["count"] for r in rows} == {1000}


def test_entry_and_every_core_query_runs(spark):
    from barloom import registry

    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    for name in ("resample_session_30m", "screener", "round_trips_fifo", "tf_kagi", "monte_carlo"):
        registry.QUERIES[name](spark, SF).collect()
