import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from barloom import functions as fn
from barloom import sources
from barloom.plans import signals
from barloom.streaming import quiet_symbols, revised_bars, tail_pusher


def test_json_store_keeps_one_row_a_stamp(spark, tmp_path):
    t = dt.datetime(2026, 8, 5, 9, 15)
    df = spark.createDataFrame([("A", "NSE", "equity", "1m", t, 1.0, 2.0, 1.0, 2.0, v) for v in (5, 9)] + [("A", "NSE", "equity", "1m", t + dt.timedelta(minutes=1), 1.0, 2.0, 1.0, 2.0, 1)], sources.BARS)
    sources.write_json_bars(df, str(tmp_path / "j"))
    rows = sources.read_json_bars(spark, str(tmp_path / "j")).orderBy("timestamp").collect()
    assert [r.volume for r in rows] == [9, 1]
    assert sources.read_json_bars(spark, str(tmp_path / "j"), start="2026-08-05 09:16:00").count() == 1


def test_broken_files_are_listed(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    (tmp_path / "x" / "bad.parquet").write_bytes(b"nothing")
    assert [os.path.basename(r.path) for r in sources.unreadable_files(spark, str(tmp_path)).collect()] == ["bad.parquet"]


def test_quiet_symbols_are_reported(spark, tmp_path):
    day = dt.datetime(2026, 8, 5, 10)
    for k, rows in enumerate([[("A", 0), ("B", 0)], [("B", 600)], [("B", 1200)]]):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({"symbol": s, "ts": (day + dt.timedelta(seconds=x)).isoformat() + "Z"}) for s, x in rows))
        os.utime(tmp_path / f"{k}.json", (1000 + k, 1000 + k))
    stream = spark.readStream.schema("symbol string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = quiet_symbols(stream).writeStream.format("memory").queryName("quiet_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert "A" in {r.symbol for r in spark.table("quiet_out").collect()}


def test_the_last_write_of_a_stamp_wins(spark, tmp_path):
    t, path = dt.datetime(2026, 8, 5, 9, 15), str(tmp_path / "j")
    one = lambda v: spark.createDataFrame([("A", "NSE", "equity", "1m", t, 1.0, 2.0, 1.0, 2.0, v)], sources.BARS)
    sources.write_json_bars(one(9), path)
    for f in (tmp_path / "j").rglob("*.json"):
        os.utime(f, (1000, 1000))
    sources.write_json_bars(one(5), path)
    assert [r.volume for r in sources.read_json_bars(spark, path).collect()] == [5]


def test_upsert_rewrites_the_months_it_touches(spark, tmp_path):
    root = str(tmp_path / "lake")
    row = lambda s, month, v: (s, "NSE", "equity", "1m", dt.datetime(2026, month, 5, 9, 15), 1.0, 2.0, 1.0, 2.0, v)
    frame = lambda *rows: spark.createDataFrame(list(rows), sources.BARS)
    assert sources.upsert_lake(spark, root, frame(row("A", 8, 1), row("A", 6, 2), row("B", 8, 3))) == 3
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "lake").rglob("*.parquet")}
    assert sources.upsert_lake(spark, root, frame(row("A", 8, 7))) == 1
    rows = sources.read_lake(spark, root).orderBy("symbol", "timestamp").collect()
    assert [(r.symbol, r.timestamp.month, r.volume) for r in rows] == [("A", 6, 2), ("A", 8, 7), ("B", 8, 3)]
    assert sum(f.exists() for f in before) == 2 and not list(tmp_path.glob("lake-staged*"))


def test_quarantine_moves_and_names_broken_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    (tmp_path / "x" / "bad.parquet").write_bytes(b"nothing at all, truly")
    moved = sources.quarantine(spark, str(tmp_path / "x"), str(tmp_path / "aside"))
    assert [os.path.basename(p) for p in moved] == ["bad.parquet"] and spark.read.parquet(str(tmp_path / "x")).count() == 3
    assert len(list((tmp_path / "aside").rglob("bad.parquet"))) == 1


def test_universes_and_schemas(spark, tmp_path):
    (tmp_path / "few.csv").write_text("Symbol,Series\nA,EQ\nB,BE\nC,XX\n")
    assert [tuple(r) for r in sources.read_universes(spark, str(tmp_path)).collect()] == [("few", 2)]
    assert [tuple(r) for r in sources.schema_of({"v": spark.range(1)}, "v").collect()] == [("id", "bigint")]
    with pytest.raises(ValueError):
        sources.schema_of({}, "w")


def test_nearest_strikes(spark):
    chain = spark.createDataFrame([("A", float(x)) for x in (90, 100, 110)] + [("B", 5.0)], "underlying string, strike double")
    refs = spark.createDataFrame([("A", 1, 104.0), ("A", 2, 105.0), ("A", 3, 111.0), ("A", 4, 1.0), ("A", 5, 100.0), ("C", 6, 1.0)], "underlying string, n int, reference double")
    assert {r.n: r.strike for r in sources.nearest_strikes(chain, refs).collect()} == {1: 100.0, 2: 100.0, 3: 110.0, 4: 90.0, 5: 100.0}


def _streamed(spark, tmp_path, batches, build, name):
    day = dt.datetime(2026, 8, 5, 10)
    for k, rows in enumerate(batches):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({"event_id": 100 * k + i, "symbol": "A", "ts": (day + dt.timedelta(seconds=x)).isoformat() + "Z", "price": p, "volume": v, "event": e}) for i, (x, p, v, e) in enumerate(rows)))
        os.utime(tmp_path / f"{k}.json", (1000 + k, 1000 + k))
    stream = spark.readStream.schema("event_id long, symbol string, ts timestamp, price double, volume double, event string").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_booked_bars_are_not_revised_and_sessions_are_flushed(spark, tmp_path):
    batches = [
        [(0, 10.0, 5.0, "seed"), (30, 11.0, 1.0, "tick")], [(61, 12.0, 1.0, "tick"), (59, 13.0, 2.0, "tick")], [(10, 0.0, 0.0, "fill"), (58, 14.0, 1.0, "tick")], [(90, 0.0, 0.0, "flush"), (70, 15.0, 4.0, "tick")],
    ]
    rows = _streamed(spark, tmp_path, batches, lambda s: revised_bars(s, 60, 60), "booked_out")
    got = [(r.ts.minute, r.revision, r.close, r.volume, r.dropped) for r in rows]
    # the seeded bar closes with 6, is revised once, and is booked before the third batch's late tick
    assert got == [(0, 0, 11.0, 6.0, None), (0, 1, 13.0, 8.0, None), (0, 0, 14.0, 1.0, "booked_fill"), (1, 0, 12.0, 1.0, None), (1, 1, 15.0, 5.0, None)]


def test_tails_are_pushed_for_the_symbols_of_a_batch(spark, tmp_path):
    seen = []
    push = tail_pusher(str(tmp_path / "history"), {"ema": {"length": 3}}, lambda df, n: seen.append((n, [(r.symbol, r.value) for r in df.orderBy("symbol", "ts").collect()])))
    bar = lambda s, i, c: (s, dt.datetime(2026, 8, 5, 10, i), c, c, c, c, 1.0)
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    push(spark.createDataFrame([bar("A", i, float(i)) for i in range(3)] + [bar("B", 0, 9.0)], schema), 0)
    push(spark.createDataFrame([bar("A", 3, 5.0)], schema), 1)
    push(spark.createDataFrame([bar("A", 3, 5.0)], schema), 1)
    assert seen[1] == seen[2] == (1, [("A", 3.0)]) and seen[0][1][2] == ("A", 1.0)


def test_windows_fall_back_for_missing_symbols(spark):
    t = dt.datetime(2026, 8, 5, 9, 15)
    row = lambda s, v: (s, "NSE", "equity", "1m", t, 1.0, 2.0, 1.0, 2.0, v)
    lake, asked = spark.createDataFrame([row("A", 1)], sources.BARS), []

    def broker(symbols):
        asked.append(symbols)
        return spark.createDataFrame([row("A", 9), row("B", 2)], sources.BARS)

    bounds = ("2026-08-05 09:00:00", "2026-08-05 10:00:00")
    got = sources.load_window(lake, *bounds, ["A", "B", "C"], broker).orderBy("symbol").collect()
    assert [(r.symbol, r.volume, r.origin) for r in got] == [("A", 1, "lake"), ("B", 2, "fallback")] and asked == [["B", "C"]]
    assert sources.load_window(lake, *bounds, ["A"], broker).count() == 1 and len(asked) == 1
    assert sources.load_window(lake, *bounds, ["B"]).count() == 0


def test_instrument_keys(spark):
    keys = ["nse:abc", "NFO:XYZ:20260827:1500:CE", "NFO:XYZ:20260827", "NFO:XYZ:FUT", "NFO:XYZ:20260827:1500.5:PE", "bad", "NFO:X:2026", "NFO:X:20260827:?"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", fn.parsed_instrument(F.col("k")).alias("p")).select("k", "p.*", fn.instrument_key(F.col("p")).alias("again")).collect()
    got = {r.k: (r.asset_class, r.right, r.again) for r in rows if r.exchange}
    assert got == {
        "nse:abc": ("EQUITY", None, "NSE:ABC"), "NFO:XYZ:20260827:1500:CE": ("OPTION", "CE", "NFO:XYZ:20260827:1500:CE"), "NFO:XYZ:20260827": ("FUTURE", "FUT", "NFO:XYZ:20260827:FUT"),
        "NFO:XYZ:FUT": ("FUTURE", "FUT", "NFO:XYZ:FUT"), "NFO:XYZ:20260827:1500.5:PE": ("OPTION", "PE", "NFO:XYZ:20260827:1500.5:PE"),
    }


def test_small_functions(spark):
    row = spark.range(1).select(
        fn.bucket_price(F.lit(114.05), 0.1).alias("a"), fn.ramp_colour(F.lit(5.0), 10.0).alias("b"), fn.ramp_colour(F.lit(-50.0), 10.0).alias("c"), fn.ramp_colour(F.lit(float("nan")), 10.0).alias("d"),
        fn.is_ignored_month(F.lit(5), "1, 5,x").alias("e"), fn.is_ignored_month(F.lit(5), "").alias("f"),
    ).first()
    assert tuple(row) == (114.1, "#0899814d", "#F2374580", None, True, False)
    assert fn.parameters_digest({"a": 1, "b": [2]}) == fn.parameters_digest({"b": [2], "a": 1}) != fn.parameters_digest({"a": 2})


def test_chains_are_replayed_only_if_whole(spark):
    chain = signals.event_chain(spark.createDataFrame([("k", i, f"p{i}") for i in range(10)], "key string, n long, payload string")).cache()
    assert [r.n for r in signals.replay(chain, after=6).orderBy("n").collect()] == [7, 8, 9]
    assert [(r.n, r.place) for r in signals.snapshots(chain, 4).orderBy("n").collect()] == [(3, 4), (7, 8)]
    with pytest.raises(Exception, match="broken link in k at 4"):
        signals.replay(chain.withColumn("payload", F.when(F.col("n") == 4, "x").otherwise(F.col("payload")))).collect()
