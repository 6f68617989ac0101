"""Structured Streaming forms: bars, feed checks and late revisions.

Event time must be a TIMESTAMP for watermarks, so streams keep it in the
session's zone and bars carry it on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators import scans

TICKS = "event_id long, symbol string, ts timestamp, price double, volume double"


def read_tape(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A recorded tape of JSON lines as a stream."""
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def write_tape(ticks: DataFrame, path: str, checkpoint: str):
    """Record a stream of ticks as JSON lines."""
    return ticks.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def deduplicated(ticks: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Each event once, within the watermark."""
    return ticks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["symbol", "event_id"])


def tumbling_bars(ticks: DataFrame, every: str = "1 hour", start: str = "0 minutes") -> DataFrame:
    """Bars of a stream with a watermark, or of a table. Append mode gives closed bars, update mode forming ones."""
    by = F.struct("ts", "event_id")
    bars = ticks.groupBy("symbol", F.window("ts", every, every, start).alias("w")).agg(
        F.min_by("price", by).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", by).alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars"),
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n_bars")


REVISED = "symbol string, ts timestamp, revision int, close double, volume double, dropped string"
_STATE = "last_bucket long, closed_at long, revision int, close double, volume double, last_tick long, prev_bucket long, prev_close double, prev_volume double, prev_tick long, booked long"


def revised_bars(ticks: DataFrame, seconds: int = 3600, revisable_s: int = 60) -> DataFrame:
    """Bars whose last closed one may still be revised for some seconds of arrival time.

    A tick of a new bucket closes the bar before it. A tick of the closed bucket
    revises that bar if it comes within ``revisable_s`` of the closing by the
    clock of arrival (the largest event time seen), and if no fill is booked on
    that bar; else it is dropped, and the row says why.

    A column ``event`` may mark rows that aren't ticks: ``seed`` continues a bar
    that was forming (its close and volume), ``fill`` books the bar of its time,
    and ``flush`` closes the forming bar at the end of a session.
    """
    rows = ticks if "event" in ticks.columns else ticks.withColumn("event", F.lit("tick"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = list(state.get) if state.exists else [-1, -1, 0, 0.0, 0.0, -1, -1, 0.0, 0.0, -1, -1]
        out = []

        def close_forming() -> None:
            out.append((key[0], pd.Timestamp(s[0], unit="s"), 0, s[3], s[4], None))
            s[6], s[7], s[8], s[9] = s[0], s[3], s[4], s[5]

        for pdf in frames:
            for row in pdf.sort_values("event_id").itertuples():
                t = int(row.ts.timestamp())
                b = t // seconds * seconds
                clock = max(s[5], t)
                if row.event == "fill":
                    s[10] = max(s[10], b)
                    continue
                if row.event == "flush":
                    if s[0] >= 0 and s[0] != s[6]:
                        close_forming()
                        s[1], s[2] = clock, 0
                    s[5] = clock
                    continue
                if row.event == "seed":
                    if b > s[0]:
                        s[0], s[1], s[2], s[3], s[4] = b, t, 0, row.price, row.volume
                elif b > s[0]:
                    if s[0] >= 0 and s[0] != s[6]:
                        close_forming()
                    s[0], s[1], s[2], s[3], s[4] = b, t, 0, row.price, row.volume
                elif b == s[0] and b != s[6]:
                    s[4] += row.volume
                    if t >= s[5]:
                        s[3] = row.price
                elif b == s[6] and s[10] >= b:
                    out.append((key[0], pd.Timestamp(b, unit="s"), 0, row.price, row.volume, "booked_fill"))
                elif b == s[6] and clock - s[1] <= revisable_s:
                    s[2] += 1
                    s[8] += row.volume
                    if t >= s[9]:
                        s[7], s[9] = row.price, t
                    out.append((key[0], pd.Timestamp(b, unit="s"), s[2], s[7], s[8], None))
                else:
                    out.append((key[0], pd.Timestamp(b, unit="s"), 0, row.price, row.volume, "window_expired" if b == s[6] else "stale"))
                s[5] = clock
        state.update(tuple(s))
        yield pd.DataFrame(out, columns=["symbol", "ts", "revision", "close", "volume", "dropped"])

    return rows.groupBy("symbol").applyInPandasWithState(run, REVISED, _STATE, "append", GroupStateTimeout.NoTimeout)


def dropped_counts(revised: DataFrame) -> DataFrame:
    """How many ticks of each symbol were dropped, by reason; for the rows of ``revised_bars`` once they are written."""
    return revised.filter("dropped is not null").groupBy("symbol", "dropped").agg(F.count(F.lit(1)).alias("n"))


def tail_pusher(history: str, wanted: dict[str, dict], emit: Callable[[DataFrame, int], None], keep: int = 500) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over closed bars: it adds them to ``history`` and gives ``emit`` the indicators of their symbols' latest bars.

    Only the symbols of a batch are read, and of each the last ``keep`` bars. A
    batch that comes again replaces what it had written.
    """

    def push(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        own = batch.select("symbol", "ts", "open", "high", "low", "close", "volume")
        own.write.mode("overwrite").parquet(f"{history.rstrip('/')}/batch={number}")
        changed = own.groupBy("symbol").agg(F.min("ts").alias("since"))
        rows = spark.read.parquet(history).drop("batch").join(F.broadcast(changed.select("symbol")), "symbol", "left_semi")
        newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
        rows = rows.withColumn("_r", newest).filter(F.col("_r") <= keep).drop("_r").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        found = scans.run(rows, wanted)
        emit(found.join(F.broadcast(changed.withColumn("since", F.col("since").cast("timestamp_ntz"))), "symbol").filter("ts >= since").drop("since"), number)

    return push


def latest_marks(ticks: DataFrame) -> DataFrame:
    """The latest price of each symbol; stale ticks don't overwrite it."""
    return ticks.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "event_id")).alias("mark"), F.max("ts").alias("ts"))


QUIET = "symbol string, quiet_from timestamp"


def quiet_symbols(ticks: DataFrame, seconds: int = 180, lateness: str = "1 minute") -> DataFrame:
    """A row for each symbol that has had no tick for ``seconds`` of event time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"symbol": [key[0]], "quiet_from": [pd.Timestamp(last, unit="ms")]})
            return
        last = max((int(x.timestamp() * 1000) for pdf in frames for x in pdf["ts"]), default=0)
        if state.exists:
            last = max(last, state.get[0])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + 1000 * seconds, state.getCurrentWatermarkMs() + 1))

    watched = ticks.withWatermark("ts", lateness).groupBy("symbol")
    return watched.applyInPandasWithState(run, QUIET, "last long", "append", GroupStateTimeout.EventTimeTimeout)
