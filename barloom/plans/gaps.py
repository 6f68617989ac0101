"""Missing bars of trading sessions, as runs, without laying out the grid that they are missing from.

Every stamp of the sessions in a window has a number: trading days in order, and
stamps within a day. A bar's number follows from its time, so a gap is a jump
between a symbol's consecutive numbers. That costs one ordered pass over the bars
there are; only the calendar, one row a day, is built.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.schema import SESSION_CLOSE, SESSION_OPEN

#: A run at least this long is a whole session.
SESSION_RUN_S = 300 * 60


class Sessions:
    """The stamps of weekday sessions between two times, both included, on a grid of ``step`` seconds."""

    def __init__(self, start: dt.datetime, end: dt.datetime, step: int, holidays: frozenset[dt.date] = frozenset()) -> None:
        def floor(t: dt.datetime) -> dt.datetime:
            return t - dt.timedelta(seconds=(t - dt.datetime(1970, 1, 1)).total_seconds() % step)

        start, end = floor(start), floor(end)
        self.step, self.per_day = step, (SESSION_CLOSE - SESSION_OPEN) // step + 1
        n = (end.date() - start.date()).days + 1
        every = (start.date() + dt.timedelta(days=i) for i in range(max(0, n)))
        self.days = [d for d in every if d.weekday() < 5 and d not in holidays]
        self.first, self.last = self._number(start, True), self._number(end, False)

    def _number(self, t: dt.datetime, up: bool) -> int:
        """The number of the first stamp at or after ``t``, or of the last one at or before it."""
        if not self.days:
            return 0 if up else -1
        before = sum(d < t.date() for d in self.days)
        if t.date() not in self.days:
            return before * self.per_day - (0 if up else 1)
        seconds = (t - dt.datetime.combine(t.date(), dt.time())).total_seconds() - SESSION_OPEN
        at = -(-seconds // self.step) if up else seconds // self.step
        return before * self.per_day + int(min(max(at, 0), self.per_day) if up else min(max(at, -1), self.per_day - 1))

    def calendar(self, spark: SparkSession) -> DataFrame:
        """day and its number, one row a trading day; its size is that of the window's calendar."""
        return F.broadcast(spark.createDataFrame(list(zip(self.days, range(len(self.days)))), "day date, k int"))


def _numbered(bars: DataFrame, sessions: Sessions) -> DataFrame:
    """symbol and number of the bars that lie on the grid."""
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts") - SESSION_OPEN
    rows = bars.select("symbol", F.to_date("ts").alias("day"), second.alias("s")).filter((F.col("s") >= 0) & (F.col("s") % sessions.step == 0) & (F.col("s") / sessions.step < sessions.per_day))
    rows = rows.join(sessions.calendar(bars.sparkSession), "day")
    number = F.col("k").cast("long") * sessions.per_day + (F.col("s") / sessions.step).cast("long")
    return rows.select("symbol", number.alias("i")).filter(F.col("i").between(sessions.first, sessions.last)).distinct()


def missing_runs(bars: DataFrame, symbols: DataFrame, sessions: Sessions) -> DataFrame:
    """symbol, k (the day's number), a and b: the first and last missing number of each run; a run ends with its day."""
    order = Window.partitionBy("symbol").orderBy("i")
    rows = symbols.select("symbol").distinct().join(_numbered(bars, sessions), "symbol", "left")
    rows = rows.withColumns({"before": F.coalesce(F.lag("i").over(order), F.lit(sessions.first - 1)), "newest": F.lead("i").over(order).isNull()})
    upto = F.coalesce(F.col("i"), F.lit(sessions.last + 1))  # a symbol without a bar
    end = F.lit(sessions.last).cast("long")
    spans = [F.struct((F.col("before") + 1).alias("a"), (upto - 1).alias("b")), F.struct(F.when(F.col("newest"), upto + 1).alias("a"), end.alias("b"))]
    each = rows.select("symbol", F.explode(F.array(*spans)).alias("r")).select("symbol", "r.*").filter("a <= b")
    n = sessions.per_day
    days = each.select("symbol", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / n), F.floor(F.col("b") / n))).alias("k"))
    return days.select("symbol", F.col("k").cast("int").alias("k"), F.greatest("a", F.col("k") * n).alias("a"), F.least("b", F.col("k") * n + n - 1).alias("b"))


def scan(bars: DataFrame, symbols: DataFrame, sessions: Sessions, min_gap_stamps: int = 1, include_open: bool = False) -> tuple[DataFrame, DataFrame]:
    """Gaps worth a repair (symbol, gap_start, gap_end, n_missing), and a row for each symbol on what else is missing.

    A session's last stamp isn't a gap, nor is its first one unless
    ``include_open``. Runs of fewer than ``min_gap_stamps`` are only counted.
    """
    runs = missing_runs(bars, symbols, sessions)
    n = sessions.per_day
    opens, closes = F.greatest(F.lit(sessions.first).cast("long"), F.col("k") * n), F.least(F.lit(sessions.last).cast("long"), F.col("k") * n + n - 1)
    runs = runs.withColumns({"no_open": F.col("a") == opens, "no_close": F.col("b") == closes})
    a = F.col("a") + (F.lit(0) if include_open else F.col("no_open").cast("int"))
    inner = runs.withColumns({"a": a, "b": F.col("b") - F.col("no_close").cast("int")}).withColumn("n_missing", F.greatest(F.lit(0), F.col("b") - F.col("a") + 1))
    kept = inner.filter((F.col("n_missing") >= min_gap_stamps) & (F.col("n_missing") > 0)).join(sessions.calendar(bars.sparkSession), "k")

    def stamp(i: str) -> Column:
        seconds = ((F.col(i) % n) * sessions.step + SESSION_OPEN).cast("int")
        return F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))

    gaps = kept.select("symbol", stamp("a").alias("gap_start"), stamp("b").alias("gap_end"), "n_missing")
    small = (F.col("n_missing") > 0) & (F.col("n_missing") < min_gap_stamps)
    summary = inner.groupBy("symbol").agg(
        F.sum(F.col("no_open").cast("int")).alias("open_missing"), F.sum(F.col("no_close").cast("int")).alias("close_missing"),
        F.sum(F.when(small, F.col("n_missing")).otherwise(0)).alias("sub_threshold_stamps"), (F.max("n_missing") == 0).alias("edge_only"),
    )
    return gaps, summary


def merged(ranges: DataFrame, step: int) -> DataFrame:
    """Ranges (symbol, gap_start, gap_end) of a symbol that overlap or touch within ``step`` seconds, as one."""
    order = Window.partitionBy("symbol").orderBy("gap_start", "gap_end")
    reached = F.max("gap_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce((F.col("gap_start") > reached + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(step).cast("decimal(18,6)"))).cast("int"), F.lit(1))
    numbered = ranges.withColumn("_s", starts).withColumn("_g", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("symbol", "_g").agg(F.min("gap_start").alias("gap_start"), F.max("gap_end").alias("gap_end")).drop("_g")


def clipped(ranges: DataFrame, cap: dt.datetime, last_stamp: int = SESSION_CLOSE - 960, step: int = 60) -> DataFrame:
    """Ranges cut to weekday sessions up to ``last_stamp`` (15:14) of each day and to ``cap``, one a day, then merged."""
    days = ranges.select("symbol", "gap_start", "gap_end", F.explode(F.sequence(F.to_date("gap_start"), F.to_date("gap_end"))).alias("day")).filter(F.weekday("day") < 5)

    def at(second: int) -> Column:
        return F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(second).cast("decimal(18,6)"))

    low, high = F.greatest("gap_start", at(SESSION_OPEN)), F.least(F.col("gap_end"), at(last_stamp), F.lit(cap).cast("timestamp_ntz"))
    return merged(days.select("symbol", low.alias("gap_start"), high.alias("gap_end")).filter("gap_start <= gap_end"), step)


def repair_order(gaps: DataFrame, step: int) -> DataFrame:
    """A row for each symbol with the kind of its gaps and its place in the queue.

    Holes within a day (0) come before whole missing sessions (1), and those
    before bare first stamps (2); within a kind, the most stamps come first.
    """
    seconds = (F.unix_micros(F.col("gap_end").cast("timestamp")) - F.unix_micros(F.col("gap_start").cast("timestamp"))) / 1_000_000
    at_open = (F.hour("gap_start") * 3600 + F.minute("gap_start") * 60 + F.second("gap_start")) == SESSION_OPEN
    rows = gaps.withColumns({"_bare": (seconds == 0) & at_open, "_whole": seconds >= SESSION_RUN_S, "_n": F.floor(seconds / step) + 1})
    kinds = rows.groupBy("symbol").agg(F.when(F.min("_bare"), 2).when(F.max("_whole"), 1).otherwise(0).alias("kind"), F.sum("_n").alias("n_stamps"))
    return kinds.withColumn("place", F.row_number().over(Window.orderBy("kind", F.desc("n_stamps"), "symbol")))  # one row a symbol
