"""Parameterised screens over bars: resampling, relative strength, the morning screen and breadth, bounded in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import bucket

NUDGE = 3.7e-10


def near(x: Column, places: int) -> Column:
    return F.round(x + NUDGE, places)


def bounded(bars: DataFrame, start: str | None = None, end: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Bars between inclusive bounds, of some symbols; an empty list gives none, None all."""
    for bound, after in ((start, True), (end, False)):
        if bound is not None:
            at = F.lit(bound).cast("timestamp_ntz")
            bars = bars.filter(F.col("ts") >= at if after else F.col("ts") <= at)
    if symbols is None:
        return bars
    return bars.filter(F.col("symbol").isin(symbols) if symbols else F.lit(False))


def resample(bars: DataFrame, timeframe: str, grid: str = "session", start: str | None = None, end: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """symbol, bucket, open, high, low, close, volume and n_bars of coarser bars, in one aggregation."""
    rows = bounded(bars, start, end, symbols)
    return rows.groupBy("symbol", bucket(F.col("ts"), timeframe, grid).alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars"),
    )


def rs_scores(
    bars: DataFrame, end: str, days: int = 20, bars_per_day: int = 25, timeframe: str = "15m", grid: str = "clock",
    ma_lens: tuple[int, int, int] = (30, 45, 60), atr_len: int = 14, symbols: list[str] | None = None,
) -> DataFrame:
    """symbol, rs_score and n_scored: how far the close and three means stand apart, in average ranges, the latest bars weighing up to four times as much.

    Buckets of fewer bars than half the shortest mean are left out. A symbol
    needs all ``days`` times ``bars_per_day`` scored buckets.
    """
    short, middle, long = (int(x) for x in ma_lens)
    n = int(days) * int(bars_per_day)
    need = n + long + 1
    rows = resample(bars, timeframe, grid, end=end, symbols=symbols).filter(F.col("n_bars") >= max(short // 2, 2))
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bucket")))
    rows = rows.withColumn("back", newest).filter(F.col("back") <= need)  # a partial rank limit runs before the shuffle
    order = Window.partitionBy("symbol").orderBy("bucket")
    before = F.lag("close").over(order)
    wide = F.col("high") - F.col("low")
    tr = F.when(before.isNull(), wide).otherwise(F.greatest(wide, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    rows = rows.withColumns({"i": F.count(F.lit(1)).over(Window.partitionBy("symbol")) - F.col("back"), "tr": tr})

    def mean(x: str, k: int) -> Column:
        return F.avg(x).over(order.rowsBetween(1 - k, 0))

    rows = rows.withColumns({"a": mean("close", short), "b": mean("close", middle), "c": mean("close", long), "atr": mean("tr", int(atr_len))})
    x = (F.col("close") - F.col("a")) + (F.col("close") - F.col("b")) + (F.col("close") - F.col("c")) + (F.col("a") - F.col("b")) + (F.col("a") - F.col("c")) + (F.col("b") - F.col("c"))
    first = need - n
    rows = rows.filter((F.col("i") >= first) & (F.col("atr") > 0)).withColumns({"x": x / F.col("atr"), "w": F.exp(F.log(F.lit(4.0)) * (F.col("i") - first + 1) / n)})
    found = rows.groupBy("symbol").agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("raw"), F.count(F.lit(1)).alias("n_scored"))
    return found.filter(F.col("n_scored") == n).select("symbol", near(F.col("raw"), 4).alias("rs_score"), "raw", "n_scored")


def morning_screen(
    bars: DataFrame, as_of: str, *, gap_min_pct: float = 0.5, vol_multiple: float = 3.0, vol_lookback_days: int = 14, pre30_min_pct: float = 0.3, adx_len: int = 14,
    adx_min: float = 20.0, atr_min_pct: float | None = 1.2, atr_max_pct: float | None = None, prev_pre30_max_pct: float = 3.0, min_open: float = 100.0, strict: bool = False,
    days: int = 20, bars_per_day: int = 25, ma_lens: tuple[int, int, int] = (30, 45, 60), atr_len: int = 14, symbols: list[str] | None = None,
    timeframe: str = "15m", grid: str = "clock", decision: str = "09:45",
) -> DataFrame:
    """The symbols that pass the screen at ``as_of``, as they stood at the ``decision`` time of its day.

    Gap, early return and early volume of the day; relative strength through the
    day before above the median of all symbols; a directional index of days
    before the last one, high enough and rising; the range of a day in percent;
    the early return of the day before. ``strict`` adds a close near the top of
    the early range and a rising balance of volume.

    Bars are aggregated to days once; all else is windows over days.
    """
    at = F.date_format("ts", "HH:mm")
    early, upto = at < decision, at <= decision
    rows = bounded(bars, None, as_of, symbols)
    daily = rows.groupBy("symbol", F.date_trunc("day", "ts").alias("d")).agg(
        F.min_by("open", "ts").alias("o"), F.max_by("close", "ts").alias("c"), F.max("high").alias("h"), F.min("low").alias("l"), F.sum("volume").alias("v"),
        F.sum(F.when(early, F.col("volume")).otherwise(0.0)).alias("v30"), F.max_by(F.when(upto, F.col("close")), F.when(upto, F.col("ts"))).alias("px"),
        F.max(F.when(upto, F.col("high"))).alias("hi"), F.min(F.when(upto, F.col("low"))).alias("lo"),
    )
    order = Window.partitionBy("symbol").orderBy("d")
    before = {k: F.lag(k).over(order) for k in ("c", "h", "l")}
    pre = 100 * (F.try_divide("px", "o") - 1)
    dates = rows.select(F.date_trunc("day", "ts").alias("d")).distinct().agg(F.sort_array(F.collect_list("d"), False).alias("dates"))  # one row, of the calendar's size
    day = daily.crossJoin(F.broadcast(dates.select(F.get("dates", F.lit(0)).alias("last_day"), F.get("dates", F.lit(1)).alias("day_before")))).withColumns({
        "pre": pre, "pc": before["c"], "ph": before["h"], "pl": before["l"],
        "newest": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d"))),
    })
    day = day.withColumn("flow", F.sum(F.when(F.col("c") > F.col("pc"), F.col("v")).when(F.col("c") < F.col("pc"), -F.col("v")).otherwise(0.0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    up, down = F.col("h") - F.col("ph"), F.col("pl") - F.col("l")
    day = day.withColumns({
        "gap_pct": near(100 * (F.try_divide("o", "pc") - 1), 3), "pre30_ret": near(F.col("pre"), 3), "prev_pre30": F.lag(near(F.col("pre"), 3)).over(order),
        "close_pos": near(F.try_divide(F.col("px") - F.col("lo"), F.col("hi") - F.col("lo")), 3),
        "v30x": near(F.try_divide(F.col("v30"), F.avg("v30").over(order.rowsBetween(-vol_lookback_days, -1))), 2),
        "flow_ok": (F.col("flow") > F.avg("flow").over(order.rowsBetween(-19, 0))) & (F.col("flow") > F.lag("flow", 5).over(order)),
        "past": F.col("d") < F.col("last_day"), "tr": F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - F.col("pc")), F.abs(F.col("l") - F.col("pc"))),
        "pdm": F.when((up > down) & (up > 0), up).otherwise(0.0), "mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })
    span = order.rowsBetween(1 - adx_len, 0)
    past = day.filter("past").withColumns({k: F.avg(x).over(span) for k, x in (("p", "pdm"), ("m", "mdm"), ("atr", "tr"))})
    pdi, mdi = F.try_divide(100 * F.col("p"), F.col("atr")), F.try_divide(100 * F.col("m"), F.col("atr"))
    past = past.withColumn("dx", F.try_divide(100 * F.abs(pdi - mdi), pdi + mdi)).withColumn("adx", F.avg("dx").over(span))
    known = past.filter("adx is not null").withColumn("adx_before", F.lag("adx").over(order)).groupBy("symbol").agg(F.max(F.struct("d", "adx", "adx_before")).alias("x")).select("symbol", "x.adx", "x.adx_before")
    ranges = past.filter("d = day_before").select("symbol", "atr", (100.0 * F.try_divide("atr", "c")).alias("atr_pct"))
    strength = rs_scores(bars, f"{as_of.split(' ')[0]} 00:00:00", days, bars_per_day, timeframe, grid, ma_lens, atr_len, symbols).select("symbol", F.col("raw").alias("rs"))
    middle = strength.agg(F.median("rs").alias("middle"))  # one row
    rising = known.filter((F.col("adx") >= adx_min) & (F.col("adx") > F.col("adx_before"))).select("symbol")
    found = day.filter("newest = 1").join(rising, "symbol", "left_semi").join(strength, "symbol").crossJoin(F.broadcast(middle)).filter("rs > middle").join(ranges, "symbol", "left")
    keep = (F.col("gap_pct") >= gap_min_pct) & (F.col("v30x") >= vol_multiple) & (F.col("pre30_ret") >= pre30_min_pct) & (F.col("prev_pre30") <= prev_pre30_max_pct) & (F.col("o") >= min_open)
    if atr_min_pct is not None:
        keep = keep & (F.col("atr_pct") >= atr_min_pct)
    if atr_max_pct is not None:
        keep = keep & (F.col("atr_pct") <= atr_max_pct)
    if strict:
        keep = keep & (F.col("close_pos") >= 0.9) & F.col("flow_ok")
    return found.filter(keep).select(
        "symbol", F.col("d").alias("day"), F.col("o").alias("open_px"), "gap_pct", "pre30_ret", "v30x", near(F.col("rs"), 3).alias("rs_score"), near(F.col("atr"), 2).alias("atr"), near(F.col("atr_pct"), 2).alias("atr_pct"),
    ).orderBy(F.desc("v30x"), "symbol")


def breadth_of_days(bars: DataFrame, as_of: str, dma: int = 20, timeframe: str = "1d", grid: str = "session") -> DataFrame:
    """For each bucket up to ``as_of``: symbols, how many close above their mean of ``dma`` buckets (partial at first), and how many rose and fell."""
    order = Window.partitionBy("symbol").orderBy("bucket")
    rows = resample(bars, timeframe, grid, end=as_of).withColumns({"mean": F.avg("close").over(order.rowsBetween(1 - dma, 0)), "before": F.lag("close").over(order)})
    count = F.count(F.lit(1))
    above = F.count(F.when(F.col("close") > F.col("mean"), 1))
    return rows.groupBy("bucket").agg(
        count.alias("n_symbols"), above.alias("above_dma"), near(100.0 * above / count, 2).alias("pct_above_dma"),
        F.count(F.when(F.col("close") > F.col("before"), 1)).alias("advances"), F.count(F.when(F.col("close") < F.col("before"), 1)).alias("declines"),
    ).orderBy(F.desc("bucket"))
