"""Price profiles with points of control, value areas and session structure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import price_step


def levels(bars: DataFrame, step: float, *keys: str) -> DataFrame:
    """Volume of each price step: a bar's volume is shared equally by the steps that it spans."""
    low, high = price_step(F.col("low"), step), price_step(F.col("high"), step)
    spread = bars.select(*keys, F.explode(F.sequence(low, high)).alias("step"), (F.col("volume") / (high - low + 1)).alias("v"))
    return spread.groupBy(*keys, "step").agg(F.sum("v").alias("v"))


def value_area(profile: DataFrame, step: float, *keys: str, share: float = 0.7, ties: str = "up") -> DataFrame:
    """Point of control, and the range around it that holds ``share`` of the volume.

    The range grows by the neighbour with more volume; ``ties`` names the side
    that equal ones go to. Of equal points of control the highest stays. A
    profile is one array, bounded by the price range, folded in the JVM.
    """
    lists = profile.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", F.round("v", 6).alias("v")))).alias("p"), F.sum("v").alias("total"))
    best = F.aggregate("p", F.struct(F.lit(-1.0).alias("v"), F.lit(0).alias("at"), F.lit(0).alias("n")), lambda a, x: F.when(x["v"] >= a["v"], F.struct(x["v"].alias("v"), a["n"].alias("at"), (a["n"] + 1).alias("n"))).otherwise(F.struct(a["v"].alias("v"), a["at"].alias("at"), (a["n"] + 1).alias("n"))))
    rows = lists.withColumn("poc_at", best["at"])
    start = F.struct(F.col("poc_at").alias("lo"), F.col("poc_at").alias("hi"), F.element_at("p", F.col("poc_at") + 1)["v"].cast("double").alias("held"))

    def grow(a: Column, _: Column) -> Column:
        below = F.when(a["lo"] > 0, F.element_at("p", a["lo"].cast("int"))["v"])
        above = F.when(a["hi"] + 1 < F.size("p"), F.element_at("p", (a["hi"] + 2).cast("int"))["v"])
        upward = (F.coalesce(above, F.lit(-1.0)) >= F.coalesce(below, F.lit(-1.0))) if ties == "up" else (F.coalesce(above, F.lit(-1.0)) > F.coalesce(below, F.lit(-1.0)))
        up = F.struct(a["lo"].alias("lo"), (a["hi"] + 1).alias("hi"), (a["held"] + F.coalesce(above, F.lit(0.0))).cast("double").alias("held"))
        down = F.struct((a["lo"] - 1).alias("lo"), a["hi"].alias("hi"), (a["held"] + F.coalesce(below, F.lit(0.0))).cast("double").alias("held"))
        return F.when((a["held"] >= F.col("total") * share) | (above.isNull() & below.isNull()), a).when(upward, up).otherwise(down)

    area = F.aggregate("p", start, grow)
    rows = rows.withColumn("a", area)

    def price(at: Column) -> Column:
        return F.element_at("p", (at + 1).cast("int"))["step"] * step

    return rows.select(*keys, price(F.col("poc_at")).alias("poc"), price(F.col("a.lo")).alias("val"), price(F.col("a.hi")).alias("vah"), F.round(F.col("a.held") + 3.7e-10, 4).alias("held"), F.round(F.col("total") + 3.7e-10, 4).alias("total"))


def sessions(bars: DataFrame, step: float) -> DataFrame:
    """For each session: initial balance, range extension, single prints, tails, poor extremes and the day's type."""
    days = bars.withColumn("session", F.date_trunc("day", "ts"))
    order = Window.partitionBy("symbol", "session").orderBy("ts")
    numbered = days.withColumn("period", F.row_number().over(order))
    low, high = price_step(F.col("low"), step), price_step(F.col("high"), step)
    counts = numbered.select("symbol", "session", F.explode(F.sequence(low, high)).alias("step"), "period").groupBy("symbol", "session", "step").agg(F.count_distinct("period").alias("n"))
    shape = counts.groupBy("symbol", "session").agg(F.sum((F.col("n") == 1).cast("long")).alias("single_prints"), F.max_by("n", "step").alias("top_n"), F.min_by("n", "step").alias("bottom_n"))
    day = numbered.groupBy("symbol", "session").agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.min_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close"),
        F.max(F.when(F.col("period") <= 2, F.col("high"))).alias("ib_high"), F.min(F.when(F.col("period") <= 2, F.col("low"))).alias("ib_low"),
    )
    wide, balance = F.col("high") - F.col("low"), F.col("ib_high") - F.col("ib_low")
    kind = F.when(balance <= 0, "none").when(wide <= balance * 1.15, "non-trend").when(wide >= balance * 2, "trend").otherwise("normal variation")
    return day.join(shape, ["symbol", "session"]).select(
        "symbol", "session", "ib_high", "ib_low", (F.col("high") - F.col("ib_high")).alias("extension_up"), (F.col("ib_low") - F.col("low")).alias("extension_down"),
        "single_prints", (F.col("top_n") > 1).alias("poor_high"), (F.col("bottom_n") > 1).alias("poor_low"), kind.alias("day_type"),
    )


# Whole market profiles: letters, developing values, tails and types

SESSION_KEYS = {"day": "day", "week": "week", "month": "month", "composite": None}
PROFILE = (
    "symbol string, session long, start_ts timestamp_ntz, end_ts timestamp_ntz, open double, high double, low double, close double, periods int, poc double, vah double, val double, "
    "ib_high double, ib_low double, extension_up double, extension_down double, single_prints array<double>, buying_tail array<double>, selling_tail array<double>, poor_high boolean, poor_low boolean, "
    "day_type string, open_type string, volume_poc double, total_volume double, developing array<struct<period:int,ts:timestamp_ntz,poc:double,vah:double,val:double>>, "
    "levels array<struct<price:double,count:int,letters:string,volume:double>>"
)


def letter(period: int) -> str:
    """A to Z, then a to z, then A again."""
    return "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[period % 52]


def area(counts: np.ndarray, share: float) -> tuple[int, int, int]:
    """Places of the fullest level, and of the top and bottom of the area around it, in counts from the highest price down; ties go up."""
    at = top = bottom = int(counts.argmax())
    held, goal = counts[at], counts.sum() * share
    while held < goal and (top > 0 or bottom + 1 < len(counts)):
        above = counts[top - 1] if top else -1
        below = counts[bottom + 1] if bottom + 1 < len(counts) else -1
        if above >= below:
            top -= 1
        else:
            bottom += 1
        held += max(above, below)
    return at, top, bottom


def day_type(balance: tuple[float, float], high: float, low: float, counts: np.ndarray, at: int) -> str:
    (top, bottom), span = balance, high - low
    if span <= 0 or top - bottom <= 0:
        return "normal"
    if high > top and low < bottom:
        return "neutral"
    if len(counts) >= 5:
        away = np.abs(np.arange(len(counts)) - at)
        second = counts[away > 1].max(initial=0)
        between = counts[(away > 0) & (away <= max(2, len(counts) // 4))].min(initial=np.iinfo(np.int64).max)
        if second >= counts[at] * 0.7 and between <= counts[at] * 0.35:
            return "double-distribution"
    ratio = span / (top - bottom)
    return "trend" if ratio >= 2.5 else "normal-variation" if ratio >= 1.4 else "normal"


def open_type(start: float, periods: list[tuple[float, float]], high: float, low: float) -> str:
    """From the open, and the (high, low) of the first two periods."""
    if not periods or high <= low:
        return "auction"
    (h1, l1), place = periods[0], (start - low) / (high - low)
    if not 0.3 <= place <= 0.7 and h1 - l1 <= (high - low) * 0.35:
        return "drive"
    if len(periods) > 1:
        h2, l2 = periods[1]
        probe = (h1 - l1) * 0.25
        fell, rose = l1 < start - probe, h1 > start + probe
        if fell and h2 > h1 or rose and l2 < l1:
            return "test-drive"
        if rose and l2 < start or fell and h2 > start:
            return "rejection-reverse"
    return "auction"


def _tail(counts: np.ndarray, prices: list[float], edges: int, down: bool) -> list[float] | None:
    """High and low of the single prints at one end, if there are as many as ``edges``."""
    run = counts[::-1] if down else counts
    n = int((np.append(run, 2) != 1).argmax())
    if edges <= 0 or n < edges:
        return None
    return [prices[len(prices) - n], prices[-1]] if down else [prices[0], prices[n - 1]]


def profiles(
    bars: DataFrame, tick_size: float = 0.05, row_ticks: int = 1, session: str = "day", block_minutes: float = 30, value_area_share: float = 0.7,
    initial_balance_periods: int = 2, composite_sessions: int = 1, tail_edges: int = 0,
) -> DataFrame:
    """One row for each session, or for each run of ``composite_sessions`` sessions, of a symbol.

    Bars are aggregated to periods and price levels where they are; what is left
    of a session, its levels and periods, is bounded by its price range and
    length, and its shape is read from that in one small scan.
    """
    if session not in SESSION_KEYS:
        raise ValueError(f"unknown session {session}")
    row = (tick_size if tick_size > 0 else 0.05) * max(1, int(row_ticks))
    block, unit = max(1, int(np.floor(block_minutes * 60 + 0.5))), SESSION_KEYS[session]
    days = bars.select("symbol", "ts", "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"), (F.date_trunc(unit, "ts") if unit else F.lit("1970-01-01").cast("timestamp_ntz")).alias("_k"))
    order = days.select("symbol", "_k").distinct().withColumn("session", F.floor((F.row_number().over(Window.partitionBy("symbol").orderBy("_k")) - 1) / (max(1, composite_sessions) if unit else 1)))
    rows = days.join(order, ["symbol", "_k"])
    key = ["symbol", "session"]
    whole = rows.groupBy(*key).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("total_volume"),
    )
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1_000_000
    placed = rows.select(*key, "ts", "high", "low", "volume").join(whole.select(*key, "start_ts"), key).withColumn("period", F.floor(seconds / block).cast("int"))
    periods = placed.groupBy(*key, "period").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max("ts").alias("ts")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("period", "h", "l", "ts"))).alias("p"))
    low, high = price_step(F.col("low"), row), price_step(F.col("high"), row)
    cells = placed.select(*key, "period", F.explode(F.sequence(low, high)).alias("step"), (F.col("volume") / (high - low + 1)).alias("v"))
    levels = cells.groupBy(*key, "step", "period").agg(F.sum("v").alias("v")).groupBy(*key, "step").agg(F.sort_array(F.collect_list("period")).alias("periods"), F.sum("v").alias("v"))
    levels = levels.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("step", "periods", "v")), False).alias("l"))
    names = [c.split()[0] for c in PROFILE.replace("array<struct<period:int,ts:timestamp_ntz,poc:double,vah:double,val:double>>", "x").replace("array<struct<price:double,count:int,letters:string,volume:double>>", "x").split(", ")]

    def shaped(r) -> dict:
        prices = [float(np.floor(x["step"] * row * 1e8 + 0.5) / 1e8) for x in r.l]
        counts = np.array([len(x["periods"]) for x in r.l])
        volumes = np.array([x["v"] for x in r.l])
        at, top, bottom = area(counts, value_area_share)
        first = [p for p in r.p if p["period"] < initial_balance_periods]
        ib = (max(p["h"] for p in first), min(p["l"] for p in first)) if first else (prices[0], prices[-1])
        developing = []
        for p in r.p:
            upto = np.array([int(np.searchsorted(x["periods"], p["period"], side="right")) for x in r.l])
            seen = np.flatnonzero(upto)
            if len(seen):
                a, t, b = area(upto[seen], value_area_share)
                developing.append({"period": p["period"], "ts": p["ts"], "poc": prices[seen[a]], "vah": prices[seen[t]], "val": prices[seen[b]]})
        return {
            "symbol": r.symbol, "session": r.session, "start_ts": r.start_ts, "end_ts": r.end_ts, "open": r.open, "high": r.high, "low": r.low, "close": r.close, "periods": r.p[-1]["period"] + 1,
            "poc": prices[at], "vah": prices[top], "val": prices[bottom], "ib_high": ib[0], "ib_low": ib[1], "extension_up": max(0.0, r.high - ib[0]), "extension_down": max(0.0, ib[1] - r.low),
            "single_prints": [x for x, n in list(zip(prices, counts))[1:-1] if n == 1], "buying_tail": _tail(counts, prices, tail_edges, True), "selling_tail": _tail(counts, prices, tail_edges, False),
            "poor_high": bool(counts[0] > 1), "poor_low": bool(counts[-1] > 1), "day_type": day_type(ib, r.high, r.low, counts, at), "open_type": open_type(r.open, [(p["h"], p["l"]) for p in r.p[:2]], r.high, r.low),
            "volume_poc": prices[int(volumes.argmax())], "total_volume": r.total_volume, "developing": developing,
            "levels": [{"price": x, "count": int(n), "letters": "".join(map(letter, l["periods"])), "volume": float(v)} for x, n, l, v in zip(prices, counts, r.l, volumes)],
        }

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([shaped(r) for r in pdf.itertuples(index=False)], columns=names)

    return whole.join(periods, key).join(levels, key).mapInPandas(run, PROFILE)


def quote_footprint(quotes: DataFrame, *keys: str) -> DataFrame:
    """Volume bought and sold at each price, by the side of the quote's middle that a trade is on; trades in the middle, or without volume, are neither.

    ``quotes`` has ``keys``, ltp, bid, ask and volume; a missing bid or ask is the trade's price.
    """
    side = aggressor(F.col("ltp"), F.col("bid"), F.col("ask"))
    rows = quotes.filter(F.col("volume").isNotNull()).withColumn("_s", side).filter("_s <> 0")
    found = rows.groupBy(*keys, F.col("ltp").alias("price")).agg(F.sum(F.when(F.col("_s") > 0, F.col("volume")).otherwise(0.0)).alias("bought"), F.sum(F.when(F.col("_s") < 0, F.col("volume")).otherwise(0.0)).alias("sold"))
    return found.withColumn("delta", F.col("bought") - F.col("sold"))


def cumulative_delta(quotes: DataFrame, *keys: str) -> DataFrame:
    """``quotes`` with the running volume bought less sold, by ts and n; a quote without volume adds nothing."""
    so_far = Window.partitionBy(*keys).orderBy("ts", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = aggressor(F.col("ltp"), F.col("bid"), F.col("ask")) * F.coalesce(F.col("volume"), F.lit(0))
    return quotes.withColumn("cvd", F.sum(step).over(so_far).cast("long"))


def aggressor(ltp: Column, bid: Column, ask: Column) -> Column:
    """1 above the middle of bid and ask, -1 below it, else 0."""
    middle = (F.coalesce(bid, ltp) + F.coalesce(ask, ltp)) / 2
    return F.when(ltp > middle, 1).when(ltp < middle, -1).otherwise(0)
