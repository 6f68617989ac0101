"""Strategies whose signals come from recurrences, as columns over bars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import scans


def in_order() -> Window:
    return Window.partitionBy("symbol").orderBy("ts")


def crosses(a: Column, b: Column) -> Column:
    """BUY where ``a`` rises above ``b``, SELL where it falls below; null elsewhere."""
    before_a, before_b = F.lag(a).over(in_order()), F.lag(b).over(in_order())
    return F.when((before_a <= before_b) & (a > b), "BUY").when((before_a >= before_b) & (a < b), "SELL")


def _only(rows: DataFrame, side: Column) -> DataFrame:
    return rows.select("symbol", "ts", side.alias("side")).filter("side is not null")


def macd_cross(bars: DataFrame) -> DataFrame:
    return _only(scans.run(bars, {"macd": {}}), crosses(F.col("macd"), F.col("signal")))


def rsi_reversal(bars: DataFrame, low: float = 30.0, high: float = 70.0) -> DataFrame:
    """BUY on the way up through ``low``, SELL on the way down through ``high``."""
    now, before = F.col("value"), F.lag("value").over(in_order())
    return _only(scans.run(bars, {"rsi": {}}), F.when((before <= low) & (now > low), "BUY").when((before >= high) & (now < high), "SELL"))


def sma_cross(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """Crossings of two full means with the next bar's time and open; ``first`` marks a symbol's first one that can be filled."""
    order = in_order()
    rows = bars.withColumns({f"_{k}": F.when(F.count("close").over(order.rowsBetween(1 - n, 0)) == n, F.avg("close").over(order.rowsBetween(1 - n, 0))) for k, n in (("fast", fast), ("slow", slow))})
    rows = rows.withColumns({"side": crosses(F.col("_fast"), F.col("_slow")), "next_ts": F.lead("ts").over(order), "next_open": F.lead("open").over(order)})
    found = rows.filter("side is not null").select("symbol", "ts", "side", "next_ts", "next_open")
    return found.withColumn("first", F.row_number().over(order) == 1)


def supertrend_flip(bars: DataFrame) -> DataFrame:
    now, before = F.col("direction"), F.lag("direction").over(in_order())
    return _only(scans.run(bars, {"supertrend": {}}), F.when((before < 0) & (now > 0), "BUY").when((before > 0) & (now < 0), "SELL"))


# Strategies that depend on their own position. Kernels return plots of numbers, as scans do; a side is 1 or -1.

STRATEGIES: dict[str, tuple] = {}


def strategy(name: str, plots: str, **defaults):
    def keep(kernel):
        STRATEGIES[name] = (kernel, defaults, tuple(plots.split(",")))
        return kernel

    return keep


@strategy("ema-ribbon-pullback", "side", l1=9, l2=21, l3=50, l4=100)
def _ribbon(b: scans.Bars, *lengths: int) -> dict[str, np.ndarray]:
    lines = np.stack([scans.ema(b.c, n) for n in lengths])
    with np.errstate(invalid="ignore"):
        rising, falling = (lines[:-1] > lines[1:]).all(axis=0), (lines[:-1] < lines[1:]).all(axis=0)
        side = np.where(rising & (b.c <= lines[0]), 1.0, np.where(falling & (b.c >= lines[0]), -1.0, scans.NAN))
    side[: max(lengths)] = scans.NAN  # one bar more than the slowest average needs
    return {"side": side}


@strategy("bracket-breakout", "side,code,stop,target", lookback=20, atr_period=14, stop_atr=1.5, reward=2.0)
def _bracket(b: scans.Bars, lookback: int, period: int, stop_atr: float, reward: float) -> dict[str, np.ndarray]:
    """Codes: 1 and 2 for entries up and down, 3 for a stop, 4 for a target. One position at a time; a bar that reaches both levels is a stop."""
    n = len(b.c)
    out = {k: np.full(n, scans.NAN) for k in ("side", "code", "stop", "target")}
    top, bottom = scans.shift(scans.rolling(b.h, lookback, np.max)), scans.shift(scans.rolling(b.l, lookback, np.min))
    tr = scans.true_range(b)
    tr[:1] = scans.NAN
    wide = scans.sma(tr, period)
    held, stop, target = 0, 0.0, 0.0
    for i in range(n):
        if held:
            near, far = (b.l[i], b.h[i]) if held > 0 else (-b.h[i], -b.l[i])
            code = 3 if near <= held * stop else 4 if far >= held * target else 0
            if code:
                out["side"][i], out["code"][i], held = -held, code, 0
            continue
        if wide[i] > 0 and (b.c[i] > top[i] or b.c[i] < bottom[i]):
            held = 1 if b.c[i] > top[i] else -1
            risk = stop_atr * wide[i]
            stop, target = b.c[i] - held * risk, b.c[i] + held * reward * risk
            out["side"][i], out["code"][i], out["stop"][i], out["target"][i] = held, 1 if held > 0 else 2, stop, target
    return out


@strategy("supertrend-regime", "side,code", period=10, multiplier=3.0, cooldown=5, hold=20)
def _regime(b: scans.Bars, period: int, multiplier: float, cooldown: int, hold: int) -> dict[str, np.ndarray]:
    """Codes: 1 and 2 for flips up and down, 3 for an exit by time. Signals fill at the next open; after a losing exit, flips are ignored for some bars."""
    way = scans.SCANS["supertrend"][0](b, period, multiplier)["direction"]
    n = len(b.c)
    out = {k: np.full(n, scans.NAN) for k in ("side", "code")}
    held, entry, since, waiting, order = 0, 0.0, None, 0, 0
    for i in range(n):
        if order and not held:
            held, entry, since = order, b.o[i], i
        elif order and order != held:
            waiting = cooldown if held * (b.o[i] - entry) < 0 else waiting
            held, since = 0, None
        order, waiting = 0, max(0, waiting - 1)
        if i and way[i] * way[i - 1] < 0 and not waiting:
            order = int(way[i])
            out["code"][i] = 1 if order > 0 else 2
        elif held and since is not None and i + 1 - since >= hold:
            order, since = -held, None
            out["code"][i] = 3
        if order:
            out["side"][i] = order
    return out


def run_strategy(bars: DataFrame, name: str, **given) -> DataFrame:
    """symbol, ts, side (BUY or SELL) and the other plots of a strategy's signals."""
    rows = scans.run(bars, {name: given}, STRATEGIES).filter("side is not null")
    return rows.withColumn("side", F.when(F.col("side") > 0, "BUY").otherwise("SELL"))


def event_chain(events: DataFrame) -> DataFrame:
    """``events`` (key, n, payload) with digests that each cover the digest before them.

    A chain is a fold in order, so a key's events are scanned together; checking
    needs no scan: see ``broken_links``.
    """
    import hashlib

    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        last, out = "", []
        for payload in pdf["payload"]:
            last = hashlib.sha256(f"{last}|{payload}".encode()).hexdigest()
            out.append(last)
        return pdf.assign(digest=out)

    return events.select("key", "n", "payload").groupBy("key").applyInPandas(one, "key string, n long, payload string, digest string")


def broken_links(chain: DataFrame) -> DataFrame:
    """The rows of a chain whose digest doesn't follow from the row before."""
    before = F.coalesce(F.lag("digest").over(Window.partitionBy("key").orderBy("n")), F.lit(""))
    return chain.withColumn("_want", F.sha2(F.concat_ws("|", before, "payload"), 256)).filter("_want <> digest").drop("_want")


def replay(chain: DataFrame, after: int = -1, until: int | None = None) -> DataFrame:
    """A verified chain's events from ``after`` on, in order; a broken link is an error that names the first one of each key."""
    bad = broken_links(chain).groupBy("key").agg(F.min("n").alias("first_bad"))
    rows = chain.join(F.broadcast(bad), "key", "left")
    wrong = F.raise_error(F.concat(F.lit("broken link in "), "key", F.lit(" at "), F.col("first_bad").cast("string"))).cast("string")
    kept = rows.filter(F.col("n") > after) if until is None else rows.filter(F.col("n").between(after + 1, until))
    return kept.select("key", "n", "payload", F.when(F.col("first_bad").isNotNull(), wrong).otherwise(F.col("digest")).alias("digest"))


def snapshots(chain: DataFrame, every: int = 10_000) -> DataFrame:
    """The last event of every ``every`` events of a key: where a replay may start from."""
    at = F.row_number().over(Window.partitionBy("key").orderBy("n"))
    return chain.withColumn("place", at).filter(F.col("place") % every == 0).select("key", "n", "place", "digest")
