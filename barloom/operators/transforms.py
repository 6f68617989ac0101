"""Bars of other shapes, made by ordered scans over a symbol's bars.

Each transform returns rows of (ts as epoch seconds, open, high, low, close,
volume); only Heikin Ashi and Kagi give a volume. Where two would share a time, the later one moves on by a second.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Row = tuple[int, float, float, float, float, float | None]
TRANSFORMS: dict[str, tuple[Callable[..., list[Row]], dict]] = {}


def transform(name: str, **defaults):
    def keep(fn):
        TRANSFORMS[name] = (fn, defaults)
        return fn

    return keep


@transform("heikin-ashi")
def heikin_ashi(t, o, h, l, c, v) -> list[Row]:  # noqa: E741
    out: list[Row] = []
    before = None
    for i in range(len(t)):
        close = (o[i] + h[i] + l[i] + c[i]) / 4
        start = (o[i] + c[i]) / 2 if before is None else sum(before) / 2
        out.append((t[i], start, max(h[i], start, close), min(l[i], start, close), close, v[i]))
        before = (start, close)
    return out


@transform("renko", box=2.0)
def renko(t, o, h, l, c, v, box) -> list[Row]:  # noqa: E741
    out: list[Row] = []
    edge = np.floor(c[0] / box) * box if len(t) else 0.0
    for at, price in zip(t[1:], c[1:]):
        step = box if price > edge else -box
        while price >= edge + box if step > 0 else price <= edge - box:
            out.append((at, edge, max(edge, edge + step), min(edge, edge + step), edge + step, None))
            edge += step
    return out


@transform("range-bars", size=3.0)
def range_bars(t, o, h, l, c, v, size) -> list[Row]:  # noqa: E741
    out: list[Row] = []
    held: list[int] = []
    for i in range(len(t)):
        held.append(i)
        x = c[held[0] : i + 1]
        if x.max() - x.min() >= size or i == len(t) - 1:
            out.append((t[i], x[0], x.max(), x.min(), x[-1], None))
            held = []
    return out


@transform("line-break", lines=3)
def line_break(t, o, h, l, c, v, lines) -> list[Row]:  # noqa: E741
    """A close beyond the last ``lines`` lines makes one that starts at the last line's close; the first close is a line of no length."""
    out: list[Row] = []
    ends = [(c[0], c[0])] if len(t) else []
    for at, price in zip(t[1:], c[1:]):
        recent = [x for line in ends[-max(1, int(lines)) :] for x in line]
        if price > max(recent) or price < min(recent):
            start = ends[-1][1]
            ends.append((start, price))
            out.append((at, start, max(start, price), min(start, price), price, None))
    return out


@transform("point-figure", box=1.0, reversal=3, method="hl", mode="fixed", percent=None, atr_period=14, atr_multiplier=1.0)
def point_figure(t, o, h, l, c, v, box, reversal, method, mode, percent, atr_period, atr_multiplier) -> list[Row]:  # noqa: E741
    """Columns of whole boxes. Prices are floored to box numbers; a column of boxes from ``low`` to ``top`` ends at ``top + 1`` boxes.

    The first bar's close is a column without a direction. A new column has
    ``reversal`` boxes against the last one, and its own size of box, which is
    fixed, a percentage of the price, or a multiple of Wilder's true range. What
    stands last, if it has a direction, is a column too.
    """
    if mode not in ("fixed", "percent", "atr") or mode == "fixed" and not box > 0 or mode == "percent" and not (percent or 0) > 0:
        raise ValueError("point-figure needs a mode of fixed, percent or atr and a size above 0")
    reversal = max(1, int(np.floor(reversal)))
    ups, downs = (h, l) if method == "hl" else (c, c)
    ranges = _running_true_range(h, l, c, max(1, int(atr_period))) if mode == "atr" else None
    size = 0.0

    def sized(price: float, i: int) -> float:
        wanted = {"fixed": lambda: box, "percent": lambda: abs(price) * percent / 100, "atr": lambda: ranges[i] * atr_multiplier}[mode]()
        return wanted if wanted > 0 and np.isfinite(wanted) else size or abs(price) * 0.01 or 1.0

    out: list[Row] = []
    side = top = low = at = 0

    def column() -> Row:
        ends = (low * size, (top + 1) * size)[:: side or 1]
        return at, ends[0], max(ends), min(ends), ends[1], None

    for i in range(len(t)):
        if not i:
            size, at = sized(c[0], 0), t[0]
            top = low = int(np.floor(c[0] / size))
            continue
        up, down = int(np.floor(ups[i] / size)), int(np.floor(downs[i] / size))
        if not side:
            if up > top or down < low:
                side, at = (1 if up - top >= low - down else -1), t[i]
                top, low = (up, low) if side > 0 else (top, down)
        elif side > 0 and up > top:
            top = up
        elif side < 0 and down < low:
            low = down
        elif (top - down if side > 0 else up - low) >= reversal:
            out.append(column())
            edge, price = (top if side > 0 else low + 1) * size, (downs if side > 0 else ups)[i]
            size, side, at = sized(price, i), -side, t[i]
            own = int(np.floor(price / size))
            top, low = (own, int(np.floor(edge / size))) if side > 0 else (int(np.ceil(edge / size)) - 1, own)
    if side:
        out.append(column())
    return out


def _running_true_range(h, l, c, n: int) -> np.ndarray:  # noqa: E741
    """Wilder's average of the true range; before ``n`` bars, their plain mean."""
    tr = h - l
    tr[1:] = np.maximum(tr[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(l[1:] - c[:-1])))
    out = np.empty(len(tr))
    for i, x in enumerate(tr):
        out[i] = tr[: i + 1].mean() if i < n else out[i - 1] + (x - out[i - 1]) / n
    return out


@transform("kagi", reversal=2.0)
def kagi(t, o, h, l, c, v, reversal) -> list[Row]:  # noqa: E741
    """Turning points of the close, each a row of one price; volume is 1 where the line is thick.

    The line is thick from where it passes its last shoulder until it passes its
    last waist; before any turn every price is past the shoulder. What stands
    last is a turning point at time 0.
    """
    if not reversal > 0:
        raise ValueError("reversal must be above 0")
    out: list[Row] = []
    side, thick = 1, False
    last_turn = {1: -np.inf, -1: np.inf}
    for i, price in enumerate(c):
        if not i:
            end = price
        elif side * (price - end) > 0:
            end = price
            if side * (price - last_turn[side]) > 0:
                thick = side > 0
        elif side * (end - price) >= reversal:
            out.append((t[i], end, end, end, end, float(thick)))
            last_turn[side], side, end = end, -side, price
    if len(t):
        out.append((0, end, end, end, end, float(thick)))
    return out


def run(bars: DataFrame, name: str, **params) -> DataFrame:
    """symbol, n (from 0), epoch and prices of the bars that a transform makes."""
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name}")
    fn, defaults = TRANSFORMS[name]
    if unknown := set(params) - set(defaults):
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    values = [params.get(k) if params.get(k) is not None else v for k, v in defaults.items()]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        seconds = pdf["ts"].astype("datetime64[s]").astype("int64").to_numpy()
        made = fn(seconds, *(pdf[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")), *values)
        out = pd.DataFrame(made, columns=["epoch", "open", "high", "low", "close", "volume"])
        at = np.arange(len(out))
        epoch = np.maximum.accumulate(out["epoch"].to_numpy(np.int64) - at) + at  # strictly rising, by a second where it must
        out["epoch"] = epoch
        return out.assign(symbol=pdf["symbol"].iloc[0], n=range(len(out)))[["symbol", "n", "epoch", "open", "high", "low", "close", "volume"]]

    schema = "symbol string, n long, epoch long, open double, high double, low double, close double, volume double"
    return bars.select("symbol", "ts", "open", "high", "low", "close", "volume").groupBy("symbol").applyInPandas(one, schema)
