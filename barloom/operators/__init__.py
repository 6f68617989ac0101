"""Indicators over bars, and the registry that serves them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import indicators as windowed
from barloom.operators import scans


def indicator(bars: DataFrame, name: str, **params) -> DataFrame:
    """symbol, ts and one column for each plot of an indicator, for all symbols at once.

    Window indicators stay in the JVM. Recurrences run in one grouped scan, over
    one symbol's bars at a time.
    """
    if name in windowed.WINDOWED:
        try:
            layers, plots = windowed.build(name, **params)
        except windowed.Recurrent:
            return scans.run(bars, {name: params})
        rows = bars.withColumn("rn", F.expr("row_number() OVER (PARTITION BY symbol ORDER BY ts)"))
        for layer in layers:
            rows = rows.selectExpr("*", *(f"{e} AS {c}" for c, e in layer.items()))
        return rows.select("symbol", "ts", *plots)
    if name in scans.SCANS:
        return scans.run(bars, {name: params})
    raise ValueError(f"unknown indicator {name}")


def register_indicator(name: str, kernel: Callable[..., dict], plots: tuple[str, ...], **defaults) -> None:
    """Add a scan, or replace one: ``kernel`` takes a symbol's bars (``scans.Bars``) and the parameters, and returns an array for each plot.

    The last registration of a name wins. The kernel is sent to the workers by value.
    """
    if not plots:
        raise ValueError("an indicator needs a plot")
    windowed.WINDOWED.pop(name, None)
    scans.SCANS[name] = (kernel, dict(defaults), tuple(plots))


def catalogue() -> list[dict]:
    """id, parameters with their defaults, and plots of every indicator."""
    plots = {name: windowed.build(name)[1] for name in windowed.WINDOWED} | {name: list(s[2]) for name, s in scans.SCANS.items()}
    defaults = {name: w[1] for name, w in windowed.WINDOWED.items()} | {name: s[1] for name, s in scans.SCANS.items()}
    return [{"id": name, "parameters": dict(defaults[name]), "plots": plots[name]} for name in sorted(plots)]


def indicator_ids() -> list[str]:
    return sorted([*windowed.WINDOWED, *scans.SCANS])
