"""Scanners: conditions on the latest values of indicators, scored and ranked."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import operators
from barloom.operators import scans

OPERATORS = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}
#: Indicators whose marks look ahead; a scan of the latest bar must not use them.
LOOK_AHEAD = frozenset(("ichimoku", "dpo", "williams-fractals", "rsi-divergence"))


@dataclass(frozen=True)
class Condition:
    """The latest value of an indicator (or ``close``) against a threshold."""

    name: str
    operator: str
    threshold: float | None
    params: dict = field(default_factory=dict)

    def matches(self, value: Column) -> Column:
        """An unknown value, threshold or operator is no match."""
        if self.threshold is None or self.operator not in OPERATORS:
            return F.lit(False)
        return F.coalesce(OPERATORS[self.operator](value, F.lit(float(self.threshold))), F.lit(False))


#: The scanners that come with the library.
SCANNERS = {
    "momentum": (Condition("close", ">", 1000.0),),
    "pullback": (Condition("close", ">", 500.0), Condition("rsi", "<", 40.0, {"length": 14})),
    "nifty500_technical": (Condition("close", ">", 100.0), Condition("roc", ">", 0.0, {"length": 10})),
}


def _latest(bars: DataFrame, condition: Condition, column: str) -> DataFrame:
    """symbol and the last known value of a condition's first plot."""
    if condition.name == "close":
        return bars.groupBy("symbol").agg(F.max_by("close", "ts").alias(column))
    if condition.name in LOOK_AHEAD:
        raise ValueError(f"{condition.name} looks ahead")
    found = operators.indicator(bars, condition.name, **condition.params)
    plot = found.columns[2]
    known = F.when(F.col(plot).isNotNull() & ~F.isnan(plot), F.struct("ts", plot))
    return found.groupBy("symbol").agg(F.max(known)[plot].alias(column))


def scan(bars: DataFrame, conditions: tuple[Condition, ...], universe: DataFrame | None = None, holdings: DataFrame | None = None) -> DataFrame:
    """symbol, score, n_matched, matched (names), values and rank of each symbol that matches a condition.

    The score is the share of conditions that match; equal scores go by symbol.
    Without conditions every symbol is returned with a score of 1. ``universe``
    has the symbols to look at, ``holdings`` (symbol, quantity) is added to the
    rows. The rank is one window over all matching symbols, a row each.
    """
    if universe is not None:
        bars = bars.join(universe.select("symbol").distinct(), "symbol", "left_semi")
    columns = [f"v{i}" for i in range(len(conditions))]
    parts = [_latest(bars, c, v) for c, v in zip(conditions, columns)]
    rows = reduce(lambda a, b: a.join(b, "symbol", "full"), parts) if parts else bars.select("symbol").distinct()
    met = [c.matches(F.col(v)) for c, v in zip(conditions, columns)]
    n = reduce(lambda a, b: a + b, (m.cast("int") for m in met), F.lit(0))
    names = F.filter(F.array(*(F.when(m, F.lit(c.name)) for c, m in zip(conditions, met))), lambda x: x.isNotNull()) if parts else F.array().cast("array<string>")
    values = F.map_filter(F.map_from_arrays(F.array(*(F.lit(c.name) for c in conditions)), F.array(*columns)), lambda _, v: v.isNotNull()) if parts else F.lit(None).cast("map<string,double>")
    rows = rows.select("symbol", n.alias("n_matched"), (n / max(1, len(conditions)) if parts else F.lit(1.0)).alias("score"), names.alias("matched"), values.alias("values"))
    if parts:
        rows = rows.filter("n_matched > 0")
    if holdings is not None:
        rows = rows.join(holdings.groupBy("symbol").agg(F.sum("quantity").alias("held_quantity")), "symbol", "left")
        rows = rows.withColumn("held_quantity", F.coalesce("held_quantity", F.lit(0))).withColumn("in_portfolio", F.col("held_quantity") != 0)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "symbol")))


def technical_latest(bars: DataFrame, fast: int = 20, slow: int = 50, length: int = 14, where: Column | None = None) -> DataFrame:
    """The latest bar of each symbol with two means (partial at first) and Wilder's index, lowest index first; symbols without an index are left out."""
    order = Window.partitionBy("symbol").orderBy("ts")
    means = {name: F.avg("close").over(order.rowsBetween(1 - n, 0)) for name, n in (("sma_fast", fast), ("sma_slow", slow))}
    rows = bars.select("symbol", "ts", "close").withColumns(means)
    index = scans.run(bars, {"rsi": {"length": length}}).select("symbol", "ts", F.col("value").alias("rsi")).filter("rsi is not null")
    last = rows.join(index, ["symbol", "ts"]).groupBy("symbol").agg(F.max(F.struct("ts", "close", "sma_fast", "sma_slow", "rsi")).alias("r")).select("symbol", "r.*")
    return (last if where is None else last.filter(where)).orderBy("rsi", "symbol")


def top(bars: DataFrame, conditions: tuple[Condition, ...], limit: int = 20, **options) -> DataFrame:
    """The first ``limit`` rows of ``scan``."""
    return scan(bars, conditions, **options).filter(F.col("rank") <= limit)
