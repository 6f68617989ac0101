"""SQL fragments for ordered windows that Spark and other engines read alike.

Series are partitioned by ``symbol`` and ordered by ``ts``. An indicator is a
list of layers; each layer adds columns and may use those of earlier layers, so
window functions nest without self-joins and share one sort.
"""

from __future__ import annotations

from collections.abc import Iterable

Layer = dict[str, str]
PART = "PARTITION BY symbol ORDER BY ts"


def over(n: int | None = None, skip: int = 0) -> str:
    """A frame of the last ``n`` rows, ``skip`` rows back; without ``n`` all rows so far."""
    low = "UNBOUNDED" if n is None else str(n - 1 + skip)
    high = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return f"OVER ({PART} ROWS BETWEEN {low} PRECEDING AND {high})"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({PART})" if n >= 0 else f"lead({x}, {-n}) OVER ({PART})"


def strict(fn: str, x: str, n: int) -> str:
    """An aggregate over n values; null until there are n, and where one is null."""
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {fn}({x}) {over(n)} END"


def sma(x: str, n: int) -> str:
    return strict("avg", x, n)


def rolling_sum(x: str, n: int) -> str:
    return strict("sum", x, n)


def highest(x: str, n: int) -> str:
    return strict("max", x, n)


def lowest(x: str, n: int) -> str:
    return strict("min", x, n)


def stdev(x: str, n: int) -> str:
    return strict("stddev_pop", x, n)


def weighted(x: str, weights: list[float]) -> str:
    """Sum of weights times values, the newest first; null where a value is missing."""
    return "(" + " + ".join(f"{w!r} * {x if k == 0 else lag(x, k)}" for k, w in enumerate(weights)) + ")"


def wma(x: str, n: int) -> str:
    """Weights n for the newest down to 1; needs the row number ``rn``."""
    total = n * (n + 1) / 2
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN (sum(rn * {x}) {over(n)} - (rn - {n}) * sum({x}) {over(n)}) / {total!r} END"


def div(a: str, b: str) -> str:
    """A quotient that is null for a zero divisor."""
    return f"(({a}) / nullif({b}, 0))"


def regression(kind: str, y: str, n: int) -> str:
    return f"CASE WHEN count({y}) {over(n)} = {n} THEN regr_{kind}({y}, rn) {over(n)} END"


TRUE_RANGE = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
SOURCES = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "hl2": "((high + low) / 2)", "hlc3": "((high + low + close) / 3)", "ohlc4": "((open + high + low + close) / 4)"}


def source(name: str) -> str:
    """The expression of a price source; an unknown name is the close."""
    return SOURCES.get(name, "close")


def nested(first: str, layers: Iterable[Layer], final: str) -> str:
    """A query whose layers follow each other as common table expressions."""
    parts, last = [f"t0 AS ({first})"], "t0"
    for i, layer in enumerate(layers, 1):
        added = ", ".join(f"{e} AS {c}" for c, e in layer.items())
        parts.append(f"t{i} AS (SELECT *, {added} FROM {last})")
        last = f"t{i}"
    return f"WITH {', '.join(parts)} {final.format(last=last)}"
