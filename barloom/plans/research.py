"""Pattern search, accounts in exact decimals, and the statistics of research."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EULER = 0.5772156649015329
PATHS = 64


def z_normal(x: np.ndarray) -> np.ndarray:
    """Zero mean and unit population deviation; zeros for a flat series."""
    s = x.std()
    return np.zeros(len(x)) if s < 1e-12 else (x - x.mean()) / s


def dtw_all(rows: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Banded dynamic time warping distances of each row to ``b``, over the sum of lengths; each cell of the band is one operation on all rows."""
    (k, n), m = rows.shape, len(b)
    band = max(band, abs(n - m))
    before = np.full((m + 1, k), np.inf)
    before[0] = 0.0
    for i in range(n):
        now = np.full((m + 1, k), np.inf)
        for j in range(max(0, i - band), min(m, i + band + 1)):
            now[j + 1] = np.abs(rows[:, i] - b[j]) + np.minimum(np.minimum(before[j + 1], now[j]), before[j])
        before = now
    return before[m] / (n + m)


def dtw(a: np.ndarray, b: np.ndarray, band: int) -> float:
    return float(dtw_all(np.asarray(a, float)[None, :], b, band)[0])


def _windows(daily: DataFrame, window: int, horizon: int, end: str | None) -> DataFrame:
    """symbol, ts, d (the number of its date among all dates), w (closes of the last ``window`` dates, none of them missing), days and fwd_pct."""
    rows = daily.select("symbol", "ts", "close")
    if end is not None:
        rows = rows.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    dates = rows.select("ts").distinct().withColumn("d", F.row_number().over(Window.orderBy("ts")))  # one row a date
    rows = rows.join(F.broadcast(dates), "ts")
    order = Window.partitionBy("symbol").orderBy("d")
    later = rows.select("symbol", (F.col("d") - horizon).alias("d"), F.col("close").alias("later"))
    rows = rows.withColumns({
        "w": F.collect_list("close").over(order.rowsBetween(1 - window, 0)), "days": F.count(F.lit(1)).over(Window.partitionBy("symbol")),
        "whole": F.col("d") - F.lag("d", window - 1).over(order) == window - 1,
    })
    rows = rows.join(later, ["symbol", "d"], "left")
    return rows.withColumn("fwd_pct", F.when(F.col("close") > 0, 100 * (F.col("later") / F.col("close") - 1))).drop("later")


def find_similar(daily: DataFrame, symbol: str, window: int = 20, horizon: int = 5, top_k: int = 10, band: float = 0.2, end: str | None = None, exclude_overlap_days: int = 0) -> DataFrame:
    """The windows of closes, of all symbols, closest to the last window of ``symbol``, with what followed and the median of what followed any window.

    Windows are arrays over an ordered frame; a date that a symbol misses breaks
    its windows, and symbols with less than a window, a horizon and a day are left
    out. The query is one window, so it is sent to the tasks; its own window is no
    match. With ``exclude_overlap_days``, of a symbol's matches whose dates are
    that close only the nearest stays: a match shuts out twice as many others at
    most, so a list longer by that factor holds all that stay.
    """
    rows = _windows(daily, window, horizon, end)
    query = daily.filter(F.col("symbol") == symbol)
    if end is not None:
        query = query.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    last = [r for r in query.orderBy(F.desc("ts")).limit(window).select("ts", "close").collect()]
    if len(last) < window:
        raise ValueError(f"{symbol} has {len(last)} days, a window needs {window}")
    goal, width = z_normal(np.array([r["close"] for r in reversed(last)])), max(1, int(band * window))

    @F.pandas_udf("double")
    def distance(w: pd.Series) -> pd.Series:
        if not len(w):
            return pd.Series([], dtype=float)
        rows = np.stack(w.to_list()).astype(float)
        spread = rows.std(axis=1, keepdims=True)
        flat = spread < 1e-12
        return pd.Series(dtw_all(np.where(flat, 0.0, (rows - rows.mean(axis=1, keepdims=True)) / np.where(flat, 1.0, spread)), goal, width))

    known = rows.filter("whole").filter((F.col("days") >= window + horizon + 1) | (F.col("symbol") == symbol))
    baseline = known.agg(F.median("fwd_pct").alias("baseline_median_fwd"))  # one row
    others = known.filter(~((F.col("symbol") == symbol) & (F.col("ts") == F.lit(last[0]["ts"])))).select("symbol", "ts", "d", F.round(distance("w"), 5).alias("dist"), F.round("fwd_pct", 3).alias("fwd_pct"))
    near = others.orderBy("dist", "symbol", "ts").limit(top_k * (2 * exclude_overlap_days + 1))
    if exclude_overlap_days:
        kept, used = [], {}
        for r in near.collect():  # bounded by the limit above
            if len(kept) < top_k and all(abs(r["d"] - u) > exclude_overlap_days for u in used.get(r["symbol"], ())):
                kept.append((r["symbol"], r["ts"], r["dist"], r["fwd_pct"]))
                used.setdefault(r["symbol"], []).append(r["d"])
        near = daily.sparkSession.createDataFrame(kept, "symbol string, ts timestamp_ntz, dist double, fwd_pct double")
    return near.select("symbol", "ts", "dist", "fwd_pct").crossJoin(F.broadcast(baseline))


def cents(x: Decimal) -> Decimal:
    return x.quantize(Decimal("0.01"), ROUND_HALF_UP)


LEDGER = "symbol string, n long, position decimal(20,4), average decimal(20,2), realised decimal(20,2)"


def position_ledger(fills: DataFrame) -> DataFrame:
    """Position, average price and realised result after each fill, rounded to cents at every step.

    ``fills`` has symbol, n (the order), quantity (signed) and price. Reducing a
    position realises; a fill through zero re-bases the rest at its price.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        position, average, realised = Decimal(0), Decimal(0), Decimal(0)
        for row in pdf.sort_values("n").itertuples():
            q, p = Decimal(row.quantity), Decimal(row.price)
            if position * q >= 0:
                average = cents((average * abs(position) + p * abs(q)) / (abs(position) + abs(q))) if position + q else Decimal(0)
            else:
                closed = min(abs(q), abs(position))
                realised = cents(realised + (p - average) * closed * (1 if position > 0 else -1))
                if abs(q) > abs(position):
                    average = cents(p)
                elif abs(q) == abs(position):
                    average = Decimal(0)
            position += q
            out.append((row.symbol, row.n, position, average, realised))
        return pd.DataFrame(out, columns=["symbol", "n", "position", "average", "realised"])

    return fills.groupBy("symbol").applyInPandas(one, LEDGER)


def flat_to_flat(ledger: DataFrame) -> DataFrame:
    """One row for each trip from flat to flat of a position ledger."""
    order = Window.partitionBy("symbol").orderBy("n")
    marked = ledger.withColumn("trip", F.coalesce(F.sum((F.col("position") == 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    trips = marked.groupBy("symbol", "trip").agg(F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.max_by("realised", "n").alias("upto"), F.max_by("position", "n").alias("left"))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("symbol").orderBy("trip")), F.lit(0))
    return trips.withColumn("pnl", F.col("upto") - before).filter("left = 0").select("symbol", "trip", "first_n", "last_n", "pnl")


def monte_carlo(returns: DataFrame, paths: int = 1000, horizon: int = 252, seed: int = 7) -> DataFrame:
    """Compounded results of bootstrapped paths of returns (columns symbol, x).

    A path's draws come from its hash, by a fold; nothing is joined. A symbol's
    returns are copied once for every ``PATHS`` paths, which are one row's work.
    """
    lists = returns.filter("x is not null").groupBy("symbol").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    each = lists.select("symbol", "xs", F.explode(F.sequence(F.lit(0), F.lit(paths - 1), F.lit(PATHS))).alias("from"))
    own = F.sequence(F.col("from"), F.least(F.col("from") + PATHS, F.lit(paths)) - 1)

    def walk(path: Column) -> Column:
        def grown(total: Column, step: Column) -> Column:
            at = F.pmod(F.xxhash64(F.col("symbol"), path, step, F.lit(seed)), F.size("xs").cast("long"))
            return total + F.ln(1 + F.greatest(F.element_at("xs", (at + 1).cast("int")), F.lit(-0.999999)))

        return F.struct(path.cast("long").alias("path"), (F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.lit(0.0), grown)) - 1).alias("total"))

    return each.select("symbol", F.explode(F.transform(own, walk)).alias("w")).select("symbol", "w.path", "w.total")


def monte_carlo_summary(found: DataFrame) -> DataFrame:
    """Mean, deviation, 5th and 95th percentile by index, and the share of paths that gain, of each symbol's paths."""
    order = Window.partitionBy("symbol").orderBy("total", "path")
    rows = found.withColumns({"_at": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    at = {name: F.max(F.when(F.col("_at") == F.floor(F.col("_n") * share), F.col("total"))) for name, share in (("ci_lower", 0.05), ("ci_upper", 0.95))}
    return rows.groupBy("symbol").agg(
        F.avg("total").alias("mean_return"), F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("std_return"), *(e.alias(n) for n, e in at.items()),
        F.avg((F.col("total") > 0).cast("double")).alias("prob_profit"), F.count(F.lit(1)).alias("n_paths"),
    )


def expected_best_sharpe(trials: int, variance: float) -> float | None:
    """The Sharpe ratio that the best of so many worthless trials is expected to show."""
    if trials < 2:
        return None
    q = NormalDist().inv_cdf
    return variance**0.5 * ((1 - EULER) * q(1 - 1 / trials) + EULER * q(1 - 1 / (trials * np.e)))


def deflated_sharpe(scores: DataFrame, column: str = "score") -> DataFrame:
    """One row: the best score, what chance alone would give, and their difference."""
    found = scores.agg(F.count(column).alias("n"), F.var_samp(column).alias("v"), F.max(column).alias("best")).first()
    chance = expected_best_sharpe(found["n"], found["v"] or 0.0)
    rows = [(found["n"], found["best"], chance, None if chance is None else found["best"] - chance)]
    return scores.sparkSession.createDataFrame(rows, "trials long, best double, by_chance double, deflated double")


def parameter_stability(scores: DataFrame, column: str = "score", within: float = 1.0) -> DataFrame:
    """The share of parameter cells within ``within`` of the best."""
    top = scores.agg(F.max(column).alias("top"))
    return scores.crossJoin(F.broadcast(top)).agg(F.avg((F.col(column) >= F.col("top") - within).cast("double")).alias("share"))  # top is one row
