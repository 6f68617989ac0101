"""Market breadth: how many symbols rise and fall in each period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def counts(bars: DataFrame) -> DataFrame:
    """ts, advances, declines and their volumes; a symbol's first bar and a flat one are neither."""
    move = F.col("close") - F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    up, down = F.col("move") > 0, F.col("move") < 0
    return bars.withColumn("move", move).groupBy("ts").agg(
        F.count(F.when(up, 1)).alias("advances"), F.count(F.when(down, 1)).alias("declines"),
        F.sum(F.when(up, F.col("volume")).otherwise(0.0)).alias("advance_volume"), F.sum(F.when(down, F.col("volume")).otherwise(0.0)).alias("decline_volume"),
    )


def ratio(advances: Column, declines: Column) -> Column:
    """Infinite without declines, 0 without either."""
    return F.when(declines > 0, F.try_divide(advances.cast("double"), declines.cast("double"))).when(advances > 0, F.lit(INF)).otherwise(0.0)


def advance_decline(bars: DataFrame) -> DataFrame:
    return counts(bars).withColumn("ratio", ratio(F.col("advances"), F.col("declines"))).select("ts", "advances", "declines", "ratio")


def breadth_indicator(bars: DataFrame) -> DataFrame:
    """The running product of ratios: a ratio of 0 leaves it, an infinite one makes it infinite from there on.

    The product is kept as a sum of logarithms. It is one window over all
    periods, a row each, whatever the number of symbols.
    """
    rows = advance_decline(bars)
    so_far = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    finite = (F.col("ratio") > 0) & (F.col("ratio") < INF)
    total = F.sum(F.when(finite, F.ln("ratio")).otherwise(0.0)).over(so_far)
    return rows.withColumn("log_cumulative", F.when(F.max(F.col("ratio") == INF).over(so_far), F.lit(INF)).otherwise(total))


def trin(bars: DataFrame) -> DataFrame:
    """Ratio of declines to advances over that of their volumes; infinite where a divisor is 0."""
    rows = counts(bars)
    whole = F.try_divide(F.col("declines") / F.nullif("advances", F.lit(0)), F.nullif(F.col("decline_volume") / F.nullif("advance_volume", F.lit(0.0)), F.lit(0.0)))
    return rows.select("ts", F.coalesce(whole, F.lit(INF)).alias("trin"))
