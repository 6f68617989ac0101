"""Round trips of fills, results by strategy, and the statistics of trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(28,2)"
EXACT = "decimal(28,4)"
DAYS, MINUTES = 252, 375
#: The most turns of one fill among fills of equal ts and n; larger ones take turns of more units.
TURNS = 100_000
#: Periods of a year by the name of a bar's frequency; unknown names count as daily.
PERIODS = (
    dict.fromkeys(("daily", "1d", "d1"), DAYS)
    | dict.fromkeys(("1w", "w1", "weekly"), 52)
    | {name: DAYS * MINUTES // m for m, names in ((60, ("hour", "1h", "h1", "60m")), (30, ("30m", "m30")), (15, ("15m", "m15")), (5, ("5m", "m5")), (1, ("1m", "m1"))) for name in names}
)


def periods_per_year(frequency: str) -> int:
    return PERIODS.get(str(frequency).lower().strip(), DAYS)


def cents(x: Column) -> Column:
    """Money at two places, halves away from zero."""
    return F.round(x, 2).cast(MONEY)


def round_trips(fills: DataFrame, *keys: str) -> DataFrame:
    """First-in-first-out round trips, one row for each pair of an opening and a closing fill.

    ``fills`` has ``keys``, ts, n (the order of equal times), quantity (signed),
    price, and cost (of the whole fill; null for none). A fill against the
    position closes it, and what is left opens the other side.

    Within a run on one side, the k-th unit opened is the k-th closed. So opening
    and closing quantities are summed up in order, both sums are merged into one
    ordered list of boundaries, and the units between two boundaries belong to the
    next opening and the next closing fill. That is windows over one key, and no
    join of lots with lots.

    Fills of equal ts and n should not occur. Where they do, their units take turns,
    one by one, and fills of equal price and cost of a unit count as one.
    """
    order = Window.partitionBy(*keys).orderBy("ts", "n", "price", "q", "cost")  # ties fall alike in every run
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.col("quantity").cast(EXACT)
    rows = fills.select(*keys, "ts", "n", q.alias("q"), F.col("price").cast(EXACT).alias("price"), F.coalesce("cost", F.lit(0)).cast(EXACT).alias("cost")).filter("q <> 0")
    rows = rows.withColumn("held", F.sum("q").over(so_far) - F.col("q")).withColumn("unit_cost", cents(F.col("cost") / F.abs("q")))
    rows = rows.withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy("ts", "n").rangeBetween(Window.currentRow, Window.currentRow)) > 1)
    against = F.signum("held") * F.signum("q") < 0
    rows = rows.withColumn("closing", F.when(against, F.least(F.abs("q"), F.abs("held"))).otherwise(F.lit(0)).cast(EXACT))
    rows = rows.withColumn("opening", (F.abs("q") - F.col("closing")).cast(EXACT))
    starts = (F.col("opening") > 0) & ((F.col("held") == 0) | against)
    rows = rows.withColumn("run", F.sum(starts.cast("int")).over(so_far)).withColumn("starts", starts.cast("int"))
    leg = F.struct("ts", "n", "price", "unit_cost", F.signum("q").alias("side"))
    legs = F.array(
        F.struct(F.lit(0).alias("closes"), F.col("run").alias("run"), F.col("opening").alias("units")),
        F.struct(F.lit(1).alias("closes"), (F.col("run") - F.col("starts")).alias("run"), F.col("closing").alias("units")),
    )
    each = rows.select(*keys, "tied", leg.alias("leg"), F.explode(legs).alias("l")).select(*keys, "tied", "leg", "l.*").filter("units > 0")
    share = F.when(F.col("tied"), F.greatest(F.ceil(F.col("units") / TURNS), F.lit(1))).otherwise(F.col("units"))
    each = each.withColumn("share", share.cast(EXACT))
    each = each.withColumn("turn", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("units") / F.col("share")) - 1).cast("int"))))
    each = each.withColumn("units", F.least("share", F.col("units") - F.col("turn") * F.col("share")))
    own = Window.partitionBy(*keys, "run", "closes").orderBy("leg.ts", "leg.n", "turn", "leg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("upto", F.sum("units").over(own).cast(EXACT))
    # each boundary once, with the opening or closing fill that ends there
    ends = each.groupBy(*keys, "run", "upto").agg(*(F.max(F.when(F.col("closes") == c, F.col("leg"))).alias(name) for c, name in ((0, "entry"), (1, "exit"))))
    line = Window.partitionBy(*keys, "run").orderBy(F.desc("upto"))  # from the end, as a frame to the end is read anew for each row
    after = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = ends.select(
        *keys, "run", (F.col("upto") - F.coalesce(F.lead("upto").over(line), F.lit(0))).cast(EXACT).alias("quantity"),
        F.last("entry", ignorenulls=True).over(after).alias("entry"), F.last("exit", ignorenulls=True).over(after).alias("exit"),
    ).filter("exit is not null")
    pieces = pieces.groupBy(*keys, "run", "entry", "exit").agg(F.sum("quantity").cast(EXACT).alias("quantity"))  # more than one only after turns
    gross = cents((F.col("exit.price") - F.col("entry.price")) * F.col("entry.side").cast("int") * F.col("quantity"))
    costs = cents((F.col("entry.unit_cost") + F.col("exit.unit_cost")) * F.col("quantity"))
    return pieces.select(
        *keys, F.when(F.col("entry.side") > 0, "LONG").otherwise("SHORT").alias("side"), "quantity", F.col("entry.n").alias("entry_n"), F.col("entry.ts").alias("entry_ts"),
        F.col("entry.price").alias("entry_price"), F.col("exit.n").alias("exit_n"), F.col("exit.ts").alias("exit_ts"), F.col("exit.price").alias("exit_price"),
        gross.alias("gross_pnl"), costs.alias("costs"), (gross - costs).cast(MONEY).alias("net_pnl"),
    )


def with_excursions(trips: DataFrame, bars: DataFrame, *keys: str) -> DataFrame:
    """``trips`` with the largest distances of price against and for them between entry and exit.

    Whole days within a trip are read from daily extremes, and only its first and
    last day from bars; days are the join's key, so a symbol's bars don't meet in
    one task. Both are null where there are no bars.
    """
    day = F.to_date("ts").alias("day")
    priced = bars.select("symbol", "ts", "high", "low", day)
    days = priced.groupBy("symbol", "day").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    numbered = trips.withColumn("_trip", F.xxhash64(*keys, "entry_n", "exit_n"))
    first, last = F.to_date("entry_ts"), F.to_date("exit_ts")
    every = numbered.select("_trip", "symbol", "entry_ts", "exit_ts", F.explode(F.sequence(first, last)).alias("day"), first.alias("d0"), last.alias("d1"))
    edge = every.filter("day = d0 or day = d1").join(priced, ["symbol", "day"]).filter("ts between entry_ts and exit_ts")
    inner = every.filter("day > d0 and day < d1").join(days, ["symbol", "day"])
    seen = edge.select("_trip", "high", "low").unionByName(inner.select("_trip", "high", "low")).groupBy("_trip").agg(F.max("high").alias("_top"), F.min("low").alias("_bottom"))
    rows = numbered.join(seen, "_trip", "left")
    seen, entry = F.col("_top").isNotNull(), F.col("entry_price").cast("double")
    up, down = F.when(seen, F.greatest(F.col("_top") - entry, F.lit(0.0))), F.when(seen, F.greatest(entry - F.col("_bottom"), F.lit(0.0)))
    long = F.col("side") == "LONG"
    return rows.withColumns({"mae": F.round(F.when(long, down).otherwise(up) + 3.7e-10, 2), "mfe": F.round(F.when(long, up).otherwise(down) + 3.7e-10, 2)}).drop("_trip", "_top", "_bottom")


def pnl_by_strategy(fills: DataFrame) -> DataFrame:
    """Realised result and number of round trips of each strategy; fills are matched within their strategy, and null is one."""
    trips = round_trips(fills.withColumn("_s", F.coalesce(F.col("strategy"), F.lit("\0none"))), "_s", "symbol")
    found = trips.groupBy("_s").agg(F.sum("net_pnl").cast(MONEY).alias("realised"), F.count(F.lit(1)).alias("n_trips"))
    everyone = fills.select(F.coalesce(F.col("strategy"), F.lit("\0none")).alias("_s")).distinct()
    out = everyone.join(found, "_s", "left")
    return out.select(F.when(F.col("_s") != "\0none", F.col("_s")).alias("strategy"), F.coalesce("realised", F.lit(0).cast(MONEY)).alias("realised"), F.coalesce("n_trips", F.lit(0)).alias("n_trips"))


def _over_zero(a: Column, b: Column) -> Column:
    """A quotient that is 0 for a divisor of zero or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def equity_statistics(equity: DataFrame, *keys: str, frequency: str = "daily", risk_free: float = 0.0) -> DataFrame:
    """max_drawdown (a negative fraction), sharpe and sortino of curves (keys, ts, value)."""
    order = Window.partitionBy(*keys).orderBy("ts")
    peak = F.max("value").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.lag("value").over(order)
    rows = equity.withColumns({"x": F.try_divide(F.col("value") - before, before), "down": F.when(peak > 0, F.col("value") / peak - 1).otherwise(0.0)})
    year = periods_per_year(frequency)
    mean = F.avg("x") * year - risk_free
    spread, below = F.stddev_samp("x"), F.sqrt(F.sum(F.when(F.col("x") < 0, F.col("x") * F.col("x")).otherwise(F.when(F.col("x").isNotNull(), 0.0))) / F.count("x"))
    return rows.groupBy(*keys).agg(
        F.least(F.min("down"), F.lit(0.0)).alias("max_drawdown"),
        F.when(F.count("x") > 1, _over_zero(mean, spread * year**0.5)).otherwise(0.0).alias("sharpe"),
        F.when(F.count("x") > 1, _over_zero(mean, below * year**0.5)).otherwise(0.0).alias("sortino"),
    )


def statistics(trips: DataFrame, *keys: str, equity: DataFrame | None = None, frequency: str = "daily", risk_free: float = 0.0) -> DataFrame:
    """The figures of trades, one row for each value of ``keys``.

    Money is net of costs unless its name says gross. ``exposure`` is the time
    held over the time from the first entry to the last exit.
    """
    net, gross = F.col("net_pnl"), F.col("gross_pnl")
    wins, losses = net > 0, net < 0
    # as decimals: the sum of a few million long trades leaves 63 bits
    held = (F.unix_micros(F.col("exit_ts").cast("timestamp")) - F.unix_micros(F.col("entry_ts").cast("timestamp"))).cast("decimal(20,0)")
    span = F.unix_micros(F.max("exit_ts").cast("timestamp")) - F.unix_micros(F.min("entry_ts").cast("timestamp"))

    def total(x: Column, where: Column | None = None) -> Column:
        return cents(F.coalesce(F.sum(x if where is None else F.when(where, x)), F.lit(0)))

    def mean(where: Column | None = None) -> Column:
        x = net if where is None else F.when(where, net)
        return cents(F.coalesce(F.try_divide(F.sum(x), F.count(x)), F.lit(0)))

    count = F.count(F.lit(1))
    rows = trips.groupBy(*keys).agg(
        count.alias("total_trades"), F.count(F.when(wins, 1)).alias("winning_trades"), F.count(F.when(losses, 1)).alias("losing_trades"),
        total(net).alias("net_profit"), total(gross, gross > 0).alias("gross_profit"), total(gross, gross < 0).alias("gross_loss"), total(F.col("costs")).alias("total_costs"),
        (F.count(F.when(wins, 1)) / count).alias("win_rate"), (F.count(F.when(losses, 1)) / count).alias("loss_rate"),
        mean().alias("average_trade"), mean(wins).alias("average_winner"), mean(losses).alias("average_loser"),
        F.coalesce(F.max(F.when(wins, net)), F.lit(0)).cast(MONEY).alias("largest_win"), F.coalesce(F.min(F.when(losses, net)), F.lit(0)).cast(MONEY).alias("largest_loss"),
        _over_zero(F.sum(held), F.nullif(F.greatest(span, F.lit(0)), F.lit(0))).alias("exposure"),
    )
    rows = rows.withColumns({
        "profit_factor": _over_zero(F.col("gross_profit"), F.nullif(F.abs("gross_loss"), F.lit(0).cast(MONEY))), "expectancy": F.col("average_trade"),
        "risk_reward": _over_zero(F.col("average_winner"), F.nullif(F.abs("average_loser"), F.lit(0).cast(MONEY))),
    })
    if equity is None:
        return rows
    curve = equity_statistics(equity, *keys, frequency=frequency, risk_free=risk_free)
    return rows.join(curve, [*keys], "left").withColumn("max_drawdown_pct", 100 * F.col("max_drawdown"))


FEES = {  # Fixed values: shares of turnover and the cap of an order's brokerage
    "brokerage": 0.0003, "brokerage_cap": 20, "exchange": 0.0000345, "regulator": 0.000002, "stamp": 0.00003, "service": 0.18,
    "intraday_sell": 0.00025, "delivery": 0.001,
}


def fees(side: Column, quantity: Column, price: Column, product: Column | None = None) -> Column:
    """The parts of a fill's fees, each rounded to two places, as a struct.

    Delivery pays the transaction tax on both sides, intraday on sales; a null
    product is intraday, and another one is an error.
    """
    turnover = (quantity.cast(EXACT) * price.cast(EXACT)).cast("decimal(30,6)")
    product = F.coalesce(product if product is not None else F.lit("INTRADAY"), F.lit("INTRADAY"))

    def part(rate: float) -> Column:
        return F.round(turnover * F.lit(f"{rate:.8f}").cast("decimal(12,8)"), 2).cast(MONEY)

    broker = F.least(F.round(turnover * F.lit(f"{FEES['brokerage']:.8f}").cast("decimal(12,8)"), 2).cast(MONEY), F.lit(FEES["brokerage_cap"]).cast(MONEY))
    tax = F.when(product == "DELIVERY", part(FEES["delivery"])).when(product != "INTRADAY", F.raise_error(F.lit("no fee schedule for this product")).cast(MONEY))
    tax = tax.when(side == "SELL", part(FEES["intraday_sell"])).otherwise(F.lit(0).cast(MONEY))
    exchange, regulator = part(FEES["exchange"]), part(FEES["regulator"])
    service = F.round((broker + exchange + regulator) * F.lit("0.18").cast("decimal(4,2)"), 2).cast(MONEY)
    return F.struct(broker.alias("brokerage"), tax.alias("transaction_tax"), exchange.alias("exchange_fee"), regulator.alias("regulator_fee"), part(FEES["stamp"]).alias("stamp"), service.alias("service_tax"))


def stop_gap_price(kind: Column, side: Column, level: Column, low: Column, high: Column, gap_bps: float = 25.0, least: float = 0.01) -> Column:
    """Where a triggered protective leg fills: a target at its level, a stop at the worse of the level moved by the gap and the bar's own extreme."""
    k = gap_bps / 10_000
    long = side == "BUY"
    worse = F.when(long, F.least(level * (1 - k), low)).otherwise(F.greatest(level * (1 + k), high))
    return F.when(kind != "stop", level).otherwise(F.greatest(worse, F.lit(least)))
