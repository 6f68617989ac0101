"""Backtests: signals filled at the next bar's open, protective exits, corporate actions and an account, bar by bar.

A run is one symbol under one account. What a bar does depends on all that came
before it, so a symbol's bars are one ordered scan, in exact decimals; symbols
run side by side. Each bar, in this order: corporate actions that are due; the
order of the bar before, at the open; the protective exit; cash and the position
at the close join the equity curve.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans import trades

D = Decimal
ZERO, CENT, TICK = D("0.00"), D("0.01"), D("0.0001")
EVENTS = (
    "symbol string, ts timestamp_ntz, kind string, side string, quantity decimal(28,4), price decimal(28,4), fee decimal(28,2), "
    "cash decimal(28,2), position decimal(28,4), average decimal(28,2), realised decimal(28,2), equity decimal(28,2), reason string"
)


def q2(x: Decimal) -> Decimal:
    return x.quantize(CENT, ROUND_HALF_UP)


@dataclass(frozen=True)
class Costs:
    """Slippage of market orders, the gap past a stop, and fees by product."""

    slippage_pct: float = 0.0
    stop_gap_bps: float = 25.0
    product: str = "INTRADAY"
    charged: bool = True

    def fee(self, side: str, quantity: Decimal, price: Decimal) -> Decimal:
        if not self.charged:
            return ZERO
        rate = {k: D(str(v)) for k, v in trades.FEES.items()}
        turnover = quantity * price
        broker = q2(min(turnover * rate["brokerage"], rate["brokerage_cap"]))
        exchange, regulator = q2(turnover * rate["exchange"]), q2(turnover * rate["regulator"])
        tax = rate["delivery"] if self.product == "DELIVERY" else rate["intraday_sell"] if side == "SELL" else ZERO
        return broker + exchange + regulator + q2(turnover * tax) + q2(turnover * rate["stamp"]) + q2((broker + exchange + regulator) * rate["service"])


class Account:
    """Cash and one position; money is rounded to cents at every step."""

    def __init__(self, cash: Decimal) -> None:
        self.cash, self.position, self.average, self.realised = cash, D(0), ZERO, ZERO
        self.opened: dt.date | None = None

    def affords(self, side: str, quantity: Decimal, price: Decimal, fee: Decimal) -> bool:
        """A purchase and its fee must be covered; a sale must cover its fee."""
        return self.cash - fee >= (q2(quantity * price) if side == "BUY" else -q2(quantity * price))

    def fill(self, side: str, quantity: Decimal, price: Decimal, fee: Decimal, day: dt.date) -> None:
        signed = quantity if side == "BUY" else -quantity
        before = self.position
        if before * signed >= 0:
            self.average = q2((self.average * abs(before) + price * quantity) / (abs(before) + quantity))
            self.opened = self.opened if before else day
        else:
            closed = min(quantity, abs(before))
            self.realised = q2(self.realised + (price - self.average) * closed * (1 if before > 0 else -1))
            if quantity > abs(before):
                self.average, self.opened = q2(price), day
        self.position = before + signed
        if not self.position:
            self.average, self.opened = ZERO, None
        self.cash = q2(self.cash - signed * price - fee)

    def act(self, kind: str, ratio: Decimal, amount: Decimal) -> None:
        """A split or bonus leaves the position's value as it is, up to rounding, which cash takes; a dividend is paid on the signed quantity."""
        if kind in ("SPLIT", "BONUS") and ratio > 0:
            basis = self.average * self.position
            self.position, self.average = (self.position * ratio).quantize(TICK), q2(self.average / ratio)
            self.cash = q2(self.cash + basis - self.average * self.position)
        elif kind == "DIVIDEND":
            paid = q2(amount * self.position)
            self.cash, self.realised = q2(self.cash + paid), q2(self.realised + paid)


def _run_symbol(bars: pd.DataFrame, signals: pd.DataFrame, actions: pd.DataFrame, capital: Decimal, quantity: Decimal, costs: Costs) -> pd.DataFrame:
    """Rows of events (fill, refused, unfilled, action) and one ``bar`` row for each bar."""
    if not len(bars):
        return pd.DataFrame(columns=[c.split()[0] for c in EVENTS.split(", ")])
    symbol = bars["symbol"].iloc[0]
    account = Account(capital)
    due = sorted((r.ex_date, r.action_type, D(str(r.ratio or 0)), D(str(r.amount or 0))) for r in actions.itertuples())
    by_bar: dict[object, list] = {}
    for s in signals.sort_values(["ts", "n"], kind="stable").itertuples():
        by_bar.setdefault(s.ts, []).append(s)
    out: list[tuple] = []
    waiting: list = []
    bracket: tuple[str, Decimal, Decimal, Decimal] | None = None  # side, quantity, stop, target
    slip, gap = D(str(costs.slippage_pct)) / 100, D(str(costs.stop_gap_bps)) / 10_000
    mark = ZERO

    def note(ts, kind, side=None, units=None, price=None, fee=None, reason=None) -> None:
        equity = q2(account.cash + account.position * mark)
        out.append((symbol, ts, kind, side, units, price, fee, account.cash, account.position, account.average, account.realised, equity, reason))

    def trade(ts, side, units, price, reason) -> bool:
        price = max(price, CENT).quantize(TICK, ROUND_HALF_UP)
        fee = costs.fee(side, units, price)
        if not account.affords(side, units, price, fee):
            note(ts, "refused", side, units, price, fee, "cash")
            return False
        account.fill(side, units, price, fee, ts.date())
        note(ts, "fill", side, units, price, fee, reason)
        return True

    for bar in bars.sort_values("ts", kind="stable").itertuples():
        o, h, l, c = (D(str(x)) for x in (bar.open, bar.high, bar.low, bar.close))  # noqa: E741
        while due and due[0][0] <= bar.ts.date():
            day, kind, ratio, amount = due.pop(0)
            if account.position and account.opened <= day:  # a lot bought after the day is owed nothing
                account.act(kind, ratio, amount)
                if bracket and kind in ("SPLIT", "BONUS") and ratio > 0:
                    bracket = (bracket[0], (bracket[1] * ratio).quantize(TICK), bracket[2] / ratio, bracket[3] / ratio)
                note(bar.ts, "action", reason=kind)
        if waiting:
            s = waiting.pop(0)
            price = o * (1 + slip) if s.side == "BUY" else o * (1 - slip)
            if trade(bar.ts, s.side, quantity, price, "signal"):
                if bracket and bracket[0] != s.side:
                    bracket = None
                sign = 1 if s.side == "BUY" else -1
                legs = None if pd.isna(s.stop) or pd.isna(s.target) else (D(str(s.stop)), D(str(s.target)))
                if legs and sign * account.position > 0 and sign * (price - legs[0]) > 0 and sign * (legs[1] - price) > 0:
                    bracket = (s.side, quantity, *legs)
        if bracket and not account.position:
            bracket = None
        if bracket:
            side, units, stop, target = bracket
            long = side == "BUY"
            at_stop, at_target = (l <= stop, h >= target) if long else (h >= stop, l <= target)
            if at_stop or at_target:
                price = target if not at_stop else min(stop * (1 - gap), l) if long else max(stop * (1 + gap), h)
                bracket = None
                trade(bar.ts, "SELL" if long else "BUY", units, price, "stop" if at_stop else "target")
        mark = c
        note(bar.ts, "bar")
        waiting += by_bar.pop(bar.ts, [])
    for s in waiting + [s for late in by_bar.values() for s in late]:
        note(s.ts, "unfilled", s.side, reason="no later bar")
    return pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])


def run(bars: DataFrame, signals: DataFrame, capital: float = 1_000_000, quantity: float = 1, costs: Costs = Costs(), actions: DataFrame | None = None) -> DataFrame:
    """What happened, in order within a symbol (column ``at``): one ``bar`` row a bar, and one for each fill, refusal, action and unfilled signal.

    ``signals`` has symbol, ts (of the bar that decided), side, and perhaps stop,
    target and n (the order within a bar). ``actions`` has symbol, ex_date,
    action_type, ratio and amount; each is applied once, to lots held on its day.
    """
    have = set(signals.columns)
    asked = signals.select("symbol", "ts", "side", *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (("stop", "double"), ("target", "double"), ("n", "long"))))
    empty = bars.sparkSession.createDataFrame([], "symbol string, ex_date date, action_type string, ratio double, amount double")
    due = (actions if actions is not None else empty).select("symbol", F.col("ex_date").cast("date").alias("ex_date"), F.upper("action_type").alias("action_type"), F.col("ratio").cast("double"), F.col("amount").cast("double")).distinct()
    lists = asked.groupBy("symbol").agg(F.collect_list(F.struct("ts", "side", "stop", "target", "n")).alias("signals"))
    owed = due.groupBy("symbol").agg(F.collect_list(F.struct("ex_date", "action_type", "ratio", "amount")).alias("actions"))
    extra = lists.join(owed, "symbol", "full")
    cash, units = D(str(capital)), D(str(quantity))

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        def table(name: str, columns: list[str]) -> pd.DataFrame:
            found = right[name].iloc[0] if len(right) else None
            return pd.DataFrame([] if found is None else [x if isinstance(x, dict) else x.asDict() for x in found], columns=columns)

        asked = table("signals", ["ts", "side", "stop", "target", "n"])
        asked["ts"] = pd.to_datetime(asked["ts"])
        made = _run_symbol(left, asked, table("actions", ["ex_date", "action_type", "ratio", "amount"]), cash, units, costs)
        return made.assign(at=range(len(made)))

    own = bars.select("symbol", "ts", "open", "high", "low", "close")
    return own.groupBy("symbol").cogroup(extra.groupBy("symbol")).applyInPandas(one, EVENTS + ", at int")


def result(events: DataFrame, frequency: str = "daily") -> DataFrame:
    """One row a symbol: return, Sharpe ratio, drawdown, fees, counts of fills, refusals and unfilled signals, and where the run ended."""
    curve = events.filter("kind = 'bar'").select("symbol", F.col("at").alias("ts"), F.col("equity").cast("double").alias("value"))
    figures = trades.equity_statistics(curve, "symbol", frequency=frequency)
    last = F.max_by(F.struct("cash", "position", "average", "realised", "equity"), "at")
    counts = {n: F.count(F.when(F.col("kind") == k, 1)) for n, k in (("n_fills", "fill"), ("n_refused", "refused"), ("n_unfilled", "unfilled"), ("n_actions", "action"), ("n_bars", "bar"))}
    rows = events.groupBy("symbol").agg(*(e.alias(n) for n, e in counts.items()), F.coalesce(F.sum(F.when(F.col("kind") == "fill", F.col("fee"))), F.lit(0)).cast(trades.MONEY).alias("fees"), last.alias("end"))
    ends = curve.groupBy("symbol").agg(F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last"))
    total = F.coalesce(F.try_divide(F.col("last") - F.col("first"), F.col("first")), F.lit(0.0))
    return rows.join(figures, "symbol", "left").join(ends, "symbol", "left").select("symbol", *counts, "fees", "end.*", total.alias("total_return"), "sharpe", "max_drawdown")


def split_adjusted(bars: DataFrame, actions: DataFrame, point_in_time: bool = False) -> DataFrame:
    """Prices over the product of split and bonus ratios: of all of a symbol's actions, or of those whose day is still to come at the bar."""
    ratios = actions.filter(F.upper("action_type").isin("SPLIT", "BONUS") & (F.col("ratio") > 0)).select("symbol", F.col("ex_date").cast("date").alias("day"), F.ln(F.col("ratio").cast("double")).alias("step"))
    prices = ("open", "high", "low", "close")
    if not point_in_time:
        whole = ratios.groupBy("symbol").agg(F.exp(F.sum("step")).alias("factor"))
        return bars.join(whole, "symbol", "left").withColumns({c: F.col(c) / F.coalesce("factor", F.lit(1.0)) for c in prices}).drop("factor")
    # steps and bars in one ordered list: what comes later on a symbol's line applies
    both = bars.withColumns({"_step": F.lit(0.0), "_day": F.to_date("ts"), "_is": F.lit(1)}).unionByName(ratios.select("symbol", F.col("day").alias("_day"), F.col("step").alias("_step"), F.lit(0).alias("_is")), allowMissingColumns=True)
    later = Window.partitionBy("symbol").orderBy(F.desc("_day"), F.desc("_is")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.sum(F.when(F.col("_is") == 0, F.col("_step")).otherwise(0.0)).over(later)
    return both.withColumn("_f", F.exp(after)).filter("_is = 1").withColumns({c: F.col(c) / F.col("_f") for c in prices}).drop("_step", "_day", "_is", "_f")
