"""Row expressions: time grids, session masks, prices and order flow."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.schema import INTERVALS, SESSION_CLOSE, SESSION_OPEN, TIMEFRAME_SECONDS


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def in_session(ts: Column, weekdays_only: bool = False) -> Column:
    """From 09:15:00 to 15:30:00, both ends included."""
    inside = seconds_of_day(ts).between(SESSION_OPEN, SESSION_CLOSE)
    return inside & (F.weekday(ts) < 5) if weekdays_only else inside


def bucket(ts: Column, timeframe: str, grid: str = "clock") -> Column:
    """Start of a bar on the clock's grid, or on the session's, which opens at 09:15."""
    if timeframe not in TIMEFRAME_SECONDS or grid not in ("clock", "session"):
        raise ValueError(f"unknown timeframe or grid: {timeframe}, {grid}")
    if timeframe == "1w":
        return F.date_trunc("week", ts)
    if timeframe == "1d":
        return F.date_trunc("day", ts)
    every = INTERVALS[timeframe]
    shift = "15 minutes" if grid == "session" and timeframe in ("30m", "1h") else "0 minutes"
    return F.window(ts, every, every, shift)["start"]


def price_source(name: str) -> Column:
    """open, high, low, close, volume, hl2, hlc3 or ohlc4; any other name is close."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    known = {"open": o, "high": h, "low": l, "close": c, "volume": F.col("volume"), "hl2": (h + l) / 2, "hlc3": (h + l + c) / 3, "ohlc4": (o + h + l + c) / 4}
    return known.get(name, c)


def valid_bar() -> Column:
    """Whether prices are positive and ordered and the volume isn't negative; nulls and NaN fail."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    real = ~(F.isnan(o) | F.isnan(h) | F.isnan(l) | F.isnan(c))
    ordered = (h >= F.greatest(o, c)) & (l <= F.least(o, c)) & (h >= l) & (F.least(o, h, l, c) > 0) & (v >= 0)
    return F.coalesce(real & ordered, F.lit(False))


def compare(value: Column, operator: str, threshold: Column | float | None) -> Column:
    """A condition; a null on either side, or an unknown operator, doesn't match."""
    if threshold is None:
        return F.lit(False)
    t = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    tests = {">": value > t, ">=": value >= t, "<": value < t, "<=": value <= t, "==": value == t, "!=": value != t}
    return F.coalesce(tests.get(operator, F.lit(False)), F.lit(False))


def price_step(price: Column, step: float) -> Column:
    """Number of the price step that a price rounds to, halves upward."""
    return F.floor(price / step + 0.5).cast("long")


def imbalance(bid: Column, ask: Column) -> Column:
    """(bid - ask) / (bid + ask), 0 without quantity."""
    return F.coalesce(F.try_divide(bid - ask, F.nullif(bid + ask, F.lit(0.0))), F.lit(0.0))


def stop_hit(side: Column, low: Column, high: Column, stop: Column) -> Column:
    return F.when(side == "BUY", low <= stop).otherwise(high >= stop)


def target_hit(side: Column, low: Column, high: Column, target: Column) -> Column:
    return F.when(side == "BUY", high >= target).otherwise(low <= target)


def slipped(price: Column, side: Column, percent: float) -> Column:
    """A price moved against the trader by ``percent``."""
    return price * F.when(side == "BUY", 1 + percent / 100).otherwise(1 - percent / 100)


def normalized_symbol(symbol: Column) -> Column:
    """Upper case, trimmed, without an exchange prefix or a series suffix."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(symbol)), r"^[A-Z]+:", ""), r"[-.](?:EQ|BE|NS|BO)$", "")


def bucket_price(price: Column, step: float) -> Column:
    """The price of a price's step, without the dust of binary fractions beyond eight places."""
    return F.floor(price_step(price, step) * step * 1e8 + 0.5) / 1e8


INSTRUMENT = "struct<exchange:string,underlying:string,expiry:date,strike:decimal(20,4),right:string,asset_class:string>"


def parsed_instrument(key: Column) -> Column:
    """The parts of EXCHANGE:UNDERLYING[:YYYYMMDD|FUT][:STRIKE|RIGHT][:RIGHT] as a struct; null for a malformed key."""
    part = F.split(F.trim(key), ":")
    third, fourth, fifth = (F.nullif(F.get(part, F.lit(i)), F.lit("")) for i in (2, 3, 4))
    is_future = F.coalesce(F.upper(third) == "FUT", F.lit(False))
    expiry = F.when(~is_future & third.rlike("^[0-9]{8}$"), F.to_date(F.try_to_timestamp(third, F.lit("yyyyMMdd"))))
    named = F.upper(fourth).isin("CE", "PE", "FUT")
    strike = F.when(~F.coalesce(named, F.lit(False)), fourth.try_cast("decimal(20,4)"))
    right = F.coalesce(F.upper(fifth), F.when(named, F.upper(fourth)), F.when(is_future, F.lit("FUT")), F.when(expiry.isNotNull(), F.lit("FUT")))
    kind = F.when(right == "FUT", "FUTURE").when(right.isin("CE", "PE"), "OPTION").otherwise("EQUITY")
    wrong = (F.size(part) < 2) | (third.isNotNull() & ~is_future & expiry.isNull()) | (fourth.isNotNull() & ~F.coalesce(named, F.lit(False)) & strike.isNull())
    made = F.struct(F.upper(F.get(part, F.lit(0))).alias("exchange"), F.upper(F.get(part, F.lit(1))).alias("underlying"), expiry.alias("expiry"), strike.alias("strike"), right.alias("right"), kind.alias("asset_class"))
    return F.when(~F.coalesce(wrong, F.lit(True)), made)


def instrument_key(parts: Column) -> Column:
    """The key of a struct as ``parsed_instrument`` gives it; whole strikes have no fraction."""
    strike = parts["strike"]
    text = F.when(strike == F.floor(strike), strike.cast("long").cast("string")).otherwise(F.regexp_replace(strike.cast("string"), "0+$", ""))
    return F.concat_ws(":", parts["exchange"], parts["underlying"], F.date_format(parts["expiry"], "yyyyMMdd"), text, parts["right"])


def parameters_digest(parameters: dict) -> str:
    """A short digest of parameters, whatever their order."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:24]


#: The colours of gains and losses, and the alphas of the palest and the strongest.
GAIN, LOSS, PALE, STRONG = "#089981", "#F23745", 0.1, 0.5


def ramp_colour(value: Column, cutoff: float, gain: str = GAIN, loss: str = LOSS) -> Column:
    """#rrggbbaa of a value: by its sign, and the stronger the nearer it is to ``cutoff``; null for what isn't a number."""
    share = F.least(F.lit(1.0), F.abs(value) / cutoff) if cutoff > 0 else F.lit(1.0)
    alpha = F.floor((PALE + (STRONG - PALE) * share) * 255 + 0.5).cast("int")
    known = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(known, F.concat(F.when(value >= 0, gain).otherwise(loss), F.lpad(F.lower(F.hex(alpha)), 2, "0")))


def is_ignored_month(month: Column, listed: str) -> Column:
    """Whether a month (1 to 12) is in a list like "1, 5,12"; what isn't a month is passed over."""
    months = [int(x) for x in listed.split(",") if x.strip().isdigit() and 1 <= int(x) <= 12]
    return month.isin(months) if months else F.lit(False)
