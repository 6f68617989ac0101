"""Indicators that need a recurrence or a state machine over a symbol's bars.

All that are asked for together run in one grouped scan: one shuffle by symbol,
one pass of small kernels over numpy arrays. NaN stands for "not yet defined"
inside the kernels and becomes null in the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barloom.functions import indicators as windowed

NAN = float("nan")


@dataclass
class Bars:
    """One symbol's bars, by time."""

    o: np.ndarray
    h: np.ndarray
    l: np.ndarray  # noqa: E741
    c: np.ndarray
    v: np.ndarray
    ts: np.ndarray

    @property
    def hl2(self) -> np.ndarray:
        return (self.h + self.l) / 2

    @property
    def hlc3(self) -> np.ndarray:
        return (self.h + self.l + self.c) / 3

    def source(self, name: str) -> np.ndarray:
        return {"open": self.o, "high": self.h, "low": self.l, "volume": self.v, "hl2": self.hl2, "hlc3": self.hlc3, "ohlc4": (self.o + self.h + self.l + self.c) / 4}.get(name, self.c)


SCANS: dict[str, tuple[Callable[..., dict[str, np.ndarray]], dict, tuple[str, ...]]] = {}


def scan(name: str, plots: str, **defaults):
    def keep(kernel):
        SCANS[name] = (kernel, defaults, tuple(plots.split(",")))
        return kernel

    return keep


# Kernels shared by the indicators


def smooth(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Exponential smoothing that starts with the mean of the first n defined values; a gap holds the state."""
    out = np.full(len(x), NAN)
    at = np.flatnonzero(np.isfinite(x))
    if len(at) < n:
        return out
    value = x[at[:n]].mean()
    out[at[n - 1]] = value
    for i in at[n:]:
        value += alpha * (x[i] - value)
        out[i] = value
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 2 / (n + 1))


def rma(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 1 / n)


def shift(x: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.full(len(x), NAN)
    if n == 0:
        return x.astype(float)
    if n > 0:
        out[n:] = x[:-n] if n < len(x) else []
    else:
        out[:n] = x[-n:] if -n < len(x) else []
    return out


def rolling(x: np.ndarray, n: int, fn) -> np.ndarray:
    """``fn`` along windows of n values; undefined where one is."""
    out = np.full(len(x), NAN)
    if len(x) >= n:
        out[n - 1 :] = fn(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)
    return out


def sma(x: np.ndarray, n: int) -> np.ndarray:
    return rolling(x, n, np.mean)


def true_range(b: Bars) -> np.ndarray:
    before = np.concatenate([b.c[:1], b.c[:-1]])
    out = np.maximum(b.h - b.l, np.maximum(np.abs(b.h - before), np.abs(b.l - before)))
    if len(out):
        out[0] = b.h[0] - b.l[0]
    return out


def atr(b: Bars, n: int) -> np.ndarray:
    return rma(true_range(b), n)


def moving(kind: str, x: np.ndarray, n: int, volume: np.ndarray) -> np.ndarray:
    """A moving average by its name; an unknown name is the simple one."""
    kind, n = kind.upper(), max(1, int(n))
    if kind in ("EMA", "EXPONENTIAL"):
        return ema(x, n)
    if kind == "SMMA (RMA)":
        return rma(x, n)
    if kind in ("WMA", "WEIGHTED"):
        return rolling(x, n, lambda w, axis: np.average(w, axis=axis, weights=np.arange(1, n + 1)))
    if kind == "VWMA":
        return ratio(rolling(x * volume, n, np.sum), rolling(volume, n, np.sum))
    return sma(x, n)


def smoothed(x: np.ndarray, kind: str, n: int, mult: float, volume: np.ndarray, names: tuple[str, str, str] = ("ma", "bbUpper", "bbLower")) -> dict[str, np.ndarray]:
    """An average over the line ``x``, and bands around it where ``kind`` asks for them."""
    none = np.full(len(x), NAN)
    ma = none if kind == "None" else moving(kind, x, n, volume)
    band = mult * rolling(x, max(1, int(n)), np.std) if kind == "SMA + Bollinger Bands" else none
    return dict(zip(names, (ma, ma + band, ma - band)))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, NAN, a / b)


def change(x: np.ndarray) -> np.ndarray:
    return x - shift(x)


def rsi(x: np.ndarray, n: int) -> np.ndarray:
    d = change(x)
    up, down = rma(np.where(np.isnan(d), NAN, np.maximum(d, 0)), n), rma(np.where(np.isnan(d), NAN, np.maximum(-d, 0)), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(up), NAN, np.where(down == 0, 100.0, 100 - 100 / (1 + up / np.where(down == 0, 1, down))))


# Smoothed indicators


@scan("ema", "value", length=20, source="close")
def _ema(b, length, source):
    return {"value": ema(b.source(source), length)}


@scan("smma", "smma", length=7, source="close")
def _smma(b, length, source):
    return {"smma": rma(b.source(source), length)}


@scan("dema", "value", length=9)
def _dema(b, length):
    e1 = ema(b.c, length)
    return {"value": 2 * e1 - ema(e1, length)}


@scan("tema", "value", length=9)
def _tema(b, length):
    e1 = ema(b.c, length)
    e2 = ema(e1, length)
    return {"value": 3 * (e1 - e2) + ema(e2, length)}


@scan("t3", "t3", length=5, factor=0.7, source="close")
def _t3(b, length, factor, source):
    x = b.source(source)
    for _ in range(3):
        e = ema(x, length)
        x = e * (1 + factor) - ema(e, length) * factor
    return {"t3": x}


@scan("rsi", "value", length=14, source="close")
def _rsi(b, length, source):
    return {"value": rsi(b.source(source), length)}


@scan("macd", "macd,signal,histogram", fastPeriod=12, slowPeriod=26, signalPeriod=9, source="close")
def _macd(b, fast, slow, signal, source):
    x = b.source(source)
    line = ema(x, fast) - ema(x, slow)
    mark = ema(line, signal)
    return {"macd": line, "signal": mark, "histogram": line - mark}


@scan("atr", "value", period=14)
def _atr(b, period):
    return {"value": atr(b, period)}


@scan("keltner-channel", "upper,middle,lower", period=20, mult=2.0, atrlength=10)
def _keltner(b, period, mult, atrlength):
    m, r = ema(b.c, period), atr(b, atrlength)
    return {"upper": m + mult * r, "middle": m, "lower": m - mult * r}


@scan("median", "median,upper,lower,median_ema", length=3, atr_length=14, atr_mult=2.0)
def _median(b, length, atr_length, mult):
    rank = -(-length // 2) - 1
    m = rolling(b.hl2, length, lambda w, axis: np.sort(w, axis=axis)[:, rank])
    r = atr(b, atr_length)
    return {"median": m, "upper": m + mult * r, "lower": m - mult * r, "median_ema": ema(m, length)}


@scan("ppo", "ppo,signal,hist", fastLength=12, slowLength=26, signalLength=9, oscType="EMA", sigType="EMA")
def _ppo(b, fast, slow, signal, kind, signal_kind):
    f, s = moving(kind, b.c, fast, b.v), moving(kind, b.c, slow, b.v)
    line = 100 * ratio(f - s, s)
    mark = moving(signal_kind, line, signal, b.v)
    return {"ppo": line, "signal": mark, "hist": line - mark}


@scan("pvo", "hist,pvo,signal", fastLength=12, slowLength=26, signalLength=9)
def _pvo(b, fast, slow, signal):
    f, s = ema(b.v, fast), ema(b.v, slow)
    line = 100 * ratio(f - s, s)
    mark = ema(line, signal)
    return {"hist": line - mark, "pvo": line, "signal": mark}


@scan("trix", "value", length=18)
def _trix(b, length):
    x = np.log(np.where(b.c > 0, b.c, NAN))
    return {"value": 10000 * change(ema(ema(ema(x, length), length), length))}


def _strength(x: np.ndarray, long: int, short: int) -> np.ndarray:
    d = change(x)
    return 100 * ratio(ema(ema(d, long), short), ema(ema(np.abs(d), long), short))


@scan("tsi", "tsi,signal", long=25, short=13, signal=13)
def _tsi(b, long, short, signal):
    line = _strength(b.c, long, short)
    return {"tsi": line, "signal": ema(line, signal)}


@scan("smi-ergodic-indicator", "erg,sig", longlen=20, shortlen=5, siglen=5)
def _erg(b, long, short, signal):
    line = _strength(b.c, long, short)
    return {"erg": line, "sig": ema(line, signal)}


@scan("smi-ergodic-oscillator", "osc", longlen=20, shortlen=5, siglen=5)
def _erg_osc(b, long, short, signal):
    line = _strength(b.c, long, short)
    return {"osc": line - ema(line, signal)}


@scan("smi", "smi,ema", lengthK=10, lengthD=3, lengthEMA=3)
def _smi(b, k, d, e):
    top, low = rolling(b.h, k, np.max), rolling(b.l, k, np.min)
    line = 200 * ratio(ema(ema(b.c - (top + low) / 2, d), d), ema(ema(top - low, d), d))
    return {"smi": line, "ema": ema(line, e)}


@scan("stochastic-rsi", "k,d", lengthRSI=14, lengthStoch=14, smoothK=3, smoothD=3)
def _stoch_rsi(b, n, m, k, d):
    r = rsi(b.c, n)
    low, top = rolling(r, m, np.min), rolling(r, m, np.max)
    line = sma(100 * ratio(r - low, top - low), k)
    return {"k": line, "d": sma(line, d)}


@scan("chaikin-volatility", "chaikinVolatility", periods=10, rocLookback=10)
def _chaikin_vol(b, n, back):
    e = ema(b.h - b.l, n)
    return {"chaikinVolatility": 100 * ratio(e - shift(e, back), shift(e, back))}


@scan("chop-zone", "chopZone,angle")
def _chop_zone(b):
    """The plotted value is 1 on every bar; the angle carries the zone."""
    low = rolling(b.l, 30, np.min)
    e, span = ema(b.c, 34), rolling(b.h, 30, np.max) - low
    rise = ratio(shift(e) - e, b.hlc3) * ratio(np.full(len(span), 25.0), span) * low
    angle = np.round(np.degrees(np.arccos(1 / np.sqrt(1 + rise**2))))
    return {"chopZone": np.ones(len(angle)), "angle": np.where(rise > 0, -angle, angle) + 0.0}


@scan("chandelier-exit", "longExit,shortExit", length=22, atrLength=22, atrMultiplier=3.0)
def _chandelier(b, n, m, k):
    r = k * atr(b, m)
    return {"longExit": rolling(b.h, n, np.max) - r, "shortExit": rolling(b.l, n, np.min) + r}


@scan("chande-kroll-stop", "stopLong,stopShort", p=10, x=1, q=9)
def _kroll(b, p, x, q):
    r = x * atr(b, p)
    high, low = rolling(b.h, p, np.max) - r, rolling(b.l, p, np.min) + r
    return {"stopLong": rolling(low, q, np.min), "stopShort": rolling(high, q, np.max)}


def money_flow(b: Bars) -> np.ndarray:
    return np.nan_to_num(ratio((b.c - b.l) - (b.h - b.c), b.h - b.l)) * b.v


@scan("chaikin-oscillator", "osc", short=3, long=10)
def _chaikin_osc(b, short, long):
    line = np.cumsum(money_flow(b))
    return {"osc": ema(line, short) - ema(line, long)}


@scan("elder-force-index", "efi", length=13)
def _efi(b, length):
    return {"efi": ema(change(b.c) * b.v, length)}


def _volume_index(b: Bars, n: int, sign: int, name: str) -> dict[str, np.ndarray]:
    moved = sign * change(b.v) > 0
    step = np.where(moved, np.log(np.where(moved, ratio(b.c, shift(b.c)), 1.0)), 0.0)
    line = 1000 * np.exp(np.cumsum(np.nan_to_num(step)))
    return {name: line, "ema": ema(line, n)}


@scan("nvi", "nvi,ema", maLength=255)
def _nvi(b, n):
    return _volume_index(b, n, -1, "nvi")


@scan("pvi", "pvi,ema", maLength=255)
def _pvi(b, n):
    return _volume_index(b, n, 1, "pvi")


@scan("mass-index", "mi", length=10)
def _mass(b, length):
    e = ema(b.h - b.l, 9)
    return {"mi": rolling(ratio(e, ema(e, 9)), length, np.sum)}


@scan("klinger-oscillator", "kvo,signal")
def _klinger(b):
    d = change(b.hlc3)
    signed = np.where(d >= 0, b.v, -b.v)
    line = ema(signed, 34) - ema(signed, 55)
    return {"kvo": line, "signal": ema(line, 13)}


@scan("alligator", "jaw,teeth,lips", jawLength=13, jawOffset=8, teethLength=8, teethOffset=5, lipsLength=5, lipsOffset=3)
def _alligator(b, n1, s1, n2, s2, n3, s3):
    return {"jaw": shift(rma(b.hl2, n1), s1), "teeth": shift(rma(b.hl2, n2), s2), "lips": shift(rma(b.hl2, n3), s3)}


@scan("wavetrend", "mom,wt1,wt2", n1=10, n2=21, sigLen=4)
def _wavetrend(b, n1, n2, sig):
    mid = ema(b.hlc3, n1)
    line = ema(ratio(b.hlc3 - mid, 0.015 * ema(np.abs(b.hlc3 - mid), n1)), n2)
    mark = sma(line, sig)
    return {"mom": line - mark, "wt1": line, "wt2": mark}


@scan("relative-volatility-index", "rvi,ma,bb_upper,bb_lower", length=10, offset=0, maType="SMA", maLength=14, bbMult=2.0)
def _rvi(b, length, offset, kind, ma_length, mult):
    sd, d = rolling(b.c, length, np.std), change(b.c)
    up, down = np.where(np.isnan(sd), NAN, np.where(d > 0, sd, 0.0)), np.where(np.isnan(sd), NAN, np.where(d <= 0, sd, 0.0))
    line = 100 * ratio(ema(up, 14), ema(up, 14) + ema(down, 14))
    return {"rvi": shift(line, round(offset)), **smoothed(line, kind, ma_length, mult, b.v, ("ma", "bb_upper", "bb_lower"))}


# State machines


@scan("adx", "plusDi,minusDi,adx", period=14, adxPeriod=14)
def _adx(b, period, adx_period):
    up, down = change(b.h), -change(b.l)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = true_range(b)
    tr[:1] = NAN
    r = rma(tr, period)
    pdi, mdi = 100 * ratio(rma(plus, period), r), 100 * ratio(rma(minus, period), r)
    for x in (pdi, mdi):  # no range: the last value stays
        for i in np.flatnonzero(r == 0):
            x[i] = x[i - 1] if i else NAN
    total = pdi + mdi
    dx = np.where(np.isnan(total), NAN, 100 * np.abs(pdi - mdi) / np.where(total == 0, 1, total))
    return {"plusDi": pdi, "minusDi": mdi, "adx": rma(dx, adx_period)}


@scan("supertrend", "line,up,down,direction", period=10, multiplier=3.0)
def _supertrend(b, period, multiplier):
    r, n = atr(b, period), len(b.c)
    line, direction = np.full(n, NAN), np.full(n, NAN)
    upper = lower = held = NAN
    for i in np.flatnonzero(np.isfinite(r)):
        top, low = b.hl2[i] + multiplier * r[i], b.hl2[i] - multiplier * r[i]
        old = upper
        if np.isfinite(upper):
            top = top if top < upper or b.c[i - 1] > upper else upper
            low = low if low > lower or b.c[i - 1] < lower else lower
        upper, lower = top, low
        falling = b.c[i] <= upper if np.isnan(held) or held == old else b.c[i] < lower
        held = upper if falling else lower
        line[i], direction[i] = held, -1.0 if falling else 1.0
    return {"line": line, "up": np.where(direction > 0, line, NAN), "down": np.where(direction < 0, line, NAN), "direction": direction}


@scan("mcginley-dynamic", "value", period=14)
def _mcginley(b, period):
    out = np.full(len(b.c), NAN)
    value = NAN
    for i in range(period - 1, len(b.c)):
        if np.isfinite(value) and value != 0:
            step = period * (b.c[i] / value) ** 4
            value = value + (b.c[i] - value) / step if step > 1e-300 else NAN
        if not np.isfinite(value):
            value = b.c[i - period + 1 : i + 1].mean()
        out[i] = value
    return {"value": out}


@scan("fisher-transform", "fisher,trigger", length=9)
def _fisher(b, length):
    """A window without a span is undefined and starts both recurrences anew."""
    low = rolling(b.hl2, length, np.min)
    place = ratio(b.hl2 - low, rolling(b.hl2, length, np.max) - low)
    out, position, value = np.full(len(b.c), NAN), 0.0, 0.0
    for i, x in enumerate(place):
        if np.isnan(x):
            position = value = 0.0
            continue
        position = 0.66 * (x - 0.5) + 0.67 * position
        if abs(position) > 0.99:
            position = float(np.copysign(0.999, position))
        value = out[i] = np.log((1 + position) / (1 - position)) / 2 + value / 2
    return {"fisher": out, "trigger": shift(out)}


@scan("kama", "value", erLength=10, fastLength=2, slowLength=30)
def _kama(b, n, fast, slow):
    out = np.full(len(b.c), NAN)
    if len(b.c) > n:
        noise = rolling(np.abs(change(b.c)), n, np.sum)
        value = out[n] = b.c[n]
        for i in range(n + 1, len(b.c)):
            er = min(1.0, abs(b.c[i] - b.c[i - n]) / noise[i]) if noise[i] else 0.0
            alpha = er * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)
            value = out[i] = value + alpha**2 * (b.c[i] - value)
    return {"value": out}


@scan("volatility-stop", "up,down", length=20, factor=2.0, source="close")
def _vstop(b, length, factor, source):
    x, r, tr = b.source(source), atr(b, length), true_range(b)
    n = len(x)
    stop, rising = np.full(n, NAN), np.ones(n, bool)
    high = low = x[0] if n else NAN
    up, value = True, x[0] if n else NAN
    for i in range(n):
        wide = factor * r[i] if np.isfinite(r[i]) else tr[i]
        high, low = max(high, x[i]), min(low, x[i])
        value = max(value, high - wide) if up else min(value, low + wide)
        turned = x[i] >= value
        if turned != up and i:
            up, high, low = turned, x[i], x[i]
            value = x[i] - wide if up else x[i] + wide
        stop[i], rising[i] = value, up
    return {"up": np.where(rising, stop, NAN), "down": np.where(rising, NAN, stop)}


@scan("parabolic-sar", "value", start=0.02, increment=0.02, maximum=0.2)
def _sar(b, start, increment, maximum):
    """The second bar carries the bare seed; reversals are tested from the third on, before the stop is held to the last two bars."""
    n = len(b.c)
    out = np.full(n, NAN)
    if n < 2:
        return {"value": out}
    # prices times the side: what follows is written for a rising trend alone
    side = 1 if b.c[1] >= b.c[0] else -1
    near, far = (b.l, b.h) if side > 0 else (-b.h, -b.l)
    stop, extreme, pace = near[0], far[1], start
    out[1] = side * stop
    for i in range(2, n):
        stop += pace * (extreme - stop)
        if near[i] < stop:
            side, near, far = -side, -far, -near
            stop, extreme, pace = min(-extreme, near[i]), far[i], start
        elif far[i] > extreme:
            extreme, pace = far[i], min(maximum, pace + increment)
        stop = min(stop, near[i - 1], near[i - 2])
        out[i] = side * stop
    return {"value": out}


@scan("connors-rsi", "crsi", lenrsi=3, lenupdown=2, lenroc=100)
def _connors(b, n, updown, back):
    d = change(b.c)
    streak = np.zeros(len(b.c))
    streak[:1] = -1
    for i in range(1, len(b.c)):
        s = np.sign(d[i])
        streak[i] = 0 if s == 0 else streak[i - 1] + s if streak[i - 1] * s > 0 else s
    roc = 100 * ratio(d, shift(b.c))
    rank = np.full(len(b.c), NAN)
    for i in range(back + 1, len(b.c)):
        rank[i] = 100 * (roc[i - back : i] <= roc[i]).mean()
    return {"crsi": (rsi(b.c, n) + rsi(streak, updown) + rank) / 3}


@scan("halftrend", "up,down,atr_high,atr_low,buy_signal,sell_signal", amplitude=2, channelDeviation=2, atrPeriod=100)
def _halftrend(b, amplitude, deviation, period):
    """A rising line from the highest of recent lows, or a falling one from the lowest of recent highs.

    One side is watched at a time. Falling is watched only after a turn upwards;
    at first, and after a turn downwards, it is rising.
    """
    n, amplitude = len(b.c), max(1, round(amplitude))
    half = atr(b, max(1, round(period))) / 2
    top, low = rolling(b.h, amplitude, np.max), rolling(b.l, amplitude, np.min)
    mean_h, mean_l = sma(b.h, amplitude), sma(b.l, amplitude)
    out = {k: np.full(n, NAN) for k in ("up", "down", "atr_high", "atr_low", "buy_signal", "sell_signal")}
    side, watch_fall = 1, False
    rail = {1: b.l[0], -1: b.h[0]} if n else {}
    line: dict[int, float] = {}
    for i in range(n):
        before, last = side, max(0, i - 1)
        if watch_fall:
            rail[1] = np.fmax(rail[1], low[i])
            if mean_h[i] < rail[1] and b.c[i] < b.l[last]:
                side, watch_fall, rail[-1] = -1, False, top[i]
        else:
            rail[-1] = np.fmin(rail[-1], top[i])
            if mean_l[i] > rail[-1] and b.c[i] > b.h[last]:
                side, watch_fall, rail[1] = 1, True, low[i]
        if i and side != before:
            line[side] = line[before]  # from where the other one ended
            out["buy_signal" if side > 0 else "sell_signal"][i] = line[side] - side * half[i]
        else:
            line[side] = side * max(side * rail[side], side * line.get(side, 0.0)) if i else rail[side]
        out["up" if side > 0 else "down"][i] = line[side]
        out["atr_high"][i], out["atr_low"][i] = line[side] + deviation * half[i], line[side] - deviation * half[i]
    return out


@scan("alphatrend", "alphatrend,lagged,buy_signal,sell_signal", coeff=1, AP=14)
def _alphatrend(b, coeff, n):
    """Defined from the first bar that has a money flow index; crossings of the line and its lag are signals once there was one of either kind."""
    n = max(1, round(n))
    tr = sma(true_range(b), n)
    d, flow = change(b.hlc3), b.hlc3 * b.v
    up, down = (rolling(np.where(np.isnan(d), NAN, np.where(s * d > 0, flow, 0)), n, np.sum) for s in (1, -1))
    line, value = np.full(len(b.c), NAN), 0.0
    for i in np.flatnonzero(np.isfinite(tr) & np.isfinite(up)):
        # an index of at least 50 is as much flow upwards as downwards
        value = line[i] = max(b.l[i] - tr[i] * coeff, value) if up[i] >= down[i] else min(b.h[i] + tr[i] * coeff, value)
    lagged = shift(line, 2)
    gap = line - lagged
    before = shift(gap)
    out = {"alphatrend": line, "lagged": lagged, "buy_signal": np.full(len(line), NAN), "sell_signal": np.full(len(line), NAN)}
    last: dict[int, int] = {}
    for i in np.flatnonzero((gap != 0) & np.isfinite(before)):
        side = int(np.sign(gap[i]))
        if side * before[i] > 0:
            continue  # it was on this side already
        if side in last and last.get(-side, -1) > last[side] + 1:
            out["buy_signal" if side > 0 else "sell_signal"][i] = lagged[i] * (1 - side * 0.0001)
        last[side] = i
    return out


@scan("rsi-divergence", "rsi,bull,hiddenBull,bear,hiddenBear", length=14, lbR=5, lbL=5)
def _divergence(b, length, right, left):
    """Pivots of the index that price contradicts, 6 to 61 bars after the pivot before; hidden ones aren't marked."""
    r, n = rsi(b.c, length), len(b.c)
    out = {"rsi": r} | {k: np.full(n, NAN) for k in ("bull", "hiddenBull", "bear", "hiddenBear")}
    last: dict[str, int] = {}
    for at in range(left, n - right):
        around = np.concatenate([r[at - left : at], r[at + 1 : at + right + 1]])
        if np.isnan(r[at]) or np.isnan(around).any():
            continue
        for name, pivot, price, sign in (("bull", (around > r[at]).all(), b.l, 1), ("bear", (around < r[at]).all(), b.h, -1)):
            if pivot:
                p = last.get(name)
                if p is not None and 6 <= at - p <= 61 and sign * (r[at] - r[p]) > 0 and sign * (price[at] - price[p]) < 0:
                    out[name][at] = r[at]
                last[name] = at
    return out


@scan("consolidation-breakout", "rangeHigh,rangeLow,breakUp,breakDown,insideAge")
def _consolidation(b):
    """Bodies within the range of a mother bar; a body that leaves it after more than one bar marks the rail that it broke."""
    n = len(b.c)
    out = {k: np.full(n, NAN) for k in ("rangeHigh", "rangeLow", "breakUp", "breakDown", "insideAge")}
    body_top, body_low = np.maximum(b.o, b.c), np.minimum(b.o, b.c)
    mother = 0
    for i in range(n):
        high, low, age = b.h[mother], b.l[mother], i - mother
        if 1 < age <= 250:
            if body_top[i] > high:
                out["breakUp"][i] = high
            if body_low[i] < low:
                out["breakDown"][i] = low
        if i and not (i > 1 and low <= body_low[i] and body_top[i] <= high):
            mother = i
            continue
        out["rangeHigh"][i], out["rangeLow"][i] = high, low
        if age:
            out["insideAge"][i] = age
    return out


# Window indicators with parameters that ask for a recurrence; plots and defaults are those of ``barloom.functions.indicators``


VARIANTS: dict[str, tuple[Callable[..., dict[str, np.ndarray]], tuple[str, ...]]] = {}


def variant(name: str, plots: str):
    def keep(kernel):
        VARIANTS[name] = (kernel, tuple(plots.split(",")))
        return kernel

    return keep


@variant("obv", "value,obv,ma,bbUpper,bbLower")
def _obv(b, kind, n, mult):
    line = np.cumsum(np.nan_to_num(np.sign(change(b.c)) * b.v))
    return {"value": line, "obv": line, **smoothed(line, kind, n, mult, b.v)}


@variant("cci", "cci,ma,bbUpper,bbLower")
def _cci(b, n, constant, kind, length, mult):
    off = rolling(b.hlc3, n, lambda w, axis: np.abs(w - w.mean(axis=axis, keepdims=True)).mean(axis=axis))
    line = np.where(off < 1e-12, 0.0, ratio(b.hlc3 - sma(b.hlc3, n), constant * off))
    return {"cci": line, **smoothed(line, kind, length, mult, b.v)}


@variant("ma-ribbon", "ma1,ma2,ma3,ma4")
def _ribbon(b, *lanes):
    return {f"ma{i}": moving(kind, b.source(x), n, b.v) for i, (kind, x, n) in enumerate(zip(lanes[::3], lanes[1::3], lanes[2::3]), 1)}


@variant("hull-suite", "mhull,shull")
def _hull(b, source, _mode, length, mult, band, *_colours):
    x, n = b.source(source), max(1, int(np.floor(round(length) * mult)))
    line = ema(2 * ema(x, max(1, n // 2)) - ema(x, n), max(1, round(n**0.5)))
    return {"mhull": line, "shull": shift(line, 2) if band else np.full(len(x), NAN)}


@variant("standard-error-bands", "upper,basis,lower")
def _error_bands(b, n, errors, method, smooth):
    n = max(3, n)
    at = np.arange(n) - (n - 1) / 2
    slope = rolling(b.c, n, lambda w, axis: w @ at / (at @ at))
    end = sma(b.c, n) + slope * at[-1]
    err = errors * np.sqrt(np.maximum(0, (n * rolling(b.c, n, np.var) - slope**2 * (at @ at)) / (n - 2)))
    return {k: moving(method, x, smooth, b.v) for k, x in (("upper", end + err), ("basis", end), ("lower", end - err))}


def parameters(name: str, given: dict, more: dict[str, tuple] | None = None) -> list:
    """All parameters of a scan in order; unknown ones are refused, missing and null ones are defaults."""
    known = SCANS | (more or {})
    defaults = known[name][1] if name in known else windowed.WINDOWED[name][1]
    if unknown := set(given) - set(defaults):
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return [given.get(k) if given.get(k) is not None else v for k, v in defaults.items()]


def run(bars: DataFrame, wanted: dict[str, dict], more: dict[str, tuple] | None = None) -> DataFrame:
    """symbol, ts and the plots of all scans in ``wanted``, also of those in ``more``; plots are prefixed where there are several scans."""
    kernels = {name: (k, p) for name, (k, _, p) in (SCANS | (more or {})).items()} | VARIANTS
    plan = [(kernels[name][0], parameters(name, given, more), kernels[name][1], "" if len(wanted) == 1 else name.replace("-", "_") + "_") for name, given in wanted.items()]
    columns = [prefix + p for _, _, plots, prefix in plan for p in plots]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        b = Bars(*(pdf[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")), pdf["ts"].to_numpy())
        out = {"symbol": pdf["symbol"], "ts": pdf["ts"]}
        for kernel, values, plots, prefix in plan:
            found = kernel(b, *values)
            out |= {prefix + p: pd.Series(found[p], index=pdf.index).replace([np.inf, -np.inf], NAN).astype("Float64") for p in plots}
        return pd.DataFrame(out)

    schema = "symbol string, ts timestamp_ntz, " + ", ".join(f"`{c}` double" for c in columns)
    return bars.select("symbol", "ts", "open", "high", "low", "close", "volume").groupBy("symbol").applyInPandas(one, schema)
