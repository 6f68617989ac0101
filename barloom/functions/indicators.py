"""Indicators that bounded or cumulative windows express, as layers of SQL.

Every function returns (layers, plots): layers add columns one after the other,
and plots name the output columns. Null means not yet defined. ``rn`` is the
one-based number of the bar in its series and is always there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from barloom.functions.sqlgen import TRUE_RANGE, Layer, div, highest, lag, lowest, over, regression, rolling_sum, sma, source, stdev, weighted, wma

Built = tuple[list[Layer], list[str]]
WINDOWED: dict[str, tuple[Callable[..., Built], dict]] = {}


def indicator(name: str, **defaults) -> Callable:
    def keep(build: Callable[..., Built]) -> Callable[..., Built]:
        WINDOWED[name] = (build, defaults)
        return build

    return keep


def one(name: str, expression: str) -> Built:
    return [{name: expression}], [name]


class Recurrent(ValueError):
    """These parameters ask for a recurrence, which the indicator's scan computes."""


NOTHING = "CAST(NULL AS DOUBLE)"


def moving(kind: str, x: str, n: int) -> str:
    """A moving average by its name; an unknown name is the simple one."""
    kind, n = kind.upper(), max(1, int(n))
    if kind in ("EMA", "EXPONENTIAL", "SMMA (RMA)"):
        raise Recurrent(kind)
    if kind in ("WMA", "WEIGHTED"):
        return wma(x, n)
    if kind == "VWMA":
        return div(rolling_sum(f"{x} * volume", n), rolling_sum("volume", n))
    return sma(x, n)


def smoothed(x: str, kind: str, n: int, mult: float, names: tuple[str, str, str] = ("ma", "bbUpper", "bbLower")) -> Built:
    """An average over the line ``x``, and bands around it where ``kind`` asks for them."""
    ma, upper, lower = names
    first = {ma: NOTHING if kind == "None" else moving(kind, x, n)}
    band = f"{mult} * ({stdev(x, max(1, int(n)))})" if kind == "SMA + Bollinger Bands" else NOTHING
    return [first, {upper: f"{ma} + {band}", lower: f"{ma} - {band}"}], list(names)


def moved(x: str, n: float) -> str:
    """A column drawn ``n`` bars later."""
    return lag(x, round(n)) if round(n) else x


@indicator("sma", length=20, source="close")
def _sma(length, source_name):
    return one("value", sma(source(source_name), length))


@indicator("wma", length=20)
def _wma(length):
    return one("value", wma("close", length))


def _fractional_wma(x: str, n: float) -> str:
    """Weights n, n - 1, ... while positive, over their sum."""
    weights = [n - k for k in range(math.ceil(n)) if n - k > 0]
    total = sum(weights)
    return weighted(x, [w / total for w in weights])


@indicator("hma", length=9, source="close")
def _hma(length, source_name):
    x = source(source_name)
    return [{"x0": f"2 * {_fractional_wma(x, length / 2)} - {wma(x, length)}"}, {"value": wma("x0", math.isqrt(length))}], ["value"]


@indicator("alma", length=9, offset=0.85, sigma=6.0)
def _alma(length, offset, sigma):
    m, s = offset * (length - 1), length / sigma
    w = [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(length)]  # of the oldest first
    return one("value", weighted("close", [x / sum(w) for x in reversed(w)]))


@indicator("linreg-slope", periods=14)
def _slope(periods):
    return one("slope", regression("slope", "close", periods))


@indicator("hull-suite", source="close", mode="Hma", length=55, lengthMult=1.0, visualSwitch=True, switchColor=True, candleCol=False)
def _hull(source_name, mode, length, mult, band, *_colours):
    x, n = source(source_name), max(1, math.floor(round(length) * mult))
    if mode == "Ehma":
        raise Recurrent(mode)
    part = lambda d, of=n: wma(x, max(1, of // d))
    if mode == "Thma":
        n = max(1, n // 2)
        first, last = f"3 * ({part(3, n)}) - ({part(2, n)}) - ({part(1, n)})", n
    else:
        first, last = f"2 * ({part(2)}) - ({part(1)})", max(1, round(math.sqrt(n)))
    return [{"x0": first}, {"mhull": wma("x0", last)}, {"shull": lag("mhull", 2) if band else NOTHING}], ["mhull", "shull"]


@indicator("roc", length=10)
def _roc(length):
    return one("value", f"CASE WHEN {lag('close', length)} = 0 THEN 0.0 ELSE 100 * (close - {lag('close', length)}) / nullif({lag('close', length)}, 0) END")


@indicator("bollinger", length=20, stdDev=2.0, source="close")
def _bollinger(length, mult, source_name):
    m, s = sma(source(source_name), length), stdev(source(source_name), length)
    return [{"upper": f"{m} + {mult} * ({s})", "middle": m, "lower": f"{m} - {mult} * ({s})"}], ["upper", "middle", "lower"]


@indicator("bollinger-percent-b", length=20, mult=2.0)
def _percent_b(length, mult):
    return [{"m": sma("close", length), "s": stdev("close", length)}, {"value": div(f"close - (m - {mult} * s)", f"2 * {mult} * s")}], ["value"]


@indicator("bollinger-bandwidth", length=20, mult=2.0, expansionLength=125, contractionLength=125)
def _bandwidth(length, mult, up, down):
    first = {"bandwidth": f"100 * {div(f'2 * {mult} * ({stdev("close", length)})', sma('close', length))}"}
    return [first, {"expansion": f"max(bandwidth) {over(up)}", "contraction": f"min(bandwidth) {over(down)}"}], ["bandwidth", "expansion", "contraction"]


@indicator("bb-trend", shortLength=20, longLength=50, stdDevMult=2.0)
def _bb_trend(short, long, mult):
    layer = {"sm": sma("close", short), "ss": stdev("close", short), "lm": sma("close", long), "ls": stdev("close", long)}
    low, high = f"abs((sm - {mult} * ss) - (lm - {mult} * ls))", f"abs((sm + {mult} * ss) - (lm + {mult} * ls))"
    return [layer, {"value": f"100 * {div(f'{low} - {high}', 'sm')}"}], ["value"]


@indicator("vwap", anchor="session", source="hlc3", offset=0, calcMode="stdev", showBand1=True, bandMult1=1.0, showBand2=False, bandMult2=2.0, showBand3=False, bandMult3=3.0)
def _vwap(anchor, source_name, offset, mode, *bands):
    key = {"session": "date_trunc('day', ts)", "week": "date_trunc('week', ts)", "month": "date_trunc('month', ts)", "quarter": "date_trunc('quarter', ts)", "year": "date_trunc('year', ts)"}.get(anchor, "1")
    frame = "OVER (PARTITION BY symbol, anchor_key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    x = source(source_name)
    second = {"pv": f"sum({x} * volume) {frame}", "vv": f"sum(volume) {frame}", "ppv": f"sum({x} * {x} * volume) {frame}"}
    third = {"mean": div("pv", "vv"), "spread": div("ppv", "vv")}
    fourth = {"band": "mean * 0.01" if mode == "percent" else "sqrt(greatest(0, spread - mean * mean))"}
    fifth = {"c0": "mean"}
    for i, (shown, mult) in enumerate(zip(bands[::2], bands[1::2]), 1):
        fifth |= {f"{side}0{i}": f"mean {sign} {mult} * band" if shown else NOTHING for side, sign in (("u", "+"), ("l", "-"))}
    last = {"value": moved("c0", offset), "vwap": moved("c0", offset)} | {f"{side}{i}": moved(f"{side[0]}0{i}", offset) for i in (1, 2, 3) for side in ("upper", "lower")}
    return [{"anchor_key": key}, second, third, fourth, fifth, last], list(last)


@indicator("obv", maType="None", maLength=9, bbMult=2.0)
def _obv(kind, n, mult):
    layers, plots = smoothed("value", kind, n, mult)
    return [{"step": f"CASE WHEN rn = 1 THEN 0.0 ELSE sign(close - {lag('close')}) * volume END"}, {"value": f"sum(step) {over()}"}, {"obv": "value"}, *layers], ["value", "obv", *plots]


@indicator("stochastic", kPeriod=14, kSmoothing=3, dPeriod=3)
def _stochastic(k, smooth, d):
    span = f"({highest('high', k)}) - ({lowest('low', k)})"
    return [{"raw": f"100 * {div(f'close - ({lowest("low", k)})', span)}"}, {"k": sma("raw", smooth)}, {"d": sma("k", d)}], ["k", "d"]


@indicator("vwma", period=20)
def _vwma(n):
    return one("value", div(rolling_sum("close * volume", n), rolling_sum("volume", n)))


@indicator("lsma", period=25)
def _lsma(n):
    return one("value", f"CASE WHEN count(close) {over(n)} = {n} THEN regr_intercept(close, rn) {over(n)} + regr_slope(close, rn) {over(n)} * rn END")


@indicator("envelope", period=20, percent=10.0)
def _envelope(n, percent):
    m = sma("close", n)
    return [{"middle": m}, {"upper": f"middle * {1 + percent / 100!r}", "lower": f"middle * {1 - percent / 100!r}"}], ["upper", "middle", "lower"]


@indicator("donchian", period=20, offset=0)
def _donchian(n, offset):
    first = {"h0": highest("high", n), "l0": lowest("low", n)}
    at = (lambda x: lag(x, offset)) if offset else (lambda x: x)
    return [first, {"upper": at("h0"), "lower": at("l0")}, {"middle": "(upper + lower) / 2"}], ["upper", "middle", "lower"]


def _since(x: str, sign: str, n: int) -> str:
    """Bars since the extreme of n + 1 bars, the newest of equals."""
    best = f"CASE WHEN count({x}) {over(n + 1)} = {n + 1} THEN {'max' if sign == '+' else 'min'}({x}) {over(n + 1)} END"
    return f"least({', '.join(f'CASE WHEN {x if k == 0 else lag(x, k)} = ({best}) THEN {k} END' for k in range(n + 1))})"


@indicator("aroon", length=14)
def _aroon(n):
    return [{"hs": _since("high", "+", n), "ls": _since("low", "-", n)}, {"up": f"100 * ({n} - CAST(hs AS DOUBLE)) / {n}", "down": f"100 * ({n} - CAST(ls AS DOUBLE)) / {n}"}], ["up", "down"]


@indicator("aroon-oscillator", length=14)
def _aroon_osc(n):
    layers, _ = _aroon(n)
    return [*layers, {"osc": "up - down"}], ["osc"]


@indicator("awesome-oscillator")
def _ao():
    x = source("hl2")
    return one("ao", f"({sma(x, 5)}) - ({sma(x, 34)})")


@indicator("cci", period=20, constant=0.015, maType="SMA", maLength=20, bbMult=2.0)
def _cci(n, constant, kind, length, mult):
    layers, plots = smoothed("cci", kind, length, mult)
    x = source("hlc3")
    terms = " + ".join(f"abs({'tp' if k == 0 else lag('tp', k)} - m)" for k in range(n))
    return [{"tp": x}, {"m": sma("tp", n)}, {"md": f"({terms}) / {n}"}, {"cci": f"CASE WHEN md < 1e-12 THEN 0.0 WHEN md IS NOT NULL THEN coalesce((tp - m) / nullif({constant} * md, 0), 0.0) END"}, *layers], ["cci", *plots]


@indicator("woodies-cci", cciTurboLength=6, cci14Length=14)
def _woodies(turbo, long):
    layers: list[Layer] = [{"m1": sma("close", turbo), "m2": sma("close", long)}]
    md = {f"d{i}": "(" + " + ".join(f"abs({'close' if k == 0 else lag('close', k)} - m{i})" for k in range(n)) + f") / {n}" for i, n in ((1, turbo), (2, long))}
    return [*layers, md, {"turbo": div("close - m1", "0.015 * d1"), "cci14": div("close - m2", "0.015 * d2")}, {"hist": "cci14"}], ["hist", "turbo", "cci14"]


@indicator("mfi", period=14)
def _mfi(n):
    x = source("hlc3")
    flow = {"up": f"CASE WHEN tp > {lag('tp')} THEN tp * volume WHEN rn > 1 THEN 0.0 END", "dn": f"CASE WHEN tp < {lag('tp')} THEN tp * volume WHEN rn > 1 THEN 0.0 END"}
    value = "CASE WHEN ps IS NULL THEN NULL WHEN ns = 0 THEN 100.0 ELSE 100 - 100 / (1 + ps / nullif(ns, 0)) END"
    return [{"tp": x}, flow, {"ps": rolling_sum("up", n), "ns": rolling_sum("dn", n)}, {"value": value}], ["value"]


@indicator("williams-percent-r", length=14)
def _percent_r(n):
    h, l = highest("high", n), lowest("low", n)
    return one("percentR", f"100 * {div(f'close - ({h})', f'({h}) - ({l})')}")


@indicator("ultimate-oscillator", length1=7, length2=14, length3=28)
def _uo(a, b, c):
    first = {"bp": f"CASE WHEN rn > 1 THEN close - least(low, {lag('close')}) END", "tr": f"CASE WHEN rn > 1 THEN greatest(high, {lag('close')}) - least(low, {lag('close')}) END"}
    second = {f"q{i}": div(rolling_sum("bp", n), rolling_sum("tr", n)) for i, n in enumerate((a, b, c))}
    return [first, second, {"uo": "100 * (4 * q0 + 2 * q1 + q2) / 7"}], ["uo"]


@indicator("coppock-curve", wmaLength=10, longRoCLength=14, shortRoCLength=11)
def _coppock(n, long, short):
    roc = lambda k: f"100 * {div(f'close - {lag("close", k)}', lag('close', k))}"
    return [{"r": f"{roc(long)} + {roc(short)}"}, {"curve": wma("r", n)}], ["curve"]


@indicator("dpo", period=21, isCentered=False)
def _dpo(n, centred):
    back = n // 2 + 1
    return [{"m": sma("close", n)}, {"dpo": f"close - {lag('m', -back if centred else back)}"}], ["dpo"]


@indicator("chande-momentum", length=9)
def _cmo(n):
    step = f"close - {lag('close')}"
    return [{"up": f"greatest({step}, 0)", "dn": f"greatest(-({step}), 0)"}, {"u": rolling_sum("CASE WHEN rn > 1 THEN up END", n), "d": rolling_sum("CASE WHEN rn > 1 THEN dn END", n)}, {"cmo": f"100 * {div('u - d', 'u + d')}"}], ["cmo"]


@indicator("balance-of-power")
def _bop():
    return one("bop", div("close - open", "high - low"))


@indicator("ma-channel", upperLength=20, lowerLength=20, upperOffset=0, lowerOffset=0)
def _channel(up, down, up_offset, down_offset):
    return [{"u0": sma("high", up), "l0": sma("low", down)}, {"upper": moved("u0", up_offset), "lower": moved("l0", down_offset)}], ["upper", "lower"]


@indicator("standard-deviation", periods=5, deviations=1.0)
def _sd(n, k):
    return one("stdDev", f"{k} * ({stdev('close', n)})")


def _std_error(n: int) -> Layer:
    return {"syy": regression("syy", "close", n), "sxy": regression("sxy", "close", n), "sxx": regression("sxx", "close", n)}


_RESIDUAL = "syy - sxy * sxy / nullif(sxx, 0)"


@indicator("standard-error", length=14)
def _se(n):
    n = max(3, n)
    return [_std_error(n), {"stdErr": f"CASE WHEN syy IS NOT NULL THEN sqrt(greatest(0, ({_RESIDUAL}) / {n - 2})) END"}], ["stdErr"]


@indicator("standard-error-bands", periods=21, errors=2.0, method="Simple", averagePeriods=3)
def _se_bands(n, errors, method, smooth):
    n = max(3, n)
    first = {**_std_error(n), "endpoint": _lsma(n)[0][0]["value"]}
    second = {"err": f"CASE WHEN syy IS NOT NULL THEN {errors} * sqrt(greatest(0, ({_RESIDUAL}) / {n - 2})) END"}
    third = {"hi": "endpoint + err", "lo": "endpoint - err"}
    return [first, second, third, {name: moving(method, x, smooth) for name, x in (("upper", "hi"), ("basis", "endpoint"), ("lower", "lo"))}], ["upper", "basis", "lower"]


@indicator("choppiness-index", length=14, offset=0)
def _chop(n, offset):
    return [{"tr": TRUE_RANGE}, {"ch0": f"100 * log10(nullif({div(rolling_sum('tr', n), f'({highest("high", n)}) - ({lowest("low", n)})')}, 0)) / {math.log10(n)!r}"}, {"value": moved("ch0", offset)}], ["value"]


@indicator("historical-volatility", length=10, per=1)
def _hv(n, per):
    return [{"r": f"ln(close / nullif({lag('close')}, 0))"}, {"hv": f"100 * {math.sqrt(365 / per)!r} * ({stdev('r', n)})"}], ["hv"]


@indicator("average-daily-range", length=14)
def _adr(n):
    return one("adr", sma("high - low", n))


@indicator("adl")
def _adl():
    return [{"mf": f"coalesce({div('(close - low) - (high - close)', 'high - low')}, 0) * volume"}, {"adl": f"sum(mf) {over()}"}], ["adl"]


@indicator("net-volume")
def _net():
    return one("net", f"CASE WHEN rn = 1 THEN 0.0 ELSE sign(close - {lag('close')}) * volume END")


@indicator("volume")
def _volume():
    return [{"raw": "volume"}], ["raw"]


@indicator("pvt")
def _pvt():
    return [{"step": f"coalesce({div(f'close - {lag("close")}', lag('close'))} * volume, 0)"}, {"pvt": f"sum(step) {over()}"}], ["pvt"]


@indicator("chaikin-money-flow", length=20)
def _cmf(n):
    return [{"mf": f"coalesce({div('(close - low) - (high - close)', 'high - low')}, 0) * volume"}, {"cmf": div(rolling_sum("mf", n), rolling_sum("volume", n))}], ["cmf"]


@indicator("ease-of-movement", length=14, divisor=10000)
def _eom(n, divisor):
    move = f"((high + low) / 2 - ({lag('high')} + {lag('low')}) / 2) * (high - low) * {float(divisor)!r}"
    return [{"e": div(move, "volume")}, {"eom": sma("e", n)}], ["eom"]


@indicator("ulcer-index", length=14)
def _ulcer(n):
    return [{"peak": highest("close", n)}, {"dd": f"power(100 * {div('close - peak', 'peak')}, 2)"}, {"ui": f"sqrt({sma('dd', n)})"}], ["ui"]


def _signal_roc(n: int) -> str:
    return f"100 * {div(f'close - {lag("close", n)}', lag('close', n))}"


@indicator("know-sure-thing", roclen1=10, roclen2=15, roclen3=20, roclen4=30, smalen1=10, smalen2=10, smalen3=10, smalen4=15, siglen=9)
def _kst(r1, r2, r3, r4, s1, s2, s3, s4, sig):
    rocs = {f"r{i}": _signal_roc(n) for i, n in enumerate((r1, r2, r3, r4), 1)}
    total = " + ".join(f"{i} * ({sma(f'r{i}', n)})" for i, n in enumerate((s1, s2, s3, s4), 1))
    return [rocs, {"kst": total}, {"signal": sma("kst", sig)}], ["kst", "signal"]


#: The ten rate-of-change terms as (roc length, smoothing length, weight).
SPECIAL_K = ((10, 10, 1), (15, 10, 2), (20, 10, 3), (30, 15, 4), (40, 50, 1), (65, 65, 2), (75, 75, 3), (100, 100, 4), (195, 130, 1), (265, 130, 2))


@indicator("special-k", length1=100, length2=100)
def _special_k(n1, n2):
    rocs = {f"r{i}": _signal_roc(r) for i, (r, _, _) in enumerate(SPECIAL_K)}
    total = " + ".join(f"{w} * ({sma(f'r{i}', s)})" for i, (_, s, w) in enumerate(SPECIAL_K))
    return [rocs, {"specialK": total}, {"first": sma("specialK", n1)}, {"signal": sma("first", n2)}], ["specialK", "signal"]


@indicator("momentum", len=10)
def _momentum(n):
    return one("mom", f"close - {lag('close', n)}")


@indicator("ma-cross", shortLength=9, longLength=21)
def _ma_cross(short, long):
    first = {"s": sma("close", short), "l": sma("close", long)}
    before = f"sign({lag('s')} - {lag('l')})"
    return [first, {"cross_at": f"CASE WHEN sign(s - l) <> {before} AND sign(s - l) <> 0 THEN s END"}], ["s", "l", "cross_at"]


@indicator("ma-ribbon", **{f"ma{i}{k}": v for i, n in enumerate((20, 50, 100, 200), 1) for k, v in (("Type", "sma"), ("Source", "close"), ("Length", n))})
def _ribbon(*lanes):
    lanes = list(zip(lanes[::3], lanes[1::3], lanes[2::3]))
    return [{f"ma{i}": moving(kind, source(x), n) for i, (kind, x, n) in enumerate(lanes, 1)}], [f"ma{i}" for i in range(1, 5)]


@indicator("ichimoku", conversionPeriod=9, basePeriod=26, laggingSpanPeriod=52, displacement=26)
def _ichimoku(conv, base, span, shift):
    mid = lambda n: f"(({highest('high', n)}) + ({lowest('low', n)})) / 2"
    first = {"conversion": mid(conv), "base": mid(base), "b0": mid(span)}
    return [first, {"a0": "(conversion + base) / 2"}, {"spanA": lag("a0", shift), "spanB": lag("b0", shift), "lagging": lag("close", -shift)}], ["conversion", "base", "spanA", "spanB", "lagging"]


@indicator("range-analysis", showAverage=False, avgLength=3)
def _range(shown, n):
    return [{"bar_range": "high - low"}, {"avg_range": sma("bar_range", max(1, round(n))) if shown else NOTHING}], ["bar_range", "avg_range"]


@indicator("vortex", length=14)
def _vortex(n):
    first = {"tr": TRUE_RANGE, "up": f"abs(high - {lag('low')})", "dn": f"abs(low - {lag('high')})"}
    return [first, {"vip": div(rolling_sum("up", n), rolling_sum("tr", n)), "vim": div(rolling_sum("dn", n), rolling_sum("tr", n))}], ["vip", "vim"]


@indicator("relative-vigor-index", length=10, offset=0)
def _rvgi(n, offset):
    swma = lambda x: weighted(x, [1 / 6, 2 / 6, 2 / 6, 1 / 6])
    return [{"a": swma("(close - open)"), "b": swma("(high - low)")}, {"r0": div(rolling_sum("a", n), rolling_sum("b", n))}, {"s0": swma("r0")}, {"rvgi": moved("r0", offset), "signal": moved("s0", offset)}], ["rvgi", "signal"]


@indicator("trend-strength-index", length=14)
def _tsi(n):
    """Correlation of the close with time, null in a flat window."""
    first = {"sxy": regression("sxy", "close", n), "sxx": regression("sxx", "close", n), "syy": regression("syy", "close", n)}
    return [first, {"tsi": div("sxy", "CASE WHEN syy > 1e-18 THEN sqrt(sxx * syy) END")}], ["tsi"]


@indicator("williams-fractals", periods=2)
def _fractals(n):
    def extreme(x: str, op: str) -> str:
        newer = " AND ".join(f"{x} {op} {lag(x, -k)}" for k in range(1, n + 1))
        plateaus = []
        for flat in range(5):  # up to four equal bars may stand between the peak and the older side
            equal = [f"{x} = {lag(x, k)}" for k in range(1, flat + 1)]
            older = [f"{x} {op} {lag(x, flat + k)}" for k in range(1, n + 1)]
            plateaus.append("(" + " AND ".join(equal + older) + ")")
        return f"CASE WHEN {newer} AND ({' OR '.join(plateaus)}) THEN {x} END"

    return [{"upFractal": extreme("high", ">"), "downFractal": extreme("low", "<")}], ["upFractal", "downFractal"]


@indicator("williams-vix-fix", pd=22, bbl=20, mult=2.0, lb=50, ph=0.85, pl=1.01, hp=False, sd=False)
def _vix_fix(n, bbl, mult, lb, ph, pl, show_range, show_band):
    """``hp`` shows the range of percentiles, ``sd`` the band."""
    h = highest("close", n)
    frame = over(lb)  # of what is there
    rails = {"range_high": f"CASE WHEN rn >= {lb} THEN {ph} * max(wvf) {frame} END" if show_range else NOTHING, "range_low": f"CASE WHEN rn >= {lb} THEN {pl} * min(wvf) {frame} END" if show_range else NOTHING}
    rails["upper_band"] = f"({sma('wvf', bbl)}) + {mult} * ({stdev('wvf', bbl)})" if show_band else NOTHING
    return [{"wvf": f"100 * {div(f'({h}) - low', h)}"}, rails], ["wvf", *rails]


@indicator("seasonality", startYear=2015, cutoffPercent=10.0, tablePosition="Center", tableWidth=100, tableHeight=95, showAvg=True, showStDev=True, showPos=True, ignoredMonths="")
def _seasonality(*_table):
    """The line draws nothing; the matrix is the queries ``seasonality_matrix`` and ``seasonality_stats``."""
    return one("seasonality", NOTHING)


@indicator("cpr", frame="", pivotMode="auto", showDaily=True, showWeekly=False, showMonthly=False, displaypivots=True, displaysupport=True, displayresistance=True, displaycpr=True, displayS1R1=False)
def _cpr(frame, mode, daily, weekly, monthly, pivots, support, resistance, centre, first_ones):
    """Pivots of the period before: of days, weeks and months, or of one ``frame`` alone, with short names.

    ``pivotMode`` auto shows the frame one step coarser than the bars, by their median
    distance; ``manual`` those that are asked for. First supports and
    resistances are hidden unless ``displayS1R1``.
    """
    if frame:
        return _pivots(frame)
    layers: list[Layer] = []
    shown = {"d": daily, "w": weekly, "m": monthly}
    if mode == "auto":
        layers = [{"step": f"{SECONDS} - {lag(SECONDS)}"}, {"gap": "median(step) OVER (PARTITION BY symbol)"}]
        fits = {"d": "coalesce(gap, 0) < 86400", "w": "gap >= 86400 AND gap < 604800", "m": "gap >= 604800"}
    plots: list[str] = []
    for p, unit in (("d", "day"), ("w", "week"), ("m", "month")):
        made, names = _pivots(unit, p)
        layers += made
        wanted = {"Pivot": ("pp", pivots), "S1": ("s1", support and first_ones), "S2": ("s2", support), "S3": ("s3", support), "R1": ("r1", resistance and first_ones), "R2": ("r2", resistance), "R3": ("r3", resistance), "Bc": ("bc", centre), "Tc": ("tc", centre)}
        last = {}
        for name, (column, on) in wanted.items():
            x = f"{p}_{column}"
            last[p + name] = NOTHING if not on or mode == "manual" and not shown[p] else x if mode == "manual" else f"CASE WHEN {fits[p]} THEN {x} END"
        layers.append(last)
        plots += last
    return layers, plots


_YEAR = "(year(ts) - CASE WHEN month(ts) <= 2 THEN 1 ELSE 0 END)"
#: Seconds of a bar's time since the start of the calendar, by functions that both engines have.
SECONDS = (
    f"((365 * {_YEAR} + floor({_YEAR} / 4) - floor({_YEAR} / 100) + floor({_YEAR} / 400) + floor((153 * ((month(ts) + 9) % 12) + 2) / 5) + day(ts)) * 86400.0"
    " + hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)))"
)


def _pivots(frame: str, prefix: str = "") -> Built:
    p = f"{prefix}_" if prefix else ""
    layers, plots = _frame_pivots(frame)
    if not prefix:
        return layers, plots
    names = [c for layer in layers for c in layer]

    def renamed(e: str) -> str:
        return re.sub(r"\b(" + "|".join(names) + r")\b(?!\()", lambda m: p + m.group(), e)

    return [{p + c: renamed(e) for c, e in layer.items()} for layer in layers], [p + c for c in plots]


def _frame_pivots(frame: str) -> Built:
    period = f"date_trunc('{frame}', ts)"
    group = "OVER (PARTITION BY symbol, period)"
    inside = {"ph": f"max(high) {group}", "pl": f"min(low) {group}", "pc": f"last_value(close) OVER (PARTITION BY symbol, period ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "start": f"row_number() OVER (PARTITION BY symbol, period ORDER BY ts)"}
    # each bar looks at the bar before its period's first one
    before = {c: f"max(CASE WHEN start = 1 THEN {lag_of} END) OVER (PARTITION BY symbol, period)" for c, lag_of in (("h", "lh"), ("l", "ll"), ("c", "lc"))}
    lagged = {"lh": lag("ph"), "ll": lag("pl"), "lc": lag("pc")}
    pivots = {"pp": "(h + l + c) / 3", "bc": "(h + l) / 2"}
    rest = {"tc": "2 * pp - bc", "r1": "2 * pp - l", "s1": "2 * pp - h", "r2": "pp + (h - l)", "s2": "pp - (h - l)", "r3": "h + 2 * (pp - l)", "s3": "l - 2 * (h - pp)"}
    return [{"period": period}, inside, lagged, before, pivots, rest], ["pp", "bc", "tc", "r1", "s1", "r2", "s2", "r3", "s3"]


@indicator("twap")
def _twap():
    frame = "OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return one("value", f"avg({source('ohlc4')}) {frame}")


def build(name: str, **params) -> Built:
    """Layers and plots; unknown parameters are refused, missing and null ones are defaults."""
    maker, defaults = WINDOWED[name]
    if unknown := set(params) - set(defaults):
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    values = {k: params.get(k) if params.get(k) is not None else v for k, v in defaults.items()}
    return maker(*values.values())


