"""SQL in DuckDB's dialect for the same rows as the Spark queries."""

from __future__ import annotations

from dataclasses import dataclass

from barloom.functions.sqlgen import lag, sma
from barloom.schema import INTERVALS

TICKS = "SELECT event_type AS symbol, ts, event_id, value AS price, CAST(1 + event_id % 97 AS DOUBLE) AS volume FROM events"
_OHLCV = "first(price ORDER BY {o}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {o}) AS close, sum(volume) AS volume, count(*) AS n_bars"
OHLCV = _OHLCV.format(o="ts, event_id")
HOUR_BARS = f"SELECT symbol, date_trunc('hour', ts) AS ts, {OHLCV} FROM ({TICKS}) GROUP BY 1, 2"
DAILY_BARS = (
    f"SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate) AS ts, {_OHLCV.format(o='l_orderkey, l_linenumber')} "
    "FROM (SELECT *, l_extendedprice / l_quantity AS price, l_quantity AS volume FROM lineitem) GROUP BY 1, 2"
)


def resample(timeframe: str, grid: str) -> str:
    if timeframe in ("1d", "1w"):
        start = f"date_trunc('{'day' if timeframe == '1d' else 'week'}', ts)"
    else:
        shift = ", interval '15 minutes'" if grid == "session" and timeframe in ("30m", "1h") else ""
        start = f"time_bucket(interval '{INTERVALS[timeframe]}', ts{shift})"
    return f"SELECT symbol, {start} AS bucket, {OHLCV} FROM ({TICKS}) GROUP BY 1, 2"


# Recurrences as recursive queries: each smoothing is seeded by the mean of its first n defined values.

Smooth = tuple[str, str, int, float]


@dataclass
class Walk:
    """A state machine over the rows where ``where`` holds, as a recursive query.

    ``first`` gives the state of the first such row, ``then`` that of each later
    row, where ``a_x`` is the value of ``x`` on the row before. Entries may use
    those before them; ``then`` may have helpers that aren't part of the state.
    """

    first: dict[str, str]
    then: dict[str, str]
    where: str = "TRUE"


def _chained(rows: str, steps: dict[str, str]) -> str:
    for c, e in steps.items():
        rows = f"SELECT *, CAST({e} AS DOUBLE) AS {c} FROM ({rows}) s"
    return f"({rows}) s"


def ema(name: str, x: str, n: int) -> Smooth:
    return name, x, n, 2 / (n + 1)


def rma(name: str, x: str, n: int) -> Smooth:
    return name, x, n, 1 / n


_TR = f"greatest(high - low, coalesce(abs(high - {lag('close')}), 0), coalesce(abs(low - {lag('close')}), 0))"
_MF = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume"


def _top(x: str, n: int, fn: str = "max") -> str:
    return f"CASE WHEN count({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN {fn}({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"


def _strength(long: int, short: int) -> list:
    return [
        {"d": f"close - {lag('close')}"}, {"ad": "abs(d)"}, ema("e1", "d", long), ema("e2", "e1", short),
        ema("a1", "ad", long), ema("a2", "a1", short), {"line": "e2 / nullif(a2, 0)"},
    ]


def _index(sign: str) -> list:
    moved = f"volume {sign} {lag('volume')}"
    return [{"step": f"CASE WHEN {moved} AND {lag('close')} <> 0 THEN ln(close / {lag('close')}) ELSE 0.0 END"}, {"line": "1000 * exp(sum(step) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"}, ema("ema", "line", 30)]


_RSI = [{"d": f"close - {lag('close')}"}, {"u": "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END", "dn": "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END"}, rma("au", "u", 14), rma("ad", "dn", 14), {"rsi": "CASE WHEN au IS NULL THEN NULL WHEN ad = 0 THEN 100.0 ELSE 100 - 100 / (1 + au / nullif(ad, 0)) END"}]
SCAN_LAYERS: dict[str, tuple[list, dict[str, str]]] = {
    "ema": ([ema("e", "close", 20)], {"value": "e"}),
    "smma": ([rma("e", "close", 7)], {"smma": "e"}),
    "dema": ([ema("e1", "close", 9), ema("e2", "e1", 9)], {"value": "2 * e1 - e2"}),
    "tema": ([ema("e1", "close", 9), ema("e2", "e1", 9), ema("e3", "e2", 9)], {"value": "3 * (e1 - e2) + e3"}),
    "t3": (
        [step for i in range(3) for step in (ema(f"a{i}", "close" if i == 0 else f"x{i - 1}", 5), ema(f"b{i}", f"a{i}", 5), {f"x{i}": f"a{i} * 1.7 - b{i} * 0.7"})],
        {"t3": "x2"},
    ),
    "rsi": (_RSI, {"value": "rsi"}),
    "macd": ([ema("f", "close", 12), ema("s", "close", 26), {"m": "f - s"}, ema("g", "m", 9)], {"macd": "m", "signal": "g", "histogram": "m - g"}),
    "atr": ([{"tr": _TR}, rma("a", "tr", 14)], {"value": "a"}),
    "keltner-channel": ([{"tr": _TR}, rma("a", "tr", 10), ema("m", "close", 20)], {"upper": "m + 2 * a", "middle": "m", "lower": "m - 2 * a"}),
    "ppo": ([ema("f", "close", 12), ema("s", "close", 26), {"p": "100 * (f - s) / nullif(s, 0)"}, ema("g", "p", 9)], {"ppo": "p", "signal": "g", "hist": "p - g"}),
    "pvo": ([ema("f", "volume", 12), ema("s", "volume", 26), {"p": "100 * (f - s) / nullif(s, 0)"}, ema("g", "p", 9)], {"pvo": "p", "signal": "g", "hist": "p - g"}),
    "trix": ([{"x": "ln(close)"}, ema("e1", "x", 18), ema("e2", "e1", 18), ema("e3", "e2", 18), {"t": f"10000 * (e3 - {lag('e3')})"}], {"value": "t"}),
    "tsi": ([*_strength(25, 13), {"p": "100 * line"}, ema("g", "p", 13)], {"tsi": "p", "signal": "g"}),
    "smi-ergodic-indicator": ([*_strength(20, 5), {"p": "100 * line"}, ema("g", "p", 5)], {"erg": "p", "sig": "g"}),
    "smi-ergodic-oscillator": ([*_strength(20, 5), {"p": "100 * line"}, ema("g", "p", 5)], {"osc": "p - g"}),
    "smi": (
        [{"t": _top("high", 10), "w": _top("low", 10, "min")}, {"p": "close - (t + w) / 2", "q": "t - w"}, ema("p1", "p", 3), ema("p2", "p1", 3), ema("q1", "q", 3), ema("q2", "q1", 3), {"s": "200 * p2 / nullif(q2, 0)"}, ema("g", "s", 3)],
        {"smi": "s", "ema": "g"},
    ),
    "stochastic-rsi": ([*_RSI, {"w": _top("rsi", 14, "min"), "t": _top("rsi", 14)}, {"raw": "100 * (rsi - w) / nullif(t - w, 0)"}, {"kk": sma("raw", 3)}, {"dd": sma("kk", 3)}], {"k": "kk", "d": "dd"}),
    "chaikin-volatility": ([{"r": "high - low"}, ema("e", "r", 10), {"c": f"100 * (e - {lag('e', 10)}) / nullif({lag('e', 10)}, 0)"}], {"chaikinVolatility": "c"}),
    "chandelier-exit": ([{"tr": _TR}, rma("a", "tr", 22), {"t": _top("high", 22), "w": _top("low", 22, "min")}], {"longExit": "t - 3 * a", "shortExit": "w + 3 * a"}),
    "chande-kroll-stop": (
        [{"tr": _TR}, rma("a", "tr", 10), {"t": f"({_top('high', 10)}) - a", "w": f"({_top('low', 10, 'min')}) + a"}, {"tt": _top("t", 9), "ww": _top("w", 9, "min")}],
        {"stopLong": "ww", "stopShort": "tt"},
    ),
    "chaikin-oscillator": ([{"mf": _MF}, {"ad": "sum(mf) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}, ema("f", "ad", 3), ema("s", "ad", 10)], {"osc": "f - s"}),
    "elder-force-index": ([{"f": f"(close - {lag('close')}) * volume"}, ema("e", "f", 13)], {"efi": "e"}),
    "nvi": (_index("<"), {"nvi": "ln(line)", "ema": "ln(ema)"}),
    "pvi": (_index(">"), {"pvi": "ln(line)", "ema": "ln(ema)"}),
    "mass-index": ([{"r": "high - low"}, ema("e1", "r", 9), ema("e2", "e1", 9), {"q": "e1 / nullif(e2, 0)"}, {"m": _top("q", 10, "sum")}], {"mi": "m"}),
    "klinger-oscillator": (
        [{"x": "(high + low + close) / 3"}, {"sv": f"CASE WHEN x >= {lag('x')} THEN volume ELSE -volume END"}, ema("f", "sv", 34), ema("s", "sv", 55), {"k": "f - s"}, ema("g", "k", 13)],
        {"kvo": "k", "signal": "g"},
    ),
    "alligator": (
        [{"x": "(high + low) / 2"}, rma("j", "x", 13), rma("t", "x", 8), rma("p", "x", 5), {"jj": lag("j", 8), "tt": lag("t", 5), "pp": lag("p", 3)}],
        {"jaw": "jj", "teeth": "tt", "lips": "pp"},
    ),
    "wavetrend": (
        [{"x": "(high + low + close) / 3"}, ema("e", "x", 10), {"g": "abs(x - e)"}, ema("d", "g", 10), {"c": "(x - e) / nullif(0.015 * d, 0)"}, ema("w", "c", 21), {"ww": sma("w", 4)}],
        {"mom": "w - ww", "wt1": "w", "wt2": "ww"},
    ),
    "relative-volatility-index": (
        [{"sd": _top("close", 10, "stddev_pop"), "d": f"close - {lag('close')}"}, {"u": "CASE WHEN sd IS NULL THEN NULL WHEN d > 0 THEN sd ELSE 0 END", "dn": "CASE WHEN sd IS NULL THEN NULL WHEN d <= 0 THEN sd ELSE 0 END"}, ema("eu", "u", 14), ema("ed", "dn", 14), {"v": "100 * eu / nullif(eu + ed, 0)"}, {"m": sma("v", 14)}],
        {"rvi": "v", "ma": "m", "bb_upper": "CAST(NULL AS DOUBLE)", "bb_lower": "CAST(NULL AS DOUBLE)"},
    ),
}


def _mean(x: str, n: int) -> str:
    return _top(x, n, "avg")


_ALL = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_FISH = "CASE WHEN place IS NULL THEN 0 ELSE 0.5 * ln((1 + pos) / (1 - pos)) + 0.5 * %s END"
_MEAN_FLOW = [{"tp": "(high + low + close) / 3"}, {"d": f"tp - {lag('tp')}"}, {"uf": "CASE WHEN d > 0 THEN tp * volume WHEN d IS NOT NULL THEN 0 END", "df": "CASE WHEN d < 0 THEN tp * volume WHEN d IS NOT NULL THEN 0 END"}, {"us": _top("uf", 14, "sum"), "ds": _top("df", 14, "sum")}]


def _pivot(x: str, op: str) -> str:
    return " AND ".join(f"{x} {op} {lag(x, k)}" for k in (*range(-5, 0), *range(1, 6)))


def _before(column: str, condition: str) -> str:
    return f"last_value(CASE WHEN {condition} THEN {column} END IGNORE NULLS) {_ALL}"


_UP, _DOWN = f"high - {lag('high')}", f"{lag('low')} - low"
SCAN_LAYERS |= {
    "median": ([{"x": "(high + low) / 2", "tr": _TR}, {"m": _top("x", 3, "median")}, rma("a", "tr", 14), ema("e", "m", 3)], {"median": "m", "upper": "m + 2 * a", "lower": "m - 2 * a", "median_ema": "e"}),
    "adx": (
        [
            {"tr": f"CASE WHEN rn > 1 THEN {_TR} END", "up": f"CASE WHEN {_UP} > {_DOWN} AND {_UP} > 0 THEN {_UP} ELSE 0 END", "dn": f"CASE WHEN {_DOWN} > {_UP} AND {_DOWN} > 0 THEN {_DOWN} ELSE 0 END"},
            rma("r", "tr", 14), rma("u", "up", 14), rma("w", "dn", 14), {"p": "100 * u / nullif(r, 0)", "m": "100 * w / nullif(r, 0)"},
            {"dx": "100 * abs(p - m) / CASE WHEN p + m = 0 THEN 1 ELSE p + m END"}, rma("x", "dx", 14),
        ],
        {"plusDi": "p", "minusDi": "m", "adx": "x"},
    ),
    "chop-zone": (
        [
            {"lo": _top("low", 30, "min"), "hi": _top("high", 30)}, ema("e", "close", 34),
            {"rise": f"({lag('e')} - e) / nullif((high + low + close) / 3, 0) * (25 / nullif(hi - lo, 0)) * lo"}, {"angle": "round(degrees(acos(1 / sqrt(1 + rise * rise))))"},
        ],
        {"chopZone": "1.0", "angle": "CASE WHEN rise > 0 THEN -angle ELSE angle END"},
    ),
    "fisher-transform": (
        [
            {"x": "(high + low) / 2"}, {"lo": _top("x", 9, "min"), "hi": _top("x", 9)}, {"place": "(x - lo) / nullif(hi - lo, 0)"},
            Walk(
                {"pos": "coalesce(0.66 * (place - 0.5), 0)", "fish": _FISH % "0"},
                {"raw": "0.66 * (place - 0.5) + 0.67 * a_pos", "pos": "CASE WHEN raw IS NULL THEN 0 WHEN raw > 0.99 THEN 0.999 WHEN raw < -0.99 THEN -0.999 ELSE raw END", "fish": _FISH % "a_fish"},
            ),
            {"f": "CASE WHEN place IS NOT NULL THEN fish END"}, {"g": lag("f")},
        ],
        {"fisher": "f", "trigger": "g"},
    ),
    "parabolic-sar": (
        [
            {"pc": lag("close"), "ph": lag("high"), "pl": lag("low"), "ph2": lag("high", 2), "pl2": lag("low", 2)},
            Walk(
                {"side": "CASE WHEN close >= pc THEN 1 ELSE -1 END", "stop": "CASE WHEN side > 0 THEN pl ELSE ph END", "ext": "CASE WHEN side > 0 THEN high ELSE low END", "pace": "0.02"},
                {
                    "went": "a_stop + a_pace * (a_ext - a_stop)", "turned": "CASE WHEN a_side > 0 AND low < went OR a_side < 0 AND high > went THEN 1 ELSE 0 END",
                    "side": "CASE WHEN turned = 1 THEN -a_side ELSE a_side END", "further": "CASE WHEN turned = 0 AND (side > 0 AND high > a_ext OR side < 0 AND low < a_ext) THEN 1 ELSE 0 END",
                    "pace": "CASE WHEN turned = 1 THEN 0.02 WHEN further = 1 THEN least(0.2, a_pace + 0.02) ELSE a_pace END",
                    "base": "CASE WHEN turned = 1 AND side < 0 THEN greatest(a_ext, high) WHEN turned = 1 THEN least(a_ext, low) ELSE went END",
                    "ext": "CASE WHEN turned + further = 0 THEN a_ext WHEN side > 0 THEN high ELSE low END",
                    "stop": "CASE WHEN side > 0 THEN least(base, pl, pl2) ELSE greatest(base, ph, ph2) END",
                },
                "rn > 1",
            ),
        ],
        {"value": "stop"},
    ),
    "kama": (
        [
            {"step": f"abs(close - {lag('close')})", "back": lag("close", 10)}, {"noise": _top("step", 10, "sum")},
            Walk({"v": "close"}, {"er": "CASE WHEN noise = 0 THEN 0 ELSE least(1, abs(close - back) / noise) END", "al": "er * (2 / 3 - 2 / 31) + 2 / 31", "v": "a_v + al * al * (close - a_v)"}, "rn > 10"),
        ],
        {"value": "v"},
    ),
    "mcginley-dynamic": (
        [{"m": _mean("close", 14)}, Walk({"v": "m"}, {"step": "CASE WHEN a_v <> 0 THEN 14 * power(close / a_v, 4) END", "went": "a_v + (close - a_v) / step", "v": "CASE WHEN step > 1e-300 AND isfinite(went) THEN went ELSE m END"}, "m IS NOT NULL")],
        {"value": "ln(v)"},
    ),
    "supertrend": (
        [
            {"tr": _TR, "x": "(high + low) / 2", "pc": lag("close")}, rma("r", "tr", 10),
            Walk(
                {"top": "x + 3 * r", "bottom": "x - 3 * r", "falling": "CASE WHEN close <= top THEN 1 ELSE 0 END", "held": "CASE WHEN falling = 1 THEN top ELSE bottom END"},
                {
                    "top": "CASE WHEN x + 3 * r < a_top OR pc > a_top THEN x + 3 * r ELSE a_top END", "bottom": "CASE WHEN x - 3 * r > a_bottom OR pc < a_bottom THEN x - 3 * r ELSE a_bottom END",
                    "falling": "CASE WHEN CASE WHEN a_held = a_top THEN close <= top ELSE close < bottom END THEN 1 ELSE 0 END", "held": "CASE WHEN falling = 1 THEN top ELSE bottom END",
                },
                "r IS NOT NULL",
            ),
        ],
        {"line": "held", "up": "CASE WHEN falling = 0 THEN held END", "down": "CASE WHEN falling = 1 THEN held END", "direction": "1.0 - 2 * falling"},
    ),
    "volatility-stop": (
        [
            {"tr": _TR}, rma("r", "tr", 20), {"wide": "coalesce(2 * r, tr)"},
            Walk(
                {"rising": "1", "hi": "close", "lo": "close", "v": "close"},
                {
                    "hi0": "greatest(a_hi, close)", "lo0": "least(a_lo, close)", "v0": "CASE WHEN a_rising = 1 THEN greatest(a_v, hi0 - wide) ELSE least(a_v, lo0 + wide) END",
                    "rising": "CASE WHEN close >= v0 THEN 1 ELSE 0 END", "hi": "CASE WHEN rising <> a_rising THEN close ELSE hi0 END", "lo": "CASE WHEN rising <> a_rising THEN close ELSE lo0 END",
                    "v": "CASE WHEN rising = a_rising THEN v0 WHEN rising = 1 THEN close - wide ELSE close + wide END",
                },
            ),
        ],
        {"up": "CASE WHEN rising = 1 THEN v END", "down": "CASE WHEN rising = 0 THEN v END"},
    ),
    "connors-rsi": (
        [
            {"pc": lag("close")}, {"roc": "100 * (close - pc) / nullif(pc, 0)"},
            Walk({"streak": "-1"}, {"s": "sign(close - pc)", "streak": "CASE WHEN s = 0 THEN 0 WHEN a_streak * s > 0 THEN a_streak + s ELSE s END"}),
            {"ds": f"streak - {lag('streak')}", "dc": "close - pc"},
            {f"{n}{x}": f"CASE WHEN {x} IS NOT NULL THEN greatest({s}{x}, 0) END" for x in ("ds", "dc") for n, s in (("u", ""), ("w", "-"))},
            rma("usa", "uds", 2), rma("wsa", "wds", 2), rma("uca", "udc", 3), rma("wca", "wdc", 3),
            {"ranks": "list(roc) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"},
            {"rank": "CASE WHEN rn > 101 THEN 100.0 * len(list_filter(ranks, lambda z: z <= roc)) / 100 END"},
            {"rs": "CASE WHEN wsa = 0 THEN 100 ELSE 100 - 100 / (1 + usa / wsa) END", "rc": "CASE WHEN wca = 0 THEN 100 ELSE 100 - 100 / (1 + uca / wca) END"},
        ],
        {"crsi": "(rs + rc + rank) / 3"},
    ),
    "alphatrend": (
        [
            {"tr": _TR}, {"band": _mean("tr", 14)}, *_MEAN_FLOW,
            Walk({"v": "CASE WHEN us >= ds THEN greatest(low - band, 0) ELSE least(high + band, 0) END"}, {"v": "CASE WHEN us >= ds THEN greatest(low - band, a_v) ELSE least(high + band, a_v) END"}, "us IS NOT NULL AND band IS NOT NULL"),
            {"old": lag("v", 2)}, {"gap": "v - old"}, {"side": f"CASE WHEN gap > 0 AND {lag('gap')} <= 0 THEN 1 WHEN gap < 0 AND {lag('gap')} >= 0 THEN -1 END"},
            {"lu": _before("rn", "side = 1"), "ld": _before("rn", "side = -1")},
        ],
        {"alphatrend": "v", "lagged": "old", "buy_signal": "CASE WHEN side = 1 AND ld > lu + 1 THEN old * 0.9999 END", "sell_signal": "CASE WHEN side = -1 AND lu > ld + 1 THEN old * 1.0001 END"},
    ),
    "halftrend": (
        [
            {"tr": _TR, "t2": _top("high", 2), "b2": _top("low", 2, "min"), "mh": _mean("high", 2), "ml": _mean("low", 2), "ph": lag("high"), "pl": lag("low")}, rma("r", "tr", 100), {"half": "r / 2"},
            Walk(
                {"side": "1", "falls": "0", "sup": "low", "res": "high", "lu": "low", "ld": "0", "flip": "0"},
                {
                    "s1": "CASE WHEN a_falls = 1 THEN greatest(a_sup, b2) ELSE a_sup END", "r1": "CASE WHEN a_falls = 0 THEN least(a_res, t2) ELSE a_res END",
                    "turn": "CASE WHEN a_falls = 1 AND mh < s1 AND close < pl THEN -1 WHEN a_falls = 0 AND ml > r1 AND close > ph THEN 1 ELSE 0 END",
                    "side": "CASE WHEN turn <> 0 THEN turn ELSE a_side END", "falls": "CASE WHEN turn <> 0 THEN greatest(turn, 0) ELSE a_falls END",
                    "sup": "CASE WHEN turn = 1 THEN b2 ELSE s1 END", "res": "CASE WHEN turn = -1 THEN t2 ELSE r1 END", "flip": "CASE WHEN side <> a_side THEN 1 ELSE 0 END",
                    "lu": "CASE WHEN side < 0 THEN a_lu WHEN flip = 1 THEN a_ld ELSE greatest(sup, a_lu) END", "ld": "CASE WHEN side > 0 THEN a_ld WHEN flip = 1 THEN a_lu ELSE least(res, a_ld) END",
                },
            ),
            {"v": "CASE WHEN side > 0 THEN lu ELSE ld END"},
        ],
        {
            "up": "CASE WHEN side > 0 THEN v END", "down": "CASE WHEN side < 0 THEN v END", "atr_high": "v + 2 * half", "atr_low": "v - 2 * half",
            "buy_signal": "CASE WHEN flip = 1 AND side > 0 THEN v - half END", "sell_signal": "CASE WHEN flip = 1 AND side < 0 THEN v + half END",
        },
    ),
    "rsi-divergence": (
        [
            *_RSI, {"trough": f"({_pivot('rsi', '<')})", "peak": f"({_pivot('rsi', '>')})"},
            {f"{c}_{k}": _before(x, pivot) for k, pivot, price in (("l", "trough", "low"), ("h", "peak", "high")) for c, x in (("n", "rn"), ("r", "rsi"), ("p", price))},
        ],
        {
            "rsi": "rsi", "bull": "CASE WHEN trough AND rn - n_l BETWEEN 6 AND 61 AND rsi > r_l AND low < p_l THEN rsi END", "hiddenBull": "CAST(NULL AS DOUBLE)",
            "bear": "CASE WHEN peak AND rn - n_h BETWEEN 6 AND 61 AND rsi < r_h AND high > p_h THEN rsi END", "hiddenBear": "CAST(NULL AS DOUBLE)",
        },
    ),
    "consolidation-breakout": (
        [
            {"bt": "greatest(open, close)", "bb": "least(open, close)"},
            Walk(
                {"mh": "high", "ml": "low", "mn": "rn", "inside": "1", "up": "NULL", "dn": "NULL"},
                {
                    "inside": "CASE WHEN rn > 2 AND bt <= a_mh AND bb >= a_ml THEN 1 ELSE 0 END", "mh": "CASE WHEN inside = 1 THEN a_mh ELSE high END", "ml": "CASE WHEN inside = 1 THEN a_ml ELSE low END",
                    "mn": "CASE WHEN inside = 1 THEN a_mn ELSE rn END", "up": "CASE WHEN rn - a_mn BETWEEN 2 AND 250 AND bt > a_mh THEN a_mh END", "dn": "CASE WHEN rn - a_mn BETWEEN 2 AND 250 AND bb < a_ml THEN a_ml END",
                },
            ),
        ],
        {"rangeHigh": "CASE WHEN inside = 1 THEN mh END", "rangeLow": "CASE WHEN inside = 1 THEN ml END", "breakUp": "up", "breakDown": "dn", "insideAge": "CASE WHEN rn > mn THEN CAST(rn - mn AS DOUBLE) END"},
    ),
}


_FULL = f"CASE WHEN rn > 1 THEN {_TR} END"
STRATEGY_LAYERS = {
    "ema-ribbon-pullback": (
        [*(ema(f"e{n}", "close", n) for n in (9, 21, 50, 100)), {"s": "CASE WHEN rn <= 100 THEN NULL WHEN e9 > e21 AND e21 > e50 AND e50 > e100 AND close <= e9 THEN 1 WHEN e9 < e21 AND e21 < e50 AND e50 < e100 AND close >= e9 THEN -1 END"}],
        {"side": "s"},
    ),
    "bracket-breakout": (
        [
            {"tr": _FULL, "top": f"{lag('high')}", "bottom": f"{lag('low')}"}, {"top20": _top("top", 20), "bottom20": _top("bottom", 20, "min"), "wide": _mean("tr", 14)},
            Walk(
                {"held": "0", "stop": "NULL", "goal": "NULL", "s": "0", "code": "0"},
                {
                    "code0": "CASE WHEN a_held > 0 AND low <= a_stop OR a_held < 0 AND high >= a_stop THEN 3 WHEN a_held > 0 AND high >= a_goal OR a_held < 0 AND low <= a_goal THEN 4 ELSE 0 END",
                    "enter": "CASE WHEN a_held <> 0 OR wide IS NULL OR wide <= 0 THEN 0 WHEN close > top20 THEN 1 WHEN close < bottom20 THEN -1 ELSE 0 END",
                    "s": "CASE WHEN code0 > 0 THEN -a_held ELSE enter END", "code": "CASE WHEN enter > 0 THEN 1 WHEN enter < 0 THEN 2 ELSE code0 END",
                    "held": "CASE WHEN code0 > 0 THEN 0 WHEN enter <> 0 THEN enter ELSE a_held END",
                    "stop": "CASE WHEN enter <> 0 THEN close - enter * 1.5 * wide ELSE a_stop END", "goal": "CASE WHEN enter <> 0 THEN close + enter * 3 * wide ELSE a_goal END",
                },
            ),
        ],
        {"side": "nullif(s, 0)", "code": "code", "stop": "CASE WHEN code < 3 THEN stop END", "target": "CASE WHEN code < 3 THEN goal END"},
    ),
    "supertrend-regime": (
        [
            *SCAN_LAYERS["supertrend"][0], {"way": "1.0 - 2 * falling"}, {"flip": f"CASE WHEN way * {lag('way')} < 0 THEN way ELSE 0 END"},
            Walk(
                {"pos": "0", "entry": "NULL", "since": "NULL", "waiting": "0", "todo": "0", "code": "0"},
                {
                    "opens": "CASE WHEN a_todo <> 0 AND a_pos = 0 THEN 1 ELSE 0 END", "closes": "CASE WHEN a_todo <> 0 AND a_pos <> 0 AND a_todo <> a_pos THEN 1 ELSE 0 END",
                    "waiting": "greatest(CASE WHEN closes = 1 AND (open - a_entry) * a_pos < 0 THEN 5 ELSE a_waiting END - 1, 0)",
                    "pos": "CASE WHEN opens = 1 THEN a_todo WHEN closes = 1 THEN 0 ELSE a_pos END", "entry": "CASE WHEN opens = 1 THEN open ELSE a_entry END",
                    "since0": "CASE WHEN opens = 1 THEN rn - 1 WHEN closes = 1 THEN NULL ELSE a_since END", "enters": "CASE WHEN waiting = 0 THEN coalesce(flip, 0) ELSE 0 END",
                    "late": "CASE WHEN enters = 0 AND pos <> 0 AND rn - since0 >= 20 THEN 1 ELSE 0 END", "since": "CASE WHEN late = 1 THEN NULL ELSE since0 END",
                    "todo": "CASE WHEN enters <> 0 THEN enters WHEN late = 1 THEN -pos ELSE 0 END", "code": "CASE WHEN enters > 0 THEN 1 WHEN enters < 0 THEN 2 WHEN late = 1 THEN 3 ELSE 0 END",
                },
            ),
        ],
        {"side": "nullif(todo, 0)", "code": "code"},
    ),
}


_LAST = {"at_end": "CASE WHEN rn = max(rn) OVER (PARTITION BY symbol) THEN 1 ELSE 0 END", "ep": "epoch(ts)"}
TRANSFORM_LAYERS = {
    "renko": (
        [Walk({"edge": "floor(close / 2) * 2", "bricks": "0"}, {"bricks": "CASE WHEN close >= a_edge + 2 THEN floor((close - a_edge) / 2) WHEN close <= a_edge - 2 THEN -floor((a_edge - close) / 2) ELSE 0 END", "edge": "a_edge + 2 * bricks"})],
        {"ep": "epoch(ts)", "e0": "edge - 2 * bricks", "k": "bricks"},
    ),
    "range-bars": (
        [
            _LAST,
            Walk(
                {"o": "close", "h": "close", "l": "close", "done": "0"},
                {"o": "CASE WHEN a_done = 1 THEN close ELSE a_o END", "h": "CASE WHEN a_done = 1 THEN close ELSE greatest(a_h, close) END", "l": "CASE WHEN a_done = 1 THEN close ELSE least(a_l, close) END", "done": "CASE WHEN h - l >= 3 THEN 1 ELSE 0 END"},
            ),
        ],
        {"ep": "ep", "o": "o", "h": "h", "l": "l", "c": "close", "made": "CASE WHEN done = 1 OR at_end = 1 THEN 1 ELSE 0 END"},
    ),
    "kagi": (
        [
            _LAST,
            Walk(
                {"side": "1", "ext": "close", "thick": "0", "sh": "NULL", "wa": "NULL", "turn": "0", "v": "NULL", "vt": "NULL"},
                {
                    "ahead": "CASE WHEN a_side * (close - a_ext) > 0 THEN 1 ELSE 0 END", "turn": "CASE WHEN ahead = 0 AND a_side * (a_ext - close) >= 2 THEN 1 ELSE 0 END",
                    "thick": "CASE WHEN ahead = 1 AND a_side > 0 AND (a_sh IS NULL OR close > a_sh) THEN 1 WHEN ahead = 1 AND a_side < 0 AND (a_wa IS NULL OR close < a_wa) THEN 0 ELSE a_thick END",
                    "sh": "CASE WHEN turn = 1 AND a_side > 0 THEN a_ext ELSE a_sh END", "wa": "CASE WHEN turn = 1 AND a_side < 0 THEN a_ext ELSE a_wa END", "v": "a_ext", "vt": "a_thick",
                    "side": "CASE WHEN turn = 1 THEN -a_side ELSE a_side END", "ext": "CASE WHEN ahead + turn > 0 THEN close ELSE a_ext END",
                },
            ),
        ],
        {"ep": "ep", "turn": "turn", "v": "v", "vt": "vt", "ext": "ext", "thick": "thick", "at_end": "at_end"},
    ),
    "point-figure": (
        [
            _LAST,
            Walk(
                {"side": "0", "top": "floor(close)", "bot": "floor(close)", "since": "ep", "turn": "0", "s0": "0", "t0": "0", "b0": "0", "e0": "0"},
                {
                    "up": "floor(high)", "dn": "floor(low)", "begins": "CASE WHEN a_side = 0 AND (up > a_top OR dn < a_bot) THEN CASE WHEN up - a_top >= a_bot - dn THEN 1 ELSE -1 END ELSE 0 END",
                    "turn": "CASE WHEN a_side > 0 AND up <= a_top AND a_top - dn >= 3 OR a_side < 0 AND dn >= a_bot AND up - a_bot >= 3 THEN 1 ELSE 0 END",
                    "side": "CASE WHEN begins <> 0 THEN begins WHEN turn = 1 THEN -a_side ELSE a_side END",
                    "top": "CASE WHEN begins > 0 OR a_side > 0 AND up > a_top OR turn = 1 AND a_side < 0 THEN up WHEN turn = 1 THEN a_top - 1 ELSE a_top END",
                    "bot": "CASE WHEN begins < 0 OR a_side < 0 AND dn < a_bot OR turn = 1 AND a_side > 0 THEN dn WHEN turn = 1 THEN a_bot + 1 ELSE a_bot END",
                    "since": "CASE WHEN begins <> 0 OR turn = 1 THEN ep ELSE a_since END", "s0": "a_side", "t0": "a_top", "b0": "a_bot", "e0": "a_since",
                },
            ),
        ],
        {"ep": "ep", "turn": "turn", "s0": "s0", "t0": "t0", "b0": "b0", "e0": "e0", "side": "side", "top": "top", "bot": "bot", "since": "since", "at_end": "at_end"},
    ),
}


def transform_sql(name: str) -> str | None:
    """The bars that a transform makes: symbol, n, epoch (rising by a second at least), prices and volume."""
    none = "CAST(NULL AS DOUBLE)"
    if name == "line-break":
        walk = f"""b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({HOUR_BARS})), w AS (
SELECT symbol, rn, epoch(ts) AS e, [close] AS o, [close] AS c, false AS made FROM b WHERE rn = 1 UNION ALL
SELECT symbol, rn, e, CASE WHEN made THEN list_append(o, c[-1])[-3:] ELSE o END, CASE WHEN made THEN list_append(c, x)[-3:] ELSE c END, made FROM (
SELECT b.symbol, b.rn, epoch(b.ts) AS e, w.o, w.c, b.close AS x, b.close > list_max(list_concat(w.o, w.c)) OR b.close < list_min(list_concat(w.o, w.c)) AS made FROM w JOIN b ON b.symbol = w.symbol AND b.rn = w.rn + 1) z)"""
        rows = f"SELECT symbol, rn AS i, 0 AS j, e, o[-1] AS o, greatest(o[-1], c[-1]) AS h, least(o[-1], c[-1]) AS l, c[-1] AS c, {none} AS v FROM w WHERE made"
        head = f"WITH RECURSIVE {walk}, made_rows AS ({rows})"
    else:
        inner = scan_sql(name, 9, 0.0)
        if inner is None:
            return None
        rows = {
            "renko": f"SELECT symbol, ep AS i, j, ep AS e, e0 + sign(k) * 2 * j AS o, greatest(e0 + sign(k) * 2 * j, e0 + sign(k) * 2 * (j + 1)) AS h, least(e0 + sign(k) * 2 * j, e0 + sign(k) * 2 * (j + 1)) AS l, e0 + sign(k) * 2 * (j + 1) AS c, {none} AS v FROM (SELECT *, unnest(range(CAST(abs(k) AS BIGINT))) AS j FROM x) y",
            "range-bars": f"SELECT symbol, ep AS i, 0 AS j, ep AS e, o, h, l, c, {none} AS v FROM x WHERE made = 1",
            "kagi": "SELECT symbol, ep AS i, 0 AS j, ep AS e, v AS o, v AS h, v AS l, v AS c, vt AS v FROM x WHERE turn = 1 UNION ALL SELECT symbol, ep AS i, 1 AS j, 0 AS e, ext AS o, ext AS h, ext AS l, ext AS c, thick AS v FROM x WHERE at_end = 1",
            "point-figure": f"SELECT symbol, i, j, e, CASE WHEN s > 0 THEN b ELSE t + 1 END AS o, t + 1 AS h, b AS l, CASE WHEN s > 0 THEN t + 1 ELSE b END AS c, {none} AS v FROM (SELECT symbol, ep AS i, 0 AS j, e0 AS e, s0 AS s, t0 AS t, b0 AS b FROM x WHERE turn = 1 UNION ALL SELECT symbol, ep AS i, 1 AS j, since AS e, side AS s, top AS t, bot AS b FROM x WHERE at_end = 1 AND side <> 0) y",
        }[name]
        head = f"WITH x AS ({inner}), made_rows AS ({rows})"
    return f"""{head}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i, j) - 1 AS n FROM made_rows)
SELECT symbol, n, CAST(max(e - n) OVER (PARTITION BY symbol ORDER BY n) + n AS BIGINT) AS epoch, round(o + 3.7e-10, 6) AS open, round(h + 3.7e-10, 6) AS high, round(l + 3.7e-10, 6) AS low, round(c + 3.7e-10, 6) AS close, round(v + 3.7e-10, 6) AS volume FROM numbered"""


def strategy_sql(name: str, places: int, nudge: float) -> str:
    """The signals of a strategy."""
    plots = [c for c in STRATEGY_LAYERS[name][1] if c != "side"]
    return f"SELECT symbol, ts, CASE WHEN side > 0 THEN 'BUY' ELSE 'SELL' END AS side{''.join(f', round({c}, {places}) AS {c}' for c in plots)} FROM ({scan_sql(name, 9, nudge)}) z WHERE side IS NOT NULL"


def scan_sql(name: str, places: int, nudge: float, bars: str = HOUR_BARS) -> str | None:
    """A recursive query for a scan or a strategy, if there is one."""
    known = SCAN_LAYERS | STRATEGY_LAYERS | TRANSFORM_LAYERS
    if name not in known:
        return None
    layers, plots = known[name]
    parts, last = [f"t0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({bars}))"], "t0"
    for i, layer in enumerate(layers, 1):
        if isinstance(layer, Walk):
            state, only = list(layer.first), ", ".join(layer.first)
            before = ", ".join(f"a.{c} AS a_{c}" for c in state)
            parts += [
                f"k{i} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k FROM {last} WHERE {layer.where})",
                f"w{i} AS (SELECT symbol, rn, k, {only} FROM {_chained(f'SELECT * FROM k{i} WHERE k = 1', layer.first)} UNION ALL SELECT symbol, rn, k, {only} FROM "
                f"{_chained(f'SELECT b.*, {before} FROM w{i} a JOIN k{i} b ON b.symbol = a.symbol AND b.k = a.k + 1', layer.then)})",
                f"t{i} AS (SELECT p.*, {', '.join(f'w.{c}' for c in state)} FROM {last} p LEFT JOIN w{i} w ON p.symbol = w.symbol AND p.rn = w.rn)",
            ]
        elif isinstance(layer, dict):
            parts.append(f"t{i} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in layer.items())} FROM {last})")
        else:
            column, x, n, alpha = layer
            parts += [
                f"k{i} AS (SELECT symbol, rn, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k FROM {last} WHERE {x} IS NOT NULL)",
                f"s{i} AS (SELECT symbol, avg(x) AS s FROM k{i} WHERE k <= {n} GROUP BY symbol HAVING count(*) = {n})",
                f"r{i} AS (SELECT k.symbol, k.rn, k.k, s.s AS y FROM k{i} k JOIN s{i} s ON k.symbol = s.symbol WHERE k.k = {n} "
                f"UNION ALL SELECT k.symbol, k.rn, k.k, r.y + {alpha!r} * (k.x - r.y) FROM r{i} r JOIN k{i} k ON k.symbol = r.symbol AND k.k = r.k + 1)",
                f"t{i} AS (SELECT p.*, r.y AS {column} FROM {last} p LEFT JOIN r{i} r ON p.symbol = r.symbol AND p.rn = r.rn)",
            ]
        last = f"t{i}"
    return f"WITH RECURSIVE {', '.join(parts)} SELECT symbol, ts, {', '.join(f'round({e} + {nudge!r}, {places}) AS {c}' for c, e in plots.items())} FROM {last}"


# Breadth

_BREADTH = f"""
moved AS (SELECT ts, volume, sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS s FROM ({HOUR_BARS})),
sides AS (SELECT ts, count(*) FILTER (WHERE s = 1) AS advances, count(*) FILTER (WHERE s = -1) AS declines, list_sum(list(volume) FILTER (WHERE s = 1)) AS av, list_sum(list(volume) FILTER (WHERE s = -1)) AS dv FROM moved GROUP BY ts),
ratios AS (SELECT *, CASE WHEN declines = 0 THEN CASE WHEN advances = 0 THEN 0.0 ELSE 'inf'::DOUBLE END ELSE advances / declines END AS ratio FROM sides)"""
_R = "round({} + 3.7e-10, 6)"
ADVANCE_DECLINE = f"WITH {_BREADTH} SELECT ts, advances, declines, {_R.format('ratio')} AS ratio FROM ratios"
BREADTH = f"""WITH {_BREADTH}, ranked AS (SELECT *, (SELECT min(ts) FROM ratios WHERE isinf(ratio)) AS first_inf FROM ratios)
SELECT ts, advances, declines, {_R.format('ratio')} AS ratio, CASE WHEN ts >= first_inf THEN 'inf'::DOUBLE ELSE
{_R.format("coalesce((SELECT sum(ln(r.ratio)) FROM ratios r WHERE r.ts <= k.ts AND r.ratio > 0 AND NOT isinf(r.ratio)), 0)")} END AS log_cumulative FROM ranked k"""
TRIN = f"""WITH {_BREADTH} SELECT ts, CASE WHEN advances = 0 OR coalesce(av, 0) = 0 OR coalesce(dv, 0) = 0 THEN 'inf'::DOUBLE ELSE {_R.format('(declines / advances) / (dv / av)')} END AS trin FROM ratios"""

# Screens

TECHNICAL = f"""WITH i AS ({scan_sql("rsi", 12, 0.0)}), b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({HOUR_BARS})),
newest AS (SELECT symbol, max(ts) AS ts FROM i WHERE value IS NOT NULL GROUP BY symbol)
SELECT n.symbol, n.ts, b.close, {", ".join(f"round((SELECT avg(x.close) FROM b x WHERE x.symbol = b.symbol AND x.rn > b.rn - {k} AND x.rn <= b.rn) + 3.7e-10, 6) AS {c}" for c, k in (("sma_fast", 10), ("sma_slow", 30)))}, round(i.value + 3.7e-10, 6) AS rsi
FROM newest n JOIN b ON b.symbol = n.symbol AND b.ts = n.ts JOIN i ON i.symbol = n.symbol AND i.ts = n.ts"""


def _scanner(*conditions: str) -> str:
    met = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions)
    return f"""WITH i AS ({scan_sql("rsi", 12, 0.0, DAILY_BARS)}), last_rsi AS (SELECT symbol, arg_max(value, ts) FILTER (WHERE value IS NOT NULL) AS rsi FROM i GROUP BY symbol),
c AS (SELECT symbol, list(close ORDER BY ts DESC) AS v FROM ({DAILY_BARS}) GROUP BY symbol),
x AS (SELECT c.symbol, v[1] AS close, CASE WHEN len(v) > 10 THEN 100 * (v[1] - v[11]) / v[11] END AS roc, rsi FROM c LEFT JOIN last_rsi r ON r.symbol = c.symbol),
m AS (SELECT symbol, {met} AS n_matched FROM x)
SELECT symbol, CAST(n_matched AS INTEGER) AS n_matched, round(n_matched / {len(conditions)} + 3.7e-10, 6) AS score, CAST(row_number() OVER (ORDER BY n_matched DESC, symbol) AS INTEGER) AS rank FROM m WHERE n_matched > 0"""


SCANNERS = {"momentum": _scanner("close > 1000"), "pullback": _scanner("close > 500", "rsi < 40"), "nifty500_technical": _scanner("close > 100", "roc > 0")}

# Trades, in whole cents: units that were opened are numbered, and so are units that were closed; equal numbers meet.


def _trips(keys: str) -> str:
    part = f"PARTITION BY {keys}"
    leg = f"SELECT {keys}, run, n, ts, pc, uc, sg, row_number() OVER ({part}, run ORDER BY ts, n, u) AS at FROM (SELECT * REPLACE ({{run}} AS run), unnest(range({{units}})) AS u FROM cyc)"
    names = [k.strip() for k in keys.split(",")]
    return f"""f AS (SELECT {"coalesce(CASE WHEN l_orderkey % 5 > 0 THEN CAST(l_orderkey % 5 AS VARCHAR) END, 'none')"} AS strategy, CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts,
  l_orderkey * 10 + l_linenumber AS n, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS sg, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS pc, CAST(round(l_tax * 100) AS BIGINT) AS cost FROM lineitem),
held AS (SELECT *, sum(sg * qty) OVER ({part} ORDER BY ts, n) - sg * qty AS held, (200 * cost + qty) // (2 * qty) AS uc FROM f),
split AS (SELECT *, CASE WHEN held * sg < 0 THEN least(qty, abs(held)) ELSE 0 END AS closing FROM held),
marked AS (SELECT *, CASE WHEN qty > closing AND (held = 0 OR held * sg < 0) THEN 1 ELSE 0 END AS starts FROM split),
cyc AS (SELECT *, sum(starts) OVER ({part} ORDER BY ts, n) AS run FROM marked),
ent AS ({leg.format(run="run", units="CAST(qty - closing AS BIGINT)")}), ext AS ({leg.format(run="run - starts", units="CAST(closing AS BIGINT)")}),
trips AS (SELECT {", ".join(f"e.{k}" for k in names)}, CASE WHEN e.sg > 0 THEN 'LONG' ELSE 'SHORT' END AS side, count(*) AS units, e.n AS entry_n, e.ts AS entry_ts, e.pc AS entry_pc, x.n AS exit_n, x.ts AS exit_ts, x.pc AS exit_pc,
  (x.pc - e.pc) * e.sg * count(*) AS gross, (e.uc + x.uc) * count(*) AS costs FROM ent e JOIN ext x ON {" AND ".join(f"e.{k} = x.{k}" for k in names)} AND e.run = x.run AND e.at = x.at GROUP BY {", ".join(f"e.{k}" for k in names)}, e.sg, e.n, e.ts, e.pc, e.uc, x.n, x.ts, x.pc, x.uc)"""


ROUND_TRIPS = f"""WITH {_trips("symbol")} SELECT symbol, side, CAST(units AS DOUBLE) AS quantity, entry_n, entry_pc / 100 AS entry_price, exit_n, exit_pc / 100 AS exit_price,
CAST(gross AS BIGINT) / 100 AS gross_pnl, CAST(costs AS BIGINT) / 100 AS costs, CAST(gross - costs AS BIGINT) / 100 AS net_pnl FROM trips"""
PNL_BY_STRATEGY = f"""WITH {_trips("strategy, symbol")} SELECT nullif(s.strategy, 'none') AS strategy, coalesce(CAST(sum(gross - costs) AS BIGINT), 0) / 100 AS realised, count(t.strategy) AS n_trips
FROM (SELECT DISTINCT strategy FROM f) s LEFT JOIN trips t ON t.strategy = s.strategy GROUP BY s.strategy"""
_Q = "sign({0}) * ((2 * abs({0}) + {1}) // (2 * {1})) / 100"
STATISTICS = f"""WITH {_trips("strategy, symbol")}, t AS (SELECT *, CAST(gross - costs AS BIGINT) AS net FROM trips),
g AS (SELECT strategy, count(*) AS n, count_if(net > 0) AS w, count_if(net < 0) AS l, CAST(sum(net) AS BIGINT) AS net, CAST(coalesce(sum(gross) FILTER (WHERE gross > 0), 0) AS BIGINT) AS gp, CAST(coalesce(sum(gross) FILTER (WHERE gross < 0), 0) AS BIGINT) AS gl,
  CAST(sum(costs) AS BIGINT) AS c, CAST(coalesce(sum(net) FILTER (WHERE net > 0), 0) AS BIGINT) AS nw, CAST(coalesce(sum(net) FILTER (WHERE net < 0), 0) AS BIGINT) AS nl, coalesce(max(net) FILTER (WHERE net > 0), 0) AS lw, coalesce(min(net) FILTER (WHERE net < 0), 0) AS ll,
  sum(epoch(exit_ts) - epoch(entry_ts)) AS held, max(epoch(exit_ts)) - min(epoch(entry_ts)) AS span FROM t GROUP BY strategy),
d AS (SELECT strategy, exit_ts AS ts, CAST(sum(net) AS BIGINT) / 100 AS x FROM t GROUP BY 1, 2), v AS (SELECT strategy, ts, 1e7 + sum(x) OVER (PARTITION BY strategy ORDER BY ts) AS v FROM d),
p AS (SELECT *, max(v) OVER (PARTITION BY strategy ORDER BY ts) AS top, lag(v) OVER (PARTITION BY strategy ORDER BY ts) AS b FROM v),
e AS (SELECT strategy, least(min(v / top - 1), 0) AS dd, avg((v - b) / b) AS m, stddev_samp((v - b) / b) AS sd, sqrt(avg(CASE WHEN b IS NOT NULL THEN power(least((v - b) / b, 0), 2) END)) AS down FROM p GROUP BY strategy),
q AS (SELECT g.*, e.*, {_Q.format("net", "n")} AS average_trade, CASE WHEN w > 0 THEN {_Q.format("nw", "w")} ELSE 0 END AS average_winner, CASE WHEN l > 0 THEN {_Q.format("nl", "l")} ELSE 0 END AS average_loser FROM g JOIN e ON e.strategy = g.strategy)
SELECT strategy, n AS total_trades, w AS winning_trades, l AS losing_trades, net / 100 AS net_profit, gp / 100 AS gross_profit, gl / 100 AS gross_loss, c / 100 AS total_costs, {_R.format("w / n")} AS win_rate, {_R.format("l / n")} AS loss_rate,
average_trade, average_winner, average_loser, lw / 100 AS largest_win, ll / 100 AS largest_loss, {_R.format("held / span")} AS exposure, {_R.format("coalesce(gp / nullif(-gl, 0), 0)")} AS profit_factor, average_trade AS expectancy,
{_R.format("coalesce(average_winner / nullif(-average_loser, 0), 0)")} AS risk_reward, {_R.format("dd")} AS max_drawdown, {_R.format("m * 252 / (sd * sqrt(252))")} AS sharpe, {_R.format("m * 252 / (down * sqrt(252))")} AS sortino, {_R.format("100 * dd")} AS max_drawdown_pct FROM q"""
MAE_MFE = f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({HOUR_BARS})),
m AS (SELECT *, (SELECT CASE WHEN count(*) = 5 THEN avg(x.close) END FROM b x WHERE x.symbol = b.symbol AND x.rn BETWEEN b.rn - 4 AND b.rn) - (SELECT CASE WHEN count(*) = 20 THEN avg(x.close) END FROM b x WHERE x.symbol = b.symbol AND x.rn BETWEEN b.rn - 19 AND b.rn) AS gap FROM b),
c AS (SELECT *, lag(gap) OVER w AS old, lead(ts) OVER w AS nts, lead(open) OVER w AS nopen FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s AS (SELECT symbol, sign(gap) AS s, nts, nopen, lead(nts) OVER (PARTITION BY symbol ORDER BY nts) AS ets FROM c WHERE nopen IS NOT NULL AND (old <= 0 AND gap > 0 OR old >= 0 AND gap < 0))
SELECT s.symbol, CASE WHEN s > 0 THEN 'LONG' ELSE 'SHORT' END AS side, CAST(epoch(s.nts) AS BIGINT) AS entry_n, CAST(epoch(s.ets) AS BIGINT) AS exit_n,
round(greatest(CASE WHEN s > 0 THEN round(any_value(nopen), 4) - min(low) ELSE max(high) - round(any_value(nopen), 4) END, 0) + 3.7e-10, 2) AS mae, round(greatest(CASE WHEN s > 0 THEN max(high) - round(any_value(nopen), 4) ELSE round(any_value(nopen), 4) - min(low) END, 0) + 3.7e-10, 2) AS mfe
FROM s JOIN b ON b.symbol = s.symbol AND b.ts BETWEEN s.nts AND s.ets WHERE s.ets IS NOT NULL GROUP BY s.symbol, s.s, s.nts, s.ets"""
_H = "((2 * t * {} + {}) // (2 * {}))"
FEES = f"""WITH l AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_linenumber % 2 = 0 AS sold, (l_orderkey * 10 + l_linenumber) % 2 = 0 AS delivered, CAST(l_quantity AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT) AS t FROM lineitem),
p AS (SELECT symbol, least({_H.format(3, 10000, 10000)}, 2000) AS b, CASE WHEN delivered THEN {_H.format(1, 1000, 1000)} WHEN sold THEN {_H.format(25, 100000, 100000)} ELSE 0 END AS x, {_H.format(345, 10000000, 10000000)} AS e, {_H.format(2, 1000000, 1000000)} AS r, {_H.format(3, 100000, 100000)} AS s FROM l)
SELECT symbol, count(*) AS n, CAST(sum(b) AS BIGINT) / 100 AS brokerage, CAST(sum(x) AS BIGINT) / 100 AS transaction_tax, CAST(sum(e) AS BIGINT) / 100 AS exchange_fee, CAST(sum(r) AS BIGINT) / 100 AS regulator_fee, CAST(sum(s) AS BIGINT) / 100 AS stamp,
CAST(sum((36 * (b + e + r) + 100) // 200) AS BIGINT) / 100 AS service_tax FROM p GROUP BY symbol"""
STOP_GAP = f"""SELECT symbol, ts, {_R.format("list_max([list_min([(open + close) / 2 * 0.9975, low]), 0.01])")} AS stop_buy, {_R.format("list_max([(open + close) / 2 * 1.0025, high, 0.01])")} AS stop_sell,
{_R.format("(open + close) / 2")} AS target_buy, {_R.format("(open + close) / 2")} AS target_sell FROM ({HOUR_BARS})"""
FOLDS = f"""WITH n AS (SELECT symbol, count(*) AS n FROM ({DAILY_BARS}) GROUP BY symbol), e AS (SELECT *, greatest(1, CAST(ceil(n * 0.01) AS BIGINT)) AS e FROM n), s AS (SELECT *, unnest(range(141 + e, n, 60)) AS test_from FROM e)
SELECT symbol, test_from - e - 120 AS train_from, test_from - e AS train_to, test_from, least(test_from + 60, n) AS test_to FROM s"""

# Screens bounded in time

RESAMPLE_BOUNDED = f"""SELECT symbol, time_bucket(interval '1 hour', ts, interval '15 minutes') AS bucket, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume, count(*) AS n_bars
FROM ({TICKS}) WHERE ts BETWEEN TIMESTAMP '2024-01-05 09:15:00' AND TIMESTAMP '2024-01-20 15:30:00' AND symbol IN ('click', 'view', 'none') GROUP BY 1, 2"""


def _strength_sql(end: str) -> str:
    """Relative strength of the last 121 hours of at least two ticks, 100 of them scored, by lists instead of windows."""
    mean = "list_avg(cs[greatest(i - {k} + 2, 1):i + 1])"
    return f"""hb AS (SELECT symbol, time_bucket(interval '1 hour', ts) AS b, max(price) AS h, min(price) AS l, arg_max(price, ts) AS c FROM ({TICKS}) WHERE ts <= TIMESTAMP '{end}' GROUP BY 1, 2 HAVING count(*) >= 2),
hl AS (SELECT symbol, list(c ORDER BY b)[-121:] AS cs, list(h ORDER BY b)[-121:] AS hs, list(l ORDER BY b)[-121:] AS ls FROM hb GROUP BY symbol),
hi AS (SELECT *, unnest(range(len(cs))) AS i FROM hl),
ht AS (SELECT *, CASE WHEN i = 0 THEN hs[1] - ls[1] ELSE greatest(hs[i + 1] - ls[i + 1], abs(hs[i + 1] - cs[i]), abs(ls[i + 1] - cs[i])) END AS tr FROM hi),
hm AS (SELECT symbol, i, cs[i + 1] AS c, {mean.format(k=4)} AS m1, {mean.format(k=10)} AS m2, {mean.format(k=20)} AS m3, avg(tr) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) AS atr FROM ht),
rs AS (SELECT symbol, sum((3 * c + m1 - m2 - 3 * m3) / atr * power(4, (i - 20) / 100)) / sum(power(4, (i - 20) / 100)) AS rs, count(*) AS n FROM hm WHERE i >= 21 AND atr > 0 GROUP BY symbol HAVING count(*) = 100)"""


RS_BOUNDED = f"""WITH {_strength_sql("2024-01-25 00:00:00")} SELECT symbol, round(rs + 3.7e-10, 4) AS rs_score, n AS n_scored FROM rs"""
BREADTH_BOUNDED = f"""WITH d AS (SELECT symbol, date_trunc('day', ts) AS bucket, arg_max(price, ts) AS c FROM ({TICKS}) WHERE ts <= TIMESTAMP '2024-01-26 09:45:00' GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS k FROM d),
x AS (SELECT a.bucket, a.c, (SELECT avg(b.c) FROM n b WHERE b.symbol = a.symbol AND b.k > a.k - 10 AND b.k <= a.k) AS m, p.c AS pc FROM n a LEFT JOIN n p ON p.symbol = a.symbol AND p.k = a.k - 1)
SELECT bucket, count(*) AS n_symbols, count(*) FILTER (WHERE c > m) AS above_dma, round(100.0 * count(*) FILTER (WHERE c > m) / count(*) + 3.7e-10, 2) AS pct_above_dma, count(*) FILTER (WHERE c > pc) AS advances, count(*) FILTER (WHERE c < pc) AS declines FROM x GROUP BY bucket"""
_W = "(PARTITION BY symbol ORDER BY d)"
MORNING_SCREEN = f"""WITH {_strength_sql("2024-01-26 00:00:00")},
t AS (SELECT *, date_trunc('day', ts) AS d, strftime(ts, '%H:%M') AS hm FROM ({TICKS}) WHERE ts <= TIMESTAMP '2024-01-26 09:45:00'),
dd AS (SELECT symbol, d, arg_min(price, ts) AS o, arg_max(price, ts) AS c, max(price) AS h, min(price) AS l, sum(volume) FILTER (WHERE hm < '09:45') AS v30, arg_max(price, ts) FILTER (WHERE hm <= '09:45') AS px FROM t GROUP BY symbol, d),
f AS (SELECT *, round(100 * (o / lag(c) OVER {_W} - 1) + 3.7e-10, 3) AS gap_pct, round(100 * (px / o - 1) + 3.7e-10, 3) AS pre30_ret, coalesce(v30, 0) / avg(coalesce(v30, 0)) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS vx,
  h - lag(h) OVER {_W} AS up, lag(l) OVER {_W} - l AS dn, greatest(h - l, abs(h - lag(c) OVER {_W}), abs(l - lag(c) OVER {_W})) AS tr FROM dd),
y AS (SELECT symbol, arg_max(struct_pack(d := d, o := o, gap_pct := gap_pct, pre30_ret := pre30_ret, v30x := round(vx + 3.7e-10, 2)), d) AS z, list(pre30_ret ORDER BY d DESC)[2] AS prev FROM f GROUP BY symbol),
s AS (SELECT symbol, d, c, avg(CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END) OVER w AS p, avg(CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END) OVER w AS m, avg(tr) OVER w AS atr FROM f WHERE d < (SELECT max(d) FROM t) WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 4 PRECEDING)),
x AS (SELECT symbol, d, avg(100 * abs(p - m) / nullif(p + m, 0)) OVER (PARTITION BY symbol ORDER BY d ROWS 4 PRECEDING) AS adx FROM s),
a AS (SELECT symbol, list(adx ORDER BY d DESC) FILTER (WHERE adx IS NOT NULL) AS v FROM x GROUP BY symbol),
r AS (SELECT symbol, atr, 100 * atr / nullif(c, 0) AS pct FROM s WHERE d = (SELECT max(d) FROM s))
SELECT y.symbol, z.d AS day, z.o AS open_px, z.gap_pct AS gap_pct, z.pre30_ret AS pre30_ret, z.v30x AS v30x, round(rs.rs + 3.7e-10, 3) AS rs_score, round(atr + 3.7e-10, 2) AS atr, round(pct + 3.7e-10, 2) AS atr_pct
FROM y JOIN rs ON rs.symbol = y.symbol JOIN a ON a.symbol = y.symbol JOIN r ON r.symbol = y.symbol
WHERE z.v30x >= 0.05 AND z.gap_pct >= -1e6 AND z.pre30_ret >= -1e6 AND prev <= 1e9 AND z.o >= 0.001 AND v[1] >= 1 AND v[1] > v[2] AND pct BETWEEN 0.5 AND 1e6 AND rs.rs > (SELECT median(rs) FROM rs)"""

# An account's orders one after the other: only accepted ones move cash and the position.
RISK = """WITH RECURSIVE o AS (SELECT CAST(o_custkey AS VARCHAR) AS account, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE 1.0 END AS s, round(o_totalprice) AS v,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
w AS (SELECT account, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS refused, 800000.0::DOUBLE AS cash, 0.0::DOUBLE AS position FROM (SELECT DISTINCT account FROM o)
UNION ALL SELECT account, n, k, refused, CASE WHEN refused IS NULL THEN cash - s * v ELSE cash END, CASE WHEN refused IS NULL THEN position + s ELSE position END FROM (
SELECT o.account, o.n, o.k, o.s, o.v, w.cash, w.position, CASE WHEN o.s < 0 AND w.position + o.s < 0 THEN 'short' WHEN o.v > 300000 THEN 'order value' WHEN o.s > 0 AND o.v > w.cash THEN 'cash'
WHEN abs(w.position + o.s) > abs(w.position) AND abs(w.position + o.s) * o.v > 900000 THEN 'position value' END AS refused FROM w JOIN o ON o.account = w.account AND o.k = w.k + 1) x)
SELECT account, n, refused, cash, position FROM w WHERE k > 0"""

# Sessions: the grid laid out, and what it has without a bar


def _missing(include_open: bool, least: int) -> str:
    return f"""days AS (SELECT CAST(d AS DATE) AS day FROM generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-24', interval 1 day) t(d) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (DATE '2024-01-08', DATE '2024-01-17')),
grid AS (SELECT day, day + interval '555 minutes' + interval 1 hour * h AS ts FROM days, range(7) r(h) WHERE day + interval '555 minutes' + interval 1 hour * h BETWEEN TIMESTAMP '2024-01-02 10:00:00' AND TIMESTAMP '2024-01-24 13:00:00'),
edges AS (SELECT *, ts = min(ts) OVER (PARTITION BY day) AS is_open, ts = max(ts) OVER (PARTITION BY day) AS is_close FROM grid),
have AS (SELECT DISTINCT symbol, time_bucket(interval '1 hour', ts, interval '15 minutes') AS ts FROM ({TICKS})), names AS (SELECT DISTINCT event_type AS symbol FROM events UNION ALL SELECT 'none'),
gone AS (SELECT n.symbol, e.* FROM names n, edges e WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.symbol = n.symbol AND h.ts = e.ts)),
inner_ones AS (SELECT symbol, day, ts, ts - interval 1 hour * row_number() OVER (PARTITION BY symbol, day ORDER BY ts) AS run FROM gone WHERE NOT is_close{"" if include_open else " AND NOT is_open"}),
runs AS (SELECT symbol, min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS n_missing FROM inner_ones GROUP BY symbol, day, run)"""


SESSION_GAPS = f"WITH {_missing(False, 1)} SELECT * FROM runs"
SESSION_SUMMARY = f"""WITH {_missing(False, 2)}, small AS (SELECT symbol, coalesce(sum(n_missing) FILTER (WHERE n_missing < 2), 0) AS s FROM runs GROUP BY symbol)
SELECT g.symbol, count(*) FILTER (WHERE is_open) AS open_missing, count(*) FILTER (WHERE is_close) AS close_missing, CAST(coalesce(any_value(s.s), 0) AS BIGINT) AS sub_threshold_stamps, count(*) FILTER (WHERE NOT is_open AND NOT is_close) = 0 AS edge_only
FROM gone g LEFT JOIN small s ON s.symbol = g.symbol GROUP BY g.symbol"""
REPAIR_ORDER = f"""WITH {_missing(True, 1)}, k AS (SELECT symbol, CASE WHEN bool_and(gap_start = gap_end AND strftime(gap_start, '%H:%M') = '09:15') THEN 2 WHEN bool_or(gap_end - gap_start >= interval 300 minute) THEN 1 ELSE 0 END AS kind, CAST(sum(n_missing) AS BIGINT) AS n_stamps FROM runs GROUP BY symbol)
SELECT *, row_number() OVER (ORDER BY kind, n_stamps DESC, symbol) AS place FROM k"""

# Order flow against the middle of the quote

_QUOTES = f"""q AS (SELECT symbol, ts, event_id AS n, price AS ltp, round(price / 5) * 5 AS c, CASE WHEN event_id % 7 > 0 THEN volume END AS volume, event_id FROM ({TICKS})),
m AS (SELECT *, CASE WHEN event_id % 11 > 0 THEN c - 1 ELSE ltp END + CASE WHEN event_id % 13 > 0 THEN c + 1 ELSE ltp END AS two FROM q), s AS (SELECT *, sign(2 * ltp - two) AS side FROM m)"""
FOOTPRINT = f"""WITH {_QUOTES} SELECT symbol, ltp AS price, coalesce(sum(volume) FILTER (WHERE side = 1), 0) AS bought, coalesce(sum(volume) FILTER (WHERE side = -1), 0) AS sold, sum(side * volume) AS delta FROM s WHERE volume IS NOT NULL AND side <> 0 GROUP BY symbol, ltp"""
CVD = f"WITH {_QUOTES} SELECT symbol, n, CAST(sum(side * coalesce(volume, 0)) OVER (PARTITION BY symbol ORDER BY ts, n) AS BIGINT) AS cvd FROM s"

# Ledgers in whole cents, chains and shares

_LEDGER = """f AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, ((l_orderkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT)) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS n, CAST(l_quantity AS BIGINT) * CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS p,
row_number() OVER (PARTITION BY l_suppkey ORDER BY ((l_orderkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT)) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT)) AS k FROM lineitem),
w AS (SELECT symbol, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS average, CAST(0 AS BIGINT) AS realised FROM (SELECT DISTINCT symbol FROM f) UNION ALL
SELECT f.symbol, f.n, f.k, w.pos + f.q, CAST(CASE WHEN w.pos + f.q = 0 THEN 0 WHEN w.pos * f.q >= 0 THEN (2 * (w.average * abs(w.pos) + f.p * abs(f.q)) + abs(w.pos) + abs(f.q)) // (2 * (abs(w.pos) + abs(f.q))) WHEN abs(f.q) > abs(w.pos) THEN f.p ELSE w.average END AS BIGINT),
CAST(w.realised + CASE WHEN w.pos * f.q < 0 THEN (f.p - w.average) * least(abs(f.q), abs(w.pos)) * sign(w.pos) ELSE 0 END AS BIGINT) FROM w JOIN f ON f.symbol = w.symbol AND f.k = w.k + 1)"""
LEDGER = f"WITH RECURSIVE {_LEDGER} SELECT symbol, n, CAST(pos AS DOUBLE) AS position, average / 100 AS average, realised / 100 AS realised FROM w WHERE k > 0"
FLAT_TRIPS = f"""WITH RECURSIVE {_LEDGER}, t AS (SELECT *, (SELECT count(*) FROM w v WHERE v.symbol = w.symbol AND v.k > 0 AND v.k < w.k AND v.pos = 0) AS trip FROM w WHERE k > 0),
g AS (SELECT symbol, trip, min(n) AS first_n, max(n) AS last_n, arg_max(realised, n) AS upto, arg_max(pos, n) AS held FROM t GROUP BY symbol, trip)
SELECT symbol, trip, first_n, last_n, (upto - coalesce(lag(upto) OVER (PARTITION BY symbol ORDER BY trip), 0)) / 100 AS pnl FROM g QUALIFY held = 0"""
CHAIN = """WITH RECURSIVE e AS (SELECT event_type AS key, event_id AS n, props AS payload, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
w AS (SELECT key, n, k, payload, sha256('|' || payload) AS digest FROM e WHERE k = 1 UNION ALL SELECT e.key, e.n, e.k, e.payload, sha256(w.digest || '|' || e.payload) FROM w JOIN e ON e.key = w.key AND e.k = w.k + 1)
SELECT key, n, payload, digest FROM w"""
