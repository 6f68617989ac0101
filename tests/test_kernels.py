"""State machines and transforms on series worked out by hand."""

import numpy as np
import pytest

from barloom.operators import scans, transforms

NAN = float("nan")


def bars(rows):
    o, h, l, c = (np.array(x, float) for x in zip(*rows))  # noqa: E741
    return scans.Bars(o, h, l, c, np.full(len(o), 100.0), np.arange(len(o)))


def plots(name, rows, **given):
    return {k: [None if np.isnan(x) else round(float(x), 6) for x in v] for k, v in scans.SCANS[name][0](bars(rows), *scans.parameters(name, given)).items()}


def made(name, closes, **given):
    c = np.array(closes, float)
    fn, defaults = transforms.TRANSFORMS[name]
    return [tuple(None if x is None else float(x) for x in r) for r in fn(np.arange(len(c)) + 1, c, c.copy(), c.copy(), c.copy(), c, *(defaults | given).values())]


def test_sar_carries_its_seed_and_turns_from_the_third_bar():
    # rising: seed is the first low; then 9 + 0.02 * (12 - 9) = 9.06, held to the lowest of the last two lows, 9
    got = plots("parabolic-sar", [(10, 11, 9, 10), (10, 12, 10, 11), (11, 13, 10, 12), (12, 12, 8, 8)])["value"]
    # 9 + 0.04 * (13 - 9) = 9.16 is broken by 8: the stop goes to the extreme of 13
    assert got == [None, 9.0, 9.0, 13.0]


def test_fisher_starts_anew_at_a_flat_window():
    flat = [(5, 6, 4, 5)] * 3
    got = plots("fisher-transform", [*flat, (6, 8, 6, 7), *flat], length=3)
    # one place at the top: 0.66 * 0.5 = 0.33; the next bars stand at the bottom of the window
    first = 0.5 * np.log(1.33 / 0.67)
    second = 0.66 * -0.5 + 0.67 * 0.33
    assert got["fisher"][:3] == [None] * 3 and got["fisher"][3] == round(first, 6)
    assert got["fisher"][4] == round(0.5 * np.log((1 + second) / (1 - second)) + first / 2, 6)
    assert got["fisher"][6] is None and got["trigger"][4] == got["fisher"][3]


def test_chop_zone_is_one_on_every_bar():
    got = plots("chop-zone", [(10 + i, 11 + i, 9 + i, 10 + i) for i in range(40)])
    assert got["chopZone"] == [1.0] * 40 and got["angle"][:34] == [None] * 34 and got["angle"][34] > 0


def test_halftrend_rises_first_and_turns_where_the_lows_give_way():
    up = [(10 + i, 10.5 + i, 9.5 + i, 10 + i) for i in range(6)]
    down = [(15 - 2 * i, 15.5 - 2 * i, 14.5 - 2 * i, 15 - 2 * i) for i in range(1, 5)]
    got = plots("halftrend", up + down, atrPeriod=3)
    assert got["up"][0] == 9.5 and got["down"][0] is None
    turn = next(i for i, x in enumerate(got["down"]) if x is not None)
    assert got["down"][turn] == got["up"][turn - 1] and got["sell_signal"][turn] > got["down"][turn]
    assert [x for x in got["buy_signal"] if x is not None] == []


def test_alphatrend_starts_with_the_money_flow():
    rows = [(10 + i, 11 + i, 9 + i, 10 + i) for i in range(8)]
    got = plots("alphatrend", rows, AP=3)
    assert got["alphatrend"][:3] == [None] * 3
    assert got["alphatrend"][3] == 12 - 2  # the low less a range of 2
    assert got["lagged"][5] == got["alphatrend"][3]


def test_divergence_needs_six_bars_between_pivots():
    i = np.arange(40)
    c = 100 + 5 * np.sin(i / 2.0) - 0.2 * i
    rows = [(x, x + 1, x - 1, x) for x in c]
    got = plots("rsi-divergence", rows, length=3, lbR=2, lbL=2)
    r = got["rsi"]
    lows = [k for k in range(5, 37) if r[k] < min(r[k - 2 : k] + r[k + 1 : k + 3])]
    marked = [k for k, x in enumerate(got["bull"]) if x is not None]
    assert marked == [b for a, b in zip(lows, lows[1:]) if 6 <= b - a <= 61 and r[b] > r[a] and c[b] < c[a]]
    assert got["hiddenBull"] == got["hiddenBear"] == [None] * 40


def test_consolidation_tests_bodies_and_returns_the_rail():
    rows = [(10, 10, 10, 10), (10, 15, 5, 10), (11, 20, 9, 12), (12, 13, 11, 12), (13, 16, 12, 16)]
    got = plots("consolidation-breakout", rows)
    # the third bar's wick leaves the range of the second one, its body doesn't
    assert got["insideAge"] == [None, None, 1.0, 2.0, None]
    assert got["rangeHigh"] == [10.0, None, 15.0, 15.0, None]
    assert got["breakUp"] == [None] * 4 + [15.0] and got["breakDown"] == [None] * 5


def test_line_break_opens_at_the_last_close():
    got = made("line-break", [10, 11, 12, 11.5, 9, 13])
    assert [(r[1], r[4]) for r in got] == [(10, 11), (11, 12), (12, 9), (9, 13)]


def test_point_figure_counts_floored_boxes():
    got = made("point-figure", [10.5, 12.2, 14.9, 11.8, 11.0, 15.2], reversal=3)
    # 10..14 rises to the top of box 14; 14 - 11 is three boxes, so a column falls from box 13; 15 - 11 turns it again
    assert [r[1:5] for r in got] == [(10, 15, 10, 15), (14, 14, 11, 11), (12, 16, 12, 16)]
    assert made("point-figure", [10.5, 10.6]) == []
    wide = made("point-figure", [100, 103, 99], mode="percent", percent=1.0, reversal=2)
    assert wide[0][1:5] == (100, 104, 100, 104)
    with pytest.raises(ValueError):
        made("point-figure", [1, 2], box=0)


def test_kagi_gives_turning_points():
    got = made("kagi", [10, 13, 10, 9, 14, 8])
    # thick up to 13; falling on to 9 passes every waist, so the line is thin, and 14 was reached by a turn alone
    assert [(r[0], r[1], r[5]) for r in got] == [(3, 13, 1), (5, 9, 0), (6, 14, 0), (0, 8, 0)]
    assert all(r[1] == r[2] == r[3] == r[4] for r in got)


def test_renko_and_range_bars_give_no_volume():
    assert made("renko", [10.5, 15.1, 11]) == [(2, 10, 12, 10, 12, None), (2, 12, 14, 12, 14, None), (3, 14, 14, 12, 12, None)]
    assert [r[1:] for r in made("range-bars", [10, 12, 13.5, 14])] == [(10, 13.5, 10, 13.5, None), (14, 14, 14, 14, None)]
