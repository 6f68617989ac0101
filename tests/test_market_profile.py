import datetime as dt
import random

from barloom.plans import execution, market_profile, trades
from pyspark.sql import functions as F


def brute_area(levels, share):
    steps = sorted(levels)
    poc = max(range(len(steps)), key=lambda i: (round(levels[steps[i]], 6), i))
    lo = hi = poc
    held, total = levels[steps[poc]], sum(levels.values())
    while held < total * share and (lo > 0 or hi + 1 < len(steps)):
        below = levels[steps[lo - 1]] if lo else -1
        above = levels[steps[hi + 1]] if hi + 1 < len(steps) else -1
        if above >= below:
            hi += 1
            held += above
        else:
            lo -= 1
            held += below
    return steps[poc], steps[lo], steps[hi]


def test_value_area_matches_a_loop(spark):
    rng = random.Random(3)
    rows = [(s, i, float(rng.randint(1, 40))) for s in "ABC" for i in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "symbol string, step long, v double")
    got = {r.symbol: (r.poc, r.val, r.vah) for r in market_profile.value_area(df, 1.0, "symbol").collect()}
    for s in "ABC":
        assert got[s] == brute_area({i: v for x, i, v in rows if x == s}, 0.7)


def test_volume_is_shared_by_steps(spark):
    df = spark.createDataFrame([("A", 10.0, 12.0, 9.0)], "symbol string, low double, high double, volume double")
    assert sorted((r.step, r.v) for r in market_profile.levels(df, 1.0, "symbol").collect()) == [(10, 3.0), (11, 3.0), (12, 3.0)]


def test_sessions(spark):
    t = dt.datetime(2026, 8, 5, 9)
    rows = [("A", t + dt.timedelta(hours=i), 10.0, h, l, 11.0, 1.0) for i, (h, l) in enumerate([(12.0, 10.0), (13.0, 11.0), (17.0, 12.0)])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    r = market_profile.sessions(df, 1.0).first()
    assert (r.ib_high, r.ib_low, r.extension_up, r.extension_down, r.day_type, r.single_prints) == (13, 10, 4, 0, "trend", 5)


def test_prices_and_sizes(spark):
    row = spark.range(1).select(
        trades.stop_gap_price(F.lit("stop"), F.lit("BUY"), F.lit(100.0), F.lit(99.0), F.lit(101.0)).alias("stop"),
        execution.order_price(F.lit("BUY"), F.lit(100.0), F.lit(99.5), 1.0).alias("limit"),
        execution.position_size(F.lit(10_000.0), F.lit(2.0), F.lit(100.0)).alias("size"),
        execution.position_size(F.lit(10_000.0), F.lit(0.0), F.lit(1e9)).alias("none"),
    ).first()
    assert (row.stop, row.limit, row.size, row.none) == (99.0, 99.5, 50, 0)


def test_folds_do_not_leak(spark):
    rows = execution.folds(spark, 400, train=100, test=50).collect()
    assert rows and all(r.train_to < r.test_from <= r.test_to <= 400 for r in rows)


def test_synthetic_ticks_add_up(spark):
    df = spark.createDataFrame([("A", dt.datetime(2026, 8, 5), 10.0, 12.0, 9.0, 11.0, 7.0)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    rows = execution.synthetic_ticks(df).orderBy("n").collect()
    assert [r.price for r in rows] == [10, 9, 12, 11] and sum(r.volume for r in rows) == 7


def test_whole_profile_of_a_day(spark):
    # three blocks of an hour: 10..13, 12..14, then 13..20
    rows = [("A", dt.datetime(2026, 8, 5, 9 + i), 12.0, float(h), float(l), 13.0, 10.0) for i, (h, l) in enumerate([(13, 10), (14, 12), (20, 13)])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    r = market_profile.profiles(df, 1.0, 1, "day", 60, tail_edges=2).first()
    assert [(x.price, x["count"], x.letters) for x in r.levels] == [(float(p), 1, "C") for p in range(20, 14, -1)] + [(14.0, 2, "BC"), (13.0, 3, "ABC"), (12.0, 2, "AB"), (11.0, 1, "A"), (10.0, 1, "A")]
    # the area starts at 13 and grows by the fuller neighbour, upwards where they are equal, until it holds 0.7 of 15
    assert (r.poc, r.vah, r.val) == (13.0, 18.0, 12.0)
    assert (r.ib_high, r.ib_low, r.extension_up, r.extension_down, r.day_type) == (14.0, 10.0, 6.0, 0.0, "trend")
    assert r.selling_tail == [20.0, 15.0] and r.buying_tail == [11.0, 10.0] and (r.poor_high, r.poor_low, r.periods) == (False, False, 3)
    assert [(d.period, d.poc, d.vah, d.val) for d in r.developing][0] == (0, 13.0, 13.0, 11.0) and r.total_volume == 30.0
    assert r.single_prints == [19.0, 18.0, 17.0, 16.0, 15.0, 11.0] and r.open_type == "drive"


def test_sessions_merge_and_letters_start_again(spark):
    rows = [("A", dt.datetime(2026, 8, 3) + dt.timedelta(days=d, hours=10), 10.0, 11.0, 9.0, 10.0, 1.0) for d in (0, 1, 3, 7, 30)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    count = lambda **k: market_profile.profiles(df, 1.0, **k).count()
    assert (count(), count(session="week"), count(session="month"), count(session="composite"), count(composite_sessions=2)) == (5, 3, 2, 1, 3)
    assert [market_profile.letter(i) for i in (0, 25, 26, 51, 52)] == ["A", "Z", "a", "z", "A"]


def test_footprints_follow_the_middle_of_the_quote(spark):
    rows = [("A", 1, 10.0, 9.0, 10.5, 5.0), ("A", 2, 10.0, 9.5, 10.5, 7.0), ("A", 3, 10.0, 10.0, 11.0, 2.0), ("A", 4, 10.0, None, None, 9.0), ("A", 5, 10.0, 9.0, 10.0, None)]
    q = spark.createDataFrame([(s, dt.datetime(2026, 8, 5), n, *r) for s, n, *r in rows], "symbol string, ts timestamp, n long, ltp double, bid double, ask double, volume double")
    r = market_profile.quote_footprint(q, "symbol").first()
    assert (r.price, r.bought, r.sold, r.delta) == (10.0, 5.0, 2.0, 3.0)
    assert [x.cvd for x in market_profile.cumulative_delta(q, "symbol").orderBy("n").collect()] == [5, 5, 3, 3, 3]
