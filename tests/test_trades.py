import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlespan.config import Costs, Settings
from candlespan.functions import scoring as M
from candlespan.functions import session_clock as C
from candlespan.functions import sizing as Z
from candlespan.operators import confirm as K
from candlespan.operators import maintain as T
from candlespan.operators import quality as Q
from candlespan.operators import reports as A
from candlespan.operators import trades as TR
from candlespan.operators.calendar import calendar
from candlespan.operators.panel import panel
from tests.conftest import bars, frame

FREE = Settings(costs=Costs(enabled=False))


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).collect()[0]


def path(spark, *ohlc):
    """A signal at close 100 with level 100 and ATR 2, followed by the given bars; no costs."""
    rows = [(100.0, 100.0, 100.0, 100.0), *ohlc]
    o, h, l, c = map(list, zip(*rows))
    p = TR.with_future(panel(bars(spark, frame(c, h, l, o)))).filter("bar_no = 1").withColumns({
        "level": F.lit(100.0), "atr_14": F.lit(2.0), "base_height": F.lit(10.0)})
    return TR.label_outcomes(p, FREE).collect()


def test_labels(spark):
    flat = (100.0, 101.0, 99.0, 100.0)
    r = path(spark, (99.0, 100.0, 96.0, 98.0), flat)[0]
    assert (r.stop_loss, r.state, r.exit_price, r.pnl_r) == (97, "STOPPED_OUT", 97, -1)
    r = path(spark, (101.0, 111.0, 100.0, 110.0))[0]
    assert (r.state, r.exit_price) == ("TARGET_HIT", 110) and r.pnl_r == pytest.approx(10 / 3)
    r = path(spark, (101.0, 106.5, 100.5, 106.0), (103.0, 104.0, 99.0, 99.5))[0]
    assert (r.state, r.exit_price, r.pnl_r) == ("STOPPED_OUT", 100, 0)
    r = path(spark, (95.0, 96.0, 94.0, 95.0))[0]
    assert r.exit_price == 95 and r.pnl_r < -1
    r = path(spark, *[flat] * 40)[0]
    assert (r.state, r.bars_held) == ("TIME_EXIT", 30)
    assert path(spark) == []


def test_replay_choice_equals_the_sequential_one(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for s in "abcde":
        spans = {e: e + rng.randint(1, 30) for e in rng.sample(range(1, 400), 120)}
        rows += [(s, e, x) for e, x in spans.items()]
        free = 0
        for e in sorted(spans):
            if e > free:
                want.add((s, e))
                free = spans[e]
    df = spark.createDataFrame(rows, "symbol string, entry_no long, exit_no long")
    assert {(r.symbol, r.entry_no) for r in TR.non_overlapping(df).collect()} == want
    for block in (1, 4, 16):
        assert {(r.symbol, r.entry_no) for r in TR.non_overlapping(df, block).collect()} == want


def one_by_one(entries, exits):
    taken, until = [], -1
    for e, x in zip(entries, exits):
        if e > until:
            taken.append(e)
            until = x
    return taken


def test_a_run_of_200000_overlapping_signals(spark):
    """Every bar of one symbol has a signal that overlaps the next; others have gaps of many blocks, one trade, or none that follows."""
    rng = np.random.default_rng(11)
    long_run = np.arange(1, 200_001)
    gaps = np.sort(rng.choice(10_000_000, 3_000, replace=False))
    frames = {"RUN": (long_run, long_run + rng.integers(1, 31, 200_000)), "GAP": (gaps, gaps + rng.integers(1, 20_000, 3_000)), "ONE": (np.array([5]), np.array([9]))}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"symbol": k, "entry_no": e, "exit_no": x}) for k, (e, x) in frames.items()]))
    got = TR.non_overlapping(df).toPandas()
    assert list(got.columns) == ["symbol", "entry_no", "exit_no"]
    for symbol, (entries, exits) in frames.items():
        assert sorted(got[got.symbol == symbol].entry_no) == one_by_one(entries, exits)


def test_no_trades(spark):
    df = spark.createDataFrame([], "symbol string, entry_no long, exit_no long")
    assert TR.non_overlapping(df).collect() == []


def _trade(state="ENTERED", entry="2026-01-01"):
    return [("S", 1, state, dt.date.fromisoformat(entry), 220.0, 204.0, 245.0, 250.0, 25)]


TRADE = "symbol string, id long, state string, entry_date date, entry_price double, stop_loss double, target_1 double, target_2 double, shares long"


@pytest.mark.parametrize("state, day, ohlc, want, price", [
    ("ENTERED", "2026-01-02", (190.0, 195.0, 185.0, 190.0), "STOPPED_OUT", 190.0),
    ("ENTERED", "2026-01-02", (219.0, 221.0, 200.0, 210.0), "STOPPED_OUT", 204.0),
    ("ENTERED", "2026-01-02", (230.0, 251.0, 229.0, 250.0), "TARGET_HIT", 250.0),
    ("ENTERED", "2026-01-02", (230.0, 246.0, 229.0, 240.0), "TARGET_1_HIT", None),
    ("TARGET_1_HIT", "2026-01-03", (225.0, 226.0, 219.0, 221.0), "STOPPED_OUT", 220.0),
    ("ENTERED", "2026-01-01", (190.0, 260.0, 185.0, 190.0), "ENTERED", None),
    ("ENTERED", "2026-01-31", (222.0, 226.0, 219.0, 221.0), "TIME_EXIT", 221.0),
    ("STOPPED_OUT", "2026-01-02", (190.0, 195.0, 185.0, 190.0), "STOPPED_OUT", None),
])
def test_settlement(spark, state, day, ohlc, want, price):
    t = spark.createDataFrame(_trade(state), TRADE)
    bar = spark.createDataFrame([("S", dt.date.fromisoformat(day), *ohlc)], "symbol string, date date, open double, high double, low double, close double")
    r = TR.settle(t, bar).collect()[0]
    assert (r.new_state, r.exit_price) == (want, price)


def test_progress_and_excursions(spark):
    t = spark.createDataFrame([("S", 1, dt.date(2020, 1, 1), None, 100.0, 90.0)], "symbol string, id long, entry_date date, exit_date date, entry_price double, stop_loss double")
    b = bars(spark, frame([101.0, 104.0, 101.0], high=[150, 130, 120], low=[50, 99, 95]))
    r = TR.daily_progress(t, b).collect()[0]
    assert (r.days_in_trade, r.daily_moves) == ("D2", "D1:4.0%,D2:-2.9%")
    e = TR.excursions(t, b).collect()[0]
    assert (e.max_favorable, e.max_adverse) == (3.0, -0.5)


def test_costs_and_sizes(spark):
    r = one(spark, **Z.settlement(F.lit(220.0), F.lit(230.0), F.lit(25.0), F.lit(204.0)))
    assert r.gross_pnl_inr == 250 and 0.002 < r.costs_inr / (25 * 450) < 0.0045
    s = one(spark, a=Z.position_size(F.lit(100.0), F.lit(99.9)), b=Z.position_size(F.lit(100.0), F.lit(100.0)), c=Z.position_size(F.lit(100.0), F.lit(80.0)))
    assert (s.a, s.b, s.c) == (625, 0, 250)


def test_allocation_equals_the_greedy_rule(spark):
    rng = random.Random(3)
    cands, occ, want = [], [], {}
    for day in range(60):
        d = dt.date(2020, 1, 1) + dt.timedelta(days=day)
        sectors = ["A", "B", "C"]
        held = {s: rng.randint(0, 2) for s in sectors}
        occ += [(d, s, n) for s, n in held.items()]
        rows = [(d, f"s{i:02d}", float(rng.randint(60, 70)), rng.choice(sectors)) for i in range(rng.randint(1, 25))]
        cands += rows
        total = sum(held.values())
        for c in sorted(rows, key=lambda r: (-r[2], r[1])):
            if total >= 8:
                want[c[:2]] = "position_limit"
            elif held[c[3]] >= 3:
                want[c[:2]] = "sector_limit"
            else:
                want[c[:2]] = "taken"
                held[c[3]] += 1
                total += 1
    got = K.allocate(spark.createDataFrame(cands, "date date, symbol string, score double, sector string"),
                     spark.createDataFrame(occ, "date date, sector string, n_open long"))
    assert {(r.date, r.symbol): r.reason for r in got.collect()} == want


def _settled(spark):
    rows = [("a", "S", 65.0, 2.0, 200.0, 10), ("a", "T", 72.0, -1.0, -100.0, 4), ("b", "S", 85.0, 1.0, 100.0, 6), (None, "U", 50.0, -1.0, -100.0, 4), ("b", "S", 90.0, None, None, None)]
    return spark.createDataFrame(rows, "pattern string, symbol string, score double, pnl_r double, pnl_inr double, days_held int").withColumns(
        {"costs_inr": F.lit(1.0), "gross_pnl_inr": F.lit(None).cast("double")})


def test_digest_and_bands(spark):
    d = {r.pattern or r.scope: r for r in A.digest(_settled(spark)).collect()}
    o = d["overall"]
    assert (o.n, o.wins, o.win_rate, o.avg_r, o.profit_factor, o.gross_inr) == (4, 2, 50.0, 0.25, 1.5, 104.0)
    assert set(d) == {"overall", "a", "b", "unknown"} and d["b"].profit_factor == float("inf")
    bands = {r.band: r.n for r in A.by_score_band(_settled(spark)).collect()}
    assert bands == {"60-69": 1, "70-79": 1, "80-89": 1, "90-100": 0}
    empty = A.overall(_settled(spark).filter("false")).collect()[0]
    assert (empty.n, empty.avg_r, empty.profit_factor) == (0, 0.0, None)


def test_rebasing(spark):
    old = frame(np.full(20, 1000.0), start=dt.date(2026, 1, 1))
    half = frame(np.full(10, 500.0), start=dt.date(2026, 1, 16), volume=200_000)
    got = T.upsert_prices(bars(spark, old), bars(spark, half)).toPandas()
    assert len(got) == 25 and set(got.close) == {500.0} and set(got.volume) == {200_000}
    div = frame(np.full(10, 990.0), start=dt.date(2026, 1, 16))
    got = T.upsert_prices(bars(spark, old), bars(spark, div)).toPandas()
    assert set(got.close) == {990.0} and set(got.volume) == {100_000}
    lone = frame(np.full(1, 500.0), start=dt.date(2026, 1, 20))
    assert T.adjustment_factors(bars(spark, old), bars(spark, lone)).count() == 0
    t = spark.createDataFrame(_trade() + _trade("STOPPED_OUT"), TRADE)
    f = spark.createDataFrame([("S", 0.5)], "symbol string, price_factor double")
    rows = {r.state: (r.entry_price, r.stop_loss, r.shares) for r in T.rebase_trades(t, f).collect()}
    assert rows == {"ENTERED": (110.0, 102.0, 50), "STOPPED_OUT": (220.0, 204.0, 25)}


def test_discontinuity_and_quality(spark):
    c = [100.0, 100.0, 60.0, 60.0, 36.0, 50.5]
    r = Q.discontinuities(panel(bars(spark, frame(c)))).collect()[0]
    assert r.date == dt.date(2020, 1, 6) and r.move == pytest.approx(50.5 / 36 - 1)
    q = one(spark, f=Q.quality(F.lit(1.0), F.lit(None).cast("double"), F.lit(10), F.lit(40.0)))
    assert q.f == ["adv_below_floor", "too_recent_listing", "high_promoter_pledge"]


def test_calendar_and_blackout(spark):
    hol = spark.createDataFrame([(dt.date(2026, 1, 26),)], "date date")
    span = spark.createDataFrame([(dt.date(2026, 1, 1), dt.date(2026, 6, 30))], "lo date, hi date")
    cal = calendar(span, hol)
    c = {r.date: r for r in cal.collect()}
    assert not c[dt.date(2026, 1, 26)].trading and c[dt.date(2026, 1, 27)].prev_trading == dt.date(2026, 1, 23)
    ev = spark.createDataFrame([("S", dt.date(2026, 2, 20))], "symbol string, date date")
    days = spark.createDataFrame([("S", dt.date(2026, 2, d)) for d in (11, 12, 13, 17, 20, 23)], "symbol string, date date")
    got = {r.date.day: r.blackout for r in Q.blackout(days, ev, cal).collect()}
    assert got == {11: False, 12: False, 13: True, 17: True, 20: True, 23: False}
    april = Q.blackout(spark.createDataFrame([("S", dt.date(2026, 4, 1))], "symbol string, date date"),
                       spark.createDataFrame([("S", dt.date(2026, 4, 9))], "symbol string, date date"), cal)
    assert april.collect()[0].blackout


def test_score_curves(spark):
    v = one(spark, **{f"v{i}": M.volume_points(F.lit(x)) for i, x in enumerate((0.0, 1.5, 3.0, 9.0))})
    assert tuple(v) == (0, 7.5, 15, 15)
    e = one(spark, **{f"e{i}": M.extension_penalty(F.lit(x)) for i, x in enumerate((2.0, 5.0, 8.0, 20.0))})
    assert tuple(e) == (0, 5, 10, 10)
    s = one(spark, a=M.classify_sector(F.lit("Private Bank")), b=M.classify_sector(F.lit("it")), c=M.classify_sector(F.lit("Textiles")))
    assert tuple(s) == ("BANK", "IT", None)
    f = one(spark, a=C.volume_fraction(F.lit(345)), b=C.volume_fraction(F.lit(400)), c=C.projected_volume(F.lit(851), F.lit(0.851)))
    assert f.a == pytest.approx(0.851) and f.b == 1.0 and f.c == pytest.approx(1000)


@pytest.mark.parametrize("o, h, l, c, hit", [(100.5, 103, 100.2, 102.5, True), (100.5, 103, 99.5, 102.5, False), (103, 103.5, 100.2, 100.4, False)])
def test_retest(spark, o, h, l, c, hit):
    r = one(spark, open=F.lit(float(o)), high=F.lit(float(h)), low=F.lit(float(l)), close=F.lit(float(c)))
    df = spark.createDataFrame([tuple(r)], "open double, high double, low double, close double")
    assert df.select(K.retest(F.lit(100.0)).alias("x")).collect()[0].x == hit


def test_bars_of_a_long_trade_are_not_cut(spark):
    """A trade held 196 days keeps its late high, an open one runs to the newest bar or to the date asked for."""
    close = np.full(250, 100.0)
    high = np.full(250, 101.0)
    high[190], high[240] = 150.0, 170.0
    b = bars(spark, frame(close, high=high))
    start = dt.date(2020, 1, 1)
    shape = "symbol string, id long, entry_date date, exit_date date, entry_price double, stop_loss double"
    t = spark.createDataFrame([("S", 1, start, start + dt.timedelta(days=196), 100.0, 90.0), ("S", 2, start, None, 100.0, 90.0)], shape)
    got = {r.id: r.max_favorable for r in TR.excursions(t, b).collect()}
    assert got == {1: 5.0, 2: 7.0}
    early = {r.id: r.max_favorable for r in TR.excursions(t, b, F.lit(start + dt.timedelta(days=100))).collect()}
    assert early == {1: 5.0, 2: pytest.approx(0.1)}
    assert {r.id: r.days_in_trade for r in TR.daily_progress(t, b).collect()} == {1: "D196", 2: "D249"}


def test_correlation_of_a_large_cohort(spark):
    from candlespan.operators.crosssection import mean_abs_correlation

    rng = np.random.default_rng(0)
    rets = rng.normal(size=(80, 11))
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(80)]
    rows = [(f"S{j}", days[i], i + 1, float(rets[i, j])) for i in range(80) for j in range(11)]
    r = spark.createDataFrame(rows, "symbol string, date date, bar_no int, ret_1 double")
    cohort = spark.createDataFrame([(days[79], f"S{j}") for j in range(11)], "date date, symbol string")
    want = np.corrcoef(rets[-63:].T)[np.triu_indices(11, 1)]
    assert np.isclose(mean_abs_correlation(r, cohort).collect()[0].avg_correlation, np.abs(want).mean())
