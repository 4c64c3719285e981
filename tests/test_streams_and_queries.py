"""Streaming jobs against their batch definitions, and queries against their SQL on the smallest tables."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from candlespan.operators.maintain import prune
from candlespan.sources import walk as B
from candlespan.streaming import jobs as ST

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PICK = [
    "flagship_leaders", "s4_universe_csv", "s7_holidays_json", "s14_assign_ids", "f2_discontinuities", "f11_blackout", "a8_full_report",
    "a12_mean_correlation", "a14_portfolio_health", "w11_adx", "w16_stage", "w19_pivot_strength", "r4_slot_allocation", "p2_darvas_box",
    "p6_ascending_triangle", "p8_cup_and_handle", "p9_flag", "m7_rescore", "t1_rebase_prices", "x2_label_outcomes", "x4_stream_tracker",
    "x5_stream_bars", "x7_stream_confirm",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    clean = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(clean, key=lambda r: tuple((x is None, "" if x is None else str(x)) for x in r))


@pytest.mark.parametrize("name", PICK)
def test_query_equals_sql(spark, duck, name):
    got = E.queries()[name](spark, SMALL)
    cur = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(cols, cur.fetchall())


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_every_query_has_sql_or_is_known_to_have_none():
    assert set(E.queries()) - set(E.oracle_sql()) == {"pipeline"} & set(E.queries()) | {
        q for q in set(E.queries()) - set(E.oracle_sql()) if q.startswith("op")
    }


def test_later_batches_replace_earlier_ones(spark):
    """A tick that arrives in a later batch changes its bar; the newest version of the bar counts."""
    ev = B.table(spark, SMALL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    src, out = ST.scratch_dir(spark, "src"), ST.scratch_dir(spark, "out")
    ev.filter("event_id % 2 = 0").coalesce(1).write.mode("append").parquet(src)
    ev.filter("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)

    def save(batch, version):
        batch.withColumn("version", F.lit(version)).write.mode("append").parquet(out)

    ST._finish(ST.tick_bars(stream, late="400 days").writeStream.outputMode("update").foreachBatch(save), spark)
    got = ST._newest(spark, out, ["symbol", "ts"])
    want = B.event_bars(ev)
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_newest_resent_bar_wins_in_a_batch_and_over_batches(spark):
    day = dt.date(2020, 1, 1)
    shape = "symbol string, date date, close double, arrival long"
    table = spark.createDataFrame([("A", day, 1.0), ("B", day, 1.0)], "symbol string, date date, close double")
    feed = spark.createDataFrame([("A", day, 5.0, 3), ("A", day, 9.0, 1), ("A", day, 7.0, 3), ("B", day, 2.0, 2), ("B", day, 3.0, 9)], shape)
    for batches in (1, 3):
        got = {r.symbol: r.close for r in ST.stream_upsert(spark, table, feed.repartition(3), batches).collect()}
        assert got == {"A": 7.0, "B": 3.0}


def test_a_trade_is_tracked_over_several_batches(spark):
    """First target in one batch, the moved stop in the next; a mark outlives the end, so later bars do not start it anew."""
    start = dt.date(2020, 1, 1)
    bars = [("S", start + dt.timedelta(days=i), o, h, lo, c) for i, (o, h, lo, c) in enumerate(
        [(100, 101, 99, 100), (100, 103, 99, 102), (102, 111, 101, 110), (110, 112, 104, 105), (105, 106, 98, 99), (99, 100, 80, 85), (85, 200, 80, 190), (190, 300, 180, 250)]
    )]
    bars = spark.createDataFrame([(s, d, float(o), float(h), float(lo), float(c)) for s, d, o, h, lo, c in bars], "symbol string, date date, open double, high double, low double, close double")
    trades = spark.createDataFrame([("t", "S", start, 100.0, 90.0, 110.0, 130.0)], "id string, symbol string, entry_date date, entry_price double, stop_loss double, target_1 double, target_2 double")
    for batches in (1, 3):
        got = sorted((r.date, r.state, r.price) for r in ST.track_trades(spark, trades, bars, batches=batches).collect())
        assert got == [(start + dt.timedelta(days=2), "TARGET_1_HIT", 110.0), (start + dt.timedelta(days=4), "STOPPED_OUT", 100.0)]


def test_trades_are_moved_alike_in_one_batch_and_in_twelve(spark):
    rng = np.random.default_rng(2)
    start, shape = dt.date(2020, 1, 1), "symbol string, date date, open double, high double, low double, close double"
    bars, trades = [], []
    for s in "AB":
        close = 100 + np.cumsum(rng.normal(0, 0.8, 150))
        for i, c in enumerate(close):
            bars.append((s, start + dt.timedelta(days=i), float(c - 0.5), float(c + rng.uniform(0, 1)), float(c - rng.uniform(0, 1)), float(c)))
        trades += [(f"{s}{i}", s, start + dt.timedelta(days=i), float(close[i]), float(close[i] - 6), float(close[i] + 2), float(close[i] + (3 if i % 2 else 10))) for i in range(0, 149, 7)]
    trades.append(("lost", "C", start, 1.0, 0.5, 2.0, 3.0))
    b = spark.createDataFrame(bars, shape)
    t = spark.createDataFrame(trades, "id string, symbol string, entry_date date, entry_price double, stop_loss double, target_1 double, target_2 double")
    want = []
    for _, s, entered, entry, stop, one, two in trades:
        now = "ENTERED"
        for _, day, o, h, lo, c in sorted(x for x in bars if x[0] == s and x[1] > entered):
            if lo <= stop:
                now, price = "STOPPED_OUT", min(stop, o)
            elif h >= two:
                now, price = "TARGET_HIT", two
            elif now == "ENTERED" and h >= one:
                now, price, stop = "TARGET_1_HIT", one, entry
            elif (day - entered).days >= 30:
                now, price = "TIME_EXIT", c
            else:
                continue
            want.append((s, entered, now, day, price))
            if now != "TARGET_1_HIT":
                break
    assert len({w[2] for w in want}) == 4
    for batches in (1, 12):
        assert sorted(map(tuple, ST.track_trades(spark, t, b, batches=batches).collect())) == sorted(want)


def test_a_bar_that_event_time_has_not_passed_moves_no_trade(spark):
    """Without the row that lets event time pass the last day, that day's bar stays in state."""
    from candlespan.streaming.stateful import TradeTracker

    tracker, day = TradeTracker(30), 100
    trade, bar = (day, False, "t", 100.0, 90.0, 110.0, 130.0), (day + 1, True, "", 100.0, 100.0, 80.0, 85.0)
    out, held = tracker.passed(("S",), [trade], [], day)
    assert out == [] and held == [("t", day, "ENTERED", 90.0, 100.0, 110.0, 130.0)]
    out, held = tracker.passed(("S",), [bar], held, day + 1)
    assert out == [("t", "S", day, "STOPPED_OUT", day + 1, 90.0)] and held == []


def test_watchlist_stream_equals_the_batch_prune_on_every_day(spark):
    rng, start, life = random.Random(4), dt.date(2020, 1, 1), 20
    on = lambda d: start + dt.timedelta(days=d)
    adds, gone = [], []
    for s in "abc":
        adds += [(s, on(d), on(d - rng.choice([0, 0, 0, 2, 30])), float(d), 2.0) for d in sorted(rng.sample(range(150), 12))]
        gone += [(s, on(d)) for d in rng.sample(range(150), 8)]
    adds.append(("a", on(3), None, 1.0, 1.0))
    a = spark.createDataFrame(adds, "symbol string, date date, breakout_date date, breakout_level double, original_score double")
    g = spark.createDataFrame(gone, "symbol string, date date")
    logs = [sorted(map(tuple, ST.stream_watchlist(spark, a, g, life, n).collect())) for n in (1, 5)]
    assert logs[0] == logs[1] and {r[3] for r in logs[0]} == {"added", "removed", "expired"}
    log = spark.createDataFrame(logs[0], "symbol string, date date, turn int, change string, breakout_date date, breakout_level double, original_score double").cache()
    last = max(x[1] for x in [*adds, *gone])
    for day in (on(d) for d in range(0, 151, 10)):
        if day > last:
            break
        table = {}
        for row in sorted([(x[1], 0, x) for x in adds if x[2]] + [(x[1], 1, x) for x in gone], key=lambda r: r[:2]):
            if row[0] <= day:
                if row[1]:
                    entry = table.get(row[2][0])
                    if entry and entry[2] >= row[0] - dt.timedelta(days=life):
                        del table[row[2][0]]
                else:
                    table[row[2][0]] = row[2]
        listed = spark.createDataFrame([(x[0], *x[2:]) for x in table.values()], "symbol string, breakout_date date, breakout_level double, original_score double")
        want = prune(listed, "breakout_date", F.lit(day), life)
        assert sorted(map(tuple, ST.watchlist_on(log, day).collect())) == sorted(map(tuple, want.collect()))


def test_repeated_and_late_messages_are_dropped_and_counted(spark):
    """A copy inside the watermark is a repeat, one far behind it is late; another value of the same arrival is neither."""
    day, shape = dt.date(2020, 1, 1), "symbol string, date date, close double, arrival long, part long"
    first = [("A", day, 1.0, 10), ("A", day, 1.0, 10), ("B", day, 2.0, 10), ("C", day, 5.0, 11)]
    second = [("A", day, 1.0, 10), ("A", day, 3.0, 10), ("D", day, 1.0, 60), ("E", day, 1.0, 60)]
    third = [("B", day, 9.0, 12), ("C", day, 5.0, 11), ("C", day, 6.0, 70), ("D", day, 1.0, 60)]
    feed = spark.createDataFrame([(*r, k) for k, rows in enumerate((first, second, third)) for r in rows], shape)
    newest, counts = ST.resent_bars(spark, feed, 3, "20 days", by="part")
    assert {r.symbol: r.close for r in newest.collect()} == {"A": 3.0, "B": 2.0, "C": 6.0, "D": 1.0, "E": 1.0}
    assert tuple(counts.first()) == (12, 2, 3, 7)


def test_rows_of_a_batch_wait_as_one_value():
    from candlespan.streaming.stateful import TradeTracker

    class Listed:
        def __init__(self):
            self.values = []

        def exists(self):
            return bool(self.values)

        def get(self):
            return iter(self.values)

        def put(self, values):
            self.values = list(values)

        def clear(self):
            self.values = []

        def appendValue(self, value):
            self.values.append(value)

        def appendList(self, values):
            self.values += values

    class Handle:
        def __init__(self):
            self.timers = []

        def getListState(self, name, schema):
            return Listed()

        def registerTimer(self, at):
            self.timers.append(at)

    class Clock:
        def __init__(self, day):
            self.day = day

        def getCurrentWatermarkInMs(self):
            return self.day * 86_400_000

    work = TradeTracker(30)
    work.init(Handle())
    names = [c.split()[0] for c in work.ROW.split(", ")]
    rows = [(10, False, "t", 100.0, 90.0, 110.0, 130.0)] + [(d, True, "", 100.0 + d, 101.0 + d, 99.0 + d, 100.0 + d) for d in range(10, 40)]
    for some in (rows[:20], rows[20:]):
        assert list(work.handleInputRows(("S",), iter([pd.DataFrame(some, columns=names)]), None)) == []
    assert len(work.waiting.values) == 2  # one for each batch
    first = [r for f in work.handleExpiredTimer(("S",), Clock(12), None) for r in f["state"]]
    assert first == ["TARGET_1_HIT"] and len(work.waiting.values) == 1 and len(work.held.values) == 1
    last = [(r.state, r.price) for f in work.handleExpiredTimer(("S",), Clock(39), None) for r in f.itertuples()]
    assert last == [("TARGET_HIT", 130.0)] and not work.waiting.values and not work.held.values
