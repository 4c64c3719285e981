"""The daily runs as one plan against a walk through the days, one run after another."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from candlespan.config import Risk, Settings
from candlespan.operators.confirm import near_level
from candlespan.operators.panel import own_rows, panel
from candlespan.operators.quality import bad_move
from candlespan.operators.trades import bars_after, with_future
from candlespan.plans import days as D

START = dt.date(2021, 1, 4)
COLUMNS = ("symbol string, date date, open double, high double, low double, close double, volume_ratio double, continuous boolean, atr_14 double, "
           "level double, base_height double, pattern string, score double, sector string, monday_open boolean, risk_multiplier double")
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def market(seed, symbols=14, days=110):
    rng, rows = random.Random(seed), []
    for k in range(symbols):
        price, sector, top = 100.0, rng.choice(["A", "B", "C", None]), 100.0
        for day in range(days):
            date = START + dt.timedelta(days=day)
            if date.weekday() > 4 or rng.random() < 0.06:
                continue
            o = round(price * rng.uniform(0.985, 1.015), 2)
            c = round(o * rng.uniform(0.97, 1.032), 2)
            h, l = round(max(o, c) * rng.uniform(1, 1.012), 2), round(min(o, c) * rng.uniform(0.985, 1), 2)
            if rng.random() < 0.15:
                top = round(price * rng.uniform(0.99, 1.01), 2)
            level = top if rng.random() < 0.8 else None
            rows.append((f"S{k:02d}", date, o, h, l, c, rng.choice([1.0, 1.6, 2.0, 2.5, None]), rng.random() < 0.97, 2.0, level, 12.0 if level else None,
                         "box", float(rng.randrange(55, 75)), sector, rng.random() < 0.9, rng.choice([1.0, 0.5, None])))
            price = c
    return rows


def walked(rows, risk, window=D.PULLBACK_DAYS):
    """Tables handed from run to run and day to day; no row of a later day is looked at."""
    bars, number = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        number[r[0]] = number.get(r[0], 0) + 1
        bars.setdefault(r[1], {})[r[0]] = {**dict(zip(NAMES, r)), "no": number[r[0]]}
    trades, listed = [], {}

    def room(sector):
        live = [t for t in trades if t["state"] in ("ENTERED", "TARGET_1_HIT")]
        inside = sum(t["sector"] == sector for t in live)
        ok = (not risk.max_concurrent_positions or len(live) < risk.max_concurrent_positions) and (not risk.max_positions_per_sector or inside < risk.max_positions_per_sector)
        return (len(live), inside) if ok else None

    def enter(bar, kind, score, level, height, since, full):
        friday = bar["date"].weekday() == 4
        stop = level - (1.5 if not friday else 2.5 if bar["monday_open"] else 3.5) * bar["atr_14"]
        per = abs(bar["close"] - stop)
        scale = 1.0 if bar["risk_multiplier"] is None else bar["risk_multiplier"]
        shares = 0 if not per else min(int(risk.capital * (risk.risk_per_trade_pct * scale / 100) // per), int(risk.capital / max(1, risk.max_concurrent_positions) // bar["close"]))
        trades.append({"date": bar["date"], "symbol": bar["symbol"], "kind": kind, "score": score, "sector": bar["sector"] or "unknown", "level": level, "since": since, "entry": bar["close"],
                       "stop": stop, "t1": bar["close"] + 2 * per, "t2": bar["close"] + height, "shares": shares, "state": "ENTERED", "exit": None, "price": None, "full": full})

    for date in sorted(bars):
        today = bars[date]
        hits = [b for b in today.values() if b["continuous"] and b["level"] and b["volume_ratio"] and b["close"] > b["level"] and b["volume_ratio"] >= 1.5 and b["score"] >= 60]
        for b in sorted(hits, key=lambda b: (-b["score"], b["symbol"])):
            full = room(b["sector"] or "unknown")
            if full:
                enter(b, "BREAKOUT", b["score"], b["level"], b["base_height"], date, full)
                listed[b["symbol"]] = (date, b["level"], b["score"])
        listed = {k: v for k, v in listed.items() if (date - v[0]).days <= window}
        for symbol in sorted(listed):
            since, level, score = listed[symbol]
            if any(t["kind"] == "PULLBACK_ENTRY" and t["symbol"] == symbol and abs(t["level"] - level) < 0.01 for t in trades):
                del listed[symbol]
                continue
            b = today.get(symbol)
            if not b or not b["continuous"] or b["no"] < 21:
                continue
            span, c, o, l = b["high"] - b["low"], b["close"], b["open"], b["low"]
            turned = min(o, c) - l > abs(c - o) or c > o
            strong = (span > 0 and (c - l) / span >= 0.5) or c - level >= level * 0.01
            if level <= l <= level * 1.01 and c > level and turned and strong:
                full = room(b["sector"] or "unknown")
                if full:
                    enter(b, "PULLBACK_ENTRY", score, level, max(0.0, c - level), since, full)
                    del listed[symbol]
        # end of day
        for t in trades:
            b, held = today.get(t["symbol"]), (date - t["date"]).days
            if t["exit"] or not b or not held:
                continue
            stop = max(t["entry"], t["stop"]) if t["state"] == "TARGET_1_HIT" else t["stop"]
            if b["low"] <= stop:
                t.update(state="STOPPED_OUT", price=min(stop, b["open"]), exit=date)
            elif b["high"] >= t["t2"]:
                t.update(state="TARGET_HIT", price=t["t2"], exit=date)
            elif t["state"] == "ENTERED" and b["high"] >= t["t1"]:
                t["state"] = "TARGET_1_HIT"
            elif held >= 30:
                t.update(state="TIME_EXIT", price=b["close"], exit=date)
        for symbol in list(listed):
            since, level, _ = listed[symbol]
            if symbol in today and 0 <= (date - since).days <= 3 and today[symbol]["close"] < level:
                del listed[symbol]
    return trades


def planned(spark, rows, settings):
    bars = spark.createDataFrame(rows, COLUMNS).repartition(7)
    return D.trading_days(own_rows(with_future(panel(bars), settings.paper.hold_max_days + 1)), settings).collect()


@pytest.mark.parametrize("seed, total, sector_cap", [(1, 8, 3), (2, 3, 1), (3, 5, 0), (4, 0, 0)])
def test_the_plan_equals_a_walk_through_the_days(spark, seed, total, sector_cap):
    rows, risk = market(seed), Risk(max_concurrent_positions=total, max_positions_per_sector=sector_cap)
    got, want = planned(spark, rows, Settings(risk=risk)), walked(rows, risk)
    show = lambda *v: tuple(round(x, 6) if isinstance(x, float) else x for x in v)
    a = sorted(show(r.date, r.symbol, r.alert_type, r.score, r.sector, r.breakout_level, r.since, r.entry_price, r.stop_loss, r.target_1, r.target_2, r.shares, r.state, str(r.exit_date), r.exit_price or 0.0, r.n_open, r.n_sector) for r in got)
    b = sorted(show(t["date"], t["symbol"], t["kind"], t["score"], t["sector"], t["level"], t["since"], t["entry"], t["stop"], t["t1"], t["t2"], t["shares"], t["state"], str(t["exit"]), t["price"] or 0.0, *t["full"]) for t in want)
    assert a == b
    states, kinds = {t["state"] for t in want}, {t["kind"] for t in want}
    # the smaller books are full of breakouts whenever a retest comes
    assert {"STOPPED_OUT", "TARGET_HIT"} <= states and ("PULLBACK_ENTRY" in kinds or 0 < total < 8) and len({r[1] for r in rows}) >= 60


def test_no_days(spark):
    assert planned(spark, [], Settings()) == []


def test_facts_and_bars_ahead_asked_for_the_few_give_the_same(spark):
    rows, settings = market(5), Settings(risk=Risk(max_concurrent_positions=3, max_positions_per_sector=1))
    numbered = own_rows(panel(spark.createDataFrame(rows, COLUMNS)))
    late = ("sector", "monday_open", "risk_multiplier")
    facts = spark.createDataFrame([(r[0], r[1], *r[-3:]) for r in rows], "symbol string, date date, sector string, monday_open boolean, risk_multiplier double")
    got = D.trading_days(numbered.drop(*late), settings, facts=lambda some: some.join(facts, ["symbol", "date"], "left"), bars=numbered)
    assert sorted(map(str, got.collect())) == sorted(map(str, planned(spark, rows, settings))) != []
    # rows with `ahead` never meet in an exchange of all bars
    assert "ahead" not in numbered.columns


def test_a_few_rows_get_the_bars_after_them(spark):
    bars = panel(spark.createDataFrame(market(6, 4, 90), COLUMNS))
    want = {(r.symbol, r.bar_no): r.ahead for r in own_rows(with_future(bars, 31)).collect()}
    some = own_rows(bars).filter("bar_no % 7 = 0 or bar_no = n_bars")
    got = bars_after(some.unionByName(some), own_rows(bars), 31).collect()
    assert len(got) > 30 and all(r.ahead == want[r.symbol, r.bar_no] for r in got) and any(not r.ahead for r in got)


def test_a_price_of_zero_ends_no_run(spark):
    close = [5.0, 0.0, 0.0, -4.0, 0.0, 3.0, 3.1]
    rows = [("Z", START + dt.timedelta(days=k), c, c, c, c) for k, c in enumerate(close)]
    p = panel(spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double"))
    moves = [r.bad for r in p.withColumn("bad", bad_move()).orderBy("bar_no").collect()]
    assert moves == [None, -1.0, None, float("-inf"), -1.0, float("inf"), None]
    assert p.filter(near_level(F.col("close"), F.col("low"), 2.0)).count() == 3
