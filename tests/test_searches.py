"""Searches over plain arrays against one-by-one rules, and inputs that are worked out once."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlespan.operators import indicators as I
from candlespan.operators import patterns as P
from candlespan.operators.kernels import (
    FIELDS, FLAG_NOTES, YEAR_NOTES, Columns, Smooth, _extremes, box_kernel, cup_kernel, flag_kernel, lagged, only, smoothing, year_high_kernel,
)
from candlespan.operators.panel import panel, series
from candlespan.operators.stage import peaks, slope_kernel, with_stage
from candlespan.plans import queries as Q
from candlespan.plans.scan import analysed
from candlespan.sources.walk import walk_bars


def bars(seed: int, n: int = 320, holes: tuple = ()) -> pd.DataFrame:
    r = np.random.default_rng(seed)
    x = 100 * np.exp(np.cumsum(r.normal(0, 0.02, n)))
    f = pd.DataFrame({"bar_no": np.arange(1, n + 1), "close": x, "high": x * 1.01, "low": x * 0.99, "volume": r.integers(1, 5, n)})
    for c in holes:
        f[c] = f[c].astype(float).mask(r.random(n) < 0.02)
    return f


HOLES = [(), ("high", "close"), ("low",), ("volume",)]


def same(kernel, prefix: str, names: tuple, f: pd.DataFrame, rule) -> int:
    got, found = kernel.fn(f), 0
    for t in range(len(f)):
        want, row = rule(f, t), [got[f"{prefix}_{n}"][t] for n in names]
        if want is None:
            assert np.isnan(row[0]), t
        else:
            np.testing.assert_allclose(row[: len(want)], want, rtol=1e-12)
            found += 1
    return found


def year_high(f, t):
    if t < 251:
        return None
    top, past = f.high[t - 251 : t + 1].max(), f[t - 125 : t + 1]
    gap = (top - f.close[t]) / top
    if not gap <= 0.02:
        return None
    hits = (past.high >= top * (1 - 0.015)).to_numpy()
    at = int(hits.argmax())
    low = past.low[at:].min()
    return min(100, 50 + max(hits.sum() - 1, 0) * 5), top, f.bar_no[t] - 125 + at, top - low, hits.sum(), gap, low


def flag(f, t):
    a = f[max(0, t - 59) : t + 1]
    n, c, v = len(a), a.close.to_numpy(), a.volume.to_numpy(float)
    for fl in range(5, 16) if t >= 14 else ():
        if n - fl < 5:
            continue
        top, low = a.high[n - fl :].max(), a.low[n - fl :].min()
        if not (top > 0 and (top - low) / top <= 0.12 and -0.10 <= (c[-1] - c[n - fl]) / c[n - fl] <= 0):
            continue
        for pl in range(5, min(19, n - fl) + 1):
            b = n - fl - pl
            move, mine = (c[n - fl - 1] - c[b]) / c[b], v[b : b + pl].sum() / pl
            if move >= 0.15 and mine > (v[:b].sum() / b if b else mine):
                wide = (top - low) / top
                return min(100, 60 + min(20, (move - 0.15) / 0.15 * 20) + 10 * (wide < 0.06)), top, f.bar_no[t] - fl - pl + 1, c[n - fl - 1] - c[b], move, pl, fl


def box(f, t):
    for length in range(min(80, t + 1), 19, -1):
        high, low = (f[c].to_numpy()[t - length + 1 : t + 1] for c in ("high", "low"))
        top, floor = high.max(), low.min()
        if not (floor > 0 and high[0] >= top * 0.99 and (top - floor) / top <= 0.15):
            continue
        hits = np.flatnonzero(high >= top * 0.99)
        if len(hits) >= 3 and hits[-1] >= 0.5 * (length - 1):
            wide = (top - floor) / top
            bonus = 10 if wide < 0.08 else 5 if wide < 0.12 else 0
            return min(100, 60 + min(20, (len(hits) - 3) * 5) + bonus), top, t - length + 2, top - floor, floor, len(hits), length, wide


def cup(f, t):
    high, low = f.high.to_numpy(), f.low.to_numpy()
    a0 = max(0, t - 179)
    for h in range(5, 26) if t >= 39 else ():
        top, floor = high[t - h + 1 : t + 1].max(), low[t - h + 1 : t + 1].min()
        size = t + 1 - a0 - h
        if size < 20 or not 0.04 <= (top - floor) / top <= 0.20:
            continue
        mid = a0 + size // 2
        left, right = a0 + int(high[a0:mid].argmax()), mid + int(high[mid : t - h + 1].argmax())
        ll, rl, bottom = high[left], high[right], low[left : right + 1].min()
        d = (ll - bottom) / ll
        if 20 <= right - left <= 130 and abs(rl - ll) / ll <= 0.05 and top <= rl * 1.01 and 0.12 <= d <= 0.35 and floor >= (rl + bottom) / 2:
            return min(100, max(60, 60 + 10 * (1 - abs(rl - ll) / ll / 0.05) + 10 * ((top - floor) / top < 0.10))), rl, left + 1, rl - bottom, ll, bottom, d


@pytest.mark.parametrize("holes", HOLES)
def test_year_high_and_flag(holes):
    assert sum(same(year_high_kernel(), "year", FIELDS + YEAR_NOTES, bars(s, holes=holes), year_high) for s in range(12))
    assert sum(same(flag_kernel(), "flag", FIELDS + FLAG_NOTES, bars(s, holes=holes), flag) for s in range(8))


def test_box_and_cup():
    names = FIELDS + ("floor", "touches", "window_len", "relative_width")
    assert sum(same(box_kernel(), "box", names, bars(s), box) for s in range(4))
    assert sum(same(cup_kernel(), "cup", FIELDS + ("left_lip", "bottom", "cup_depth"), bars(s), cup) for s in range(10))


def test_first_highest_of_stretches():
    v = np.random.default_rng(0).integers(0, 4, 90).astype(float)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(90), np.arange(1, 91)))
    a, b = a[(a < b) & (b - a <= 40)], b[(a < b) & (b - a <= 40)]
    assert _extremes(v, 40)(a, b).tolist() == [i + int(v[i:j].argmax()) for i, j in zip(a, b)]


def test_bars_come_from_one_pass_over_the_lines(spark, tmp_path):
    """Narrow readers too: a half of the plan that needed other columns was a second pass."""
    day = [dt.datetime(1995 + k // 5, 1 + k % 5, 3) for k in range(20)]
    rows = [(k, 1, k % 3, 1, float(1 + k * 7 % 50), day[k]) for k in range(20)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp")
    lines.write.parquet(f"{tmp_path}/l")
    narrow = walk_bars(spark.read.parquet(f"{tmp_path}/l")).select("symbol", "date", "close", "bar_no", "n_bars")
    plan = narrow._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1
    want = {}
    for k, _, s, _, q, d in rows:
        past = want.setdefault(str(s), [])
        past.append((d.date(), (past[-1][1] if past else 1500.0) + q - 25.5, len(past) + 1))
    got = {}
    for r in narrow.orderBy("symbol", "date").collect():
        got.setdefault(r.symbol, []).append((r.date, r.close, r.bar_no))
        assert r.n_bars == len(want[r.symbol])
    assert got == want


def test_candidates_are_worked_out_once(spark, monkeypatch):
    calls = []
    rows = spark.createDataFrame([("1", dt.date(1995, 1, 2), 70.0, 9, 100.0), ("2", dt.date(1995, 1, 2), 60.0, 9, 90.0)],
                                 "symbol string, date date, score double, bar_no long, close double")
    monkeypatch.setattr(Q.Tables, "signals", lambda t: calls.append(1) or rows)
    monkeypatch.setattr(Q.Tables, "universe", lambda t: spark.createDataFrame([("1", "ASIA"), ("2", "ASIA")], "symbol string, sector string"))
    got = Q._cohorts(Q.Tables(spark, "unused"))
    # two positions of the sector are held already, so one slot is left
    assert [tuple(r) for r in got.collect()] == [(dt.date(1995, 1, 2), "1")]
    assert len(calls) == 1


def test_the_scan_exchanges_its_panel_once(spark):
    plans = {}
    rows = pd.concat([bars(k, 260).assign(symbol=f"S{k}", date=[dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(260)]) for k in (1, 2)])
    table = spark.createDataFrame(rows.assign(open=rows.close, n_bars=260), "bar_no long, close double, high double, low double, volume long, symbol string, date date, open double, n_bars long")
    for name, made in (("scan", analysed(table, extra_kernels=[lagged(("_average", "vol_avg_20", 1))])), ("stage", with_stage(I.with_standard(peaks(panel(table)), [slope_kernel()])))):
        plans[name] = made._jdf.queryExecution().executedPlan().toString()
        assert plans[name].count("Exchange hashpartitioning") == 1, name
    # the same as windows behind the map give
    plain = {(r.symbol, r.bar_no): r for r in with_stage(I.with_standard(panel(table))).withColumn("before", F.lag("vol_avg_20").over(series())).collect()}
    got = analysed(table, extra_kernels=[lagged(("_average", "vol_avg_20", 1))]).collect()
    assert len(got) == 520 and {r.stage for r in got} > {"UNKNOWN"}
    for r in got:
        want = plain[r.symbol, r.bar_no]
        assert (r.stage, r._average) == (want.stage, want.before)
    full = {(r.symbol, r.bar_no): r for r in P.with_patterns(panel(table)).withColumn("best", P.best_pattern()).select("symbol", "bar_no", "best").collect()}
    assert all(r.best == full[r.symbol, r.bar_no].best for r in got) and any(r.best for r in got)


def test_columns_stand_for_a_frame():
    f = bars(3, 60)
    c = Columns({n: f[n].to_numpy() for n in f})
    copy = c.copy()
    copy["more"] = f["close"] * 2
    assert len(c) == 60 and copy["more"].equals(f["close"] * 2) and "more" not in c.made and c["high"].equals(f["high"])
    k = only(year_high_kernel(), ["year_level"])
    assert list(k.fn(c)) == ["year_level"] == [n for n, _ in k.outputs]
    assert [np.isnan(v[:3]).all() for v in lagged(("a", "close", 3), ("b", "close", 99)).fn(c).values()] == [True, True]
    np.testing.assert_array_equal(lagged(("a", "close", 3)).fn(c)["a"][3:], f["close"].to_numpy()[:-3])


def test_a_series_may_start_at_a_later_number():
    f = bars(4, 40).assign(seg=0, own=True)
    f["bar_no"] += 1  # the first one had no date
    k = smoothing([Smooth("m", "close", 0.1)])
    np.testing.assert_allclose(k.fn(f)["m"], f.close.ewm(alpha=0.1, adjust=False).mean())
    with pytest.raises(ValueError):
        k.fn(f.assign(seg=1))
