import numpy as np
import pytest

from candlespan.config import PATTERN_ORDER, Settings, Thresholds
from candlespan.operators.panel import own_rows, panel
from candlespan.operators.patterns import best_pattern, pattern_rows, with_patterns
from candlespan.operators.stage import with_stage
from candlespan.plans import scan
from tests.conftest import bars, frame, legs, walk


def matches(spark, f, name):
    rows = pattern_rows(with_patterns(panel(bars(spark, f)), [name]), [name])
    return {r.bar_no: r for r in rows.collect()}


def latest(spark, f, name):
    return matches(spark, f, name).get(len(f))


def test_52_week_high(spark):
    c = np.linspace(100, 200, 252)
    c[-1] = c[-2] * 0.99
    m = latest(spark, frame(c), "fifty_two_week_high")
    assert m.breakout_level == pytest.approx(c[-2] * 1.005)
    assert latest(spark, frame(c[:200]), "fifty_two_week_high") is None


def test_darvas_box(spark):
    ramp, box = np.linspace(60, 90, 40), np.full(30, 98.0)
    high, low = np.concatenate([ramp, np.full(30, 98.5)]), np.concatenate([ramp - 1, np.full(30, 97.0)])
    for i in (0, 6, 12, 24):
        high[40 + i] = 100
    low[50] = 96
    m = latest(spark, frame(np.concatenate([ramp, box]), high, low), "darvas_box")
    assert (m.breakout_level, m.base_height, m.notes["touches"], m.notes["window_len"]) == (100, 4, 4, 30)


def test_squeeze_needs_the_upper_half(spark):
    wide = 100 + 8 * np.array([1, -1] * 55)
    assert latest(spark, frame(np.concatenate([wide, np.linspace(104, 104.5, 20)])), "bollinger_squeeze")
    assert latest(spark, frame(np.concatenate([wide, np.linspace(104.5, 104, 20)])), "bollinger_squeeze") is None


def test_ascending_triangle(spark):
    n, high, low = 60, np.full(60, 97.0), np.full(60, 95.0)
    for i in range(5, n, 10):
        high[i] = 100
    for k, i in enumerate(range(10, n - 3, 10)):
        low[i] = 86 + 2 * k
    high = high + np.linspace(0, 1e-3, n) * (high < 100)
    low = low + np.linspace(0, 1e-3, n) * (low > 94)
    m = latest(spark, frame(np.full(n, 96.0), high, low), "ascending_triangle")
    assert m.breakout_level == 100 and m.notes["support_slope"] > 0 and m.notes["support_r2"] > 0.7


def test_contractions(spark):
    c = legs([60, 100, 75, 100, 88, 100, 94, 98], 7)
    m = latest(spark, frame(c, volume=np.linspace(200_000, 50_000, len(c)).astype(int)), "vcp")
    assert m.notes["n_contractions"] >= 3 and m.notes["volume_decreasing"] == 1 and len(m.moves) == m.notes["n_contractions"]


def _zigzag_run(high, low, vol):
    """The definition on one truncated history, front to back."""
    n = 3
    h, l = high[-250:], low[-250:]
    v = vol[-250:]
    ev = []
    for i in range(n, len(h) - n):
        w = slice(i - n, i + n + 1)
        if h[i] == h[w].max() and (h[w] == h[i]).sum() == 1:
            ev.append((i, "H", h[i]))
        if l[i] == l[w].min() and (l[w] == l[i]).sum() == 1:
            ev.append((i, "L", l[i]))
    zig = []
    for e in ev:
        if zig and zig[-1][1] == e[1]:
            better = e[2] > zig[-1][2] if e[1] == "H" else e[2] < zig[-1][2]
            if better:
                zig[-1] = e
        else:
            zig.append(e)
    cs = [((a[2] - b[2]) / a[2], a[0], b[0], b[2]) for a, b in zip(zig, zig[1:]) if a[1] == "H" and b[1] == "L" and a[2] > b[2]]
    run = cs[-1:]
    for c in reversed(cs[:-1]):
        if run[0][0] > c[0] * 0.6:
            break
        run.insert(0, c)
    if len(run) < 3:
        return None
    means = [v[c[1] : c[2] + 1].mean() for c in run]
    level = h[run[-1][2] :].max()
    return len(run), level, level - run[-1][3], all(b <= a for a, b in zip(means, means[1:])), len(high) - len(h) + run[0][1] + 1


def test_contractions_equal_the_definition_on_every_history(spark):
    f = walk(11, 420)
    got = matches(spark, f, "vcp")
    high, low, vol = f.high.to_numpy(), f.low.to_numpy(), f.volume.to_numpy()
    found = 0
    for t in range(8, len(f) + 1):
        want = _zigzag_run(high[:t], low[:t], vol[:t])
        m = got.get(t)
        assert (m is None) == (want is None), t
        if want:
            found += 1
            assert (m.notes["n_contractions"], m.breakout_level, m.base_height, bool(m.notes["volume_decreasing"]), m.base_start_no) == want
    assert found > 0


def test_cup_and_handle(spark):
    c = np.concatenate([np.linspace(100, 80, 30), np.linspace(80, 99, 30), np.linspace(98, 92, 8)])
    m = latest(spark, frame(c, c, c), "cup_and_handle")
    assert m.breakout_level == pytest.approx(99) and 0.12 <= m.notes["cup_depth"] <= 0.35


def test_flag_needs_volume_in_the_pole(spark):
    c = np.concatenate([np.full(20, 80.0), np.linspace(80, 96, 10), np.linspace(95, 90, 8)])
    vol = np.full(38, 100_000)
    vol[20:30] = 200_000
    assert latest(spark, frame(c, volume=vol), "flag")
    assert latest(spark, frame(c), "flag") is None


def test_every_bar_equals_a_rerun_on_its_own_history(spark):
    """No look-ahead: what the panel says about a bar is what its truncated history says."""
    f = walk(12, 330)
    p = with_patterns(panel(bars(spark, f)))
    full = {(r.bar_no, r.pattern): (round(r.confidence, 9), round(r.breakout_level, 9)) for r in pattern_rows(p).collect()}
    cut_frames = [f.iloc[:t].assign(symbol=f"t{t}") for t in (60, 130, 255, 290, 330)]
    cut = pattern_rows(with_patterns(panel(bars(spark, *cut_frames))))
    for t in (60, 130, 255, 290, 330):
        want = {(r.bar_no, r.pattern): (round(r.confidence, 9), round(r.breakout_level, 9)) for r in cut.filter(f"symbol = 't{t}' and bar_no = {t}").collect()}
        assert want == {k: v for k, v in full.items() if k[0] == t}


def test_best_pattern_prefers_confidence_then_order(spark):
    p = with_patterns(panel(bars(spark, walk(13, 300)))).withColumn("best", best_pattern())
    rows = own_rows(p).collect()
    order = {n: i for i, n in enumerate(PATTERN_ORDER)}
    for r in rows:
        found = [r[f"p_{n}"] for n in PATTERN_ORDER if r[f"p_{n}"] is not None]
        want = min(found, key=lambda m: (-m.confidence, order[m.pattern])).pattern if found else None
        assert (r.best.pattern if r.best else None) == want


def test_stages(spark):
    up, down = np.linspace(100, 200, 250), np.linspace(200, 100, 250)
    frames = [frame(up, symbol="up"), frame(down, symbol="down"), frame(up[:50], symbol="short"),
              frame(np.concatenate([np.linspace(200, 100, 200), np.full(250, 100.0)]), symbol="base"),
              frame(np.concatenate([np.linspace(100, 200, 150), np.full(190, 200.0)]), symbol="top")]
    got = own_rows(with_stage(panel(bars(spark, *frames)))).filter("bar_no = n_bars").collect()
    s = {r.symbol: r.stage for r in got}
    assert s["up"] == "STAGE_2" and s["down"] == "STAGE_4" and s["short"] == "UNKNOWN"


def test_scan_end_to_end(spark):
    c = np.concatenate([np.linspace(100, 195, 250), np.full(49, 205.0) - np.array([0, 1] * 24 + [0]) * 0.5, [206.0]])
    high = c * 1.0
    high[-30] = 207.0
    vol = np.full(300, 1_000_000)
    vol[-1] = 3_000_000
    b = bars(spark, frame(c, high, c - 1.0, volume=vol))
    u = spark.createDataFrame([("S", "BANK")], "symbol string, sector string")
    th = Settings(thresholds=Thresholds(min_adv_cr=1.0))
    last = scan.morning_scan(b, u, th).filter("bar_no = 300").collect()[0]
    assert last.stage == "STAGE_2" and last.gate == "passed" and last.score >= 50
    assert scan.watchlist(scan.morning_scan(b, u, th)).filter("date = (date '2020-01-01' + 299)").count() == 1
