import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlespan.operators import indicators as I
from candlespan.operators.kernels import Smooth, run_kernels, smoothing
from candlespan.operators.panel import number_bars, own_rows, panel, segment
from candlespan.operators.pivots import pivot_strength, pivots
from candlespan.operators.ranking import medians, percentile_ranks, tercile_cuts, value_counts
from candlespan.sources import walk as B
from tests.conftest import bars, frame, walk


def test_numbering_spans_calendar_blocks(spark):
    df = bars(spark, walk(1, 900, "A"), walk(2, 30, "B"))
    got = number_bars(df).toPandas().sort_values(["symbol", "date"])
    assert got[got.symbol == "A"].bar_no.tolist() == list(range(1, 901))
    assert set(got[got.symbol == "B"].n_bars) == {30}


def test_small_segments_give_the_same_windows(spark):
    df = number_bars(bars(spark, walk(3, 500)))
    cols = {"sma": I.sma("close", 20), "ret": I.period_return(15), "tr": I.true_range()}
    whole = own_rows(segment(df).withColumns(cols)).toPandas().sort_values("bar_no", ignore_index=True)
    cut = segment(df, seg_rows=60, back=40, ahead=10)
    assert cut.filter("not own").count() > 0
    parts = own_rows(cut.withColumns(cols)).toPandas().sort_values("bar_no", ignore_index=True)
    pd.testing.assert_frame_equal(whole, parts[whole.columns])


def test_pivot_strength_across_segments(spark):
    data = walk(4, 400)
    b = number_bars(bars(spark, data))
    cut = segment(b, seg_rows=50, back=30, ahead=10)
    got = {(r.bar_no, r.kind): r.strength for r in pivot_strength(cut, b, 5, seg_rows=50).collect()}
    want = {}
    for r in pivots(segment(b), 5).collect():
        v = data.high.to_numpy() if r.kind == "HIGH" else -data.low.to_numpy()
        i = r.bar_no - 1
        left = right = 0
        while i - left - 1 >= 0 and v[i - left - 1] < v[i]:
            left += 1
        while i + right + 1 < len(v) and v[i + right + 1] < v[i]:
            right += 1
        want[(r.bar_no, r.kind)] = min(left, right)
    assert want and got == want


def test_flat_tops_are_no_pivots(spark):
    f = frame([1, 3, 2, 4, 2, 5, 2], high=[1, 3, 2, 4, 2, 5, 2], low=[0] * 7)
    got = pivots(panel(bars(spark, f)), 1).filter("kind = 'HIGH'")
    assert sorted(r.bar_no for r in got.collect()) == [2, 4, 6]
    flat = frame([1] * 9, high=[5] * 9, low=[1] * 9)
    assert pivots(panel(bars(spark, flat)), 2).count() == 0


def test_smoothing_follows_the_recursion_with_gaps(spark):
    f = walk(5, 80).assign(x=lambda d: np.where(np.arange(80) % 7 == 3, np.nan, d.close))
    df = spark.createDataFrame(f).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("volume", F.col("volume").cast("long"))
    got = own_rows(run_kernels(panel(df), [smoothing([Smooth("y", "x", 0.1, 5)])])).toPandas().sort_values("bar_no")
    y, gap, want, seen = None, 1, [], 0
    for v in f.x:
        if np.isnan(v):
            gap += 1
        else:
            seen += 1
            old = (1 - 0.1) ** gap
            y = v if y is None else (old * y + 0.1 * v) / (old + 0.1)
            gap = 1
        want.append(y if seen >= 5 else np.nan)
    np.testing.assert_allclose(got.y.to_numpy(float), want, rtol=1e-12)


def test_hot_supplier_is_split_and_exact(spark, monkeypatch):
    """One supplier with a third of all lines, most of them on one day, cut into many order blocks."""
    rng = np.random.default_rng(6)
    n = 3000
    hot = np.arange(n) % 3 == 0
    li = pd.DataFrame({
        "l_orderkey": rng.integers(1, 5000, n), "l_linenumber": rng.integers(1, 7, n), "l_partkey": rng.integers(1, 900, n),
        "l_suppkey": np.where(hot, 1, rng.integers(2, 30, n)), "l_quantity": rng.integers(1, 51, n).astype(float),
        "l_shipdate": pd.to_datetime("2000-01-01") + pd.to_timedelta(np.where(hot & (rng.random(n) < 0.8), 5, rng.integers(0, 700, n)), "D"),
    })
    monkeypatch.setattr(B, "ORDER_BLOCK", 64)
    got = B.walk_bars(spark.createDataFrame(li)).toPandas().sort_values(["symbol", "date"], ignore_index=True)
    li["symbol"] = li.l_suppkey.astype(str)
    li = li.sort_values(["symbol", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    li["p"] = 1500 + (li.l_quantity - 25.5).groupby(li.symbol).cumsum()
    li["before"] = li.p - li.l_quantity + 25.5
    li["date"] = li.l_shipdate.dt.date
    g = li.groupby(["symbol", "date"])
    want = pd.DataFrame({"open": g.before.first(), "mx": g.p.max(), "mn": g.p.min(), "close": g.p.last(), "volume": g.l_quantity.sum().astype(int)}).reset_index()
    assert got.close.tolist() == want.close.tolist() and got.volume.tolist() == want.volume.tolist()
    assert got.high.tolist() == np.maximum(want.open, want.mx).tolist() and got.low.tolist() == np.minimum(want.open, want.mn).tolist()


def test_split_ranks_equal_plain_ranks(spark):
    """A third of the values tie; the split path is forced."""
    rng = np.random.default_rng(7)
    v = np.where(np.arange(900) % 3 == 0, 0.25, rng.normal(size=900).round(2))
    df = spark.createDataFrame(pd.DataFrame({"g": ["a", "b"] * 450, "v": v}))
    for small in (0, 10**9):
        got = value_counts(df, ["g"], "v", 8, small).toPandas()
        for g, part in pd.DataFrame({"g": ["a", "b"] * 450, "v": v}).groupby("g"):
            m = got[got.g == g].set_index("v")
            for x, row in m.iterrows():
                assert row.upto == (part.v <= x).sum() and row.n == (part.v == x).sum() and row.total == len(part)


def test_percentiles_medians_terciles(spark):
    rows = [("d", "w", -0.5), ("d", "b", 0.4), ("d", "m", 0.1), ("d", "n", 0.1), ("d", "z", None), ("e", "x", 0.3)]
    df = spark.createDataFrame(rows, "date string, symbol string, ret double")
    got = {(r.date, r.symbol): r.rs_percentile for r in percentile_ranks(df, ["date"], "ret").collect()}
    assert got[("d", "b")] == 100 and got[("d", "w")] == 0 and got[("d", "m")] == got[("d", "n")] == 50
    assert got[("d", "z")] is None and got[("e", "x")] == 50
    assert {r.date: r.median for r in medians(df, ["date"], "ret").collect()}["d"] == 0.1
    nums = spark.createDataFrame([("f", float(i)) for i in range(9)] + [("g", 1.0)] * 9, "feature string, value double")
    cuts = {r.feature: (r.lo, r.hi) for r in tercile_cuts(nums, ["feature"], "value").collect()}
    assert cuts == {"f": (3.0, 6.0), "g": (None, None)}


def test_indicator_facts(spark):
    two = frame([10.5, 21], high=[11, 22], low=[10, 20])
    assert own_rows(panel(bars(spark, two)).withColumn("tr", I.true_range())).orderBy("bar_no").collect()[1].tr == 11.5
    got = own_rows(I.smoothed_indicators(panel(bars(spark, walk(8, 150), frame(np.linspace(50, 90, 60), symbol="U"))))).toPandas()
    r = got[got.symbol == "S"].sort_values("bar_no")
    assert r.rsi.iloc[:14].isna().all() and r.rsi.iloc[14:].between(0, 100).all() and (r.atr_14.iloc[13:] > 0).all()
    np.testing.assert_allclose(r.macd_hist, r.macd - r.macd_signal)
    assert r.adx.iloc[:27].isna().all() and r.adx.iloc[27:].notna().all()
    up = got[got.symbol == "U"].sort_values("bar_no")
    assert (up.rsi.iloc[14:] == 100).all()


def test_dates_are_kept(spark):
    got = number_bars(bars(spark, frame([1, 2, 3], start=dt.date(1999, 12, 30)))).orderBy("date").collect()
    assert [r.bar_no for r in got] == [1, 2, 3] and got[2].date == dt.date(2000, 1, 1)


def test_long_series_smooths_across_segments(spark):
    """9,000 bars make three segments; restarting in the halo must not show."""
    f = walk(9, 9000)
    p = panel(bars(spark, f))
    assert p.select("seg").distinct().count() == 3
    got = own_rows(I.with_standard(p)).select("bar_no", "atr_50", "atr_14", "sma_200").toPandas().sort_values("bar_no", ignore_index=True)
    pc = f.close.shift(1)
    tr = pd.concat([f.high - f.low, (f.high - pc).abs(), (f.low - pc).abs()], axis=1).max(axis=1)
    assert len(got) == 9000
    for n in (14, 50):
        want = tr.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
        np.testing.assert_allclose(got[f"atr_{n}"].to_numpy(float), want.to_numpy(), rtol=1e-12)
    np.testing.assert_allclose(got.sma_200.to_numpy(float), f.close.rolling(200).mean().to_numpy(), rtol=1e-9)


def test_scratch_goes_to_the_shared_folder(spark):
    from candlespan.session import scratch_dir

    class Fake:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "hdfs://shared/ck/" if key == "spark.checkpoint.dir" else default

    assert scratch_dir(Fake, "bars").startswith("hdfs://shared/ck/bars-")
    Fake.conf.get = staticmethod(lambda key, default=None: "yarn" if key == "spark.master" else default)
    with pytest.raises(ValueError):
        scratch_dir(Fake, "bars")


def test_smoothing_of_long_periods_over_segments(spark):
    from candlespan.operators.kernels import halo_rows, run_kernels, smoothing
    from candlespan.operators.panel import own_rows, panel

    f = walk(3, 9000)
    specs = [I.ema_spec("ema_200", "close", 200), I.wilder_spec("mean_100", "close", 100)]
    assert halo_rows(2 / 201) > 2048
    cut = panel(bars(spark, f), seg_rows=4000, back=3800)
    got = own_rows(run_kernels(cut, [smoothing(specs)])).orderBy("bar_no").toPandas()
    np.testing.assert_allclose(got.ema_200.to_numpy(float), f.close.ewm(alpha=2 / 201, adjust=False).mean().to_numpy(), rtol=1e-12)
    np.testing.assert_allclose(got.mean_100.to_numpy(float)[99:], f.close.ewm(alpha=0.01, adjust=False).mean().to_numpy()[99:], rtol=1e-12)
    with pytest.raises(Exception, match="too short"):
        own_rows(run_kernels(panel(bars(spark, f)), [smoothing(specs)])).collect()


def test_a_universe_without_symbols_is_an_error(spark, tmp_path):
    from candlespan.sources.files import universe_csv

    (tmp_path / "u.csv").write_text("Symbol,Company Name,Industry\n,x,y\n")
    with pytest.raises(ValueError):
        universe_csv(spark, str(tmp_path / "u.csv"))


def test_holidays_known_in_advance_count(spark):
    from candlespan.operators.calendar import calendar

    span = spark.createDataFrame([(dt.date(2026, 1, 20), dt.date(2026, 1, 30))], "lo date, hi date")
    days = {r.date.day: r.trading for r in calendar(span, spark.createDataFrame([(dt.date(2026, 1, 21),)], "date date")).collect()}
    assert not days[26] and not days[21] and days[27]


def test_panels_are_dealt_into_all_partitions(spark):
    """Few rows, but long searches for each: merged into one task a core, a second task doubles the time of the stage."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(40 * 30).selectExpr("cast(id % 40 as string) symbol", "date_add(date '2020-01-01', cast(id div 40 as int)) date", "1.0D close")
    assert n > 1 and panel(rows).rdd.getNumPartitions() == n
    lines = spark.range(40 * 30).selectExpr(
        "id % 40 l_suppkey", "timestamp '2020-01-01' + make_interval(0, 0, 0, cast(id div 40 as int)) l_shipdate", "id l_orderkey", "1 l_linenumber",
        "id l_partkey", "cast(id % 50 as double) l_quantity")
    assert panel(B.walk_bars(lines), even=False).rdd.getNumPartitions() == n
