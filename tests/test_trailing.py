"""Trailing windows of the grouped map against window frames and one-by-one rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlespan.operators import indicators as I
from candlespan.operators import trades as TR
from candlespan.operators.kernels import Rolling, _trailing_deviation, rolling, run_kernels, squeeze_kernel, triangle_kernel
from candlespan.operators.panel import panel, trailing
from candlespan.operators.pivots import with_pivots
from candlespan.operators.quality import bad_move, continuous
from conftest import bars, walk


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def holed(spark):
    rows = bars(spark, walk(3, 400), walk(4, 9, "T"))
    return rows.withColumn("close", F.when(F.dayofmonth("date") % 11 != 0, F.col("close")))


def test_rolling_equals_frames_with_holes(spark):
    specs = [Rolling("a", "close", 50), Rolling("b", "close", 20, "max", False), Rolling("c", "low", 13, "min", False), Rolling("d", "volume", 7)]
    rows = run_kernels(panel(holed(spark), seg_rows=128, back=64, ahead=8), [rolling(specs)])
    rows = rows.withColumns({
        "a2": F.when(F.col("bar_no") >= 50, F.avg("close").over(trailing(50))), "b2": F.max("close").over(trailing(20)),
        "c2": F.min("low").over(trailing(13)), "d2": F.when(F.col("bar_no") >= 7, F.avg("volume").over(trailing(7))),
    }).filter("own").toPandas()
    assert len(rows) == 409
    for c in "abcd":
        pd.testing.assert_series_equal(rows[c], rows[f"{c}2"], check_exact=True, check_names=False)


def test_standard_set_slides_no_frames(spark):
    text = plan(I.with_standard(panel(bars(spark, walk(1, 30)))))
    assert "-49" not in text and "-199" not in text


def test_continuous_equals_count(spark):
    rows = panel(holed(spark)).withColumn("close", F.when(F.col("bar_no").isin(40, 90), F.col("close") * 3).otherwise(F.col("close")))
    rows = rows.withColumn("bad", bad_move()).withColumns({"got": continuous(30), "want": F.count("bad").over(trailing(29)) == 0})
    assert rows.filter("got is null or got != want").count() == 0 and rows.filter("not got").count() > 30


def test_only_marked_rows_carry_the_bars_after_them(spark):
    p = panel(bars(spark, walk(5, 60)))
    marked = lambda f: (f["bar_no"] % 7 == 0).to_numpy()
    got = TR.ahead_of(run_kernels(p, [TR.future_kernel(marked, 10)], marked)).select("bar_no", "ahead")
    want = TR.with_future(p, 10).filter("bar_no % 7 = 0").select("bar_no", "ahead")
    assert got.orderBy("bar_no").collect() == want.orderBy("bar_no").collect() and got.count() == 8


@pytest.mark.parametrize("seed", [1, 2])
def test_squeeze_rule(seed):
    f = walk(seed, 300).assign(bar_no=np.arange(1, 301))
    f["close"] = 100 + (f["close"] - 100) * np.linspace(1, 0.05, 300) + np.arange(300) * 0.02  # calms down while it rises
    got = pd.DataFrame(squeeze_kernel().fn(f))
    x = f["close"]
    mid, dev = x.rolling(20).mean(), x.rolling(20).std(ddof=0)
    width = 4 * dev / mid
    hit = (f["bar_no"] >= 60) & (width <= width.rolling(126, min_periods=1).min() * 1.001) & (x >= mid)
    assert (got["squeeze_confidence"].notna() == hit).all() and hit.any()
    median = width.rolling(126, min_periods=1).median()
    np.testing.assert_allclose(got["squeeze_median_width_6mo"][hit], median[hit], rtol=1e-9)
    np.testing.assert_allclose(_trailing_deviation(x.to_numpy(), 20)[19:], dev[19:], rtol=1e-9)


def test_triangle_rule(spark):
    f = with_pivots(panel(bars(spark, walk(6, 500))), 3).toPandas().sort_values("bar_no", ignore_index=True)
    got, found = pd.DataFrame(triangle_kernel().fn(f)), 0
    for t in range(len(f)):
        past = f.iloc[max(t - 76, 0) : max(t - 2, 0)]
        hs, ls = past["piv_high"].dropna(), past["piv_low"].dropna()
        ok = t >= 19 and len(hs) >= 4 and len(ls) >= 3 and ((hs.max() - hs) / hs.max() <= 0.02).sum() >= 3
        if ok:
            x = past["bar_no"][ls.index]
            slope, r2 = np.polyfit(x, ls, 1)[0], np.corrcoef(x, ls)[0, 1] ** 2
            ok = slope > 0 and r2 >= 0.7
        assert ok == (not np.isnan(got["triangle_confidence"][t])), t
        if ok:
            found += 1
            assert np.isclose(got["triangle_support_slope"][t], slope) and np.isclose(got["triangle_support_r2"][t], r2)
            assert got["triangle_level"][t] == hs.max() and got["triangle_n_low_pivots"][t] == len(ls)
    assert found
