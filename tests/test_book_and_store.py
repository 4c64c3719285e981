"""The living book, correlation by tiles, the alert sink and the stored bars that merges rewrite in part."""

import datetime as dt
import glob
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlespan.operators import confirm as K
from candlespan.operators import crosssection as X
from candlespan.session import scratch_dir
from candlespan.sources import files as IO

START = dt.date(2020, 1, 1)
CANDIDATES = "date date, symbol string, score double, sector string, exit_date date, priority int"


def one_by_one(rows, total, sector_cap):
    book, out = [], []
    for date, symbol, score, sector, ends, _ in sorted(rows, key=lambda r: (r[0], r[5], -r[2], r[1])):
        sector = sector or "unknown"
        book = [p for p in book if p[0] is None or p[0] >= date]
        inside = sum(p[1] == sector for p in book)
        if (not total or len(book) < total) and (not sector_cap or inside < sector_cap):
            out.append((date, symbol, score, sector, ends, len(book), inside))
            book.append((ends, sector))
    return sorted(out, key=str)


@pytest.mark.parametrize("total, sector_cap", [(8, 3), (3, 1), (2, 5), (0, 2), (4, 0), (0, 0)])
def test_book_equals_taking_candidates_one_by_one(spark, total, sector_cap):
    rng = random.Random(total * 10 + sector_cap)
    rows = []
    for day in range(60):
        for k in range(rng.choice([0, 1, 5, 40])):
            date = START + dt.timedelta(days=day)
            ends = date + dt.timedelta(days=rng.choice([0, 1, 5, 20])) if rng.random() < 0.95 else None
            rows.append((date, f"S{k:02d}", float(rng.randrange(60, 70)), rng.choice(["A", "B", "C", "D", None]), ends, rng.randrange(2)))
    got = K.living_book(spark.createDataFrame(rows, CANDIDATES).repartition(5), total, sector_cap)
    assert sorted(map(tuple, got.collect()), key=str) == one_by_one(rows, total, sector_cap)


def test_an_empty_book(spark):
    assert K.living_book(spark.createDataFrame([], CANDIDATES)).collect() == []


def pair_mean(series, least=10):
    """Mean absolute correlation of all pairs of {day: return} series, pair by pair."""
    out = []
    for i, a in enumerate(series):
        for b in series[i + 1 :]:
            days = sorted(set(a) & set(b))
            x, y = np.array([a[d] for d in days]), np.array([b[d] for d in days])
            if len(days) >= least and x.std() > 1e-9 and y.std() > 1e-9:
                out.append(abs(np.corrcoef(x, y)[0, 1]))
    return float(np.mean(out)) if out else 0.0


@pytest.mark.parametrize("tile", [3, 1024])
def test_correlation_by_tiles_equals_pair_by_pair(spark, tile):
    rng = np.random.default_rng(5)
    rows, series = [], {}
    for k in range(14):
        days = np.sort(rng.choice(90, 80 if k < 12 else 12, replace=False))
        series[f"S{k}"] = {int(d): float(v) for d, v in zip(days, rng.normal(0, 0.02, len(days)) if k else np.full(len(days), 0.01))}
        rows += [(f"S{k}", START + dt.timedelta(days=int(d)), n + 1, series[f"S{k}"][int(d)]) for n, d in enumerate(days)]
        last = max(series[f"S{k}"])
        if last != 89:  # everyone has the cohort's date
            series[f"S{k}"][89] = 0.01
            rows.append((f"S{k}", START + dt.timedelta(days=89), len(days) + 1, 0.01))
    returns = spark.createDataFrame(rows, "symbol string, date date, bar_no long, ret_1 double")
    on = START + dt.timedelta(days=89)
    cohorts = spark.createDataFrame([(on, s) for s in series] + [(START, "none")], "date date, symbol string")
    got = {r.date: r.avg_correlation for r in X.mean_abs_correlation(returns, cohorts, tile=tile).collect()}
    want = pair_mean([dict(sorted(s.items())[-63:]) for s in series.values()])
    assert got[on] == pytest.approx(want, abs=1e-9) and got[START] == 0.0


def test_correlation_of_a_cohort_of_2000(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.02, (2000, 63)) + rng.normal(0, 0.01, 63)
    frame = pd.DataFrame({
        "symbol": np.repeat([f"S{k}" for k in range(2000)], 63), "date": [START + dt.timedelta(days=i) for i in range(63)] * 2000,
        "bar_no": list(range(1, 64)) * 2000, "ret_1": x.ravel()})
    returns = spark.createDataFrame(frame, "symbol string, date date, bar_no long, ret_1 double")
    cohorts = returns.filter("bar_no = 63").select("date", "symbol")
    (got,) = X.mean_abs_correlation(returns, cohorts).collect()
    c = np.corrcoef(x)
    assert got.avg_correlation == pytest.approx(np.abs(c[np.triu_indices(2000, 1)]).mean(), abs=1e-9)


def alerts(spark, rows):
    df = spark.createDataFrame(rows, "run_date string, symbol string, score double")
    return df.select("run_date", *[(F.col(c) if c in df.columns else F.lit("x")).alias(c) for c in IO.ALERT_FIELDS if c not in IO.ALERT_ROUNDED or c == "score"],
                     *[F.lit(1.234).alias(c) for c in IO.ALERT_ROUNDED if c != "score"])


def read(spark, path):
    return sorted((r.run_date, r.run, r.symbol, r.score) for r in IO.read_alerts(spark, path).collect())


def test_alerts_are_there_once_after_repeats_and_failures(spark):
    path = scratch_dir(spark, "alerts")
    first = alerts(spark, [("2020-01-01", "A", 1.006), ("2020-01-02", "B", 2.0)])
    IO.write_alerts(first, path)
    IO.write_alerts(first, path)
    once = [("2020-01-01", "scan", "A", "1.01"), ("2020-01-02", "scan", "B", "2.0")]
    assert read(spark, path) == once

    broken = alerts(spark, [("2020-01-01", "A", 9.0), ("2020-01-03", "C", 9.0)] * 50).repartition(8)
    with pytest.raises(Exception):  # some tasks write their rows before one fails for good
        IO.write_alerts(broken.withColumn("notes", F.expr("if(rand(1) < 0.02, raise_error('lost'), 'x')")), path)
    assert read(spark, path) == once

    IO.write_alerts(alerts(spark, [("2020-01-01", "D", 4.0)]), path, run="preclose")
    assert read(spark, path) == sorted([*once, ("2020-01-01", "preclose", "D", "4.0")])
    days = spark.createDataFrame([("2020-01-02",)], "run_date string")
    IO.write_alerts(first.filter("false"), path, dates=days)
    assert read(spark, path) == [("2020-01-01", "preclose", "D", "4.0"), once[0]]


def test_merge_rewrites_only_the_folders_that_change(spark):
    path, n_symbols, n_days = scratch_dir(spark, "store"), 100, 700
    day = F.date_add(F.lit(START), (F.col("id") % n_days).cast("int"))
    rows = spark.range(n_symbols * n_days).select(F.floor(F.col("id") / n_days).cast("string").alias("symbol"), day.alias("date"), F.col("id").cast("double").alias("close"))
    IO.write_bar_store(rows, path)

    def files():
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path.removeprefix('file:')}/**/*.parquet", recursive=True)}

    before = files()
    last = rows.filter(F.col("date") >= F.lit(START + dt.timedelta(days=n_days - 5))).withColumn("close", F.col("close") + 1)
    incoming = last.unionByName(last.select("symbol", F.date_add("date", 5).alias("date"), "close"))
    assert incoming.count() == 1000
    touched = IO.merge_bar_store(spark, path, incoming)
    after = files()
    kept = [f for f in before if after.get(f) == before[f]]
    assert len(before) - len(kept) <= touched and len(before) - len(kept) < 0.05 * len(before)
    want = rows.join(incoming.select("symbol", "date"), ["symbol", "date"], "left_anti").unionByName(incoming)
    got = IO.read_bar_store(spark, path).select("symbol", "date", "close")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert IO.merge_bar_store(spark, path, incoming) == 0 and files() == after


def test_merge_takes_one_of_several_rows_of_a_key(spark):
    path, shape = scratch_dir(spark, "store"), "symbol string, date date, close double"
    IO.write_bar_store(spark.createDataFrame([("A", START, 1.0), ("B", START, None)], shape), path)
    assert IO.merge_bar_store(spark, path, spark.createDataFrame([("B", START, None)], shape)) == 0
    assert IO.merge_bar_store(spark, path, spark.createDataFrame([("A", START, 3.0), ("A", START, 2.0), ("C", START, 5.0)], shape)) > 0
    assert sorted(map(tuple, IO.read_bar_store(spark, path).collect()), key=str) == [("A", START, 3.0), ("B", START, None), ("C", START, 5.0)]


@pytest.mark.parametrize("together", [1, 2, 8])
def test_correlation_in_parts_of_several_tiles(spark, together):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 0.02, (40, 150))
    x[3, 100:] = 0.01
    frame = pd.DataFrame({
        "symbol": np.repeat([f"S{k}" for k in range(40)], 150), "date": [START + dt.timedelta(days=i) for i in range(150)] * 40,
        "bar_no": list(range(1, 151)) * 40, "ret_1": x.ravel()})
    returns = spark.createDataFrame(frame, "symbol string, date date, bar_no long, ret_1 double")
    at = [0, 61, 62, 63, 125, 126, 149]  # around the edges of blocks of 63 bars
    cohorts = returns.filter(f"bar_no in ({', '.join(str(i + 1) for i in at)})").select("date", "symbol")
    got = {r.date: r.avg_correlation for r in X.mean_abs_correlation(returns, cohorts, tile=4, together=together).collect()}
    for i in at:
        want = pair_mean([{d: row[d] for d in range(max(0, i - 62), i + 1)} for row in x])
        assert got[START + dt.timedelta(days=i)] == pytest.approx(want, abs=1e-9), i


def test_a_cohort_of_several_tiles_is_sent_once(spark):
    returns = spark.createDataFrame([(f"S{k}", START + dt.timedelta(days=i), i + 1, float((k * 7 + i * i) % 11)) for k in range(60) for i in range(20)],
                                    "symbol string, date date, bar_no long, ret_1 double")
    out = X.mean_abs_correlation(returns, returns.filter("bar_no = 20").select("date", "symbol"), tile=10)
    assert out.count() == 1
    sent = out.filter("avg_correlation > 0")
    assert sent.count() == 1 and "explode(sequence(0, (parts" in sent._jdf.queryExecution().optimizedPlan().toString()
