import numpy as np
import pytest
from pyspark.sql import functions as F

from candlespan.llm.mixing import WEIGHTS, copies, flight, mix_report, mixed, source_targets


def brute_targets(sizes):
    total, capped, target = sum(sizes), set(), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(3 * sizes[i] for i in capped)
        w = sum(WEIGHTS[i % 3] for i in rest)
        target = {i: 3 * sizes[i] for i in capped} | {i: left * WEIGHTS[i % 3] / w for i in rest}
        over = {i for i in rest if target[i] > 3 * sizes[i]}
        if not over:
            return [target[i] for i in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("sizes", [[10], [100, 1, 1], [5, 50, 500], [1, 1, 1000, 3, 0], [7, 7, 7, 7, 7, 7], [0, 5]])
def test_targets_match_the_reshared_ones(spark, sizes):
    df = spark.createDataFrame([(chr(97 + i), n) for i, n in enumerate(sizes)], "source string, size long")
    got = [r.target for r in source_targets(df).orderBy("source").collect()]
    assert np.allclose(got, brute_targets(sizes))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    chance, size = rng.random(500), rng.integers(1, 2000, 500)
    out = flight(chance, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert np.isclose(out.sum(), chance.sum()) and np.isclose((out * size).sum(), (chance * size).sum())


def test_flight_is_unbiased():
    chance, size = np.array([0.2, 0.5, 0.7, 0.4, 0.6, 0.6]), np.array([1, 2, 3, 3, 2, 1])
    mean = np.mean([flight(chance, size, np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.abs(mean - chance).max() < 0.04


def corpus(spark, n=3000):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", "c", None][min(3, int(rng.exponential(0.8)))], 1) for i in range(n)]
    rows += [(n, None, "a", 1), (n, None, "a", 1), (None, "x y", "b", 1), (n + 1, "w " * 3000, "c", 1), (n + 2, "", "empty", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")


@pytest.mark.parametrize("block", [4096, 64])
def test_words_taken_come_near_the_targets(spark, block):
    docs = corpus(spark)
    rows = docs.select(F.col("doc_id").alias("key"), "source", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).alias("size"))
    out = copies(rows, block=block).join(docs.select(F.col("doc_id").alias("key"), "source").dropna(subset=["key"]), "key")
    per = out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert not [r for r in per if abs(r.taken - r.target) > 150]
    assert out.filter("copies > 3 or copies < 0").count() == 0


def test_report_is_whole_and_repeatable(spark):
    docs = corpus(spark)
    one = sorted(map(str, mix_report(docs).collect()))
    assert one == sorted(map(str, mix_report(docs.repartition(7)).collect())) and len(one) == docs.count()
    assert mix_report(docs.limit(0)).collect() == []


def test_mixed_repeats_rows_and_keeps_columns(spark):
    docs = corpus(spark)
    out = mixed(docs)
    assert out.schema == docs.schema
    report = mix_report(docs).groupBy().agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)))).first()[0] == pytest.approx(report, rel=0.02)
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 6
    assert mixed(docs.limit(0)).collect() == []


def test_columns_named_like_the_mix_own(spark):
    rows = [(i, "a b c d", "xy"[i % 2], i, "k", 5) for i in range(40)] + [(99, "a b", "x", 0, "k", 5)] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key long, __key string, mix_total int")
    got = mixed(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= set(rows)
    plain = mixed(docs.drop("mix_key", "__key", "mix_total"))
    assert sorted(r.doc_id for r in got.collect() if r.doc_id == 99) in ([99] * k for k in range(60)) and plain.count() > 0
