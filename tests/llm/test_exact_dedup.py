import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from candlespan.llm.exact_dedup import exact_duplicates

ROWS = [
    (1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "a "), (7, "A"), (8, "é" * 30_000), (9, "é" * 30_000), (3, "b"), (None, "b"),
    (None, "alone"), (None, "alone"), (10, "c"),
] + [(100 + i, "hot") for i in range(200)]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, hashlib.sha256((t or "").encode()).hexdigest(), keep, len(groups[t or ""]), i == keep))
    return sorted(out, key=str)


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumn("digest", F.lit("theirs")).withColumn("salt", F.lit(1)).withColumn("keep_id", F.lit("x"))


def test_groups_match_brute_force(spark):
    got = exact_duplicates(docs(spark, ROWS))
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)


@pytest.mark.parametrize("salts", [1, 3])
def test_clashing_digests_never_merge_texts(spark, salts):
    got = exact_duplicates(docs(spark, ROWS), salts, lambda t: F.length(t).cast("string")).drop("digest")
    want = sorted(((a, c, d, e) for a, _, c, d, e in expected(ROWS)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_table(spark):
    assert exact_duplicates(docs(spark, ROWS).limit(0)).collect() == []
