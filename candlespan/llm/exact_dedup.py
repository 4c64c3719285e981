"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Three stages, each comparing the whole text as well as its digest:

1. each map task folds its own equal texts into one row (the partial side of the first aggregation);
2. the rows of a digest are merged per salt, a number drawn from the map task, so that no digest meets in one task;
3. the salt winners, at most `salts` per text, are combined.

A text with a third of all rows is one row per map task after the first stage. The answer goes back to the documents by
digest, a join whose hot keys adaptive execution splits. Only if two different texts share a digest is the text itself
shuffled a second time, for the rows of those digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespan.llm.common import stored

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def text_groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct (digest, text) of rows (doc_id, text, digest): its largest doc_id and its number of rows."""
    folded = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "text", "salt")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return folded.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for every row of docs (doc_id, text); other columns are ignored.

    Null text equals empty text. Of equal texts the row with the largest doc_id stays; a null doc_id is smaller than any
    other, and if a group has no other, all its rows count as the one that stays. Rows equal in doc_id and text are the
    same document and share its outcome. An empty table gives no rows. Digest clashes never merge different texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("digest", digest(F.col("text")))
    groups = stored(text_groups(rows, salts).select("digest", "keep_id", "group_size"), "text-groups")
    clashes = groups.groupBy("digest").count().filter("count > 1").select("digest")
    thin = rows.select("doc_id", "digest")
    if clashes.isEmpty():
        found = thin.join(groups, "digest")
    else:
        clashing = rows.join(clashes, "digest", "left_semi")
        apart = clashing.join(text_groups(clashing, salts), ["digest", "text"]).select("digest", "doc_id", "keep_id", "group_size")
        plain = groups.join(clashes, "digest", "left_anti")
        found = thin.join(plain, "digest").unionByName(apart)
    return found.select(
        "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    )
