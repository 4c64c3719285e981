"""Benchmark decontamination by a generalised suffix automaton.

The automaton of the benchmark items is built once and sent to the tasks; each streams the words of its documents through it,
following the longest match. A match that reaches a window (ten item words, or a whole shorter item) marks its words.
The automaton's size is checked: beyond `block_words` the items are dealt into several automata, applied in separate passes of
which only the documents with hits are kept, and merged.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlespan.llm.common import kept_in_worker, release, spare_name, stored
from candlespan.llm.suffix_automaton import WORD, SuffixAutomaton, words_of

#: Words of the items in one automaton; some 300 bytes each in a task.
BLOCK_WORDS = 300_000
FOUND = "n_words long, spans array<struct<first:int,end:int>>, items array<string>"


def _matcher(spark, items: list[tuple[str, str | None]], window: int):
    automaton = spark.sparkContext.broadcast(SuffixAutomaton(items, window))

    @F.pandas_udf(FOUND)
    def match(texts: pd.Series) -> pd.DataFrame:
        kept_in_worker("decontaminate")
        rows = []
        for text in texts:
            words = words_of(text)
            spans, names = automaton.value.scan(words)
            rows.append((len(words), [{"first": a, "end": b} for a, b in spans], sorted(names)))
        release()
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    # Spark repeats deterministic functions below and above a filter on their result
    return automaton, match.asNondeterministic()


def _covered(spans: Column) -> Column:
    """Words covered by spans (first, end), which may overlap."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))

    def step(acc, s):
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["first"], acc["to"]))).alias("n"),
            F.greatest(acc["to"], s["end"]).alias("to"),
        )

    return F.aggregate(F.array_sort(spans), zero, step)["n"].cast("long")


def item_blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The items (item_id, text) in parts of about `block_words` words; always one part at least."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    words = items.select(F.sum(F.length("text") / 2)).first()[0] or 0  # a word takes two characters at least
    n = int(words // block_words) + 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs with a column `found`: n_words, spans of hit words, items, n_hit.

    docs needs a column text, benchmark the columns item_id and text; other columns of docs stay as they are, but for one
    named `found`, which is replaced. Null and empty texts have no words; a null item_id is written as an empty string;
    items of equal id count once. An empty benchmark hits nothing; no documents give no rows. Repeated rows stay.
    """
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, block_words)
    if len(blocks) == 1:
        _, match = _matcher(spark, [tuple(r) for r in blocks[0].collect()], window)
        out = docs.withColumn("found", match("text"))
    else:
        key, name, parts = F.xxhash64(F.coalesce("text", F.lit(""))), spare_name("text_key", docs), None
        for items in blocks:
            automaton, match = _matcher(spark, [tuple(r) for r in items.collect()], window)
            hits = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("found", match("text"))
            hits = hits.filter(F.size("found.spans") > 0).select(key.alias("text_key"), "found").dropDuplicates(["text_key"])
            hits = stored(hits, "benchmark-hits")
            automaton.unpersist()
            parts = hits if parts is None else parts.unionByName(hits)
        merged = parts.groupBy("text_key").agg(
            F.max("found.n_words").alias("n_words"), F.flatten(F.collect_list("found.spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items"),
        )
        merged = merged.select("text_key", F.struct("n_words", "spans", "items").alias("found"))
        count = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
        none = F.struct(
            F.coalesce(count, F.lit(0)).cast("long").alias("n_words"),
            F.array().cast("array<struct<first:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"),
        )
        out = (
            docs.drop("found").withColumn(name, key).join(merged.withColumnRenamed("text_key", name), name, "left")
            .withColumn("found", F.coalesce("found", none)).drop(name)
        )
    return out.withColumn("found", F.struct("found.*", _covered(F.col("found.spans")).alias("n_hit")))


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, cuts in zip(texts, spans):
        if text is None or not len(cuts):
            out.append(text)
            continue
        raw = text.encode()
        places = [m.span() for m in WORD.finditer(raw.lower())]
        at, kept = 0, []
        for s in sorted(cuts, key=lambda s: s["first"]):
            begin, end = places[s["first"]][0], places[s["end"] - 1][1]
            kept.append(raw[at : max(at, begin)])
            at = max(at, end)
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pd.Series(out, dtype=object)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows of docs with hit spans cut out of `text`; documents with more than `max_coverage` of their words hit are left out.

    Rows without a hit stay unchanged. `n_chars`, where docs has it, is set anew for changed texts. Only columns that came in
    come out. The cut ends at word bounds, so the text around it stays as it was.
    """
    aside = spare_name("found_before", docs)
    hit = benchmark_hits(docs.withColumnRenamed("found", aside), benchmark, window, block_words)
    kept = hit.filter(F.col("found.n_hit") <= max_coverage * F.col("found.n_words"))
    changed = F.col("found.n_hit") > 0
    out = kept.withColumn("text", F.when(changed, _cut("text", "found.spans")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop("found").withColumnRenamed(aside, "found").select(*[F.col(f"`{c}`") for c in docs.columns])
