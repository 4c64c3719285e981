"""URL rules by hashed lookup expressions.

Every distinct (host, path) is expanded into the expressions a rule could have: each suffix of the host at a label boundary,
joined with each prefix of the path whose length occurs among the rules. Expressions and rules meet on the first bytes of
their digest, an equality join on a short key; the full digest and the strings are compared after it. Of the rules that
fit, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespan.llm.common import ascii_lower

#: The query's rules: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
PREFIX_BYTES = 4
MAX_PREFIX_LENGTHS = 4096


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def split_url(url):
    """(host, path) columns. Null, or a URL without `://`, gives two empty strings."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def best_rules(hosts_paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for the distinct (host, path) that some rule fits.

    Longest means the rule's host and path together; of equally long ones the longer host wins, then block. A rule with an
    empty host fits nothing. The lengths of the rules' paths and the numbers of labels of their hosts, a few small numbers each, are looked
    up first; more than `MAX_PREFIX_LENGTHS` different ones are refused, as the expansion would no longer be small.
    """
    rules = rules.filter((F.col("host") != "") & F.col("verdict").isin("allow", "block")).select(
        ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().limit(MAX_PREFIX_LENGTHS + 1).collect())
    if len(lengths) > MAX_PREFIX_LENGTHS:
        raise ValueError("the rules' paths have too many different lengths")
    hashed = rules.withColumn("full", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn(
        "short", F.substring("full", 1, 2 * PREFIX_BYTES)
    )
    # only suffixes of as many labels as some rule has can fit, so a host of thousands of labels makes no more of them than another
    dots = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("."), F.lit("")))
    counts = sorted(r[0] for r in rules.select(dots("rule_host") + 1).distinct().limit(MAX_PREFIX_LENGTHS + 1).collect())
    if len(counts) > MAX_PREFIX_LENGTHS:
        raise ValueError("the rules' hosts have too many different numbers of labels")
    fitting = [F.when(dots("host") >= n - 1, F.substring_index("host", ".", -n)) for n in counts]
    suffixes = F.array_compact(F.array(*fitting)) if fitting else F.array().cast("array<string>")
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    expressions = (
        hosts_paths.filter(F.col("host") != "").distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("cut", F.explode(cuts))
        .select("host", "path", "suffix", F.substring(F.col("path"), F.lit(1), F.col("cut")).alias("prefix"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("digest", 1, 2 * PREFIX_BYTES))
    )
    fits = expressions.join(hashed, "short").filter(
        (F.col("digest") == F.col("full")) & (F.col("suffix") == F.col("rule_host")) & (F.col("prefix") == F.col("rule_path"))
    )
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"),
    )
    return fits.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url); other columns are ignored.

    Without a fitting rule, `rule` is null and the verdict is `default`. Null page_ids and repeated rows stay as they are.
    """
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    # no verdict is looked up for rows without a host, so they are not one hot key of the join
    key = F.when(F.col("host") != "", F.col("host"))
    best = best_rules(parts.select("host", "path"), rules).withColumnsRenamed({"host": "best_host", "path": "best_path"})
    return (
        parts.withColumn("key", key)
        .join(best, (F.col("key") == F.col("best_host")) & (F.col("path") == F.col("best_path")), "left")
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )
