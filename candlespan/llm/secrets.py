"""Secret scanning over a trigram index, in DataFrame operations only.

Rules whose pattern has mandatory trigrams are not run over every text. The index holds one posting (trigram, document) for
each trigram of the rules' queries that a text contains. Postings are intersected per alternative, alternatives united per
clause, and clauses intersected per rule; the candidates that remain are verified with the pattern itself. Rules without
mandatory trigrams scan every text.

Spans count code points: the pieces between matches and the matches themselves are cut by the same pattern, so running sums
of their lengths give the places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespan.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group of the pattern whose length must reach `least`; shorter matches are dropped after matching.
    group: int = 0
    least: int = 0


#: The contract's three kinds. Character runs of the last two are maximal, so a lower bound inside the pattern and dropping
#: short runs afterwards are the same.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further public token formats.
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """Array of (start, end, order) of the rule's matches that pass, leftmost and not overlapping."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    cut = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    zero = F.struct(F.array().cast("array<struct<start:int,end:int,good:boolean>>").alias("done"), F.lit(0).alias("at"))
    good = (
        (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least) if rule.least else (lambda m: F.lit(True))
    )

    def step(acc, pair):
        begin = acc["at"] + pair["gap"]
        stop = begin + F.length(pair["match"])
        one = F.struct(begin.alias("start"), stop.alias("end"), good(pair["match"]).alias("good"))
        return F.struct(F.concat(acc["done"], F.array(one)).alias("done"), stop.alias("at"))

    pairs = F.zip_with(F.slice(cut, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    done = F.filter(F.aggregate(pairs, zero, step)["done"], lambda s: s["good"])
    found = F.transform(done, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind_no"), s["end"].alias("end")))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind_no:int,end:int>>")


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: (trigram, doc) for each of the trigrams that the lower-cased text of keyed (doc, text) contains."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    # the one-element array binds the lower-cased text once for all trigrams
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))[0]
    return keyed.select("doc", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, list], spark: SparkSession) -> DataFrame:
    """(doc, rule) for which the index meets all clauses of the rule's query."""
    terms = [
        (rule, c, a, len(grams), g)
        for rule, clauses in queries.items() for c, clause in enumerate(clauses) for a, grams in enumerate(clause) for g in sorted(grams)
    ]
    wanted = spark.createDataFrame(terms, "rule int, clause int, alternative int, size int, trigram string")
    total = {rule: len(clauses) for rule, clauses in queries.items()}
    sizes = F.create_map(*[F.lit(x) for pair in total.items() for x in pair])
    # the terms are as many as the rules have trigrams, so they may be broadcast; the index has a (trigram, doc) once per row with that key, hence the distinct count
    alternatives = (
        index.join(F.broadcast(wanted), "trigram").groupBy("doc", "rule", "clause", "alternative", "size")
        .agg(F.count_distinct("trigram").alias("met")).filter("met = size")
    )
    clauses = alternatives.select("doc", "rule", "clause").distinct()
    return clauses.groupBy("doc", "rule").count().filter(F.col("count") == F.element_at(sizes, F.col("rule"))).select("doc", "rule")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, spans) for every row of docs (doc_id, text); other columns are ignored.

    `spans` is an array of (start, kind_no, end) by start and then rule order; code points, end exclusive. Null text is
    empty. Rows equal in doc_id and text are the same document: each gets the same spans. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        "doc_id", text.alias("text"),
        F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(text).alias("hash")).alias("doc"),
    )
    asked = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    full = [i for i in range(len(rules)) if i not in asked]
    scanned = keyed.select(
        "doc_id", "doc", (F.concat(*[_spans(rules[i], i, F.col("text")) for i in full]) if full else _none()).alias("scanned")
    )
    if asked:
        grams = sorted({g for q in asked.values() for clause in q for alt in clause for g in alt})
        ruled = candidates(postings(keyed, grams), asked, spark).groupBy("doc").agg(F.collect_set("rule").alias("rules"))
        checked = keyed.join(ruled, "doc").select(
            "doc",
            F.concat(*[
                F.when(F.array_contains("rules", i), _spans(rules[i], i, F.col("text"))).otherwise(_none()) for i in asked
            ]).alias("checked"),
        )
        checked = checked.groupBy("doc").agg(F.first("checked").alias("checked"))
        scanned = scanned.join(checked, "doc", "left").withColumn("scanned", F.concat("scanned", F.coalesce("checked", _none())))
    return scanned.select("doc_id", F.array_sort("scanned").alias("spans"))


def spans_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["end"])), ","
    )
