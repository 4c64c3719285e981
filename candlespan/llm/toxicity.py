"""Toxicity of documents after restoring disguised words.

A character model is counted over all documents. Words and word beginnings whose presence goes with toxic labels are found by a
likelihood-ratio test, and a logistic regression over their presence gives the score. Only the learning uses labels, and of
these only rows whose crc32(doc_id as text) mod 5 is not 0, at most about `TRAIN_ROWS` of them, drawn by a hash of the doc_id.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlespan.llm.common import drawn, kept_in_worker, release, spare_name, stored
from candlespan.llm.deobfuscate import SYMBOLS, WORD, Restorer, SymbolTable, forms, language_model, restored_words, skeleton, spaced_words

TRAIN_ROWS = 20_000
#: Words whose forms a worker remembers before it forgets them all.
REMEMBERED = 300_000
#: Characters of texts whose four-grams are counted together.
JOINED = 1 << 20
#: Different features a task counts before it hands the counts on.
COUNTED = 100_000
#: Likelihood ratio (twice the log) a feature must reach, and the most features kept, the strongest first.
LEAST_RATIO = 15.0
MOST_FEATURES = 4000
#: Lengths of word beginnings that are features, and how many different words with one count apart.
BEGINNINGS = (4, 5, 6, 7, 8)
MOST_TOGETHER = 4
#: A document also has a feature for each of these precisions that one of its features reaches, so that what is learnt of all
#: telling words holds for a word that seldom comes alone.
LEVELS = (0.5, 0.7, 0.85, 0.95)
WORD_RIDGE, LEVEL_RIDGE = 1.0, 0.05


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def symbol_counts(docs: DataFrame) -> np.ndarray:
    """Four-gram counts over all texts. Each task sums its own; what reaches the driver has at most SYMBOLS ** 4 rows."""

    def count(batches):
        kept_in_worker("toxicity")
        table, total = SymbolTable(), np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            texts = [t for t in batch["text"] if t]
            ends = np.cumsum([len(t) for t in texts]) // JOINED
            for some in np.split(np.array(texts, object), np.flatnonzero(np.diff(ends)) + 1):
                # six breaks between two texts are the three after one and before the next, and hold three four-grams of breaks alone
                if len(some):
                    table.counts((" " * 6).join(some), total)
                    total[0] -= 3 * (len(some) - 1)
            release()
        code = np.flatnonzero(total)
        yield pd.DataFrame({"code": code, "n": total[code]})

    rows = docs.select("text").mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**4, np.int64)
    for r in rows:
        out[r[0]] = r[1]
    return out


def level(x: float) -> str:
    return f"|{x}"


def features(words: set[str]) -> set[str]:
    """Whole words, and the beginnings of longer ones with a bar and the number of different words, up to `MOST_TOGETHER`, that a
    document has with it: one word of a frequent beginning says less than several."""
    out = set(words)
    for n in BEGINNINGS:
        seen = Counter([w[:n] for w in words if len(w) > n])
        out.update([b + "|1" for b in seen])
        out.update([f"{b}|{i}" for b, k in seen.items() if k > 1 for i in range(2, min(k, MOST_TOGETHER) + 1)])
    return out


@dataclass
class Model:
    #: Weight and precision of each feature: the share of toxic documents among the training documents that have it.
    weights: dict[str, float]
    precision: dict[str, float]
    bias: float
    cost: np.ndarray

    def __post_init__(self):
        self.restorer = Restorer(self.cost)
        # features start with one of these, so other words cannot matter
        self.heads = {f.partition("|")[0][: min(BEGINNINGS)] for f in self.precision}
        #: The forms that can matter of words seen before, mostly none.
        self.seen: dict[str, frozenset[str]] = {}
        self.skeletons = {skeleton(f.partition("|")[0]) for f in self.precision}

    def doubled(self, word: str) -> bool:
        bare = skeleton(word)
        return bare in self.skeletons or any(bare[:n] in self.skeletons for n in range(2, max(BEGINNINGS) + 1))

    def telling(self, text: str | None) -> set[str]:
        """Those of a text's restored words that may have a feature."""
        low, seen, out = (text or "").lower(), self.seen, set()
        if len(seen) > REMEMBERED:
            seen.clear()
        words = set(WORD.findall(low))
        for w in words:
            if (known := seen.get(w)) is None:
                known = seen[w] = self._own(forms(w, self.restorer, self.doubled))
            if known:
                out |= known
        return out | self._own(spaced_words(low, self.restorer))

    def _own(self, words: set[str]) -> frozenset[str]:
        return frozenset(w for w in words if w[: min(BEGINNINGS)] in self.heads)

    def present(self, text: str | None) -> list[str]:
        """The model's features in a text, and the precision levels that the best of them reaches."""
        own = sorted(features(self.telling(text)) & self.precision.keys())
        best = max([self.precision[f] for f in own], default=0.0)
        return own + [level(x) for x in LEVELS if best >= x]

    def score(self, text: str | None) -> float:
        x = self.bias + sum(self.weights.get(f, 0.0) for f in self.present(text))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _regression(rows: list[tuple[list[int], int]], ridge: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge on the weights: Newton steps, each solved by conjugate gradients."""
    n, y = len(ridge), np.array([t for _, t in rows], float)
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    feature = np.array([f for fs, _ in rows for f in fs], int)
    w = np.zeros(n + 1)  # the last one is the bias
    w[n] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.append(ridge, 1e-6)
    forward = lambda x: x[n] + np.bincount(doc, x[feature], len(rows))
    back = lambda r: np.append(np.bincount(feature, r[doc], n), r.sum())
    loss = lambda x: np.logaddexp(0, forward(x)).sum() - (y * forward(x)).sum() + 0.5 * (penalty * x * x).sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        grad, curve = back(p - y) + penalty * w, p * (1 - p)
        step, rest = np.zeros(n + 1), -grad
        towards, size = rest.copy(), rest @ rest
        for _ in range(60):
            if size < 1e-10:
                break
            bent = back(curve * forward(towards)) + penalty * towards
            t = size / (towards @ bent)
            step, rest = step + t * towards, rest - t * bent
            size, old = rest @ rest, size
            towards = rest + size / old * towards
        part, now = 1.0, loss(w)
        while loss(w + part * step) > now and part > 1e-4:
            part /= 2
        w = w + part * step
        if np.abs(grad).max() < 1e-4:
            break
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic). Labels that are null or of null doc_ids are left out; a document
    with several labels is toxic if one says so. Without labelled rows every score is 0."""
    spark = docs.sparkSession
    cost = language_model(symbol_counts(docs))
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    taught = drawn(marked, marked.count(), train_rows, "doc_id")
    sample = stored(docs.select("doc_id", "text").join(taught, "doc_id").select("text", "toxic"), "toxic-sample")
    sent = spark.sparkContext.broadcast(cost)

    def count(batches):
        kept_in_worker("toxicity")
        restorer, tally, rows = Restorer(sent.value), (Counter(), Counter()), [0, 0]

        def counted():
            both = [f for f in tally[0].keys() | tally[1].keys() if f]
            # the empty name carries the number of documents
            out = pd.DataFrame({
                "feature": ["", *both], "clean": [rows[0], *map(tally[0].__getitem__, both)], "toxic": [rows[1], *map(tally[1].__getitem__, both)],
            })
            tally[0].clear(), tally[1].clear()
            rows[:] = 0, 0
            return out

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                tally[toxic].update(features(restored_words(text, restorer)))
                rows[toxic] += 1
                # a feature's counts are summed over all that is handed on, so they may come in several parts
                if len(tally[0]) + len(tally[1]) >= COUNTED:
                    yield counted()
        yield counted()
        release()

    seen = sample.mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seen = stored(seen, "toxic-features")
    size = seen.filter("feature = ''").first()
    if not size or not size.clean + size.toxic:
        return Model({}, {}, -30.0, cost)
    # twice the log-likelihood ratio of "present" given toxic against given clean
    a, b, na, nb = F.col("toxic").cast("double"), F.col("clean").cast("double"), float(size.toxic), float(size.clean)
    rate, plog = (a + b) / (na + nb), lambda x, p: F.when(x > 0, x * F.log(p)).otherwise(0.0)
    fit = lambda p, q: plog(a, p) + plog(na - a, 1 - p) + plog(b, q) + plog(nb - b, 1 - q)
    ratio = 2 * (fit(a / max(na, 1.0), b / max(nb, 1.0)) - fit(rate, rate))
    strong = seen.filter((F.col("feature") != "") & (a / max(na, 1.0) > 2 * b / max(nb, 1.0))).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
    kept = strong.orderBy(F.desc("ratio"), "feature").limit(MOST_FEATURES).collect()
    precision = {r.feature: (r.toxic + 0.1) / (r.toxic + r.clean + 0.5) for r in kept}
    draft = spark.sparkContext.broadcast(Model({}, precision, 0.0, cost))
    names = [*precision, *map(level, LEVELS)]
    place = {f: i for i, f in enumerate(names)}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def present(texts: pd.Series) -> pd.Series:
        kept_in_worker("toxicity")
        return pd.Series([draft.value.present(t) for t in texts])

    rows = sample.select(present("text"), "toxic").collect()
    ridge = np.array([WORD_RIDGE] * len(precision) + [LEVEL_RIDGE] * len(LEVELS))
    w, bias = _regression([([place[f] for f in r[0]], r[1]) for r in rows], ridge)
    return Model(dict(zip(names, w.tolist())), precision, bias, cost)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with a column `toxicity` between 0 and 1; null texts are scored like empty ones."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        kept_in_worker("toxicity")
        out = pd.Series([sent.value.score(t) for t in texts], dtype="float64")
        release()
        return out

    return docs.withColumn("toxicity", score.asNondeterministic()("text"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text); other columns are ignored.

    Repeated rows get the same score; a null doc_id counts as held out. An empty table gives no rows.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


def clean_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is below 0.5; the columns stay as they are."""
    names = [F.col(f"`{n}`") for n in docs.columns]
    aside = spare_name("toxicity_before", docs)
    inner = docs.withColumnRenamed("toxicity", aside)
    kept = scored(inner, train(docs.select("doc_id", "text"), labels)).filter("toxicity < 0.5").drop("toxicity")
    return kept.withColumnRenamed(aside, "toxicity").select(*names)
