import random
import zlib
from collections import Counter

import numpy as np
import pytest

from candlespan.llm import toxicity as toxicity_module
from candlespan.llm.deobfuscate import SYMBOLS, Restorer, SymbolTable, language_model, restored_words, suspicious
from candlespan.llm.toxicity import clean_only, scored, symbol_counts, toxicity, train

WORDS = ["the", "garden", "is", "green", "letter", "summer", "of", "an", "old", "house", "window", "river", "stone", "and", "bread"]
BAD = ["stupid", "idiot", "moron", "vequabe", "vequado", "vequari", "vequtal"]


def corpus(n=600):
    rng = random.Random(0)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(3, 60))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randint(1, 3) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, score string, toxicity double").repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_symbol_counts_match_brute_force(spark, monkeypatch):
    texts = ["Ab é-c", None, "", "x" * 5000 + " " + "yé1" * 900]
    want = Counter()
    for t in texts:
        if t:
            s = [0, 0, 0, *[ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0 for c in t.lower()], 0, 0, 0]
            want.update(((s[i] * SYMBOLS + s[i + 1]) * SYMBOLS + s[i + 2]) * SYMBOLS + s[i + 3] for i in range(len(s) - 3))
    got = symbol_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {i: got[i] for i in np.flatnonzero(got)} == want
    monkeypatch.setattr(toxicity_module, "JOINED", 300)
    many = symbol_counts(spark.createDataFrame([(t,) for t in texts * 40], "text string").coalesce(1))
    assert (many == 40 * got).all()
    table, total = SymbolTable(), np.zeros(SYMBOLS**4, np.int64)
    table.counts(texts[3], total, chunk=7)
    table.counts(texts[0], total)
    assert (total == got).all()


def test_decoding_restores_disguises():
    table, total = SymbolTable(), np.zeros(SYMBOLS**4, np.int64)
    table.counts(" ".join(BAD + WORDS) * 20, total)
    cost = language_model(total)
    assert np.allclose(np.exp(-cost).sum(-1), 1, atol=1e-3)
    r = Restorer(cost)
    for hidden, meant in {"1d10t": "idiot", "stuuupid": "stupid", "m0r0n": "moron", "$tup1d": "stupid", "s t u p i d": "stupid", "summer": "summer"}.items():
        assert r.decode(hidden) == meant
    assert not suspicious("letter") and not suspicious("2024") and suspicious("l3tter")
    assert restored_words("an i-d-i-o-t, S T U P I D! 2024 1d10t!", r) >= {"an", "idiot", "stupid", "2024"}
    assert restored_words(None, r) == set() and restored_words("a " * 20_000, r) == {"a"}


def test_held_out_accuracy_and_disguised_words(tables, spark):
    rows, docs, labels = tables
    out = toxicity(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.5)
    wrong = [i for i, _, y in rows if got[i].predicted != y]
    assert len(wrong) <= 6
    texts = ["the garden is st00pid stup1d", "an old i d i o t and bread", "the veqquabe of vequari house", "the green letter", None, "", "M0R0N " + "river " * 20_000]
    model = train(docs, labels)
    test = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [int(r.toxicity >= 0.5) for r in scored(test, model).orderBy("doc_id").collect()] == [1, 1, 1, 0, 0, 0, 1]


def test_labels_of_held_out_rows_are_not_learnt(tables, spark):
    rows, docs, labels = tables
    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity(docs, labels).collect())) == sorted(map(tuple, toxicity(docs, turned).collect()))


def test_filter_keeps_columns_and_edge_cases(tables, spark):
    rows, docs, labels = tables
    kept = clean_only(docs, labels)
    assert kept.schema == docs.schema and abs(kept.count() - sum(1 - y for *_, y in rows)) <= 6
    assert toxicity(docs.limit(0), labels).collect() == []
    assert {r.score < 0.01 for r in toxicity(docs, labels.limit(0)).collect()} == {True}
    twice = spark.createDataFrame([(None, "x"), (None, "x"), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.held_out, r.predicted) for r in toxicity(twice, labels).collect()) == [(False, False, 0), (True, True, 0), (True, True, 0)]


def test_short_spaced_and_edge_marked_words_are_restored():
    table, total = SymbolTable(), np.zeros(SYMBOLS**4, np.int64)
    table.counts(" ".join(BAD + WORDS + ["tits", "noob", "ass", "shit"]) * 20, total)
    r = Restorer(language_model(total))
    for text, meant in {
        "t i t s!": "tits", "n o o b!!": "noob", "river a s s": "ass", "@ s s": "ass", "s h ! t": "shit", "s-h-i-+": "shit",
        "idio+": "idiot", "!diot": "idiot", "idiot!": "idiot", "i d i o t !": "idiot",
    }.items():
        assert meant in restored_words(text, r), text
    assert restored_words("green river!", r) == {"green", "river"} and restored_words("a - a - a", r) == {"a"}


def test_features_are_handed_on_in_parts(spark, tables, monkeypatch):
    _, docs, labels = tables
    whole = train(docs.coalesce(1), labels)
    monkeypatch.setattr(toxicity_module, "COUNTED", 7)
    parts = train(docs.coalesce(1), labels)
    assert len(whole.precision) > 7 and parts.precision == whole.precision and (parts.cost == whole.cost).all()
    assert parts.weights == pytest.approx(whole.weights, abs=1e-3) and parts.bias == pytest.approx(whole.bias, abs=1e-3)
