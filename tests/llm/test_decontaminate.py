import random

import pytest

from candlespan.llm.decontaminate import benchmark_hits, decontaminate
from candlespan.llm.suffix_automaton import SuffixAutomaton, words_of


def brute(text, items, window):
    words = words_of(text)
    hit, names = set(), set()
    for name, item in items:
        own = words_of(item)
        size = min(window, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                names.add(name)
    return len(words), sorted(hit), sorted(names)


def case(seed, alphabet, n_items=12, n_docs=60):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    items = [(str(i), text(rng.choice([0, 1, 2, 3, 5, 8, 12, 20]))) for i in range(n_items)]
    docs = [text(rng.randint(0, 40)) for _ in range(n_docs)]
    docs += [text(3) + " " + rng.choice(items)[1] + "! " + text(5) for _ in range(n_docs)]
    return items, docs


@pytest.mark.parametrize("seed,alphabet,window", [(0, "ab", 4), (1, "abcdef", 4), (2, "abcd", 10), (3, ["the", "The", "é", "É", "x1"], 3)])
def test_automaton_matches_brute_force(seed, alphabet, window):
    items, docs = case(seed, alphabet)
    automaton = SuffixAutomaton(items, window)
    for text in docs:
        words = words_of(text)
        spans, names = automaton.scan(words)
        assert (len(words), [i for a, b in spans for i in range(a, b)], sorted(names)) == brute(text, items, window)


@pytest.mark.parametrize("block_words", [300_000, 40])
def test_hits_in_one_or_several_automata(spark, block_words):
    items, texts = case(5, "abcde")
    texts += [None, "", "?!", items[6][1], "é " * 20_000]
    docs = spark.createDataFrame([(i, t, "f", 0) for i, t in enumerate(texts)], "doc_id long, text string, found string, items int")
    bench = spark.createDataFrame([(n, t, 1) for n, t in items] + [(None, None, 1)], "item_id string, text string, doc_id int")
    got = {r.doc_id: (r.found.n_words, r.found.n_hit, list(r.found["items"])) for r in benchmark_hits(docs, bench, 4, block_words).collect()}
    want = {i: brute(t, items, 4) for i, t in enumerate(texts)}
    assert got == {i: (n, len(h), names) for i, (n, h, names) in want.items()}


def test_cuts_spans_and_drops_covered_documents(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    texts = [passage, "Clean text stays, all of it.", " ".join(["word"] * 40) + f" start {passage.upper()}; " + "after", None, ""]
    docs = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, found string, n_chars int")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(docs, bench).collect()}
    assert sorted(got) == [1, 2, 3, 4] and list(got[1].asDict()) == docs.columns
    assert got[1].text == texts[1] and got[3].text is None and got[4].text == ""
    assert got[2].text == " ".join(["word"] * 40) + " start ; after" and got[2].n_chars == len(got[2].text) and got[2].found == "s"


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert benchmark_hits(docs.limit(0), bench).collect() == []
    assert [r.found.n_hit for r in benchmark_hits(docs, bench.limit(0)).collect()] == [0]
    assert decontaminate(docs, bench.limit(0)).collect() == docs.collect()


@pytest.mark.parametrize("block_words", [300_000, 4])
def test_columns_named_like_the_operators_own(spark, block_words):
    bench = spark.createDataFrame([("i1", "one two three four five"), ("i2", "six seven eight nine ten")], "item_id string, text string")
    rows = [(1, "x one two three four five y z w v u t s", "a", "b", "c"), (2, "none of it", "d", "e", "f"), (2, "none of it", "d", "e", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string, found string, Found_Before string")
    got = decontaminate(docs, bench, 4, block_words=block_words)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted([(1, "x  y z w v u t s", "a", "b", "c"), *rows[1:]])
