import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from candlespan.llm import language_model as lm
from candlespan.llm.elias_fano import EliasFano, Trie


@pytest.mark.parametrize("n,universe", [(0, 1), (0, 10), (1, 1 << 64), (3, 1 << 64), (500, 501), (500, 1 << 20), (300, 1 << 63), (1000, 7)])
def test_sequences_and_successor_search(n, universe):
    rng = random.Random(n)
    values = sorted(rng.randrange(universe) for _ in range(n))
    fano = EliasFano.build(np.array(values, np.uint64), universe)
    assert fano.values().tolist() == values
    asked = sorted({*values, *[min(v + 1, universe - 1) for v in values], *[rng.randrange(universe) for _ in range(200)], 0, universe - 1})
    at, equal = fano.successor(np.array(asked, np.uint64))
    for x, i, e in zip(asked, at.tolist(), equal.tolist()):
        assert i == sum(v < x for v in values) and e == (x in values)


def test_three_level_trie_round_trip():
    rng = random.Random(0)
    words = sorted(rng.getrandbits(64) for _ in range(40))
    grams = sorted({(rng.randrange(12), rng.randrange(40), rng.randrange(40)) for _ in range(600)})
    ones = sorted({g[:1] for g in grams})
    twos = sorted({g[:2] for g in grams})
    levels = [
        (np.zeros(len(ones), int), np.array([g[0] for g in ones]), {"v": np.arange(len(ones))}),
        (np.array([ones.index(g[:1]) for g in twos]), np.array([g[1] for g in twos]), {"v": np.arange(len(twos))}),
        (np.array([twos.index(g[:2]) for g in grams]), np.array([g[2] for g in grams]), {"v": np.arange(len(grams), dtype=np.uint16)}),
    ]
    trie = Trie.open(Trie.build(np.array(words, np.uint64), levels).pack())
    assert trie.word(np.array([words[3], words[3] + 1, words[39]], np.uint64)).tolist() == [3, -1, 39]
    asked = grams + [(rng.randrange(12), rng.randrange(40), rng.randrange(40)) for _ in range(300)]
    node = np.zeros(len(asked), int)
    for k in range(3):
        node = trie.child(k, node, np.array([g[k] for g in asked]))
    place = {g: i for i, g in enumerate(grams)}
    assert node.tolist() == [place.get(g, -1) for g in asked]
    start, end = trie.children(1)
    assert [(twos[a][0], twos[b - 1][0]) for a, b in zip(start, end)] == [(g[0], g[0]) for g in ones]


def rows(seed=0, n=250):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "The", "the", "x\x1cy"]
    out = []
    for i in range(n):
        text, last = [], 0
        for _ in range(rng.randint(0, 80)):
            last = (last * 3 + rng.randrange(3)) % len(words)  # a Markov chain, so that contexts tell
            text.append(words[last])
        out.append((i * 7, rng.choice([" ", "\n", " \t"]).join(text)))
    return out + [(None, "The  end"), (None, "The  end"), (3, None), (4, ""), (5, "q " * 5000), (6, "z" * 50_000), (6, "z" * 50_000)]


def words_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


def brute(data, kappa):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in data]
    texts = [words_of(t) for _, t in data]
    train = [t for t, h in zip(texts, held) if not h]
    one, two = Counter(w for t in train for w in t), Counter(("<", t[0]) for t in train)
    two += Counter(p for t in train for p in zip(t, t[1:]))
    n, v = sum(one.values()), len(one)
    context = one.copy()
    context["<"] = len(train)
    out = []
    for (i, _), t, h in zip(data, texts, held):
        p1 = [(one[w] + 0.5) / (n + 0.5 * (v + 1)) for w in t]
        pairs = list(zip(["<", *t], t))
        score = sum(math.log10(p if kappa == math.inf else (two[a] + kappa * p) / (context[a[0]] + kappa)) for a, p in zip(pairs, p1))
        out.append((i, h, len(t), sum(one[w] > 0 for w in t), n, sum(map(math.log10, p1)), score))
    return out


@pytest.mark.parametrize("block,shard", [(1_000_000, 4_000_000), (300, 2000)])
def test_scores_match_brute_force(spark, block, shard):
    data = rows()
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in data], "doc_id long, text string, block string, shard int").repartition(5)
    key = lambda r: (r[0] is None, r[0], r[2])
    got = sorted(map(tuple, lm.scored(docs, block, shard).collect()), key=key)
    best = min((brute(data, k) for k in lm.KAPPAS), key=lambda out: sum(abs(g[6] - w[6]) for g, w in zip(got, sorted(out, key=key))))
    assert len(got) == len(data)
    for g, w in zip(got, sorted(best, key=key)):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
        # a byte holds a probability to within a sixty-fourth of a decade
        assert abs(g[6] - w[6]) <= g[2] / 64 + 1e-6
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_probabilities_sum_to_one(spark):
    counts = np.array([3, 1, 6])
    p = lm.PROBABILITY[lm.quantised(counts / 10)]
    assert np.allclose(np.log10(p), np.log10(counts / 10), atol=1 / 64 + 1e-9)
    assert lm.PROBABILITY[lm.NONE] == 0


def test_empty_table_and_no_training_rows(spark):
    docs = spark.createDataFrame(rows()[:9], "doc_id long, text string")
    assert lm.scored(docs.limit(0)).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = lm.scored(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert tuple(r)[:5] == (only, True, 3, 0, 0) and r.score == r.base_score == 0
