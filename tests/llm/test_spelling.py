import random
import zlib
from collections import Counter

import duckdb
import pytest

from candlespan.llm import spelling as S
from candlespan.llm.queries import ORACLES, op11_spelling_variants

SCHEMA = "doc_id long, text string, word string, n long, form string"


def edits(a, b):
    """The whole edit matrix."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def some_words(seed, n, letters="abé", least=6, most=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(letters, k=rng.randrange(least, most + 1))) for _ in range(n)})


def by_hand(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        letters = [c.lower() if c.isascii() else c for c in text or ""]
        word = ""
        for c in [*letters, " "]:
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                word += c
                continue
            if word:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
                if h % 199 == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                counts[word] += 1
            word = ""
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def got(spark, rows, size=S.SLICE):
    return sorted(map(tuple, S.spelling_variants(spark.createDataFrame(rows, SCHEMA), size).collect()), key=str)


def test_rows_of_the_band_equal_the_whole_matrix():
    words = some_words(1, 120, most=8, least=1)
    for query in words[::3]:
        for word in words:
            row, q = S.START, S.padded(query)
            for d, letter in enumerate(word[: len(query) + 1]):
                row = S.STEPS[8 * row + 4 * (letter == q[d]) + 2 * (letter == q[d + 1]) + (letter == q[d + 2])]
            if abs(len(query) - len(word)) < 2:
                assert row // (9, 3, 1)[len(query) - len(word) + 1] % 3 == min(2, edits(word, query))


def test_every_partner_that_shares_the_first_half_is_found():
    words = some_words(2, 1500)
    found = S.SortedWords(words, [1] * len(words))
    for query in words[::7]:
        want = [k for k, w in enumerate(words) if w[: S.half(query)] == query[: S.half(query)] and edits(w, query) == 1]
        assert found.near(query) == want


def test_prefixes_are_given_up_only_where_no_word_can_fit():
    words = some_words(3, 80, most=8)
    for query in words:
        fit = {w[:k] for w in words for k in range(len(w) + 1) if edits(w, query) <= 1}
        assert all(S.prefix_fits(p, query) for p in fit)


def corpus(seed):
    rng = random.Random(seed)
    base = some_words(seed, 60, "abcd", 6, 11)
    rows = []
    for i in range(300):
        line = []
        for _ in range(30):
            w = rng.choice(base[: rng.choice([2, 10, len(base)])])
            if rng.random() < 0.2:
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "É" + w[k + 1 :]])
            line.append(rng.choice([w, w.upper(), w + "s", w + "7"]))
        rows.append((i, rng.choice([" ", "-", "× ", "\n"]).join(line), "c", 1, None))
    return rows


def test_variants_equal_comparing_all_words(spark):
    rows = corpus(4)
    want = by_hand(rows)
    assert len(want) > 100 and any(r[1] for r in want)
    for size in (S.SLICE, 7):
        assert got(spark, rows, size) == want


def test_a_prefix_that_a_third_of_the_words_share(spark):
    rng = random.Random(6)
    hot = ["prefix" + "".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(120)]
    words = sorted({*hot, *some_words(6, 240, "abcdef", 6, 8)})
    rows = [(i, " ".join([w] * (5 + 40 * (i % 5 == 0))), "c", 1, None) for i, w in enumerate(words)]
    assert got(spark, rows, 10) == by_hand(rows)


def test_long_chains_lead_to_the_last_form(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"]
    rows = [(1000 + k, " ".join([w] * 5 ** (k + 1)), "c", 1, None) for k, w in enumerate(chain)]
    want = by_hand(rows)
    assert got(spark, rows) == want and [r[2] for r in want] == ["abbbbb"] * 6


def test_nulls_empty_and_long_texts_repeats_and_ties(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 50)
    rows = [(1, None, "x", 1, "y"), (2, "", None, None, None), (None, "ÀÉÎÕÜß àéîõüß " * 6, "x", 1, "y"), (3, "Anvile ANVIL1 anvils " * 9, "", 0, "")] * 2
    rows += [(9, "qwerty " * 25 + "qwertz " * 25 + "qwertx " * 5, "", 0, ""), (8, "w" * 300 + " word", "", 0, "")]
    assert got(spark, rows) == by_hand(rows)
    assert got(spark, []) == [] and got(spark, rows[:2]) == []


@pytest.mark.parametrize("seed", [7, 8])
def test_query_equals_its_sql(spark, tmp_path, seed):
    spark.createDataFrame(corpus(seed), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = op11_spelling_variants(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLES["op11_spelling_variants"])
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_no_copies_of_words_go_through_the_driver(spark, monkeypatch):
    plans, kept = [], S.stored

    def seen(df, name):
        out = kept(df, name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(S, "stored", seen)
    words = [("common", 700), ("commom", 100), ("commmm", 20), ("cammon", 5)]
    rows = [(i, f"{w} " * n, "", 0, "") for i, (w, n) in enumerate(words)]
    out = S.spelling_variants(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, out.collect()), key=str) == by_hand(rows)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    joins = [p for p in plans if "Join" in p]
    assert len(joins) >= 2 and not any("Broadcast" in p for p in joins)
