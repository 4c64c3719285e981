import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candlespan.llm import bpe
from candlespan.llm.queries import op13_bpe_round_trip, word_vocabulary

LIBRARY = Tokenizer.from_file(word_vocabulary())
CODER = bpe.WordBpe(word_vocabulary())
BITS = [
    *"aAbBsStT'  \n\t.,!?<|>10½²ŸßÄö　中あ한가\x1c\x85\xa0Σσİ̈́", "<|endoftext|>", "<|startoftext|>",
    "<|EndOfText|>", "'ll", "'RE", "aaaa", "word", "\U0001f600", "͸", "ﬁ", "Å", "ᾳ", "\x00",
]
TEXTS = [None, "", " ", "\n\n", "a", "a<|endoftext|>b <|startoftext|>", "ΟΣ Σ", "it's WE'LL", "é ́", "aaaaaaa " * 50, "x" * 5000, "123 4"]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def both(texts):
    ids, n = CODER.encode(texts)
    lists = pa.ListArray.from_arrays(pa.array([0, *n.cumsum().tolist()], pa.int32()), pa.array(ids))
    return list(zip(lists.to_pylist(), CODER.decode(lists).to_pylist()))


def test_equals_the_library_on_random_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(30))) for _ in range(5000)]
    assert both(texts) == [expected(t) for t in texts]


def test_every_character_that_is_not_left_to_the_library():
    texts = [f"a{chr(c)}1 {chr(c)}Bc" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not bpe.ODD.search(chr(c))]
    assert len(texts) > 30_000 and both(texts) == [expected(t) for t in texts]


def test_merging_one_place_at_a_time_gives_the_same(monkeypatch):
    monkeypatch.setattr(CODER, "rising", False)
    texts = ["banana aaaaaaa mississippi", "x" * 300]
    assert both(texts) == [expected(t) for t in texts]


def test_rounds_equal_merging_by_hand():
    merges = {k: (r, m) for k, r, m in zip(CODER.keys.tolist(), CODER.ranks.tolist(), CODER.made.tolist())}
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdeinrst", k=rng.randrange(1, 14))) for _ in range(500)})
    flat, sizes = CODER.merged(words)
    want = []
    for w in words:
        symbols = [int(CODER.inner[b]) for b in w[:-1].encode()] + [int(CODER.last[ord(w[-1])])]
        while pairs := [(merges[k][0], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (k := a * CODER.size + b) in merges]:
            _, i = min(pairs)
            symbols[i : i + 2] = [merges[symbols[i] * CODER.size + symbols[i + 1]][1]]
        want.append(symbols)
    assert flat.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]


def test_long_texts_are_cut_only_where_nothing_changes(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 40)
    rng = random.Random(7)
    text = "".join(rng.choices(BITS, k=2000))
    parts = bpe.cut_long(text, 40)
    assert len(parts) > 10 and "".join(parts) == text
    assert sum((ids for ids, _ in both(parts)), []) == expected(text)[0]
    assert bpe.cut_long("y" * 100, 40) == ["y" * 100]


def test_tables_with_nulls_ties_and_clashing_columns(spark, monkeypatch):
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)] + [(None, "A b", 0, "y"), (None, "A b", 0, "y"), (3, "again", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long, decoded string")
    got = bpe.encode_texts(docs, word_vocabulary(), decoded=True)
    assert got.columns == ["doc_id", "ids", "decoded"]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(d, *expected(t)) for d, t, _, _ in rows], key=key)
    back = bpe.decode_ids(got, word_vocabulary())
    assert back.exceptAll(got.select("doc_id", F.col("decoded").alias("text"))).count() == 0
    assert bpe.encode_texts(docs.limit(0), word_vocabulary(), decoded=True).collect() == []


def test_decoding_leaves_out_ids_without_a_token(spark):
    ids = LIBRARY.encode("two words", add_special_tokens=False).ids
    coded = spark.createDataFrame([(1, None), (2, []), (3, [-1, ids[0], None, 1 << 30, ids[1]])], "doc_id long, ids array<int>")
    assert dict(bpe.decode_ids(coded, word_vocabulary()).collect()) == {1: "", 2: "", 3: LIBRARY.decode(ids, skip_special_tokens=False)}


def test_other_schemes_are_refused():
    from candlespan.llm.queries import vocabulary

    with pytest.raises(ValueError):
        bpe.WordBpe(vocabulary())


def test_query_digests(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op13_bpe_round_trip(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        ids, text = expected(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
