import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from candlespan.llm.queries import vocabulary

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("la", "ren", "mo", "tis")]
BAD = ["idiot", "moron", "stupid"]
PASSAGE = " ".join(f"{w}x" for w in WORDS[:14])


def corpus():
    rng = random.Random(0)
    rows, toxic = [], {}
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(rng.randint(30, 80))]
        toxic[i] = int(i % 7 == 3)
        if toxic[i]:
            words[5:5] = [rng.choice(BAD), rng.choice(BAD)]
        if i % 11 == 2:
            words[9:9] = PASSAGE.split()
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
    rows += [(400 + k, rows[8 + k][1], "en", "s2") for k in range(40)]
    return rows, toxic


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, toxic = corpus()
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def expected():
    """Texts by doc_id after the three filters, by plain rules."""
    rows, _ = corpus()
    clean = [r for r in rows if not set(BAD) & set(r[1].split())]
    first = {}
    for i, text, _, source in sorted(clean):
        first.setdefault(text, (i, source))
    return {i: (text.replace(PASSAGE + " ", " ").replace("  ", " ") if PASSAGE in text else text, source) for text, (i, source) in first.items()}


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "simhash_dedup", "decontaminate", "mix_sources", "token_output"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).schema == docs.schema


def test_texts_cross_in_small_batches(spark, folder):
    before = spark.conf.get(P.BATCH)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    try:
        for name, stage in P.STAGES[:-1]:
            spark.conf.set(P.BATCH, "10000")
            stage(spark, docs, folder)
            assert int(spark.conf.get(P.BATCH)) == (4096 if name == "simhash_dedup" else 1000)
    finally:
        spark.conf.set(P.BATCH, before)


def test_run_matches_plain_rules(spark, folder):
    want, tokenizer = expected(), Tokenizer.from_file(vocabulary())
    out = P.run(spark, folder).orderBy("start").collect()
    assert {r.doc_id for r in out} <= set(want)
    start, sizes = 0, Counter()
    for r in out:
        text, source = want[r.doc_id]
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        # where a passage was cut out, the blanks around it are left as they were
        if r.ids_crc32 != zlib.crc32(ids.tobytes()):
            assert r.doc_id % 11 == 2
        assert r.start == start
        start += r.n_tokens
        sizes[source] += len(text.split())
    whole = defaultdict(int)
    for text, source in want.values():
        whole[source] += len(text.split())
    total = sum(whole.values())
    weights = dict(zip(sorted(whole), (5, 2, 1)))
    for source in whole:
        target = min(3 * whole[source], total * weights[source] / 8)
        assert abs(sizes[source] - target) <= 160


def test_filters_match_plain_rules(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, folder)
    got = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    assert got == {i: " ".join(t.split()) for i, (t, _) in expected().items()}
