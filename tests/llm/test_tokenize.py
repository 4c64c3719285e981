import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from candlespan.llm.queries import vocabulary
from candlespan.llm.token_files import ShardReader, ShardWriter
from candlespan.llm.tokenize import PieceEncoder, token_output, write_shards

TEXTS = [
    None, "", " ", "a", "  a  b ", "it's  we'll 've\n\n x \t y", "x <|endoftext|> y<|endoftext|>", "é 😀  ñ z  q 　w", "tab\t x\r\n \x1c y \x85 z",
    "1234 5 678 !?  ... (a) ", "word " * 20_000, "‍ ﷺ ²³ ½ Ⅷ 한국어 中文 字", "a" * 30_000,
]


TOKENIZER = Tokenizer.from_file(vocabulary())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_equal_whole_texts():
    rng = random.Random(0)
    bits = [" ", " ", ",", "ä", "  ", "\n", "\t", "'s", "'", "a", "B", "é", "1", "22", ".", "<|endoftext|>", " ", "\x1c", " ", "😀", "\x85", "word"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    texts += ["x" * 9_000_000 + " y", "\x00 a \x00b"]
    want = [ids_of(t)[:-1] for t in texts]
    for remembered in (1 << 30, 1 << 10):
        encoder = PieceEncoder(vocabulary(), remembered)
        for part in (texts, texts[::-1]):
            got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(pa.array(part, pa.large_string()))]
            assert got == (want if part is texts else want[::-1])
    assert list(encoder.encode(pa.array([], pa.large_string()))) == []


def test_remembered_pieces_are_numbers_into_one_array():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé1") for _ in range(rng.randint(1, 14))) for _ in range(90_000)]
    texts = [" ".join(words[i : i + 3000]) for i in range(0, len(words), 3000)] + ["x.\n" + "\n".join(words[:500]), "$" * 40 + "\n\n", ""]
    encoder = PieceEncoder(vocabulary(), size=1 << 16)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(pa.array(texts, pa.large_string()))]
        assert got == [ids_of(t)[:-1] for t in texts]
    # more than the arrays first have room for; no piece is an object of its own besides its text and number
    assert len(encoder.known) > 1 << 16 and sorted(encoder.known.values()) == list(range(len(encoder.known)))
    for piece, k in list(encoder.known.items())[:2000]:
        ids = encoder.flat[encoder.starts[k] : encoder.starts[k + 1]].tolist()
        assert TOKENIZER.decode(ids) == piece and encoder.size > 150 * len(encoder.known)


def expected(rows):
    out, start = [], 0
    for i, t in rows:
        ids = np.array(ids_of(t), "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip_through_spark(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, start int, shard string").repartition(4)
    got = token_output(docs, vocabulary())
    assert sorted(map(tuple, got.collect())) == expected(rows)
    assert token_output(docs.limit(0), vocabulary()).collect() == []


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "b"), (5, "b"), (None, "a"), (-2, "c"), (2**62, "d")], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_output(docs, vocabulary()).collect())
    assert got == [(0, None, 2), (2, -2, 2), (4, 5, 2), (6, 5, 2), (8, 2**62, 2)]


def test_one_document_from_a_shard(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(300)], "doc_id long, text string")
    manifest = write_shards(docs, f"file://{tmp_path}/t", vocabulary()).collect()
    assert sum(r.n_docs for r in manifest) == 300
    found = [(ShardReader(r.path), r) for r in manifest]
    for doc_id in (0, 17, 299):
        (ids,) = [reader.tokens(k).tolist() for reader, _ in found for k in reader.find(doc_id)]
        assert ids == ids_of("word " * (doc_id + 1))


def test_frames_are_independent_and_checked(tmp_path):
    path = f"file://{tmp_path}/a.tok"
    w, docs = ShardWriter(path, frame_bytes=100), [np.arange(n, dtype="<u4") for n in (0, 3, 50, 1, 2000, 2)]
    for i, d in enumerate(docs):
        w.add(i, d.tobytes(), zlib.crc32(d.tobytes()))
    assert w.close() == sum(map(len, docs))
    reader = ShardReader(path)
    assert len(reader.frames) > 2 and all((reader.tokens(i) == d).all() for i, d in enumerate(docs))
    raw = (tmp_path / "a.tok").read_bytes()
    # a plain reader of zstandard passes over the skippable frames
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole == b"".join(d.tobytes() for d in docs)
    bad = bytearray(raw)
    bad[int(reader.starts[1]) + 12] ^= 1
    (tmp_path / "b.tok").write_bytes(bytes(bad))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        ShardReader(f"file://{tmp_path}/b.tok").frame(1)
    assert (ShardReader(f"file://{tmp_path}/b.tok").tokens(1) == docs[1]).all()
