"""BPE encoding and decoding with a tokenizers file whose words carry an end mark, by batched merge rounds in numpy.

The distinct words of a slice of texts lie end to end in one flat array of symbols. Every round finds the lowest-ranked pair of each
word, by binary search of the pairs' keys among the sorted keys of all merges, and merges it in all words at once; words without a
pair left leave the array. Only pairs beside a merged symbol are looked up again. Ids are then dealt out to the texts by position.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlespan.llm.common import kept_in_worker, release, subset

#: The one scheme whose words are found here; files with another one have their words found by the library.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
]}
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = regex.compile(WORD)
#: Characters whose class, lower case and composition are old enough to be the same in every library; texts with others go to the
#: library's own normaliser and splitter, line by line.
ODD = regex.compile(
    r"[^\x00-\x1B\x20-\x7E\xA0-\u024F\u0300-\u036F\u0391-\u03A9\u03B1-\u03C9\u0410-\u045F\u0490-\u04BF\u2010-\u2027\u2030-\u205E\u20AC"
    r"\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]"
)
#: Characters worked on at a time.
SLICE = 2 << 20
NONE = np.iinfo(np.int32).max


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordBpe:
    """Encodes and decodes like the tokenizers library with the same file and add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        fits = (
            model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and len(steps) == 2 and byte_level.items() <= steps[1].items() and spec["decoder"] is None
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        if not fits:
            raise ValueError(f"{path} is not a byte-level BPE file of the kind that is read here")
        split = {"type": "Split", "pattern": {"Regex": WORD}, "behavior": "Removed", "invert": True}
        self.known = spec["normalizer"] == NORMALIZER and steps[0] == split
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._tables(model)

    def _tables(self, model: dict) -> None:
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        chars = byte_chars()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int64)
        self.last = np.array([vocab.get(c + end, -1) for c in chars], np.int64)
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        tokens: list[str | None] = [None] * self.size
        for token, i in [*vocab.items(), *self.added.items()]:
            tokens[i] = token
        self.tokens = pa.array(tokens, pa.string())
        merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges[vocab[a] * self.size + vocab[b]] = rank, vocab[a + b]
        self.keys = np.array([*sorted(merges), np.iinfo(np.int64).max])
        rank, made = np.array([merges[k] for k in self.keys[:-1].tolist()] + [(NONE, -1)]).T
        self.ranks, self.made = rank.astype(np.int32), made
        # a merge never makes a pair of lower rank than its own, so that all its places in a word may be merged in one round
        first_use = np.full(self.size, NONE, np.int64)
        for side in (self.keys[:-1] // self.size, self.keys[:-1] % self.size):
            np.minimum.at(first_use, side, rank[:-1])
        self.rising = bool((first_use[made[:-1]] > rank[:-1]).all())

    def words(self, text: str) -> list[str]:
        """The words of a text; those that are an added token are that token."""
        if self.cut and (parts := self.cut.split(text))[1:]:
            return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if self.known and not ODD.search(text):
            return WORDS.findall(unicodedata.normalize("NFC", text).replace("\u03A3", "\u03C3").lower())
        # white space is dropped anyway, and nothing composes or joins over a line end
        lines = text.split("\n") if self.known else [text]
        return [self._text(w) for line in lines for w, _ in self.split(self.normalize(line))]

    def _text(self, word: str) -> str:
        return bytes(map(self.byte_of.__getitem__, word)).decode()

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that start at these positions; NONE where there is no merge or the word ends."""
        nxt = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] * self.size + symbols[nxt]
        place = np.searchsorted(self.keys, key)
        fits = (self.keys[place] == key) & (word[at] == word[nxt]) & (nxt > at)
        return np.where(fits, self.ranks[place], NONE), self.made[place]

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words end to end, and how many each has."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols, word = self.inner[data], np.repeat(np.arange(len(raw)), sizes)
        symbols[np.cumsum(sizes)[sizes > 0] - 1] = self.last[data[np.cumsum(sizes)[sizes > 0] - 1]]
        for k in [k for k, w in enumerate(words) if w in self.added]:  # few: each stands once among distinct words
            own = np.flatnonzero(word == k)
            symbols[own], symbols[own[0]] = -1, self.added[words[k]]
        symbols, word = symbols[symbols >= 0], word[symbols >= 0]
        done_symbols, done_words = [], []
        rank, made = self._pairs(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            over = least == NONE
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            at = np.flatnonzero((rank == least) & ~over)
            if not self.rising:
                at = at[np.unique(word[at], return_index=True)[1]]
            # of a run of equal symbols every second pair from its start is merged
            begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbols[at] = made[at]
            keep = ~over
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, word, rank, made = symbols[keep], word[keep], rank[keep], made[keep]
            again = np.unique(np.concatenate([place[at], place[at] - 1]))
            again = again[again >= 0]
            rank[again], made[again] = self._pairs(symbols, word, again)
        if not done_words:
            return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
        word = np.concatenate(done_words)
        return np.concatenate(done_symbols)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(raw))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts end to end, and how many each has."""
        words: list[str] = []
        ends = []
        for text in texts:
            words += self.words(text)
            ends.append(len(words))
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        flat, sizes = self.merged(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        counts = sizes[index]
        total = np.append(0, np.cumsum(counts))
        # the place of each id: the start of its word's ids, and how far it is inside the word
        place = np.repeat((np.cumsum(sizes) - sizes)[index] - total[:-1], counts) + np.arange(total[-1])
        return flat[place].astype(np.int32), np.diff(total[ends], prepend=0)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Each list's tokens joined by blanks; ids without a token are left out."""
        index = ids.flatten()
        index = pc.if_else(pc.and_(pc.greater_equal(index, 0), pc.less(index, self.size)), index, None)
        tokens = pc.take(self.tokens, index)
        if tokens.null_count:
            held = np.append(0, np.cumsum(tokens.is_valid().to_numpy(zero_copy_only=False)))
            offsets = held[ids.offsets.to_numpy() - ids.offsets[0].as_py()]
            tokens = tokens.drop_null()
        else:
            offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")


def cut_long(text: str, size: int) -> list[str]:
    """The text in parts of about `size` characters, cut before a blank or line end: no word, composition or added token spans one."""
    out, start = [], 0
    while len(text) - start > size:
        found = regex.compile(r"[ \n]").search(text, start + size)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


def slices(texts: list[str | None], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `size` characters each."""
    start = held = 0
    for k, text in enumerate(texts):
        if held and held + len(text or "") > size:
            yield start, k
            start, held = k, 0
        held += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def _coder(vocabulary: str) -> WordBpe:
    return kept_in_worker(f"bpe {vocabulary}", lambda: WordBpe(vocabulary))


def encode_texts(docs: DataFrame, vocabulary: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text), and with `decoded` the text that the ids decode to.

    Other columns are ignored. Null and empty texts have no ids and decode to an empty text. Rows are independent: repeated ones,
    and null doc_ids, each give their row; an empty table gives no rows. No shuffle; a worker holds one slice of texts at a time.
    """
    doc = subset(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    fields = [doc.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [T.StructField("decoded", T.StringType())] * decoded)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                parts = [cut_long(t or "", SLICE) for t in texts[a:b]]
                # a long text stands alone, and goes through part by part
                found = [coder.encode([x]) for x in parts[0]] if b - a == 1 else [coder.encode([x for p in parts for x in p])]
                counts = np.concatenate([c for _, c in found])
                owner = np.repeat(np.arange(b - a), [len(p) for p in parts])
                offsets = np.append(0, np.cumsum(np.bincount(owner, weights=counts, minlength=b - a))).astype(np.int64)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([i for i, _ in found])))
                out = {"doc_id": batch.column("doc_id").slice(a, b - a), "ids": ids}
                if decoded:
                    out["decoded"] = coder.decode(ids)
                yield pa.RecordBatch.from_pydict(out)
                del found, ids, out
            release()

    return doc.mapInArrow(encode, schema)


def decode_ids(coded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of coded (doc_id, ids): tokens joined by blanks, like the library's decode(ids, skip_special_tokens=False).

    Null lists, and empty ones, give an empty text; null ids and ids without a token are left out.
    """
    rows = subset(coded, "doc_id", "ids").withColumn("ids", F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": coder.decode(batch.column("ids"))})

    return rows.mapInArrow(decode, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))
