"""Token-id output: encode whole texts, write them in ascending doc_id order, read them back.

Documents are dealt into ranges of (doc_id, hash of the text) and sorted inside them; each range becomes one shard file, written by
one task in a single pass. The manifest has one row per shard with its number of tokens; running sums over it place each shard
in the whole, so no task and no driver sees more than one row per shard.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlespan.llm.common import kept_in_worker, release, stored, subset
from candlespan.llm.token_files import ShardReader, ShardWriter, make_folder
from candlespan.session import scratch_dir

END_ID = 2
#: Places where a new piece of the byte-level scheme starts for certain, so that a text may be cut there: before a blank that
#: stands before something that is no white space; before a mark after a Latin letter or digit; and between a single line end and a
#: Latin letter. MARK stands for a cut; texts that hold it, or a blank before white space or the end, are encoded whole.
MARK = "\x00"
LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ODD = rf"\x00| ([{WHITE}]|$)"
CUTS = ((rf"([0-9{LATIN}])([.,!?:;])", rf"\1{MARK}\2"), (rf"([0-9{LATIN}.,!?:;])\n([{LATIN}])", f"\\1\n{MARK}\\2"))
#: Pieces that may follow a single line end.
LETTERED = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F](?:.*\\S)?\\Z", re.S)
#: Bytes of remembered pieces, by a generous estimate, before a worker forgets them all; characters encoded at a time.
REMEMBERED = 250 << 20
SLICE = 4 << 20


def _with_room(old: np.ndarray, used: int, wanted: int) -> np.ndarray:
    """The array, or if it is too short for `wanted` entries, a copy of the `used` ones in one of at least double the length."""
    if wanted <= len(old):
        return old
    out = np.empty(max(wanted, 2 * len(old)), old.dtype)
    out[:used] = old[:used]
    return out


class PieceEncoder:
    """Encodes texts with a tokenizers file of the byte-level scheme.

    The distinct pieces of a slice of texts go through the library unless remembered; the ids of all pieces are then put in
    place with array operations. The result equals encoding each whole text.
    """

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED, size: int = SLICE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.remembered, self.slice = remembered, size
        self._forget()
        # a token of a byte-level vocabulary is written with one character for each byte
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.n_bytes[i] = len(token)

    def _forget(self) -> None:
        #: The numbers of remembered pieces; the ids of piece k are flat[starts[k] : starts[k + 1]]. Both arrays have room to grow.
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.empty(1 << 16, "<u4"), np.zeros(1 << 16, np.int64)
        self.size = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.known)
        first, last = int(self.starts[n]), int(self.starts[n]) + len(ids)
        self.flat = _with_room(self.flat, first, last)
        self.starts = _with_room(self.starts, n + 1, n + 1 + len(pieces))
        self.flat[first:last] = ids
        self.starts[n + 1 : n + 1 + len(pieces)] = first + np.cumsum(lengths)
        self.known.update(zip(pieces, range(n, n + len(pieces))))
        self.size += 150 * len(pieces) + sum(map(len, pieces)) + 4 * len(ids)

    def _learn(self, pieces: list[str]) -> None:
        """Remembers the ids of new pieces. Those that start with a blank, and after a line end those that are a word, are encoded
        as one text, which is much cheaper, and parted by their lengths in bytes."""
        other: list[str] = []
        for skip, part in ((0, [p for p in pieces if p[:1] == " "]), (1, [p for p in pieces if p[:1] != " "])):
            if skip:
                other = [p for p in part if not LETTERED.match(p)]
                part = [p for p in part if LETTERED.match(p)]
            for i in range(0, len(part), 8192):
                self._learn_as_one(part[i : i + 8192], skip)
        found = self._ids(other)
        self._remember(other, np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4)

    def _learn_as_one(self, part: list[str], skip: int) -> None:
        ids = np.frombuffer(self._ids(["".join(part) if not skip else "\n" + "\n".join(part)])[0], "<u4")
        ends = np.cumsum(self.n_bytes[ids])
        lengths = np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)) + skip
        cuts = np.searchsorted(ends, np.cumsum(lengths), side="right")
        counts = np.diff(cuts, prepend=0)
        if skip:
            # the line end before a word is a token of its own
            ids, counts = np.delete(ids, cuts - counts), counts - 1
        self._remember(part, ids, counts)

    def encode(self, texts: pa.StringArray) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers, worked out a slice of the texts at a time."""
        sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False)) // self.slice
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        for a, b in zip(edges, edges[1:]):
            yield from self._slice(texts.slice(a, b - a).cast(pa.large_string()))
            release()

    def _slice(self, texts: pa.StringArray) -> list[bytes]:
        if not len(texts):
            return []
        odd = pc.match_substring_regex(texts, ODD)
        marked = pc.replace_substring(texts, " ", MARK + " ")
        for pattern, put in CUTS:
            marked = pc.replace_substring_regex(marked, pattern, put)
        parts = pc.split_pattern(pc.if_else(odd, "", marked), MARK)
        coded = parts.flatten().dictionary_encode()
        # by way of numpy, as to_pylist makes a scalar of every piece
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.size > self.remembered:
            self._forget()
        numbers = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(numbers < 0)):
            fresh = [pieces[i] for i in new.tolist()]
            self._learn(fresh)
            numbers[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        first = self.starts[numbers]
        lengths = self.starts[numbers + 1] - first
        index = coded.indices.to_numpy()
        counts = lengths[index]
        ends = np.cumsum(counts)
        # the place of every token: the start of its piece's ids, and how far it is inside the piece
        kind = np.int32 if len(counts) and max(ends[-1], len(self.flat)) < 1 << 31 else np.int64
        place = np.repeat((first[index] - (ends - counts)).astype(kind), counts)
        place += np.arange(len(place), dtype=kind)
        raw = memoryview(self.flat[place].tobytes())
        bounds = 4 * np.append(0, ends)[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        out = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for k, ids in zip(whole, self._ids([texts[k].as_py() for k in whole])):
            out[k] = ids
        return out


def write_shards(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, remembered: int = REMEMBERED, size: int = SLICE
) -> DataFrame:
    """The manifest (shard, path, n_docs, n_tokens) after writing docs (doc_id, text) under `folder`, a shared one.

    Null text is empty, each document ends with `end_id`. Null doc_ids come first; equal ones are in the order of the hash of
    their texts. Shards without documents are not written.
    """
    make_folder(folder)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        encoder, writer, shard = kept_in_worker(f"tokens {vocabulary} {remembered} {size}", lambda: PieceEncoder(vocabulary, remembered, size)), None, TaskContext.get().partitionId()
        path, n_docs = f"{folder}/shard-{shard:06d}.tok", 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                writer = writer or ShardWriter(path)
                ids = b"".join((ids, end))
                writer.add(doc_id, ids, zlib.crc32(ids))
                n_docs += 1
        if writer:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": n_docs, "n_tokens": writer.close()}])

    rows = subset(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("hash", F.xxhash64("text"))
    order = F.col("doc_id").asc_nulls_first()
    ordered = rows.repartitionByRange(order, "hash").sortWithinPartitions(order, "hash", "text")
    manifest = ordered.select("doc_id", "text").mapInArrow(write, "shard long, path string, n_docs long, n_tokens long")
    return stored(manifest, "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document in the shard files, computed from the ids they hold."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch["path"], batch["first"]):
                reader = ShardReader(path)
                doc_id = pd.Series(reader.entries["doc_id"], dtype="Int64").mask(reader.entries["known"] == 0)
                n_tokens, crc32 = zip(*reader.documents())
                yield pd.DataFrame({
                    "doc_id": doc_id,
                    "start": int(start) + np.concatenate([[0], np.cumsum(n_tokens)[:-1]]),
                    "n_tokens": n_tokens,
                    "ids_crc32": crc32,
                })

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = placed.select("path", "first").repartition(max(1, manifest.count()))
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(
    docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = END_ID, remembered: int = REMEMBERED, size: int = SLICE
) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of docs (doc_id, text) written to and read back from token files.

    Other columns are ignored. Null text is empty and gives the end id alone. Repeated rows are written as often as they come. An
    empty table writes no file and gives no rows. Without `folder`, a new one in the shared folder is used. `remembered` bounds a
    worker's memory of pieces and `size` the characters it works on at a time; both bear on speed and memory alone.
    """
    return read_shards(write_shards(docs, folder or scratch_dir(docs.sparkSession, "tokens"), vocabulary, end_id, remembered, size))
