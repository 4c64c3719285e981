"""A bigram language model of the training documents, kept in Elias-Fano tries, and the score of every document under it.

The corpus is never gathered in one place. Documents are cut into blocks of some hundred thousand tokens. A block sends each shard of
contexts its distinct bigrams with their training counts, as one compressed array; equal bigrams of a block travel once. A shard, which
has the contexts of one remainder of the hash, merges the blocks' counts, builds its trie and maps it, looks up what each block asked
for, and sends back one byte for a bigram and a count for a word. The blocks then score their documents.

    p(w | c) = weight * P(w | c) + (1 - weight) * p(w),  weight = n(c) / (n(c) + kappa),  p(w) = (n(w) + 0.5) / (N + 0.5 (V + 1))

P is the relative frequency the trie holds, quantised to a byte. kappa is the value of a fixed row that gives the training documents the
best likelihood when each token is left out of the counts it is scored with; the row reaches to infinity, the unigram model.
"""

from __future__ import annotations

import mmap
import pickle
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespan.llm.common import kept_in_worker, release, stored
from candlespan.llm.elias_fano import Trie

BLOCK_TOKENS = 600_000
#: Tokens whose contexts one shard has, about.
SHARD_TOKENS = 1_200_000
#: Look-ups made at a time.
CHUNK = 1 << 17
#: Reserved word hashes.
START, END = 0, 1
KAPPAS = (5.0, 50.0, 500.0, 5_000.0, 50_000.0, float("inf"))
#: Probabilities are powers of 10 ** (1 / STEPS); 255 stands for none.
STEPS, NONE = 32, 255


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(raw: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def thin(a: np.ndarray) -> np.ndarray:
    """The array in the smallest unsigned type that holds it."""
    top = int(a.max(initial=0))
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, NONE - 1).astype(np.uint8)


PROBABILITY = np.append(10.0 ** (-np.arange(NONE) / STEPS), 0.0)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class BlockBuilder:
    def __init__(self):
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, doc_id, held_out: bool, text: str | None) -> None:
        words = tokens_of(text)
        self.parts.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        self.docs.append((doc_id, held_out, len(words) + 1))
        self.size += len(words) + 1

    def payload(self) -> bytes:
        """Word hashes by falling frequency, after START and END; the tokens as numbers of them, with an END for each document."""
        flat = np.concatenate(self.parts)
        often = np.bincount(flat, minlength=len(self.words))
        order = np.argsort(-often, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(2, len(order) + 2)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)[order]
        hashes = np.concatenate([np.array([START, END], np.uint64), hashes])
        lengths = np.array([d[2] for d in self.docs], np.int64)
        out = np.ones(int(lengths.sum()), np.int64)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(lengths) - 1] = False
        out[inner] = place[flat]
        ids = np.array([d[0] or 0 for d in self.docs], np.int64)
        return pack(hashes, thin(out), lengths, ids, np.array([d[0] is None for d in self.docs]), np.array([d[1] for d in self.docs]))


class Block:
    """A block with its distinct bigrams, dealt to shards."""

    def __init__(self, payload: bytes, shards: int):
        self.hashes, tokens, self.lengths, self.ids, self.no_id, self.held_out = unpack(payload)
        context = np.zeros(len(tokens), np.int64)
        context[1:] = tokens[:-1]
        context[np.cumsum(self.lengths) - self.lengths] = 0
        self.pairs = context << 32 | tokens
        self.trained = np.repeat(~self.held_out, self.lengths)
        self.distinct = np.unique(self.pairs)
        self.first, self.second = (self.distinct >> 32).astype(np.int32), (self.distinct & 0xFFFFFFFF).astype(np.int32)
        shard = (self.hashes % np.uint64(shards)).astype(np.int64)[self.first]
        self.order = np.argsort(shard, kind="stable")
        self.edges = np.searchsorted(shard[self.order], np.arange(shards + 1))

    def counts(self) -> np.ndarray:
        seen, n = np.unique(self.pairs[self.trained], return_counts=True)
        out = np.zeros(len(self.distinct), np.int64)
        out[np.searchsorted(self.distinct, seen)] = n
        return out

    def requests(self) -> Iterator[tuple[int, bytes]]:
        counts = self.counts()
        for s, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:])):
            if a < b:
                pick = self.order[a:b]
                used, where = np.unique(np.concatenate([self.first[pick], self.second[pick]]), return_inverse=True)
                yield s, pack(self.hashes[used], thin(where[: b - a]), thin(where[b - a :]), thin(counts[pick]))

    def contexts(self, s: int) -> np.ndarray:
        """The distinct contexts of a shard's bigrams, in their order."""
        first = self.first[self.order[self.edges[s] : self.edges[s + 1]]]
        return first[np.flatnonzero(np.diff(first, prepend=-1))]


class Requests:
    """What all blocks ask of one shard, laid end to end."""

    def __init__(self, payloads: Iterator[bytes]):
        hashes, first, second, counts = zip(*map(unpack, payloads))
        self.pairs = np.cumsum([0, *map(len, first)])
        words = np.cumsum([0, *map(len, hashes)])
        if words[-1] >= 1 << 32:
            raise ValueError("too many words for one shard")
        self.hashes = np.concatenate(hashes)
        self.first = np.concatenate([f + np.uint32(w) for f, w in zip(first, words)])
        self.second = np.concatenate([x + np.uint32(w) for x, w in zip(second, words)])
        self.counts = np.concatenate([n.astype(np.uint32) for n in counts])

    def trie(self) -> Trie:
        """The trie of the bigrams that were counted."""
        words = np.unique(self.hashes)
        size = max(1, len(words))
        place, seen = np.searchsorted(words, self.hashes), self.counts > 0
        key = place[self.first[seen]] * size + place[self.second[seen]]
        del place
        order = np.argsort(key)
        key, n = key[order], self.counts[seen][order].astype(np.int64)
        del order, seen
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        key = key[starts]
        n = np.add.reduceat(n, starts) if len(starts) else n
        first = key // size
        roots = np.flatnonzero(np.diff(first, prepend=-1))
        total = np.add.reduceat(n, roots) if len(roots) else n
        parent = np.repeat(np.arange(len(roots)), np.diff(np.append(roots, len(key))))
        return Trie.build(words, [
            (np.zeros(len(roots), np.int64), first[roots], {"count": total}),
            (parent, key % size, {"probability": quantised(n / total[parent])}),
        ])

    def answers(self, trie: Trie) -> Iterator[bytes]:
        """For each block the counts of its distinct contexts, in order, and the bytes of its bigrams."""
        total, probability = trie.levels[0]["values"]["count"], trie.levels[1]["values"]["probability"]
        ids, root = np.empty(len(self.hashes), np.int32), np.empty(len(self.hashes), np.int32)
        for i in range(0, len(ids), CHUNK):
            ids[i : i + CHUNK] = trie.word(self.hashes[i : i + CHUNK])
            root[i : i + CHUNK] = trie.child(0, np.zeros(len(ids[i : i + CHUNK]), np.int64), ids[i : i + CHUNK])
        codes = np.full(len(self.first), NONE, np.uint8)
        for i in range(0, len(codes), CHUNK):
            node = trie.child(1, root[self.first[i : i + CHUNK]], ids[self.second[i : i + CHUNK]])
            known = np.flatnonzero(node >= 0)
            codes[i + known] = probability[node[known]]
        # words of different blocks have different numbers, so a change of the first word is a new context or a new block
        fresh = np.flatnonzero(np.append(True, self.first[1:] != self.first[:-1])) if len(self.first) else np.empty(0, np.int64)
        asked = root[self.first[fresh]]
        counts = np.where(asked >= 0, total[np.maximum(asked, 0)], 0) if len(total) else np.zeros(len(asked), np.int64)
        bounds = np.searchsorted(fresh, self.pairs)
        for k in range(len(bounds) - 1):
            yield pack(thin(counts[bounds[k] : bounds[k + 1]]), codes[self.pairs[k] : self.pairs[k + 1]])


def _serve(group: pd.DataFrame) -> pd.DataFrame:
    kept_in_worker("language model")
    requests = Requests(group["payload"])
    raw = requests.trie().pack()
    size = len(raw)
    release()
    with tempfile.TemporaryFile() as file:
        file.write(raw)
        file.flush()
        del raw
        with mmap.mmap(file.fileno(), size, access=mmap.ACCESS_READ) as mapped:
            trie = Trie.open(mapped)
            replies = list(requests.answers(trie))
            starts = trie.words.values()[trie.levels[0]["keys"].values().astype(np.int64)] == START
            known = trie.levels[0]["keys"].n - int(starts.sum())
            nodes = trie.levels[1]["keys"].n
            del trie, starts, requests
    release()
    out = pd.DataFrame({"block": group["block"], "shard": group["shard"], "payload": replies})
    summary = {"block": [-1], "shard": [int(group["shard"].iloc[0])], "payload": [pack(known, nodes, size)]}
    return pd.concat([out, pd.DataFrame(summary)])


def _log_mix(n_pair, n_context, p1, kappa: float) -> np.ndarray:
    """log10 of the mixed probability; n_pair and n_context may be counts with a token left out."""
    if kappa == float("inf"):
        return np.log10(p1)
    return np.log10((n_pair + kappa * p1) / (n_context + kappa))


def score_block(block: Block, replies: dict[int, bytes], n_train: int, n_types: int, n_docs: int) -> pd.DataFrame:
    """Per document: token counts, the base score, and scores and left-out scores for each kappa."""
    count = np.zeros(len(block.hashes), np.int64)
    codes = np.empty(len(block.distinct), np.uint8)
    for s, (a, b) in enumerate(zip(block.edges[:-1], block.edges[1:])):
        if a < b:
            contexts, code = unpack(replies[s])
            count[block.contexts(s)] = contexts
            codes[block.order[a:b]] = code
    # as contexts START stands for the beginnings of documents; as a token END for their ends
    own = count.copy()
    own[0], own[1] = n_docs, n_docs
    first, second = block.first, block.second
    n_context = own[first].astype(float)
    n_pair = PROBABILITY[codes] * n_context
    c, whole = own[second].astype(float), n_train + 0.5 * (n_types + 1)
    p1 = (c + 0.5) / whole
    left_pair, left_context = np.maximum(np.rint(n_pair) - 1, 0), np.maximum(n_context - 1, 0)
    left_p1 = np.maximum(c - 0.5, 0.5) / max(whole - 1, 1)
    at = np.searchsorted(block.distinct, block.pairs)
    edges = np.cumsum(block.lengths) - block.lengths
    per_doc = lambda v: np.add.reduceat(v[at], edges)
    out = {
        "doc_id": pd.Series(block.ids, dtype="Int64").mask(block.no_id), "held_out": block.held_out, "n_tokens": block.lengths,
        "n_known": per_doc((c > 0).astype(np.int64)), "base_score": per_doc(np.log10(p1)),
    }
    out["scores"] = list(np.array([per_doc(_log_mix(n_pair, n_context, p1, k)) for k in KAPPAS]).T)
    left = np.array([per_doc(_log_mix(left_pair, left_context, left_p1, k)) for k in KAPPAS]).T
    left[block.held_out] = 0
    out["left_out"] = list(left)
    return pd.DataFrame(out)


def scored(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    Trains on the rows whose crc32(doc_id as text) mod 5 is not 1; a null doc_id counts as the empty text. Null text is empty: one end
    token. Other columns are ignored, repeated rows count and are scored each, an empty table gives no rows. Without training
    rows every token is unknown and both scores are those of the smoothing alone.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held.alias("held_out"), "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_in_worker("language model")
        task, builder, k = TaskContext.get().partitionId(), BlockBuilder(), 0

        def finished() -> pd.DataFrame:
            trained = [d for d in builder.docs if not d[1]]
            return pd.DataFrame({
                "block": [task << 32 | k], "n_train": [sum(d[2] for d in trained)], "n_docs": [len(trained)], "size": [builder.size],
                "payload": [builder.payload()],
            })

        for batch in batches:
            for doc_id, held_out, text in zip(batch["doc_id"], batch["held_out"], batch["text"]):
                builder.add(None if doc_id is None else int(doc_id), bool(held_out), text)
                if builder.size >= block_tokens:
                    yield finished()
                    builder, k = BlockBuilder(), k + 1
                    release()
        if builder.docs:
            yield finished()

    blocks = stored(rows.mapInPandas(cut, "block long, n_train long, n_docs long, size long, payload binary"), "lm-blocks")
    total = blocks.agg(F.sum("n_train"), F.sum("n_docs"), F.sum("size")).first()
    n_train, n_docs, size = (x or 0 for x in total)
    shards = int(size // shard_tokens) + 1

    def ask(batches):
        for batch in batches:
            for name, payload in zip(batch["block"], batch["payload"]):
                asked = list(Block(payload, shards).requests())
                yield pd.DataFrame({"block": name, "shard": [s for s, _ in asked], "payload": [p for _, p in asked]})
                del asked
                release()

    shape = "block long, shard int, payload binary"
    asked = blocks.select("block", "payload").mapInPandas(ask, shape)
    served = stored(asked.groupBy("shard").applyInPandas(_serve, shape), "lm-replies")
    n_types = sum(unpack(r.payload)[0] for r in served.filter("block = -1").collect()) + (n_docs > 0)

    def score(group: pd.DataFrame) -> pd.DataFrame:
        by = dict(zip(group["shard"], group["payload"]))
        found = score_block(Block(by.pop(-1), shards), by, n_train, n_types, n_docs)
        release()
        return found

    both = blocks.select("block", F.lit(-1).alias("shard"), "payload").unionByName(served.filter("block >= 0"))
    result = both.groupBy("block").applyInPandas(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, left_out array<double>"
    )
    result = stored(result, "lm-scores")
    fit = result.agg(*[F.sum(F.col("left_out")[k]) for k in range(len(KAPPAS))]).first()
    best = max(range(len(KAPPAS)), key=lambda k: fit[k]) if fit[0] is not None else 0
    return result.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score")
    )
