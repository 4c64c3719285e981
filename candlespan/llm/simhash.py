"""SimHash fingerprints, and their pairs within a Hamming distance by vantage-point trees.

Fingerprints. A bit is set where more than half of a document's shingle hashes have it. A fingerprint has one or more words of 64
bits; the first uses the hashes themselves, further ones the hashes mixed with a constant.

Shards. Bits are chosen for each of several bands. Each band has a vantage-point tree of its own, built from a bounded sample of the
points: a node holds a vantage point and a distance, points nearer than it go left. Every point goes to the leaf it falls in, and,
where its distance is so near the node's that a partner within `margin` may lie on the other side by the triangle inequality, to the
leaves there as well. Two fingerprints within `radius` are within radius // bands of each other in one of disjoint bands at
least, so with that margin no pair is lost. With more bands than `radius` the margin is zero: partners share the leaf and nothing
is copied. That makes the trees selective: distances of unrelated fingerprints all lie close to half the bits, and a margin of
the whole radius would copy most points at every node.

Search. Equal fingerprints are one point. Inside a shard, points with equal bits in the band are compared over all bits, or,
with a margin, a second tree over whole fingerprints prunes by the same bounds with the full radius. A shard with more points than
`block` is cut into blocks, and pairs of blocks are separate groups, so no group of near copies lands in one task. A task returns,
instead of all pairs, the links of a spanning forest: no component is lost.

Similar sets. Where fingerprints only estimate a similarity, their pairs are candidates: pairs well beyond the expected distance are
taken too, and each is checked on the shingle sets themselves. Near links are checked first and contracted. Of the candidates between
different groups only a spanning forest leaves the search; its trees say which sets can meet at all. The sets of a tree, cut into
blocks where it is large, are then compared inside one group, which finds the candidate pairs again from the fingerprints, checks each and
returns a spanning forest of the links. So no candidate pair is ever a row, however many a group of near copies has.

Components. Stars are contracted round by round: each point's larger neighbours are joined to its smallest one, then its
smaller ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlespan.llm.common import drawn, kept_in_worker, release, spare_name, stored

SEED = 42
BANDS = 5
#: Words of the fingerprints that estimate similarity.
WIDE = 4
#: Bits of a band in the search for candidate pairs, deviations of the distance allowed beyond its mean, and bands of the first links.
PAIR_BITS = 13
SLACK = 4
NEAR_BANDS = 8
SAMPLE = 20_000
#: Leaves of a tree at most, and points a leaf should have before there are more.
LEAVES = 4096
LEAF_SIZE = 1000
BLOCK = 2048
SALTS = 8
LEAF_POINTS = 512
#: Sets that small trees of candidates share a group with, and sets and shingles in a block of a large tree, on average.
SETS = 512
SET_BLOCK = 2048
SET_SHINGLES = 1 << 20


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "<u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    hash_, view = xxhash.xxh64_intdigest, memoryview(line)
    return np.array([hash_(view[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist() or [len(line)])], "<u8")


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash made of each: the hash itself for 0, else the finish of a public 64-bit mixer."""
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return z ^ z >> np.uint64(31)


def simhash(hashes: np.ndarray, words: int = 1) -> list[int]:
    """The fingerprint as signed 64-bit numbers; all zero without hashes."""
    out = []
    for k in range(words if len(hashes) else 0):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 14):
            part = mixed(hashes[i : i + (1 << 14)], k)
            ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return out or [0] * words


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, w0, w1, ...) for every row of docs (doc_id, text); with `distinct`, repeated shingles count once."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(texts: pd.Series) -> pd.Series:
        kept_in_worker("simhash")
        hashes = (shingle_hashes(t, shingle) for t in texts)
        out = pd.Series([simhash(np.unique(h) if distinct else h, words) for h in hashes])
        release()
        return out

    found = docs.select("doc_id", run.asNondeterministic()("text").alias("w"))
    return found.select("doc_id", *[F.col("w")[k].alias(f"w{k}") for k in range(words)])


class VantageTree:
    """A vantage-point tree over the bits of a band, used to deal points into leaves."""

    def __init__(self, sample: np.ndarray, margin: int, leaves: int, rng: np.random.Generator):
        self.margin = margin
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage point, distance, left, right; negative: a leaf
        self.n_leaves = 0
        points = np.unique(sample)
        self.root = self._build(points, max(1, len(points) // leaves), rng)

    def _build(self, points: np.ndarray, small: int, rng: np.random.Generator) -> int:
        if len(points) > small:
            # of a few vantage points, the one whose distances spread most splits best
            best = max((points[k] for k in rng.integers(0, len(points), 4)), key=lambda v: np.bitwise_count(points ^ v).std())
            far = np.bitwise_count(points ^ best)
            cut = int(np.median(far)) or 1
            near = far < cut
            if near.any() and not near.all():
                place = len(self.nodes)
                self.nodes.append((int(best), cut, 0, 0))
                left, right = self._build(points[near], small, rng), self._build(points[~near], small, rng)
                self.nodes[place] = (int(best), cut, left, right)
                return place
        self.n_leaves += 1
        return -self.n_leaves

    def leaves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, leaf, whether it is the leaf the point itself falls in) for all leaves a point must be in."""
        todo, out = [(self.root, np.arange(len(points)), np.ones(len(points), bool))], []
        while todo:
            node, index, home = todo.pop()
            if not len(index):
                continue
            if node < 0:
                out.append((index, np.full(len(index), -node), home))
                continue
            vantage, cut, left, right = self.nodes[node]
            far = np.bitwise_count(points[index] ^ np.uint64(vantage)).astype(np.int64)
            near = far < cut
            to_left, to_right = near | (far - self.margin < cut), ~near | (far + self.margin >= cut)
            todo.append((left, index[to_left], (home & near)[to_left]))
            todo.append((right, index[to_right], (home & ~near)[to_right]))
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else empty


def split_bands(bands: int, words: int) -> list[np.ndarray]:
    """Disjoint bands of neighbouring bits."""
    edges = [64 * words * k // bands for k in range(bands + 1)]
    return [np.arange(a, b) for a, b in zip(edges, edges[1:])]


def band_keys(points: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The given bits of points (point, word) as numbers."""
    if not len(points):
        return np.empty(0, "<u8")
    flags = np.unpackbits(np.ascontiguousarray(points).view("u1").reshape(len(points), -1), axis=1, bitorder="little")[:, bits]
    full = np.zeros((len(points), 8), np.uint8)
    packed = np.packbits(flags, axis=1, bitorder="little")
    full[:, : packed.shape[1]] = packed
    return full.view("<u8").ravel()


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of index pairs within the radius; a vantage-point search that compares directly where few points are left."""
    todo = [(np.arange(len(left)), np.arange(len(right)))]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        if min(len(a), len(b)) > LEAF_POINTS:
            vantage = left[a[len(a) // 2]]
            da, db = distance(left[a], vantage), distance(right[b], vantage)
            cut = int(np.median(da))
            # each left point looks on its side and, within the radius of the border, on the other
            lower, upper = (a[da < cut], b[db < cut + radius]), (a[da >= cut], b[db >= cut - radius])
            before = len(a) * len(b)
            if len(lower[0]) * len(lower[1]) + len(upper[0]) * len(upper[1]) < 0.9 * before:
                todo += [lower, upper]
                continue
        for i in range(0, len(a), LEAF_POINTS):
            part = a[i : i + LEAF_POINTS]
            x, y = np.nonzero(distance(left[part][:, None], right[b][None, :]) <= radius)
            yield part[x], b[y]


def equal_key_pairs(points: np.ndarray, keys: np.ndarray, own: np.ndarray, low: int, high: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of index pairs of equal key within the radius, one of block `low` and one of block `high`."""
    order = np.argsort(keys, kind="stable")
    keys, points, own = keys[order], points[order], own[order]
    at = np.arange(len(keys))
    for apart in range(1, len(keys)):
        at = at[at + apart < len(keys)]
        at = at[keys[at] == keys[at + apart]]
        if not len(at):
            return
        other = at + apart
        pick = at[own[at] != own[other]] if low != high else at
        if len(pick):
            pick = pick[distance(points[pick], points[pick + apart]) <= radius]
            yield order[pick], order[pick + apart]


class Forest:
    """Union-find; keeps only links that join two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins pairs; most pairs of a dense batch are already joined and are sorted out by label first."""
        while len(a):
            label = np.array([self.root(x) for x in range(len(self.up))])
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if not len(a):
                return
            # one link for each pair of labels, and of these one for each label, is enough for this turn
            la, lb = label[a], label[b]
            lo, hi = np.minimum(la, lb), np.maximum(la, lb)
            _, first = np.unique(hi, return_index=True)
            for x, y in zip(lo[first].tolist(), hi[first].tolist()):
                rx, ry = self.root(x), self.root(y)
                if rx != ry:
                    self.up[max(rx, ry)] = min(rx, ry)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        label = np.array([self.root(x) for x in range(len(self.up))], dtype=np.int64)
        child = np.flatnonzero(label != np.arange(len(label)))
        return child, label[child]


def shortest_forest(n: int, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of n points are a spanning forest of least length: in every turn each tree takes its shortest way out."""
    order = np.argsort(length, kind="stable")
    left, right = a[order], b[order]
    at, forest, taken = np.arange(len(order)), Forest(n), []
    while True:
        label = np.array([forest.root(x) for x in range(n)])
        la, lb = label[left[at]], label[right[at]]
        apart = la != lb
        at, la, lb = at[apart], la[apart], lb[apart]
        if not len(at):
            return order[np.array(taken, np.int64)]
        best = np.full(n, len(order))
        for side in (la, lb):
            np.minimum.at(best, side, at)
        for k in np.unique(best[best < len(order)]).tolist():
            x, y = forest.root(int(left[k])), forest.root(int(right[k]))
            if x != y:
                forest.up[max(x, y)] = min(x, y)
                taken.append(k)


def links(
    points: DataFrame, radius: int, bands: list[np.ndarray], margin: int = 0, sample: int = SAMPLE, leaves: int = LEAVES, block: int = BLOCK,
    direct: bool = False,
) -> DataFrame:
    """(a, b) with a > b: links between the points (node, w0, w1, ...) whose transitive closure is that of all pairs within the radius
    that are within `margin` of each other in a band. If points have a column `label`, only pairs of different labels count.

    With `direct` every link is itself such a pair, and of those that connect the same points the shortest are taken.

    `sample` bounds the points the trees are built from; every point is in the trees' leaves whatever the sample, so it
    bears on speed alone.
    """
    spark = points.sparkSession
    names = [c for c in points.columns if c not in ("node", "label")]
    more = ["label"] if "label" in points.columns else []
    n_points = points.count()
    seeds = np.array([tuple(r) for r in drawn(points, n_points, sample, "node").orderBy("node").select(*names).collect()], "<i8").reshape(-1, len(names))
    leaves = max(1, min(leaves, n_points // LEAF_SIZE))
    rng = np.random.default_rng(SEED)
    trees = [VantageTree(band_keys(seeds, bits), margin, leaves, rng) for bits in bands]
    sent = spark.sparkContext.broadcast((trees, bands))

    def deal(batches):
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.iloc[i : i + 4096]
                words = part[names].to_numpy("<i8")
                for band, (tree, bits) in enumerate(zip(*sent.value)):
                    index, leaf, home = tree.leaves(band_keys(words, bits))
                    yield part.iloc[index].assign(band=band, leaf=leaf, home=home)[["band", "leaf", "home", "node", *more, *names]]

    shape = "band int, leaf int, home boolean, node long" + "".join(f", {n} long" for n in [*more, *names])
    dealt = points.select("node", *more, *names).mapInPandas(deal, shape)
    # the many bands of a search for pairs are dealt twice rather than written
    dealt = dealt if more else stored(dealt, "simhash-leaves")
    # at most `leaves` rows for each band, so it may be broadcast
    sizes = dealt.groupBy("band", "leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = dealt.join(F.broadcast(sizes), ["band", "leaf"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("low"), F.greatest("own", k).alias("high")))
    spread = placed.withColumn("pair", F.explode(others)).select("band", "leaf", "pair.low", "pair.high", "own", "node", *more, *names)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        node, words = group["node"].to_numpy(), group[names].to_numpy("<i8").view("<u8")
        if len(node) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        low, high, own = int(group["low"].iloc[0]), int(group["high"].iloc[0]), group["own"].to_numpy()
        if margin:
            one, two = np.flatnonzero(own == low), np.flatnonzero(own == high)
            found = ((one[x], two[y]) for x, y in near_pairs(words[one], words[two], radius))
        else:
            keys = band_keys(words, sent.value[1][int(group["band"].iloc[0])])
            found = equal_key_pairs(words, keys, own, low, high, radius)
        if more:
            label = group["label"].to_numpy()
            found = ((x[pick], y[pick]) for x, y in found if (pick := label[x] != label[y]).any())
        if direct:
            x = y = np.empty(0, np.int64)
            for new_x, new_y in found:
                differ = node[new_x] != node[new_y]
                x, y = np.concatenate([x, new_x[differ]]), np.concatenate([y, new_y[differ]])
                if len(x) > 1 << 18:
                    keep = shortest_forest(len(node), x, y, distance(words[x], words[y]))
                    x, y = x[keep], y[keep]
            keep = shortest_forest(len(node), x, y, distance(words[x], words[y]))
            x, y = x[keep], y[keep]
            return pd.DataFrame({"a": np.maximum(node[x], node[y]), "b": np.minimum(node[x], node[y])})
        forest, held, n = Forest(len(node)), [], 0
        for x, y in found:
            differ = node[x] != node[y]
            held.append((x[differ], y[differ]))
            n += len(held[-1][0])
            if n > 1 << 18:
                forest.join(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            forest.join(*map(np.concatenate, zip(*held)))
        child, root = forest.stars()
        return pd.DataFrame({"a": np.maximum(node[child], node[root]), "b": np.minimum(node[child], node[root])})

    found = spread.groupBy("band", "leaf", "low", "high").applyInPandas(search, "a long, b long")
    return stored(found.filter("a <> b").distinct(), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the smallest node of its component.

    Alternates large and small stars until no edge changes. Each turn is written to the shared folder.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        # large star: an edge's smaller end gives way to that end's own smallest neighbour; salted, as a centre has many edges
        lowest = edges.groupBy(F.col("a").alias("centre")).agg(F.min("b").alias("m"))
        lowest = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = edges.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
        large = salted.join(lowest, (F.col("b") == F.col("centre")) & (salted["salt"] == lowest["salt"]), "left")
        large = large.select("a", F.coalesce("m", "b").alias("b")).distinct()
        # small star: a point's smaller neighbours and itself are joined to the smallest of them
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a")
        small = small.select("a", "m").unionByName(small.select(F.col("b").alias("a"), "m")).filter("a <> m").distinct()
        edges = stored(small.withColumnRenamed("m", "b"), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def _points(marked: DataFrame) -> DataFrame:
    names = [c for c in marked.columns if c != "doc_id"]
    return stored(marked.groupBy(*names).agg(F.min("doc_id").alias("doc_id")), "simhash-points")


def _named(marked: DataFrame, points: DataFrame, edges: DataFrame) -> DataFrame:
    """marked (doc_id, node, w0, ...) with the component_id of each row, its points being linked by the edges."""
    rooted = points.select("node", "doc_id").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    member = stored(rooted.select("node", "root").join(named, "root").select("node", "component_id"), "simhash-components")
    return marked.join(member, "node")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, bands: int = BANDS, **search) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text); other columns are ignored.

    component_id is the smallest doc_id among the documents linked, directly or through others, by fingerprints that differ in at
    most `radius` bits. Null and empty texts, and those of white space alone, have fingerprint 0 and are linked like any other. Null
    doc_ids are members, but never name a component unless all its ids are null. Repeated rows have equal results.
    """
    marked = stored(fingerprints(docs, shingle).withColumn("node", F.col("w0")), "fingerprints")
    points = _points(marked)
    found = _named(marked, points, links(points.drop("doc_id"), radius, split_bands(bands, 1), radius // bands, **search))
    return found.select("doc_id", F.col("w0").alias("fingerprint"), "component_id")


def wide_bands() -> list[np.ndarray]:
    """Twice sixteen bands of sixteen bits: neighbouring bits, and every sixteenth one. The first `NEAR_BANDS` find the first links."""
    bits = np.arange(64 * WIDE)
    return [*bits.reshape(-1, 16), *bits.reshape(16, -1).T]


def pair_bands() -> list[np.ndarray]:
    """Bands of `PAIR_BITS` bits for candidate pairs: as many disjoint ones as fit, of each of two orders of the bits."""
    rng = np.random.default_rng(SEED)
    fit = 64 * WIDE // PAIR_BITS
    return [b for _ in range(2) for b in rng.permutation(64 * WIDE)[: fit * PAIR_BITS].reshape(fit, PAIR_BITS)]


def _set_name(shingles: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes(), SEED)], "<u8").view("<i8")[0])


def _set_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, node, w0, w1, ...): node names the set of shingles, so equal sets, and only those, are one point."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(texts: pd.Series) -> pd.Series:
        kept_in_worker("simhash")
        sets = (np.unique(shingle_hashes(t, shingle)) for t in texts)
        out = pd.Series([[_set_name(s), *simhash(s, WIDE)] for s in sets])
        release()
        return out

    found = docs.select("doc_id", run.asNondeterministic()("text").alias("w"))
    return found.select("doc_id", F.col("w")[0].alias("node"), *[F.col("w")[k + 1].alias(f"w{k}") for k in range(WIDE)])


def _sets(nodes: DataFrame, points: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the given distinct nodes, each from the text of its point's doc_id."""
    shape = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    @F.pandas_udf(shape)
    def run(texts: pd.Series) -> pd.DataFrame:
        kept_in_worker("simhash")
        sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
        return pd.DataFrame({"node": [_set_name(s) for s in sets], "shingles": pd.Series([s.view("<i8") for s in sets], dtype=object)})

    asked = nodes.join(points.select("node", F.col("doc_id").alias("from")), "node")
    texts = docs.select("doc_id", "text").join(asked, F.col("doc_id").eqNullSafe(F.col("from"))).select("node", "text")
    sets = texts.withColumn("own", run.asNondeterministic()("text")).filter("own.node = node").select("node", "own.shingles")
    return stored(sets.dropDuplicates(["node"]), "simhash-sets")


def _verified(pairs: DataFrame, points: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of points whose shingle sets have at least the Jaccard similarity."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), points, docs, shingle)
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("double")
    found = both.filter(common / (F.size("sa") + F.size("sb") - common) >= similarity)
    return stored(found.select("a", "b"), "simhash-verified")


def candidate_pairs(words: np.ndarray, label: np.ndarray, own: np.ndarray, low: int, high: int, radius: int,
                    bands: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(place, places): for each point of block `low` the later ones it must be checked against, those of block `high` if that is another.

    These are the points of another label within the radius that agree with it on a whole band.
    """
    keys = np.stack([band_keys(words, bits) for bits in bands])
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    for at, x in enumerate(left):
        y = right[at + 1 :] if low == high else right
        y = y[(label[y] != label[x]) & (distance(words[y], words[x]) <= radius)]
        y = y[(keys[:, y] == keys[:, x, None]).any(axis=0)]
        if len(y):
            yield int(x), y


def similar_pairs(shingles: list[np.ndarray], pairs: Iterator[tuple[int, np.ndarray]], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the pairs (place, places) whose sets of shingles have at least the Jaccard similarity, in batches."""
    size = np.array([len(s) for s in shingles])
    ends = np.cumsum(size)
    number = np.unique(np.concatenate(shingles), return_inverse=True)[1]
    mine = np.zeros(len(number) + 1, bool)
    for x, y in pairs:
        own = number[ends[x] - size[x] : ends[x]]
        mine[own] = True
        common = np.array([np.count_nonzero(mine[number[ends[k] - size[k] : ends[k]]]) for k in y], float)
        mine[own] = False
        y = y[common / (size[x] + size[y] - common) >= similarity]
        if len(y):
            yield np.full(len(y), x), y


def _links_inside(trees: DataFrame, labels: DataFrame, points: DataFrame, docs: DataFrame, shingle: int, similarity: float, radius: int,
                  bands: list[np.ndarray], sets_in_group: int = SETS, sets_in_block: int = SET_BLOCK, shingles_in_block: int = SET_SHINGLES) -> DataFrame:
    """(a, b): links whose closure is that of all candidate pairs of points whose shingle sets have at least the Jaccard similarity.

    `trees` are the `components` of the candidate pairs: no candidate pair joins two of them, so any number of small trees may
    share a group. A tree with more sets or shingles than a block should have is cut into blocks by hash, and its pairs of blocks are groups.
    """
    names = [f"w{k}" for k in range(WIDE)]
    trees = trees.unionByName(trees.select(F.col("root").alias("node"), "root").distinct())
    rows = trees.join(_sets(trees.select("node"), points, docs, shingle), "node").join(labels.select("node", "label", *names), "node")
    rows = stored(rows, "simhash-trees")
    n, s = F.count(F.lit(1)), F.sum(F.size("shingles"))
    blocks = F.greatest(F.lit(1), F.ceil(n / sets_in_block), F.ceil(s / shingles_in_block)).cast("int")
    sizes = stored(rows.groupBy("root").agg(blocks.alias("blocks"), n.alias("n"), s.alias("s")), "simhash-trees")
    small = sizes.filter("blocks = 1").agg(F.sum("n"), F.sum("s")).first()
    shared = max(1, (small[0] or 0) // sets_in_group, (small[1] or 0) // (shingles_in_block // 4))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = rows.join(sizes.select("root", "blocks"), "root").withColumns({
        "own": own, "tree": F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(shared))).otherwise(F.col("root")),
    })
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("low"), F.greatest("own", k).alias("high")))
    spread = placed.withColumn("pair", F.explode(others)).select(
        (F.col("blocks") > 1).alias("large"), "tree", "pair.low", "pair.high", "own", "node", "label", "shingles", *names)

    def check(group: pd.DataFrame) -> pd.DataFrame:
        node, words = group["node"].to_numpy(), group[names].to_numpy("<i8").view("<u8")
        low, high, own = int(group["low"].iloc[0]), int(group["high"].iloc[0]), group["own"].to_numpy()
        pairs = candidate_pairs(words, group["label"].to_numpy(), own, low, high, radius, bands)
        forest = Forest(len(node))
        held: list = []
        for found in similar_pairs(list(group["shingles"]), pairs, similarity):
            held.append(found)
            if sum(len(x) for x, _ in held) > 1 << 18 or len(held) > 256:
                forest.join(*map(np.concatenate, zip(*held)))
                held = []
        if held:
            forest.join(*map(np.concatenate, zip(*held)))
        child, root = forest.stars()
        return pd.DataFrame({"a": np.maximum(node[child], node[root]), "b": np.minimum(node[child], node[root])})

    found = spread.groupBy("large", "tree", "low", "high").applyInPandas(check, "a long, b long")
    return stored(found.filter("a <> b").distinct(), "simhash-verified")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, **search) -> DataFrame:
    """(doc_id, component_id) of docs (doc_id, text), linked by a Jaccard similarity of shingle sets of at least `similarity`.

    Every link is checked on the sets. A fingerprint of `WIDE` words finds the pairs to check: shingle sets of similarity J are at an
    angle whose cosine is 2J / (1 + J), and each bit differs with the angle's share of a half turn, at 0.8 with 0.151. Candidates
    may differ in `SLACK` deviations more bits, and must agree on one of `pair_bands`. README has the measured share of pairs met.
    """
    bits = 64 * WIDE
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    radius = int(round(bits * share))
    wide = radius + int(np.ceil(SLACK * np.sqrt(bits * share * (1 - share))))
    marked = stored(_set_prints(docs, shingle), "fingerprints")
    points = _points(marked)
    bare = points.drop("doc_id")
    near = _verified(links(bare, radius, wide_bands()[:NEAR_BANDS], direct=True, **search), points, docs, shingle, similarity)
    labels = bare.join(components(near), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    labels = stored(labels, "simhash-labels")
    trees = components(links(labels, wide, pair_bands(), **search))
    more = _links_inside(trees, labels, points, docs, shingle, similarity, wide, pair_bands())
    return _named(marked, points, near.unionByName(more)).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, **search) -> DataFrame:
    """The rows of docs with one document kept of each group of similar ones: that with the smallest doc_id.

    Of rows that share this doc_id one stays, the first by the hash of all columns; where a group has null ids only, one of its
    rows stays. Texts without words are one group.
    """
    names = [F.col(f"`{n}`") for n in docs.columns]
    key = F.xxhash64(*names)
    thin = docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", key.alias("key")).alias("doc_id"), "text")
    found = similar_groups(thin, shingle, similarity, **search)
    own, nth = spare_name("copy_key", docs), spare_name("copy_nth", docs)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.key").alias(own)).distinct()
    place = F.row_number().over(Window.partitionBy(own).orderBy(own))
    return docs.withColumn(own, key).join(kept, own).withColumn(nth, place).filter(F.col(nth) == 1).select(*names)
