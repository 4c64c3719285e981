"""Vector code compression: each vector becomes one codebook index for each of its parts.

Components are scaled to integers, so that every sum and distance is exact. For each part position the sub-vectors are sorted along
a Hilbert curve and cut into flat blocks, stored once, that carry their box (least and greatest component) and sum. In a round a
block first works out, from its box alone, which entries can be nearest to any of its points: those whose least distance to the box
is not above another's greatest, and that are not farther than the box centre's nearest entry all over the box. A block left with one
entry adds its stored sum without looking at its points; the others compare their points with the short list only. Rounds exchange
one row for each entry and task. Codebooks, of `entries` rows, are the only thing at the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlespan.llm.common import release, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Points in a block, and bits in a Hilbert key.
BLOCK, KEY_BITS = 128, 60
#: Copies of the labels' totals, so that rows of one common label meet in several tasks.
SALTS = 32


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along a Hilbert curve of points (n, d) with components in [0, 2^bits), d * bits <= 63: Skilling's transform."""
    x = cells.T.astype(np.int64).copy()
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1:], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1:], np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis >> b & 1)
    return key


def curve_order(points: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Hilbert keys of points (n, d), on a grid of two standard deviations around the mean; of many dimensions the widest count."""
    axes = np.sort(np.argsort(-spread, kind="stable")[:KEY_BITS])
    bits = min(8, KEY_BITS // max(1, len(axes)))
    scaled = (points[:, axes] - mean[axes]) / np.maximum(4 * spread[axes], 1e-9) + 0.5
    return hilbert_keys(np.clip(scaled * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, e) of integer points and entries."""
    top = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * int(top) ** 2 * points.shape[1] < 1 << 53:  # whole numbers that doubles hold, so the product is exact
        p, e = points.astype(float), entries.astype(float)
        return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)).astype(np.int64)
    out = np.empty((len(points), len(entries)), np.int64)
    for k, entry in enumerate(entries):
        gap = points - entry
        out[:, k] = (gap * gap).sum(1)
    return out


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries (b, e) may be nearest, or tie for it, at some point of each of the boxes (b, d)."""
    below, above = low[:, None, :] - entries, entries - high[:, None, :]
    outside = np.maximum(np.maximum(below, above), 0)
    inside = np.maximum(np.abs(below), np.abs(above))
    farthest = (inside * inside).sum(2)
    may = (outside * outside).sum(2) <= farthest.min(1)[:, None]
    # of the rest, those farther than the entry nearest to the box's centre wherever a point may lie
    middle = entries[squared_distances(low + high, 2 * entries).argmin(1)][:, None, :]
    step = entries - middle
    gain = 2 * np.maximum(low[:, None, :] * step, high[:, None, :] * step).sum(2)
    return may & ((middle * middle).sum(2) - (entries * entries).sum(1) + gain >= 0)


class Blocks:
    """The blocks of an Arrow batch, and the work of a round on them."""

    def __init__(self, batch: pa.RecordBatch, kind: np.dtype):
        self.part, self.n = (batch.column(c).to_numpy() for c in ("part", "n"))
        self.raw, self.kind = batch.column("points"), kind
        wide = lambda c: [np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist()]
        self.low, self.high, self.sum = wide("low"), wide("high"), wide("sum")

    def nearest(self, books: list[np.ndarray], chunk: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """(block, points or None, index of each point) of every block; None and one index where one entry serves the whole block."""
        for part, book in enumerate(books):
            own = np.flatnonzero(self.part == part)
            for i in range(0, len(own), chunk):
                some = own[i : i + chunk]
                may = shortlists(np.array([self.low[k] for k in some]), np.array([self.high[k] for k in some]), book)
                for k, row in zip(some.tolist(), may):
                    short = np.flatnonzero(row)
                    if len(short) == 1:
                        yield k, None, short
                    else:
                        points = self.points(k)
                        yield k, points, short[squared_distances(points, book[short]).argmin(1)]

    def points(self, k: int) -> np.ndarray:
        return np.frombuffer(self.raw[k].as_buffer(), self.kind).reshape(self.n[k], -1).astype(np.int64)


def _integers(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    """The vectors of a batch as integers (n, d)."""
    vectors = batch.column("vector")
    if not len(vectors):
        return np.zeros((0, 0), np.int64)
    return np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(vectors), -1).astype(np.int64)


def _kept(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, id, label, vector) of the rows whose vector is whole; `row` tells equal rows apart."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), vector.alias("vector"))
    whole = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return rows.filter(F.col("vector").isNotNull() & F.coalesce(whole, F.lit(False))).withColumn("row", F.monotonically_increasing_id())


def _statistics(kept: DataFrame, parts: int, scale: int):
    """Mean, standard deviation and greatest magnitude of every component, as integers; a row for each component at the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not len(batch):
                continue
            lengths = pc.unique(pc.list_value_length(batch.column("vector"))).to_pylist()
            if len(lengths) > 1 or lengths == [0]:
                held[1] = [0, np.zeros(1), np.zeros(1), np.full(1, np.inf)]  # a mark: the caller refuses the table
                break
            x = _integers(batch, scale).astype(float)
            new = [len(x), x.sum(0), (x * x).sum(0), np.abs(x).max(0, initial=0)]
            old = held.get(x.shape[1])
            held[x.shape[1]] = new if old is None else [old[0] + new[0], old[1] + new[1], old[2] + new[2], np.maximum(old[3], new[3])]
        for d, (n, total, squares, top) in held.items():
            axis = pa.array(np.arange(d, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [axis, pa.array(np.full(d, n)), pa.array(total), pa.array(squares), pa.array(top)], ["axis", "n", "total", "squares", "top"])

    sums = kept.select("vector").mapInArrow(partial, "axis int, n long, total double, squares double, top double")
    got = sums.groupBy("axis").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")], F.max("top").alias("top")).orderBy("axis").collect()
    n, total, squares, top = (np.array([r[c] for r in got], float) for c in ("n", "total", "squares", "top"))
    if len(got) and (n.min() != n.max() or np.isinf(top).any() or len(got) % parts):
        raise ValueError(f"vectors must have one length that {parts} divides")
    mean = total / np.maximum(n, 1)
    return n, mean, np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean * mean, 0)), top


def _write_blocks(kept: DataFrame, parts: int, scale: int, mean: np.ndarray, spread: np.ndarray, kind: np.dtype, block: int) -> DataFrame:
    """The blocks of every part position, stored. Ranges of (part, key, row) part equal points too, however many there are."""
    width = len(mean) // parts
    ids, labels = kept.schema["id"].dataType, kept.schema["label"].dataType

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch, scale)
            for p in range(parts if len(x) else 0):
                own = slice(p * width, (p + 1) * width)
                points = np.ascontiguousarray(x[:, own]).astype(kind)
                columns = {
                    "part": pa.array(np.full(len(x), p, np.int32)), "key": pa.array(curve_order(points, mean[own], spread[own])),
                    "row": batch.column("row"), "point": pa.array([r.tobytes() for r in points], pa.binary()),
                }
                for c in ("id", "label"):  # these travel with the first part
                    columns[c] = batch.column(c) if p == 0 else pa.nulls(len(x), batch.column(c).type)
                yield pa.RecordBatch.from_pydict(columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def blocks(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            x = np.frombuffer(b"".join(rows.column("point").to_pylist()), kind).reshape(len(rows), width).astype(np.int64)
            part = rows.column("part").to_numpy()
            out = {c: [] for c in ("part", "n", "points", "low", "high", "sum", "rows", "ids", "labels")}
            for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                points, of = x[a:b], int(part[a])
                values = [of, b - a, points.astype(kind).tobytes()] + [f(points, axis=0).tobytes() for f in (np.min, np.max, np.sum)]
                values += [rows.column("row").slice(a, b - a).to_pylist()]
                values += [rows.column(c).slice(a, b - a).to_pylist() if of == 0 else None for c in ("id", "label")]
                for c, v in zip(out, values):
                    out[c].append(v)
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            kinds += tuple(pa.list_(rows.column(c).type) for c in ("id", "label"))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            part = held.column("part").to_numpy()
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            sizes = np.diff(np.append(starts, len(part)))
            ends = np.concatenate([s + np.arange(block, n + 1, block) for s, n in zip(starts, sizes)] + [starts[1:]]).astype(np.int64)
            ends = np.unique(ends)
            if len(ends):
                yield blocks(held.slice(0, int(ends[-1])), ends)
                held = held.slice(int(ends[-1]))
        if held is not None and len(held):
            yield blocks(held, np.array([len(held)]))
        release()

    dealt = kept.mapInArrow(deal, T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("row", T.LongType()),
        T.StructField("point", T.BinaryType()), T.StructField("id", ids), T.StructField("label", labels),
    ]))
    ordered = dealt.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row")
    binary = [T.StructField(c, T.BinaryType()) for c in ("points", "low", "high", "sum")]
    return stored(ordered.mapInArrow(cut, T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("n", T.IntegerType()), *binary,
        T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(ids)), T.StructField("labels", T.ArrayType(labels)),
    ])), "vector-blocks")


def _moved(blocks: DataFrame, books: list[np.ndarray], kind: np.dtype) -> list[np.ndarray]:
    """The codebooks after one round: each entry the mean, rounded down, of the points nearest to it."""
    width = books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros_like(b) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            work = Blocks(batch, kind)
            for k, points, index in work.nearest(books):
                p = work.part[k]
                if points is None:
                    total[p][index[0]] += work.sum[k]
                    count[p][index[0]] += work.n[k]
                else:
                    order = np.argsort(index, kind="stable")
                    used, starts = np.unique(index[order], return_index=True)
                    total[p][used] += np.add.reduceat(points[order], starts)
                    count[p][used] += np.bincount(index)[used]
        for p in range(len(books)):
            used = np.flatnonzero(count[p])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[p][used]),
                pa.array(list(total[p][used]), pa.list_(pa.int64())),
            ], ["part", "entry", "n", "sums"])

    columns = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)]
    rows = blocks.select("part", "n", "points", "low", "high", "sum").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
    after = [b.copy() for b in books]
    for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns).collect():
        after[r["part"]][r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return after


def _codes(blocks: DataFrame, books: list[np.ndarray], kind: np.dtype) -> DataFrame:
    """(id, label, code, error) of every row: its parts are brought together by `row`."""
    ids, labels = (blocks.schema[c].dataType.elementType for c in ("ids", "labels"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work = Blocks(batch, kind)
            for k, points, index in work.nearest(books):
                points, p = work.points(k) if points is None else points, int(work.part[k])
                index = np.broadcast_to(index, len(points))
                gap = points - books[p][index]
                own = [batch.column(c).slice(k, 1).flatten() if p == 0 else pa.nulls(len(points), batch.column(c).type.value_type) for c in ("ids", "labels")]
                yield pa.RecordBatch.from_arrays([
                    batch.column("rows").slice(k, 1).flatten(), pa.array(np.full(len(points), p, np.int32)), pa.array(index.astype(np.int32)),
                    pa.array((gap * gap).sum(1)), *own,
                ], ["row", "part", "entry", "error", "id", "label"])

    rows = blocks.mapInArrow(assign, T.StructType([
        T.StructField("row", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()),
        T.StructField("error", T.LongType()), T.StructField("id", ids), T.StructField("label", labels),
    ]))
    entry = [F.max(F.when(F.col("part") == p, F.col("entry"))).alias(f"e{p}") for p in range(len(books))]
    first = [F.max(F.when(F.col("part") == 0, F.col(c))).alias(c) for c in ("id", "label")]
    found = rows.groupBy("row").agg(*first, *entry, F.sum("error").alias("error"))
    return found.select("id", "label", F.array(*[f"e{p}" for p in range(len(books))]).alias("code"), "error")


def compress_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK,
) -> tuple[DataFrame, list[np.ndarray]]:
    """The codes (id, label, code array<int>, error long) of all whole vectors, and the codebooks they refer to.

    A component x counts as floor(scale * x). Vectors are cut into `parts` equal parts; each position's codebook starts as that part
    of the `entries` vectors with the smallest ids (equal ids: in the order of the vectors; null ids come last), is moved in `rounds`
    rounds (nearest entry by squared distance, ties to the lower index; then means rounded down; unused entries stay), and the parts
    are assigned once more. `error` is the sum of the parts' squared distances.

    Rows whose vector is null, or holds a null or not finite component, are left out. Fewer vectors than `entries` make smaller
    codebooks, an empty table gives no rows and empty codebooks. Repeated rows are coded each for itself. Other columns are ignored.
    Vectors of different lengths, of a length that `parts` does not divide, or too large for exact 64-bit distances are an error.
    """
    kept = _kept(table, id_col, vector_col, label_col)
    n, mean, spread, top = _statistics(kept, parts, scale)
    if not len(n):
        empty = kept.select("id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
        return empty, [np.zeros((0, 0), np.int64)] * parts
    if 4 * len(mean) * int(top.max()) ** 2 >= 1 << 62 or int(top.max()) * int(n.max()) >= 1 << 62:
        raise ValueError("vectors are too large for exact 64-bit distances")
    kind = np.dtype(np.int16 if top.max() < 1 << 15 else np.int32 if top.max() < 1 << 31 else np.int64)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = np.floor(scale * np.array([r["vector"] for r in first])).astype(np.int64)
    width = len(mean) // parts
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    blocks = _write_blocks(kept, parts, scale, mean, spread, kind, block)
    for _ in range(rounds):
        books = _moved(blocks, books, kind)
    return _codes(blocks, books, kind), books


def label_errors(codes: DataFrame) -> DataFrame:
    """`codes` with `label_error`, the error summed over equal labels, nulls together.

    A common label is summed in each task before rows meet, and its total is handed out through several salts.
    """
    codes = stored(codes, "vector-codes")
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("id", "code", "error"), F.lit(SALTS)).cast("int")
    rows = codes.withColumn("own", salt)
    return rows.join(totals, rows["label"].eqNullSafe(totals["of"]) & (rows["own"] == totals["salt"])).drop("own", "of", "salt")


def code_text(code: Column) -> Column:
    """A code as two lowercase hex digits for each part."""
    return F.array_join(F.transform(code, lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
