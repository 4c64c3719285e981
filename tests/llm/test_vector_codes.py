import duckdb
import numpy as np
import pytest

from candlespan.llm import vector_codes as V
from candlespan.llm.queries import ORACLES, op12_vector_codes

SCHEMA = "vec_id long, embedding array<double>, label string, code string, row long"


def by_hand(x, parts, entries, rounds):
    """Codes, errors and codebooks of integer vectors in the order of their ids, with plain loops."""
    width = x.shape[1] // parts
    codes, errors, books = [], [], []
    for p in range(parts):
        points = [tuple(map(int, r)) for r in x[:, p * width : (p + 1) * width]]
        book = points[:entries]

        def nearest(q, book=None):
            return min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            own = [nearest(q, book)[1] for q in points]
            for k in range(len(book)):
                mine = [q for q, o in zip(points, own) if o == k]
                if mine:
                    book[k] = tuple(sum(c) // len(mine) for c in zip(*mine))
        found = [nearest(q, book) for q in points]
        codes.append([k for _, k in found])
        errors.append([d for d, _ in found])
        books.append(book)
    return list(map(list, zip(*codes))), [sum(e) for e in zip(*errors)], books


def compare(spark, rows, parts=2, entries=5, rounds=3, block=4):
    got, books = V.compress_vectors(spark.createDataFrame(rows, SCHEMA), parts=parts, entries=entries, rounds=rounds, block=block)
    kept = sorted((r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.floor(1024 * np.array([r[1] for r in kept])).astype(np.int64)
    codes, errors, want = by_hand(x, parts, entries, rounds)
    assert [b.tolist() for b in books] == [[list(e) for e in b] for b in want]
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]), r[2])
    found = sorted([(r.id, r.label, r.code, r.error) for r in got.collect()], key=key)
    assert found == sorted([(r[0], r[2], c, e) for r, c, e in zip(kept, codes, errors)], key=key)
    return got


def test_curve_visits_every_cell_by_steps_of_one():
    for d, bits in ((2, 3), (3, 2), (4, 2), (5, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        keys = V.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_distances_are_exact_whatever_their_size():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 28):
        points, entries = rng.integers(-top, top, (20, 3)), rng.integers(-top, top, (7, 3))
        want = [[sum(int(a - b) ** 2 for a, b in zip(p, e)) for e in entries] for p in points]
        assert V.squared_distances(points, entries).tolist() == want


def test_short_lists_hold_every_nearest_entry_and_leave_most_out():
    rng = np.random.default_rng(2)
    held = 0
    for _ in range(200):
        book = rng.integers(-9, 9, (30, 3))
        points = rng.integers(-9, 9, 3) + rng.integers(-1, 2, (6, 3))
        may = V.shortlists(points.min(0)[None], points.max(0)[None], book)[0]
        distances = V.squared_distances(points, book)
        assert may[(distances == distances.min(1)[:, None]).any(0)].all()
        held += may.sum()
    assert held < 200 * 30 / 3


def test_codes_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (4, 6))
    rows = [(int(i), (centres[i % 4] + rng.normal(0, 0.05, 6)).tolist(), "ab"[i % 2], "c", 1) for i in rng.permutation(60)]
    compare(spark, rows)


def test_ties_repeats_nulls_and_clashing_columns(spark):
    grid = [[float(a), float(b)] for a in (-1, 0, 1) for b in (-1, 0, 1)]
    rows = [(i, v, None if i % 3 else "x", None, i) for i, v in enumerate(grid * 3)]
    rows += [(7, [0.0, 0.0], "x", "y", 0)] * 40 + [(None, [1.0, 1.0], None, None, None), (None, [1.0, 1.0], None, None, None)]
    rows += [(100, None, "x", None, 0), (101, [None, 1.0], "x", None, 0), (102, [float("nan"), 1.0], "x", None, 0), (103, [float("inf"), 1.0], "x", None, 0), (104, [1.0, float("-inf")], "x", None, 0)]
    codes = compare(spark, rows)
    sums: dict = {}
    found = codes.collect()
    for r in found:
        sums[r.label] = sums.get(r.label, 0) + r.error
    out = V.label_errors(codes).collect()
    assert len(out) == len(found) and all(r.label_error == sums[r.label] for r in out)


def test_small_and_empty_tables(spark):
    compare(spark, [(5, [0.5, -0.5], "a", None, 1)])
    for rows in ([], [(1, None, None, None, None)]):
        codes, books = V.compress_vectors(spark.createDataFrame(rows, SCHEMA))
        assert V.label_errors(codes).collect() == [] and [b.size for b in books] == [0] * 4


def test_vectors_that_have_no_exact_result_are_an_error(spark):
    lengths = [(i, [1.0] * n, "", "", 0) for i, n in enumerate((2, 4, 2, 3, 2))]
    for rows in (lengths, lengths[:2], [(1, [], "", "", 0)], [(1, [1.0, 2.0, 3.0], "", "", 0)], [(1, [1e30, 0.0], "", "", 0)]):
        with pytest.raises(ValueError):
            V.compress_vectors(spark.createDataFrame(rows, SCHEMA), parts=2)


def test_query_equals_its_sql(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.1, 64).tolist(), "abc"[i % 3], "c", 1) for i in range(300)] + [(300, None, "a", "", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_vector_codes(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(ORACLES["op12_vector_codes"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
