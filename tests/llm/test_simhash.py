import random

import numpy as np
import pytest
import xxhash

from candlespan.llm.simhash import (
    WIDE, VantageTree, _links_inside, _points, _set_prints, band_keys, components, distance, equal_key_pairs, links, near_duplicates, near_pairs, one_of_each, pair_bands,
    shingle_hashes, shortest_forest, similar_groups, simhash, split_bands, wide_bands,
)


def brute_fingerprint(text, size):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "\x00").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32})
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def texts():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    near = []
    for t in base[:20]:
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            near.append(" ".join(w))
    return base + near + [None, "", " \n\t", "É é A", "a a a a a a a", "A a\na", "x" * 40_000, "w " * 30_000] + base[:5]


@pytest.mark.parametrize("size", [1, 4, 5])
def test_fingerprints_match_the_definition(size):
    for t in texts():
        assert simhash(shingle_hashes(t, size))[0] & (1 << 64) - 1 == brute_fingerprint(t, size)


@pytest.mark.parametrize("search", [{}, {"bands": 1, "leaves": 8}, {"bands": 3, "block": 16}, {"sample": 3, "block": 8}])
def test_components_match_brute_force(spark, search):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i + 10, t, 1, 2) for i, t in rows], "doc_id long, text string, leaf int, a int").repartition(4)
    got = {r.doc_id: (r.fingerprint & (1 << 64) - 1, r.component_id) for r in near_duplicates(docs, 4, 4, **search).collect()}
    prints = [brute_fingerprint(t, 4) for _, t in rows]
    assert got == {i + 10: (p, c + 10) for i, p, c in zip(range(len(rows)), prints, brute_components(prints, 4))}


@pytest.mark.parametrize("radius,bands", [(4, 5), (4, 1), (4, 2), (6, 3), (0, 1)])
def test_links_lose_no_component(spark, radius, bands):
    rng = np.random.default_rng(radius + bands)
    centre = rng.integers(0, 1 << 63, 30, dtype=np.int64)
    points = np.concatenate([centre, *[centre ^ (1 << rng.integers(0, 63, 30)) ^ (1 << rng.integers(0, 63, 30)) for _ in range(12)]])
    points = np.unique(np.append(points, [-1, 0, 1]))
    df = spark.createDataFrame([(int(p), int(p)) for p in points], "node long, w0 long")
    found = links(df, radius, split_bands(bands, 1), radius // bands, leaves=4, block=64)
    assert all(a > b for a, b in found.collect())
    roots = {r.node: r.root for r in components(found).collect()}
    label = brute_components([int(p) & (1 << 64) - 1 for p in points], radius)
    assert [roots.get(int(p), int(p)) for p in points] == [int(points[k]) for k in label]


def test_trees_deal_partners_into_a_common_leaf():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 1 << 63, 2000, dtype=np.int64).view("<u8")
    other = points ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype("<u8")) ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype("<u8"))
    for bands in (1, 2, 3):
        shared = np.zeros(2000, bool)
        for bits in split_bands(bands, 1):
            keys, near = band_keys(points[:, None], bits), band_keys(other[:, None], bits)
            assert (keys == sum((points >> np.uint64(b) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(bits))).all()
            tree = VantageTree(keys[:500], 2 // bands, 16, rng)
            home = {int(i): int(leaf) for i, leaf, h in zip(*tree.leaves(keys)) if h}
            assert len(home) == 2000
            for i, leaf, _ in zip(*tree.leaves(near)):
                shared[i] |= home[int(i)] == leaf
        assert shared.all()


def test_search_inside_a_shard_prunes_nothing_needed():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.int64).view("<u8")
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype("<u8"))
    found = {(int(x), int(y)) for a, b in near_pairs(base[:, None], near[:, None], 3) for x, y in zip(a, b)}
    x, y = np.nonzero(np.bitwise_count(base[:, None] ^ near[None, :]) <= 3)
    assert found == set(zip(x.tolist(), y.tolist()))


def test_pairs_of_equal_keys():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 8, (300, 2)).astype("<u8")
    keys, own = points[:, 0] & np.uint64(3), rng.integers(0, 2, 300)
    want = {(i, j) for i in range(300) for j in range(i) if keys[i] == keys[j] and np.bitwise_count(points[i] ^ points[j]).sum() <= 2}
    for low, high in ((0, 0), (0, 1)):
        pick = np.flatnonzero(own == low) if low == high else np.arange(300)
        got = {(max(pick[x], pick[y]), min(pick[x], pick[y])) for a, b in equal_key_pairs(points[pick], keys[pick], own[pick], low, high, 2) for x, y in zip(a, b)}
        assert got == {(i, j) for i, j in want if sorted((own[i], own[j])) == [low, high]}


def test_wide_bands_and_recall(spark):
    assert sorted(np.concatenate(wide_bands()).tolist()) == sorted(2 * list(range(64 * WIDE))) and len(wide_bands()) == 32
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for g in range(80):
        base = [rng.choice(words) for _ in range(200)]
        for k in range(3):
            copy = list(base)
            for _ in range((0, 1, 3)[k]):  # about 0.95 and 0.86 alike
                copy[rng.randrange(200)] = rng.choice(words)
            rows.append((g * 3 + k, " ".join(copy)))
    rows += [(1000 + i, " ".join(base[: 60 + i] + [rng.choice(words) for _ in range(140)])) for i in range(5)]
    found = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i] == i // 3 * 3 for i in range(240)) >= 230
    assert all(found[i] == i for i in range(1000, 1005)) and all(found[i] // 3 == i // 3 for i in range(240))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 700)] + [(900, 901), (901, 900), (950, 950)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {i: 500 for i in range(501, 700)} | {901: 900}


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (1, "a b c d e f g", "y"), (None, "A b c d e f g", "z"), (9, "q", None), (None, None, None), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(((r.doc_id, r.text or "", r.fingerprint) for r in one_of_each(docs).collect()), key=str)
    assert got == sorted([(1, "a b c d e f g", "y"), (9, "q", None), (None, "", None)], key=str)
    assert one_of_each(docs.limit(0)).collect() == [] and one_of_each(docs).schema == docs.schema


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [tuple(r) for r in near_duplicates(docs).collect()] == [(None, 0, None)]
    assert near_duplicates(docs.limit(0)).collect() == []


def test_similar_groups_are_those_of_exact_similarity(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for g in range(300):
        n, similar = (200, 40, 14)[g % 3], g % 2 == 0
        base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        # the last r words differ: (m - r) shingles of m + r are common
        m = n - 4
        r = max(k for k in range(m) if (m - k) / (m + k) >= 0.8) + (0 if similar else 1)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[: n - r] + [f"v{rng.randrange(10**9)}" for _ in range(r)]))]
        want[2 * g + 1] = 2 * g if similar else 2 * g + 1
    found = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(found[i] != i for i, c in want.items() if c == i)
    met = sum(found[i] == c for i, c in want.items() if c != i)
    assert met >= 0.94 * 150, met


def test_shortest_forest_has_the_least_length():
    rng = np.random.default_rng(8)
    for n in (1, 2, 30, 60):
        a, b = rng.integers(0, n, 150), rng.integers(0, n, 150)
        a, b = a[a != b], b[a != b]
        length = rng.integers(0, 9, len(a))
        got = shortest_forest(n, a, b, length)
        group, total, edges = list(range(n)), 0, 0
        for k in np.argsort(length, kind="stable"):  # one by one, the shortest first
            x, y = group[a[k]], group[b[k]]
            if x != y:
                group = [x if g == y else g for g in group]
                total, edges = total + length[k], edges + 1
        assert len(got) == edges and length[got].sum() == total


def test_columns_named_like_the_operators_own_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "k", 1), (2, "a b c d e f", "l", 2), (3, "g h i j k", "m", 3)], "doc_id long, text string, copy_key string, COPY_NTH int")
    got = one_of_each(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, "a b c d e f", "k", 1), (3, "g h i j k", "m", 3)]


def test_candidates_of_a_dense_group_leave_the_search_as_a_forest(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, WIDE, dtype=np.int64)
    points = []
    for i in range(300):  # all within 12 bits of each other, each with a label of its own
        words = centre.copy()
        for bit in rng.integers(0, 64 * WIDE, 6):
            words[bit // 64] ^= np.int64(1) << np.int64(bit % 64) if bit % 64 < 63 else np.int64(0)
        points.append((i, i, *map(int, words)))
    df = spark.createDataFrame(points, "node long, label long, " + ", ".join(f"w{k} long" for k in range(WIDE)))
    bands = pair_bands()
    got = links(df, 62, bands).collect()
    assert len(got) <= len(bands) * 299 < 300 * 299 / 2
    assert {r.root for r in components(spark.createDataFrame(got)).collect()} == {0}


@pytest.mark.parametrize("group,block", [(512, 2048), (4, 3)])
def test_links_inside_trees_are_those_of_the_sets(spark, group, block):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(40):  # some pairs are similar, many are near misses
        words = list(base)
        for k in rng.sample(range(60), 1 + i % 4):
            words[k] = f"v{i}-{k}"
        texts.append(" ".join(words))
    texts += ["far away text of its own", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    points = _points(_set_prints(docs, 5)).cache()
    labels = points.drop("doc_id").withColumn("label", points["node"])
    trees = components(links(labels, 62, pair_bands()))
    found = _links_inside(trees, labels, points, docs, 5, 0.8, 62, pair_bands(), sets_in_group=group, sets_in_block=block)
    doc = {r.node: r.doc_id for r in points.collect()}
    prints = {r.doc_id: r for r in points.collect()}
    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in enumerate(texts)}
    words = {i: np.array([prints[i][f"w{k}"] for k in range(WIDE)], "<i8").view("<u8") for i in sets}
    keys = {i: [int(band_keys(w[None, :], bits)[0]) for bits in pair_bands()] for i, w in words.items()}
    alike = [(i, j) for i in sets for j in range(i) if sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    met = [(i, j) for i, j in alike if distance(words[i], words[j]) <= 62 and any(a == b for a, b in zip(keys[i], keys[j]))]

    def groups(pairs):
        label = list(range(len(texts)))
        for i, j in pairs:
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
        return label

    got = [(doc[r.a], doc[r.b]) for r in found.collect()]
    assert got and all((max(p), min(p)) in set(alike) for p in got) and groups(got) == groups(met)
