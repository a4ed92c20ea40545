import numpy as np
import pytest
from pyspark.sql import functions as F

from bootlens.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=5, k=5):
    """Brute force over all pairs, in whole Python numbers."""
    live = {(i, y, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for i, y, a in live:
        if i % every:
            continue
        scored = [(sum(p * q for p, q in zip(a, b)), j, z) for j, z, b in live if len(a) == len(b)]
        good = sorted((-s, j) for s, j, z in scored if z == y and j != i)[:k]
        for minus, j in good:
            p = -minus
            bad = sorted((-s, n) for s, n, z in scored if z != y and 80 * p <= 100 * s <= 100 * p)[:k]
            out += [(i, j, r, n, p, -s) for r, (s, n) in enumerate(bad, 1)]
    return sorted(out)


def got(df, every=5, **kw):
    return sorted(map(tuple, hn.mine(df, is_anchor=F.col("id") % every == 0, **kw).collect()))


def clusters(n=240, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(0, 0.15, (n, dim))
    return [(k, [float(np.float32(c)) for c in v], int(rng.integers(0, 3))) for k, v in enumerate(x)]


@pytest.mark.parametrize("block, anchor_block", [(2048, 2048), (32, 7), (64, 1)])
def test_as_brute_force(spark, block, anchor_block):
    rows = clusters()
    assert got(spark.createDataFrame(rows, SCHEMA), block=block, anchor_block=anchor_block) == plain(rows)


def test_hot_label_copies_and_ties(spark):
    """One label holds most rows, one vector many ids: ties go by the smaller id."""
    rows = [(k, [1.0, 0.5], 1) for k in range(60)] + [(100 + k, [1.0, 0.5], 2) for k in range(30)] + [(200 + k, [0.9, 0.4 + k / 100], 1 + k % 3) for k in range(30)]
    out = got(spark.createDataFrame(rows, SCHEMA), block=16, anchor_block=4)
    assert out == plain(rows) and out


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clusters(60) + [(None, [1.0] * 8, 1), (300, None, 1), (301, [1.0] * 8, None), (305, [nan] + [1.0] * 7, 1), (310, [inf] + [1.0] * 7, 1), (315, [None] + [1.0] * 7, 1),
                           (320, [], 1), (325, [], 2), (330, [0.0] * 8, 1), (335, [1.0, 2.0], 1), (340, [1.0, 2.0], 1), (341, [1.0, 1.5], 2), (345, [-1.0] * 8, 2),
                           (5, [2.0] * 8, 1), (5, [2.0] * 8, 1), (10, [0.5] * 8, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "a", "c", "score", "rank", "anchor", "row", "at", "parent", "length", "vector", "one", "hash"):
        df = df.withColumn(name, F.lit(3))
    assert got(df, block=16, anchor_block=4) == plain(rows)


def test_empty_and_lonely(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(5, [1.0], 1), (6, [1.0], 2)], SCHEMA)) == []   # no positive
    assert got(spark.createDataFrame([(1, [1.0], 1), (6, [1.0], 2)], SCHEMA)) == []   # no anchor


def test_large_components(spark):
    """Beyond 2^53 sums are made of longs; a vector whose scores a long may not hold takes no part."""
    rows = [(k, [1e5 + k, 7e4 - k, 1.0 / (k + 1)], k % 2) for k in range(20)]
    doubles = SCHEMA.replace("float", "double")
    assert got(spark.createDataFrame(rows, doubles)) == plain(rows)
    assert got(spark.createDataFrame([*rows, (25, [1e30, 1.0, 1.0], 1)], doubles)) == plain(rows)


def test_tree_spans_and_is_least():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (30, 4))
    order, parent, length = hn.spanning_tree(x)
    place = {int(i): k for k, i in enumerate(order)}
    assert sorted(place) == list(range(30)) and all(place[int(p)] < place[i] for i, p in enumerate(parent) if p >= 0)
    edges, seen, total = sorted((np.linalg.norm(x[i] - x[j]), i, j) for i in range(30) for j in range(i)), list(range(30)), 0.0
    for d, i, j in edges:   # Kruskal
        if seen[i] != seen[j]:
            total += d
            a, b = seen[i], seen[j]
            seen = [b if s == a else s for s in seen]
    assert length.sum() == pytest.approx(total)


def test_bounds_save_scores():
    """On anchors that lie close together most candidates are never scored, and nothing is lost."""
    rng = np.random.default_rng(2)
    a = np.floor(256 * (np.ones(16) + rng.normal(0, 0.01, (40, 16))))
    x = np.floor(256 * rng.normal(0, 1, (500, 16)))
    order, parent, length = hn.spanning_tree(a)
    place = {int(i): k for k, i in enumerate(order)}
    parents = np.array([place[int(parent[i])] if parent[i] >= 0 else -1 for i in order])
    best = {}

    def asked(i, lower, upper):
        return np.nonzero(upper >= hn._kth(lower, 5))[0]

    def found(i, at, s):
        best[i] = sorted(s.tolist(), reverse=True)[:5]

    computed = hn.walk(a[order], parents, length[order], x, asked, found)
    assert best == {k: sorted((x @ a[i]).astype(int).tolist(), reverse=True)[:5] for k, i in enumerate(order)}
    assert computed < 0.3 * 40 * 500
