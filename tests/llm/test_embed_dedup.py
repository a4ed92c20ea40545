import numpy as np
import pytest
from pyspark.sql import functions as F

from bootlens.llm import embed_dedup as e


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = [v / np.linalg.norm(v) for _, v in ok]
    link = np.array([[a != b and len(x) == len(y) and x @ y >= threshold for b, y in enumerate(unit)] for a, x in enumerate(unit)]).reshape(len(ok), len(ok))
    root = np.arange(len(ok))
    ids = np.array([i for i, _ in ok])
    comp = ids.copy()
    for _ in root:
        comp = np.array([min([comp[a], *comp[link[a]]]) for a in range(len(ok))])
    out = [(int(i), int(link[a].sum()), int(comp[a])) for a, i in enumerate(ids)]
    return sorted(out + [(i, 0, i) for i, v in rows if not any(i == j for j, _ in ok)], key=str)


def clusters(n, size, d=64, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        centre = rng.normal(size=d)
        rows += [[float(np.float32(x)) for x in centre + rng.normal(size=d) * 0.1 * rng.random()] for _ in range(size)]
    return [(k * 3 + 1, v) for k, v in enumerate(rows)]


def run(spark, rows, **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("copies", F.lit("x")).repartition(3)
    got = [tuple(r) for r in e.near_duplicates(df, **settings).collect()]
    assert all(kept == (i == c) for i, _, c, kept in got)
    return sorted((r[:3] for r in got), key=str)


def test_as_brute_force_with_odd_vectors(spark):
    rows = clusters(20, 12)
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, None), (903, []), (904, [0.0] * 64), (905, [float("nan")] + [1.0] * 63),
             (906, [float("inf")] * 64), (907, [None] + [1.0] * 63), (908, [2 * x for x in rows[0][1]]), (909, [-x for x in rows[0][1]]), (910, [1.0, 2.0]), (911, [1.0, 2.0]), (912, [3.0])]
    got, want = run(spark, rows), brute(rows)
    links = lambda rs: sum(r[1] for r in rs)
    assert links(got) >= 0.99 * links(want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert [g[2] for g in got] == [w[2] for w in want]


def test_small_blocks_count_each_link_once(spark):
    rows = clusters(2, 60, seed=5)
    assert run(spark, rows, block=16) == run(spark, rows, block=512)


def test_recall_on_near_threshold_links(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        a, b = rng.normal(size=64), rng.normal(size=64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.951 + 0.02 * rng.random()
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    got, want = run(spark, rows), brute(rows)
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want)


def test_null_id_and_empty(spark):
    assert run(spark, [(None, [1.0, 2.0]), (1, [1.0, 2.0])]) == [(1, 0, 1), (None, 0, None)]
    assert run(spark, []) == []


def test_hadamard_keeps_lengths_and_buckets_agree():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(e.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert (e.buckets(x) == e.buckets(3.0 * x)).all() and e.buckets(x).shape == (5, e.TABLES * e.PROBES)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_narrow_vectors(spark, width):
    rows = [(k, [float(1 + k % 2)] + [0.5] * (width - 1)) for k in range(8)]
    assert [r[2] for r in run(spark, rows)] == [r[2] for r in brute(rows)]


def test_pairs_that_met_before():
    rng = np.random.default_rng(3)
    for n, spread in ((40, 6), (40, 4000), (7, 2)):
        codes = rng.integers(0, spread, (n, 9))
        a, b = np.nonzero(~np.eye(n, dtype=bool))   # a row is not linked with itself
        for links in (slice(None), slice(0, 5)):
            got = e._met_before(codes, spread // 2, a[links], b[links])
            assert got.tolist() == [bool({c for c in codes[i] if c < spread // 2} & set(codes[j])) for i, j in zip(a[links], b[links])]


def test_dense_group(spark):
    """4,000 vectors in one tight cone: all linked with all, each pair counted once."""
    rng = np.random.default_rng(8)
    x = np.ones(32) + rng.normal(0, 0.03, (4000, 32))
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = e.near_duplicates(df).agg(F.min("n_links"), F.max("n_links"), F.max("component_id"), F.count("*")).first()
    assert tuple(got) == (3999, 3999, 0, 4000)
