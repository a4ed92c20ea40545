import random

import pytest
import xxhash
from pyspark.sql import functions as F

from bootlens.llm import simhash
from bootlens.llm.common import components
from tests.llm.rows import documents, odd_rows, prose

signed = lambda x: x - (1 << 64) if x >> 63 else x


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(items, near):
    comp = {k: k for k in items}
    for _ in items:
        comp = {a: min(comp[b] for b in items if near(a, b)) for a in items}
    return comp


def test_fingerprints(monkeypatch):
    texts = [None, "", "  ", "A b", "a B", "One\x0btwo\x1cthree\xa0four five", "É É É É", prose(2, 500)]
    want = [plain_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(simhash, "CHUNK_WORDS", 7)
    assert [simhash.fingerprint(t) for t in texts] == want


@pytest.mark.parametrize("cell_rows", [0, 1, 16])
@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_links_connect_what_brute_force_connects(spark, cell_rows, max_bits):
    rng = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = simhash.links(df, max_bits=max_bits, cell_rows=cell_rows)
    assert found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > max_bits).count() == 0
    got = {r["node"]: r["component"] for r in components(found, "a", "b").collect()}
    items = [signed(x) for x in fps]
    want = plain_components(items, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits)
    assert {k: got.get(k, k) for k in items} == want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(300, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 100 for k in range(100, 160)} | {200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_odd_documents(spark):
    got = sorted((tuple(r) for r in simhash.near_duplicates(documents(spark)).collect()), key=str)
    fp = {k: plain_fingerprint(r[1]) for k, r in enumerate(odd_rows())}
    near = plain_components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    want = []
    for k, r in enumerate(odd_rows()):
        ids = [x[0] for j, x in enumerate(odd_rows()) if near[j] == near[k] and x[0] is not None]
        want.append((r[0], f"{fp[k]:016x}", min(ids) if ids else None))
    assert got == sorted(want, key=str)


def test_keep_one(spark):
    df = documents(spark)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str)
    assert ids == sorted([1, 3, 4, 7, 8, 9, 12, 13, None, None, None], key=str)  # 2 copies 1; 5 and 6 have no words like 4; 9 twice; no id: kept
    assert simhash.keep_one(documents(spark, [])).collect() == [] and simhash.near_duplicates(documents(spark, [])).collect() == []


def test_keep_one_judges_rows_that_share_an_id_by_their_texts(spark):
    a, b, c = prose(50), prose(51), prose(52)
    rows = [(5, a), (5, b), (3, b), (7, a), (8, c), (8, c), (8, a), (2, c)]
    kept = simhash.keep_one(documents(spark, [(i, t, "en", "a", 1) for i, t in rows]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(5, a), (3, b), (2, c)])
    rows = [(5, a), (5, b), (5, b), (7, a), (9, b)]  # two components with one smallest id
    kept = simhash.keep_one(documents(spark, [(i, t, "en", "a", 1) for i, t in rows]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(5, a), (5, b)])
