import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bootlens.llm import quality_mil as qm
from tests.conftest import SF_SMALL
from tests.llm.rows import documents, odd_rows, prose

LABELS = "doc_id long, quality int, toxic int"


def junk(rng, kind, n=70):
    words = [rng.choice(["cheap", "click", "deal", "win", "now"]) for _ in range(n)]
    return " ".join([w.upper() + "!!" for w in words] if kind == 0 else [w + "$$$" for w in words] if kind == 1 else [words[0]] * n)


def corpus(n=300, seed=4):
    """Clean prose; every fourth document holds one passage or two of junk between clean ones."""
    rng, rows, labels = random.Random(seed), [], []
    for k in range(n):
        bad = k % 4 == 0
        parts = [prose(1000 * k + j, rng.randint(60, 130)) for j in range(rng.randint(1, 4))]
        if bad:
            parts.insert(rng.randint(0, len(parts)), junk(rng, k % 3, rng.randint(64, 140)))
        rows.append((k, "\n".join(parts), "en", f"src{k % 5}", 1))
        labels.append((k, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy_and_attention(spark):
    rows, labels = corpus()
    got = {r["doc_id"]: r for r in qm.classify(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = {i: y for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in got.items() if r["held_out"]} == set(held) and len(held) > 30
    assert sum(got[i]["predicted"] == y for i, y in held.items()) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    bad = [i for i, y, _ in labels if y == 0 and got[i]["passages"] >= 4]
    texts = {r[0]: r[1].split() for r in rows}
    ugly = lambda words: sum(w.endswith(("!!", "$$$")) or words.count(w) > 30 for w in words)
    seen = [ugly(texts[i][64 * got[i]["top_passage"]:64 * got[i]["top_passage"] + 64]) > 20 for i in bad]
    assert sum(seen) >= 0.8 * len(seen)   # the attention lies on the junk


def test_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = qm.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == y] for y in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_labels_of_held_out_documents_and_other_columns_do_not_matter(spark):
    rows, labels = corpus(120)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 1) for i, y, _ in labels]
    other = [(i, t, "xx", str(i), 0) for i, t, *_ in rows]
    a, b = (sorted(map(tuple, qm.classify(documents(spark, r, clash=False), spark.createDataFrame(y, LABELS)).collect())) for r, y in ((rows, labels), (other, flipped)))
    assert a == b


def test_odd_rows(spark):
    rows, labels = corpus(80)
    rows += [(1000 + (r[0] or 0), *r[1:]) for r in odd_rows()] + [(None, "a b", None, None, None), (2000, "x" * 700_000 + " " + prose(1, 90_000), "en", "a", 1), (2001, "\U0001F600\ud800 a", None, None, None)][:2]
    labels += [(None, 1, 0), (3, None, 0), (5, 7, 0), (7, 0, 0), (7, 1, 0), (9999, 0, 0), (1004, 0, 0), (1005, 1, 1)]
    df = documents(spark, rows).withColumn("score", F.lit(1)).withColumn("x", F.lit(2)).withColumn("held_out", F.lit(3))
    got = qm.classify(df, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("t")).withColumn("key", F.lit(1))).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in got) == sorted((r[0] is not None, r[0]) for r in rows)
    by = {r["doc_id"]: r for r in got}
    assert len({by[i]["score"] for i in (1004, 1005, 1006)}) == 1 and by[1004]["passages"] == 1
    assert by[2000]["passages"] >= 1400 and by[None]["held_out"] is False


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 0, 0)]])
def test_without_two_classes(spark, labels):
    got = qm.classify(documents(spark, [(1, prose(1), "en", "a", 1), (2, "", None, None, None)]), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 2 and len({r["score"] for r in got}) == 1 and 0 < got[0]["score"] < 1


def test_empty(spark):
    assert qm.classify(documents(spark, []), spark.createDataFrame([], LABELS)).collect() == []


def test_passages_do_not_depend_on_company():
    texts = [prose(1, 200), "", "one", prose(2, 64), " \n ", "ÀÉ été 12 $$$ ##"]
    alone = [qm.encode([t])[0] for t in texts]
    x, owner = qm.encode(texts)
    for k, a in enumerate(alone):
        assert np.array_equal(x[owner == k], a)
    assert [len(a) for a in alone] == [4, 1, 1, 1, 1, 1]


def test_long_texts_are_whole(monkeypatch):
    text = prose(3, 5000)
    monkeypatch.setattr(qm, "AT_ONCE", 1000)
    assert "".join(qm.pieces(text)) == text and len(list(qm.pieces(text))) > 10
    assert sum(len(x) for x, _ in qm.encoded([text, None, text])) >= 2 * 5000 / 64


def test_gradients():
    rng = np.random.default_rng(0)
    m = qm.Model.blank(rng, 0.1)
    x = rng.random((9, qm.WIDTH)) * 0.1
    args = x, np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, grad = qm._loss_and_gradients(m, *args)
    for name in ("embed", "shift", "view", "gate", "attend", "read", "bias"):
        w, g = getattr(m, name), getattr(grad, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = w[at], 1e-5
        w[at] = old + eps
        up = qm._loss_and_gradients(m, *args)[0]
        w[at] = old - eps
        down = qm._loss_and_gradients(m, *args)[0]
        w[at] = old
        assert g[at] == pytest.approx((up - down) / (2 * eps), rel=1e-4)
