import random
import zlib

from pyspark.sql import functions as F

from bootlens.llm import langid
from tests.conftest import SF_SMALL
from tests.llm.rows import documents, odd_rows

SOUNDS = {"xx": ["ka", "to", "mi", "ru"], "yy": ["bl", "est", "ung", "ich"], "zz": ["eau", "oi", "que", "lle"]}


def labelled(n=150, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(n):
        lang = sorted(SOUNDS)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(30)), lang, "a", 1))
    return rows


def test_held_out_accuracy(spark):
    got = langid.identify(documents(spark, labelled())).collect()
    truth = {r[0]: r[2] for r in labelled()}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1} and held
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    both = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in both) >= 0.95 * len(both)


def test_labels_of_held_out_documents_and_sources_do_not_matter(spark):
    rows = labelled()
    other = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 3 == 1 else y, str(i), n) for i, t, y, _, n in rows]
    a, b = (sorted(map(tuple, langid.identify(documents(spark, x, clash=False)).collect())) for x in (rows, other))
    assert a == b


def test_odd_rows(spark):
    rows = labelled(60) + [(1000 + (r[0] or 0), *r[1:]) for r in odd_rows()] + [(None, "kato miru", None, None, None), (2000, "12 34 !", "xx", "a", 1), (2001, "ka" * 500, None, "a", 1)]
    got = langid.identify(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i in (1004, 1005, 1006, 2000):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[2001]["lang_pred"] == "xx" and by[None]["held_out"] is False
    assert all(r["lang_pred"] != "und" for i, r in by.items() if i not in (1004, 1005, 1006, 2000))


def test_without_labels_and_empty(spark):
    assert {r["lang_pred"] for r in langid.identify(documents(spark, [(1, "abc", None, "a", 1)])).collect()} == {"und"}
    assert langid.identify(documents(spark, [])).collect() == []


def test_grams_of_words_do_not_depend_on_company():
    one = [sorted(langid.gram_buckets([w])[0].tolist()) for w in ("abc", "é", "\U0001F600x")]
    found, own = langid.gram_buckets(["abc", "é", "\U0001F600x"])
    assert [sorted(found[own == k].tolist()) for k in range(3)] == one


def test_rejection_is_calibrated(spark):
    """Scraps with labels at random are learnt to be doubtful; real texts pass."""
    rng, rows = random.Random(9), labelled(240)
    junk = ["".join(rng.choice("qwx") for _ in range(4)) for _ in range(60)]
    model = langid.train([r[1] for r in rows] + junk, [r[2] for r in rows] + [rng.choice(sorted(SOUNDS)) for _ in junk])
    texts = [(k, t) for k, t in enumerate([r[1] for r in rows] + junk)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit(1))
    rejected = {r["doc_id"] for r in langid.predict(df, model).collect() if r["rejected"]}
    assert len([k for k in rejected if k < 240]) <= 24 and len([k for k in rejected if k >= 240]) >= 57
