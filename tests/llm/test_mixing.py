import pytest
from pyspark.sql import functions as F

from bootlens.llm import mixing
from tests.llm.rows import documents, odd_rows, prose


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rate = (goal - sum(2 * sizes[s] for s in capped)) / max(1e-300, sum(weight[s] for s in sizes if s not in capped))
        above = {s for s in sizes if s not in capped and weight[s] * rate > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * rate for s in sizes}
        capped |= above


def many(n=400):
    return [(k, prose(k, 5 + (k * 37) % 90), "en", None if k % 11 == 0 else "s%d" % (k % 5 if k % 3 else 0), 1) for k in range(n)]


def test_targets_and_taken(spark):
    rows = many()
    got = mixing.mix(documents(spark, rows)).collect()
    size = {i: len(t.split()) for i, t, *_ in rows}
    sizes = {}
    for i, _, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    target, source = plain_targets(sizes), {r[0]: r[3] for r in rows}
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s]) and r["target"] == pytest.approx(target[s], rel=1e-12)
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert r["taken"] >= int(target[s] // sizes[s]) * r["size"]  # complete epochs first
    assert all(abs(taken[s] - target[s]) <= 60 for s in sizes)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))


@pytest.mark.parametrize("long_id", [3, 1500, 2999, 7777])
def test_one_long_document_does_not_end_the_draw(spark, long_id):
    """A source of many short texts and one very long one, which often stands early in key order."""
    rows = [(k, prose(k % 50, 60), "en", "b", 1) for k in range(3000) if k != long_id]
    rows += [(long_id, " ".join(["word"] * 40_000), "en", "b", 1)]
    rows += [(10_000 + k, prose(k, 80), "en", "ac"[k % 2], 1) for k in range(600)]
    df = documents(spark, rows, clash=False)
    source = {r[0]: r[3] for r in rows}
    taken, target, total = {}, {}, {}
    for r in mixing.mix(df).collect():
        s = source[r["doc_id"]]
        taken[s], target[s], total[s] = taken.get(s, 0) + r["taken"], r["target"], r["source_size"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[s] - target[s]) <= 60 for s in taken)
    assert mixing.take(df).count() > 0


def test_reruns_agree_on_any_partitioning(spark):
    df = documents(spark, many(200), clash=False)
    runs = [sorted(map(tuple, mixing.mix(df.repartition(n)).select("doc_id", "taken").collect())) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_heavier_documents_are_taken_more_often(spark):
    df = spark.range(20000).select(F.col("id"), mixing.key(F.col("id"), F.lit(4.0)).alias("heavy"), mixing.key(F.col("id") + 20000, F.lit(1.0)).alias("light"))
    share = df.agg(F.avg((F.col("heavy") < F.col("light")).cast("int"))).first()[0]
    assert share == pytest.approx(0.8, abs=0.02)  # 4 / (4 + 1)


def test_odd_rows_and_the_mix_itself(spark):
    df = documents(spark)
    mixed = mixing.mix(df)
    assert mixed.count() == len(odd_rows())
    taken = {(r[0], r[1]): r[2] for r in mixed.groupBy("doc_id", "size").agg(F.sum("taken")).collect()}
    out = mixing.take(df)
    assert out.columns == df.columns
    words = out.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).alias("s")).groupBy("doc_id", "s").agg(F.sum("s")).collect()
    assert {(r[0], r[1]): r[2] for r in words if r[2]} == {k: v for k, v in taken.items() if v}


def test_no_words_and_empty(spark):
    assert [r["taken"] for r in mixing.mix(documents(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)])).collect()] == [0, 0]
    assert mixing.mix(documents(spark, [])).collect() == [] and mixing.take(documents(spark, [])).collect() == []
