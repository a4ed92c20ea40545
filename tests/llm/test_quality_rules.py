import random

from bootlens.llm import quality_rules as q
from tests.llm.rows import documents, odd_rows, prose

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return n, n[0] < 50 or 100 * n[4] > 50 * n[0]


def test_counts_as_plain_python(spark):
    rng, rows = random.Random(2), []
    for k in range(150):
        vocabulary = rng.choice([["a", "b"], ["a", "b", "c", "dé"], "the # ** x|y $ é \U0001F600 \x1c \xa0 zz".split(" ")])
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\n\n", "\t", "\x0b", "\r\n"]) for _ in range(rng.randint(0, 70)))
        rows.append((k, text, None, None, None))
    rows += [r for r in odd_rows() if r[0] in (1, 3, 4, 5, 6, 7, 12, 13)]
    rows = list({r[0]: r for r in rows}.values())
    got = {r["doc_id"]: (tuple(r)[1:6], r["base_failed"]) for r in q.judge(documents(spark, rows)).collect()}
    assert got == {r[0]: plain(r[1]) for r in rows}


def test_verdicts(spark):
    rows = [(1, prose(1), "en", "a", 1), (2, "the " * 49, "en", "a", 1), (3, prose(2).replace(" ", " #$%& "), "en", "a", 1),
            (4, " ".join(f"xq{i}z" for i in range(100)), "en", "a", 1), (5, "same line of the words here\n" * 20, "en", "a", 1), (6, None, None, None, None)]
    got = {r["doc_id"]: r["kept"] for r in q.judge(documents(spark, rows)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_stage_agrees_and_plan_is_native(spark):
    df = documents(spark)
    kept = q.keep_good(df)
    assert kept.columns == df.columns
    want = sorted((r["doc_id"] for r in q.judge(df).where("kept").collect()), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want and 8 in want
    plan = kept._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange hash" not in plan


def test_empty(spark):
    assert q.judge(documents(spark, [])).collect() == [] and q.keep_good(documents(spark, [])).collect() == []
