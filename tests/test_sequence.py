"""ordered_scan against plain windows, with a hot key cut over many ranges."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from bootlens.operators.sequence import Count, Fill, Lag, ordered_scan


@pytest.fixture(scope="module")
def seq_df(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 1, 1, 1, 1, 2, 3, None]), rnd.randint(0, 40), i, rnd.choice([None, 1, 2]),
             rnd.random() < 0.25) for i in range(2500)]
    return spark.createDataFrame(rows, "k int, t int, seq long, v int, flag boolean")


@pytest.mark.parametrize("desc", [False, True])
def test_scan_matches_windows(spark, seq_df, desc):
    got = ordered_scan(seq_df, ["k"], ["t", "seq"],
                       [Lag(["v", "seq"]), Fill(["v", "seq"], F.col("flag"), "f_"), Count("n"),
                        Count("nf", F.col("flag"))], descending=desc, partitions=9)
    o = [F.col("t").desc(), F.col("seq").desc()] if desc else [F.col("t"), F.col("seq")]
    w = W.partitionBy("k").orderBy(*o)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    exp = seq_df.select(
        "*", F.lag("v").over(w).alias("prev_v"), F.lag("seq").over(w).alias("prev_seq"),
        F.last(F.when(F.col("flag"), F.struct("v", "seq")), ignorenulls=True).over(upto).alias("s"),
        F.count(F.lit(1)).over(upto).alias("n"), F.sum(F.col("flag").cast("long")).over(upto).alias("nf"))
    exp = exp.select(*seq_df.columns, "prev_v", "prev_seq", F.col("s.v").alias("f_v"), F.col("s.seq").alias("f_seq"),
                     "n", "nf")
    got = got.select(*exp.columns)
    assert got.exceptAll(exp).count() == 0
    assert exp.exceptAll(got).count() == 0


def test_hot_key_is_split(spark, seq_df):
    """The hot key (most rows) must land in several ranges."""
    from bootlens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    ranged = seq_df.repartitionByRange(9, "k", "t", "seq").withColumn("p", F.spark_partition_id())
    assert ranged.where("k = 1").select("p").distinct().count() > 1


def test_many_empty_ranges_and_global_numbering(spark):
    rows = [(i % 3 if i % 5 else None, i * 7 % 11, i) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, t int, seq long")
    got = ordered_scan(df, ["k"], ["t", "seq"], [Lag(["seq"]), Count("n")], partitions=97)
    w = W.partitionBy("k").orderBy("t", "seq")
    exp = df.select("*", F.lag("seq").over(w).alias("prev_seq"), F.row_number().over(w).cast("long").alias("n"))
    assert got.select(*exp.columns).exceptAll(exp).count() == 0
    glob = ordered_scan(df, [], ["t", "seq"], [Count("n")], partitions=6)
    exp2 = df.select("seq", F.row_number().over(W.orderBy("t", "seq")).cast("long").alias("n"))
    assert glob.select("seq", "n").exceptAll(exp2).count() == 0


def test_empty_input(spark):
    df = spark.createDataFrame([], "k int, t int, seq long")
    out = ordered_scan(df, ["k"], ["t", "seq"], [Lag(["seq"]), Fill(["seq"], F.lit(True)), Count("n")], partitions=4)
    assert out.count() == 0 and "prev_seq" in out.columns


@pytest.mark.parametrize("parts", [1, 2, 13])
def test_result_does_not_depend_on_ranges(spark, seq_df, parts):
    ops = lambda: [Lag(["v"]), Fill(["seq"], F.col("flag"), "f_"), Count("n")]
    base = ordered_scan(seq_df, ["k"], ["t", "seq"], ops(), descending=True, partitions=5)
    other = ordered_scan(seq_df, ["k"], ["t", "seq"], ops(), descending=True, partitions=parts)
    assert base.exceptAll(other).count() == 0 and other.exceptAll(base).count() == 0


def test_default_ranges_may_be_merged(spark, seq_df):
    """Without ``partitions`` the ranges come from the session and AQE may
    merge adjacent ones; the result is the same as plain windows."""
    got = ordered_scan(seq_df, ["k"], ["t", "seq"], [Lag(["seq"]), Count("n")])
    w = W.partitionBy("k").orderBy("t", "seq")
    exp = seq_df.select("*", F.lag("seq").over(w).alias("prev_seq"), F.row_number().over(w).cast("long").alias("n"))
    got = got.select(*exp.columns)
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_random_inputs_match_windows(spark):
    """Property check on random small inputs (hypothesis): any keys (NULL
    included), ties in time broken by seq, any range count."""
    from hypothesis import given, settings, strategies as st

    row = st.tuples(st.sampled_from([None, 1, 2]), st.integers(0, 5), st.booleans())

    @settings(max_examples=4, deadline=None)
    @given(st.lists(row, min_size=0, max_size=40), st.integers(1, 6), st.booleans())
    def check(rows, parts, desc):
        data = [(k, t, i, f) for i, (k, t, f) in enumerate(rows)]
        df = spark.createDataFrame(data, "k int, t int, seq long, flag boolean")
        got = ordered_scan(df, ["k"], ["t", "seq"], [Lag(["seq"]), Fill(["seq"], F.col("flag"), "f_"), Count("n")],
                           descending=desc, partitions=parts)
        o = [F.col("t").desc(), F.col("seq").desc()] if desc else [F.col("t"), F.col("seq")]
        w = W.partitionBy("k").orderBy(*o)
        upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
        exp = df.select("*", F.lag("seq").over(w).alias("prev_seq"),
                        F.last(F.when(F.col("flag"), F.col("seq")), ignorenulls=True).over(upto).alias("f_seq"),
                        F.count(F.lit(1)).over(upto).alias("n"))
        got = got.select(*exp.columns)
        assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0

    check()


def test_a_forward_scan_keeps_no_copy_of_its_order(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "k string, o long, v long")
    out = ordered_scan(df, ["k"], ["o"], [Lag(["v"])])
    assert "_pos" not in out._jdf.queryExecution().analyzed().toString()
    assert [tuple(x) for x in out.orderBy("o").collect()] == [("a", 1, 5, None), ("a", 2, 6, 5)]


@pytest.mark.parametrize("parts,desc", [(1, False), (9, False), (97, False), (9, True)])
def test_totals_of_whole_runs(spark, parts, desc):
    """Minimum and maximum over all rows of a run, those behind a row too; runs span many ranges, are cut by their
    edges, hold no value, come before any start, and keys are NULL."""
    rnd = random.Random(11)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.randint(0, 60), i, rnd.choice([None, None, None, *"abcd"]), rnd.random() < 0.02) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, t int, seq long, v string, flag boolean")
    got = ordered_scan(df, ["k"], ["t", "seq"], [Fill(["t", "seq"], F.col("flag"), "run_", least={"lo": F.col("v")}, greatest={"hi": F.upper("v"), "top": F.col("seq")})],
                       descending=desc, partitions=parts)
    w = W.partitionBy("k").orderBy(*[F.col(c).desc() if desc else F.col(c) for c in ("t", "seq")]).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = W.partitionBy("k", "run_t", "run_seq")
    exp = (df.withColumn("s", F.last(F.when(F.col("flag"), F.struct("t", "seq")), ignorenulls=True).over(w)).select(*df.columns, F.col("s.t").alias("run_t"), F.col("s.seq").alias("run_seq"))
           .select("*", F.min("v").over(run).alias("lo"), F.max(F.upper("v")).over(run).alias("hi"), F.max("seq").over(run).alias("top")))
    assert sorted(map(repr, got.select(*exp.columns).collect())) == sorted(map(repr, exp.collect()))


def test_rows_are_not_shuffled_to_meet_the_edges_of_ranges(spark):
    """The edges are small however many rows there are, and are planned as such."""
    df = spark.range(60_000).select((F.col("id") % 7).alias("k"), (F.hash("id") % 1000).alias("t"), F.col("id").alias("seq"), F.xxhash64("id").alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        out = ordered_scan(df, ["k"], ["t", "seq"], [Lag(["v"]), Fill(["v"], F.col("v") > 0, greatest={"most": F.col("v")})], descending=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_reverse_scan_writes_no_copy_of_its_order(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "k string, o long, v long")
    out = ordered_scan(df, ["k"], ["o"], [Lag(["v"])], descending=True)
    assert "_pos" not in out._jdf.queryExecution().analyzed().toString()
    assert [tuple(x) for x in out.orderBy("o").collect()] == [("a", 1, 5, 6), ("a", 2, 6, None)]
