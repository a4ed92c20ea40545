"""Streams held to their batch forms (inputs end with a late flush row)."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from bootlens.operators import requests as rq, timeline as tl
from bootlens.operators.windows import last_wins
from bootlens.plans.standins import epoch_ns_of
from bootlens.streaming import boot as st

T0 = dt.datetime(2024, 1, 1)


def _stream(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run(df, tmp_dir, mode="append"):
    return st.run_to_files(df, f"{tmp_dir}/q_{uuid.uuid4().hex[:8]}", mode).collect()


def _at(s):
    return T0 + dt.timedelta(seconds=s)


def test_boot_outcome_stream_equals_batch(spark, tmp_dir):
    runs = [("a", 1, _at(0)), ("a", 2, _at(1000)), ("b", 3, _at(5)), ("c", 4, _at(50)), ("zz", 99, _at(90000))]
    notes = [("a", 10, _at(100), "ok"), ("a", 11, _at(120), "bad"), ("b", 12, _at(400), "ok"),
             ("c", 13, _at(60), "oops"), ("a", 14, _at(1100), "ok"), ("zz", 98, _at(90000), "ok")]
    r = spark.createDataFrame(runs, "bmc_id string, seq long, ts timestamp")
    n = spark.createDataFrame(notes, "bmc_id string, seq long, ts timestamp, status string")
    got = _run(st.boot_outcome_stream(_stream(spark, r, f"{tmp_dir}/r"), _stream(spark, n, f"{tmp_dir}/n")), tmp_dir)
    got = {(x.bmc_id, x.run_seq): (x.outcome, x.notice_seq) for x in got}
    batch = rq.boot_outcome(r.withColumn("epoch_ns", epoch_ns_of(F.col("ts"))), n.withColumn("epoch_ns", epoch_ns_of(F.col("ts"))),
                            partitions=3)
    exp = {(x.bmc_id, x.run_seq): (x.outcome, x.notice_seq) for x in batch.collect() if x.bmc_id != "zz"}
    assert got == exp
    assert exp[("a", 1)] == ("ok", 10) and exp[("b", 3)] == ("timed out", None)


def test_state_stream_equals_batch(spark, tmp_dir):
    ev = spark.createDataFrame([("c1", _at(1), 1, "up"), ("c1", _at(5), 2, "running"), ("c2", _at(2), 3, "pending"),
                                ("c1", _at(5), 4, "shutting-down")], "bmc_id string, ts timestamp, seq long, state string")
    got = {x.bmc_id: x.state for x in _run(st.state_stream(_stream(spark, ev, f"{tmp_dir}/e")), tmp_dir, "update")}
    exp = {x.bmc_id: x.state for x in last_wins(ev, ["bmc_id"], ["ts", "seq"], ["state"]).collect()}
    assert got == exp == {"c1": "shutting-down", "c2": "pending"}
    v = spark.createDataFrame([("pending",), ("up",), ("terminated",), (None,)], "s string")
    assert [x.v for x in v.select(st.wait_verdict(F.col("s")).alias("v")).collect()] == ["go", "wait", "fail", "fail"]


def test_interval_stream_equals_pairing(spark, tmp_dir):
    marks = [("c1", "boot", "begin", 1, _at(0)), ("c1", "boot", "end", 2, _at(30)), ("c1", "boot", "begin", 3, _at(100)),
             ("c1", "boot", "end", 4, _at(160)), ("c2", "boot", "begin", 5, _at(10)), ("zz", "boot", "begin", 9, _at(99999)),
             ("zz", "boot", "end", 10, _at(99999))]
    m = spark.createDataFrame(marks, "bmc_id string, phase string, kind string, seq long, ts timestamp")
    got = {(x.bmc_id, x.begin_seq): x.end_seq for x in _run(st.interval_stream(_stream(spark, m, f"{tmp_dir}/m")), tmp_dir)}
    batch = tl.pair_marks(m.withColumn("epoch_ns", epoch_ns_of(F.col("ts"))), ["bmc_id"], partitions=3)
    exp = {(x.bmc_id, x.begin_seq): x.end_seq for x in batch.collect() if x.bmc_id != "zz"}
    assert got == exp == {("c1", 1): 2, ("c1", 3): 4, ("c2", 5): None}


def test_the_next_mark_decides(spark, tmp_dir):
    """begin, begin, end: the first begin stays open, as a failed and retried phase does in the batch form."""
    marks = [("c1", "boot", "begin", 1, _at(0)), ("c1", "boot", "begin", 2, _at(10)), ("c1", "boot", "end", 3, _at(20)),
             ("c1", "boot", "begin", 4, _at(20)), ("c1", "boot", "end", 5, _at(20)), ("zz", "boot", "begin", 9, _at(99999))]
    m = spark.createDataFrame(marks, "bmc_id string, phase string, kind string, seq long, ts timestamp")
    got = {x.begin_seq: x.end_seq for x in _run(st.interval_stream(_stream(spark, m, f"{tmp_dir}/m")), tmp_dir) if x.bmc_id == "c1"}
    batch = tl.pair_marks(m.withColumn("epoch_ns", epoch_ns_of(F.col("ts"))), ["bmc_id"], partitions=2)
    assert got == {x.begin_seq: x.end_seq for x in batch.collect() if x.bmc_id == "c1"} == {1: None, 2: 3, 4: 5}


def test_a_session_is_used_once_until_it_expires(spark, tmp_dir):
    """Five micro-batches: the state outlives the watermark delay by far and ends with the session."""
    schema = "session_id string, nonce string, ts timestamp, rid long"
    hashes = spark.createDataFrame([("s1", _at(20000), "n"), ("s2", _at(100), "n"), ("s3", None, "n"), ("s4", _at(9e5), None)],
                                   "session_id string, session_good_for timestamp, nonce2 string")
    batches = [[("s1", "n", _at(5), 2), ("s1", "n", _at(1), 1), ("s3", "n", _at(0), 3), ("s4", "", _at(0), 4)],
               [("s2", "x", _at(50), 5), ("s9", "n", _at(50), 6)],
               [("s2", "n", _at(100), 7), ("s1", "n", _at(7300), 8)],
               [("s1", "n", _at(15000), 9), ("s2", "n", _at(15000), 10)],
               [("s1", "n", _at(30000), 11), ("s1", "n", _at(19999), 12)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_dir}/s/{i}")
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
         .parquet(f"{tmp_dir}/s"))
    got = sorted((x.session_id, x.seq) for x in _run(st.first_use_stream(s, hashes, seq="rid"), tmp_dir))
    assert got == [("s1", 1), ("s2", 7)]


def test_late_notice_is_ignored(spark, tmp_dir):
    """A notice that arrives after its run was closed by the watermark is
    dropped, as the reference ignores a notice after the deadline.

    One file per micro-batch (``maxFilesPerTrigger=1``) fixes what arrives
    when: batch 0 moves the watermark far past run a's bound, batch 1 closes
    run a (timed out), batch 2 brings a notice for a that is late."""
    rs = "bmc_id string, seq long, ts timestamp"
    ns = "bmc_id string, seq long, ts timestamp, status string"
    batches = [([("a", 1, _at(0)), ("z", 9, _at(5000))], [("z", 19, _at(5000), "ok")]),
               ([("zz", 8, _at(9000))], [("zz", 18, _at(9000), "ok")]),
               ([("zzz", 7, _at(12000))], [("a", 10, _at(60), "ok"), ("zzz", 17, _at(12000), "ok")])]
    for i, (runs, notes) in enumerate(batches):
        spark.createDataFrame(runs, rs).coalesce(1).write.parquet(f"{tmp_dir}/r/{i}")
        spark.createDataFrame(notes, ns).coalesce(1).write.parquet(f"{tmp_dir}/n/{i}")

    def src(path, schema):
        return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
                .parquet(path))

    out = st.boot_outcome_stream(src(f"{tmp_dir}/r", rs), src(f"{tmp_dir}/n", ns), timeout=180, watermark="1 second")
    got = {(x.bmc_id, x.run_seq): (x.outcome, x.notice_seq) for x in _run(out, tmp_dir)}
    assert got[("a", 1)] == ("timed out", None)
    assert got[("z", 9)] == ("ok", 19)


def _by_hand(waits, states, timeout):
    """Verdict of each wait: the state at its time, else the first that ends it."""
    out = {}
    for key, seq, at in waits:
        own = sorted((t, s, v) for k, s, t, v in states if k == key)
        now = [x for x in own if x[0] <= at]
        later = [x for x in own if at < x[0] < at + dt.timedelta(seconds=timeout)]
        end = {"pending": "go", "terminated": "fail", "shutting-down": "fail", None: "fail"}
        found = end.get(now[-1][2]) if now else "fail"
        found = found or next((end[v] for _, _, v in later if v in end), "timed out")
        out[(key, seq)] = found
    return out


def test_wait_with_a_deadline(spark, tmp_dir):
    """Micro-batches out of order inside the watermark delay; every wait has one verdict."""
    import random

    rng = random.Random(5)
    states = [(f"c{rng.randint(0, 5)}", 1000 + k, _at(rng.randint(0, 3000)), rng.choice(["up", "up", "up", "pending", "terminated", "shutting-down", None])) for k in range(80)]
    waits = [(f"c{rng.randint(0, 6)}", k, _at(rng.randint(0, 3000))) for k in range(120)]
    for i in range(4):   # arrival: by time, give or take 300 s
        early = lambda t, j: min(3, max(0, int(((t - T0).total_seconds() + (j * 97) % 300) // 800))) == i  # noqa: E731, B023
        spark.createDataFrame([r for r in states if early(r[2], r[1])] + ([("zz", 9999, _at(99999), "up")] if i == 3 else []),
                              "bmc_id string, seq long, ts timestamp, state string").coalesce(1).write.parquet(f"{tmp_dir}/s/{i}")
        spark.createDataFrame([r for r in waits if early(r[2], r[1])] + ([("zz", 9998, _at(99999))] if i == 3 else []),
                              "bmc_id string, seq long, ts timestamp").coalesce(1).write.parquet(f"{tmp_dir}/w/{i}")

    def src(name, schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_dir}/{name}")

    out = st.wait_stream(src("w", "bmc_id string, seq long, ts timestamp"), src("s", "bmc_id string, seq long, ts timestamp, state string"), timeout=400, watermark="15 minutes", parts=3)
    rows = [x for x in _run(out, tmp_dir) if x.bmc_id != "zz"]
    assert len(rows) == len(waits)
    assert {(x.bmc_id, x.seq): x.verdict for x in rows} == _by_hand(waits, states, 400)


def test_overlapping_runs_of_one_key(spark, tmp_dir):
    """10,000 overlapping runs of one container, then one notice: one row a run, and no more rows in state than came in."""
    n = 10_000
    runs = spark.range(n).select(F.lit("hot").alias("bmc_id"), F.col("id").alias("seq"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=(F.col("id") / 100).cast("decimal(18,6)"))).alias("ts"))
    runs = runs.unionByName(spark.createDataFrame([("zz", -1, _at(90000))], "bmc_id string, seq long, ts timestamp"))
    notes = spark.createDataFrame([("hot", 5, _at(120), "ok"), ("hot", 6, _at(130), "bad"), ("zz", 7, _at(90000), "ok")], "bmc_id string, seq long, ts timestamp, status string")
    out = st.boot_outcome_stream(_stream(spark, runs, f"{tmp_dir}/r"), _stream(spark, notes, f"{tmp_dir}/n"), timeout=110, parts=4)
    got = [x for x in _run(out, tmp_dir) if x.bmc_id == "hot"]
    assert len(got) == n and len({x.run_seq for x in got}) == n
    assert all((x.outcome, x.notice_seq) == (("ok", 5) if x.run_seq / 100 > 10 else ("timed out", None)) for x in got)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and "FlatMapGroupsInPandasWithState" in plan


def test_keys_share_states(spark, tmp_dir, monkeypatch):
    """A stream has no more states than buckets, however many keys, and each key its own answers."""
    from bootlens.streaming import inorder

    monkeypatch.setattr(inorder, "BUCKETS", 3)
    n = 200
    marks = spark.range(2 * n).select(F.concat(F.lit("k"), (F.col("id") % n).cast("string")).alias("bmc_id"), F.lit("p").alias("phase"), F.when(F.col("id") < n, "begin").otherwise("end").alias("kind"),
                                      F.col("id").alias("seq"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=(F.col("id") / 10).cast("decimal(18,6)"))).alias("ts"))
    marks = marks.unionByName(spark.createDataFrame([("zz", "p", "begin", -1, _at(90000))], "bmc_id string, phase string, kind string, seq long, ts timestamp"))
    out = st.interval_stream(_stream(spark, marks, f"{tmp_dir}/m"))
    assert "bucket" in out._jdf.queryExecution().analyzed().toString()
    assert {(x.bmc_id, x.begin_seq, x.end_seq) for x in _run(out, tmp_dir) if x.bmc_id != "zz"} == {(f"k{i}", i, i + n) for i in range(n)}
