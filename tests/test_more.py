"""Remaining operators: timeline stream, samples, lookups, ages, first/last
lines, SMT selection, deadlines."""

import datetime as dt
import os

from pyspark.sql import functions as F

from bootlens.functions import scalars as sc
from bootlens.operators import benchmark as bm, catalog as cat, timeline as tl, windows as win
from bootlens.sources import files as sf
from bootlens.sources.timeline import format_line, rejects, stream_timeline
from bootlens.streaming import boot as st
from tests.fleet import fleet


def test_stream_timeline_matches_batch(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/logs/h1")
    lines = ["2024-01-01 09:00:00|1704099600.000000001|7|C9 boot:begin bmcid=C9|",
             "2024-01-01 09:00:03|1704099603.000000000|7|C9 boot:end bmcid=C9|",
             "not a line"]
    with open(f"{tmp_dir}/logs/h1/time.1", "w") as f:
        f.write("\n".join(lines) + "\n")
    s = stream_timeline(spark, f"{tmp_dir}/logs/h1")
    read = st.run_to_files(s, f"{tmp_dir}/ck")
    rows = read.collect()
    assert {r.host for r in rows} == {"h1"} and sum(1 for r in rows if not r.valid) == 1
    m = tl.marks(read.where("valid"))
    assert sorted((r.phase, r.kind) for r in m.collect()) == [("boot", "begin"), ("boot", "end")]
    assert rejects(read).count() == 1
    out = spark.range(1).select(format_line(F.lit("d"), F.lit(1_500_000_000), F.lit(3), F.lit("a|b")).alias("x")).first().x
    assert out == "d|1.500000000|3|a|b|"


def test_samples_reader(spark, tmp_dir):
    with open(f"{tmp_dir}/watt.csv", "w") as f:
        f.write("ts,source,value\n2024-01-01 00:00:00,wattchecker,10.5\n2024-01-01 00:00:01,wattchecker,11\n")
    s = sf.read_samples(spark, f"{tmp_dir}/watt.csv")
    assert [r.value for r in s.orderBy("ts").collect()] == [10.5, 11.0]
    assert dict(s.dtypes)["ts"] == "timestamp"


def test_lookup_and_active(spark):
    nodes, conts, *_ = fleet(spark)
    keys = spark.createDataFrame([(3,), (9,)], "node_id long")
    got = sorted((r.node_id, r.node_name) for r in cat.lookup(keys, nodes, "node_id", ["node_name"]).collect())
    assert got == [(3, "n3"), (9, None)]
    assert cat.active(conts.union(conts.limit(1).withColumn("state", F.lit(None)))).count() == 2
    assert "password_mgmt" not in cat.node_view(nodes).columns


def test_accessed_since(spark):
    now = dt.datetime(2024, 1, 2, 12, 0, 0)
    ls = spark.createDataFrame([("a", now - dt.timedelta(hours=23)), ("b", now - dt.timedelta(hours=25))],
                               "path string, accessed timestamp")
    assert [r.path for r in sf.accessed_since(ls, F.lit(now)).collect()] == ["a"]


def test_first_and_last_lines(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), ("k", 2, "b"), ("j", 5, "z")],
                               "key string, line_no long, value string")
    assert {r.key: r.value for r in sf.first_line(df, "key", "line_no", "value").collect()} == {"k": "a", "j": "z"}
    assert {r.key: r.value for r in sf.last_line(df, "key", "line_no", "value").collect()} == {"k": "c", "j": "z"}
    fm = {r.key: r.value for r in win.first_match(df, ["key"], ["line_no"], ["value"]).collect()}
    assert fm == {"k": "a", "j": "z"}


def test_smt_selection(spark):
    cpus = spark.createDataFrame([("h", 0, 0), ("h", 4, 0), ("h", 1, 1), ("h", 5, 1)], "host string, cpu int, core int")
    got = {r.cpu: r.online for r in bm.smt_off_cpus(cpus).collect()}
    assert got == {0: 1, 4: 0, 1: 1, 5: 0}
    on = {r.cpu: r.first_flag for r in win.first_of_group(cpus, ["host", "core"], ["cpu"], mode="on").collect()}
    assert set(on.values()) == {1}


def test_deadlines(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    df = spark.createDataFrame([(t0,)], "start timestamp")
    r = df.select(sc.deadline("start", 180).alias("d"),
                  sc.time_left(sc.deadline("start", 180), F.lit(t0 + dt.timedelta(seconds=30))).alias("left"),
                  sc.expired(F.lit(t0), F.lit(t0)).alias("same"),
                  sc.expired(F.lit(t0), F.lit(t0 + dt.timedelta(seconds=1))).alias("later")).first()
    assert r.d == t0 + dt.timedelta(seconds=180) and r.left == 150.0
    assert r.same is False and r.later is True


def test_passwd_home(spark):
    lines = spark.createDataFrame([("root:x:0:0:root:/root:/bin/sh", 1), ("bob:x:1000:1000::/srv/bob:/bin/sh", 2),
                                   ("bob:x:1001:1001::/other:/bin/sh", 3)], "line string, line_no long")
    homes = sc.passwd_homes(lines)
    users = spark.createDataFrame([("bob",), ("eve",), ("root",)], "user string")
    got = {r.user: r.h for r in users.join(homes, "user", "left")
           .select("user", sc.home_dir(F.col("user"), F.col("home")).alias("h")).collect()}
    assert got == {"bob": "/srv/bob", "eve": "/home/eve", "root": "/root"}


def test_catalog_reader(spark, tmp_dir):
    from bootlens.schemas import NODE
    from bootlens.sources import catalog as src_cat

    nodes = fleet(spark)[0]
    nodes.write.parquet(f"{tmp_dir}/db/Node")
    back = src_cat.catalog(spark, f"{tmp_dir}/db", "Node")
    assert back.schema == NODE and back.count() == nodes.count()
    raw = spark.createDataFrame([("1",), ("0",), ("x",)], "v string")
    assert [r.b for r in raw.select(src_cat.as_bool("v").alias("b")).collect()] == [True, False, None]


def test_reset_atime_rule(spark):
    from bootlens.operators import quality as qa

    req = spark.createDataFrame([("a", "nfs", True), ("b", "ramfs", True), ("c", "ramfs", False), ("d", "isofs", None)],
                                "request_id string, fstype string, reset_atime boolean")
    assert [(r.key, r.detail) for r in qa.reset_atime_rule(req).collect()] == [("b", "fstype=ramfs")]


def test_insert_absent_and_log(spark, tmp_dir):
    from bootlens.operators import changes as chg
    from bootlens.schemas import KERNEL, LOG

    kernels = fleet(spark)[2]
    rows = spark.createDataFrame([(None, "kA", "x", None, None), (None, "kQ", "q", None, None)], KERNEL)
    new = {r.kernel_name: (r.kernel_id, r.kernel_file) for r in chg.insert_absent(kernels, rows, "kernel_name",
                                                                                  "kernel_id").collect()}
    assert new["kA"] == (10, "k/a") and new["kQ"] == (13, "q")
    log = spark.createDataFrame([(dt.datetime(2024, 1, 1), 42, "addnode n1")], LOG)
    chg.append_log(log, f"{tmp_dir}/log")
    chg.append_log(log, f"{tmp_dir}/log")
    assert spark.read.parquet(f"{tmp_dir}/log").count() == 2


def test_zero_length_and_open_only(spark):
    from bootlens.operators import meter

    def D(s):
        return int(s) * 1_000_000_000

    iv = spark.createDataFrame([("c", "p", D("10"), 1, D("10")), ("c", "p", D("20"), 2, D("30"))],
                               "bmc_id string, phase string, begin_ns long, begin_seq long, end_ns long")
    s = spark.createDataFrame([("c", D("10"), 5, 3.0), ("c", D("25"), 6, 4.0), ("c", D("30"), 7, 6.0)],
                              "bmc_id string, epoch_ns long, seq long, value double")
    got = {r.begin_seq: (r.n_samples, r.joule, r.watt) for r in meter.phase_energy(iv, s, delay=0, floor=None,
                                                                                  partitions=2).collect()}
    assert got == {1: (1, 0.0, None), 2: (2, 25.0, 2.5)}
    open_only = spark.createDataFrame([("c", "p", None, None)], "bmc_id string, phase string, end_ns long, "
                                                               "duration_ns long")
    r = tl.phase_times(open_only).first()
    assert (r.n_closed, r.n_open, r.total_sec, r.avg_sec) == (0, 1, None, None)
    assert spark.range(1).select(sc.gflops(F.lit(10), F.lit(0.0)).alias("g")).first().g is None
