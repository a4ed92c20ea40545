"""Change sets: insert, upsert, replace, set, delete, state events."""

import datetime as dt

from pyspark.sql import functions as F

from bootlens.operators import changes as chg
from bootlens.schemas import KERNEL
from tests.fleet import fleet


def test_insert_upsert_replace(spark):
    _, _, kernels, _, _ = fleet(spark)
    ch = spark.createDataFrame([("kA", "k/a2", "k/a2.sig"), ("kN", "k/n", None), ("kM", "k/m", "")],
                               "kernel_name string, kernel_file string, kernel_sig_file string")
    up = {r.kernel_name: r for r in chg.apply_upsert(kernels, ch, "kernel_name", "kernel_id").collect()}
    assert (up["kA"].kernel_id, up["kA"].kernel_file, up["kA"].kernel_param) == (10, "k/a2", "quiet")
    assert (up["kM"].kernel_id, up["kN"].kernel_id, up["kN"].kernel_param) == (13, 14, "")
    assert up["kB"].kernel_file == "k/b"
    rep = {r.kernel_name: r for r in chg.apply_replace(kernels, ch.withColumn("kernel_param", F.lit(None).cast("string")),
                                                       "kernel_name", "kernel_id").collect()}
    assert (rep["kA"].kernel_id, rep["kM"].kernel_id, rep["kN"].kernel_id) == (13, 14, 15)
    assert len(rep) == 5
    rows = spark.createDataFrame([(None, "kA", "f", None, None), (None, "kZ", "f", "", "")], KERNEL)
    new, refused = chg.apply_insert(kernels, rows, "kernel_name", "kernel_id")
    assert [r.kernel_name for r in refused.collect()] == ["kA"]
    z = {r.kernel_name: r for r in new.collect()}["kZ"]
    assert z.kernel_id == 13 and z.kernel_sig_file is None and z.kernel_param is None


def test_set_and_delete(spark):
    _, _, kernels, _, _ = fleet(spark)
    ch = spark.createDataFrame([("kB", "new"), ("kQ", "x")], "kernel_name string, kernel_param string")
    new, unknown = chg.set_column(kernels, ch, "kernel_name", "kernel_param")
    assert {r.kernel_name: r.kernel_param for r in new.collect()}["kB"] == "new"
    assert [r.kernel_name for r in unknown.collect()] == ["kQ"]
    new, unknown = chg.delete_by_name(kernels, ch.select("kernel_name"), "kernel_name")
    assert sorted(r.kernel_name for r in new.collect()) == ["kA", "kC"] and unknown.count() == 1


def test_state_events(spark):
    _, conts, *_ = fleet(spark)
    ev = spark.createDataFrame([("c1", 1, 1, "shutting-down"), ("c1", 2, 2, "terminated"),
                                ("c4", 1, 3, "removed"), ("c3", 1, 4, "removed")],
                               "bmc_id string, epoch_ns long, seq long, state string")
    new, refused = chg.apply_states(conts, ev)
    got = {r.bmc_id: (r.state, r.node_id) for r in new.collect()}
    assert got["c1"] == ("terminated", None) and "c3" not in got and got["c4"] == ("pending", 2)
    assert [r.bmc_id for r in refused.collect()] == ["c4"]
    forced, _ = chg.apply_states(conts, ev, force=True)
    assert "c4" not in {r.bmc_id for r in forced.collect()}
    assert {r.bmc_id: r.state for r in chg.latest_state(ev).collect()}["c1"] == "terminated"
    _ = dt


def _events(spark, rows):
    return spark.createDataFrame([(b, k, k, s) for k, (b, s) in enumerate(rows)], "bmc_id string, epoch_ns long, seq long, state string")


def test_kill_then_remove(spark):
    """rm of a live container is refused; kill then rm deletes it, whatever came before."""
    _, conts, *_ = fleet(spark)
    ev = _events(spark, [("c1", "removed"), ("c1", "terminated"), ("c1", "removed"),      # refused, killed, gone
                         ("c2", "running"), ("c2", "removed"),                           # live by its last event: refused
                         ("c4", "terminated"), ("c4", None), ("c4", "removed"),            # NULL is live: refused, node is free
                         ("zz", "removed")])
    new, refused = chg.apply_states(conts, ev, partitions=3)
    assert {r.bmc_id: (r.state, r.node_id) for r in new.collect()} == {"c2": ("running", 3), "c3": ("terminated", None), "c4": (None, None)}
    assert sorted(r.bmc_id for r in refused.collect()) == ["c1", "c2", "c4"]
    new, refused = chg.apply_states(conts, ev, force=True)
    assert sorted(r.bmc_id for r in new.collect()) == ["c3"] and refused.count() == 0


def test_repeated_names_and_deleted_ids(spark):
    _, _, kernels, _, _ = fleet(spark)
    ch = spark.createDataFrame([(1, "kA", "a1", "s"), (2, "kA", "a2", "s"), (3, "kN", "n1", "s"), (4, "kN", "n2", "s")],
                               "line int, kernel_name string, kernel_file string, kernel_sig_file string")
    table = kernels.where("kernel_name != 'kC'")      # id 12 was given to kC once
    up = {r.kernel_name: (r.kernel_id, r.kernel_file) for r in chg.apply_upsert(table, ch, "kernel_name", "kernel_id", order=["line"], highest=12).collect()}
    assert up == {"kA": (10, "a2"), "kB": (11, "k/b"), "kN": (13, "n2")}
    full = ch.withColumn("kernel_param", F.lit("p"))
    rep = {r.kernel_name: (r.kernel_id, r.kernel_file) for r in chg.apply_replace(table, full, "kernel_name", "kernel_id", order=["line"], highest=12).collect()}
    assert rep == {"kA": (13, "a2"), "kB": (11, "k/b"), "kN": (14, "n2")}
    new, refused = chg.apply_insert(table, full, "kernel_name", "kernel_id", order=["line"], highest=12)
    assert {r.kernel_name: (r.kernel_id, r.kernel_file) for r in new.collect()} == {"kA": (10, "k/a"), "kB": (11, "k/b"), "kN": (13, "n1")}
    assert sorted((r.kernel_name, r.line) for r in refused.collect()) == [("kA", 1), ("kA", 2), ("kN", 4)]
    new, _ = chg.set_column(table, full.withColumn("kernel_param", F.col("kernel_file")), "kernel_name", "kernel_param", order=["line"])
    assert sorted((r.kernel_name, r.kernel_param) for r in new.collect()) == [("kA", "a2"), ("kB", None)]


def test_states_as_one_by_one(spark):
    """Random events of few containers over many ranges, against a plain loop."""
    import random

    rng = random.Random(4)
    table = [(f"c{k}", rng.choice(["up", "terminated", None]), k) for k in range(12)]
    events = [(f"c{min(11, int(rng.expovariate(0.5)))}", rng.randint(0, 40), n, rng.choice(["up", "running", "terminated", "removed", "removed", None])) for n in range(400)]
    conts = spark.createDataFrame(table, "bmc_id string, state string, node_id long")
    ev = spark.createDataFrame(events, "bmc_id string, epoch_ns long, seq long, state string").repartition(4)
    for force in (False, True):
        want, refused = {}, set()
        for key, state, node in table:
            gone = freed = False
            for _, _, s in sorted((e, n, s) for b, e, n, s in events if b == key):
                if s == "removed":
                    if gone or force or state == "terminated":
                        gone = True
                    else:
                        refused.add(key)
                else:
                    state, freed = s, freed or s == "terminated"
            if not gone:
                want[key] = (state, None if freed or state == "terminated" else node)
        new, no = chg.apply_states(conts, ev, force=force, partitions=9)
        assert {r.bmc_id: (r.state, r.node_id) for r in new.collect()} == want
        assert {r.bmc_id for r in no.collect()} == (set() if force else refused)
