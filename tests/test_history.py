"""The catalog as of a time, in batch and stream."""

import random

from pyspark.sql import functions as F

from bootlens.operators import history as hist
from bootlens.streaming import boot as st

NODES = "node_id long, epoch_ns long, seq long, ip4_addr_boot string, mac_addr_mgmt string"
CONTAINERS = "bmc_id string, epoch_ns long, state string, node_id long"
REQUESTS = "request_id long, epoch_ns long, remote_addr string, mac_addr string"


def test_intervals(spark):
    n = spark.createDataFrame([(1, 0, 1, "ip1", "m1"), (1, 50, 2, "ip9", "m1"), (1, 200, 3, None, None), (2, 0, 1, "ip2", None), (None, 5, 1, "x", "y")], NODES)
    c = spark.createDataFrame([("a", 10, "up", 1), ("a", 15, "running", None), ("a", 30, "terminated", None), ("b", 40, "terminated", 1), ("b", 45, "up", 1),
                               ("z", 60, "up", 1), ("q", 7, "up", None)], CONTAINERS)
    got = sorted(map(tuple, hist.catalog_history(n, c, partitions=3).collect()), key=str)
    assert got == sorted([
        (1, "ip1", "m1", None, 0, 10), (1, "ip1", "m1", "a", 10, 30), (1, "ip1", "m1", None, 30, 40), (1, "ip1", "m1", "b", 40, 50),
        (1, "ip9", "m1", "b", 50, 60), (1, "ip9", "m1", "z", 60, 200), (1, None, None, "z", 200, None), (2, "ip2", None, None, 0, None)], key=str)


def test_before_and_after_a_reallocation(spark):
    n = spark.createDataFrame([(1, 0, 1, "ip1", "m1"), (2, 0, 1, "ip2", "m2"), (1, 500, 2, None, None), (2, 500, 3, "ip1", "m2")], NODES)
    c = spark.createDataFrame([("a", 10, "up", 1), ("a", 100, "terminated", None), ("b", 120, "up", 1), ("c", 300, "up", 2)], CONTAINERS)
    r = spark.createDataFrame([(1, 9, "ip1", None), (2, 10, "ip1", "m2"), (3, 99, "nowhere", "m1"), (4, 100, "ip1", "m1"), (5, 130, "ip1", None), (6, 400, "ip1", "m2"),
                               (7, 600, "ip1", "m1"), (8, 600, None, "m2"), (9, 600, None, None), (10, None, "ip1", None)], REQUESTS)
    got = {x.request_id: (x.bmc_id, x.matched_by) for x in hist.identify_caller_at(r, hist.catalog_history(n, c), partitions=2).collect()}
    assert got == {1: (None, None), 2: ("a", "ip"), 3: ("a", "mac"), 4: (None, None), 5: ("b", "ip"), 6: ("b", "ip"), 7: ("c", "ip"), 8: ("c", "mac"),
                   9: (None, None), 10: (None, None)}


def test_hot_node_as_brute_force(spark):
    """One node holds most events and requests; every interval and answer as a plain search gives them."""
    rng = random.Random(3)
    terms, t = [], 0
    for k in range(300):
        t += rng.randint(1, 9)
        end = t + rng.randint(1, 12) if rng.random() < 0.9 else None
        terms.append((f"c{k}", 1 if k % 10 else 2, t, end))
    moves = [(1, 0, 1, "ip-a", "m1"), *((1, s, 2 + s, f"ip-{s % 7}", "m1") for s in range(100, 1200, 37)), (2, 0, 1, "ip-x", "m2")]
    events = [(b, s, "up", node) for b, node, s, _ in terms] + [(b, e, "terminated", None) for b, _, _, e in terms if e is not None]
    asked = [(q, rng.randint(0, 1600), rng.choice(["ip-a", "ip-1", "ip-3", "ip-x", "no"]), rng.choice([None, "m1", "m2"])) for q in range(600)]

    def holder(node, at):
        last = max(((s, b, e) for b, n, s, e in terms if n == node and s <= at), default=None)
        return last[1] if last and (last[2] is None or at < last[2]) else None

    def where(at, col, value):
        for node in (1, 2):
            now = max(((e, s, ip, mac) for n, e, s, ip, mac in moves if n == node and e <= at), default=None)
            if now and value is not None and now[col] == value:
                return holder(node, at)

    n, c, r = (spark.createDataFrame(x, s) for x, s in ((moves, NODES), (events, CONTAINERS), (asked, REQUESTS)))
    got = {x.request_id: (x.bmc_id, x.matched_by) for x in hist.identify_caller_at(r, hist.catalog_history(n, c, partitions=5), partitions=5).collect()}
    for q, at, ip, mac in asked:
        a, b = where(at, 2, ip), where(at, 3, mac)
        assert got[q] == ((a, "ip") if a else (b, "mac") if b else (None, None))


def test_stream_sees_a_growing_catalog(spark, tmp_dir):
    """A container made between two micro-batches is found, and a late request is answered as of its own time."""
    spark.createDataFrame([(1, 0, 1, "ip1", "m1")], NODES).write.parquet(f"{tmp_dir}/n")
    spark.createDataFrame([("a", 10, "up", 1)], CONTAINERS).write.parquet(f"{tmp_dir}/c")
    spark.createDataFrame([(1, 20, "ip1", None), (2, 5, "ip1", None)], REQUESTS).write.parquet(f"{tmp_dir}/r")
    source = spark.readStream.schema(REQUESTS).parquet(f"{tmp_dir}/r")

    def resolve(rows):
        return hist.identify_caller_at(rows, hist.catalog_history(spark.read.parquet(f"{tmp_dir}/n"), spark.read.parquet(f"{tmp_dir}/c")))

    st.run_with_catalog(source, resolve, f"{tmp_dir}/q")
    spark.createDataFrame([("a", 30, "terminated", None), ("b", 40, "up", 1)], CONTAINERS).write.mode("append").parquet(f"{tmp_dir}/c")
    spark.createDataFrame([(3, 50, "ip1", None), (4, 25, "ip1", None), (5, 35, "ip1", None)], REQUESTS).write.mode("append").parquet(f"{tmp_dir}/r")
    out = st.run_with_catalog(source, resolve, f"{tmp_dir}/q")
    assert {x.request_id: x.bmc_id for x in out.collect()} == {1: "a", 2: None, 3: "b", 4: "a", 5: None}
    assert out.select(F.countDistinct("batch")).first()[0] == 2
