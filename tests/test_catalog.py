"""Catalog operators on the hand-made fleet: NULL and ordering rules."""

import random

import pytest
from pyspark.sql import functions as F

from bootlens.operators import allocation, catalog as cat, quality as qa
from tests.fleet import fleet


@pytest.fixture(scope="module")
def f(spark):
    return fleet(spark)


def test_listing_concat_and_order(f):
    nodes, conts, k, i, r = f
    rows = cat.container_listing(conts, k, i, r, nodes, all=True).collect()
    assert [x.bmc_id for x in rows] == ["c1", "c2", "c3", "c4"]
    by = {x.bmc_id: x for x in rows}
    assert by["c1"].kernel_param == "quiet x=1"
    assert by["c2"].kernel_param is None            # container param NULL -> NULL, not concat_ws
    assert by["c4"].kernel_name is None and by["c4"].kernel_param is None   # orphan kernel
    active = [x.bmc_id for x in cat.container_listing(conts, k, i, r, nodes).collect()]
    assert active == ["c1", "c4"]
    assert [x.bmc_id for x in cat.container_ids(conts).collect()] == ["c1", "c4"]


def test_detail_inner_drops_terminated_and_orphans(f):
    nodes, conts, k, i, r = f
    d = cat.container_detail(conts.select("bmc_id"), conts, nodes, k, i, r)
    assert sorted(x.bmc_id for x in d.collect()) == ["c1", "c2"]
    assert "password_mgmt" not in d.columns


def test_free_vs_deletable(f):
    nodes, conts, *_ = f
    assert sorted(x.node_id for x in cat.free_nodes(nodes, conts).collect()) == [4, 5]
    assert cat.deletable_nodes(nodes, conts, null_aware=True).count() == 0   # c3 has NULL node
    assert cat.deletable_nodes(nodes, conts.where("bmc_id != 'c3'"), null_aware=True).count() == 2
    assert cat.deletable_nodes(nodes, conts, null_aware=False).count() == 2


def test_node_occupancy(f):
    nodes, conts, *_ = f
    occ = {x.ID: x for x in cat.node_occupancy(nodes, conts).collect()}
    assert occ[3].bmc_id == "c2" and occ[3].state == "terminated"
    assert occ[4].bmc_id is None


def test_match_rank_and_candidates(spark, f):
    nodes, conts, k, i, r = f
    req = spark.createDataFrame([("q1", "eq", 2), ("q2", "ge", 1), ("q2", "le", 1), ("q3", "any", None),
                                 ("q4", "lt", 1), ("q5", "le", 1), ("q6", "ge", 9)], "request_id string, rank_op string, rank_n int")
    got = {x.request_id: (x.n_nodes, x.node_id) for x in cat.match_rank(nodes, req).collect()}
    # node 5 has no rank: it fits ``any`` alone
    assert got == {"q1": (2, 3), "q2": (2, 1), "q3": (5, 1), "q4": (0, None), "q5": (2, 1), "q6": (0, None)}
    assert [x.request_id for x in cat.bad_rank_requests(req).collect()] == ["q4"]
    runs = spark.createDataFrame([("q1", "kA", "iA", "rA", "s-ramfs", "eq", 2), ("q5", "kA", "iA", "rA", "nfs", "ge", 0),
                                  ("q7", "kX", "iA", "rA", "nfs", "any", None)],
                                 "request_id string, kernel string, initrd string, image string, fstype string, "
                                 "rank_op string, rank_n int")
    cand = {x.request_id: (x.n_nodes, x.node_id) for x in cat.candidates(runs, k, i, r, nodes, conts).collect()}
    # node 3 is taken by c2, node 4 has no TPM -> q1 gets nothing; q5 may take node 4 (rank 2); q7 names no kernel
    assert cand == {"q1": (0, None), "q5": (1, 4)}


def test_match_rank_as_brute_force(spark):
    rng = random.Random(3)
    nodes = [(j, rng.choice([None, *range(-4, 40, 3)]), rng.random() < 0.4) for j in range(120)]
    reqs = [(q, op, rng.randint(-6, 42)) for q in range(80) for op in rng.choice([["eq"], ["le"], ["ge"], ["ge", "le"], ["any"], ["any", "le"]])]
    need = {q: rng.random() < 0.5 for q, *_ in reqs}
    n = spark.createDataFrame(nodes, "node_id long, node_rank int, have_tpm boolean")
    r = spark.createDataFrame([(q, op, None if op == "any" else v, need[q]) for q, op, v in reqs],
                              "request_id long, rank_op string, rank_n int, need boolean")
    got = {x.request_id: (x.n_nodes, x.node_id) for x in cat.match_rank(n, r, need_tpm="need", partitions=5).collect()}
    fits = {"eq": lambda a, v: a is not None and a == v, "le": lambda a, v: a is not None and a <= v,
            "ge": lambda a, v: a is not None and a >= v, "any": lambda a, v: True}
    for q in need:
        ok = [j for j, a, t in nodes if (t or not need[q]) and all(fits[op](a, v) for p, op, v in reqs if p == q)]
        assert got[q] == (len(ok), min(ok, default=None))


def test_allocate(spark, f):
    nodes, conts, *_ = f
    free = cat.free_nodes(nodes.withColumn("node_rank", F.lit(7)), conts.where("bmc_id = 'x'"))
    req = spark.createDataFrame([(f"r{j}", "eq", 7) for j in range(4)] + [("r9", "ge", 1), ("r8", "any", None), ("r7", "lt", 3), ("r6", "le", None)],
                                "request_id string, rank_op string, rank_n int")
    got = {x.request_id: (x.node_id, x.reason) for x in allocation.allocate(req, free).collect()}
    assert [got[f"r{j}"][0] for j in range(4)] == [1, 2, 3, 4] and got["r9"] == (5, None)
    assert got["r8"] == (None, "Node exhausted") and got["r7"] == got["r6"] == (None, "invalid rank expression")


FITS = {"eq": lambda a, v: a is not None and a == v, "le": lambda a, v: a is not None and a <= v,
        "ge": lambda a, v: a is not None and a >= v, "any": lambda a, v: True}


def _fits(asks, node, need=False):
    return all(FITS[op](node[1], v) for op, v in asks) and (node[2] or not need)


def _most(reqs, nodes):
    """Size of a greatest matching, by augmenting paths: ``reqs`` are lists of predicates."""
    holds = {}

    def place(q, seen):
        for x in nodes:
            if x[0] not in seen and _fits(reqs[q], x):
                seen.add(x[0])
                if x[0] not in holds or place(holds[x[0]], seen):
                    holds[x[0]] = q
                    return True
        return False

    return sum(place(q, set()) for q in range(len(reqs)))


def _one_by_one(reqs, nodes):
    """The policy of ``allocate``, one node after another: reqs {id: (predicates, need)}."""
    top = 1 << 40
    hi = lambda asks: min([v for op, v in asks if op in ("le", "eq")], default=top if {op for op, _ in asks} != {"any"} else top + 1)
    lo = lambda asks: max([v for op, v in asks if op in ("ge", "eq")], default=-top)
    got, used = {}, set()
    for need in (True, False):
        for x in sorted((x for x in nodes if x[0] not in used and (x[2] or not need)), key=lambda x: (x[1] is None, x[1] or 0, x[2], x[0])):
            wait = [(hi(asks), lo(asks), q) for q, (asks, n) in reqs.items() if n == need and q not in got and _fits(asks, x)]
            if wait:
                got[min(wait)[2]] = x[0]
                used.add(x[0])
    return got


def _ask(rng):
    op = rng.choice(["eq", "le", "ge", "any", "both", "both"])
    a, b = rng.randint(0, 9), rng.randint(0, 9)
    return [("ge", min(a, b)), ("le", max(a, b) if rng.random() < 0.9 else min(a, b) - 1)] if op == "both" else [(op, None if op == "any" else a)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_allocate_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    nodes = [(j, rng.choice([None, 1, 2, 3, 4, 5, 6, 8]), rng.random() < 0.4) for j in range(40)]
    reqs = {q: (_ask(rng), rng.random() < 0.4) for q in range(60)}
    n = spark.createDataFrame(nodes, "node_id long, node_rank int, have_tpm boolean")
    r = spark.createDataFrame([(q, op, v, need) for q, (asks, need) in reqs.items() for op, v in asks], "request_id long, rank_op string, rank_n int, need boolean")
    got = {x.request_id: x.node_id for x in allocation.allocate(r, n, need_tpm="need", partitions=3).collect()}
    want = _one_by_one(reqs, nodes)
    assert got == {q: want.get(q) for q in reqs}


def test_allocate_serves_as_many_as_any_matching(spark):
    """Many small cases side by side (ranks apart by 100 a case): the served are as many as a greatest matching."""
    rng = random.Random(7)
    nodes, reqs, most = [], {}, {}
    for case in range(60):
        own = [(case * 100 + j, case * 100 + rng.randint(0, 9), False) for j in range(rng.randint(1, 8))]
        asks = [[(op, None if v is None else case * 100 + v) for op, v in _ask(rng)] for _ in range(rng.randint(1, 9))]
        asks = [[*a, ("ge", case * 100), ("le", case * 100 + 99)] for a in asks]
        nodes += own
        reqs |= {case * 100 + k: a for k, a in enumerate(asks)}
        most[case] = _most(asks, own)
    n = spark.createDataFrame(nodes, "node_id long, node_rank int, have_tpm boolean")
    r = spark.createDataFrame([(q, op, v) for q, asks in reqs.items() for op, v in asks], "request_id long, rank_op string, rank_n int")
    got = {x.request_id: x.node_id for x in allocation.allocate(r, n).collect()}
    assert set(got) == set(reqs)
    by = {x[0]: x for x in nodes}
    held = [v for v in got.values() if v is not None]
    assert len(held) == len(set(held)) and all(_fits(reqs[q], by[v]) for q, v in got.items() if v is not None)
    served = {}
    for q, v in got.items():
        served[q // 100] = served.get(q // 100, 0) + (v is not None)
    assert served == most


def test_allocate_hot_class_and_rank(spark):
    """One pair of bounds and one rank hold most rows; numbering and stretches are cut into ranges."""
    n = spark.range(3000).select(F.col("id").alias("node_id"), F.when(F.col("id") % 3 > 0, 5).otherwise((F.col("id") % 50).cast("int")).alias("node_rank"))
    r = spark.range(4000).select(F.col("id").alias("request_id"), F.lit("ge").alias("rank_op"), F.lit(3).alias("rank_n")).unionByName(
        spark.range(4000).where("id % 4 > 0").select(F.col("id").alias("request_id"), F.lit("le").alias("rank_op"), F.lit(5).alias("rank_n")))
    got = allocation.allocate(r, n, partitions=7).collect()
    ranks = {x.node_id: x.node_rank for x in n.collect()}
    served = [x for x in got if x.node_id is not None]
    assert len(got) == 4000 and len({x.node_id for x in served}) == len(served)
    assert all(ranks[x.node_id] >= 3 and (x.request_id % 4 == 0 or ranks[x.node_id] <= 5) for x in served)
    inside, above = sum(3 <= v <= 5 for v in ranks.values()), sum(v > 5 for v in ranks.values())
    assert len(served) == min(3000, inside) + min(1000, above)


def test_gate_and_signatures(spark, f):
    _, _, k, i, r = f
    req = spark.createDataFrame([
        ("a", "kX", "iA", "rA", "nfs"), ("b", "kA", "iX", "rA", "nfs"), ("c", "kB", "iA", "rA", "s-ramfs"),
        ("d", "kC", "iA", "rA", "s-ramfs"), ("e", "kA", "iB", "rA", "s-ramfs"), ("f", "kA", "iA", "rZ", "s-ramfs"),
        ("g", "kB", "iB", "rB", "nfs")], "request_id string, kernel string, initrd string, image string, fstype string")
    got = {x.request_id: x.gate for x in cat.run_gate(req, k, i, r).collect()}
    assert got == {"a": "missing kernel", "b": "missing initrd", "c": "unsigned kernel", "d": "unsigned kernel",
                   "e": "unsigned initrd", "f": "needs pull", "g": "ok"}


def test_image_presence_and_union(spark, f):
    _, _, k, i, r = f
    images = cat.image_catalog(k, i, r.unionByName(r.limit(1)))
    names = spark.createDataFrame([("kA",), ("rA",), ("zz",)], "name string")
    got = {x.name: (x.found, x.broken) for x in cat.image_presence(names, images).collect()}
    assert got == {"kA": (True, False), "rA": (True, True), "zz": (False, False)}


def test_missing_files(spark, f):
    nodes, conts, k, i, r = f
    joined = cat.container_detail(conts.select("bmc_id"), conts, nodes, k, i, r)
    listing = spark.createDataFrame([("k/a",), ("i/a",), ("r/a",), ("k/c",)], "path string")
    got = sorted((x.bmc_id, x.what) for x in cat.missing_files(cat.required_files(joined), listing).collect())
    assert got == [("c1", "initrd-sig"), ("c1", "kernel-sig"), ("c1", "rootfs-etc"),
                   ("c2", "initrd-sig"), ("c2", "rootfs-etc")]


def test_counts_and_duplicates(spark, f):
    nodes, conts, *_ = f
    keys = spark.createDataFrame([(1,), (3,), (4,)], "node_id long")
    got = sorted((x.node_id, x.n) for x in cat.key_counts(keys, conts, "node_id").collect())
    assert got == [(1, 1), (3, 1), (4, 0)]
    # two NULL macs are not duplicates; the shared management address is
    assert cat.duplicates(nodes, "mac_addr_mgmt").count() == 0
    assert [x.ip4_addr_mgmt for x in cat.duplicates(nodes, "ip4_addr_mgmt").collect()] == ["10.0.1.3"]


def test_quality_report(f):
    nodes, conts, k, i, r = f
    rep = {(x.rule, x.table, x.key, x.detail) for x in qa.quality_report(nodes, conts, k, i, r).collect()}
    assert ("Q1 required", "Node", "5", "node_name missing") in rep
    assert ("Q1 required", "Node", "5", "node_rank missing") in rep
    assert ("Q2 domain", "Node", "4", "method_mgmt=bogus") in rep
    assert ("Q3 unique", "Node", "10.0.1.3", "ip4_addr_mgmt n=2") in rep
    assert ("Q4 reference", "Container", "c4", "kernel_id=99 not in Kernel") in rep
    assert not any(x[2] == "c3" for x in rep)   # NULL node reference passes


def test_admit_runs(spark, f):
    nodes, conts, k, i, r = f
    req = spark.createDataFrame([
        ("a", "kX", "iA", "rA", "nfs", "eq", 2),        # missing kernel: stops at the gate
        ("b", "kA", "iA", "rZ", "nfs", "eq", 2),        # needs pull: still allocated
        ("c", "kA", "iA", "rA", "nfs", "eq", 2),        # rank 2 has one free node left after b
        ("d", "kA", "iA", "rA", "nfs", "any", None)],
        "request_id string, kernel string, initrd string, image string, fstype string, rank_op string, rank_n int")
    got = {x.request_id: (x.gate, x.node_id, x.reason) for x in allocation.admit_runs(req, k, i, r, nodes, conts).collect()}
    assert got == {"a": ("missing kernel", None, "missing kernel"), "b": ("needs pull", 4, None),
                   "c": ("ok", None, "Node exhausted"), "d": ("ok", 5, None)}


def test_allocate_with_tpm(spark):
    free = spark.createDataFrame([(1, 7, True), (2, 7, False), (3, 7, True), (4, 8, False), (5, 9, True), (6, 9, False)],
                                 "node_id long, node_rank int, have_tpm boolean")
    req = spark.createDataFrame([("r1", "eq", 7, True), ("r2", "eq", 7, True), ("r3", "eq", 7, True),
                                 ("r4", "eq", 8, False), ("r5", "eq", 9, True), ("r6", "eq", 9, False), ("r7", "any", None, False)],
                                "request_id string, rank_op string, rank_n int, need boolean")
    got = {x.request_id: (x.node_id, x.reason) for x in allocation.allocate(req, free, need_tpm="need").collect()}
    assert got == {"r1": (1, None), "r2": (3, None), "r3": (None, "Node exhausted"), "r4": (4, None),
                   "r5": (5, None), "r6": (6, None), "r7": (2, None)}


def test_rank_ok_predicate(spark):
    from bootlens.operators.catalog import rank_ok

    df = spark.createDataFrame([("any", None, 3), ("eq", 3, 3), ("eq", 2, 3), ("le", 3, 3), ("ge", 4, 3), ("lt", 9, 3),
                                ("eq", None, 3)], "op string, n int, r int")
    got = [x.ok for x in df.select(rank_ok(F.col("op"), F.col("n"), F.col("r")).alias("ok")).collect()]
    assert got == [True, True, False, True, False, False, None]


def test_image_views(f):
    _, _, k, i, r = f
    assert cat.image_view(k, "kernel").columns == ["ID", "name", "file", "sig", "param"]
    assert cat.image_view(i, "initrd").columns == cat.image_view(r, "rootfs").columns == ["ID", "name", "file", "sig"]
    assert cat.image_view(k, "kernel").where("ID = 10").first().param == "quiet"


def _images(spark):
    k = spark.createDataFrame([(i, "same") for i in range(40)] + [(40, "one"), (40, "one"), (41, None), (None, "one")], "kernel_id long, kernel_name string")
    i = spark.createDataFrame([(i, "boot") for i in range(12)] + [(12, "other"), (13, None)], "initrd_id long, initrd_name string")
    r = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "rootfs_id long, rootfs_name string")
    asked = spark.createDataFrame([(n, "same", "boot", "a") for n in range(25)] + [(30, "one", "other", "b"), (31, "one", "boot", "b"), (31, "one", "boot", "b"), (32, None, "boot", "a"), (33, "gone", "boot", "a"),
                                                                                 (34, "one", None, "a")], "request_id long, kernel string, initrd string, image string")
    return asked, k, i, r


def test_every_combination_of_images_of_a_name(spark, monkeypatch):
    """Names shared by requests and images, repeated rows and NULLs: as the plain joins give, whatever the length of the arrays."""
    import collections

    asked, k, i, r = _images(spark)
    plain = (asked.join(k.withColumnRenamed("kernel_name", "kernel"), "kernel").join(i.withColumnRenamed("initrd_name", "initrd"), "initrd")
             .join(r.withColumnRenamed("rootfs_name", "image"), "image"))
    cols = ["request_id", "kernel_id", "initrd_id", "rootfs_id"]
    exp = collections.Counter(map(tuple, plain.select(cols).collect()))
    for block in (4096, 5):
        monkeypatch.setattr(cat, "BLOCK", block)
        assert collections.Counter(map(tuple, cat.with_image_ids(asked, k, i, r, 3).select(cols).collect())) == exp


def test_combinations_of_images_are_not_shuffled(spark, f):
    """Behind the step that makes the combinations of images there is no exchange any more."""
    nodes, conts, _, _, _ = f
    asked, k, i, r = _images(spark)
    asked = asked.withColumns({"fstype": F.lit("nfs"), "rank_op": F.lit("any"), "rank_n": F.lit(None).cast("long")})
    plan = cat.candidates(asked, k, i, r, nodes, conts)._jdf.queryExecution().sparkPlan().toString().split("\n")
    explodes = [n for n, line in enumerate(plan) if "Generate explode(_k" in line]
    assert explodes and not any("Exchange" in line or "Join" in line for line in plan[:explodes[0]])


def test_one_array_is_exploded_behind_the_join(spark):
    """A task holds what one row becomes in explodes that follow each other: behind the join that is one array of
    kernels, and the other two arrays are exploded below it and short."""
    asked, k, i, r = _images(spark)
    plan = cat.with_image_ids(asked, k, i, r, 3)._jdf.queryExecution().sparkPlan().toString().split("\n")
    join = next(n for n, line in enumerate(plan) if "SortMergeJoin" in line and "_chunk" in line)
    assert ["explode(_k" in line for line in plan[:join] if "Generate" in line] == [True]
    assert cat.FEW ** 2 <= cat.BLOCK

def test_rows_without_a_reference_are_not_joined(f):
    """Most containers hold no node: their rows must not meet in one task of an outer join."""
    nodes, conts, k, i, r = f
    plan = qa.quality_report(nodes, conts, k, i, r)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and plan.count("Join LeftAnti") == 1
