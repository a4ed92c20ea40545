"""Batch allocation, one node per request and one request per node.

The reference allocates one request at a time and takes any fitting free node
(INSERT ... SELECT ... LIMIT 1).  Its rank predicates are ANDed, so a request
asks for an interval of ranks: ``eq`` is [n, n], ``ge`` and ``le`` one bound
each, ``any`` everything.  A batch needs a policy; this one is:

1. requests that need a TPM first, on TPM nodes; then the others on all nodes
   that are left, at each rank on nodes without a TPM first;
2. in both as many requests as possible are served;
3. going up the ranks, the nodes of a rank serve those waiting requests whose
   upper bound is smallest (then by lower bound, then in request order), nodes
   by node_id.

Matching intervals to points by the smallest upper end serves as many as any
matching can.  No request is looked at one by one: requests of equal bounds are
one class, nodes of equal rank one row, and the sweep up the ranks works on
their counts (one row per distinct rank and per distinct pair of bounds, sorted
and streamed through; what waits is a heap of classes).  It tells from which
number on how many requests of a class meet which node numbers of a rank.
Requests are numbered in their class, nodes in their rank, both by
``ordered_scan``, so a class or a rank that holds a third of all rows is split
over many tasks; a third scan brings each request the stretch it falls in, and
requests and nodes meet on (rank, number).
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from typing import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bootlens.operators.sequence import Count, Fill, ordered_scan
from bootlens.session import scratch_dir

#: Bounds that are not asked for.  ``any`` reaches one further up than ``ge``: to the nodes without a rank.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 2
UNRANKED = HIGHEST + 1
_STRETCH = pa.schema([(c, pa.int64()) for c in ("lo", "hi", "first", "n", "rank", "rank_first")])


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rank_intervals(requests: DataFrame, request_id: str = "request_id", op: str = "rank_op", n: str = "rank_n",
                   keep: Sequence[Column] = ()) -> DataFrame:
    """One row per request, its ANDed predicates as an interval: request_id, lo, hi (NULL: not asked), ranked (a
    node without a rank does not fit), void (an unknown operator or a missing number), and the aggregates ``keep``."""
    o, v = F.col(op), F.col(n)
    bounded = F.coalesce(o.isin("eq", "le", "ge"), F.lit(False))
    known = F.coalesce((o == "any") | (bounded & v.isNotNull()), F.lit(False))
    return requests.groupBy(request_id).agg(
        F.max(F.when(o.isin("ge", "eq"), v)).cast("long").alias("lo"), F.min(F.when(o.isin("le", "eq"), v)).cast("long").alias("hi"),
        F.max(bounded).alias("ranked"), F.max(~known).alias("void"), *keep)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes and ranks in order of (at, kind) -> stretches: from number ``first`` on, ``n`` requests of the class
    (lo, hi) take the nodes of ``rank`` from number ``rank_first`` on (numbers from 1)."""
    waiting: list[list[int]] = []   # [hi, lo, next number, how many]
    for batch in batches:
        out = []
        for at, kind, lo, hi, n in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                heapq.heappush(waiting, [hi, lo, 1, n])
                continue
            used = 0
            while waiting and used < n:
                top = waiting[0]
                if top[0] < at:
                    heapq.heappop(waiting)
                    continue
                some = min(n - used, top[3])
                out.append((top[1], top[0], top[2], some, at, used + 1))
                used += some
                top[2] += some
                top[3] -= some
                if not top[3]:
                    heapq.heappop(waiting)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_STRETCH)


def _match(requests: DataFrame, nodes: DataFrame, partitions: int | None) -> DataFrame:
    """(_rid, node_id): numbered requests (_rid, lo, hi, _k) served from nodes (node_id, rank, _tpm)."""
    none = F.lit(None).cast("long")
    events = (requests.groupBy("lo", "hi").agg(F.count("*").alias("n")).select(F.col("lo").alias("at"), F.lit(0).alias("kind"), "lo", "hi", "n")
              .unionByName(nodes.groupBy("rank").agg(F.count("*").alias("n")).select(F.col("rank").alias("at"), F.lit(1).alias("kind"), none.alias("lo"), none.alias("hi"), "n")))
    stretches = _staged(events.repartition(1).sortWithinPartitions("at", "kind", "hi").mapInArrow(_sweep, ", ".join(f"{c} long" for c in _STRETCH.names)), "alloc-stretches")
    rows = (requests.select("lo", "hi", F.col("_k").alias("at"), F.lit(1).alias("kind"), "_rid", *[none.alias(c) for c in _STRETCH.names[2:]])
            .unionByName(stretches.select("lo", "hi", F.col("first").alias("at"), F.lit(0).alias("kind"), *_STRETCH.names[2:]), allowMissingColumns=True))
    placed = ordered_scan(rows, ["lo", "hi"], ["at", "kind"], [Fill(_STRETCH.names[2:], "kind = 0")], partitions=partitions)
    asked = (placed.where("kind = 1 AND at < fill_first + fill_n")
             .select("_rid", F.col("fill_rank").alias("rank"), (F.col("fill_rank_first") + F.col("at") - F.col("fill_first")).alias("_j")))
    offered = ordered_scan(nodes, ["rank"], ["_tpm", "node_id"], [Count("_j")], partitions=partitions)
    return asked.join(offered.select("rank", "_j", "node_id"), ["rank", "_j"]).select("_rid", "node_id")


def allocate(requests: DataFrame, free: DataFrame, request_id: str = "request_id",
             request_order: Sequence[str] = ("request_id",), op: str = "rank_op", n: str = "rank_n",
             node_id: str = "node_id", rank: str = "node_rank", need_tpm: str | None = None,
             tpm: str = "have_tpm", partitions: int | None = None) -> DataFrame:
    """Allocate free nodes to requests by the policy of the module text.

    Rows that repeat a request's id add rank predicates (ANDed); they should
    agree in all else, and the smallest order and any need for a TPM count.
    ``request_order`` must be unique (end it with the request id).  With
    ``need_tpm`` (a boolean request column, true for ``s-ramfs``) the TPM rule
    (P5) applies; without it all nodes are alike.  A node without a rank fits ``any`` only.  Output: one row per
    request: its id, ``node_id`` (NULL when none) and ``reason`` (NULL when
    allocated): "Node exhausted", or "invalid rank expression" for an unknown
    operator or a missing number."""
    need = F.coalesce(F.col(need_tpm), F.lit(False)) if need_tpm else F.lit(False)
    order = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(request_order)])).alias("_order")
    wanted = _staged(rank_intervals(requests, request_id, op, n, keep=[F.max(need).alias("_need"), order])
                     .select(F.col(request_id).alias("_rid"), F.coalesce("lo", F.lit(LOWEST)).alias("lo"),
                             F.coalesce("hi", F.when(F.col("ranked"), HIGHEST).otherwise(UNRANKED)).alias("hi"), "void", "_need", "_order.*"), "alloc-requests")
    has_tpm = F.coalesce(F.col(tpm), F.lit(False)) if need_tpm and tpm in free.columns else F.lit(False)
    pool = _staged(free.select(F.col(node_id).alias("node_id"), F.coalesce(F.col(rank).cast("long"), F.lit(UNRANKED)).alias("rank"), has_tpm.alias("_tpm")),
                   "alloc-nodes")
    numbered = ordered_scan(wanted.where("NOT void AND lo <= hi"), ["_need", "lo", "hi"], [f"_o{i}" for i in range(len(request_order))], [Count("_k")], partitions=partitions)
    got: list[DataFrame] = []
    for needs in (True, False):
        own = wanted.where((F.col("_need") == needs) & ~F.col("void"))
        if own.isEmpty():
            continue
        left = pool.where("_tpm") if needs else pool
        if got:
            left = left.join(got[0].select("node_id"), "node_id", "left_anti")
        got.append(_staged(_match(numbered.where(F.col("_need") == needs).select("_rid", "lo", "hi", "_k"), left, partitions), "alloc-pairs"))
    out = wanted.select(F.col("_rid").alias(request_id), "void")
    if got:
        pairs = functools.reduce(DataFrame.unionByName, got).select("_rid", F.col("node_id").alias(node_id))
        out = out.join(pairs, F.col(request_id) == F.col("_rid"), "left")
    else:
        out = out.withColumn(node_id, F.lit(None).cast(free.schema[node_id].dataType))
    reason = F.when(F.col("void"), F.lit("invalid rank expression")).when(F.col(node_id).isNull(), F.lit("Node exhausted"))
    return out.select(request_id, node_id, reason.alias("reason"))


def admit_runs(requests: DataFrame, kernels: DataFrame, initrds: DataFrame, rootfs: DataFrame, nodes: DataFrame,
               containers: DataFrame, request_id: str = "request_id",
               request_order: Sequence[str] = ("request_id",), partitions: int | None = None) -> DataFrame:
    """The run path: gate (J10/J11), then allocation (J7) of the requests
    that pass.  A request whose image is missing ('needs pull') is pulled
    first in the reference and then allocated, so it goes on too.  Rows that
    repeat a request's id add rank predicates and agree in all else.

    Output, one row per request: request_id, gate, node_id, reason (the gate's
    verdict when the request stops there, else the allocation's)."""
    from bootlens.operators.catalog import free_nodes, run_gate

    extra = [c for c in request_order if c not in (request_id, "rank_op", "rank_n", "fstype")]
    gated = _staged(run_gate(requests, kernels, initrds, rootfs).select(request_id, "gate", "rank_op", "rank_n", "fstype", *extra), "gated")
    go = F.col("gate").isin("ok", "needs pull")
    asked = gated.where(go).withColumn("_need_tpm", F.coalesce(F.col("fstype") == F.lit("s-ramfs"), F.lit(False)))
    alloc = allocate(asked, free_nodes(nodes, containers), request_id=request_id, request_order=request_order,
                     need_tpm="_need_tpm", partitions=partitions)
    out = gated.groupBy(request_id).agg(F.min("gate").alias("gate")).join(alloc, request_id, "left")
    return out.select(request_id, "gate", "node_id", F.when(~go, F.col("gate")).otherwise(F.col("reason")).alias("reason"))


def allocated_containers(admitted: DataFrame, requests: DataFrame, kernels: DataFrame, initrds: DataFrame,
                         rootfs: DataFrame, created: Column, request_id: str = "request_id") -> DataFrame:
    """Container rows of the admitted requests that got a node, as the
    allocation inserts them: ids of the named images, the request's id as
    bmc_id, and the default state ``terminated`` (power-on comes later).  A
    request whose image is still to be pulled has no rootfs row and gets no
    container yet."""
    from bootlens.operators.catalog import with_image_ids

    got = admitted.where(F.col("node_id").isNotNull()).select(request_id, "node_id")
    wanted = requests.dropDuplicates([request_id]).drop(*(c for c in requests.columns if c not in (request_id, "kernel", "initrd", "image", "fstype", "base_name", "client_addr", "kernel_param", "command")))
    j = with_image_ids(wanted.join(got, request_id), kernels, initrds, rootfs)
    text = lambda c: F.col(c) if c in requests.columns else F.lit(None).cast("string")
    return j.select(F.col(request_id).cast("string").alias("bmc_id"), text("base_name").alias("base_name"),
                    text("client_addr").alias("client_addr"), "kernel_id", text("kernel_param").alias("kernel_param"),
                    "initrd_id", "rootfs_id", "fstype", "node_id", text("command").alias("command"),
                    created.alias("created"), F.lit("terminated").alias("state"))
