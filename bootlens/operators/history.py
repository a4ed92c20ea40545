"""The catalog as of a time: who held which node under which address, and when.

The tables of the catalog only know the present.  Their events (a node
registered, readdressed or deleted; a container given a node, terminated,
removed) tell the past: ``catalog_history`` turns them into intervals, and
``identify_caller_at`` answers a boot request (J13) as of the request's own time,
so a request that arrives late still finds the container of its moment.

A node's events stand in one order, and what holds at each is filled forward
(``ordered_scan``), so no event meets all others of a busy node; requests find
the interval of their address in the same way.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from bootlens.operators.sequence import Fill, Lag, ordered_scan

#: The states in which a container has given its node back.
GONE_STATES = ("terminated", "removed")


def container_terms(events: DataFrame, key: str = "bmc_id", node_id: str = "node_id", epoch: str = "epoch_ns", state: str = "state") -> DataFrame:
    """Per container the time it held its node: key, node_id, held_from, held_to (NULL: still does).

    It holds the node that the first event with a ``node_id`` names, whatever the state says, until it is
    terminated or removed (events without a node).  A container gets one node in its life."""
    e, gone = F.col(epoch), F.col(state).isin(*GONE_STATES) & F.col(node_id).isNull()
    has = F.col(node_id).isNotNull() & e.isNotNull()
    return (events.groupBy(key).agg(F.min_by(node_id, F.when(has, F.struct(e, node_id))).alias("node_id"), F.min(F.when(has, e)).alias("held_from"),
                                    F.min(F.when(gone, e)).alias("held_to")).where("node_id IS NOT NULL"))


def catalog_history(node_events: DataFrame, container_events: DataFrame, key: str = "bmc_id", node_id: str = "node_id", ip: str = "ip4_addr_boot",
                    mac: str = "mac_addr_mgmt", epoch: str = "epoch_ns", seq: str = "seq", partitions: int | None = None) -> DataFrame:
    """node_id, ip, mac, key, valid_from, valid_to (nanoseconds; NULL: to this day): the intervals in which
    a node had these addresses and held this container (NULL: none).

    ``node_events``: node_id, epoch, seq and the addresses from then on (both NULL once it is deleted).
    ``container_events``: key, epoch, state, node_id, as ``container_terms`` reads them.  A node holds one
    container at a time; should a new one come before the old one has ended, the new one has it."""
    addr = node_events.select(F.col(node_id).alias("node_id"), F.col(epoch).cast("long").alias("_e"), F.lit(0).alias("_kind"), F.col(seq).cast("string").alias("_s"),
                              F.col(ip).alias(ip), F.col(mac).alias(mac))
    terms = container_terms(container_events, key, node_id, epoch)
    held = terms.select("node_id", F.col("held_from").cast("long").alias("_e"), F.lit(1).alias("_kind"), F.col(key).cast("string").alias("_s"), F.col(key).alias("_key"),
                        F.col("held_to").cast("long").alias("_to"))
    rows = addr.unionByName(held, allowMissingColumns=True).where("node_id IS NOT NULL AND _e IS NOT NULL")
    now = ordered_scan(rows, ["node_id"], ["_e", "_kind", "_s"], [Fill([ip, mac], "_kind = 0", "at_"), Fill(["_key", "_to"], "_kind = 1", "by")], partitions=partitions)
    # the next change of the same node ends an interval; rows of one time leave empty ones but for the last
    last = (now.groupBy("node_id", "_e").agg(F.max_by(F.struct(f"at_{ip}", f"at_{mac}", "by_key", "by_to"), F.struct("_kind", "_s")).alias("_v")).select("node_id", "_e", "_v.*"))
    until = ordered_scan(last, ["node_id"], ["_e"], [Lag(["_e"], "next")], descending=True, partitions=partitions)
    ended = F.coalesce(F.col("by_to") <= F.col("_e"), F.lit(False))
    live = until.select("node_id", F.col(f"at_{ip}").alias(ip), F.col(f"at_{mac}").alias(mac), F.when(~ended, F.col("by_key")).alias(key),
                        F.when(~ended, F.col("by_to")).alias("_to"), F.col("_e").alias("valid_from"), F.col("next_e").alias("valid_to"))
    # a container that ends inside an interval cuts it in two
    cut = F.col("_to").isNotNull() & (F.col("valid_to").isNull() | (F.col("_to") < F.col("valid_to")))
    first = F.struct(F.col(key).alias("k"), F.col("valid_from").alias("f"), F.when(cut, F.col("_to")).otherwise(F.col("valid_to")).alias("t"))
    rest = F.struct(F.lit(None).cast(live.schema[key].dataType).alias("k"), F.col("_to").alias("f"), F.col("valid_to").alias("t"))
    pieces = live.withColumn("_p", F.explode(F.when(cut, F.array(first, rest)).otherwise(F.array(first))))
    return pieces.select("node_id", ip, mac, F.col("_p.k").alias(key), F.col("_p.f").alias("valid_from"), F.col("_p.t").alias("valid_to"))


def as_of(requests: DataFrame, history: DataFrame, key: str, value: str, epoch: str = "epoch_ns", request_id: str = "request_id",
          partitions: int | None = None) -> DataFrame:
    """(request_id, ``value``): what ``history`` (key, value, valid_from, valid_to) says of each request's ``key`` at its time.

    Intervals of a key do not overlap; where they do, the one that began last answers, if it still holds.
    Requests whose key has no interval then, or is NULL, give no row; ``request_id`` is unique."""
    h = history.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col("valid_from").alias("_e"), F.lit(0).alias("_prio"), F.lit(None).cast(requests.schema[request_id].dataType).alias("_id"),
                                                     F.col(value).alias("_v"), F.col("valid_to").alias("_to"))
    r = requests.where(F.col(key).isNotNull() & F.col(epoch).isNotNull()).select(F.col(key).alias("_k"), F.col(epoch).cast("long").alias("_e"), F.lit(1).alias("_prio"), F.col(request_id).alias("_id"))
    both = h.unionByName(r, allowMissingColumns=True)
    told = ordered_scan(both, ["_k"], ["_e", "_prio", "_id"], [Fill(["_v", "_to"], "_prio = 0", "at")], partitions=partitions)
    return (told.where("_prio = 1 AND at_v IS NOT NULL AND (at_to IS NULL OR _e < at_to)")
            .select(F.col("_id").alias(request_id), F.col("at_v").alias(value)))


def identify_caller_at(requests: DataFrame, history: DataFrame, request_id: str = "request_id", epoch: str = "epoch_ns", req_ip: str = "remote_addr",
                       req_mac: str = "mac_addr", ip: str = "ip4_addr_boot", mac: str = "mac_addr_mgmt", key: str = "bmc_id",
                       partitions: int | None = None) -> DataFrame:
    """J13 as of each request's time: the container whose node had the request's boot address then, else the one whose
    node had its MAC; ``matched_by`` is 'ip', 'mac' or NULL (reject).  ``history`` as ``catalog_history`` gives it."""
    kinds = (("ip", req_ip, ip), ("mac", req_mac, mac))
    addr = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{kind} "), F.col(c)))
    union = functools.partial(functools.reduce, DataFrame.unionByName)
    asked = union([requests.select(F.struct(request_id, F.lit(kind).alias("kind")).alias("_ask"), epoch, addr(kind, c).alias("_addr")) for kind, c, _ in kinds])
    known = union([history.where(F.col(key).isNotNull()).select(addr(kind, c).alias("_addr"), key, "valid_from", "valid_to") for kind, _, c in kinds])
    found = as_of(asked, known, "_addr", key, epoch, "_ask", partitions)
    by = found.groupBy(F.col(f"_ask.{request_id}").alias("_rid")).agg(*[F.max(F.when(F.col("_ask.kind") == kind, F.col(key))).alias(f"_by_{kind}") for kind, *_ in kinds])
    j = requests.join(by, F.col(request_id) == F.col("_rid"), "left")
    matched = F.when(F.col("_by_ip").isNotNull(), F.lit("ip")).when(F.col("_by_mac").isNotNull(), F.lit("mac"))
    return j.select(*requests.columns, F.coalesce("_by_ip", "_by_mac").alias(key), matched.alias("matched_by"))
