"""Request checks: who is calling (J13), may this sender notify (J14),
one-time sessions (J15, W7) and boot outcome against a deadline (J18)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bootlens.operators.sequence import Fill, ordered_scan
from bootlens.schemas import ns_lit, span_seconds
from bootlens.operators.windows import first_use


def identify_caller(requests: DataFrame, nodes: DataFrame, containers: DataFrame, req_ip: str = "remote_addr",
                    req_mac: str = "mac_addr", node_ip: str = "ip4_addr_boot", node_mac: str = "mac_addr_mgmt",
                    key: str = "bmc_id", node_id: str = "node_id") -> DataFrame:
    """The container a boot request comes from, by the boot address and
    by the MAC of its node; the address match wins.  ``matched_by`` is 'ip',
    'mac' or NULL (reject).

    Only nodes that hold a container can match: an idle node with the boot
    address does not hide a container found by MAC.  Should a node hold
    several containers, or nodes share an address, the smallest key answers,
    so a request gets one row (NULL addresses never match)."""
    held = (containers.where(F.col(node_id).isNotNull()).select(key, node_id)
            .join(nodes.select(node_id, node_ip, node_mac), node_id))

    def lookup(addr: str, as_addr: str, as_key: str) -> DataFrame:
        return (held.where(F.col(addr).isNotNull()).groupBy(F.col(addr).alias(as_addr))
                .agg(F.min(key).alias(as_key)))

    j = (requests.join(lookup(node_ip, "_ip", "_by_ip"), F.col(req_ip) == F.col("_ip"), "left")
         .join(lookup(node_mac, "_mac", "_by_mac"), F.col(req_mac) == F.col("_mac"), "left"))
    matched = F.when(F.col("_by_ip").isNotNull(), F.lit("ip")).when(F.col("_by_mac").isNotNull(), F.lit("mac"))
    return j.select(*requests.columns, F.coalesce("_by_ip", "_by_mac").alias(key), matched.alias("matched_by"))


def container_addresses(detail: DataFrame, key: str = "bmc_id",
                        addrs: Sequence[str] = ("ip4_addr_os", "ip4_addr_mgmt", "ip4_addr_boot")) -> DataFrame:
    """The (bmc_id, addr) pairs a container may notify from: its node's os,
    management and boot addresses (NULLs dropped)."""
    pairs = F.explode(F.array(*[F.col(a) for a in addrs])).alias("addr")
    return detail.select(key, pairs).where(F.col("addr").isNotNull()).distinct()


def authorise_sender(notices: DataFrame, detail: DataFrame, key: str = "bmc_id", sender: str = "remote_addr",
                     addrs: Sequence[str] = ("ip4_addr_os", "ip4_addr_mgmt", "ip4_addr_boot")) -> DataFrame:
    """Notices whose sender is one of the container's addresses.

    ``detail`` is the container detail (J4: inner joins, so a terminated
    container, with no node, gives no pairs and all its notices are
    refused).  A left semi join keeps each notice at most once."""
    ok = container_addresses(detail, key, addrs).withColumnRenamed("addr", "_addr")
    cond = (notices[key] == ok[key]) & (notices[sender] == ok["_addr"])
    return notices.join(ok, cond, "left_semi")


def check_session(requests: DataFrame, hashes: DataFrame, now: Column, session: str = "session_id",
                  nonce: str = "nonce", order: Sequence[str] = ("ts",)) -> DataFrame:
    """J15 + W7: one-time sessions.

    A request is refused when its session is unknown, expired
    (``session_good_for < now``, strictly: expiring exactly now is valid; a
    session without an expiry counts as expired),
    or its nonce differs from ``nonce2``.  A NULL or empty nonce never
    matches (also after use, where the reference's empty value would compare
    equal).
    Among valid requests of one session only the first (in ``order``) is
    accepted; the later ones are 'reused'.  ``order`` must not tie within a
    session (end it with a request id).  Output: the requests with
    ``verdict``."""
    h = hashes.select(F.col("session_id").alias("_sid"), "session_good_for", "nonce2")
    j = requests.join(h, requests[session] == F.col("_sid"), "left")
    base = (F.when(F.col("_sid").isNull(), F.lit("unknown session"))
            .when(F.col("session_good_for").isNull() | (F.col("session_good_for") < now), F.lit("expired"))
            .when(~F.coalesce(F.nullif(F.col(nonce), F.lit("")) == F.nullif(F.col("nonce2"), F.lit("")), F.lit(False)),
                  F.lit("bad nonce")))
    j = j.withColumn("_base", base).drop("_sid", "session_good_for", "nonce2")
    valid = j.where(F.col("_base").isNull())
    firsts = (first_use(valid, [session], list(order), list(order), count_as=None)
              .select(F.col(session).alias("_fs"), F.struct(*[F.col(o) for o in order]).alias("_first")))
    out = j.join(firsts, j[session].eqNullSafe(F.col("_fs")), "left")
    verdict = (F.when(F.col("_base").isNotNull(), F.col("_base"))
               .when(F.struct(*[F.col(o) for o in order]) == F.col("_first"), F.lit("ok"))
               .otherwise(F.lit("reused")))
    return out.select(*requests.columns, verdict.alias("verdict"))


def boot_outcome(runs: DataFrame, notices: DataFrame, keys: Sequence[str] = ("bmc_id",),
                 epoch: str = "epoch_ns", seq: str = "seq", status: str = "status",
                 timeout: float = 180.0, partitions: int | None = None) -> DataFrame:
    """Did the booted system notify before the deadline?

    For each run start, the first notice of the same key at or after it
    (an as-of join run forward in time, by ``ordered_scan``, so no
    run x notice pairs are formed and a hot key is split over tasks) is the
    answer; later notices are ignored.  ``outcome`` is 'ok' (status ok),
    'boot failure: STATUS', or 'timed out' when no notice came before
    start + ``timeout`` seconds."""
    keys = list(keys)
    r = runs.select(*keys, F.col(epoch).alias("_e"), F.lit(0).alias("_prio"), F.col(seq).alias("_s"),
                    F.lit(None).cast("string").alias("_status"), F.lit(False).alias("_is_notice"))
    n = notices.select(*keys, F.col(epoch).alias("_e"), F.lit(1).alias("_prio"), F.col(seq).alias("_s"),
                       F.col(status).cast("string").alias("_status"), F.lit(True).alias("_is_notice"))
    both = r.unionByName(n)
    scanned = ordered_scan(both, keys, ["_e", "_prio", "_s"],
                           [Fill(["_e", "_s", "_status"], F.col("_is_notice"), prefix="n")],
                           descending=True, partitions=partitions)
    in_time = F.coalesce(F.col("n_e") < F.col("_e") + ns_lit(timeout), F.lit(False))   # no time: not in time
    outcome = (F.when(~in_time, F.lit("timed out"))
               .when(F.col("n_status") == F.lit("ok"), F.lit("ok"))
               .otherwise(F.concat(F.lit("boot failure: "), F.col("n_status"))))
    return (scanned.where(~F.col("_is_notice"))
            .select(*keys, F.col("_s").alias("run_seq"), outcome.alias("outcome"),
                    F.when(in_time, F.col("n_s")).alias("notice_seq"),
                    F.when(in_time, span_seconds(F.col("n_e") - F.col("_e"))).alias("wait_sec")))


def checked_boot_outcome(runs: DataFrame, notices: DataFrame, detail: DataFrame, keys: Sequence[str] = ("bmc_id",),
                         sender: str = "remote_addr", timeout: float = 180.0,
                         partitions: int | None = None) -> DataFrame:
    """The notice path: a notice counts only when its sender is one of the
    container's addresses (J14); the first counted notice before the
    deadline decides the boot (J18)."""
    ok = authorise_sender(notices, detail, key=keys[0], sender=sender)
    return boot_outcome(runs, ok, keys, timeout=timeout, partitions=partitions)
