"""Fleet catalog operators: listings, lookups, joins and audits.

U1, P1-P5, J1-J6, J8-J12, A1, A2, O1, O3.

Catalog sides (images, nodes) are small next to containers and events in
practice, but nothing here assumes it: joins are plain equi-joins, so AQE
picks broadcast when the measured size allows and splits skewed partitions
otherwise; none carries a broadcast hint.  J8's NULL rule is an EXISTS
subquery, not a join.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bootlens.session import scratch_dir
from bootlens.operators.sequence import Count, ordered_scan
from bootlens.schemas import IMAGE_KINDS

# --------------------------------------------------------------------------
# U1, P1, P2, P3


def image_catalog(kernels: DataFrame, initrds: DataFrame, rootfs: DataFrame) -> DataFrame:
    """The three image tables as one, with ``kind``.

    Columns: kind, image_id, name, file, sig_file, kernel_param (NULL for
    initrd and rootfs)."""
    def one(df, kind):
        cols = [F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("image_id"),
                F.col(f"{kind}_name").alias("name"), F.col(f"{kind}_file").alias("file"),
                F.col(f"{kind}_sig_file").alias("sig_file")]
        if "kernel_param" in df.columns:
            cols.append(F.col("kernel_param"))
        return df.select(*cols)

    return (one(kernels, "kernel")
            .unionByName(one(initrds, "initrd"), allowMissingColumns=True)
            .unionByName(one(rootfs, "rootfs"), allowMissingColumns=True))


# Fixed column titles of the node listing.
NODE_TITLES = (("node_id", "ID"), ("node_name", "name"), ("node_descr", "descr"), ("node_rank", "rank"),
               ("have_tpm", "tpm"), ("method_mgmt", "method"), ("ip4_addr_mgmt", "addr_mgmt"),
               ("ip4_addr_boot", "addr_boot"), ("interface_os", "iface_os"), ("ip4_addr_os", "addr_os"),
               ("netmask_os", "netmask_os"), ("gateway_os", "gateway_os"), ("dns_os", "dns_os"))


# Fixed column titles of the image listings.
_IMAGE_TITLES = (("id", "ID"), ("name", "name"), ("file", "file"), ("sig_file", "sig"))


def image_view(images: DataFrame, kind: str) -> DataFrame:
    """One image table (kernel, initrd or rootfs) under its listing
    titles; kernels also show their parameter."""
    titles = [(f"{kind}_{c}", t) for c, t in _IMAGE_TITLES]
    return images.select(*[F.col(c).alias(t) for c, t in (titles + [("kernel_param", "param")] if kind == "kernel" else titles)])


def node_view(nodes: DataFrame) -> DataFrame:
    """Nodes under their listing titles; the management password is
    never part of any output."""
    return nodes.select(*[F.col(c).alias(t) for c, t in NODE_TITLES])


def active(df: DataFrame, all: bool = False, state: str = "state") -> DataFrame:
    """Hide terminated containers unless ``all``.  A NULL state is
    dropped too (SQL ``!=``)."""
    return df if all else df.where(F.col(state) != F.lit("terminated"))


def lookup(keys: DataFrame, table: DataFrame, key: str, cols: Sequence[str], key_col: str | None = None) -> DataFrame:
    """Batch key lookup: every key row with the matching ``cols`` (NULL
    when absent)."""
    key_col = key_col or key
    right = table.select(F.col(key).alias("_lk"), *cols)
    return keys.join(right, F.col(key_col) == F.col("_lk"), "left").drop("_lk")


# --------------------------------------------------------------------------
# P4, P5, J5, J6, J8


# Fixed rank operators of a run request.
RANK_OPS = ("any", "eq", "le", "ge")


def rank_ok(op: Column, n: Column, rank: Column) -> Column:
    """P4 as a predicate: any / eq N / le N / ge N.  Any other operator is
    never true (see ``bad_rank_requests``)."""
    return (F.when(op == "any", F.lit(True))
            .when(op == "eq", rank == n)
            .when(op == "le", rank <= n)
            .when(op == "ge", rank >= n)
            .otherwise(F.lit(False)))


def bad_rank_requests(requests: DataFrame, op: str = "rank_op") -> DataFrame:
    """P4 error rows: requests with an unknown rank operator."""
    return requests.where(~F.coalesce(F.col(op).isin(*RANK_OPS), F.lit(False)))


def match_rank(nodes: DataFrame, requests: DataFrame, request_id: str = "request_id", op: str = "rank_op",
               n: str = "rank_n", rank: str = "node_rank", node_id: str = "node_id", need_tpm: str | None = None,
               tpm: str = "have_tpm", partitions: int | None = None) -> DataFrame:
    """Per request the number of nodes whose rank satisfies all its rank
    predicates and the lowest ``node_id`` among them: (request_id, n_nodes,
    node_id), one row per request.  Repeated predicates are ANDed; ``any``
    accepts every rank and, if nothing else is asked, nodes without one; an unknown operator
    or a missing number matches nothing, as a false SQL predicate would.  With ``need_tpm`` (a boolean
    request column) only TPM nodes count for the requests that need one.

    No request x node pairs are formed.  A request's predicates fold into one
    interval of ranks.  Distinct ranks and interval ends stand in one order
    (``ordered_scan``): running sums there give every end the number of ranks
    and of nodes before it, so the count is one difference.  The lowest id of a
    stretch of ranks is two look-ups in a disjoint sparse table: for each length
    2^k the ranks are cut into halves of that length, and each rank keeps the
    lowest id from itself to the middle of its pair of halves.  Two ranks that
    differ in bit k at the highest lie on both sides of such a middle.  Nodes
    and requests are read once, into the written table of that order."""
    o, v = F.col(op), F.col(n)
    known = F.coalesce(o.isin(*RANK_OPS), F.lit(False))
    bounded = F.coalesce(o.isin("ge", "le", "eq"), F.lit(False))
    secure = F.coalesce(F.col(need_tpm), F.lit(False)) if need_tpm else F.lit(False)
    iv = requests.groupBy(F.col(request_id).alias("_req")).agg(
        F.max(F.when(o.isin("ge", "eq"), v)).cast("long").alias("_lo"), F.min(F.when(o.isin("le", "eq"), v)).cast("long").alias("_hi"),
        F.max(bounded).alias("_ranked"), F.max(secure).alias("_need"), F.max(~known | (bounded & v.isNull())).alias("_void"))
    has = F.coalesce(F.col(tpm), F.lit(False)) if tpm in nodes.columns else F.lit(False)
    per_rank = (nodes.groupBy(F.col(rank).cast("long").alias("_rank"))
                .agg(F.count("*").alias("_n"), F.min(node_id).alias("_id"), F.count(F.when(has, 1)).alias("_nt"), F.min(F.when(has, F.col(node_id))).alias("_idt")))
    # places: zone 0 the nodes without a rank, 1 the ranks, -1 and 2 before and behind all; of one value, low end < rank < high end
    zone, at, side = ("_zone", "_at", "_side")
    place = lambda z, x, y: F.struct(F.lit(z).alias(zone), F.coalesce(x, F.lit(0)).cast("long").alias(at), F.lit(y).alias(side))
    first, last, zero = place(-1, F.lit(0), 0), place(2, F.lit(0), 2), F.lit(-(1 << 63))
    low = (F.when(F.col("_void"), place(2, F.lit(0), 0)).when(F.col("_lo").isNotNull(), place(1, F.col("_lo"), 0)).when(F.col("_ranked"), place(1, zero, 0)).otherwise(first))
    high = (F.when(F.col("_void"), place(-1, F.lit(0), 2)).when(F.col("_hi").isNotNull(), place(1, F.col("_hi"), 2)).otherwise(last))
    ends = iv.select("_req", "_need", F.explode(F.array(low, high)).alias("_p")).select("_req", "_need", "_p.*")
    ranks = per_rank.select(F.when(F.col("_rank").isNull(), 0).otherwise(1).alias(zone), F.coalesce("_rank", F.lit(0)).cast("long").alias(at), F.lit(1).alias(side), "_n", "_nt", "_id", "_idt")
    is_rank = F.col(side) == 1
    scanned = ordered_scan(ranks.unionByName(ends, allowMissingColumns=True), [], [zone, at, side, "_req"],
                           [Count("_k", is_rank), Count("_c", is_rank, F.col("_n")), Count("_ct", is_rank, F.col("_nt"))], partitions=partitions)
    path = scratch_dir(nodes.sparkSession, "ranks")
    scanned.write.parquet(path)
    placed = nodes.sparkSession.read.schema(scanned.schema).parquet(path)
    # the sparse table; a number's level is the highest bit in which it can differ from another
    bits = placed.where(is_rank).agg(F.max(F.length(F.bin(F.col("_k"))))).scalar()
    half = F.expr("shiftright(_i, _level)")
    outward = W.partitionBy("_level", half).orderBy(F.when(half % 2 == 0, -F.col("_i")).otherwise(F.col("_i"))).rowsBetween(W.unboundedPreceding, W.currentRow)
    table = (placed.where(is_rank).select((F.col("_k") - 1).alias("_i"), "_id", "_idt", F.explode(F.sequence(F.lit(0), bits)).alias("_level"))
             .select("_level", "_i", F.min("_id").over(outward).alias("_id"), F.min("_idt").over(outward).alias("_idt")))
    of = lambda end, c: F.max(F.when(F.col(side) == end, F.col(c)))
    asked = (placed.where(~is_rank).groupBy("_req").agg(
        F.max("_need").alias("_need"), of(0, "_k").alias("_a"), (of(2, "_k") - 1).alias("_b"),
        (of(2, "_c") - of(0, "_c")).alias("_all"), (of(2, "_ct") - of(0, "_ct")).alias("_tpm")))
    asked = asked.withColumn("_level", F.when(F.col("_a") < F.col("_b"), F.length(F.bin(F.expr("_a ^ _b"))) - 1).when(F.col("_a") == F.col("_b"), 0))
    end = lambda c: table.select(F.col("_level").alias(f"_l{c}"), F.col("_i").alias(f"_i{c}"), F.struct("_id", "_idt").alias(f"_min{c}"))
    j = asked
    for c in ("_a", "_b"):
        j = j.join(end(c), (F.col("_level") == F.col(f"_l{c}")) & (F.col(c) == F.col(f"_i{c}")), "left")
    lowest = F.when(F.col("_need"), F.least("_min_a._idt", "_min_b._idt")).otherwise(F.least("_min_a._id", "_min_b._id"))
    count = F.when(F.col("_level").isNull(), 0).otherwise(F.when(F.col("_need"), F.col("_tpm")).otherwise(F.col("_all")))
    return j.select(F.col("_req").alias(request_id), F.coalesce(count, F.lit(0)).cast("long").alias("n_nodes"), lowest.alias(node_id))


def tpm_ok(fstype: Column, have_tpm: Column) -> Column:
    """P5: a TPM is needed for ``s-ramfs``; other types take any node."""
    return F.when(fstype == F.lit("s-ramfs"), F.coalesce(have_tpm, F.lit(False))).otherwise(F.lit(True))


def occupied_nodes(containers: DataFrame, node_id: str = "node_id") -> DataFrame:
    """Node ids held by a container (``node_id IS NOT NULL``, whatever the
    state says)."""
    return containers.where(F.col(node_id).isNotNull()).select(node_id)


def free_nodes(nodes: DataFrame, containers: DataFrame, node_id: str = "node_id") -> DataFrame:
    """Nodes no container holds (left anti join; NULL node ids of
    terminated containers are skipped)."""
    return nodes.join(occupied_nodes(containers, node_id), node_id, "left_anti")


def deletable_nodes(nodes: DataFrame, containers: DataFrame, null_aware: bool = True,
                    node_id: str = "node_id") -> DataFrame:
    """Nodes that no container names.

    ``null_aware=True`` keeps the reference's ``NOT IN`` without a NULL
    guard: one container with NULL node_id (any terminated one) makes the
    result empty.  The NULL test is an uncorrelated EXISTS subquery (run
    once, stops at the first NULL) and the rest a left anti join, so it plans
    as a shuffle or broadcast join rather than a null-aware broadcast of the
    whole container side.  ``null_aware=False`` is J6."""
    free = free_nodes(nodes, containers, node_id)
    if not null_aware:
        return free
    return free.where(~containers.where(F.col(node_id).isNull()).exists())


def candidates(requests: DataFrame, kernels: DataFrame, initrds: DataFrame, rootfs: DataFrame, nodes: DataFrame,
               containers: DataFrame, request_id: str = "request_id", partitions: int | None = None) -> DataFrame:
    """For each run request whose kernel, initrd and image exist, their
    ids, the number of free nodes that fit and the lowest of them (NULL when
    none): the rank predicates hold, and ``s-ramfs`` needs a TPM node.  One
    row per request, as the reference takes one node (LIMIT 1).

    Requests carry: request_id, kernel, initrd, image, fstype, rank_op,
    rank_n; rows that repeat a request_id add rank predicates (ANDed)."""
    images = requests.select(request_id, "kernel", "initrd", "image").distinct()
    asked = requests.select(request_id, "rank_op", "rank_n", (F.col("fstype") == F.lit("s-ramfs")).alias("_need"))
    fit = match_rank(free_nodes(nodes, containers), asked, request_id, need_tpm="_need", partitions=partitions)
    return with_image_ids(images.join(fit, request_id), kernels, initrds, rootfs, partitions).select(
        request_id, "kernel_id", "initrd_id", "rootfs_id", "n_nodes", "node_id")


#: About how many kernels of one name are packed into an array, and how many requests or initrds.
BLOCK, FEW = 4096, 64


def _packed(df: DataFrame, by: Sequence[str], out: str, block: int) -> DataFrame:
    """``df`` in arrays of about ``block`` rows or less that are alike in ``by``: by, _n (arrays of these values),
    _chunk (from 0), ``out`` (structs of the other columns).  Rows with a NULL in ``by`` meet nothing and are left out."""
    rows = df.dropna(subset=list(by)).select(*by, F.struct(*[c for c in df.columns if c not in by]).alias(out))
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / block).alias("_n"))
    return (rows.join(counts, list(by)).groupBy(*by, "_n", F.pmod(F.xxhash64(out), F.col("_n")).alias("_chunk"))
            .agg(F.collect_list(out).alias(out)))


def with_image_ids(requests: DataFrame, kernels: DataFrame, initrds: DataFrame, rootfs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Requests (kernel, initrd, image: names) with kernel_id, initrd_id and rootfs_id, one row for each
    combination of rows of these names.

    Names may be shared by many images and many requests, so there may be far
    more combinations than rows in all tables together.  Until the last step
    requests of the same names, and images of a name, therefore stand in arrays
    of bounded length, which meet on (name, array number); the arrays are
    exploded behind the last exchange, so what is shuffled stays in proportion
    to the tables and combinations are only streamed out.  A task holds all rows
    that one row becomes in explodes which follow each other directly; requests
    and initrds are therefore exploded before the join with the kernels, whose
    sort stands between, and a row behind it becomes ``BLOCK`` rows, not the
    product of three arrays."""
    spark = requests.sparkSession
    named = lambda df, kind, c: df.select(F.col(f"{kind}_name").alias(c), f"{kind}_id")
    path = scratch_dir(spark, "with-image")
    found = requests.join(named(rootfs, "rootfs", "image"), "image")
    found.write.parquet(path)
    asked = _packed(spark.read.schema(found.schema).parquet(path), ["kernel", "initrd"], "_asked", min(FEW, BLOCK)).drop("_n", "_chunk")
    i = _packed(named(initrds, "initrd", "initrd"), ["initrd"], "_i", min(FEW, BLOCK)).drop("_n", "_chunk")
    k = _packed(named(kernels, "kernel", "kernel"), ["kernel"], "_k", BLOCK).withColumn("_k", F.col("_k.kernel_id"))
    # a fixed number of partitions: few bytes may become many rows, which AQE's merging of small partitions cannot know
    n = int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    left = (asked.join(i, "initrd").join(k.select("kernel", "_n").distinct(), "kernel")
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n"))
    each = (left.repartition(n, "kernel", "_chunk").select("kernel", "_chunk", "initrd", F.explode("_asked").alias("_asked"), "_i")
            .select("kernel", "_chunk", "initrd", "_asked.*", F.explode("_i").alias("_i")))
    met = each.join(k.drop("_n").repartition(n, "kernel", "_chunk").hint("merge"), ["kernel", "_chunk"])
    return met.select("kernel", "initrd", *[c for c in found.columns if c not in ("kernel", "initrd")], "_i.initrd_id", F.explode("_k").alias("kernel_id"))


# --------------------------------------------------------------------------
# J1-J4, O1


def node_occupancy(nodes: DataFrame, containers: DataFrame) -> DataFrame:
    """Node listing (P1 titles) with the container on each node."""
    c = containers.where(F.col("node_id").isNotNull()).select("node_id", "bmc_id", "state")
    return nodes.join(c, "node_id", "left").select(*[F.col(col).alias(t) for col, t in NODE_TITLES],
                                                   "bmc_id", "state")


def container_listing(containers: DataFrame, kernels: DataFrame, initrds: DataFrame, rootfs: DataFrame,
                      nodes: DataFrame, all: bool = False, sort: bool = True) -> DataFrame:
    """J2 (+ P2, O1): the container listing: four left joins; the kernel
    parameter is the kernel's then the container's, joined by a space and
    NULL when either is NULL (``||``, not ``concat_ws``).  Ordered by created
    then bmc_id (the id makes ties stable)."""
    c = active(containers, all)
    k = kernels.select("kernel_id", "kernel_name", F.col("kernel_param").alias("_kparam"))
    i = initrds.select("initrd_id", "initrd_name")
    r = rootfs.select("rootfs_id", "rootfs_name")
    n = nodes.select("node_id", "node_name", F.col("ip4_addr_os").alias("addr"))
    j = (c.join(k, "kernel_id", "left").join(i, "initrd_id", "left")
         .join(r, "rootfs_id", "left").join(n, "node_id", "left"))
    out = j.select("bmc_id", "addr", "client_addr", "kernel_name",
                   F.concat(F.col("_kparam"), F.lit(" "), F.col("kernel_param")).alias("kernel_param"),
                   "initrd_name", "rootfs_name", "node_name", "fstype", "command", "created", "state")
    return out.orderBy("created", "bmc_id") if sort else out


def container_ids(containers: DataFrame, all: bool = False) -> DataFrame:
    """Container ids in created order."""
    return active(containers, all).select("bmc_id", "created").orderBy("created", "bmc_id").select("bmc_id")


def container_detail(keys: DataFrame, containers: DataFrame, nodes: DataFrame, kernels: DataFrame,
                     initrds: DataFrame, rootfs: DataFrame) -> DataFrame:
    """Container with node and images, by four inner joins, for the
    asked ids.  A terminated container (node NULL) or one whose image row is
    gone yields no row."""
    c = containers.join(keys.select("bmc_id").distinct(), "bmc_id", "left_semi")
    return (c.join(nodes.drop("password_mgmt"), "node_id")
            .join(kernels.withColumnRenamed("kernel_param", "kernel_default_param"), "kernel_id")
            .join(initrds, "initrd_id").join(rootfs, "rootfs_id"))


# --------------------------------------------------------------------------
# J9-J12


def image_presence(names: DataFrame, images: DataFrame, name: str = "name") -> DataFrame:
    """J9 (+ A2): per asked name, how many images of each kind carry it.

    ``found`` = the name exists in some kind; ``broken`` = some kind has it
    more than once (a UNIQUE column holding a duplicate).  Images are counted
    per (name, kind) before the join (partial aggregation)."""
    counts = images.groupBy(F.col("name").alias("_n")).agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in IMAGE_KINDS])
    j = names.select(name).distinct().join(counts, F.col(name) == F.col("_n"), "left").drop("_n")
    ns = [F.coalesce(F.col(f"n_{k}"), F.lit(0)) for k in IMAGE_KINDS]
    return j.select(name, *[c.alias(f"n_{k}") for c, k in zip(ns, IMAGE_KINDS)],
                    F.greatest(*[c > 0 for c in ns]).alias("found"),
                    F.greatest(*[c > 1 for c in ns]).alias("broken"))


def _signed(sig: Column) -> Column:
    """Unsigned = NULL or '' (the reference tests ``-z``)."""
    return F.coalesce(sig, F.lit("")) != F.lit("")


def signed_policy(fstype: Column, kernel_signed: Column, initrd_signed: Column) -> Column:
    """``s-ramfs`` needs both signature files; NULL when fine, else the
    reason."""
    s = fstype == F.lit("s-ramfs")
    return (F.when(s & ~kernel_signed, F.lit("unsigned kernel"))
            .when(s & ~initrd_signed, F.lit("unsigned initrd")))


def _by_name(df: DataFrame, name: str, sig: str | None, prefix: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_n")]
    if sig:
        aggs.append(F.max(_signed(F.col(sig)).cast("int")).cast("boolean").alias(f"{prefix}_signed"))
    return df.groupBy(F.col(name).alias(f"_{prefix}")).agg(*aggs)


def run_gate(requests: DataFrame, kernels: DataFrame, initrds: DataFrame, rootfs: DataFrame) -> DataFrame:
    """J10 + J11: gate of a run request, in the reference's order:
    missing kernel, missing initrd, unsigned kernel, unsigned initrd (both
    only for s-ramfs), needs pull (no such rootfs), ok.

    Images are reduced to one row per name first (count, any signature), so
    duplicate names never multiply requests."""
    k = _by_name(kernels, "kernel_name", "kernel_sig_file", "k")
    i = _by_name(initrds, "initrd_name", "initrd_sig_file", "i")
    r = _by_name(rootfs, "rootfs_name", None, "r")
    j = (requests.join(k, F.col("kernel") == F.col("_k"), "left")
         .join(i, F.col("initrd") == F.col("_i"), "left")
         .join(r, F.col("image") == F.col("_r"), "left"))
    policy = signed_policy(F.col("fstype"), F.coalesce(F.col("k_signed"), F.lit(False)),
                           F.coalesce(F.col("i_signed"), F.lit(False)))
    gate = (F.when(F.col("_k").isNull(), F.lit("missing kernel"))
            .when(F.col("_i").isNull(), F.lit("missing initrd"))
            .when(policy.isNotNull(), policy)
            .when(F.col("_r").isNull(), F.lit("needs pull"))
            .otherwise(F.lit("ok")))
    return j.select(*requests.columns, gate.alias("gate"))


def required_files(images_joined: DataFrame, root: str = "") -> DataFrame:
    """The files a container's images need: kernel, initrd, rootfs,
    ``rootfs-etc``, and each signature file only when one is named."""
    def p(c: Column) -> Column:
        return F.concat(F.lit(root), c) if root else c

    files = F.array(
        F.struct(F.lit("kernel").alias("what"), p(F.col("kernel_file")).alias("path")),
        F.struct(F.lit("initrd").alias("what"), p(F.col("initrd_file")).alias("path")),
        F.struct(F.lit("rootfs").alias("what"), p(F.col("rootfs_file")).alias("path")),
        F.struct(F.lit("rootfs-etc").alias("what"), p(F.concat(F.col("rootfs_file"), F.lit("-etc"))).alias("path")),
        F.struct(F.lit("kernel-sig").alias("what"),
                 F.when(_signed(F.col("kernel_sig_file")), p(F.col("kernel_sig_file"))).alias("path")),
        F.struct(F.lit("initrd-sig").alias("what"),
                 F.when(_signed(F.col("initrd_sig_file")), p(F.col("initrd_sig_file"))).alias("path")))
    return (images_joined.select("bmc_id", F.explode(files).alias("f"))
            .select("bmc_id", "f.what", "f.path").where(F.col("path").isNotNull()))


def missing_files(required: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Required files that the listing does not hold (left anti)."""
    return required.join(listing.select(F.col(path).alias("_p")), F.col("path") == F.col("_p"), "left_anti")


# --------------------------------------------------------------------------
# A1, A2


def key_counts(keys: DataFrame, df: DataFrame, col: str, key_col: str | None = None) -> DataFrame:
    """A1: rows per asked key, 0 when absent (counted before the join)."""
    key_col = key_col or col
    counts = df.groupBy(F.col(col).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    j = keys.join(counts, F.col(key_col) == F.col("_k"), "left").drop("_k")
    return j.withColumn("n", F.coalesce(F.col("n"), F.lit(0)))


def duplicates(df: DataFrame, col: str) -> DataFrame:
    """A2: values of a UNIQUE column that occur more than once (NULLs are
    not duplicates).

    Values may be long, so 64-bit hashes are counted first, and only the
    values whose hash repeats are compared themselves."""
    rows = df.where(F.col(col).isNotNull()).select(col)
    again = rows.groupBy(F.xxhash64(col).alias("_h")).agg(F.count("*").alias("_n")).where("_n > 1")
    return (rows.join(again, F.xxhash64(col) == F.col("_h"), "left_semi").groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))
