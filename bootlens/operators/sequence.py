"""Ordered scans over keyed sequences that stay balanced when one key is hot.

Several timeline operators need "the row before this one for the same key"
(pairing begin/end marks, carrying a container id forward, the run a line
belongs to, the next notice after a boot start).  A plain
``Window.partitionBy(key)`` sends every row of a key to one task; when one
container, meter or user holds a third of all rows that task holds a third
of the data.  ``ordered_scan`` avoids this:

1. ``repartitionByRange(*keys, *order)`` spreads the rows over ``P``
   ranges of the total order (key, order...), P being
   ``spark.sql.shuffle.partitions``.  Spark samples the data, so a hot key is
   cut into many ranges; the order columns end in a unique tie-breaker, so
   even equal timestamps are split.  AQE may merge adjacent small ranges
   (a merged range is still a contiguous slice of the order), so tiny inputs
   do not pay for P tasks.
2. The range number is stored with the rows: they are written once as a
   parquet table in the shared checkpoint folder (``spark.checkpoint.dir``)
   and read back.  The range bounds come from sampling and differ between
   two executions of the same plan, so they are fixed once; the written
   table also cuts the lineage, so a lost executor only costs a re-read of
   the shared files, and later steps read only the columns they need.
3. Inside each range a window over ``(range, key)`` computes the scan.  Such
   a group is at most one range (about N/P rows), never a whole hot key.
4. A row whose predecessor lies in an earlier range takes it from an edge
   table: one row per non-empty range (at most P rows), joined on the range
   number.  The table is written, too, so that its size is known before the
   rows are touched: it is broadcast when that allows, else rows are shuffled.
   Edge values are found with ``max_by`` (partial aggregation, nothing is
   collected to the driver).

``descending=True`` runs the scan from the end: ``Lag`` then yields the next
row and ``Fill`` the nearest later match.

5. Totals over the whole run that a ``Fill`` gives a row (the rows behind it
   too) are made inside each range by a second window, which needs no further
   shuffle.  Only the first and last run of a range can reach into others;
   their parts are put together in a table of one row per range.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bootlens.session import ensure_checkpoint_dir, scratch_dir


@dataclass
class Lag:
    """Values of ``cols`` on the neighbouring row of the same key.

    Output columns are ``prefix + col``.
    """

    cols: Sequence[str]
    prefix: str = "prev_"


@dataclass
class Fill:
    """Values of ``cols`` on the nearest row at or before this one (same key)
    where ``when`` holds.  Output columns are ``prefix + col``; NULL when no
    such row exists.

    ``least`` and ``greatest`` (output name to column) are the minimum and
    maximum over the row's run: all rows of the key that take the same filled
    values, also those behind this one."""

    cols: Sequence[str]
    when: Column | str
    prefix: str = "fill_"
    least: dict[str, Column] = field(default_factory=dict)
    greatest: dict[str, Column] = field(default_factory=dict)
    _flag: str = field(default="", repr=False)

    def totals(self) -> list[tuple]:
        return [(out, F.min, c) for out, c in self.least.items()] + [(out, F.max, c) for out, c in self.greatest.items()]


@dataclass
class Count:
    """Running count (inclusive) of rows of the same key where ``when``
    holds (all rows when ``when`` is None), in scan order.  With ``value``
    the running sum of that column instead (NULL counts 0; give a decimal for
    sums whose differences must be exact).  Output ``out``."""

    out: str = "running_count"
    when: Column | str | None = None
    value: Column | str | None = None
    _flag: str = field(default="", repr=False)


def _as_col(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def _same_key(keys: Sequence[str], struct_col: str) -> Column:
    """The row's key is that of a struct with the key as k0, k1, ..."""
    cond = F.col(struct_col).isNotNull()
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"{struct_col}.k{i}"))
    return cond


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the checkpoint folder, whose size is known to who joins it."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _run_edges(ranged: DataFrame, keys: Sequence[str], rank: Column, op: Fill) -> DataFrame:
    """One row per range: the key and totals of the run that reaches into it (``head``, NULL when none does) and of
    its last run (``tail``, with the values that ``op`` fills in there), over all ranges that hold rows of them."""
    flag = F.col(op._flag)
    key = F.struct(F.lit(True).alias("row"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    ends = ranged.groupBy("_part").agg(
        F.min_by(key, rank).alias("_first"), F.max_by(key, rank).alias("_last"), F.min(F.when(flag, rank)).alias("_from"), F.max(F.when(flag, rank)).alias("_to"),
        F.max_by(F.struct(key.alias("key"), F.struct(*op.cols).alias("values")), F.when(flag, rank)).alias("_start"))
    ends = _written(ends, "run-ends")
    head = _same_key(keys, "_first") & (F.col("_from").isNull() | (rank < F.col("_from")))
    tail = _same_key(keys, "_last") & (F.col("_to").isNull() | (rank >= F.col("_to")))
    totals = op.totals()
    told = ranged.join(ends, "_part").groupBy("_part").agg(
        *[F.any_value(c).alias(c) for c in ends.columns[1:]], F.max(head).alias("any_head"), *[how(F.when(head, c)).alias(f"h{j}") for j, (_, how, c) in enumerate(totals)],
        *[how(F.when(tail, c)).alias(f"t{j}") for j, (_, how, c) in enumerate(totals)])
    # runs are numbered along the ranges: a range begins one unless it lies within one as a whole
    by_range = W.orderBy("_part")
    runs = (told.withColumn("goes_on", F.col("any_head") & F.lag("_last").over(by_range).eqNullSafe(F.col("_first")))
            .withColumn("within", F.col("goes_on") & F.col("_from").isNull() & F.col("_first").eqNullSafe(F.col("_last")))
            .withColumn("tail_run", F.sum(F.when(F.col("within"), 0).otherwise(1)).over(by_range.rowsBetween(W.unboundedPreceding, W.currentRow)))
            .withColumn("head_run", F.when(F.col("goes_on"), F.when(F.col("within"), F.col("tail_run")).otherwise(F.lag("tail_run").over(by_range)))))
    parts = runs.select(F.explode(F.array(*[F.struct(F.col(f"{e}_run").alias("run"), *[F.col(f"{e[0]}{j}").alias(f"x{j}") for j in range(len(totals))])
                                            for e in ("head", "tail")])).alias("p")).select("p.*")
    of_run = parts.where("run IS NOT NULL").groupBy("run").agg(*[how(f"x{j}").alias(f"x{j}") for j, (_, how, _) in enumerate(totals)])
    total = lambda e: of_run.select(F.col("run").alias(f"{e}_run"), F.struct(F.lit(True).alias("row"), *[f"x{j}" for j in range(len(totals))]).alias(f"{e}_total"))
    return (runs.join(total("head"), "head_run", "left").join(total("tail"), "tail_run")
            .select("_part", F.col("_first").alias("first"), F.col("_last").alias("last"), F.when(F.col("_start.key").eqNullSafe(F.col("_last")), F.col("_start.values")).alias("values"), "head_total", "tail_total"))


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], ops: Sequence[Lag | Fill | Count],
                 descending: bool = False, partitions: int | None = None) -> DataFrame:
    """Add the columns of ``ops`` to ``df``; see the module text.

    ``order`` columns order the rows of a key; end them with a unique
    tie-breaker.  Reverse scans negate them, so they must be numeric
    (epoch nanoseconds, sequence numbers); forward scans take any sortable
    column.  ``keys`` may be empty (one sequence over all rows).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n_ranges = int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    if n_ranges < 1:
        raise ValueError(f"partitions must be at least 1, got {n_ranges}")

    keys, order = list(keys), list(order)
    if not ops:
        return df
    base_cols = df.columns
    # a reverse scan is a forward scan over the order turned round; neither keeps a second copy of the order columns
    pos = [F.col(o).desc_nulls_first() if descending else F.col(o).asc_nulls_first() for o in order]
    extra = []
    fills = [op for op in ops if isinstance(op, Fill)]
    lags = [op for op in ops if isinstance(op, Lag)]
    for i, op in enumerate(fills):
        op._flag = f"_fw{i}"
        extra.append(F.coalesce(_as_col(op.when), F.lit(False)).alias(op._flag))
    counts = [op for op in ops if isinstance(op, Count)]
    for i, op in enumerate(counts):
        op._flag = f"_cw{i}"
        cond = F.lit(True) if op.when is None else F.coalesce(_as_col(op.when), F.lit(False))
        added = cond.cast("long") if op.value is None else F.coalesce(F.when(cond, _as_col(op.value)), F.lit(0))
        extra.append(added.alias(op._flag))

    path = scratch_dir(spark, "ordered-scan")
    staged = df.select("*", *extra)
    # Without an explicit count the ranges start at spark.sql.shuffle.partitions
    # and AQE may merge adjacent small ones: a merged partition still holds a
    # contiguous slice of the order, which is all the edge stitching needs.
    ranged_out = (staged.repartitionByRange(n_ranges, *keys, *pos) if partitions
                  else staged.repartitionByRange(*keys, *pos))
    ranged_out.withColumn("_part", F.spark_partition_id()).write.mode("overwrite").parquet(path)
    ranged = spark.read.parquet(path)

    # 3. scan inside each range
    w = W.partitionBy("_part", *keys).orderBy(*pos)
    local = ranged
    for op in lags:
        local = local.withColumn(f"_lf_{op.prefix}", F.lag(F.lit(True)).over(w))
        for c in op.cols:
            local = local.withColumn(f"_l_{op.prefix}{c}", F.lag(c).over(w))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    for op in fills:
        local = local.withColumn(
            f"_f_{op.prefix}",
            F.last(F.when(F.col(op._flag), F.struct(*[F.col(c) for c in op.cols])), ignorenulls=True).over(upto))

    for op in counts:
        local = local.withColumn(f"_n_{op.out}", F.sum(op._flag).over(upto))

    for op in fills:
        run = W.partitionBy("_part", *keys, f"_f_{op.prefix}")
        for name, how, c in op.totals():
            local = local.withColumn(f"_t_{name}", how(c).over(run))

    # 4. edges: last row and last matching row of every range
    key_struct = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    rank = F.struct(*keys, *[(-F.col(o)).alias(f"_pos{i}") if descending else F.col(o) for i, o in enumerate(order)])
    aggs = []
    lag_cols = [c for op in lags for c in op.cols]
    if lags:
        aggs.append(F.max_by(F.struct(*key_struct, *[F.col(c).alias(f"v{j}") for j, c in enumerate(lag_cols)]),
                             rank).alias("_e_last"))
    for i, op in enumerate(fills):
        aggs.append(F.max_by(F.struct(*key_struct, *[F.col(c).alias(f"v{j}") for j, c in enumerate(op.cols)]),
                             F.when(F.col(op._flag), rank)).alias(f"_e_fill{i}"))
    edges = ranged.groupBy("_part").agg(*aggs) if aggs else None
    if counts:
        # count of the last key of each range: partial counts per (range,
        # key), then the last key's per range; then running totals along the
        # ranges that end in the same key.
        per_key = ranged.groupBy("_part", *keys).agg(*[F.sum(op._flag).alias(f"c{i}") for i, op in enumerate(counts)])
        tail = per_key.groupBy("_part").agg(
            F.max_by(F.struct(*key_struct, *[F.col(f"c{i}").alias(f"v{i}") for i in range(len(counts))]),
                     F.struct(*keys)).alias("_e_tail"))
        tail_keys = [F.col(f"_e_tail.k{i}") for i in range(len(keys))]
        by_last = W.partitionBy(*tail_keys).orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
        tail = tail.select("_part", F.struct(
            *[k.alias(f"k{i}") for i, k in enumerate(tail_keys)],
            *[F.sum(F.col(f"_e_tail.v{i}")).over(by_last).alias(f"v{i}") for i in range(len(counts))]).alias("_e_cum"))
        edges = tail if edges is None else edges.join(tail, "_part", "full")
    by_range = W.orderBy("_part")  # one row per range
    carry_cols = [F.col("_part")]
    if lags:
        carry_cols.append(F.lag("_e_last").over(by_range).alias("_c_last"))
    for i, _ in enumerate(fills):
        carry_cols.append(F.last(f"_e_fill{i}", ignorenulls=True)
                          .over(by_range.rowsBetween(W.unboundedPreceding, -1)).alias(f"_c_fill{i}"))
    if counts:
        carry_cols.append(F.lag("_e_cum").over(by_range).alias("_c_cum"))
    carry = edges.select(*carry_cols)
    for i, op in enumerate(fills):
        if op.totals():
            whole = _run_edges(ranged, keys, rank, op)
            carry = carry.join(whole.select("_part", F.struct(*whole.columns[1:]).alias(f"_c_run{i}")), "_part", "left")
    # written, as Spark reckons it as large as the rows it is made of until it knows: they would all be shuffled by range again
    carry = _written(carry, "range-edges")

    out = local.join(carry, "_part", "left")
    same_key = partial(_same_key, keys)

    results = []
    j = 0
    for op in lags:
        local_found = F.col(f"_lf_{op.prefix}").isNotNull()
        for c in op.cols:
            results.append(F.when(local_found, F.col(f"_l_{op.prefix}{c}"))
                           .when(same_key("_c_last"), F.col(f"_c_last.v{j}")).alias(op.prefix + c))
            j += 1
    for i, op in enumerate(fills):
        found = F.col(f"_f_{op.prefix}").isNotNull()
        for jj, c in enumerate(op.cols):
            results.append(F.when(found, F.col(f"_f_{op.prefix}.{c}"))
                           .when(same_key(f"_c_fill{i}"), F.col(f"_c_fill{i}.v{jj}")).alias(op.prefix + c))
        last_run = same_key(f"_c_run{i}.last") & F.col(f"_f_{op.prefix}").eqNullSafe(F.col(f"_c_run{i}.values"))
        goes_on = same_key(f"_c_run{i}.first") & ~found & F.col(f"_c_run{i}.head_total").isNotNull()
        for jj, (name, _, _) in enumerate(op.totals()):
            results.append(F.when(last_run, F.col(f"_c_run{i}.tail_total.x{jj}")).when(goes_on, F.col(f"_c_run{i}.head_total.x{jj}"))
                           .otherwise(F.col(f"_t_{name}")).alias(name))
    for i, op in enumerate(counts):
        results.append((F.col(f"_n_{op.out}") + F.when(same_key("_c_cum"), F.col(f"_c_cum.v{i}")).otherwise(F.lit(0)))
                       .alias(op.out))
    return out.select(*[F.col(c) for c in base_cols], *results)
