"""Change sets applied to catalog tables.

No table format with MERGE ships with PySpark, so each operator returns the
new version of the table (write it as a new version; readers of the old one
are not disturbed) plus, where the reference reports them, error rows.
New ids are ``max(id) + running number``; the running number comes from
``ordered_scan`` (range partitioned), never from one global window.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bootlens.operators.sequence import Count, ordered_scan


def _with_new_ids(rows: DataFrame, base: DataFrame, id_col: str, order: str,
                  partitions: int | None = None, highest: int | Column | None = None) -> DataFrame:
    """Give ``rows`` the ids after the highest one ever given, in ``order``
    (unique among ``rows``; names are).  ``highest`` is that id where the
    table no longer holds it, so that the id of a deleted row never returns."""
    top = base.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()   # scalar subquery, run once
    if highest is not None:
        top = F.greatest(top, F.lit(highest) if isinstance(highest, int) else highest)
    numbered = ordered_scan(rows, [], [order], [Count("_n")], partitions=partitions)
    return numbered.withColumn(id_col, top + F.col("_n")).drop("_n")


def _last_per_name(rows: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """One change per name: the last in ``order`` (all columns when empty)."""
    rest = [c for c in rows.columns if c != name]
    at = F.struct(*[F.col(c) for c in (order or rows.columns)])
    return (rows.groupBy(name).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), at).alias("_r"))
            .select(name, *[F.col("_r")[c].alias(c) for c in rest]))


def apply_insert(table: DataFrame, rows: DataFrame, name: str, id_col: str, empty_as_null: bool = True,
                 partitions: int | None = None, order: Sequence[str] = (),
                 highest: int | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """M1: insert rows whose name is new; known names are refused, and of rows
    that repeat a new name all but the first in ``order`` (a unique input
    order; without one equal rows count once and the smallest row is first).

    With ``empty_as_null`` (the node insert) empty text is stored as NULL;
    image imports keep ''.  Returns (new table, refused rows)."""
    if empty_as_null:
        rows = rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c)
                             for c, t in rows.dtypes])
    if not order:
        rows = rows.dropDuplicates()
    at = F.struct(*[F.col(c) for c in (order or rows.columns)])
    first = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(at).alias("_first"))
    known = table.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_known", F.lit(True))
    marked = (rows.join(first, name, "left").join(known, name, "left")
              .withColumn("_ok", F.col("_known").isNull() & (F.col("_first").isNull() | (at == F.col("_first")))))
    new = marked.where("_ok").drop("_first", "_known", "_ok")
    refused = (marked.where("not _ok").drop("_first", "_known", "_ok")
               .withColumn("error", F.concat(F.lit("exists: "), F.col(name))))
    added = _with_new_ids(new.drop(id_col) if id_col in new.columns else new, table, id_col, name, partitions, highest)
    return table.unionByName(added.select(*table.columns)), refused


def apply_upsert(table: DataFrame, changes: DataFrame, name: str, id_col: str,
                 keep: Sequence[str] = ("kernel_param",), new_default: str = "",
                 partitions: int | None = None, order: Sequence[str] = (),
                 highest: int | Column | None = None) -> DataFrame:
    """M2: insert or update by name.  An updated row keeps its id and the
    ``keep`` columns; other columns take the change's values.  A new row gets
    a new id and ``new_default`` ('') in the ``keep`` columns.  Of changes that
    repeat a name the last in ``order`` counts.  One full outer join."""
    keep = list(keep)
    set_cols = [c for c in table.columns if c not in (id_col, name, *keep)]
    ch = _last_per_name(changes.select(name, *set_cols, *[c for c in order if c not in (name, *set_cols)]), name, order)
    new_of = [F.col(c).alias(f"_new_{c}") for c in set_cols]
    both = (table.withColumn("_old", F.lit(True))
            .join(ch.select(name, *new_of, F.lit(True).alias("_ch")), name, "full_outer"))
    merged = [F.when(F.col("_ch"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in set_cols
              else F.when(F.col("_old"), F.col(c)).otherwise(F.lit(new_default)).alias(c) if c in keep
              else F.col(c) for c in table.columns]
    added = _with_new_ids(both.where("_old is null").select(*merged).drop(id_col), table, id_col, name, partitions, highest)
    return both.where("_old").select(*merged).unionByName(added.select(*table.columns))


def apply_replace(table: DataFrame, changes: DataFrame, name: str, id_col: str,
                  partitions: int | None = None, order: Sequence[str] = (),
                  highest: int | Column | None = None) -> DataFrame:
    """M3: insert or replace: every changed name gets a new id (the replaced
    row's id is gone; containers pointing at it keep the old id).  Of changes
    that repeat a name the last in ``order`` stays."""
    kept = table.join(changes.select(name), name, "left_anti")
    ch = _last_per_name(changes, name, order)
    added = _with_new_ids(ch.drop(id_col) if id_col in ch.columns else ch, table, id_col, name, partitions, highest)
    return kept.unionByName(added.select(*table.columns))


def set_column(table: DataFrame, changes: DataFrame, name: str, col: str,
               order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """M4: update one column by name; of changes that repeat a name the last
    in ``order`` counts.  Returns (new table, unknown names)."""
    last = _last_per_name(changes.select(name, col, *[c for c in order if c not in (name, col)]), name, order)
    ch = last.select(name, F.col(col).alias("_v"), F.lit(True).alias("_m"))
    out = (table.join(ch, name, "left")
           .withColumn(col, F.when(F.col("_m"), F.col("_v")).otherwise(F.col(col))).drop("_v", "_m"))
    unknown = changes.join(table.select(name), name, "left_anti").withColumn(
        "error", F.concat(F.lit("unknown: "), F.col(name)))
    return out.select(*table.columns), unknown


def delete_by_name(table: DataFrame, names: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """M5: delete rows by name.  Returns (new table, unknown names)."""
    out = table.join(names.select(name), name, "left_anti")
    unknown = names.join(table.select(name), name, "left_anti").withColumn(
        "error", F.concat(F.lit("unknown: "), F.col(name)))
    return out.select(*table.columns), unknown


def insert_absent(table: DataFrame, rows: DataFrame, name: str, id_col: str, partitions: int | None = None,
                  order: Sequence[str] = (), highest: int | Column | None = None) -> DataFrame:
    """M6: insert rows whose name is absent; present names are left alone, and
    so is the table by rows that repeat a name after the first."""
    return apply_insert(table, rows, name, id_col, empty_as_null=False, partitions=partitions, order=order,
                        highest=highest)[0]


def latest_state(events: DataFrame, key: str = "bmc_id", order: Sequence[str] = ("epoch_ns", "seq"),
                 state: str = "state") -> DataFrame:
    """Current state per container from state events (last wins, by
    partial ``max_by``)."""
    o = F.struct(*[F.col(c) for c in order])
    return events.groupBy(key).agg(F.max_by(state, o).alias(state), F.max(o).alias("_at")).drop("_at")


LIVE, DEAD, GONE = range(3)
_CHUNK = pa.schema([("bmc_id", pa.string()), ("range", pa.int32()), ("from_live", pa.int32()), ("from_dead", pa.int32()), ("live_refused", pa.bool_()),
                    ("dead_refused", pa.bool_()), ("any_set", pa.bool_()), ("new", pa.string()), ("freed", pa.bool_())])
_CHUNK_DDL = ("bmc_id string, range int, from_live int, from_dead int, live_refused boolean, dead_refused boolean, any_set boolean, new string, freed boolean")


def _state_chunks(force: bool):
    """Ordered events of a range -> per container what they do together: where they lead from a live and from a dead
    container, whether a removal is refused on the way, and the state they leave."""
    after_removal = (GONE if force else LIVE, GONE, GONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now = TaskContext.get().partitionId(), None
        for batch in batches:
            done = []
            for key, state in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or key != now[0]:
                    if now is not None:
                        done.append(now)
                    now = [key, part, LIVE, DEAD, False, False, False, None, False]
                if state == "removed":
                    now[4] |= not force and now[2] == LIVE
                    now[5] |= not force and now[3] == LIVE
                    now[2], now[3] = after_removal[now[2]], after_removal[now[3]]
                else:
                    to = DEAD if state == "terminated" else LIVE
                    now[2], now[3] = (x if x == GONE else to for x in now[2:4])
                    now[6], now[7], now[8] = True, state, now[8] or to == DEAD
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _CHUNK.types)], schema=_CHUNK)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now, _CHUNK.types)], schema=_CHUNK)

    return run


def apply_states(containers: DataFrame, events: DataFrame, force: bool = False,
                 order: Sequence[str] = ("epoch_ns", "seq"), partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M7: apply state events (kill / rm) to the container table, in ``order``
    (end it with a unique column).

    An event sets the container's state; ``terminated`` frees its node.
    ``removed`` deletes the row if the state before it (the last state event,
    else the table's) is ``terminated``, or with ``force``; any other state,
    NULL too, is live: that removal is refused and the rest of the events
    still counts.  Returns (new table, containers with a refused removal).

    An event is a function on live, dead and gone containers, and so is a run
    of events.  The events are range-partitioned by (container, order) and
    streamed through once; each range gives a function a container, and a
    container's few (one but where its events span ranges) are applied one
    after the other to the state in the table."""
    state = F.col("state").cast("string").alias("_state")
    ev = events.where(F.col("bmc_id").isNotNull()).select(F.col("bmc_id").cast("string").alias("bmc_id"), state, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    at = ["bmc_id", *[f"_o{i}" for i in range(len(order))]]
    ranged = ev.repartitionByRange(partitions, *at) if partitions else ev.repartitionByRange(*at)
    chunks = ranged.sortWithinPartitions(*at).select("bmc_id", "_state").mapInArrow(_state_chunks(force), _CHUNK_DDL)
    steps = chunks.groupBy("bmc_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(f.name) for f in _CHUNK][1:]))).alias("_steps"))   # one a range

    def follow(start: Column) -> Column:
        first = F.struct(start.alias("at"), F.lit(False).alias("refused"))
        to = lambda s, x: F.when(s["at"] == LIVE, x["from_live"]).when(s["at"] == DEAD, x["from_dead"]).otherwise(GONE)
        no = lambda s, x: F.when(s["at"] == LIVE, x["live_refused"]).when(s["at"] == DEAD, x["dead_refused"]).otherwise(False)
        return F.aggregate("_steps", first, lambda s, x: F.struct(to(s, x).alias("at"), (s["refused"] | no(s, x)).alias("refused")))

    key = "bmc_id"
    j = containers.join(steps.withColumnRenamed("bmc_id", "_bmc"), F.col(key) == F.col("_bmc"), "left").drop("_bmc")
    was_dead = F.coalesce(F.col("state") == F.lit("terminated"), F.lit(False))
    j = j.withColumn("_end", F.when(F.col("_steps").isNotNull(), follow(F.when(was_dead, DEAD).otherwise(LIVE))))
    refused = j.where("_end.refused").select(key, F.lit("live container").alias("error"))
    sets = F.filter("_steps", lambda x: x["any_set"])
    any_set = F.coalesce(F.size(sets) > 0, F.lit(False))
    now = F.when(any_set, F.element_at(sets, -1)["new"]).otherwise(F.col("state"))
    free = F.coalesce(F.exists("_steps", lambda x: x["freed"]), F.lit(False)) | F.coalesce(now == F.lit("terminated"), F.lit(False))
    out = (j.where(F.coalesce(F.col("_end.at") != GONE, F.lit(True))).withColumn("_now", now)
           .withColumn("node_id", F.when(~free, F.col("node_id"))).withColumn("state", F.col("_now")))
    return out.select(*containers.columns), refused


def append_log(log_rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """M8: append rows to the audit log table."""
    log_rows.write.mode("append").format(fmt).save(path)
