"""Timeline operators: marks to runs, container ids, intervals and phase times.

Data path: timeline lines (S4/S5) -> ``marks`` (F20) -> ``segment_runs`` (W2)
-> ``fill_bmc_id`` (W8) -> ``pair_marks`` (W1) -> ``phase_times`` (A4).

Every per-key sequence step goes through ``ordered_scan`` (range-partitioned,
so a container or process with a third of all lines is still split over
many tasks); every per-key total is a ``groupBy`` with partial aggregation
joined back on the key (AQE splits a skewed join partition).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bootlens.functions.marks import SCRIPT_PREFIX, START_MARK, bmcid_of, container_id, mark_field, mark_joined, mark_split
from bootlens.operators.sequence import Fill, Lag, ordered_scan
from bootlens.schemas import span_seconds
from bootlens.session import scratch_dir

ORDER = ("epoch_ns", "seq")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def marks(timeline: DataFrame) -> DataFrame:
    """F20 over every valid timeline line.

    Adds prefix, phase, kind (begin/end or NULL), rest, bmc_id and
    ``is_start``.  bmc_id: a mark's ``bmcid=`` (or the first word of
    ``exec_kill1``/``exec_rm1``); a plain fact line (``... bmcid=ID ...``)
    names its container too.  is_start: the ``--Start--`` line of a process
    run, or a web script's own begin mark (``cgi-...:begin`` without
    prefix), since those scripts write no start line and their pids are
    reused.
    """
    tl = timeline.where(F.col("valid")) if "valid" in timeline.columns else timeline
    # a projection each: the rewritten message and its groups are used more than once and made once
    base = tl.select("host", "pid", "epoch_ns", "seq", "message", mark_joined(F.col("message")).alias("_joined"))
    base = base.select("host", "pid", "epoch_ns", "seq", "message", mark_split(F.col("message"), F.col("_joined")).alias("_parts"))
    p = F.col("_parts")
    fields = base.select("host", "pid", "epoch_ns", "seq", "message",
                         mark_field(p, 1).alias("prefix"), mark_field(p, 2).alias("phase"),
                         mark_field(p, 3).alias("kind"), mark_field(p, 4).alias("rest"))
    named = F.coalesce(container_id(F.col("phase"), F.col("kind"), F.col("rest")),
                       F.when(F.col("kind").isNull(), bmcid_of(F.col("message"))))
    script_begin = (F.col("prefix").isNull() & F.col("phase").startswith(SCRIPT_PREFIX)
                    & (F.col("kind") == F.lit("begin")))
    start = (F.col("message") == F.lit(START_MARK)) | F.coalesce(script_begin, F.lit(False))
    return fields.select("*", named.alias("bmc_id"), start.alias("is_start"))


def segment_runs(m: DataFrame, keys: Sequence[str] = ("host", "pid"), start: Column | None = None,
                 partitions: int | None = None) -> DataFrame:
    """Split the lines of a pid into runs.

    A run starts at a ``--Start--`` line (or where ``start`` holds) and holds
    every later line of the same (host, pid) up to the next start.  The run
    is named by the (epoch_ns, seq) of its start line: ``run_epoch_ns``,
    ``run_seq``.  Lines before any start (CGI scripts write none) form one run
    with NULL run fields.
    """
    start = start if start is not None else F.col("is_start")
    out = ordered_scan(m, list(keys), list(ORDER), [Fill(list(ORDER), start, prefix="run_")],
                       partitions=partitions)
    return out


def segment_runs_and_carry(m: DataFrame, keys: Sequence[str] = ("host", "pid"),
                           partitions: int | None = None) -> DataFrame:
    """W2 and the carry of W8 in one ordered scan over (host, pid).

    ``run_epoch_ns``/``run_seq`` as in ``segment_runs``; ``_carry_bmc_id`` is
    the id of the nearest line at or before this one that names an id or
    starts a run (a start line names none, so the carry stops at run
    starts and stays inside the run).  ``_run_note_id``, ``_run_parent_pid``,
    ``_run_id_min`` and ``_run_id_max`` are what ``attach_pid`` and
    ``fill_bmc_id`` need to know of the whole run, so that they join nothing."""
    start = F.col("is_start")
    note = F.col("_note") if "_note" in m.columns else note_fields(F.col("message"))
    return ordered_scan(m, list(keys), list(ORDER),
                        [Fill(list(ORDER), start, prefix="run_", least={"_run_id_min": F.col("bmc_id")},
                              greatest={"_run_id_max": F.col("bmc_id"), "_run_note_id": note["id"], "_run_parent_pid": note["parent"]}),
                         Fill(["bmc_id"], F.col("bmc_id").isNotNull() | start, prefix="_carry_")],
                        partitions=partitions)


def fill_bmc_id(m: DataFrame, keys: Sequence[str] = ("host", "run_epoch_ns", "run_seq", "pid"),
                partitions: int | None = None) -> DataFrame:
    """Give marks of a process the container id the process works on.

    A process run that names one container id (``exec_run`` names it once)
    gives it to all its marks, also those before the naming mark.  A run that
    names several (``kill``/``rm`` of many ids) gives each mark the last id
    named at or before it.  Marks that name an id keep it.  When ``m``
    already holds ``_carry_bmc_id`` (``segment_runs_and_carry``) no second
    scan is run, and the ids of a run are ``_run_id_min`` and ``_run_id_max``.
    (Those are of the marks' own ids: in a run with a note ``attach_pid`` gave
    every mark an id, so they are not asked there.)
    """
    keys = list(keys)
    carried = m if "_carry_bmc_id" in m.columns else ordered_scan(
        m, keys, list(ORDER), [Fill(["bmc_id"], F.col("bmc_id").isNotNull(), prefix="_carry_")], partitions=partitions)
    if "_run_id_min" not in m.columns:
        stats = (m.groupBy(*keys)
                 .agg(F.min("bmc_id").alias("_run_id_min"), F.max("bmc_id").alias("_run_id_max")))
        carried = _null_safe_join(carried, stats, keys)
    single = F.col("_run_id_min") == F.col("_run_id_max")
    return (carried
            .withColumn("bmc_id", F.coalesce(F.col("bmc_id"), F.when(single, F.col("_run_id_min")), F.col("_carry_bmc_id")))
            .drop("_run_id_min", "_run_id_max", "_carry_bmc_id"))


def pair_marks(m: DataFrame, keys: Sequence[str] = ("bmc_id",), phase: str = "phase", kind: str = "kind",
               order: Sequence[str] = ORDER, carry: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Pair begin and end marks into intervals.

    Per (keys, phase) the marks are taken in (epoch_ns, seq) order; a begin is
    closed by the very next mark when that mark is an end.  Begins followed by
    another begin, or by nothing (a failed process writes no end), are kept
    as open intervals with NULL end.  Ends without a begin are dropped.
    ``carry`` columns are taken from the begin mark, so only begins bring them.
    """
    keys, order = list(keys), list(order)
    needed = list(dict.fromkeys([*keys, phase, kind, *order]))
    be = (m.where(F.col(kind).isin("begin", "end") & F.col(phase).isNotNull())
          .select(*needed, *[F.when(F.col(kind) == "begin", F.col(c)).alias(c) for c in dict.fromkeys(carry) if c not in needed]))
    nxt = ordered_scan(be, [*keys, phase], order, [Lag([kind, *order], prefix="_next_")], descending=True,
                       partitions=partitions)
    closed = F.col(f"_next_{kind}") == F.lit("end")
    ep, sq = order[0], order[-1]
    return (nxt.where(F.col(kind) == "begin")
            .select(*keys, phase, *carry,
                    F.col(ep).alias("begin_ns"), F.col(sq).alias("begin_seq"),
                    F.when(closed, F.col(f"_next_{ep}")).alias("end_ns"),
                    F.when(closed, F.col(f"_next_{sq}")).alias("end_seq"))
            .withColumn("duration_ns", F.col("end_ns") - F.col("begin_ns")))


def phase_times(intervals: DataFrame, keys: Sequence[str] = ("bmc_id", "phase")) -> DataFrame:
    """A4: time per phase: closed and open interval counts, total and mean
    seconds of the closed ones."""
    return (intervals.groupBy(*keys)
            .agg(F.count("end_ns").alias("n_closed"),
                 (F.count(F.lit(1)) - F.count("end_ns")).alias("n_open"),
                 F.sum("duration_ns").alias("_total_ns"))
            .withColumn("total_sec", span_seconds(F.col("_total_ns"))).drop("_total_ns")
            .withColumn("avg_sec", F.try_divide(F.col("total_sec"), F.col("n_closed"))))


def relative_time(df: DataFrame, key: str = "bmc_id", epoch: str = "epoch_ns", out: str = "rel_sec") -> DataFrame:
    """Seconds since the first mark of the same key.

    The first mark is a partial ``min`` per key joined back (no window over a
    whole key)."""
    first = df.groupBy(key).agg(F.min(epoch).alias("_first"))
    return (df.join(first, key, "left")
            .withColumn(out, span_seconds(F.col(epoch) - F.col("_first")))
            .drop("_first"))


# Fixed pattern of the note a background child process writes first.
NOTE_PATTERN = r"^exec_pull: (.*)$"


def note_fields(message: Column) -> Column:
    """Struct (id, parent) of a child's note; NULL when the message is not one."""
    note = F.regexp_extract(message, NOTE_PATTERN, 1)
    return F.when(message.rlike(NOTE_PATTERN), F.struct(
        F.nullif(F.regexp_extract(note, r"bmcid=(\S+)", 1), F.lit("")).alias("id"),
        F.nullif(F.regexp_extract(note, r"parent=(\d+)", 1), F.lit("")).try_cast("long").alias("parent")))


def telling_lines(m: DataFrame) -> DataFrame:
    """The lines of ``marks`` that intervals depend on, without their texts, written once.

    Kept are starts, begin and end marks, lines that name a container and
    children's notes (``_note``, as ``note_fields``); any other line neither
    opens nor closes anything and names nothing.  Lines are chosen from the
    written rows: a filter on top of the parsing would be pushed below it and
    parse every line twice, and so would the sample that finds range bounds."""
    noted = m.select("host", "pid", "epoch_ns", "seq", "phase", "kind", "bmc_id", "is_start", note_fields(F.col("message")).alias("_note"))
    path = scratch_dir(m.sparkSession, "telling-lines")
    noted.write.parquet(path)
    rows = m.sparkSession.read.schema(noted.schema).parquet(path)
    return rows.where(F.col("is_start") | F.col("kind").isNotNull() | F.col("bmc_id").isNotNull() | F.col("_note").isNotNull())


def attach_pid(m: DataFrame, keys: Sequence[str] = ("host", "run_epoch_ns", "run_seq")) -> DataFrame:
    """A background child (``pull --note=bmcid=ID --note=parent=PID``)
    logs ``exec_pull: bmcid=ID parent=PID``; every mark of that child's run
    gets the container id, and ``parent_pid`` names the process that started
    it.  Notes (of the messages, or ``_note`` where they are read already) are
    reduced per (keys, pid) and joined back, unless the scan has brought them
    (``segment_runs_and_carry``); marks keep an id they already have."""
    if "_run_note_id" in m.columns:
        return (m.drop("_note").withColumn("bmc_id", F.coalesce("bmc_id", "_run_note_id")).drop("_run_note_id")
                .withColumnRenamed("_run_parent_pid", "parent_pid"))
    keys = list(keys)
    notes = m.select(*keys, "pid", F.col("_note") if "_note" in m.columns else note_fields(F.col("message")).alias("_note"))
    noted = (notes.where(F.col("_note").isNotNull())
             .groupBy(*keys, "pid").agg(F.max("_note.id").alias("_note_id"), F.max("_note.parent").alias("parent_pid")))
    joined = _null_safe_join(m.drop("_note"), noted, [*keys, "pid"])
    return joined.withColumn("bmc_id", F.coalesce("bmc_id", "_note_id")).drop("_note_id")


def intervals_from_timeline(timeline: DataFrame, partitions: int | None = None) -> DataFrame:
    """S4 -> F20 -> W2 -> J19 -> W8 -> W1: intervals per (bmc_id, phase).

    Marks without any container id pair on (host, run, pid, phase) instead.
    The log is read and parsed once; only the narrow rows of telling lines are
    ordered."""
    m = telling_lines(marks(timeline))
    m = segment_runs_and_carry(m, partitions=partitions)
    m = attach_pid(m)
    m = fill_bmc_id(m, partitions=partitions)
    # one pairing scan: by container id, or by process run when there is none
    proc = F.concat_ws("/", F.lit("proc"), F.col("host"), F.col("run_epoch_ns").cast("string"),
                       F.col("run_seq").cast("string"), F.col("pid").cast("string"))
    m = m.withColumn("_proc", F.when(F.col("bmc_id").isNull(), proc))
    own = ["host", "run_epoch_ns", "run_seq", "pid"]
    iv = pair_marks(m, ["bmc_id", "_proc"], carry=own, partitions=partitions)
    return iv.select("phase", "bmc_id", *own, *[c for c in iv.columns if c not in ("phase", "bmc_id", "_proc", *own)])
