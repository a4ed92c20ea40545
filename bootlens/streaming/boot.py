"""The boot-time checks as Structured Streaming queries.

Each stream operator is held to the result of its batch form (tests run
both on the same input with ``trigger(availableNow=True)``).  Event time
columns must be ``timestamp`` (``withWatermark`` refuses TIMESTAMP_NTZ), so
inputs are cast with the session time zone (UTC).

Late data: a notice after the deadline is never read by the reference.
Here a run is closed (and its outcome emitted, once) when the watermark
passes its deadline; a notice that arrives after that is behind the
watermark and dropped (``tests/test_streams.py::test_late_notice_is_ignored``).
A notice delivered late but before its run is closed still counts, since its
own time decides.  The newest runs of a finite input stay open until later
rows move the watermark (tests end their input with a late row on each
side).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bootlens.operators.requests import identify_caller
from bootlens.streaming.inorder import ANSWER, BOTH, OTHER, PARTS, START, bucket_of, first_answer, packed, unpacked

#: Stands for a request without a sequence number, which comes last among those of its time.
_LAST_SEQ = (1 << 63) - 1


def as_event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


def boot_outcome_stream(runs: DataFrame, notices: DataFrame, keys: Sequence[str] = ("bmc_id",),
                        timeout: float = 180.0, watermark: str = "10 minutes", parts: int = PARTS) -> DataFrame:
    """J18 on streams: run starts (keys, ts, seq) against notices (keys,
    ts, seq, status); first notice within ``timeout`` seconds wins.  Keyed
    state answers the runs in the order of their times (see ``inorder``): no
    run x notice pairs, a hot key in ``parts``."""
    none = F.lit(None).cast("string")
    rows = (runs.withWatermark("ts", watermark).select(*keys, "ts", F.lit(0).alias("prio"), F.col("seq").cast("long").alias("seq"), F.lit(START).alias("kind"), none.alias("value"))
            .unionByName(notices.withWatermark("ts", watermark).select(
                *keys, "ts", F.lit(1).alias("prio"), F.col("seq").cast("long").alias("seq"), F.lit(ANSWER).alias("kind"), F.col("status").cast("string").alias("value"))))
    f = first_answer(rows, keys, timeout, parts)
    got = F.col("found")
    outcome = (F.when(~got, F.lit("timed out")).when(F.col("answer") == "ok", F.lit("ok"))
               .otherwise(F.concat(F.lit("boot failure: "), F.col("answer"))))
    wait = (F.unix_micros("answer_ts") - F.unix_micros("ts")).cast("double") / F.lit(1e6)
    return f.select(*keys, F.col("seq").alias("run_seq"), outcome.alias("outcome"),
                    F.col("answer_seq").alias("notice_seq"), F.when(got, wait).alias("wait_sec"))


def state_stream(events: DataFrame, key: str = "bmc_id", order: Sequence[str] = ("ts", "seq"),
                 state: str = "state") -> DataFrame:
    """Current state per container (W6), kept by a streaming
    aggregation; run it in ``update`` or ``complete`` mode."""
    o = F.struct(*[F.col(c) for c in order])
    return events.groupBy(key).agg(F.max_by(state, o).alias(state), F.max(o).alias("_last")).select(
        key, state, *[F.col(f"_last.{c}").alias(f"last_{c}") for c in order])


# The states that end waiting for boot (pending = go on).
WAIT_OK, WAIT_FAIL = ("pending",), ("shutting-down", "terminated")


def wait_verdict(state: Column) -> Column:
    """Waiting ends on ``pending``; fails on shutting-down, terminated
    or no state; other states keep waiting."""
    return (F.when(state.isin(*WAIT_OK), F.lit("go"))
            .when(state.isNull() | state.isin(*WAIT_FAIL), F.lit("fail"))
            .otherwise(F.lit("wait")))


def wait_stream(requests: DataFrame, states: DataFrame, keys: Sequence[str] = ("bmc_id",), timeout: float = 180.0,
                watermark: str = "10 minutes", parts: int = PARTS) -> DataFrame:
    """T2 as a wait with a deadline: requests (keys, ts, seq) that wait until
    the state of their container lets them go on; (keys, seq, ts, verdict,
    state, state_ts, wait_sec), exactly one row a request.

    The state that holds at the request's time (a state of that very time
    included) decides at once if it is ``pending`` (go), a dead one, or none at
    all (fail); otherwise the first such state before ts + ``timeout`` does,
    and ``timed out`` is the verdict when there is none."""
    none = F.lit(None).cast("string")
    rows = (states.withWatermark("ts", watermark).select(*keys, "ts", F.lit(0).alias("prio"), F.col("seq").cast("long").alias("seq"), F.lit(OTHER).alias("kind"),
                                                         F.col("state").cast("string").alias("value"))
            .unionByName(requests.withWatermark("ts", watermark).select(*keys, "ts", F.lit(1).alias("prio"), F.col("seq").cast("long").alias("seq"),
                                                                        F.lit(START).alias("kind"), none.alias("value"))))
    f = first_answer(rows, keys, timeout, parts, slices=False, settles=(*WAIT_OK, *WAIT_FAIL), no_state=True)
    verdict = F.when(F.col("found"), wait_verdict(F.col("answer"))).otherwise(F.lit("timed out"))
    wait = (F.unix_micros("answer_ts") - F.unix_micros("ts")).cast("double") / F.lit(1e6)
    return f.select(*keys, "seq", "ts", verdict.alias("verdict"), F.col("answer").alias("state"), F.when(F.col("found"), wait).alias("wait_sec"))


def enrich_requests(requests: DataFrame, nodes: DataFrame, containers: DataFrame, **kw) -> DataFrame:
    """Boot requests (a stream) resolved against node and container
    tables that stand still: a stream-static left join, J13's rule.  For a
    catalog that changes while the stream runs see ``run_with_catalog``."""
    return identify_caller(requests, nodes, containers, **kw)


def run_with_catalog(requests: DataFrame, resolve: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """T3 with a catalog that changes: every micro-batch of ``requests`` is
    resolved by ``resolve(rows)``, which reads the catalog anew, so a
    container made a minute ago is seen.  With ``catalog_history`` and
    ``identify_caller_at`` inside, a request is answered as of its own time,
    however late it arrives.

    Runs everything available now; the rows of micro-batch n replace those of
    an earlier attempt at it.  Called again with the same ``folder`` the stream
    goes on where it ended.  Returns all rows so far, with ``batch``."""
    out = f"{folder}/rows"

    def write(rows: DataFrame, n: int) -> None:
        resolve(rows).write.mode("overwrite").parquet(f"{out}/batch={n}")

    run = requests.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write)
    run.start().awaitTermination()
    return requests.sparkSession.read.option("mergeSchema", True).parquet(out)


def first_use_stream(requests: DataFrame, hashes: DataFrame, session: str = "session_id", nonce: str = "nonce",
                     ts: str = "ts", seq: str = "seq", watermark: str = "10 minutes") -> DataFrame:
    """T4: one-time sessions on a stream: (session, ts, seq) of the one
    request of each session that passes.

    J15's test comes first: a known session, not expired at the request's own
    time (no expiry counts as expired), and its nonce.  Of the requests that
    pass it the earliest (ts, seq) of the micro-batch in which a session is
    first used is accepted; every later one is refused.  That a session is
    used is kept until it expires: only when the watermark has passed
    ``session_good_for`` is it dropped, and from then on its requests are
    expired.  Used sessions are kept in ``inorder.BUCKETS`` states, so a call
    of Python serves many of them."""
    h = hashes.select(F.col("session_id").alias("_sid"), "session_good_for", "nonce2")
    valid = (requests.withWatermark(ts, watermark).join(h, F.col(session) == F.col("_sid"))
             .where((F.col(ts) <= F.col("session_good_for"))
                    & (F.nullif(F.col(nonce), F.lit("")) == F.nullif(F.col("nonce2"), F.lit(""))))
             .select(F.col(session).alias("session_id"), F.col(ts).alias("ts"), F.col(seq).cast("long").alias("seq"), "session_good_for"))

    us, none = F.unix_micros, F.lit(_LAST_SEQ)
    given = valid.select(bucket_of("session_id"), "session_id", "ts", us("ts").alias("at"), F.coalesce("seq", none).alias("seq"), us("session_good_for").alias("until"))

    def earliest(rows):
        """Per session its first request, with the latest expiry of them all."""
        until = rows.groupby("session_id", sort=False)["until"].max().rename("until")
        first = rows.sort_values(["at", "seq"]).drop_duplicates("session_id")[["session_id", "at", "seq"]]
        return first.merge(until, left_on="session_id", right_index=True)

    def once(key, batches, state):
        import pandas as pd
        import pyarrow as pa

        schema = pa.schema([("session_id", pa.string()), ("until", pa.int64())])
        used, new = unpacked(state.get[0]).to_pandas() if state.exists else schema.empty_table().to_pandas(), None
        for rows in batches:
            first = earliest(rows)
            new = first if new is None else earliest(pd.concat([new, first]))
        if new is not None:
            new = new[~new["session_id"].isin(used["session_id"])]
            used = pd.concat([used, new[["session_id", "until"]]])
        expiry = used["until"] // 1000 + 1
        used = used[expiry > state.getCurrentWatermarkMs()]
        if len(used):
            state.update((packed(pa.Table.from_pandas(used, schema=schema, preserve_index=False)),))
            state.setTimeoutTimestamp(int(used["until"].min() // 1000 + 1))
        elif state.exists:
            state.remove()
        if new is not None and len(new):
            yield new[["session_id", "at", "seq"]]

    first = given.groupBy("bucket").applyInPandasWithState(once, "session_id string, at long, seq long", "used binary", "append", "EventTimeTimeout")
    return first.select("session_id", F.timestamp_micros("at").alias("ts"), F.nullif("seq", none).alias("seq"))


def interval_stream(marks: DataFrame, keys: Sequence[str] = ("bmc_id", "phase"), bound_seconds: float = 3600.0,
                    watermark: str = "10 minutes", parts: int = PARTS) -> DataFrame:
    """T5: phase intervals as marks arrive, by W1's rule: the next mark of the
    same (bmc_id, phase) decides.  An end within ``bound_seconds`` closes the
    begin before it; another begin, or none in time, leaves it open (NULL end)."""
    is_begin = F.col("kind") == F.lit("begin")
    rows = marks.withWatermark("ts", watermark).select(
        *keys, "ts", F.lit(0).alias("prio"), F.col("seq").cast("long").alias("seq"), F.when(is_begin, BOTH).otherwise(ANSWER).alias("kind"), F.col("kind").alias("value"))
    f = first_answer(rows, keys, bound_seconds, parts)
    closed = F.col("found") & (F.col("answer") == F.lit("end"))
    return f.select(*keys, F.col("seq").alias("begin_seq"), F.col("ts").alias("begin_ts"),
                    F.when(closed, F.col("answer_seq")).alias("end_seq"), F.when(closed, F.col("answer_ts")).alias("end_ts"))


def run_to_files(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now into Parquet files under
    ``folder`` (in the shared checkpoint folder) and read them back.

    ``update`` writes each micro-batch's upserts with its number in ``batch``;
    a batch that is repeated after a failure replaces its own files."""
    out = f"{folder}/rows"
    run = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        run = run.format("parquet").option("path", out)
        schema = df.schema
    else:
        run = run.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        schema = df.schema.add("batch", "long")
    run.start().awaitTermination()
    return df.sparkSession.read.schema(schema).parquet(out)
