"""Keyed state with event-time timers: rows of a key answered in the order of their own times.

Several stream operators ask for the first answer after a start: the first
notice after a run (T1), the next mark after a begin (T5), the first state that
ends a wait (T2).  A stream-stream join makes every start x answer pair inside
the bound before it can pick the first.  Here a key's state holds

* the rows whose time the watermark has not passed yet (an earlier one may still
  arrive), and
* the starts that wait: those after the last answer.

When the watermark moves on, the rows it has passed are final and are gone
through once in (time, prio, seq) order.  An answer settles every waiting start
at once and empties the list, so a start is settled by one row and leaves one
row: nothing is multiplied, and state rows are linear in the input.  A start
whose deadline the watermark passes is settled by its timer.  State, timer and
output of a micro-batch are committed together, so each start is answered
exactly once.

A key may hold a third of all rows.  Its starts are dealt out to ``parts`` by a
hash of their sequence number, and, where an answer needs nothing from before
the bound, to slices of time.  Answers go to every part and to the one or two
slices whose starts they can still reach.  Each (key, part, slice) is gone
through on its own.

There may be millions of these.  A call of Python and a timer for each would cost
far more than its few rows, so they are kept in ``BUCKETS`` states by a hash of
(key, part, slice): a call works off a bucket's rows together, and its state is
their table in Arrow's format.  The number is part of a stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Kinds of a row: it waits, it answers, or both; OTHERS changes what a later start finds.
START, ANSWER, BOTH, OTHER = 0, 1, 2, 3
PARTS = 4
#: How many states a stream has.
BUCKETS = 1024
#: Stands for a row without a sequence number, which comes first among rows of its time.
NO_SEQ = -(1 << 63)
_ROW = [("part", pa.int32()), ("slice", pa.int64()), ("at", pa.int64()), ("prio", pa.int32()), ("seq", pa.int64()), ("kind", pa.int32()), ("value", pa.string())]


def bucket_of(*cols: str) -> Column:
    """The state in which the rows of these values are kept."""
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int").alias("bucket")


def packed(table: pa.Table) -> bytes:
    """A table as a column of a state (Arrow's stream format, compressed)."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(blob)).read_all()


def first_answer(rows: DataFrame, keys: Sequence[str], bound_seconds: float, parts: int = PARTS, slices: bool = True,
                 settles: Sequence[str] | None = None, no_state: bool = False) -> DataFrame:
    """(keys, seq, ts, found, answer_seq, answer_ts, answer) per start, once it is settled.

    ``rows`` (a watermarked stream): keys, ts, prio (order among rows of one
    time, before seq), seq, kind, value.  A start is settled by the first
    answer at or after it in (ts, prio, seq); it is ``found`` if it comes before
    ts + bound.  With ``settles`` values are states: an answer counts only if
    its value is one of these, and a start finds the state that holds at its
    time (``no_state``: having none settles it too, with a NULL answer)."""
    bound = int(round(bound_seconds * 1e6))
    keys = list(keys)
    span = 8 * bound
    at = F.unix_micros("ts")
    own_part = F.pmod(F.xxhash64("seq"), F.lit(parts)).cast("int")
    # a row's copies: (part, slice, kind); a start lies in one part and slice, what answers in all it can reach
    is_start, answers = F.col("kind").isin(START, BOTH), F.col("kind") != START
    dealt = rows.withColumn("at", at).withColumn("own", own_part)
    dealt = dealt.withColumn("part", F.explode(F.when(answers, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array("own"))))
    if slices:
        now, then = F.floor(F.col("at") / span), F.floor((F.col("at") - bound) / span)
        dealt = dealt.withColumn("slice", F.explode(F.when(answers, F.sequence(then, now)).otherwise(F.array(now))))
        home = (F.col("part") == F.col("own")) & (F.col("slice") == now)
    else:
        dealt = dealt.withColumn("slice", F.lit(0).cast("long"))
        home = F.col("part") == F.col("own")
    kind = F.when(is_start & ~home, ANSWER).otherwise(F.col("kind"))
    dealt = dealt.withColumn("kind", kind)
    settle = None if settles is None else frozenset(settles)
    group = [*(f"k{i}" for i in range(len(keys))), "part", "slice"]
    row_schema = pa.schema([*((c, pa.string()) for c in group[:-2]), *_ROW])
    known_schema = pa.schema([*(row_schema.field(c) for c in group), ("last", pa.string())])

    def fold(key, batches, state) -> Iterator[pd.DataFrame]:
        tables, known = [row_schema.empty_table()], {}
        if state.exists:
            held, states = (unpacked(x) for x in state.get)
            tables.append(held)
            known = {tuple(g): last for *g, last in zip(*(c.to_pylist() for c in states.columns))}
        tables += [pa.Table.from_pandas(b[row_schema.names], schema=row_schema, preserve_index=False) for b in batches]
        passed = state.getCurrentWatermarkMs() * 1000
        rows = pa.concat_tables(tables)
        final = pc.less_equal(rows["at"], passed)
        rest, due = rows.filter(pc.invert(final)), rows.filter(final)
        number = due.select(group).to_pandas().groupby(group, dropna=False, sort=False).ngroup().to_numpy() if due.num_rows else np.empty(0, "int64")
        order = np.lexsort((due["seq"].to_numpy(), due["prio"].to_numpy(), due["at"].to_numpy(), number))
        due, number = due.take(order), number[order]
        at, seq, value = (due[c].to_pylist() for c in ("at", "seq", "value"))
        out, kept, waiting = [], [], []   # out: (row of the start, found, answer's seq, at, value)
        own, last, seen = None, None, False

        def close():
            out.extend((w, False, NO_SEQ, 0, None) for w in waiting if at[w] + bound <= passed)
            kept.extend(w for w in waiting if at[w] + bound > passed)
            if seen:
                known[own] = last

        groups = list(zip(*(due[c].to_pylist() for c in group))) if settle is not None else None
        before = None
        for i, (g, what) in enumerate(zip(number.tolist(), due["kind"].to_pylist())):
            if g != before:
                close()
                before, waiting = g, []
                if settle is not None:
                    own = groups[i]
                    seen = own in known
                    last = known.get(own)
            if what in (ANSWER, BOTH, OTHER):
                if settle is not None:
                    last, seen = value[i], True
                if settle is None or last in settle or (last is None and no_state):
                    out.extend((w, True, seq[i], at[i], value[i]) if at[i] < at[w] + bound else (w, False, NO_SEQ, 0, None) for w in waiting)
                    waiting = []
            if what in (START, BOTH):
                if settle is not None and ((no_state and not seen) or (seen and (last in settle or last is None and no_state))):
                    out.append((i, True, NO_SEQ, at[i], last))   # settled by the state it finds
                else:
                    waiting.append(i)
        close()
        # the next time that something can be settled, in whole milliseconds past the watermark
        wake = min([at[w] + bound for w in kept] + ([pc.min(rest["at"]).as_py()] if rest.num_rows else []), default=None)
        held = pa.concat_tables([due.take(np.array(kept, "int64")), rest])
        if held.num_rows or known:
            states = pa.Table.from_pylist([dict(zip(known_schema.names, (*g, x))) for g, x in known.items()], schema=known_schema)
            state.update((packed(held), packed(states)))
        elif state.exists:
            state.remove()
        if wake is not None:
            state.setTimeoutTimestamp(max(-(-wake // 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            start, found, answer_seq, answer_at, answer = zip(*out)
            of = due.take(np.array(start, "int64"))
            yield pd.DataFrame({**{c: of[c].to_pandas() for c in group[:-2]}, "seq": of["seq"].to_numpy(), "at": of["at"].to_numpy(), "found": found,
                                "answer_seq": answer_seq, "answer_at": answer_at, "answer": pd.Series(answer, dtype="object")})

    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = ", ".join([*(f"{c} string" for c in group[:-2]), "seq long, at long, found boolean, answer_seq long, answer_at long, answer string"])
    seq_of = lambda c, when: F.when(when & (F.col(c) != F.lit(NO_SEQ)), F.col(c))
    return (dealt.select(bucket_of(*keys, "part", "slice"), *(F.col(k).cast("string").alias(c) for k, c in zip(keys, group)), "part", "slice", "ts", "at", F.col("prio").cast("int").alias("prio"),
                         F.coalesce(F.col("seq").cast("long"), F.lit(NO_SEQ)).alias("seq"), F.col("kind").cast("int").alias("kind"), F.col("value").cast("string").alias("value"))
            .groupBy("bucket").applyInPandasWithState(fold, schema, "held binary, known binary", "append", "EventTimeTimeout")
            .select(*(F.col(c).cast(types[k]).alias(k) for k, c in zip(keys, group)), seq_of("seq", F.lit(True)).alias("seq"), F.timestamp_micros("at").alias("ts"), "found",
                    seq_of("answer_seq", F.col("found")).alias("answer_seq"), F.when(F.col("found"), F.timestamp_micros("answer_at")).alias("answer_ts"), "answer"))
