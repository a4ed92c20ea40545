"""Mixing sources to target weights (operator 4).

Each source gets a target number of words.  As many complete epochs over the
source as fit come first.  What remains of the target is filled by
Efraimidis-Spirakis sampling: every document draws the exponential key
``-ln(u) / weight`` with u from a hash of its id, keys are sorted within the
source, sizes are prefix-summed, and documents are taken while the sum stays
within the budget.  The first that does not fit may be very long, so the draw
goes on behind it: among documents of at most half the gap that is left, again
in order of their keys, until one does not fit.  Each such round more than
halves the gap or runs out of documents, so few are needed until the gap is a
thousandth of the target.  Last comes one more document, the one whose size is
nearest to the gap, if that brings the source nearer.

The outcome per source is one row: the number of epochs, and per round the
stretch of keys and the largest size taken; documents are matched to it by
source alone, so no text is shuffled for the decision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bootlens.llm.common import fresh, prefix_sums, staged, word_count

#: Production settings: weights by rank of the source, total share, most times a document is taken.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Rounds go on while the gap is larger than this share of the target.
NEAR = 0.001


def key(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    """Exponential key of a document; u is 52 bits of the MD5 of seed and id, centred, so never 0 or 1."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    u = (bits.cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / weight


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn.  ``share`` of
    all sizes is dealt out by weight; a source stops at ``most`` times its
    size and the excess is dealt to the others by weight until none is above.
    The only state of that loop is the words per unit of weight, so each round
    is one aggregate."""
    placed = prefix_sums(sources.select(F.col("source").isNull().alias("_last"), "source", "source_size", F.lit(1).cast("long").alias("_one")), [], ["_last", "source"], "_one", "_rank")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    t = staged(placed.select("source", "source_size", turn.alias("_w"), (F.col("source_size") * float(most)).alias("_cap")), "sources")
    total, weight = t.agg(F.sum("source_size"), F.sum("_w")).first()
    if not total:
        return t.select("source", "source_size", F.lit(0.0).alias("target"))
    goal = share * total
    rate = goal / weight
    while True:
        above = F.col("_cap") < rate * F.col("_w")
        capped, free = t.agg(F.sum(F.when(above, F.col("_cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("_w")))).first()
        raised = (goal - capped) / free if free else rate
        if raised <= rate:
            break
        rate = raised
    return t.select("source", "source_size", F.least("_cap", rate * F.col("_w")).alias("target"))


def _behind(key: Column, size: Column, at_key: Column, at_size: Column) -> Column:
    """Whether (key, size) comes after (at_key, at_size)."""
    return (key > at_key) | ((key == at_key) & (size > at_size))


def _drawn(key: Column, size: Column, rounds: Column) -> Column:
    """Whether a document lies in a stretch that some round took."""
    return F.exists(rounds, lambda r: _behind(key, size, r["low_key"], r["low_size"]) & ~_behind(key, size, r["high_key"], r["high_size"]) & (size <= r["longest"]))


def plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, epochs, rounds, fill) from (source, size, key).

    A document is taken ``epochs`` times, and once more if it lies in one of
    ``rounds`` (behind (low_key, low_size), up to (high_key, high_size), no
    longer than ``longest``) or is ``fill`` (null: none).  Documents of one key
    and size (rows that repeat an id) share their fate."""
    dealt = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    counted = dealt.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    units = staged(sized.groupBy("source", "key", "size").agg((F.count("*") * F.col("size")).alias("total")), "units")
    no_rounds = F.array().cast("array<struct<low_key:double,low_size:long,high_key:double,high_size:long,longest:double>>")
    state = counted.select(F.col("source").alias("_s"), "target", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("gap"), no_rounds.alias("rounds"),
                           F.lit(-1.0).alias("low_key"), F.lit(-1).cast("long").alias("low_size"), F.lit(float("inf")).alias("longest"), F.lit(True).alias("open"))
    while True:
        state = staged(state, "mix-state")   # one row per source
        live = state.where("open")
        if live.isEmpty():
            break
        own = units.join(live, F.col("source").eqNullSafe(F.col("_s"))).where(_behind(F.col("key"), F.col("size"), F.col("low_key"), F.col("low_size")) & (F.col("size") <= F.col("longest")))
        summed = prefix_sums(own.select("source", "key", "size", "total", "gap"), ["source"], ["key", "size"], "total")
        end = F.col("before") + F.col("total")
        at, fits = F.struct("key", "size"), end <= F.col("gap")
        step = summed.groupBy(F.col("source").alias("_of")).agg(F.max(F.when(fits, at)).alias("_high"), F.max(F.when(fits, end)).alias("_filled"), F.min(F.when(~fits, at)).alias("_next"))
        joined = state.join(step, F.col("open") & F.col("_s").eqNullSafe(F.col("_of")), "left")
        gap = F.col("gap") - F.coalesce("_filled", F.lit(0))
        taken = F.struct("low_key", "low_size", F.col("_high.key").alias("high_key"), F.col("_high.size").alias("high_size"), "longest")
        state = joined.select("_s", "target", gap.alias("gap"), F.when(F.col("_high").isNotNull(), F.concat("rounds", F.array(taken))).otherwise(F.col("rounds")).alias("rounds"),
                              F.coalesce("_next.key", "low_key").alias("low_key"), F.coalesce("_next.size", "low_size").alias("low_size"),
                              F.when(F.col("open"), gap / 2).otherwise(F.col("longest")).alias("longest"),
                              (F.col("_next").isNotNull() & (gap > NEAR * F.col("target"))).alias("open"))
    last = state.select("_s", "gap", "rounds")
    rest = (units.join(last, F.col("source").eqNullSafe(F.col("_s")))
            .where(~_drawn(F.col("key"), F.col("size"), F.col("rounds")) & (F.abs(F.col("gap") - F.col("total")) < F.col("gap"))))
    fill = rest.groupBy(F.col("source").alias("_f")).agg(F.min_by(F.struct("key", "size"), F.struct(F.abs(F.col("gap") - F.col("total")), "key", "size")).alias("fill"))
    found = last.join(fill, F.col("_s").eqNullSafe(F.col("_f")), "left").select("_s", "rounds", "fill")
    return staged(counted.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "plan")


def _times(drawn: Column, size: Column, epochs: Column, rounds: Column, fill: Column) -> Column:
    once = _drawn(drawn, size, rounds) | F.coalesce((drawn == fill["key"]) & (size == fill["size"]), F.lit(False))
    return epochs + once.cast("long")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    return rows.select("doc_id", "source", "size", key(F.col("doc_id"), quality(F.col("size"))).alias("key"))


def quality(size: Column) -> Column:
    """Sampling weight of a document: texts of 50 words or more count fully, shorter ones by their share of that."""
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), size / 50.0))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per input row.

    Null and wordless texts have size 0 and are taken 0 words of.  A null
    source is a source of its own, sorted last.  Rows that repeat an id are
    separate rows; those of one size share their fate.  Reruns on any partitioning agree, as keys
    come from ids.  Other columns are ignored."""
    sized = staged(_sized(docs, doc_id, text, source), "sized")
    p = plan(sized).withColumnRenamed("source", "_source")
    taken = F.col("size") * _times(F.col("key"), F.col("size"), F.col("epochs"), F.col("rounds"), F.col("fill"))
    return sized.join(p, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def take(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, columns as they are."""
    p = plan(staged(_sized(docs, doc_id, text, source), "sized")).select("source", "epochs", "rounds", "fill")
    size = word_count(docs[text])
    times = _times(key(docs[doc_id].cast("long"), quality(size)), size, p["epochs"], p["rounds"], p["fill"])
    joined = docs.join(p, docs[source].eqNullSafe(p["source"]))
    copy = fresh(docs, "copy")
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(True), times.cast("int"))).alias(copy)).drop(copy)
