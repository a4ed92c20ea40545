"""Metering: samples inside phases (J17), energy (A5), network volume
and the per-request report (A8).

Spark has no range join, and interval x sample pairs are not needed: what is
asked of the samples inside an interval are counts and sums, and these are
differences of running sums.  ``sums_in`` puts samples and interval ends in
one order per key and takes the running sums at both ends by one
``ordered_scan``: n samples and m intervals are n + 2 m rows, however long the
intervals are and however they overlap, and a hot key spans many tasks.  Sums
run in decimals, so their differences are exact.

Edges are not interpolated: energy is the trapezoid sum over consecutive
samples that both lie inside the interval.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from bootlens.operators.sequence import Count, Fill, Lag, ordered_scan
from bootlens.schemas import ns_lit, span_seconds

INTERVAL_COLS = ("phase", "begin_ns", "begin_seq", "end_ns")
#: Type of what is summed: 16 digits before and 12 after the point.
SUMMED = "decimal(28,12)"


def sums_in(intervals: DataFrame, samples: DataFrame, sums: Sequence[str], last: Sequence[str] = (),
            keys: Sequence[str] = ("bmc_id",), ts: str = "epoch_ns", seq: str = "seq",
            partitions: int | None = None) -> DataFrame:
    """Per closed interval with samples of its key at begin <= ts <= end
    their number ``n_samples``, the sums of the ``sums`` columns (exact
    decimals) and the values of the ``last`` columns on the last of them.

    Open intervals (NULL end) and intervals without samples give no row."""
    keys, sums, last = list(keys), list(sums), list(last)
    s = samples.where(F.col(ts).isNotNull()).select(
        *keys, F.col(ts).alias("_at"), F.lit(1).alias("_side"), F.col(seq).cast("long").alias("_s"),
        F.lit(None).cast(intervals.schema["phase"].dataType).alias("phase"),
        *[F.lit(None).cast("long").alias(c) for c in INTERVAL_COLS[1:]],
        *[F.col(c).try_cast(SUMMED).alias(f"_v{i}") for i, c in enumerate(sums)],
        *[F.col(c).alias(f"_w{i}") for i, c in enumerate(last)])
    ends = F.explode(F.array(F.struct(F.col("begin_ns").alias("at"), F.lit(0).alias("side")),
                             F.struct(F.col("end_ns").alias("at"), F.lit(2).alias("side"))))
    e = (intervals.where(F.col("begin_ns").isNotNull() & (F.col("end_ns") >= F.col("begin_ns")))
         .select(*keys, *INTERVAL_COLS, ends.alias("_e")).select(
             *keys, F.col("_e.at").alias("_at"), F.col("_e.side").alias("_side"), F.col("begin_seq").cast("long").alias("_s"),
             *INTERVAL_COLS, *[F.lit(None).cast(SUMMED).alias(f"_v{i}") for i in range(len(sums))],
             *[F.lit(None).cast(samples.schema[c].dataType).alias(f"_w{i}") for i, c in enumerate(last)]))
    is_sample = F.col("_side") == F.lit(1)
    ops = [Count("_n", is_sample), *[Count(f"_t{i}", is_sample, F.col(f"_v{i}")) for i in range(len(sums))]]
    if last:
        ops.append(Fill([f"_w{i}" for i in range(len(last))], is_sample, prefix="_f"))
    at_end = ordered_scan(s.unionByName(e), keys, ["_at", "_side", "_s"], ops, partitions=partitions).where(~is_sample)
    inside = lambda c: F.sum(F.when(F.col("_side") == 2, F.col(c)).otherwise(-F.col(c)))
    out = at_end.groupBy(*keys, *INTERVAL_COLS).agg(
        inside("_n").alias("n_samples"), *[inside(f"_t{i}").alias(c) for i, c in enumerate(sums)],
        *[F.max(F.when(F.col("_side") == 2, F.col(f"_f_w{i}"))).alias(c) for i, c in enumerate(last)])
    return out.where(F.col("n_samples") > 0)


def prepare_samples(samples: DataFrame, keys: Sequence[str] = ("bmc_id",), ts: str = "epoch_ns",
                    seq: str = "seq", value: str = "value", delay: float = 0.0,
                    floor: float | None = None, partitions: int | None = None) -> DataFrame:
    """Drop samples below ``floor`` (min power threshold), shift sample time
    back by ``delay`` seconds (meter delay) and add the next sample of the
    same source (``next_epoch_ns``, ``next_value``)."""
    s = samples
    if floor is not None:
        s = s.where(F.col(value) >= F.lit(floor))
    if delay:
        s = s.withColumn(ts, F.col(ts) - ns_lit(delay))
    return ordered_scan(s, list(keys), [ts, seq], [Lag([ts, value], prefix="next_")], descending=True, partitions=partitions)


def phase_energy(intervals: DataFrame, samples: DataFrame, keys: Sequence[str] = ("bmc_id",),
                 delay: float = 4.0, floor: float | None = 1.0, partitions: int | None = None) -> DataFrame:
    """A5: energy (joule) and mean power (watt) per closed interval.

    joule = sum over consecutive inside samples of (v0 + v1) / 2 * (t1 - t0);
    watt = joule / interval seconds (NULL for a zero-length interval).
    Intervals without samples give no row.

    Each sample carries the energy up to the next one; an interval's is the
    sum over its samples without that of its last one, which leads outside.
    """
    keys = list(keys)
    s = prepare_samples(samples.select(*keys, "epoch_ns", "seq", "value"), keys, delay=delay, floor=floor, partitions=partitions)
    ahead = (F.col("value") + F.col("next_value")) / F.lit(2.0) * span_seconds(F.col("next_epoch_ns") - F.col("epoch_ns"))
    s = s.withColumn("ahead", ahead.try_cast(SUMMED)).withColumn("outside", F.col("ahead"))
    m = sums_in(intervals, s, ["ahead"], ["outside"], keys, partitions=partitions)
    joule = (F.col("ahead") - F.coalesce("outside", F.lit(0))).cast("double")
    seconds = span_seconds(F.col("end_ns") - F.col("begin_ns"))
    return m.select(*keys, "phase", "begin_ns", "begin_seq", seconds.alias("seconds"), "n_samples",
                    F.round(joule, 6).alias("joule"), F.round(F.try_divide(joule, seconds), 6).alias("watt"))


def phase_net(intervals: DataFrame, samples: DataFrame, keys: Sequence[str] = ("bmc_id",),
              partitions: int | None = None) -> DataFrame:
    """Network volume per closed interval: sample count and sum."""
    m = sums_in(intervals, samples, ["value"], (), keys, partitions=partitions)
    return m.select(*keys, "phase", "begin_ns", "begin_seq", "n_samples", F.round(F.col("value").cast("double"), 6).alias("volume"))


def phase_report(requests: DataFrame, intervals: DataFrame, samples: DataFrame,
                 keys: Sequence[str] = ("bmc_id",), report: str = "report", delay: float = 4.0,
                 floor: float | None = 1.0, partitions: int | None = None) -> DataFrame:
    """Reports asked for by (keys, report in {time, pwr}, phase).

    Every closed interval of an asked-for phase gives one row per report:
    seconds for ``time``; seconds, joule and watt for ``pwr`` (NULL when no
    sample fell inside).  Energy is computed only for the (container, phase)
    pairs of ``pwr`` requests, from those containers' samples.
    """
    keys = list(keys)
    wanted = requests.select(*keys, "phase", report).distinct()      # a request asked twice is one
    asked = intervals.where(F.col("end_ns").isNotNull()).join(wanted, [*keys, "phase"])
    pwr = wanted.where(F.col(report) == F.lit("pwr"))
    metered = samples.join(pwr.select(*keys).distinct(), keys, "left_semi")
    energy = phase_energy(asked.where(F.col(report) == F.lit("pwr")), metered, keys, delay=delay, floor=floor, partitions=partitions)
    at = [*keys, "phase", "begin_ns", "begin_seq"]
    out = asked.join(energy.select(*at, F.lit("pwr").alias(report), "joule", "watt"), [*at, report], "left")
    return out.select(*keys, "phase", report, "begin_seq", span_seconds(F.col("end_ns") - F.col("begin_ns")).alias("seconds"),
                      "joule", "watt")
