"""First/last per key: W4, W5, W6, W7, P7, O4.

All of these are ``min_by``/``max_by`` aggregations: Spark aggregates each
task's rows before the shuffle, so a key with a third of all rows sends one
partial row per task, never the rows themselves.  Where a per-row flag is
wanted the per-key result is joined back (AQE splits a skewed join side).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F


def _order(order: Sequence[str]):
    return F.struct(*[F.col(o) for o in order])


def first_of_group(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "first_flag",
                   mode: str = "off") -> DataFrame:
    """1 on the first row of each group in ``order``, 0 on the others.

    ``mode='on'`` gives 1 on every row (the reference's "on" setting)."""
    if mode == "on":
        return df.withColumn(out, F.lit(1))
    group = list(group)
    firsts = df.groupBy(*group).agg(F.min(_order(order)).alias("_first"))
    return (df.join(firsts, group, "left")
            .withColumn(out, (_order(order) == F.col("_first")).cast("int"))
            .drop("_first"))


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key holding ``values`` of its last row in ``order``."""
    last = F.max_by(F.struct(*values), _order(order)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, *[F.col(f"_last.{v}").alias(v) for v in values])


def first_use(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str],
              count_as: str | None = "n_uses") -> DataFrame:
    """Only the first use of a token counts; one row per key with the
    first use's ``values`` (and how often the key was used)."""
    aggs = [F.min_by(F.struct(*values), _order(order)).alias("_first")]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    out = df.groupBy(*key).agg(*aggs)
    return out.select(*key, *[F.col(f"_first.{v}").alias(v) for v in values], *([count_as] if count_as else []))


def first_match(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """P7 / O4 (first line): the first matching row per key."""
    return first_use(df, key, order, values, count_as=None)


def last_line(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """O4 (last line)."""
    return last_wins(df, key, order, values)
