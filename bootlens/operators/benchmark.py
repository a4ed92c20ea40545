"""Benchmark reduction: A3 (mean GFLOPS per target and SMT), W4 (first of
group, used to pick one hardware thread per core)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from bootlens.operators.windows import first_of_group


def mean_by_group(runs: DataFrame, keys: Sequence[str], value: str = "gflops", count_as: str = "n",
                  digits: int | None = 6) -> DataFrame:
    """Mean of ``value`` per group (partial aggregation)."""
    mean = F.avg(value)
    if digits is not None:
        mean = F.round(mean, digits)
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_as), mean.alias("mean_gflops"))


def mean_gflops(results: DataFrame, keys: Sequence[str] = ("bench", "target", "smt")) -> DataFrame:
    """A3: mean GFLOPS per (target, smt) over all sizes and repeats; every
    GFLOPS line counts, a non-number as 0.  No lines, no group."""
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.avg("gflops").alias("mean_gflops"))


def mean_gflops_from_lines(lines: DataFrame, keys: Sequence[str] = ("bench", "target", "smt")) -> DataFrame:
    """A3 straight from result lines: GFLOPS values are summed per file
    first (one partial row per file and task crosses the shuffle), the file
    name is parsed once per file, then files are combined per (target, smt)."""
    from bootlens.sources.files import gflops_lines, result_name_fields

    per_file = gflops_lines(lines).groupBy("file_name").agg(F.sum("gflops").alias("_s"), F.count(F.lit(1)).alias("_n"))
    named = result_name_fields(per_file)
    return (named.groupBy(*keys).agg(F.sum("_n").alias("n_lines"), F.sum("_s").alias("_s"))
            .select(*keys, "n_lines", (F.col("_s") / F.col("n_lines")).alias("mean_gflops")))


def smt_off_cpus(cpus: DataFrame) -> DataFrame:
    """W4 (``off``): per (host, core) the first cpu stays online (1), the
    other hardware threads go offline (0)."""
    return first_of_group(cpus, ["host", "core"], ["cpu"], out="online")
