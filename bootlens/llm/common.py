"""Helpers shared by the operators: staged tables, prefix sums, components, files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bootlens.session import scratch_dir

#: Java / SQL patterns of a word and of what separates words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs a re-read of shared files only."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_share(key: Column, wanted: int, total: int) -> Column:
    """True for about ``wanted`` of ``total`` rows, by a hash of ``key`` (unique per row for the bound to hold).

    A filter: unlike a sort with a limit, no task gathers a share of every partition."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.lit(min(1 << 40, -(-(wanted << 40) // max(1, total)))).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


# ------------------------------------------------------------ prefix sums


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "before") -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``keys`` that come earlier in ``order``.

    Rows are cut into ranges of (keys, order), so a hot key spans many tasks.
    Ranges are numbered in the written table; each range's totals (one row per
    range and key) are summed first and added to the sums inside a range.
    Null keys are a key of their own.  Rows equal in keys and order are summed
    in an unspecified order.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in (*keys, *order)]) if keys or order else df
    t = staged(ranged.withColumn("_range", F.spark_partition_id()), "prefix")
    totals = t.groupBy("_range", *keys).agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    starts = totals.select(
        F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_sum").over(earlier.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = W.partitionBy("_range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = t.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts, same).select(*df.columns, (F.col("_in") + F.col("_start")).alias(out))


# ------------------------------------------------------------ components


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges``, for every node with an edge.

    Edges always point from a larger to a smaller node.  One round lets each
    edge's parent be replaced by the parent's own smallest parent, then ties
    all parents of a node to its smallest one.  Both steps keep what is
    connected; rounds grow with the logarithm of a component's size.  The
    smallest parents are a written table, so that in the joins both sides are
    plain exchanges and AQE can split the partition of a parent with many
    children.  Nothing is collected.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    links = staged(edges.where(F.col(a) != F.col(b)).select(high.alias("child"), low.alias("parent")).distinct(), "links")
    while True:
        least = staged(links.groupBy("child").agg(F.min("parent").alias("least")), "least")
        above = least.select(F.col("child").alias("parent"), F.col("least").alias("above"))
        jumped = staged(links.join(above, "parent", "left")
                        .select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
                        .groupBy("child", "parent").agg(F.max("moved").alias("moved")), "jumped")
        own = staged(jumped.groupBy("child").agg(F.min("parent").alias("least"), F.count("*").alias("n"), F.max("moved").alias("moved")), "own")
        if own.where((F.col("n") > 1) | F.col("moved")).isEmpty():
            return own.select(F.col("child").alias("node"), F.col("least").alias("component")).union(
                own.select(F.col("least").alias("node"), F.col("least").alias("component")).distinct())
        tied = jumped.join(own.where("n > 1").select("child", "least"), "child").where("parent != least")
        links = staged(own.select("child", F.col("least").alias("parent"))
                       .union(tied.select(F.col("parent").alias("child"), F.col("least").alias("parent"))).distinct(), "links")


# ------------------------------------------------------------ inside tasks


class BoundedCache(dict):
    """``cache[key]`` computes a missing value (never None) and keeps it.

    There are two generations of half of ``limit`` each: a full young one (the
    dict itself) becomes the old one, and what is met again moves up, so that
    frequent keys stay however many rare ones pass.  Long keys are computed
    each time, so the cache stays within about ``limit`` small entries."""

    def __init__(self, compute: Callable, limit: int = 600_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(key) <= self.longest:
            if 2 * len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value


def store(uri: str):
    """(file system, path) of a folder in the shared store: a local path or a URI that pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)
