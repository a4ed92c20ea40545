"""Catalog tables in, tables and TSV out."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bootlens.schemas import CATALOG

# Fixed value: how a dump shows NULL.
NULL_TEXT = "<NULL>"


TEXT_FORMATS = ("csv", "json", "text")


def catalog(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Scan one catalog table with its declared schema (no inference).

    ``fmt`` is any Spark file format (parquet, orc, csv with a header...).
    The catalog stores booleans as 1/0: in text formats boolean columns are
    read as text and turned into booleans (``as_bool``)."""
    schema = CATALOG[name]
    if fmt not in TEXT_FORMATS:
        return spark.read.schema(schema).format(fmt).load(f"{path}/{name}")
    bools = [f.name for f in schema.fields if isinstance(f.dataType, T.BooleanType)]
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name in bools else f.dataType, True)
                            for f in schema.fields])
    reader = spark.read.schema(as_text).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    raw = reader.load(f"{path}/{name}")
    return raw.select(*[as_bool(f.name).alias(f.name) if f.name in bools else F.col(f.name) for f in schema.fields])


def register_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Make tables visible by name (temporary views)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def list_tables(spark: SparkSession) -> list[str]:
    """Table names, sorted (session catalog metadata, not data)."""
    return sorted(t.name for t in spark.catalog.listTables())


def write_tsv(df: DataFrame, path: str, null_value: str | None = None, mode: str = "overwrite") -> str:
    """Tab separated text with a header line.

    Fields with tabs, quotes or line breaks are quoted, and times keep their
    microseconds, so every row reads back whole (``read_tsv``)."""
    w = (df.write.mode(mode).option("sep", "\t").option("header", True).option("escapeQuotes", True)
         .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
         .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    if null_value is not None:
        w = w.option("nullValue", null_value)
    w.csv(path)
    return path


def read_tsv(spark: SparkSession, path: str, schema, null_value: str | None = None) -> DataFrame:
    r = spark.read.schema(schema).option("sep", "\t").option("header", True).option("multiLine", True)
    if null_value is not None:
        r = r.option("nullValue", null_value)
    return r.csv(path)


def dump_all(spark: SparkSession, out: str, names: Iterable[str] | None = None,
             null_value: str = NULL_TEXT) -> dict[str, str]:
    """S3: every table (or ``names``), in name order, as TSV with NULL shown
    as ``<NULL>``.  Returns table name -> folder written."""
    done = {}
    for name in sorted(names) if names is not None else list_tables(spark):
        path = f"{out}/{name}"
        write_tsv(spark.table(name), path, null_value=null_value)
        done[name] = path
    return done


def rows_changed(a: DataFrame, b: DataFrame, buckets: int = 1 << 16) -> DataFrame:
    """``n_changed``: how many rows are in ``a`` and not in ``b`` or the other way round, repeats counted.

    Rows are dealt to buckets by a hash, and each side's count and sums of two
    64-bit hashes are compared per bucket; only rows of buckets that differ are
    grouped and compared themselves, so equal tables are read but not shuffled."""
    cols = a.columns
    hashes = [F.xxhash64(F.lit(salt), *cols, *[F.isnull(c) for c in cols]) for salt in (1, 2)]
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    bucket = F.pmod(F.xxhash64(F.lit(0), *cols), F.lit(buckets)).alias("_bucket")
    halves = [F.sum(F.col("_side") * half) for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(h, 32))]
    totals = both.groupBy(bucket).agg(F.array(F.sum("_side"), *halves).alias("_t"))
    odd = totals.where(F.exists("_t", lambda x: x != 0)).select("_bucket")
    differ = both.select("*", bucket).join(F.broadcast(odd), "_bucket", "left_semi").groupBy(*cols).agg(F.sum("_side").alias("_n"))
    return differ.agg(F.coalesce(F.sum(F.abs("_n")), F.lit(0)).alias("n_changed"))


def as_bool(col: str) -> F.Column:
    """Booleans stored as 1/0 (or true/false text) read as boolean."""
    c = F.col(col).cast("string")
    return F.when(c.isin("1", "true", "TRUE"), F.lit(True)).when(c.isin("0", "false", "FALSE"), F.lit(False))
