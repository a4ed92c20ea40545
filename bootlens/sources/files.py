"""Repository manifests, file listings, benchmark result logs,
meter samples and Docker JSON.

Text is read with Spark's text/binaryFile sources and parsed with
column expressions; the file a row came from is ``_metadata.file_path``.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bootlens.schemas import SAMPLE
from bootlens.session import scratch_dir

# --------------------------------------------------------------------------
# manifests

# Manifest keys and the file patterns of a repository without one.
MANIFEST_KEYS = ("kernel", "initrd", "param", "kernelsig", "initrdsig")
LISTING_SUFFIXES = (("kernel", "kernel"), ("initrd", "initrd"), ("param", "param"),
                    ("kernelsig", "kernel.sig"), ("initrdsig", "initrd.sig"))
MANIFEST_NAME = "BMCfile"


def read_manifests(spark: SparkSession, root: str, name: str = MANIFEST_NAME) -> DataFrame:
    """Every manifest file under ``root`` as lines (repo, line_no, key,
    value, error).  A file is read whole (manifests are a few lines), so
    line numbers are exact."""
    raw = (spark.read.option("wholetext", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", name).text(root)
           .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    return manifest_lines(raw)


def manifest_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Manifest text -> (repo, line_no, key, value, error).

    repo = the folder holding the manifest.  A line is ``key rest``: the
    first word, then the rest with outer blanks removed (shell ``read``).
    Keys other than kernel, initrd, param, kernelsig, initrdsig are errors,
    blank and ``#`` lines included.  A final line break ends the file."""
    body = F.regexp_replace(F.col(text), r"\n$", "")
    lines = files.select(F.element_at(F.split(F.col(path), "/"), -2).alias("repo"),
                         F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    line = F.trim(F.col("line"))
    key = F.regexp_extract(line, r"^(\S*)", 1)
    value = F.trim(F.regexp_replace(line, r"^\S*", ""))
    return lines.select("repo", (F.col("pos") + 1).cast("long").alias("line_no"), key.alias("key"),
                        value.alias("value"),
                        F.when(~key.isin(*MANIFEST_KEYS), F.concat(F.lit("syntax error: "), F.col("line")))
                        .alias("error"))


def manifest_table(lines: DataFrame, listing: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """One row per repo: kernel, initrd, param, kernelsig, initrdsig (the
    last line of each key wins), and ``error``: the first bad line, else a
    missing kernel or initrd.

    With a file ``listing`` (``path`` column) and the repository ``root``,
    a line naming a file that is not there is an error too ("cannot read"),
    as the reference reads every named file."""
    if listing is not None:
        present = listing.select(F.col("path").alias("_p"), F.lit(True).alias("_there"))
        want = F.concat(F.lit(root.rstrip("/") + "/"), F.col("repo"), F.lit("/"), F.col("value"))
        lines = (lines.join(present, want == F.col("_p"), "left")
                 .withColumn("error", F.coalesce(F.col("error"),
                                                 F.when(F.col("_there").isNull(),
                                                        F.concat(F.lit("cannot read "), F.col("value")))))
                 .drop("_p", "_there"))
    ok = F.col("error").isNull()
    aggs = [F.max_by(F.when(ok & (F.col("key") == k), F.col("value")),
                     F.when(ok & (F.col("key") == k), F.col("line_no"))).alias(k) for k in MANIFEST_KEYS]
    aggs.append(F.min_by(F.col("error"), F.when(~ok, F.col("line_no"))).alias("_bad"))
    t = lines.groupBy("repo").agg(*aggs)
    err = (F.when(F.col("_bad").isNotNull(), F.col("_bad"))
           .when(F.col("kernel").isNull(), F.lit("kernel must be specified"))
           .when(F.col("initrd").isNull(), F.lit("initrd must be specified")))
    return t.select("repo", *MANIFEST_KEYS, err.alias("error"))


def manifest_from_listing(listing: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Repositories without a manifest: the top-level file ending in each
    pattern; like a shell glob a pattern skips dot files.  Exactly one match
    is taken.  None or several (which name no readable file) are an error for
    kernel and initrd; the parameter and signature files are then left out."""
    rel = F.when(F.col(path).startswith(root.rstrip("/") + "/"),
                 F.substr(F.col(path), F.lit(len(root.rstrip("/")) + 2)))
    parts = F.split(rel, "/")
    top = listing.select(F.element_at(parts, 1).alias("repo"), F.element_at(parts, 2).alias("file"),
                         F.size(parts).alias("depth"), F.col(path).alias("path")).where(F.col("depth") == 2)
    matches = [F.struct(F.lit(k).alias("key"), (F.col("file").endswith(s) & ~F.col("file").startswith(".")).alias("hit"))
               for k, s in LISTING_SUFFIXES]
    hits = (top.select("repo", "path", F.explode(F.array(*matches)).alias("m"))
            .where(F.col("m.hit")).select("repo", "path", F.col("m.key").alias("key")))
    per = hits.groupBy("repo", "key").agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("path"))
    t = per.groupBy("repo").agg(
        *[F.max(F.when((F.col("key") == k) & (F.col("n") == 1), F.col("path"))).alias(k) for k, _ in LISTING_SUFFIXES],
        F.min(F.when((F.col("n") > 1) & F.col("key").isin("kernel", "initrd"),
                     F.concat(F.lit("ambiguous "), F.col("key")))).alias("_amb"))
    repos = top.select("repo").distinct()
    t = repos.join(t, "repo", "left")
    err = (F.when(F.col("_amb").isNotNull(), F.col("_amb"))
           .when(F.col("kernel").isNull(), F.lit("No kernel file in repository"))
           .when(F.col("initrd").isNull(), F.lit("No initrd file in repository")))
    return t.select("repo", *[k for k, _ in LISTING_SUFFIXES], err.alias("error"))


def with_param_content(manifests: DataFrame, contents: DataFrame, root: str | None = None, param: str = "param") -> DataFrame:
    """Add ``kernel_param``, what the named parameter file holds
    (trailing line breaks cut, as a shell substitution does); NULL without
    such a file.  ``contents`` is (path, text), e.g. whole-text files; with
    ``root`` the names are relative to the repository's folder below it."""
    path = F.col(param) if root is None else F.concat(F.lit(root.rstrip("/") + "/"), F.col("repo"), F.lit("/"), F.col(param))
    text = contents.select(F.col("path").alias("_path"), F.regexp_replace("text", r"\n+$", "").alias("kernel_param"))
    return manifests.join(text, path == F.col("_path"), "left").drop("_path")


# --------------------------------------------------------------------------
# Benchmark result logs

# Fixed patterns: result log names (res-BENCH-SIZE-TARGET-SmtSMT-I.out) and
# the leading number awk reads from a word.
RESULT_NAME = r"^res-([^-]+)-(\d+)-(.+)-Smt([^-]+)-(\d+)\.out$"
NUMBER_PREFIX = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def read_results(spark: SparkSession, path: str, in_folders: bool = False) -> DataFrame:
    """Result logs as (file_name, line).  With ``in_folders`` a log is a
    folder of that name (``file_name=NAME``) that holds its parts."""
    lines = spark.read.text(path)
    name = F.col("file_name") if in_folders else F.col("_metadata.file_name")
    return lines.select(name.alias("file_name"), F.col("value").alias("line"))


def first_number(text: Column) -> Column:
    """The leading number of a word, 0 when there is none (awk's ``$1``)."""
    num = F.regexp_extract(text, NUMBER_PREFIX, 1)
    return F.when(num != "", num.try_cast("double")).otherwise(F.lit(0.0))


def gflops_lines(lines: DataFrame) -> DataFrame:
    """Result lines -> (file_name, gflops) for every line holding ``GFLOPS``:
    the first ``GFLOPS *= *`` is removed and the first word read as a number
    (0 when it is not one)."""
    g = lines.where(F.col("line").contains("GFLOPS"))
    rest = F.concat_ws("", F.split(F.col("line"), "GFLOPS *= *", 2))   # drop the first marker only
    word = F.regexp_extract(rest, r"^\s*(\S*)", 1)
    return g.select("file_name", first_number(word).alias("gflops"))


def result_name_fields(df: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Add (bench, size, target, smt, i) from ``res-BENCH-SIZE-TARGET-SmtSMT-I.out``
    (one regex pass; NULL fields for other names)."""
    fn = F.col(file_name)
    parts = F.when(fn.rlike(RESULT_NAME),
                   F.split(F.regexp_replace(fn, RESULT_NAME, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001", 5))
    d = df.withColumn("_rn", parts)

    def part(i):
        return F.element_at(F.col("_rn"), i)

    return d.select(*df.columns, part(1).alias("bench"), part(2).try_cast("int").alias("size"), part(3).alias("target"),
                    part(4).alias("smt"), part(5).try_cast("int").alias("i"))


def parse_results(lines: DataFrame) -> DataFrame:
    """Result lines -> (file_name, bench, size, target, smt, i, gflops), one
    row per GFLOPS line."""
    return result_name_fields(gflops_lines(lines)).select(
        "file_name", "bench", "size", "target", "smt", "i", "gflops")


# --------------------------------------------------------------------------
# S10, S11, S12


_ENTRY = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("accessed", pa.timestamp("us", "UTC"))])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each folder of a batch; access times where the file system is the executor's own or mounted."""
    import os

    from pyarrow import fs

    utc = lambda t: dt.datetime.fromtimestamp(t, dt.timezone.utc)
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows = []
            if "://" in uri and not uri.startswith("file:"):
                store, root = fs.FileSystem.from_uri(uri)
                head = uri[:len(uri) - len(root)]
                for i in store.get_file_info(fs.FileSelector(root)):
                    rows.append({"path": head + i.path, "folder": i.type == fs.FileType.Directory, "length": i.size, "modified": i.mtime, "accessed": None})
            else:
                root = "/" + uri.split(":", 1)[1].lstrip("/") if uri.startswith("file:") else uri
                with os.scandir(root) as found:
                    for e in found:
                        if e.is_dir(follow_symlinks=False):
                            rows.append({"path": e.path, "folder": True, "length": None, "modified": None, "accessed": None})
                        elif e.is_file():
                            st = e.stat()
                            rows.append({"path": e.path, "folder": False, "length": st.st_size, "modified": utc(st.st_mtime), "accessed": utc(st.st_atime)})
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_pylist(rows[at:at + 4096], schema=_ENTRY)


def read_listing(spark: SparkSession, root: str, pattern: str | None = None, partitions: int | None = None) -> DataFrame:
    """Files under ``root`` (path, length, modified, accessed), with an optional pattern of their names.

    Folders are listed by tasks, one level of the tree a round: each round's
    folders are spread over the executors, its entries are written to the shared
    checkpoint folder, and the driver only asks whether folders are left.
    ``accessed`` is the file system's access time, and NULL in stores that keep
    none.  Names that begin with ``_`` or ``.`` and what lies in such folders
    are left out, as Spark's own readers do."""
    n = int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    level, files = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), []
    while True:
        path = scratch_dir(spark, "listing")
        found = level.repartition(n).mapInArrow(_entries, "path string, folder boolean, length long, modified timestamp, accessed timestamp")
        found.where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]")).write.parquet(path)
        entries = spark.read.parquet(path)
        files.append(entries.where("NOT folder").select("path", "length", "modified", "accessed"))
        level = entries.where("folder").select("path")
        if level.isEmpty():
            break
    out = functools.reduce(DataFrame.unionByName, files)
    if not pattern:
        return out
    return out.where(F.element_at(F.split("path", "/"), -1).rlike("^" + fnmatch.translate(pattern)))


def accessed_since(listing: DataFrame, now: Column, days: float = 1.0, ts: str = "accessed") -> DataFrame:
    """Files whose time is less than ``days`` before ``now``."""
    return listing.where(F.col(ts) > now - F.make_dt_interval(secs=F.lit(days * 86400.0)))


def area_counts(listing: DataFrame, areas: DataFrame, area: str = "area") -> DataFrame:
    """File count per area, 0 for an area without files (counted before
    the join)."""
    n = listing.groupBy(area).agg(F.count(F.lit(1)).alias("n"))
    return areas.select(area).distinct().join(n, area, "left").select(area, F.coalesce("n", F.lit(0)).alias("n"))


def read_samples(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = SAMPLE) -> DataFrame:
    """Meter samples (ts, source, value) with a declared schema."""
    r = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    return r.load(path)


# The layout of an image inspect document and of a tag list.
IMAGE_ENV_SCHEMA = "array<struct<Config:struct<Env:array<string>>>>"
TAG_SCHEMA = "array<struct<name:string>>"


def image_env(df: DataFrame, json_col: str = "json") -> DataFrame:
    """``[].Config.Env`` of an image inspect document as rows
    (key, value split at the first '='); a NULL list gives no row."""
    parsed = F.from_json(F.col(json_col), IMAGE_ENV_SCHEMA)
    env = F.flatten(F.transform(parsed, lambda x: F.coalesce(x["Config"]["Env"], F.array().cast("array<string>"))))
    rows = df.select("*", F.explode(env).alias("_env"))
    return rows.select(*df.columns, F.substring_index("_env", "=", 1).alias("key"),
                       F.when(F.col("_env").contains("="),
                              F.substr(F.col("_env"), F.instr(F.col("_env"), "=") + 1)).alias("value"))


def tag_names(df: DataFrame, json_col: str = "json") -> Column:
    """``[].name`` of a tag list document as an array."""
    return F.transform(F.from_json(F.col(json_col), TAG_SCHEMA), lambda x: x["name"])


def tag_exists(names: Column, tag: Column | str) -> Column:
    """exact match of a tag in the name list (not a pattern)."""
    return F.array_contains(names, tag)


def json_rows(df: DataFrame, json_col: str, value_type: str = "bigint") -> DataFrame:
    """a JSON object column as (key, value) rows."""
    m = F.from_json(F.col(json_col), f"map<string,{value_type}>")
    return df.select("*", F.explode(m).alias("key", "value"))


def first_line(df: DataFrame, key: str, line_no: str, value: str) -> DataFrame:
    """First line per key (partial ``min_by``, no window)."""
    return df.groupBy(key).agg(F.min_by(value, line_no).alias(value))


def last_line(df: DataFrame, key: str, line_no: str, value: str) -> DataFrame:
    """Last line per key."""
    return df.groupBy(key).agg(F.max_by(value, line_no).alias(value))


