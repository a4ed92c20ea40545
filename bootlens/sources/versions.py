"""Versioned tables: what M1-M7 return becomes the next version, or is refused.

The reference changes its catalog inside transactions, one writer at a time.
Here a table is a folder of Parquet files that never change, cut into buckets by
a hash of the key, and a log of versions.  A version names the files of each
bucket.  ``commit`` reads and rewrites only the buckets that the change set's
keys fall into; the other buckets keep the files of the base version.  The new
version is published by one rename that fails if the version exists, so of two
writers on the same base one is refused (``VersionConflict``) and can try again
on the newer base.  Readers hold a version: they are never disturbed, and any
version can be read later.

Only bucket numbers and file names pass the driver, as many as there are buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_BUCKET = "_bucket"


class VersionConflict(Exception):
    """Somebody else has published a version on the same base."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _log_file(path: str, version: int) -> str:
    return f"{path}/log/{version:020d}.json"


def _publish(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """Write the manifest under a name of its own, then rename it to the version's; the rename does not overwrite."""
    jvm, fs = _files(spark, path)
    Path, target = jvm.org.apache.hadoop.fs.Path, _log_file(path, version)
    attempt = Path(f"{path}/log/.attempt-{uuid.uuid4().hex}")
    out = fs.create(attempt, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(attempt, Path(target), plain)
    except Exception as e:
        fs.delete(attempt, False)
        if fs.exists(Path(target)):
            raise VersionConflict(f"version {version} of {path} is taken") from e
        raise


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(_log_file(path, version), wholetext=True).collect()))   # one row


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    jvm, fs = _files(spark, path)
    log = jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def _bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, path: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    names = sorted({f for b, f in manifest["files"].items() if buckets is None or int(b) in buckets})
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def _write(spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int) -> dict[str, str]:
    """Write rows by bucket to a new folder; {bucket: folder} of those that have rows."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.withColumn(_BUCKET, _bucket_of(key, buckets)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{folder}")
    jvm, fs = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}"))]
    return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}


def _highest(spark: SparkSession, path: str, manifest: dict, id_col: str | None, files: dict[str, str]) -> int | None:
    """The highest id ever given: ids of deleted rows do not return."""
    if id_col is None:
        return None
    fresh = _rows(spark, path, {**manifest, "files": files}).agg(F.max(id_col)).first()[0]
    return max((x for x in (manifest.get("highest"), fresh) if x is not None), default=None)


def create(path: str, rows: DataFrame, key: str, id_col: str | None = None, buckets: int = BUCKETS) -> int:
    """A new table; returns version 0.  ``key`` is the column that changes go by (a name, a bmc_id)."""
    spark = rows.sparkSession
    files = _write(spark, path, rows, key, buckets)
    manifest = {"key": key, "id_col": id_col, "buckets": buckets, "schema": json.loads(rows.schema.json()), "files": files, "base": None}
    manifest["highest"] = _highest(spark, path, manifest, id_col, files)
    _publish(spark, path, 0, manifest)
    return 0


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version (default: the newest)."""
    return _rows(spark, path, _manifest(spark, path, versions(spark, path)[-1] if version is None else version))


def commit(path: str, base: int, changes: DataFrame, apply: Callable[[DataFrame, DataFrame, int | None], DataFrame]) -> int:
    """Apply a change set to version ``base`` and publish the result as the next one.

    ``apply(rows, changes, highest)`` is one of the M operators: it gets the rows
    of the buckets that ``changes`` (holding the table's key column) touches and
    the highest id ever given, and returns what they become.  Rows must keep
    their keys or take keys of the change set.  Raises ``VersionConflict`` when
    the base is no longer the newest version."""
    spark = changes.sparkSession
    m = _manifest(spark, path, base)
    if versions(spark, path)[-1] != base:
        raise VersionConflict(f"version {base} of {path} is not the newest")
    touched = sorted(r[0] for r in changes.select(_bucket_of(m["key"], m["buckets"])).distinct().collect())   # bucket numbers
    new = apply(_rows(spark, path, m, touched), changes, m.get("highest"))
    files = _write(spark, path, new.select(*StructType.fromJson(m["schema"]).fieldNames()), m["key"], m["buckets"])
    strays = set(map(int, files)) - set(touched)
    if strays:
        raise ValueError(f"the change gave rows of keys that are not in its change set (buckets {sorted(strays)})")
    kept = {b: f for b, f in m["files"].items() if int(b) not in touched}
    manifest = {**m, "files": {**kept, **files}, "base": base, "highest": _highest(spark, path, m, m["id_col"], files)}
    _publish(spark, path, base + 1, manifest)
    return base + 1
