"""Q1-Q5: the catalog's insert-time checks as audits over whole tables.

Each rule returns rows (rule, table, key, detail).  ``quality_report`` checks all
rows of a table against the rules about its own values in one scan, each row
giving an array of what fails in it, all its references in another, and the
values of all UNIQUE columns of all tables in one aggregation.
"""

from __future__ import annotations

import functools
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bootlens.schemas import FSTYPES, MGMT_METHODS, TPM_VALUES

REPORT_COLS = ("rule", "table", "key", "detail")


def _rows(df: DataFrame, rule: str, table: str, key, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"),
                     key.cast("string").alias("key"), detail.alias("detail"))


def required(df: DataFrame, table: str, key: str, cols: Sequence[str]) -> DataFrame:
    """Q1: required columns (NULL or empty text is missing)."""
    out = None
    for c in cols:
        bad = df.where(F.col(c).isNull() | (F.col(c).cast("string") == ""))
        r = _rows(bad, "Q1 required", table, F.col(key), F.lit(f"{c} missing"))
        out = r if out is None else out.unionByName(r)
    return out


def domain(df: DataFrame, table: str, key: str, col: str, allowed: Sequence) -> DataFrame:
    """Q2: values outside a fixed domain (NULL is left to Q1)."""
    bad = df.where(F.col(col).isNotNull() & ~F.col(col).isin(*allowed))
    return _rows(bad, "Q2 domain", table, F.col(key), F.concat(F.lit(f"{col}="), F.col(col).cast("string")))


def unique(df: DataFrame, table: str, col: str) -> DataFrame:
    """Q3: a UNIQUE column holding a value more than once (NULLs may
    repeat, as in SQLite)."""
    d = (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
         .where(F.col("n") > 1))
    return _rows(d, "Q3 unique", table, F.col(col), F.concat(F.lit(f"{col} n="), F.col("n").cast("string")))


def references(child: DataFrame, table: str, key: str, fk: str, parent: DataFrame, pk: str,
               parent_name: str) -> DataFrame:
    """Q4: references to a missing parent row (NULL references pass; the
    reference never enforced REFERENCES)."""
    p = parent.select(F.col(pk).alias("_pk"))
    orphans = child.where(F.col(fk).isNotNull()).join(p, F.col(fk) == F.col("_pk"), "left_anti")
    return _rows(orphans, "Q4 reference", table, F.col(key),
                 F.concat(F.lit(f"{fk}="), F.col(fk).cast("string"), F.lit(f" not in {parent_name}")))


def reset_atime_rule(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Q5: resetting access times is only allowed with nfs."""
    bad = requests.where(F.coalesce(F.col("reset_atime"), F.lit(False)) & (F.col("fstype") != F.lit("nfs")))
    return _rows(bad, "Q5 reset-atime", "request", F.col(key), F.concat(F.lit("fstype="), F.col("fstype")))


def _failures(df: DataFrame, table: str, key: str, required: Sequence[str] = (), domains: Sequence[tuple[str, Sequence]] = (),
              parents: Sequence[tuple[str, DataFrame, str, str]] = ()) -> DataFrame:
    """Q1, Q2 and Q4 of a table; ``parents`` are (foreign key, parent table, its key, its name).

    References that are given stand as rows of their own (parent, its key, key of the row) and meet the keys of all
    parents in one anti join: rows without a reference, which may be nearly all, do not gather in one task."""
    text = lambda c: F.col(c).cast("string")
    fact = lambda rule, detail: F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))
    facts = [F.when(F.col(c).isNull() | (text(c) == ""), fact("Q1 required", F.lit(f"{c} missing"))) for c in required]
    facts += [F.when(F.col(c).isNotNull() & ~text(c).isin(*allowed), fact("Q2 domain", F.concat(F.lit(f"{c}="), text(c)))) for c, allowed in domains]
    found = df.select(text(key).alias("key"), F.explode(F.array_compact(F.array(*facts))).alias("f")).select("f.rule", F.lit(table).alias("table"), "key", "f.detail")
    if not parents:
        return found
    ref = lambda i, v: F.struct(F.lit(i).alias("parent"), v.cast("string").alias("ref"))
    given = [ref(i, F.col(fk).cast(parent.schema[pk].dataType)) for i, (fk, parent, pk, _) in enumerate(parents)]
    refs = df.select(text(key).alias("key"), F.explode(F.array(*given)).alias("r")).select("key", "r.*").where("ref IS NOT NULL")
    known = functools.reduce(DataFrame.unionByName, [parent.select(ref(i, F.col(pk)).alias("r")).select("r.*") for i, (_, parent, pk, _) in enumerate(parents)])
    label = lambda words: F.element_at(F.array(*map(F.lit, words)), F.col("parent") + 1)
    orphans = refs.join(known, ["parent", "ref"], "left_anti").select(
        F.lit("Q4 reference").alias("rule"), F.lit(table).alias("table"), "key",
        F.concat(label(f"{fk}=" for fk, *_ in parents), "ref", label(f" not in {name}" for *_, name in parents)).alias("detail"))
    return found.unionByName(orphans)


def _repeated(tables: Sequence[tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """Q3 of many UNIQUE columns, (table, its name, columns) each: one aggregation over their stacked values."""
    stacked = [df.select(F.lit(name).alias("table"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("key")) for c in cols])).alias("v"))
               .select("table", "v.*").where("key IS NOT NULL") for df, name, cols in tables]
    twice = functools.reduce(DataFrame.unionByName, stacked).groupBy("table", "col", "key").agg(F.count("*").alias("n")).where("n > 1")
    return twice.select(F.lit("Q3 unique").alias("rule"), "table", "key", F.concat("col", F.lit(" n="), F.col("n").cast("string")).alias("detail"))


def quality_report(nodes: DataFrame, containers: DataFrame, kernels: DataFrame, initrds: DataFrame,
                   rootfs: DataFrame) -> DataFrame:
    """Q1-Q4 over a catalog, as one table.

    ``have_tpm`` may be a boolean, or 1/0 as stored; then other values are
    reported too."""
    stored = [] if dict(nodes.dtypes)["have_tpm"] == "boolean" else [("have_tpm", TPM_VALUES)]
    images = [(kernels, "Kernel"), (initrds, "Initrd"), (rootfs, "Rootfs")]
    node = _failures(nodes, "Node", "node_id", ["node_name", "node_rank", "method_mgmt"], [*stored, ("method_mgmt", MGMT_METHODS)])
    container = _failures(containers, "Container", "bmc_id", domains=[("fstype", FSTYPES)],
                          parents=[(f"{n.lower()}_id", df, f"{n.lower()}_id", n) for df, n in [*images, (nodes, "Node")]])
    unique_columns = [(nodes, "Node", ["node_name", "mac_addr_mgmt", "ip4_addr_mgmt", "ip4_addr_boot", "ip4_addr_os"]), (containers, "Container", ["base_name"]),
                      *[(df, n, [f"{n.lower()}_name"]) for df, n in images]]
    return node.unionByName(container).unionByName(_repeated(unique_columns))
