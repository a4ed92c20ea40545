"""SimHash near-duplicates (operator 8).

Fingerprints are 64 bits over word shingles.  To find fingerprints that differ
in at most ``max_bits`` (0, 1 or 2) bits without comparing all of them:

1. Equal fingerprints are grouped first; from here on each is one row.
2. A fingerprint is mapped to the bit counts of its segments.  The Manhattan
   distance of two such vectors is at most the Hamming distance, so links lie
   among vectors at most ``max_bits`` apart.
3. Two lattice points at distance 2 or less share a point within distance 1 of
   both.  Each vector is put into its own grid cell and the cells one step
   away, and meets others in equal cells (an equi-join, no range scan).
4. Pairs of a cell are verified by their differing bits.
5. A cell with more than ``cell_rows`` fingerprints is not paired off: its
   fingerprints go through the same grid with segments of one bit, where
   Manhattan and Hamming distance are equal.  All members of such a cell are
   within 2 bits of each other, so each is tied to the smallest one (linear,
   and at most 65 distinct fingerprints can meet there).
6. The verified links are merged into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bootlens.llm.common import components, fresh, staged

CHUNK_WORDS = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text, as an unsigned integer; no words: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    total, ones = 0, np.zeros(64, dtype=np.int64)
    last = max(1, len(words) - shingle + 1)
    for at in range(0, last, CHUNK_WORDS):
        part = words[at:min(last, at + CHUNK_WORDS) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle))) if len(part) >= shingle else [part]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), seed) for g in grams], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per input row; ``fp`` holds the 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _coarse(fps: DataFrame) -> DataFrame:
    """(fp, cell): the fingerprint's own cell and those one step away; a cell packs 16 counts of 4-bit segments."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", 4 * i).bitwiseAND(_long(15))) for i in range(16)]
    own = sum((F.shiftleft(c.cast("long"), 3 * i) for i, c in enumerate(counts)), _long(0))
    packed = fps.select("fp", own.alias("own"))
    steps = [_long(0)]
    for i in range(16):
        count, step = F.shiftright("own", 3 * i).bitwiseAND(_long(7)), _long(1 << 3 * i)
        steps += [F.when(count < 4, step), F.when(count > 0, -step)]
    return packed.select("fp", "own", F.explode(F.array_compact(F.array(*steps))).alias("step")).select("fp", (F.col("own") + F.col("step")).alias("cell"))


def _fine(fps: DataFrame) -> DataFrame:
    """The same with segments of one bit: the cell is a fingerprint itself, a step changes one bit."""
    flips = F.array(_long(0), *[_long(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    return fps.select("fp", F.explode(flips).alias("step")).select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("cell"))


def links(distinct: DataFrame, fp: str = "fp", max_bits: int = 2, cell_rows: int = 16) -> DataFrame:
    """(a, b): links a > b that connect all fingerprints within ``max_bits`` bits.

    From cells of up to ``cell_rows`` fingerprints every verified pair, from
    fuller ones the ties to a smallest member; both connect the same sets."""
    if max_bits not in (0, 1, 2):
        raise ValueError("the grid finds 0, 1 or 2 differing bits")
    apart = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= max_bits
    placed = _coarse(distinct.select(F.col(fp).alias("fp")))
    full = staged(placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    met = staged(placed.join(full, "cell"), "met")
    few = met.where(F.col("n") <= cell_rows).groupBy("cell").agg(F.array_sort(F.collect_set("fp")).alias("fps"))
    pairs = (few.select("fps", F.explode("fps").alias("a"))
             .select("a", F.explode(F.filter("fps", lambda b: (b < F.col("a")) & apart(F.col("a"), b))).alias("b")))
    fine = _fine(met.where(F.col("n") > cell_rows).select("fp").distinct())
    if max_bits == 2:
        tied = (fine.groupBy("cell").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
                .select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a != b"))
    else:  # a cell's members are 2 bits apart at most, so fewer need the check
        tied = (fine.groupBy("cell").agg(F.collect_set("fp").alias("fps"))
                .select("fps", F.explode("fps").alias("a"))
                .select("a", F.explode(F.filter("fps", lambda b: (b < F.col("a")) & apart(F.col("a"), b))).alias("b")))
    return pairs.union(tied).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42,
                    max_bits: int = 2, cell_rows: int = 16) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    ``fingerprint`` is 16 lowercase hex digits.  ``component_id`` is the
    smallest doc_id reachable over links of at most ``max_bits`` differing
    bits; null only where no document of the component has an id.  Null or
    wordless texts have the fingerprint zero and link like any other.  Texts
    with fewer words than a shingle are one shingle.  Rows that share a doc_id
    each get their own fingerprint and component.  Other columns are ignored.
    """
    return _grouped(docs, doc_id, text, shingle, seed, max_bits, cell_rows).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int = 3, seed: int = 42, max_bits: int = 2, cell_rows: int = 16) -> DataFrame:
    """(doc_id, fp, class, component_id), one row per input row; ``class`` is one of the component's fingerprints and names it also where ids repeat."""
    fps = staged(fingerprints(docs, doc_id, text, shingle, seed), "fps")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct, "fp", max_bits, cell_rows), "a", "b")
    classes = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first", "n", F.col("component").isNotNull().alias("linked"), F.coalesce("component", "fp").alias("class"))
    least = classes.where("linked").groupBy("class").agg(F.min("first").alias("least"))
    # only fingerprints of several documents or with links need a look-up; the others are their own component
    several = staged(classes.where("linked or n > 1").join(least, "class", "left")
                     .select(F.col("fp").alias("_fp"), "class", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id")), "several")
    return fps.join(several, fps["fp"] == several["_fp"], "left").select(
        "doc_id", "fp", F.coalesce("class", "fp").alias("class"),
        F.when(F.col("_fp").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row with the smallest id.

    Rows that share an id are judged by their own texts: those of different
    components each have a survivor.  Rows without an id are kept, as a
    survivor is named by its id.  Columns stay as they are."""
    found = staged(_grouped(docs, doc_id, text, **settings), "near").where(F.col("doc_id").isNotNull())
    first = F.col("doc_id") == F.col("component_id")
    verdict = staged(found.groupBy(F.col("doc_id").alias("_id")).agg(F.max(first).alias("_first"), F.count("*").alias("_n")).where("not _first or _n > 1"), "verdict")
    dropped = verdict.where("not _first")
    left = docs.join(dropped, docs[doc_id] == dropped["_id"], "left_anti")
    repeated = verdict.where("_first and _n > 1").select("_id")
    if repeated.isEmpty():
        return left
    # of ids on several rows, the fingerprint says which row of a component stays
    kept = staged(found.where(first).join(repeated, F.col("doc_id") == F.col("_id"), "left_semi")
                  .groupBy("class", F.col("doc_id").alias("_id")).agg(F.min("fp").alias("_fp")).select("_id", "_fp"), "kept")
    own = fresh(docs, "fp")
    marked = _marked(left.join(repeated, left[doc_id] == repeated["_id"], "left_semi"), text, own, settings)
    chosen = marked.join(kept, (marked[doc_id] == kept["_id"]) & (marked[own] == kept["_fp"]), "left_semi").dropDuplicates([doc_id, own]).drop(own)
    return left.join(repeated, left[doc_id] == repeated["_id"], "left_anti").union(chosen)


def _marked(rows: DataFrame, text: str, name: str, settings: dict) -> DataFrame:
    """``rows`` with the fingerprint of ``text`` as the last column ``name``."""
    at, fixed = rows.columns.index(text), {k: settings[k] for k in ("shingle", "seed") if k in settings}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), **fixed) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, LongType())]))
