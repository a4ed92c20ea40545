"""Embedding near-duplicates (operator 2).

Cross-polytope hashing: a vector is rotated by three rounds of random signs
and a fast Hadamard transform; the coordinate largest in size, with its sign,
is its cell.  ``FUNCTIONS`` rotations together name a bucket, ``TABLES`` tables
are kept, and a vector also visits the buckets of its runner-up coordinates
(multiprobe).  Vectors that meet in a bucket are compared by cosine in double
precision; every link is verified.

Equal vectors are one row from the start.  Buckets of more than ``BLOCK``
rows are cut into blocks and compared block by block, so no task holds a whole
bucket and no pair leaves a task: a task gives, per vector, the number of new
links and its smallest tie.  A pair that meets in several buckets is counted
in the first of them only, which each task sees from the vectors' bucket
lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bootlens.llm.common import components, staged

#: Production parameters; recall against brute force is in the README.
TABLES, FUNCTIONS, PROBES, BLOCK, SEED = 10, 2, 3, 512, 20240


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def buckets(x: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Sorted bucket numbers (n, tables * probes) of unit vectors; the table is part of the number."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng = np.random.default_rng(seed)
    rows, out = np.arange(n), []
    for t in range(tables):
        best = []
        for _ in range(functions):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), width))
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2] if width > 2 else np.tile([0, 1], (n, 1))
            size = np.abs(y[rows[:, None], top])
            top = np.take_along_axis(top, np.argsort(-size, axis=1), axis=1)
            value = y[rows[:, None], top]
            best.append((2 * top + (value < 0), np.abs(value[:, 0]) - np.abs(value[:, 1])))
        code = np.zeros(n, dtype=np.int64)
        for cell, _ in best:
            code = code * (2 * width) + cell[:, 0]
        found = [code]
        # next buckets: change one function to its runner-up, the closest call first
        gaps = np.stack([gap for _, gap in best], axis=1)
        for f in np.argsort(gaps, axis=1, kind="stable").T[:probes - 1]:
            scale = (2 * width) ** (functions - 1 - f).astype(np.int64)
            cells = np.stack([c for c, _ in best], axis=1)[rows, f]
            found.append(code + (cells[:, 1] - cells[:, 0]) * scale)
        out += [c * tables + t for c in found]
    return np.sort(np.stack(out, axis=1), axis=1)


def _local_roots(link: np.ndarray) -> np.ndarray:
    """Smallest index reachable in a symmetric boolean link matrix."""
    n = len(link)
    root = np.arange(n)
    while True:
        least = np.minimum(root, np.where(link, root[None, :], n).min(axis=1, initial=n))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _met_before(codes: np.ndarray, code: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows a[i] and b[i] share a bucket before ``code``.

    Products of 0/1 membership matrices over the earlier buckets with several
    rows; few links among very many such buckets are looked at one by one."""
    found, place, times = np.unique(codes, return_inverse=True, return_counts=True)
    place = place.reshape(codes.shape)
    shared = np.nonzero((found < code) & (times > 1))[0]
    if len(codes) ** 2 * len(shared) > 2000 * len(a):
        out = np.zeros(len(a), dtype=bool)
        for at in range(0, len(a), 1 << 14):
            ca, cb = codes[a[at:at + (1 << 14)]], codes[b[at:at + (1 << 14)]]
            for k in range(ca.shape[1]):
                out[at:at + (1 << 14)] |= (ca[:, k] < code) & (cb == ca[:, k:k + 1]).any(axis=1)
        return out
    met = np.zeros((len(codes), len(codes)), dtype=bool)
    for at in range(0, len(shared), 256):
        column = np.full(len(found), -1)
        column[shared[at:at + 256]] = np.arange(len(shared[at:at + 256]))
        row, k = np.nonzero(column[place] >= 0)
        member = np.zeros((len(codes), 256), dtype=np.float32)
        member[row, column[place[row, k]]] = 1
        met |= member @ member.T > 0
    return met[a, b]


def _meet(ids, vectors, codes, copies, code, side, threshold):
    """Links inside one block pair: per vector (id, copies newly linked) and ties (id, smallest id tied to)."""
    order = np.argsort(ids, kind="stable")
    ids, vectors, codes, copies, side = ids[order], vectors[order], codes[order], copies[order], side[order]
    link = vectors @ vectors.T >= threshold
    np.fill_diagonal(link, False)
    if (side == 1).any():  # two blocks: only pairs across them
        link &= side[:, None] != side[None, :]
    if not link.any():
        return None
    a, b = np.nonzero(link)
    fresh = ~_met_before(codes, code, a, b)
    gained = np.bincount(a[fresh], weights=copies[b[fresh]], minlength=len(ids)).astype(np.int64)
    return ids, gained, ids[_local_roots(link)]


def linked(vectors: DataFrame, threshold: float = 0.95, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES,
           block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(id, gained, tie) from (id, copies, v): several rows per id; ``gained`` adds up to its links, ``tie`` is an id it reaches."""
    placed_schema = pa.schema([("id", pa.int64()), ("copies", pa.int64()), ("x", pa.list_(pa.float64())), ("codes", pa.list_(pa.int64()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            widths = np.asarray(lists.value_lengths())
            ids, copies = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for width in np.unique(widths):  # vectors of different length never link
                at = np.nonzero(widths == width)[0]
                x = np.asarray(lists.take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), width)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                codes = buckets(x, tables, functions, probes, seed + int(width))
                made = [pa.array(ids[at]), pa.array(copies[at]), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(codes), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(made, schema=placed_schema)

    placed = staged(vectors.select("id", "copies", "v").mapInArrow(place, "id long, copies long, x array<double>, codes array<long>"), "placed")
    rows = placed.select("id", F.size("x").alias("width"), F.explode(F.array_distinct("codes")).alias("code"))
    # of buckets with the same members the first is enough: a pair counts in its first bucket only
    members = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"set{k}") for k in range(2)]
    full = staged(rows.groupBy("width", "code").agg(F.count("*").alias("n"), *members).where("n > 1")
                  .groupBy("width", "n", "set0", "set1").agg(F.min("code").alias("code")).select("width", "code", "n"), "full")
    # blocks of a crowded bucket: each row goes to the pairs of its block with every block
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = rows.join(full, ["width", "code"]).select("id", "width", "code", blocks.alias("blocks"), F.pmod(F.xxhash64("id", "code"), blocks).cast("int").alias("mine"))
    pairs = own.select("id", "width", "code", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meeting = pairs.select("id", "width", "code", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    carried = meeting.join(placed.select("id", "copies", "x", "codes"), "id")
    grouped = carried.repartition("width", "code", "low", "high").sortWithinPartitions("width", "code", "low", "high")
    schema = pa.schema([("id", pa.int64()), ("gained", pa.int64()), ("tie", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def groups(table: pa.Table):
            keys = np.stack([table.column(k).to_numpy() for k in ("width", "code", "low", "high")], axis=1)
            starts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1), len(keys)]
            return list(zip(starts, starts[1:]))

        def work(table: pa.Table, spans) -> Iterator[pa.RecordBatch]:
            ids, code = table.column("id").to_numpy(), table.column("code").to_numpy()
            side, copies = table.column("side").to_numpy(), table.column("copies").to_numpy()
            flat = lambda name: table.column(name).combine_chunks()
            xs, cs = flat("x"), flat("codes")
            made = []
            for a, b in spans:
                if b - a < 2:
                    continue
                x = xs.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                c = cs.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                met = _meet(ids[a:b], x, c, copies[a:b], code[a], side[a:b], threshold)
                if met is not None:
                    made.append(met)
            if made:
                columns = [np.concatenate([m[k] for m in made]) for k in range(3)]
                useful = (columns[1] > 0) | (columns[2] != columns[0])
                yield pa.RecordBatch.from_arrays([pa.array(c[useful]) for c in columns], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            spans = groups(table)
            yield from work(table, spans[:-1])
            held = [table.slice(spans[-1][0])]  # its group may go on in the next batch: two blocks at most
        if held:
            yield from work(held[0], [(0, held[0].num_rows)])

    return grouped.mapInArrow(compare, "id long, gained long, tie long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, **settings) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Links are pairs of rows found by the hashing with a cosine of at least
    ``threshold``; none below it.  Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, nor do vectors of
    different length.  Rows that repeat a vector are linked copies of each
    other (rows that repeat an id too).  Rows without an id link with nothing.
    Other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite, F.lit(False))
    valid = staged(rows.where(usable), "vectors")
    distinct = staged(valid.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "distinct")
    found = staged(linked(distinct, threshold, **settings), "linked")
    gained = found.groupBy("id").agg(F.sum("gained").alias("gained"))
    tied = components(found, "id", "tie")
    each = distinct.join(gained, "id", "left").join(tied, F.col("id") == F.col("node"), "left").select(
        F.col("v").alias("_v"), "copies", (F.coalesce("gained", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # only copies and linked vectors need a look-up
    known = staged(each.where("n_links > 0"), "known")
    out = valid.join(known, F.col("v") == F.col("_v"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
