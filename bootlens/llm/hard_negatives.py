"""Hard-negative mining (operator 11): anchor spanning trees bound the scores, few are computed.

Scores are inner products of whole-numbered vectors.  The anchors of a block
are joined by a minimum spanning tree.  Where the score of a candidate with a
parent anchor is known to lie in ``s ± e``, its score with a child at distance
``d`` lies in ``s ± (e + d * |candidate|)`` (Cauchy-Schwarz).  Only candidates
whose interval meets what an anchor asks for are scored; the others carry the
wider interval on to the anchor's own children.

What an anchor asks for:

* first its positives: the best ``positives`` other rows of its label.  Of the
  intervals of the candidates at hand, the k-th largest lower end is a score
  that k of them reach, so intervals that end below it are out;
* then, per positive, the best ``negatives`` rows of other labels whose scores
  lie in a window below the positive's score.  Intervals outside the window are
  out, and, where k intervals lie wholly inside it, those that end below the
  k-th largest lower end.

Both are exact.  Anchors (a stated query set) and candidates are cut into
blocks; a cell of the grid anchor block x candidate block is one task's small
group, so no task holds an anchor's candidates, and a cell gives at most k rows
an anchor and window.  They meet in a window of rank k, which Spark limits in
each task before the shuffle.  Blocks follow the label and the vector's largest
component, so anchors of one tree lie near each other and a search for
positives visits the blocks of its own label only.  A label that holds a third
of all rows is many blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bootlens.llm.common import prefix_sums, staged

ANCHORS, CANDIDATES = 2048, 2048   # rows of a block
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = (80, 100), (100, 100)  # window of a negative's score, as fractions of the positive's
SCALE = 256
#: Longest scaled vector: the product of two such norms fits a long.
LONGEST = float(1 << 31)
#: Up to this product of norms sums of whole doubles are exact in any order.
EXACT = float(1 << 53)


def quantized(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Whole numbers (as doubles) of the components: floor(scale * x), x as double."""
    return np.floor(scale * flat.astype(np.float64))


# ------------------------------------------------------------ the tree


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length) of a minimum spanning tree over the rows of ``x`` (Prim).

    ``order`` visits parents first; a root has parent -1."""
    n = len(x)
    parent, length = np.full(n, -1), np.zeros(n)
    if not n:
        return np.zeros(0, np.int64), parent, length
    near, at, out = np.full(n, np.inf), 0, [0]
    open_ = np.ones(n, dtype=bool)
    open_[0] = False
    for _ in range(n - 1):
        far = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        better = open_ & (far < near)
        near[better], parent[better] = far[better], at
        at = int(np.where(open_, near, np.inf).argmin())
        length[at] = near[at]
        open_[at] = False
        out.append(at)
    return np.array(out, dtype=np.int64), parent, length


def _forest(table: pa.Table) -> pa.Table:
    """The rows of an anchor block in visiting order, with parent (a place in that order) and edge length; one tree a dimension."""
    cols = table.column("vector").combine_chunks()
    dims = cols.value_lengths().to_numpy(zero_copy_only=False)
    order, parents, lengths = [], [], []
    for dim in np.unique(dims):
        own = np.nonzero(dims == dim)[0]
        visit, parent, length = spanning_tree(quantized(_matrix(cols.take(pa.array(own)), dim)))
        place = np.empty(len(own), dtype=np.int64)
        place[visit] = np.arange(len(own)) + len(order)
        order += own[visit].tolist()
        parents += [int(place[p]) if p >= 0 else -1 for p in parent[visit]]
        lengths += length[visit].tolist()
    n = len(order)
    return (table.take(pa.array(order, pa.int64())).append_column("at", pa.array(range(n), pa.int32()))
            .append_column("parent", pa.array(parents, pa.int32())).append_column("length", pa.array(lengths, pa.float64())))


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), int(dim))


# ------------------------------------------------------------ a cell


def _scores(x: np.ndarray, norms: np.ndarray, anchor: np.ndarray, norm: float) -> np.ndarray:
    """Exact inner products as longs."""
    if norm * float(norms.max(initial=0.0)) < EXACT:
        return (x @ anchor).astype(np.int64)
    return x.astype(np.int64) @ anchor.astype(np.int64)


def walk(anchors: np.ndarray, parent: np.ndarray, length: np.ndarray, x: np.ndarray,
         asked: Callable[[int, np.ndarray, np.ndarray], np.ndarray], found: Callable[[int, np.ndarray, np.ndarray], None]) -> int:
    """Visit the anchors from the root on; returns the number of scores computed.

    ``asked(i, lower, upper)`` gives the candidates (indices) to score for
    anchor ``i``, ``found(i, indices, scores)`` takes their scores."""
    norms, own = np.sqrt((x * x).sum(axis=1)), np.sqrt((anchors * anchors).sum(axis=1))
    mid, err, computed = np.empty((len(anchors), len(x))), np.empty((len(anchors), len(x))), 0
    for i, p in enumerate(parent):
        if p < 0:   # a root is scored with all
            at = np.arange(len(x))
            mid[i], err[i] = 0, 0
        else:
            mid[i], err[i] = mid[p], err[p] + length[i] * norms
            slack = err[i] * 1e-9 + np.abs(mid[i]) * 1e-12 + 1e-3   # rounding of lengths, norms and sums
            at = asked(i, mid[i] - err[i] - slack, mid[i] + err[i] + slack)
        if len(at):
            s = _scores(x if len(at) == len(x) else x[at], norms, anchors[i], float(own[i]))
            mid[i, at], err[i, at] = s, 0
            computed += len(at)
            found(i, at, s)
    return computed


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _by_dim(left: pa.Table, right: pa.Table):
    """For each dimension of both: anchors' rows in visiting order, candidates' rows, and both matrices."""
    left = left.sort_by("at")
    a, c = left.column("vector").combine_chunks(), right.column("vector").combine_chunks()
    da, dc = (v.value_lengths().to_numpy(zero_copy_only=False) for v in (a, c))
    parent = left.column("parent").to_numpy()
    for dim in np.intersect1d(da, dc):
        i, j = np.nonzero(da == dim)[0], np.nonzero(dc == dim)[0]
        shift = int(i[0])   # a dimension's anchors follow each other
        yield (left.slice(shift, len(i)), right.take(pa.array(j)), quantized(_matrix(a.slice(shift, len(i)), dim)),
               quantized(_matrix(c.take(pa.array(j)), dim)), np.where(parent[i] < 0, -1, parent[i] - shift))


def _numpy(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _positives(k: int):
    schema = pa.schema([("anchor", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for anchors, cands, a, x, parent in _by_dim(left, right):
            row, a_id, a_label, length = _numpy(anchors, "row", "id", "label", "length")
            c_id, c_label = _numpy(cands, "id", "label")

            def fits(i: int) -> np.ndarray:
                return (c_label == a_label[i]) & (c_id != a_id[i])

            def asked(i, lower, upper):
                at = np.nonzero(fits(i))[0]
                return at[upper[at] >= _kth(lower[at], k)]

            def found(i, at, s):
                keep = fits(i)[at]
                at, s = at[keep], s[keep]
                best = _first(c_id[at], s, k)
                out.append((np.full(len(best), row[i]), c_id[at[best]], s[best]))

            walk(a, parent, length, x, asked, found)
        return _rows(out, schema)

    return cell


def _window(score: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int]:
    """Least and greatest whole s with low * score <= s <= high * score, fractions given as (numerator, denominator)."""
    return -((-low[0] * score) // low[1]), (high[0] * score) // high[1]


def _negatives(k: int, low: tuple[int, int], high: tuple[int, int]):
    schema = pa.schema([("anchor", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("score", pa.int64())])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for anchors, cands, a, x, parent in _by_dim(left, right):
            row, a_label, length = _numpy(anchors, "row", "label", "length")
            c_id, c_label = _numpy(cands, "id", "label")
            windows = [[(p, *_window(p, low, high)) for p in sorted(set(ps or ()))] for ps in anchors.column("scores").to_pylist()]

            def asked(i, lower, upper):
                other = np.nonzero(c_label != a_label[i])[0]
                lower, upper = lower[other], upper[other]
                need = np.zeros(len(other), dtype=bool)
                for _, lo, hi in windows[i]:
                    if lo <= hi:
                        sure = _kth(lower[(lower >= lo) & (upper <= hi)], k)
                        need |= (upper >= max(lo, sure)) & (lower <= hi)
                return other[need]

            def found(i, at, s):
                keep = c_label[at] != a_label[i]
                at, s = at[keep], s[keep]
                for p, lo, hi in windows[i]:
                    inside = np.nonzero((s >= lo) & (s <= hi))[0]
                    best = inside[_first(c_id[at[inside]], s[inside], k)]
                    out.append((np.full(len(best), row[i]), np.full(len(best), p), c_id[at[best]], s[best]))

            walk(a, parent, length, x, asked, found)
        return _rows(out, schema)

    return cell


def _rows(parts: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(schema)
    return pa.table([pa.array(c, pa.int64()) for c in cols], schema=schema)


# ------------------------------------------------------------ on Spark


def _best(df: DataFrame, keys: list[str], id_: str, k: int) -> DataFrame:
    """The first ``k`` rows of each key by score, ties by smaller id, with their ``rank``."""
    w = W.partitionBy(*keys).orderBy(F.col("score").desc(), id_)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def eligible(vectors: DataFrame, vec_id: str, vector: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, vector) of the rows that take part; rows that repeat wholly are one."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("vector"))
    size = F.aggregate(F.col("vector"), F.lit(0.0), lambda s, x: s + F.pow(F.lit(float(scale)) * x.cast("double"), F.lit(2)))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad
                      & (size < LONGEST * LONGEST)).distinct()


def mine(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH,
         block: int = CANDIDATES, anchor_block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor``: a condition on ``id`` (the row's id as a long).  ``label``:
    the row's class (default: column ``label``); rows without one take no part,
    nor do those with a null id, a null vector, a null or non-finite component,
    or a scaled vector of length 2^31 or more, whose scores a long may not
    hold.  Rows equal in id, label and vector count once; rows that share an id
    otherwise are rows of their own, but never their namesake's positive.
    Vectors of different length never meet.  An anchor without a positive, and
    a positive without a negative in its window, give no row."""
    label = F.col("label") if label is None else label
    rows = staged(eligible(vectors, vec_id, vector, label), "vectors")
    # A vector's largest component: a cheap key that keeps near vectors in near places.
    top = F.expr("""transform(vector, (x, i) -> struct(abs(x) AS a, CASE WHEN x < 0 THEN -1 - i ELSE i END AS i))""")
    heads = rows.where(is_anchor).select("id", "label", "vector", F.lit(1).cast("long").alias("one"),
                                         F.coalesce(F.array_max(top)["i"], F.lit(0)).alias("side"), F.size("vector").alias("dim"),
                                         F.xxhash64("vector").alias("hash"))
    numbered = prefix_sums(heads, [], ["dim", "label", "side", "id", "hash"], "one", "row")
    blocked = numbered.select("row", "id", "label", "vector", F.floor(F.col("row") / anchor_block).cast("int").alias("a"))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocked.schema.fields)
    anchors = staged(blocked.groupBy("a").applyInArrow(_forest, f"{columns}, at int, parent int, length double"), "anchors")
    n_anchor_blocks, n_blocks = (max(1, -(-total // size)) for total, size in ((anchors.count(), anchor_block), (rows.count(), block)))
    cands = rows.withColumn("c", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(n_blocks)).cast("int"))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("c")

    def grid(left: DataFrame, right: DataFrame, cell, schema: str) -> DataFrame:
        return left.select("*", every_block).groupBy("a", "c").cogroup(right.groupBy("to", "c")).applyInArrow(cell, schema)

    held = anchors.select(F.col("label"), F.col("a").alias("to")).distinct()   # a row or two a block, or a row an anchor where labels are that many
    pairs = grid(anchors, cands.join(held, "label"), _positives(positives), "anchor long, positive_id long, score long")
    good = staged(_best(pairs, ["anchor"], "positive_id", positives).drop("rank"), "positives")
    asked = good.groupBy("anchor").agg(F.collect_set("score").alias("scores"))   # at most ``positives`` a group
    with_scores = anchors.join(asked, F.col("row") == F.col("anchor"), "left").drop("anchor")
    everywhere = cands.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_anchor_blocks - 1))).alias("to"))
    hard = grid(with_scores, everywhere, _negatives(negatives, low, high), "anchor long, positive_score long, negative_id long, score long")
    best = _best(hard, ["anchor", "positive_score"], "negative_id", negatives)
    return (good.select("anchor", "positive_id", F.col("score").alias("positive_score"))
            .join(best, ["anchor", "positive_score"])
            .join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")))
