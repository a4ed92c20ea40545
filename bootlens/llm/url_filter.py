"""URL filter (operator 5): rules first, gradient-boosted trees for what no rule fits.

The trees see lexical features only: length, depth, digit ratio, entropy,
parameter counts and statistics of the host's suffix.  They are trained from
labelled URLs and compiled into a native expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from bootlens.llm.common import hash_share, staged
from bootlens.llm.trees import boosted_margin

#: Documented bound: labelled URLs per class to fit on.
SAMPLE_PER_CLASS = 5000
TREES, DEPTH, SEED = 12, 3, 7
#: Parts of the labelled URLs; statistics for a training row leave its own part out.
FOLDS = 5
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "n_params", "param_length", "n_hyphens", "suffix_share", "suffix_block", "lead_share", "lead_block")


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty for no URL."""
    raw = F.regexp_extract(rest_of(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty for no URL."""
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # a longer rule is asked before the shorter ones
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits: lengths of equal runs in the sorted characters."""
    sorted_chars = F.array_sort(F.split(text, ""))
    n = F.length(text)

    def runs(c):
        ends = F.filter(F.sequence(F.lit(1), F.size(c)), lambda i: (i == F.size(c)) | (F.get(c, i) != F.get(c, i - 1)))
        return F.transform(F.array(ends), lambda e: F.aggregate(
            F.sequence(F.lit(0), F.size(e) - 1), F.lit(0.0),
            lambda acc, k: acc - _bits((F.get(e, k) - F.coalesce(F.get(e, k - 1), F.lit(0))) / n)))[0]

    return F.when(n > 0, F.transform(F.array(sorted_chars), runs)[0]).otherwise(0.0)


def _bits(p: Column) -> Column:
    return p * F.log2(p)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    query = F.regexp_extract(F.coalesce(rest_of(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    whole = F.coalesce(url, F.lit(""))
    length = F.length(whole)
    return {
        "length": length, "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.regexp_count(path, F.lit("/[^/]")), "labels": F.regexp_count(host, F.lit("[^.]+")),
        "digit_ratio": F.when(length > 0, F.regexp_count(whole, F.lit("[0-9]")) / length).otherwise(0.0),
        "entropy": entropy(whole), "n_params": F.regexp_count(query, F.lit("[^&]+")), "param_length": F.length(query),
        "n_hyphens": F.regexp_count(whole, F.lit("[-_]")),
    }


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def lead_of(path: Column) -> Column:
    """First segment of a path."""
    return F.regexp_extract(path, "^/([^/]*)", 1)


def fold_of(url: Column) -> Column:
    """The part of the URLs, by hash, whose labels a training row of the same part does not see."""
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS)).cast("int")


def _counted(rows: DataFrame, value: Column, n: int, rate: float, name: str) -> DataFrame:
    """(value, share, block, out) of every value: its share of all rows, the block rate of its labelled rows drawn to
    ``rate``, and that rate without the labels of each fold."""
    stats = rows.groupBy(value.alias("_value"), fold_of(F.col("url")).alias("_fold")).agg(
        F.count("*").alias("n"), F.count("label").alias("l"), F.coalesce(F.sum("label"), F.lit(0)).alias("b"))
    sums = stats.groupBy("_value").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"),
                                       *[F.struct(*[F.coalesce(F.sum(F.when(F.col("_fold") == k, F.col(c))), F.lit(0)).alias(c) for c in ("l", "b")]).alias(f"_f{k}") for k in range(FOLDS)])
    drawn = lambda b, l: (b + rate) / (l + 1)  # noqa: E731, E741
    out = F.array(*[drawn(F.col("b") - F.col(f"_f{k}.b"), F.col("l") - F.col(f"_f{k}.l")) for k in range(FOLDS)])
    return staged(sums.select("_value", (F.col("n") / n).alias("_share"), drawn(F.col("b"), F.col("l")).alias("_block"), out.alias("_out")), name)


def _looked_up(value: Column, stats: DataFrame | None, rate: float, fold: Column | None = None) -> list[Column]:
    """(share, block rate) of a value; values without statistics have share 0 and the overall rate.

    With ``fold`` the rate is that of the other folds' labels.  A correlated
    subquery: Spark plans it as an equi-join of the rows with the table.
    ``max`` says that a value has one row there."""
    if stats is None:
        return [F.lit(0.0), F.lit(rate)]
    found = stats.where(F.col("_value").eqNullSafe(value)).select(F.max(F.struct("_share", "_block", "_out")).alias("_found")).scalar()
    return [F.coalesce(found["_share"], F.lit(0.0)), F.coalesce(found["_block"] if fold is None else found["_out"][fold], F.lit(rate))]


@dataclass
class Judge:
    """A fitted filter; ``suffixes`` of hosts and ``leads`` of paths are tables of every counted value's share and block rate."""

    suffixes: DataFrame | None
    leads: DataFrame | None
    rate: float
    model: object | None

    def features(self, f: Column, host: Column, path: Column, fold: Column | None = None) -> list[Column]:
        """Features in the order of FEATURES; ``host`` and ``path`` are plain columns of the rows.

        Training rows give their ``fold``: statistics that held a row's own
        label would tell it the answer."""
        return ([f[k].cast("double") for k in FEATURES[:-4]] + _looked_up(suffix_of(host.outer()), self.suffixes, self.rate, fold)
                + _looked_up(lead_of(path.outer()), self.leads, self.rate, fold))

    def blocks(self, features: Sequence[Column]) -> Column:
        if self.model is None:  # one class only, or no labels
            return F.lit(self.rate > 0.5)
        return boosted_margin(self.model, features) > 0


def fit(rows: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Judge:
    """Fit on (url, host, path, f, label): label 1 to block, 0 to allow, null unlabelled.

    Shares of host suffixes and of first path segments are counted over all
    rows and block rates over all labelled ones, and all are kept.  A training row
    sees the block rates of the other folds only.  The trees are fitted on about ``per_class`` distinct labelled URLs a class, drawn by a
    hash of the URL."""
    n, labelled, blocked = rows.agg(F.count("*"), F.count("label"), F.sum("label")).first()
    if not labelled or not blocked or blocked == labelled:
        return Judge(None, None, float(bool(blocked)), None)
    rate = blocked / labelled
    judge = Judge(_counted(rows, suffix_of(F.col("host")), n, rate, "suffixes"), _counted(rows, lead_of(F.col("path")), n, rate, "leads"), rate, None)
    known = staged(rows.where("label is not null").select("url", "host", "path", "f", "label").distinct(), "labelled")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("label") == c).where(hash_share(F.col("url"), per_class, sizes[c])) for c in (0, 1)]
    columns = judge.features(F.col("f"), F.col("host"), F.col("path"), fold_of(F.col("url")))
    sample = staged(parts[0].union(parts[1]).orderBy("url").select(F.col("label").cast("double").alias("label"), *[c.alias(k) for k, c in zip(FEATURES, columns)]), "sample")
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.coalesce(1))
    judge.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32).fit(assembled.select("label", "features"))
    return judge


def filter_urls(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", **bounds) -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked_by_trees), one row per input row.

    ``verdict`` is the longest fitting rule's, else the trees'.  URLs that a
    rule judges are the labelled ones the trees learn from.  Null URLs and
    those without ``://`` have empty host and path; no rule fits, the trees
    judge them.  Without labelled URLs of both classes, the rest gets the
    verdict of the only class (allow if there is none)."""
    u = F.col("url")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.select("page_id", "url", host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.select("*", matched(F.col("host"), F.col("path"), rules).alias("rule"))
    verdict_of = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.verdict)])
    rows = rows.select("*", verdict_of[F.col("rule")].alias("given"), F.struct(*[c.alias(k) for k, c in lexical(u, F.col("host"), F.col("path")).items()]).alias("f"))
    rows = staged(rows.select("*", (F.col("given") == "block").cast("int").alias("label")), "urls")
    judge = fit(rows, **bounds)
    scored = rows.select("*", *[c.alias(f"_{k}") for k, c in zip(FEATURES, judge.features(F.col("f"), F.col("host"), F.col("path")))])
    judged = scored.select("page_id", "host", "path", "rule", "given", judge.blocks([F.col(f"_{k}") for k in FEATURES]).alias("blocked_by_trees"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("blocked_by_trees"), "block").otherwise("allow")).alias("verdict"), "blocked_by_trees")
