"""Quality rules (operator 9): a table of thresholds, compiled into one projection.

``measures`` are Spark expressions over one text; ``RULES`` bounds them.  No
user functions, no shuffle: every row is judged from its own text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bootlens.llm.common import SPACE

#: Frequent words of the corpus languages.
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "de", "la", "le", "et", "les", "des", "der", "die", "und", "das", "ist", "den", "el", "en", "que", "los", "y")


@dataclass(frozen=True)
class Rule:
    """Keep a text while ``low <= measure <= high``; a bound of None does not bind."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production thresholds.
RULES = (
    Rule("n_words", 50, None),
    Rule("repeat_ratio", None, 0.5),
    Rule("mean_word_chars", 2, 12),
    Rule("symbol_ratio", None, 0.15),
    Rule("stop_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.5),
)
BASE_RULES = RULES[:2]


def counts(text: Column) -> Column:
    """Struct of the counts of one text (null: no words).

    n_words; word_chars (code points in words); n_symbols (characters of
    ``#*$%&|<>``); n_lines (lines with a word); n_dup_lines (those equal to an
    earlier line); n_stop (words of STOP_WORDS, lower-cased);
    n_repeat_words (words inside 3-word windows that occur twice or more in
    the text, the first time included)."""
    t = F.coalesce(text, F.lit(""))
    # lambdas are evaluated once per element, so each array is bound to a field once and used from there
    base = F.struct(
        t.alias("t"),
        F.filter(F.split(t, SPACE), lambda w: w != "").alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("l"))
    return _bind(base, lambda b: F.struct(
        F.size(b["w"]).cast("long").alias("n_words"),
        F.length(F.regexp_replace(b["t"], SPACE, "")).cast("long").alias("word_chars"),
        (F.length(b["t"]) - F.length(F.regexp_replace(b["t"], r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size(b["l"]).cast("long").alias("n_lines"),
        (F.size(b["l"]) - F.size(F.array_distinct(b["l"]))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(b["w"], lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        _repeat_words(b["w"]).alias("n_repeat_words")))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur more than once.

    Windows are told apart by hash first: no equal hashes, no repeats.  Else
    (hash, window, position) are sorted, windows equal to a neighbour in that
    order are repeats, and their positions are added up without overlap."""
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def repeats(w, h):
        order = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.struct(
            h[i].alias("h"), F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("s"), i.alias("i"))))
        same = lambda a, b: (a["h"] == b["h"]) & (a["s"] == b["s"])
        at = _bind(order, lambda o: F.sort_array(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda k: ((k > 0) & same(o[k], F.get(o, k - 1))) | ((k < F.size(o) - 1) & same(o[k], F.get(o, k + 1)))),
            lambda k: o[k]["i"])))
        return _bind(at, lambda p: F.aggregate(
            p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
            lambda acc: acc["n"]))

    none = F.lit(0).cast("long")
    return F.when(F.size(words) < 4, none).otherwise(_bind(hashed(words), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), none).otherwise(repeats(words, h))))


def measures(c: Column) -> dict[str, Column]:
    """What rules can bound, from a ``counts`` struct; ratios of texts without words or lines are 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(c[a].cast("double"), c[b].cast("double")), F.lit(0.0))
    return {
        "n_words": c["n_words"].cast("double"), "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "mean_word_chars": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "word_chars"),
        "stop_ratio": ratio("n_stop", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
    }


def passes(c: Column, rules: Sequence[Rule] = RULES) -> Column:
    """True where no rule is broken."""
    of, ok = measures(c), F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (of[r.measure] >= F.lit(float(r.low)))
        if r.high is not None:
            ok = ok & (of[r.measure] <= F.lit(float(r.high)))
    return ok


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, counts, base_failed, kept), one row per input row.

    ``base_failed``: under 50 words, or more than half of the words repeat.
    ``kept``: not base_failed and all ``rules`` hold.  Null and empty texts
    have no words and fail.  Other columns are ignored."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), counts(F.col(text)).alias("c"))
    c = F.col("c")
    failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    return rows.select("doc_id", "c.n_words", "c.word_chars", "c.n_symbols", "c.n_dup_lines", "c.n_repeat_words",
                       failed.alias("base_failed"), (~failed & passes(c, rules)).alias("kept"), "c.n_lines", "c.n_stop")


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are."""
    c = counts(F.col(text))
    failed = lambda c: (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    return docs.where(_bind(c, lambda c: ~failed(c) & passes(c, rules)))
