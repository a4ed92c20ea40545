"""Secret scan (operator 7): wide candidates, false positives removed by a random forest.

Candidates are unbroken runs of 16 or more token characters, values of 6 or
more characters assigned to a name for secrets, and providers' formats.
Labelled findings come from rules that need the context or a provider's
format; the forest learns from them what secrets look like, and judges every
candidate.  What counts as a word is counted over all documents.  The fitted
trees are native expressions.  Texts are never shuffled: a scan finds all
candidates once, as a table of narrow rows, and masking is a projection of each text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bootlens.llm.common import fresh, hash_share, staged
from bootlens.llm.trees import forest_votes

#: Names that announce a secret, formats of providers, what a candidate looks like.
KEY_NAMES = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential|auth)"
ASSIGNED = KEY_NAMES + r"[A-Za-z_]{0,12}[\"']?\s{0,3}(=|:|=>|:=)\s{0,3}[\"']?$"
FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|sk_(live|test)_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,})$"
TOKEN = "[A-Za-z0-9_+/-]"
FORMAT = f"(?<!{TOKEN})(?:{FORMATS[1:-1]})(?!{TOKEN})"
#: Right after a name for secrets and its sign; the first lookbehind only saves the second one most of its work.
AFTER_NAME = r"(?<=[=:>\s\"'`])(?<=[=:>]\s{0,3}[\"'`]?)(?<=" + KEY_NAMES.replace("(?i)(", "(?i:", 1) + r"[A-Za-z_]{0,12}[\"']?\s{0,3}(?:=|:|=>|:=)\s{0,3}[\"'`]?)"
#: Six characters or more up to the closing quote; with spaces inside only if no long run is cut into.
QUOTED = "|".join(rf"(?<={q})(?:(?=(?:[^{q}\\\s]|\\.){{6}})(?:[^{q}\\\s]++|\\.)*+(?={q})|(?![^{q}\n]*{TOKEN}{{16}})(?=(?:[^{q}\\\n]|\\.){{6}})(?:[^{q}\\\n]++|\\.)*+(?={q}))" for q in "\"'`")
#: Without quotes: up to a space, a quote, a tag, the next field, or punctuation that ends a phrase; in a query string up to its & or #.
_PLAIN = r"[^\s\p{Z}\"'`,;.&<)\]}>]|[,;&](?!\s{0,3}[\"']?[A-Za-z_][A-Za-z0-9_.-]{0,40}[\"']?\s{0,3}[=:])(?!_END)|[.)\]}>](?!_END)|<(?![/!A-Za-z])".replace("_END", r"[,;.&)\]}>]{0,8}(?:[\s\p{Z}\"'`<]|\z)")
_QUERY = r"[^\s\p{Z}\"'`&#<>]"
UNQUOTED = rf"(?![=:>])(?:(?<=[?&;][A-Za-z0-9_.-]{{1,40}}=)(?={_QUERY}{{6}}){_QUERY}++|(?<![?&;][A-Za-z0-9_.-]{{1,40}}=)(?=(?:{_PLAIN}){{6}})(?:{_PLAIN})++)"
CANDIDATE = f"{FORMAT}|{AFTER_NAME}(?:{QUOTED}|{UNQUOTED})|(?<!{TOKEN}){TOKEN}{{16,}}={{0,2}}(?![A-Za-z0-9_+/=-])"

#: Documented bounds: labelled findings per class to fit on; characters of context on either side.
SAMPLE_PER_CLASS, BEFORE, AFTER = 5000, 48, 32
TREES, DEPTH, SEED, THRESHOLD, MASK = 16, 5, 11, 0.5, "[SECRET]"
#: Words of the dictionary: so many at most, those of the most documents; their letters; letters of the longest run that is parted into words.
DICTIONARY_WORDS, SHORTEST, LONGEST, PARTED = 4000, 2, 24, 62
#: Of splits that part a sample equally well a tree takes the first feature's, so length, which says least, comes last.
FEATURES = ("transitions", "dictionary_share", "digit_share", "upper_share", "distinct_share", "vowel_share", "named", "quoted", "assigned", "in_path", "n_slashes", "length")


def parts(text: Column) -> Column:
    """Struct of ``cands`` (candidates in order) and ``gaps`` (what lies around them, one more)."""
    return F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("cands"), F.split(text, CANDIDATE, -1).alias("gaps"))


def dictionary(docs: DataFrame, text: str = "text", limit: int = DICTIONARY_WORDS) -> list[str]:
    """The ``limit`` words of ASCII letters in the most documents (two at least), lower-cased, ties by word.

    A word stands between signs that are neither letters nor digits, so runs of letters inside random values are none.
    Words of all documents are counted, once a document, so a text that repeats a word has no more say than another."""
    word = F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}0-9]+"))).alias("word")
    counted = docs.select(word).where(F.col("word").rlike(f"^[a-z]{{{SHORTEST},{LONGEST}}}$")).groupBy("word").agg(F.count("*").alias("n"))
    return [r["word"] for r in counted.where("n > 1").orderBy(F.desc("n"), "word").limit(limit).collect()]  # limit rows at most


def covered(cand: Column, words: Sequence[str]) -> Column:
    """Letters of a candidate's pieces that are words of the dictionary, alone or written together.

    Pieces are runs of letters, cut before a capital that follows a small letter.  Bit e of a long
    says whether the first e letters of a piece are words."""
    known = lambda w: w.isin(*words)

    def together(p: Column) -> Column:
        word_to = lambda bits, e: F.exists(F.sequence(F.greatest(F.lit(0), e - LONGEST), e - SHORTEST), lambda i: (F.getbit(bits, i) == 1) & known(F.substring(p, i + 1, e - i)))
        one = F.lit(1).cast("long")
        bits = F.aggregate(F.sequence(F.lit(SHORTEST), F.length(p)), one,
                           lambda bits, e: F.when(word_to(bits, e), bits.bitwiseOR(F.call_function("shiftleft", one, e))).otherwise(bits))
        return F.getbit(bits, F.length(p)) == 1

    pieces = F.split(F.lower(F.regexp_replace(cand, "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+")
    word = lambda p: known(p) | F.when(F.length(p).between(2 * SHORTEST, PARTED), together(p)).otherwise(False)
    return F.aggregate(F.filter(pieces, word), F.lit(0), lambda n, p: n + F.length(p))


def features(cand: Column, before: Column, after: Column, words: Sequence[str]) -> list[Column]:
    """Features of a candidate between ``before`` and ``after``, in the order of FEATURES; ``words`` is the dictionary."""
    n = F.length(cand).cast("double")
    share = lambda pattern, of=cand: F.regexp_count(of, F.lit(pattern)) / n
    flag = lambda c: c.cast("double")
    return [
        share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]"), covered(cand, words) / n, share("[0-9]"), share("[A-Z]"),
        F.size(F.array_distinct(F.split(F.lower(cand), ""))) / n, share("(?i)[aeiou]"),
        flag(before.rlike(KEY_NAMES + r"[^\n]{0,24}$")), flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        flag(before.rlike(r"(=|:)\s{0,3}[\"']?$")), flag(before.rlike(r"(://|[./\\?&#])[^\s\"']*$")), share("/") * n, n,
    ]


def label(cand: Column, before: Column) -> Column:
    """1: a provider's format in it, or assigned to a name for secrets and mixed of digits and letters.
    0: only letters, only digits or few of either kind, or inside a URL or path.  Null: neither."""
    mixed = cand.rlike("[0-9]") & cand.rlike("[A-Za-z]")
    plain = (~mixed) | (F.regexp_count(cand, F.lit("[0-9]")) <= 2)
    return (F.when(cand.rlike(FORMAT) | (before.rlike(ASSIGNED) & mixed), 1)
            .when(plain | before.rlike(r"(://|www\.)[^\s\"']*$"), 0))


def _context(p: Column, i: Column) -> tuple[Column, Column, Column]:
    """A candidate, and the text around it; a long name is a candidate itself, so the one before belongs to the context."""
    before = F.concat(F.coalesce(F.right(F.get(p["cands"], i - 1), F.lit(BEFORE)), F.lit("")), p["gaps"][i])
    return p["cands"][i], F.right(before, F.lit(BEFORE)), F.left(p["gaps"][i + 1], F.lit(AFTER))


@dataclass
class Scanner:
    """A fitted scanner; without a forest (labels of one class only) the labelling rules decide alone."""

    model: object | None
    words: Sequence[str] = ()
    threshold: float = THRESHOLD

    def score(self, cand: Column, before: Column, after: Column) -> Column:
        """Share of trees that call it a secret; one with a provider's format in it is 1."""
        if self.model is None:
            return F.coalesce(label(cand, before), F.lit(0)).cast("double")
        values = F.struct(*[v.cast("double").alias(k) for k, v in zip(FEATURES, features(cand, before, after, self.words))])
        votes = F.transform(F.array(values), lambda f: forest_votes(self.model, [f[k] for k in FEATURES]))[0]
        return F.when(cand.rlike(FORMAT), 1.0).otherwise(votes)

    def findings(self, text: Column) -> Column:
        """Array of (start, length, candidate, score, is_secret), in order; ``start`` counts code points from 0."""
        def judged(p):
            at = F.sequence(F.lit(0), F.size(p["cands"]) - 1)
            each = F.transform(at, lambda i: F.struct(F.length(p["gaps"][i]).alias("gap"), p["cands"][i].alias("candidate"), self.score(*_context(p, i)).alias("score")))
            return F.when(F.size(p["cands"]) > 0, each)

        return F.transform(F.array(parts(text)), judged)[0]

    def masked(self, text: Column, mask: str = MASK) -> Column:
        """The text with every secret replaced."""
        def rebuilt(p):
            at = F.sequence(F.lit(0), F.size(p["cands"]) - 1)
            pieces = F.transform(at, lambda i: F.concat(p["gaps"][i], F.when(self.score(*_context(p, i)) >= self.threshold, F.lit(mask)).otherwise(p["cands"][i])))
            return F.concat(F.array_join(pieces, ""), F.element_at(p["gaps"], -1))

        return F.when(text.rlike(CANDIDATE), F.transform(F.array(parts(text)), rebuilt)[0]).otherwise(text)


def candidates(docs: DataFrame, doc_id: str | None = "doc_id", text: str = "text") -> DataFrame:
    """Every candidate of every text, found once and written: (row, doc_id, finding, gap, cand, before, after).

    ``row`` tells rows of ``docs`` apart, ``gap`` counts the code points since the candidate before."""
    key = F.col(doc_id).cast("long") if doc_id else F.lit(None).cast("long")
    rows = docs.select(key.alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(CANDIDATE))
    found = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", parts(F.col("text")).alias("p"))

    def each(i: Column) -> Column:
        return F.struct(F.length(F.col("p.gaps")[i]).alias("gap"), *[c.alias(n) for c, n in zip(_context(F.col("p"), i), ("cand", "before", "after"))])

    at = F.sequence(F.lit(0), F.size("p.cands") - 1)
    return staged(found.select("row", "doc_id", F.posexplode(F.transform(at, each)).alias("finding", "x")).select("row", "doc_id", "finding", "x.*"), "candidates")


def fit(docs: DataFrame, text: str = "text", per_class: int = SAMPLE_PER_CLASS, found: DataFrame | None = None) -> Scanner:
    """Fit the forest on about ``per_class`` distinct labelled findings a class, drawn by their hash.

    Candidates of all documents (``found``, or found here) are labelled; the sample is taken from them."""
    found = candidates(docs, None, text) if found is None else found
    labelled = staged(found.select("cand", "before", "after", label(F.col("cand"), F.col("before")).alias("label")).where("label is not null").distinct(), "labelled")
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Scanner(None)
    words = dictionary(docs, text)
    value = F.concat_ws("\n", "before", "cand", "after")
    sample = labelled.where(F.when(F.col("label") == 1, hash_share(value, per_class, sizes[1])).otherwise(hash_share(value, per_class, sizes[0])))
    sample = sample.orderBy("cand", "before", "after")
    columns = features(F.col("cand"), F.col("before"), F.col("after"), words)
    sample = staged(sample.select(F.col("label").cast("double").alias("label"), *[c.cast("double").alias(k) for k, c in zip(FEATURES, columns)]), "findings")
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.coalesce(1))
    return Scanner(RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32).fit(assembled.select("label", "features")), words)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """(doc_id, finding, start, length, candidate_sha256, score, is_secret), one row per candidate.

    ``finding`` numbers a document's candidates from 0, ``start`` counts code
    points.  Null and empty texts and texts without candidates have no rows.
    Rows that repeat a document give their findings again.  Other columns are
    ignored.  Candidates are found once; labels, scores and positions come from
    their table, positions as running sums over the candidates of one text."""
    found = candidates(docs, doc_id, text)
    scanner = fit(docs, text, found=found, **bounds)
    scored = found.withColumn("score", scanner.score(F.col("cand"), F.col("before"), F.col("after")))
    size = F.length("cand").cast("long")
    end = F.sum(F.col("gap") + size).over(W.partitionBy("row").orderBy("finding").rowsBetween(W.unboundedPreceding, W.currentRow))
    return scored.select("doc_id", F.col("finding").cast("long").alias("finding"), (end - size).alias("start"), size.alias("length"),
                         F.sha2("cand", 256).alias("candidate_sha256"), "score", (F.col("score") >= scanner.threshold).alias("is_secret"))


def mask_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **bounds) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and, if given, ``n_chars`` set to the new length where it changed."""
    scanner = fit(docs, text, **bounds)
    masked = scanner.masked(F.col(text))
    if not n_chars or n_chars not in docs.columns:
        return docs.select(*[masked.alias(c) if c == text else F.col(c) for c in docs.columns])
    new = fresh(docs, "masked")
    both = docs.withColumn(new, masked)
    size = F.when(F.col(new) != F.col(text), F.length(new).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars))
    return both.select(*[F.col(new).alias(c) if c == text else size.alias(c) if c == n_chars else F.col(c) for c in docs.columns])
