"""Quality classifier (operator 13): attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words; only the bag has a label.
Every passage is encoded (shares of character classes, of their hashed pairs
and of hashed letter trigrams, and how its words repeat) and mapped to a hidden
vector h.  Gated attention weighs the passages,
``a ~ softmax(w . (tanh(V h) * sigmoid(G h)))``, and the document's score reads
the weighted sum of their hidden vectors.  All weights are learnt together from
document labels by Adam in numpy, so a few junk passages between clean ones can
decide, and the attention says which.

As the score is linear in the weighted sum, a passage only has to hand on its
attention and its own reading: any number of passages of a text is two numbers
each.
"""

from __future__ import annotations

import io
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from bootlens.llm.common import hash_share, staged

PASSAGE = 64                       # words
HIDDEN, GATE = 32, 16
PAIRS, TRIGRAMS, STATS = 256, 512, 12
#: Documented bound of the training sample: documents per class, and passages of one (spread evenly over its whole text).
PER_CLASS, PASSAGES = 2000, 16
EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 12, 1500, 32, 6e-3, 1e-4, 11   # epochs, but at least so many steps
THRESHOLD = 0.3
#: Characters that are encoded at once; a longer text is cut behind a word.
AT_ONCE = 1 << 19
SPACE = regex.compile(r"[\x20\x09-\x0D]")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE_CLASS, LOWER, UPPER, DIGIT, OTHER = 0, 1, 2, 3, 4
CLASSES = 5 + len(PUNCTUATION)
WIDTH = STATS + CLASSES + PAIRS + TRIGRAMS


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point of the basic plane (others: a letter, itself)."""
    kind, low = np.full(1 << 16, OTHER, dtype=np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat[0] in "LM":
            kind[c] = UPPER if cat in ("Lu", "Lt") else LOWER
            small = ch.lower()
            low[c] = ord(small) if len(small) == 1 else c
        elif cat[0] == "N":
            kind[c] = DIGIT
    for k, ch in enumerate(PUNCTUATION):
        kind[ord(ch)] = 5 + k
    kind[[9, 10, 11, 12, 13, 32]] = SPACE_CLASS
    return kind, low


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashed(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x * _MIX) >> np.uint64(40)).astype(np.int64) % buckets


def _shares(passage: np.ndarray, bucket: np.ndarray, n: int, width: int) -> np.ndarray:
    """Square roots of the shares of each passage's buckets."""
    counts = np.bincount(passage * width + bucket, minlength=n * width).reshape(n, width)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, index of its text); a text without a word is one passage of zeros."""
    kinds, lower = _classes()
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    text_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    low = np.minimum(points, 0xFFFF)
    kind = np.where(points > 0xFFFF, LOWER, kinds[low])
    folded = np.where(points > 0xFFFF, points, lower[low]).astype(np.uint64)
    space = kind == SPACE_CLASS
    start = ~space & np.concatenate(([True], space[:-1]))
    at = np.nonzero(start)[0]
    word_text = text_of[at]
    first = np.searchsorted(word_text, np.arange(len(texts)))      # a text's first word
    number = np.arange(len(at)) - first[word_text]
    begins = (number % PASSAGE == 0)
    passage_of_word = np.cumsum(begins) - 1
    has = np.bincount(word_text, minlength=len(texts)) > 0
    owner = word_text[begins]
    n = len(owner)
    word = np.cumsum(start) - 1
    used = (word >= 0) & (word_text[np.maximum(word, 0)] == text_of) if len(at) else np.zeros(len(points), dtype=bool)
    p = passage_of_word[word[used]] if len(at) else np.zeros(0, np.int64)
    k, f, sp = kind[used].astype(np.int64), folded[used], space[used]

    def within(width: int) -> np.ndarray:
        return p[:len(p) - width + 1] == p[width - 1:]

    unit = np.bincount(p * CLASSES + k, minlength=n * CLASSES).reshape(n, CLASSES)
    chars = np.maximum(unit.sum(axis=1), 1)
    same = within(2) if len(p) > 1 else np.zeros(0, dtype=bool)
    pair = _hashed((k[:-1] * CLASSES + k[1:] + 1).astype(np.uint64)[same], PAIRS) if len(p) > 1 else np.zeros(0, np.int64)
    pairs = _shares(p[:-1][same], pair, n, PAIRS) if len(p) > 1 else np.zeros((n, PAIRS))
    if len(p) > 2:
        inside = within(3) & ~sp[1:-1] & ~(sp[:-2] & sp[2:])
        tri = _hashed(((f[:-2] * np.uint64(0x100000001B3) + f[1:-1]) * np.uint64(0x100000001B3) + f[2:] + np.uint64(1))[inside], TRIGRAMS)
        trigrams = _shares(p[:-2][inside], tri, n, TRIGRAMS)
    else:
        trigrams = np.zeros((n, TRIGRAMS))
    stats = np.zeros((n, STATS))
    if n:
        own, sign = word[used], ~sp
        spot = np.nonzero(used)[0] - at[own]
        weight = (np.uint64(0x100000001B3) ** np.arange(1, min(4096, int(spot.max()) + 1) + 1, dtype=np.uint64))
        digest = np.zeros(len(at), dtype=np.uint64)
        np.add.at(digest, own[sign], (f[sign] + np.uint64(1)) * weight[np.minimum(spot[sign], len(weight) - 1)])
        words = np.bincount(passage_of_word, minlength=n)
        repeat = np.concatenate(([False], (digest[1:] == digest[:-1]) & (passage_of_word[1:] == passage_of_word[:-1])))
        order = np.lexsort((digest, passage_of_word))
        fresh = np.concatenate(([True], (digest[order][1:] != digest[order][:-1]) | (passage_of_word[order][1:] != passage_of_word[order][:-1])))
        letters = np.maximum(unit[:, LOWER] + unit[:, UPPER], 1)
        marks = unit[:, 5:].sum(axis=1)
        marked = np.zeros(len(at), dtype=bool)
        marked[own[k >= OTHER]] = True
        long_words = np.bincount(own[sign], minlength=len(at))
        newline = np.bincount(p[f == 10], minlength=n)
        share = lambda flags: np.bincount(passage_of_word[flags], minlength=n) / words
        stats = np.stack([
            np.ones(n), unit[:, UPPER] / letters, unit[:, DIGIT] / chars, marks / chars, unit[:, OTHER] / chars, unit[:, SPACE_CLASS] / chars,
            np.minimum(1, np.bincount(p[sign], minlength=n) / words / 20), np.bincount(passage_of_word[order][fresh], minlength=n) / words, share(repeat), share(marked),
            share(long_words > 15), np.minimum(1, newline / words)], axis=1)
    x = np.concatenate([stats, np.sqrt(unit / chars[:, None]), pairs, trigrams], axis=1).astype(np.float32)
    bare = np.nonzero(~has)[0]
    return np.concatenate([x, np.zeros((len(bare), WIDTH), np.float32)]), np.concatenate([owner, bare])


def pieces(text: str | None) -> Iterator[str]:
    """A whole text in pieces of about ``AT_ONCE`` characters, cut behind words."""
    text, a = text or "", 0
    while len(text) - a > AT_ONCE:
        cut = SPACE.search(text, a + AT_ONCE)
        b = cut.end() if cut else len(text)
        yield text[a:b]
        a = b
    if a < len(text) or not text:
        yield text[a:]


def encoded(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``encode`` over pieces of about ``AT_ONCE`` characters in all; the index names the text in ``texts``."""
    pending, owner, size = [], [], 0
    for k, text in enumerate(texts):
        for part in pieces(text):
            if pending and size + len(part) > AT_ONCE:
                x, at = encode(pending)
                yield x, np.array(owner)[at]
                pending, owner, size = [], [], 0
            pending.append(part)
            owner.append(k)
            size += len(part) + 1
    if pending:
        x, at = encode(pending)
        yield x, np.array(owner)[at]


# ------------------------------------------------------------ the model


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Model:
    """``embed``, ``shift``: features to hidden vectors; ``view``, ``gate``, ``attend``: gated attention; ``read``, ``bias``: the score."""

    embed: np.ndarray
    shift: np.ndarray
    view: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    read: np.ndarray
    bias: np.ndarray

    @staticmethod
    def blank(rng: np.random.Generator, bias: float = 0.0) -> Model:
        return Model(rng.normal(0, 0.2, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, (HIDDEN, GATE)), rng.normal(0, 0.3, (HIDDEN, GATE)),
                     rng.normal(0, 0.3, GATE), rng.normal(0, 0.3, HIDDEN), np.array([bias]))

    @staticmethod
    def constant(share: float) -> Model:
        """A model without labels of both kinds: the share of good ones for any text."""
        m = Model(np.zeros((WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, GATE)), np.zeros((HIDDEN, GATE)), np.zeros(GATE), np.zeros(HIDDEN), np.zeros(1))
        m.bias[0] = np.log(share / (1 - share))
        return m

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        return Model(**{f.name: z[f.name] for f in fields(Model)})

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(attention before the softmax, own reading) of each passage."""
        h = np.tanh(x @ self.embed + self.shift)
        return (np.tanh(h @ self.view) * _sigmoid(h @ self.gate)) @ self.attend, h @ self.read

    def score(self, attention: np.ndarray, reading: np.ndarray) -> float:
        a = np.exp(attention - attention.max())
        return float(_sigmoid((a @ reading) / a.sum() + self.bias[0]))


def _loss_and_gradients(m: Model, x: np.ndarray, cuts: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Weighted log loss of bags (``cuts``: the first passage of each) and its gradients."""
    sizes = np.diff(np.append(cuts, len(x)))
    h = np.tanh(x @ m.embed + m.shift)
    t, s = np.tanh(h @ m.view), _sigmoid(h @ m.gate)
    e = (t * s) @ m.attend
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, cuts), sizes))
    a /= np.repeat(np.add.reduceat(a, cuts), sizes)
    own = h @ m.read
    logit = np.add.reduceat(a * own, cuts) + m.bias[0]
    p = _sigmoid(logit)
    loss = -(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / weight.sum()
    g = weight * (p - y) / weight.sum()
    gp = np.repeat(g, sizes)
    de = gp * a * (own - np.repeat(logit - m.bias[0], sizes))
    dts = de[:, None] * m.attend
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    dh = (gp * a)[:, None] * m.read + dt @ m.view.T + ds @ m.gate.T
    dz = dh * (1 - h * h)
    return loss, Model(x.T @ dz, dz.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ de, h.T @ (gp * a), np.array([g.sum()]))


def train(bags: list[np.ndarray], labels: list[int], prior: float, seed: int = SEED) -> Model:
    """Fit on bags of passages; ``prior`` is the share of label 1 among all labelled documents, to which classes are weighed back.

    Every fifth bag is held back; the epoch that reads them best is kept."""
    y = np.array(labels, dtype=np.float64)
    if not 0 < y.sum() < len(y):
        n = len(y)
        return Model.constant((y.sum() + 1) / (n + 2))
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    m = Model.blank(rng, float(np.log(prior / (1 - prior))))
    names = [f.name for f in fields(m)]
    first = {c: np.zeros_like(getattr(m, c)) for c in names}
    second = {c: np.zeros_like(getattr(m, c)) for c in names}
    back = np.arange(0, len(bags), 5) if len(bags) >= 50 else np.arange(0)
    used = np.setdiff1d(np.arange(len(bags)), back)

    def batch(rows):
        sizes = [len(bags[k]) for k in rows]
        return np.concatenate([bags[k] for k in rows]).astype(np.float64), np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64), y[rows], weight[rows]

    per_epoch = -(-len(used) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // per_epoch))
    steps, step, best, kept = epochs * per_epoch, 0, np.inf, m.pack()
    for _ in range(epochs):
        order = rng.permutation(used)
        for at in range(0, len(order), BATCH):
            step += 1
            _, grad = _loss_and_gradients(m, *batch(order[at:at + BATCH]))
            lr = RATE * (1 - (step - 1) / steps)
            for c in names:
                g, w = getattr(grad, c), getattr(m, c)
                first[c] = 0.9 * first[c] + 0.1 * g
                second[c] = 0.999 * second[c] + 0.001 * g * g
                w -= lr * (first[c] / (1 - 0.9 ** step) / (np.sqrt(second[c] / (1 - 0.999 ** step)) + 1e-8) + DECAY * w)
        if len(back):
            loss = sum(_loss_and_gradients(m, *batch(back[a:a + 256]))[0] * weight[back[a:a + 256]].sum() for a in range(0, len(back), 256))
            if loss < best:
                best, kept = loss, m.pack()
        else:
            kept = m.pack()
    return Model.unpack(kept)


# ------------------------------------------------------------ on Spark


def held_out(doc_id: Column) -> Column:
    """The documents no model learns from: crc32 of the id as text, modulo 5, is 0 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Train on (doc_id, text) and (doc_id, label 0 / 1) rows.

    Labels are counted over all rows; a hash of the id picks about
    ``per_class`` of each.  Their documents are encoded where they lie; the
    model is made in one task from that bounded sample."""
    known = staged(labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").cast("int").alias("label")), "labels")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}   # two rows at most
    total = sum(sizes.values())
    if not total:
        return Model.constant(0.5)
    chosen = F.lit(False)
    for label, n in sizes.items():
        chosen = chosen | ((F.col("label") == label) & hash_share(F.col("doc_id"), per_class, n))
    sample = docs.join(staged(known.where(chosen), "labels-chosen"), "doc_id").select(F.col("doc_id").cast("string").alias("key"), "text", "label")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text, label in zip(*(c.to_pylist() for c in b.columns)):
                x = np.concatenate([part for part, _ in encoded([text])])
                x = x[np.unique(np.linspace(0, len(x) - 1, min(len(x), PASSAGES)).round().astype(int))]
                yield pa.RecordBatch.from_pydict({"key": pa.array([key]), "label": pa.array([label], pa.int32()), "x": pa.array([x.astype(np.float16).tobytes()], pa.binary())})

    ready = staged(sample.mapInArrow(bags, "key string, label int, x binary"), "bags")
    prior = min(1 - 1e-3, max(1e-3, sizes.get(1, 0) / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((k, y, x) for b in batches for k, y, x in zip(*(c.to_pylist() for c in b.columns)))
        m = train([np.frombuffer(x, dtype=np.float16).reshape(-1, WIDTH) for *_, x in rows], [y for _, y, _ in rows], prior)
        yield pa.RecordBatch.from_pydict({"model": pa.array([m.pack()], pa.binary())})

    return Model.unpack(bytes(ready.coalesce(1).mapInArrow(run, "model binary").first()[0]))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, passages, top_passage), one row per input row, from whole texts.

    ``top_passage`` is the place of the passage with the most attention.  Null
    texts are empty; a text without a word is one passage without features."""
    shared = docs.sparkSession.sparkContext.broadcast(model.pack())   # WIDTH x HIDDEN doubles
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.int64()), ("top_passage", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.unpack(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                parts = [(own, *m.passages(x)) for x, own in encoded(part.column(1).to_pylist())]
                own, e, g = (np.concatenate(c) for c in zip(*parts))
                order = np.argsort(own, kind="stable")
                cuts = np.searchsorted(own[order], np.arange(part.num_rows + 1))
                rows = [order[i:j] for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.score(e[r], g[r]) for r in rows], pa.float64()), pa.array([len(r) for r in rows], pa.int64()),
                                                  pa.array([int(e[r].argmax()) for r in rows], pa.int64())], schema=schema)

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, "doc_id long, score double, passages long, top_passage long"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
             per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages, top_passage): learn from labels of documents not held out, score all.

    A document with both labels counts as 0; labels other than 0 and 1 are none."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where(~held_out(F.col("doc_id")))
    scored = predict(rows, fit(rows, known, per_class))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages", "top_passage")
