"""Language identification (operator 6): averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its words' character n-grams,
hashed into ``BUCKETS`` rows; a linear softmax reads the language from it.
Embeddings and weights are trained together by stochastic gradient descent in
numpy on a bounded sample.  The scores are calibrated on held-back documents of
the sample: a temperature, and a score below which a prediction is rejected.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from bootlens.llm.common import BoundedCache, staged

LETTERS = regex.compile(r"\p{L}+")
#: Model size and documented bound of the training sample (documents per language).
BUCKETS, DIMS, GRAMS, PER_LABEL = 1 << 15, 16, (1, 2, 3, 4), 400
EPOCHS, STEPS, BATCH, RATE, SEED = 8, 800, 16, 20.0, 5  # epochs, but at least so many steps
#: The rejection score is the lowest at which at most this share of the held-back predictions that pass it is wrong.
TOLERATED = 0.02
UNKNOWN = "und"
LONGEST = 200


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def gram_buckets(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of many words: bucket numbers, and the word each belongs to.

    Words are framed by ``<`` and ``>``; n-grams are hashed by a rolling polynomial over code points."""
    framed = [f"<{w}>" for w in words]
    sizes = np.array([len(w) for w in framed], dtype=np.int64)
    points = np.frombuffer("".join(framed).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    found, own = [], []
    value = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        usable = len(points) - n + 1
        if usable <= 0:
            break
        value = value[:usable] * np.uint64(0x100000001B3) + points[n - 1:] + np.uint64(1)
        if n in GRAMS:
            inside = owner[:usable] == owner[n - 1:]
            mixed = value[inside] * np.uint64(0x9E3779B97F4A7C15)
            found.append(((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64))
            own.append(owner[:usable][inside])
    return (np.concatenate(found), np.concatenate(own)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bag(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text with their shares."""
    counts = Counter(words_of(text))
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0)
    found, own = gram_buckets(list(counts), buckets)
    weight = np.bincount(found, weights=np.array(list(counts.values()), dtype=np.float64)[own], minlength=buckets)
    at = np.nonzero(weight)[0]
    return at, weight[at] / weight.sum()


@dataclass
class Model:
    """``scores``: logits that one n-gram of a bucket adds; ``bias``; calibration."""

    labels: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, labels=np.array(self.labels, dtype=str), scores=self.scores, bias=self.bias, calibration=np.array([self.temperature, self.reject_below]))
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        return Model([str(x) for x in z["labels"]], z["scores"], z["bias"], *map(float, z["calibration"]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], buckets: int = BUCKETS, dims: int = DIMS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Fit and calibrate; every fifth text is held back for the calibration."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    bags = [(*_bag(t, buckets), names.index(y)) for t, y in zip(texts, labels)]
    bags = [b for b in bags if len(b[0])]
    held, used = bags[::5], [b for k, b in enumerate(bags) if k % 5] or bags
    table = rng.normal(0, 0.1, (buckets, dims))
    weights, bias = rng.normal(0, 0.1, (dims, len(names))), np.zeros(len(names))
    per_epoch = max(1, -(-len(used) // BATCH))
    epochs = max(epochs, -(-STEPS // per_epoch)) if used else 0
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        order = rng.permutation(len(used))
        for a in range(0, len(order), BATCH):
            part = [used[k] for k in order[a:a + BATCH]]
            lr = rate * (1 - step / steps)
            step += 1
            x = np.stack([share @ table[at] for at, share, _ in part])
            grad = _softmax(x @ weights + bias)
            grad[np.arange(len(part)), [y for *_, y in part]] -= 1
            grad /= len(part)
            back = grad @ weights.T
            weights -= lr * 0.1 * (x.T @ grad)
            bias -= lr * 0.01 * grad.sum(axis=0)
            for (at, share, _), g in zip(part, back):
                table[at] -= lr * share[:, None] * g
    model = Model(names, table @ weights, bias)
    if held:
        logits = np.stack([share @ model.scores[at] for at, share, _ in held]) + bias
        truth = np.array([y for *_, y in held])
        doubt = 1 / (len(held) + 2)  # no finite sample shows that nothing is wrong

        def loss(t: float) -> float:
            logs = np.log(np.maximum(_softmax(logits / t), 1e-300))
            own = logs[np.arange(len(truth)), truth]
            others = (logs.sum(axis=1) - own) / max(1, len(names) - 1)
            return float(-((1 - doubt) * own + doubt * others).mean())

        model.temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
        p = _softmax(logits / model.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(best)
        wrong = np.cumsum(~right[order][::-1])[::-1] / np.arange(len(order), 0, -1)  # among those at least as sure
        fine = np.nonzero(wrong <= TOLERATED)[0]
        if not len(fine):
            model.reject_below = float(np.nextafter(best.max(), 2))
        elif fine[0]:
            model.reject_below = float(best[order[fine[0]]])
    return model


def fit(labelled: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Train on (key, text, label): per label about ``per_label`` texts, those with the smallest hashes of ``key``.

    Labels are counted over all rows; a hash threshold per label then picks
    the sample without a sort or shuffle of texts.  The model is made in one
    task from that bounded sample."""
    rows = labelled.where("label is not null and text is not null")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    hashed = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_label / n))])
    sample = rows.where(hashed < share[F.col("label")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted((k, t, y) for b in batches for k, t, y in zip(*(c.to_pylist() for c in b.columns)))
        model = train([t for _, t, _ in seen], [y for *_, y in seen])
        yield pa.RecordBatch.from_pydict({"model": pa.array([model.pack()], pa.binary())})

    sampled = staged(sample.select(F.coalesce("key", F.lit("")).alias("key"), "text", "label"), "sample")
    return Model.unpack(bytes(sampled.coalesce(1).mapInArrow(run, "model binary").first()[0]))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row per input row, from whole texts.

    ``score`` is the calibrated probability of the predicted language.  Null
    texts and those without a letter, or any text under a model without
    labels, are ``und`` with score 0 and rejected; a score under the model's
    rejection score sets ``rejected`` beside the best label."""
    shared = docs.sparkSession.sparkContext.broadcast(model.pack())  # BUCKETS x languages doubles
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.unpack(shared.value)
        n = len(m.labels)
        table, place = np.zeros((1 << 16, n + 1)), {}  # a word's summed logits and number of n-grams

        def learn(words: list[str]) -> np.ndarray:
            found, own = gram_buckets(words, len(m.scores))
            size = len(words)
            return np.stack([np.bincount(own, weights=m.scores[found, k], minlength=size) for k in range(n)] + [np.bincount(own, minlength=size)], axis=1)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [words_of(t) if n else [] for t in part.column(1).to_pylist()]
                missing = list({w for words in texts for w in words if len(w) <= LONGEST and w not in place})
                if len(place) + len(missing) > 1 << 20:  # bounded: start the cache anew
                    place.clear()
                    missing = list({w for words in texts for w in words if len(w) <= LONGEST})
                if missing:
                    start = len(place)
                    while start + len(missing) > len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    for a in range(0, len(missing), 1 << 15):
                        table[start + a:start + a + len(missing[a:a + (1 << 15)])] = learn(missing[a:a + (1 << 15)])
                    place.update(zip(missing, range(start, start + len(missing))))
                rows = []
                for i, words in zip(part.column(0).to_pylist(), texts):
                    if not words:
                        rows.append({"doc_id": i, "lang_pred": UNKNOWN, "score": 0.0, "rejected": True})
                        continue
                    total = np.zeros(n + 1)
                    for a in range(0, len(words), 1 << 16):
                        total += table[[place[w] for w in words[a:a + (1 << 16)] if w in place]].sum(axis=0)
                    longs = [w for w in words if len(w) > LONGEST]
                    if longs:
                        total += learn(longs).sum(axis=0)
                    p = _softmax((total[:n] / total[n] + m.bias) / m.temperature)
                    best = int(p.argmax())
                    rows.append({"doc_id": i, "lang_pred": m.labels[best], "score": float(p[best]), "rejected": bool(p[best] < m.reject_below)})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """The documents no model learns from: crc32 of the id as text, modulo 3, is 1 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learn from the labelled rows not held out, predict all."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("label"))
    known = rows.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("string").alias("key"), "text", "label")
    model = fit(known, per_label)
    return predict(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
