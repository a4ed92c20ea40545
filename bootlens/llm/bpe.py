"""Byte-level BPE encoding and decoding (operator 1).

A text is cut into units at white space, a unit into pre-tokens, and each
pre-token is merged on its own: a heap of (merge rank, position) over a doubly
linked list of symbols, where entries whose symbols have changed since are
skipped when they surface.  Decoding concatenates the vocabulary strings.

Units repeat, so each worker keeps a bounded cache of their ids.  A word of
common letters is a unit without the punctuation behind it, and a pre-token as
it stands.  Long texts are worked off in chunks that end at unit boundaries,
whole to the end.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bootlens.llm.common import BoundedCache

#: The white space of Unicode, which ends a unit.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
BOUNDARY = re.compile(f"(?<=[^{WHITE}])(?= [^{WHITE}])")
CHUNK = 1 << 20
#: Ranges of Unicode that hold letters only (Latin, Cyrillic, kana, Han, Hangul).
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: A word of such letters that ends at white space or an ASCII character, or else a unit.  Pre-tokens with
#: letters end where letters end, and none looks back, so the parts of a unit have the pre-tokens of the whole.
WORD = re.compile(f" ?[{LETTERS}]++(?=[\\x00-@\\[-`{{-\\x7f{WHITE}]|\\Z)")
PART = re.compile(f"{WORD.pattern}|{UNIT.pattern}")


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Cut a long text before single spaces between words, where no pre-token crosses."""
    at = 0
    while len(text) - at > size:
        found = BOUNDARY.search(text, at + size)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:] if at else text


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others get code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PackedIds(BoundedCache):
    """Ids of units, kept as the bytes of 4-byte integers: small, and nothing that garbage collection follows."""

    def __getitem__(self, unit: str) -> memoryview:
        return memoryview(self.packed(unit)).cast("I")

    def packed(self, unit: str) -> bytes:
        return super().__getitem__(unit)


class BytePairCoder:
    """Encoder and decoder of one byte-level BPE file of the tokenizers library.

    ``path`` names the file on every executor (it is installed with Python)."""

    def __init__(self, path: str, cache: int = 600_000):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
        self.joined = [vocab[left + right] for left, right in pairs]  # by rank
        ranks = {}
        for rank, (left, right) in enumerate(pairs):
            ranks.setdefault(vocab[left], {})[vocab[right]] = rank
        none: dict[int, int] = {}
        self.ranks = [ranks.get(i, none) for i in range(max(vocab.values()) + 1)]  # of a left symbol, by the right one
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_of_char()
        self.id_of = {c: vocab[c] for c in alphabet if c in vocab}
        self._shown = {b: c for c, b in alphabet.items()}
        self.piece = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in (vocab | self.special).items():
            self.piece[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None
        self._cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self._units = PackedIds(self._unit, cache)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token (in the byte-level alphabet)."""
        id_of, ranks, joined = self.id_of, self.ranks, self.joined
        ids = [id_of[c] for c in word if c in id_of]
        n, queue, i = len(ids), [], 0  # entries are rank * n + position
        for left, right in zip(ids, ids[1:]):
            rank = ranks[left].get(right)
            if rank is not None:
                queue.append(rank * n + i)
            i += 1
        if not queue:
            return tuple(ids)
        heapify(queue)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            entry = heappop(queue)
            i, rank = entry % n, entry // n
            left, j = ids[i], after[i]
            if left < 0 or j < 0:
                continue  # stale: one of the two symbols is gone
            if ranks[left].get(ids[j]) != rank:
                continue  # stale: the pair here is another one by now
            ids[i] = new = joined[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                rank = ranks[new].get(ids[k])
                if rank is not None:
                    heappush(queue, rank * n + i)
            h = before[i]
            if h >= 0:
                rank = ranks[ids[h]].get(new)
                if rank is not None:
                    heappush(queue, rank * n + h)
        return tuple([x for x in ids if x >= 0])

    def _unit(self, unit: str) -> bytes:
        if WORD.fullmatch(unit):
            ids = self.merge(unit.encode().decode("latin-1").translate(self._shown))
        else:
            ids = [x for word, _ in self._cut(unit) for x in self.merge(word)]
        return array("I", ids).tobytes()

    def encode_parts(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, chunk by chunk."""
        known = self._units
        for segment in self.split_special.split(text) if any(s in text for s in self.special) else [text]:
            if segment in self.special:
                yield [self.special[segment]]
            elif segment:
                for chunk in chunks(segment):
                    units = PART.findall(chunk)
                    distinct = set(units)
                    here = dict(zip(distinct, map(known.get, distinct)))
                    for u, ids in here.items():
                        if ids is None:
                            here[u] = known.packed(u)
                    yield memoryview(b"".join(map(here.__getitem__, units))).cast("I").tolist()

    def encode(self, text: str) -> list[int]:
        return [x for part in self.encode_parts(text) for x in part]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def coder(path: str) -> BytePairCoder:
    """The coder of a worker process, made once."""
    return BytePairCoder(path)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]).

    One output row per input row, repeated rows included; other columns of
    ``docs`` are ignored, whatever their names.  A null text is an empty one
    (no ids).  ``ids_sha256`` hashes the decimal ids joined by commas,
    ``decoded_sha256`` the UTF-8 of what the ids decode to.  The string of a
    special token in a text becomes that token.  No shuffle.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        decimal = [str(i) for i in range(len(c.piece))]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    n, id_hash, decoded, kept = 0, hashlib.sha256(), [], []
                    for ids in c.encode_parts(t or ""):
                        if ids:
                            id_hash.update((("," if n else "") + ",".join(map(decimal.__getitem__, ids))).encode())
                            decoded.append(c.decode_bytes(ids))
                            n += len(ids)
                            if with_ids:
                                kept += ids
                    whole = b"".join(decoded).decode("utf-8", errors="replace").encode()
                    row = {"doc_id": i, "n_tokens": n, "ids_sha256": id_hash.hexdigest(), "decoded_sha256": hashlib.sha256(whole).hexdigest()}
                    rows.append(row | {"ids": kept} if with_ids else row)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, out)
