"""Token-id files (operator 3).

A store is a folder of shards in ascending doc_id order plus one shared
zstandard dictionary, trained on serialized id arrays of a sample.  Every
document is its own zstandard frame, so one short document can be read
without the others.  Texts are encoded and compressed where they lie; only
frames are sorted by doc_id.  Shard layout, little-endian:

    header   8 bytes magic, 32 bytes SHA-256 of the dictionary
    frames   one per document: its ids as unsigned 32-bit integers
    index    per document 6 longs: has_id, doc_id, offset, frame bytes, tokens, tokens before it in the shard
    footer   long: number of documents, long: tokens in the shard, 8 bytes magic

Shards are written by tasks under an attempt's own name and then renamed, so a
repeated attempt puts the same bytes in the same place.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from bootlens.llm.bpe import CHUNK, LETTERS, WHITE, chunks
from bootlens.llm.common import hash_share, prefix_sums, staged, store
from bootlens.session import scratch_dir

MAGIC = b"TOKSHRD1"
HEADER, ENTRY, FOOTER = 40, 48, 24
#: Documented bounds of the dictionary's training sample (about so many documents, so many pieces of
#: so many bytes of each, spread evenly over its whole id array) and of the dictionary.
SAMPLE_DOCS, PIECES, PIECE, DICT_BYTES = 2000, 8, 512, 64 << 10
LEVEL = 3
#: A space as byte-level vocabularies write it.
SPACE = "\u0120"
#: Longer units are not kept in a worker's cache.
LONGEST = 64
#: Characters of text that are cut at once, and the kinds of characters that tell where.
BLOCK = 4 << 20
BLANK, GAP, LETTER, DIGIT, MARK = range(1, 6)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """By code point: the space, other white space, a common letter, an ASCII digit, another ASCII character; 0 for all others."""
    table = np.zeros(0x110000, dtype=np.uint8)
    table[:0x80] = MARK
    low = "".join(map(chr, range(0x10000)))
    for kind, range_ in ((LETTER, LETTERS), (DIGIT, "0-9"), (GAP, WHITE), (BLANK, " ")):
        for found in re.finditer(f"[{range_}]+", low):
            table[found.start():found.end()] = kind
    return table


def _pairs(pairs: list[tuple[int, int]]) -> np.ndarray:
    """By 8 * kind + kind of the next character: whether a unit begins between them."""
    table = np.zeros(64, dtype=bool)
    table[[8 * a + b for a, b in pairs]] = True
    return table


_OTHER = (0, LETTER, DIGIT, MARK)
#: Where white space begins or a word behind it (inside white space: see ``cut_units``).
PAIRS = _pairs([(a, b) for a in _OTHER for b in (BLANK, GAP)] + [(GAP, b) for b in _OTHER])
#: Also where letters or digits end, for the byte-level pattern of the library.
FINE_PAIRS = PAIRS | _pairs([(LETTER, DIGIT), (LETTER, MARK), (DIGIT, LETTER), (DIGIT, MARK)])


def cut_units(parts: list[str], whole: Sequence[str] = (), pairs: np.ndarray = FINE_PAIRS) -> tuple[pa.StringArray, np.ndarray]:
    """Units of texts, one after another, and the number of units before each text and after the last.

    Units end at white space; of a run of it before a word the last character
    is apart, and goes with the word if it is a space.  With ``FINE_PAIRS`` runs
    of common letters and of ASCII digits also end where another known kind
    begins: byte-level pre-tokens end there too and none looks back, so the units
    have the pre-tokens of the whole.  A text that is in ``whole`` is one unit."""
    text = "".join(parts)
    kind = kinds()[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
    edges = np.append(0, np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))))
    edge = np.zeros(len(kind) + 1, dtype=bool)
    edge[edges] = True
    begins = edge.copy()
    begins[1:-1] |= pairs[8 * kind[:-1] + kind[1:]]
    white = (kind == BLANK) | (kind == GAP)
    last = np.nonzero(white[:-2] & white[1:-1] & ~white[2:])[0] + 1
    begins[last[~edge[last + 1]]] = True
    for k in (k for k, part in enumerate(parts) if part in whole):
        begins[edges[k] + 1:edges[k + 1]] = False
    at = np.nonzero(begins[:-1])[0]
    before = np.searchsorted(at, edges)
    data = text.encode()
    if len(data) > len(text):
        at = np.nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)[0][at]
    offsets = np.append(at, len(data)).astype("<i4")
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)), before


def blocks(parts: list[str], size: int = BLOCK) -> Iterator[list[str]]:
    """Runs of parts of about ``size`` characters together, a part at least."""
    block, held = [], 0
    for part in parts:
        if block and held + len(part) > size:
            yield block
            block, held = [], 0
        block.append(part)
        held += len(part)
    if block:
        yield block


class LibraryEncoder:
    """The tokenizers library over units of texts (``cut_units``), whose ids do not depend on their neighbours.

    Units repeat, so each distinct one in a bounded cache goes through the
    library once.  The cache has two generations: when the young one is full it
    becomes the old one, and what is met again moves up, so that frequent units
    stay however many rare ones pass.  Units that start with their space can stand side by side in
    one text without changing each other's ids; thousands of them are encoded
    at once and told apart by the tokens that begin with a space."""

    def __init__(self, path: str, limit: int = 1_200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.model._resize_cache(0)  # every unit comes once: the library's own cache would only fill
        # a space begins every spaced unit and nothing inside one: tokens that begin with it part the units
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        words = self.tokenizer.pre_tokenizer
        self.pairs = FINE_PAIRS if isinstance(words, pre_tokenizers.ByteLevel) and words.use_regex else PAIRS
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit = limit

    def _spaced(self, units: list[str]) -> list[bytes]:
        """Ids of units that each are a space and a word."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.append(np.nonzero(self.begins[ids])[0], len(ids)) * 4
        if len(at) == len(units) + 1:
            data, cuts = ids.tobytes(), at.tolist()
            return [data[a:b] for a, b in zip(cuts, cuts[1:])]
        encoded = self.tokenizer.encode("".join(units), add_special_tokens=False)   # a vocabulary of another kind: by offsets
        starts = np.cumsum([0, *map(len, units)])
        first = np.searchsorted(np.array([s for s, _ in encoded.offsets]), starts)
        ids = np.array(encoded.ids, dtype="<u4")
        return [ids[a:b].tobytes() for a, b in zip(first, first[1:])]

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units that the cache does not hold; short ones are kept there."""
        spaced, other = [], []
        for u in units:
            (spaced if len(u) > 1 and u[0] == " " and not u[1].isspace() else other).append(u)
        made = {}
        for at in range(0, len(spaced), 4096):
            part = spaced[at:at + 4096]
            made.update(zip(part, self._spaced(part)))
        for at in range(0, len(other), 4096):
            part = other[at:at + 4096]
            made.update(zip(part, [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]))
        self._keep((u, ids) for u, ids in made.items() if len(u) <= LONGEST)
        return made

    def _keep(self, units) -> None:
        if 2 * len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young.update(units)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, serialized as unsigned 32-bit integers."""
        parts = [list(self.parts(t)) for t in texts]
        made = (ids for block in blocks([p for own in parts for p in own]) for ids in self._block(block))
        return [b"".join(islice(made, len(own))) for own in parts]

    def _block(self, parts: list[str]) -> list[bytes]:
        """Ids of each part: those of the distinct units, taken in the units' order."""
        units, before = cut_units(parts, self.special, self.pairs)
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.young.get, distinct))
        missing = [u for u, ids in zip(distinct, found) if ids is None]
        if missing:
            again = {u: ids for u, ids in zip(missing, map(self.old.get, missing)) if ids is not None}
            new = self.learn([u for u in missing if u not in again]) | again
            self._keep(again.items())
            found = [new[u] if ids is None else ids for u, ids in zip(distinct, found)]
        taken = pa.array(found, pa.large_binary()).take(coded.indices)
        data = memoryview(taken.buffers()[2] or b"")
        at = np.append(0, np.cumsum(pc.binary_length(taken).to_numpy()))[before].tolist()
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts whose ids do not depend on each other: special tokens, what lies between, chunks of long ones."""
        for segment in self.split_special(text) if any(s in text for s in self.special) else (text,):
            yield from chunks(segment) if len(segment) > CHUNK else (segment,)


def slices(batch: pa.RecordBatch, rows: int = 2048, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and, but for longer single ones, ``size`` bytes of the second column."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        after = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, after - at)
        at = after


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
    return LibraryEncoder(path)


def pieces(ids: bytes, count: int = PIECES, size: int = PIECE) -> bytes:
    """A serialized id array, or ``count`` pieces of ``size`` bytes spread evenly over the whole of a longer one."""
    if len(ids) <= count * size:
        return ids
    last = (len(ids) - size) // 4
    return b"".join(ids[4 * at:4 * at + size] for at in (last * k // (count - 1) for k in range(count)))


def train_dictionary(docs: DataFrame, path: str, end_id: int, max_docs: int = SAMPLE_DOCS) -> bytes:
    """Dictionary from pieces of the id arrays of about ``max_docs`` documents drawn by a hash of doc_id (null: of the text).

    The sample is encoded where it lies and trained on in one task in order of
    doc_id, so the same documents give the same dictionary on any partitioning.
    Too few samples give an empty one (frames are then compressed without)."""
    total = docs.count()
    sample = docs.where(hash_share(F.coalesce("doc_id", F.xxhash64("text")), max_docs, total))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = struct.pack("<I", end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [pieces(ids + end) for ids in encoder(path).encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        rows = sorted((i is not None, i or 0, ids) for batch in batches for i, ids in zip(*(c.to_pylist() for c in batch.columns)))
        samples = [ids for *_, ids in rows]
        size, made = sum(map(len, samples)), b""
        if len(samples) >= 16 and size >= 16 * 1024:
            try:
                made = zstandard.train_dictionary(min(DICT_BYTES, max(1024, size // 10)), samples, level=LEVEL).as_bytes()
            except zstandard.ZstdError:  # samples too small or too alike to train on
                made = b""
        yield pa.RecordBatch.from_pydict({"dict": pa.array([made], pa.binary())})

    bits = sample.select("doc_id", "text").mapInArrow(cut, "doc_id long, ids binary")
    rows = bits.repartition(1).mapInArrow(run, "dict binary").collect()  # DICT_BYTES at most
    return bytes(rows[0][0]) if rows else b""


def _compressor(dictionary: bytes, read: bool = False):
    import zstandard

    kind = zstandard.ZstdDecompressor if read else zstandard.ZstdCompressor
    settings = {} if read else {"level": LEVEL, "write_content_size": True}
    return kind(dict_data=zstandard.ZstdCompressionDict(dictionary), **settings) if dictionary else kind(**settings)


def write_store(docs: DataFrame, path: str, folder: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the shards to ``folder``.

    Returns the manifest (shard, file, n_docs, n_tokens), also written to the
    folder.  Null texts are empty.  Documents without an id come first;
    documents that share an id follow each other, by a hash of the text.
    Columns other than the two named are ignored.  One pass over the texts gives
    frames, written once; they are shuffled by ranges of doc_id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dictionary = train_dictionary(rows, path, end_id)
    files, at = store(folder)
    files.create_dir(at, recursive=True)
    with files.open_output_stream(f"{at}/dictionary") as out:
        out.write(dictionary)
    shared = rows.sparkSession.sparkContext.broadcast(dictionary)  # DICT_BYTES at most

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = _compressor(shared.value), struct.pack("<I", end_id)
        for batch in batches:
            for part in slices(batch):
                ids = [x + end for x in encoder(path).encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(tool.compress, ids), pa.binary())],
                                                 names=["doc_id", "hash", "n_tokens", "frame"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, index, before, out, offset = store(folder)[0], [], 0, None, HEADER
        name, attempt = f"{at}/shard-{shard:08d}", f"{at}/attempt-{uuid.uuid4().hex}"
        for batch in batches:
            if out is None and batch.num_rows:
                out = fs.open_output_stream(attempt)
                out.write(MAGIC + hashlib.sha256(shared.value).digest())
            for i, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                out.write(frame)
                index.append(struct.pack("<6q", i is not None, i or 0, offset, len(frame), n, before))
                before += n
                offset += len(frame)
        if out is not None:
            out.write(b"".join(index) + struct.pack("<2q", len(index), before) + MAGIC)
            out.close()
            fs.move(attempt, name)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "n_docs": len(index), "n_tokens": before}])

    frames = staged(rows.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(press, "doc_id long, hash long, n_tokens long, frame binary"), "frames")
    ordered = frames.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "hash", "frame").select("doc_id", "n_tokens", "frame")
    written = ordered.mapInArrow(run, "shard long, file string, n_docs long, n_tokens long")
    written.write.parquet(f"{folder}/manifest")
    return rows.sparkSession.read.parquet(f"{folder}/manifest")


class Shard:
    """Reader of one shard: the index is read, then any document by its place."""

    def __init__(self, fs, file: str, dictionary: bytes):
        self.file = fs.open_input_file(file)
        size = self.file.size()
        self.file.seek(size - FOOTER)
        n, self.n_tokens, magic = struct.unpack("<2q8s", self.file.read(FOOTER))
        if magic != MAGIC:
            raise ValueError(f"{file}: no shard footer")
        self.file.seek(size - FOOTER - n * ENTRY)
        self.index = np.frombuffer(self.file.read(n * ENTRY), dtype="<i8").reshape(n, 6)
        self.file.seek(0)
        if self.file.read(HEADER) != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{file}: written with another dictionary")
        self.read = _compressor(dictionary, read=True)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the shard, its end id included."""
        _, _, offset, size, tokens, _ = self.index[k]
        self.file.seek(int(offset))
        ids = np.frombuffer(self.read.decompress(self.file.read(int(size)), max_output_size=int(tokens) * 4), dtype="<u4")
        if len(ids) != tokens:
            raise ValueError("a frame does not hold as many ids as its index entry says")
        return ids

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Documents with this id, found in the ordered index."""
        own = self.index[self.index[:, 0] == 1]
        first = len(self.index) - len(own)
        low, high = np.searchsorted(own[:, 1], [doc_id, doc_id + 1])
        return [self.document(first + k) for k in range(low, high)]


def read_store(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` counts the ids of all documents before it; the shards' totals are
    summed first (one row per shard), the index has the sums inside a shard."""
    based = prefix_sums(manifest.select("shard", "file", "n_tokens"), [], ["shard"], "n_tokens", "base").select("file", "base")
    root = store(folder)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = store(folder)[0]
        dictionary = None
        for batch in batches:
            for row in batch.to_pylist():
                if dictionary is None:
                    with fs.open_input_stream(f"{root}/dictionary") as f:
                        dictionary = f.read()
                shard = Shard(fs, row["file"], dictionary)
                for at in range(0, len(shard.index), 4096):
                    part = shard.index[at:at + 4096]
                    crcs = [zlib.crc32(shard.document(at + k).tobytes()) for k in range(len(part))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[:, 1], mask=part[:, 0] == 0), pa.array(part[:, 5] + row["base"]), pa.array(part[:, 4]), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = staged(based, "shards")
    tasks = max(1, spread.count())
    return spread.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a store to the shared checkpoint folder and read it back."""
    folder = scratch_dir(docs.sparkSession, "tokens")
    return read_store(write_store(docs, path, folder, end_id, doc_id, text), folder)
