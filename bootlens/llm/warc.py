"""WARC writing and reading (operator 10).

One gzip member per record.  Pages with equal payloads are found on narrow
rows (page id and digest); the payload itself moves at most once.  The reader
goes through a file front to back with an incremental zlib decompressor,
frames records by Content-Length and verifies payload digests, holding one
chunk and never a whole payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bootlens.llm.common import staged, store
from bootlens.session import scratch_dir

CHUNK = 1 << 16
#: The profile of a revisit by digest and the format version.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Capture time of records whose table has none.
UNDATED = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member.  A revisit has no block; both kinds carry digest and length of the full payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = payload if refers_to is None else b""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", UNDATED),
        ("WARC-Target-URI", "".join((url or "").split("\r")).replace("\n", "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT)]
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def first_with_payload(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, first) for the pages that repeat the payload of a smaller page_id."""
    seen = staged(pages.where(F.octet_length("payload") >= min_bytes).select("page_id", F.sha2("payload", 256).alias("digest")), "digests")
    first = staged(seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "first")
    # both sides are plain exchanges, so AQE splits the partition of a frequent payload
    return staged(seen.join(first, "digest").where("page_id > first").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first"), "revisits").distinct()


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per row to ``folder``; returns the manifest (file, n_records), also written there.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest page_id is a response, larger ones revisit it; rows that
    repeat that smallest id are responses too.  A null html is an empty
    payload; rows without a page_id are responses."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    again = first_with_payload(rows, min_bytes)
    marked = rows.join(again, (F.col("page_id") == F.col("_id")) & (F.sha2("payload", 256) == F.col("_digest")), "left").select("page_id", "url", "payload", "first")
    files, at = store(folder)
    files.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, out, n = store(folder)[0], None, 0
        name, attempt = f"{at}/part-{TaskContext.get().partitionId():08d}.warc.gz", f"{at}/attempt-{uuid.uuid4().hex}"
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for r in batch.slice(k, 64).to_pylist():
                    out = out or fs.open_output_stream(attempt)
                    out.write(record(r["page_id"], r["url"], r["payload"], r["first"]))
                    n += 1
        if out is not None:
            out.close()
            fs.move(attempt, name)
            yield pa.RecordBatch.from_pylist([{"file": name, "n_records": n}])

    marked.mapInArrow(run, "file string, n_records long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def read_records(stream) -> Iterator[dict]:
    """Headers of every record of one archive, front to back, as lower-case names; digests and framing are verified."""
    data, inflate = b"", None
    while True:
        if not data:
            data = stream.read(CHUNK)
            if not data:
                if inflate is not None:
                    raise ValueError("the archive ends inside a record")
                return
        if inflate is None:
            inflate, head, body, left, sha, tail = zlib.decompressobj(31), None, b"", 0, hashlib.sha1(), b""
        body += inflate.decompress(data, CHUNK)
        data = inflate.unconsumed_tail
        if inflate.eof:
            data = inflate.unused_data
        if head is None and b"\r\n\r\n" in body:
            raw, _, body = body.partition(b"\r\n\r\n")
            lines = raw.decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("a member does not start a record")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            left = int(head["content-length"])
        if head is not None:
            taken = body[:left]
            sha.update(taken)
            left -= len(taken)
            tail += body[len(taken):]
            body = b""
        if inflate.eof:
            if head is None or left or tail != b"\r\n\r\n":
                raise ValueError("a record's length does not fit its member")
            if head["warc-type"] == "response" and head["warc-payload-digest"] != "sha1:" + base64.b32encode(sha.digest()).decode():
                raise ValueError(f"wrong payload digest: {head['warc-record-id']}")
            yield head
            inflate = None


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    page = lambda urn: int(urn[len("<urn:page:"):-1] or -1) if urn and urn != "<urn:page:>" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = store(folder)[0]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(file, compression=None) as stream:
                    for h in read_records(stream):
                        rows.append({"page_id": page(h["warc-record-id"]), "payload_bytes": int(h["x-payload-length"]), "payload_digest": h["warc-payload-digest"][len("sha1:"):],
                                     "record_type": h["warc-type"], "refers_to": page(h.get("warc-refers-to"))})
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = manifest.select("file")
    return files.repartition(max(1, files.count())).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write archives to the shared checkpoint folder and read them back."""
    folder = scratch_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, page_id, url, html, min_bytes), folder)
