import base64
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from bootlens.llm import warc

SCHEMA = "page_id long, url string, html string"
ROWS = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://c/", "é中\U0001F600\r\n\r\nWARC/1.1\r\n" * 3),
        (6, "http://d/", "z" * 300_000), (7, "http://d/", "z" * 300_000), (8, "http://e/", "tiny"), (9, "http://e/", "tiny"), (9, "http://e/", "tiny"), (None, "http://f/", "<p>x</p>")]


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("first", F.lit("x")).withColumn("_id", F.lit(2)).repartition(3)


def want(rows, least=0):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        again = len(b) >= least and i is not None and first is not None and i > first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    got = sorted((tuple(r) for r in warc.round_trip(pages(spark, ROWS), min_bytes=least).collect()), key=str)
    assert got == want(ROWS, least)


def test_empty(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


class Slow(io.BytesIO):
    def read(self, n=-1):
        return super().read(min(n, 7))


def test_reader_in_small_chunks_and_faults():
    data = b"".join(warc.record(i, u, (h or "").encode(), 1 if i == 2 else None) for i, u, h in ROWS)
    heads = list(warc.read_records(Slow(data)))
    assert [h["warc-record-id"] for h in heads] == [f"<urn:page:{'' if i is None else i}>" for i, *_ in ROWS]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-9])))
    other = warc.record(1, "u", b"abc", None)
    import gzip
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(gzip.compress(gzip.decompress(other).replace(b"\r\n\r\nabc", b"\r\n\r\nabd")))))
    with pytest.raises(ValueError, match="length"):
        list(warc.read_records(io.BytesIO(gzip.compress(gzip.decompress(other).replace(b"Content-Length: 3", b"Content-Length: 2")))))
    assert list(warc.read_records(io.BytesIO(b""))) == []
