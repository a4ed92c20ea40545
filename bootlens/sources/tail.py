"""S5 by byte position: timeline logs that grow, as a stream.

Spark's file stream takes whole new files and knows no place inside one.  This
source follows files as they grow.  Its offset is a map {file: byte}; a
micro-batch covers the bytes up to the last line end seen, so a line being
written is left for the next one.  Ranges of at most ``range_bytes`` are read by
different tasks.  ``seq`` is the byte at which a line starts: it orders the lines
of a file as they stand there, equal lines and equal times included, and is the
same in whatever batches the file is read.

Files are reached through ``pyarrow.fs`` (shared paths and the stores it knows).
"""

from __future__ import annotations

import fnmatch

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE_BYTES = 64 << 20
_STEP = 1 << 20


def _store(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def log_files(uri: str, pattern: str = "*") -> dict[str, int]:
    """{file: size} of the files under a folder whose names fit the pattern (a file: itself)."""
    from pyarrow import fs

    files, root = _store(uri)
    infos = [files.get_file_info(root)]
    if infos[0].type == fs.FileType.Directory:
        infos = files.get_file_info(fs.FileSelector(root, recursive=True))
    return {i.path: i.size for i in infos if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern)}


def complete_until(uri: str, file: str, start: int, end: int) -> int:
    """The byte behind the last line end in [start, end); ``start`` if there is none."""
    with _store(uri)[0].open_input_file(file) as f:
        while end > start:
            a = max(start, end - _STEP)
            f.seek(a)
            at = f.read(end - a).rfind(b"\n")
            if at >= 0:
                return a + at + 1
            end = a
    return start


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, floor: int, stop: int):
        self.file, self.start, self.end, self.floor, self.stop = file, start, end, floor, stop


def read_lines(uri: str, file: str, start: int, end: int, floor: int, stop: int):
    """Batches (value, file, seq) of the lines that start in [start, end); ``floor`` and ``stop`` bound the complete lines."""
    with _store(uri)[0].open_input_file(file) as f:
        at, rest = start, b""
        if start > floor:   # a line begun before this range is the range's before it
            f.seek(start - 1)
            at = start - 1
        else:
            f.seek(start)
        skip = start > floor
        while at < stop:
            data = f.read(min(_STEP, stop - at))
            if not data:
                break
            begin, data = at - len(rest), rest + data
            at += len(data) - len(rest)
            cuts = np.nonzero(np.frombuffer(data, dtype=np.uint8) == 10)[0]
            if skip:
                if not len(cuts):
                    rest = data
                    continue
                begin, data, cuts, skip = begin + int(cuts[0]) + 1, data[cuts[0] + 1:], cuts[1:] - cuts[0] - 1, False
            starts = np.concatenate(([0], cuts + 1)).astype(np.int64)
            lines = starts[:-1][starts[:-1] + begin < end]
            rest = data[starts[-1]:]
            if len(lines):
                values = [data[a:b].decode("utf-8", "replace").removesuffix("\r") for a, b in zip(lines.tolist(), cuts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([file] * len(values), pa.string()), pa.array(lines + begin, pa.int64())],
                                                 names=["value", "file", "seq"])
            if begin + int(starts[-1]) >= end:
                return


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.uri, self.pattern = options["path"], options.get("pattern", "*")
        self.size = int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {f: complete_until(self.uri, f, 0, n) for f, n in sorted(log_files(self.uri, self.pattern).items())}

    def partitions(self, start, end):
        out = []
        for file, stop in sorted(end.items()):
            floor = start.get(file, 0)
            out += [_Range(file, a, min(stop, a + self.size), floor, stop) for a in range(floor, stop, self.size)]
        return out or [_Range("", 0, 0, 0, 0)]

    def read(self, part):
        if part.start < part.end:
            yield from read_lines(self.uri, part.file, part.start, part.end, part.floor, part.stop)


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").load(folder)``: value, file, seq."""

    @classmethod
    def name(cls):
        return "growing_lines"

    def schema(self):
        return "value string, file string, seq long"

    def streamReader(self, schema):
        return _Reader(self.options)


def stream_lines(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("pattern", pattern).option("rangebytes", range_bytes).load(path)


def follow_timeline(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Timeline lines as their files grow; ``seq`` is the line's byte position in its file, host its folder."""
    from bootlens.sources.timeline import host_from_path, parse_lines

    lines = stream_lines(spark, path, pattern, range_bytes)
    return parse_lines(lines, host=host_from_path(F.col("file")), seq=F.col("seq"))
