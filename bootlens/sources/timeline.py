"""The begin/end timeline log as a table or a stream.

A line reads ``local date|epoch.nanos|pid|message|``.  The message may hold
``|`` (whole user commands are logged), so the line is matched by one
anchored pattern and never split on the bar.  Lines that do not match are
kept with ``valid = false`` (see ``rejects``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bootlens.functions.marks import SEP
from bootlens.schemas import NS_PER_SECOND

# Fixed pattern of a timeline line.
LINE_PATTERN = r"^([^|]*)\|([0-9]+(?:\.[0-9]+)?)\|([0-9]+)\|(.*)\|$"


def parse_lines(lines: DataFrame, value: str = "value", host: Column | None = None,
                seq: Column | None = None) -> DataFrame:
    """Lines (one column of text) to the timeline schema.

    ``seq`` breaks ties of equal epochs; by default the position of the line
    in the scan (stable for a given set of files).
    """
    v = F.col(value)
    # one match per line: epoch, pid, and date and message still joined by the bar between them.  A line that
    # matches gets shorter (its last bar goes), any other stays as it is; the result is a column of its own, so
    # that the pattern runs once.
    cut = lines.select(
        (host if host is not None else F.lit(None).cast("string")).alias("host"),
        (seq if seq is not None else F.monotonically_increasing_id()).alias("seq"),
        v.alias("line"), F.regexp_replace(v, LINE_PATTERN, f"$2{SEP}$3{SEP}$1|$4").alias("_cut"))
    parts = cut.select("host", "seq", "line", F.when(F.col("_cut") != F.col("line"), F.split("_cut", SEP, 3)).alias("_f"))
    epoch, pid, rest = (F.col("_f")[i] for i in range(3))

    # "seconds.fraction" to whole nanoseconds (fraction cut or padded to 9
    # digits); NULL, not a failed job, when it does not fit a long.
    secs = F.substring_index(epoch, ".", 1).try_cast("long")
    digits = F.when(F.instr(epoch, ".") > 0, F.substring_index(epoch, ".", -1)).otherwise("")
    frac = F.rpad(F.substring(digits, 1, 9), 9, "0").try_cast("long")
    epoch_ns = F.try_add(F.try_multiply(secs, F.lit(NS_PER_SECOND)), frac)
    pid = pid.try_cast("long")
    # a line is valid when it matches and its numbers fit their types
    return parts.select(
        "host", F.substring_index(rest, "|", 1).alias("local_date"), epoch_ns.alias("epoch_ns"), pid.alias("pid"),
        F.substr(rest, F.instr(rest, "|") + 1).alias("message"), "seq",
        (F.col("_f").isNotNull() & epoch_ns.isNotNull() & pid.isNotNull()).alias("valid"), "line")


def host_from_path(path: Column) -> Column:
    """Host name = the folder that holds the log file."""
    return F.element_at(F.split(path, "/"), -2)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Read timeline files (batch).  Host is the parent folder name."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"))
    return parse_lines(raw, host=host_from_path(F.col("_path")))


def stream_timeline(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream over rolled files in a folder.

    ``seq``, which orders lines of one epoch, is a hash of file and line: the
    same however often and in whatever batches the files are read."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(path).select("value", F.col("_metadata.file_path").alias("_path"))
    return parse_lines(raw, host=host_from_path(F.col("_path")), seq=F.xxhash64("_path", "value"))


def rejects(timeline: DataFrame) -> DataFrame:
    return timeline.where(~F.col("valid")).select("host", "line")


def format_line(local_date: Column, epoch_ns: Column, pid: Column, message: Column) -> Column:
    """The writer's side: one timeline line (``seconds.nanoseconds``)."""
    frac = F.pmod(epoch_ns, F.lit(NS_PER_SECOND))
    secs = ((epoch_ns - frac).cast("decimal(20,0)") / F.lit(NS_PER_SECOND)).cast("long")
    epoch = F.format_string("%d.%09d", secs, frac)
    return F.concat_ws("|", local_date, epoch, pid.cast("string"), message, F.lit(""))
