"""Log sources: listing, plain and gzip text, tar archives, and lines handed over by the driver.

Every reader returns ``raw_line``: source string, line_number long (from 1), text string.
"""

from __future__ import annotations

import io
import sys
import tarfile
import zlib
from collections.abc import Iterable
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_LINE = "source string, line_number long, text string"

#: Broken and missing files are passed over with a warning.
LENIENT = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}
#: Lines of one Arrow batch out of an archive.
BATCH_LINES = 8192

#: Endings of log files; names without an ending count too.
LOG_ENDINGS = (".log", ".txt", ".json", ".csv", ".out")
ARCHIVE_ENDINGS = (".gz", ".tgz")


def _ending(path: str) -> str:
    name = path.rpartition("/")[2].lower()
    return "." + name.rpartition(".")[2] if "." in name else ""


def is_log(path: str) -> bool:
    """Whether a folder walk or an archive takes this file."""
    return _ending(path) in ("", *LOG_ENDINGS, *ARCHIVE_ENDINGS)


def is_tar(path: str) -> bool:
    return path.lower().endswith((".tar.gz", ".tgz"))


def expand(spark: SparkSession, sources: Iterable[str]) -> list[str]:
    """Files behind paths, patterns and folders (walked, log endings only), each once, in order.

    Goes through Hadoop's file systems, so any store works. Missing paths are reported and left out.
    """
    out: list[str] = []
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for given in sources:
        path = fs_path(given)
        fs = path.getFileSystem(conf)
        found = fs.globStatus(path) or []
        if not len(found):
            print(f"emberlog: no such source: {given}", file=sys.stderr)
        for status in found:
            if status.isDirectory():
                walk, inner = fs.listFiles(status.getPath(), True), []
                while walk.hasNext():
                    inner.append(walk.next().getPath().toString())
                out += sorted(p for p in inner if is_log(p))
            else:
                out.append(status.getPath().toString())
    return [*dict.fromkeys(out)]


def read_text(spark: SparkSession, paths: list[str], whole: bool = False) -> DataFrame:
    """Lines of plain and gzip files, numbered without a sort or a shuffle of text.

    Large files are split. A first pass counts the lines of each split (one small row each); a line's
    number is its place in its split after the counts of those before it. ``whole`` reads each file in one
    task instead, which is quicker for many small files.

    A file that is gone or broken doesn't end the run: what can be read of it counts (nothing with ``whole``),
    and the executor that meets it logs a warning. A line may be of any length.
    """
    reader = spark.read.options(**LENIENT)
    if whole:
        lines = reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
        lines = lines.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n", -1)).alias("n", "text"))
        return lines.select(_source("path"), (F.col("n") + 1).cast("long").alias("line_number"), "text")
    lines = reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    from pyspark.sql import Window

    splits = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "block", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    rows = lines.join(splits, ["path", "block"])
    return rows.select(_source("path"), (F.col("id") - F.col("first") + F.col("before") + 1).alias("line_number"), "text")


def _source(path: str):
    """The path without ``file:``; a gzip file's source names what is inside."""
    plain = F.regexp_replace(path, r"^file:/*", "/")
    inner = F.regexp_replace(F.element_at(F.split(plain, "/"), -1), r"(?i)\.gz$", "")
    return F.when(F.lower(plain).endswith(".gz"), F.concat(plain, F.lit(":"), inner)).otherwise(plain).alias("source")


def read_tar(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of the log files in .tar.gz and .tgz archives; a member is a source ``path:member``.

    Members that aren't regular files, hidden or without a log ending are left out; a broken archive gives
    the lines before the break. An archive is one binary value, so it may have 2 GB; members are read line by line.
    """
    files = spark.read.format("binaryFile").options(**LENIENT).load(paths).select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), "content")

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                        for m in tar:
                            name = m.name.rpartition("/")[2]
                            if not m.isfile() or name.startswith(".") or _ending(name) not in ("", *LOG_ENDINGS):
                                continue
                            lines = io.TextIOWrapper(tar.extractfile(m), "utf-8", "replace", newline="\n")
                            at = 1
                            while some := [x.removesuffix("\n").removesuffix("\r") for x in islice(lines, BATCH_LINES)]:
                                cols = [pa.array([f"{path}:{m.name}"] * len(some), pa.string()), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.string())]
                                yield pa.RecordBatch.from_arrays(cols, ["source", "line_number", "text"])
                                at += len(some)
                except (tarfile.TarError, OSError, EOFError, zlib.error) as e:
                    print(f"emberlog: {path}: {e}", file=sys.stderr)

    return files.mapInArrow(run, RAW_LINE)


def from_lines(spark: SparkSession, lines: Iterable[str], source: str = "stdin") -> DataFrame:
    """Lines that the driver has, such as standard input."""
    rows = [(source, k, x.rstrip("\n")) for k, x in enumerate(lines, 1)]
    return spark.createDataFrame(rows, RAW_LINE)


def read(spark: SparkSession, sources: Iterable[str], whole: bool = False) -> DataFrame:
    """``raw_line`` of all sources; none, or ``-``, is standard input."""
    sources = [*sources]
    if not sources or sources == ["-"]:
        return from_lines(spark, sys.stdin)
    paths = expand(spark, sources)
    tars, plain = [p for p in paths if is_tar(p)], [p for p in paths if not is_tar(p)]
    parts = ([read_text(spark, plain, whole)] if plain else []) + ([read_tar(spark, tars)] if tars else [])
    if not parts:
        return spark.createDataFrame([], RAW_LINE)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
