"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space bytes that separate words, as a Java class. ``bytes.split()`` uses the same six.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows and bytes of one Arrow batch handed to Python, so that very long texts cannot pile up in a worker.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each context, so that workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_emberlog_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    path = Path(tempfile.mkdtemp(prefix="emberlog-")) / f"{top.name}.zip"
    path.write_bytes(data.getvalue())
    context.addPyFile(str(path))  # the driver serves it; executors fetch it from there
    context._emberlog_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Ready a session for Python workers: ship the package, bound Arrow batches (a smaller bound that is set stays)."""
    shipped(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is set here only where it is unset and the session is local (tests); a cluster without it is an error.
    """
    context = spark.sparkContext
    conf = context.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_emberlog_dir", None)
    if not found:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = context._emberlog_dir = tempfile.mkdtemp(prefix="emberlog-")
    return f"{found.rstrip('/')}/{context.applicationId}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and survives lost executors; unlike an RDD checkpoint it stays columnar, so a
    later reader that needs two columns reads two columns. No success marker: on a local file system without
    Hadoop's native library the driver would start a process to set its mode, which for a moment shares the
    driver's whole memory and is counted with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a ``stored`` table that nothing reads any more."""
    spark, base = df.sparkSession, shared_dir(df.sparkSession)
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if base.split(":")[-1] in path:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def fold(key: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The array of words ``[^\\x20\\x09-\\x0D]+``; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def byte_words(text: str | bytes | None) -> list[bytes]:
    """The words as UTF-8 bytes with A-Z lowered (``bytes.lower`` leaves other letters alone)."""
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode()).lower().split()


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_slices(text: str | bytes | None, size: int = 1 << 18) -> Iterator[list[bytes]]:
    """``byte_words`` in lists of about ``size`` bytes each, so that no very long text becomes one list."""
    data = text.encode() if isinstance(text, str) else text or b""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + size) if at + size < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].lower().split()
        at = end


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # not glibc: nothing to tune
        return None


def tidy() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and idle beside later ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def sparing() -> None:
    """From now on large blocks come from the system one by one and go back when they are freed."""
    if (libc := _libc()) is not None:
        libc.mallopt(-3, 256 << 10)  # M_MMAP_THRESHOLD: set, it no longer grows with what is freed
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD


def lean(run):
    """``run`` (a function from batches to batches) as a task that holds little and leaves nothing behind.

    Large blocks go back to the system when they are freed (``sparing``); at the end of the task what the
    allocators still hold goes back too.
    """

    @functools.wraps(run)
    def wrapped(batches):
        sparing()
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped
