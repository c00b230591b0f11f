"""Rate spikes for each source and the window around the densest errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels as L


def bucket(seconds: int):
    """Number of the timestamp's bucket; null without one."""
    return F.floor(F.unix_seconds("timestamp") / seconds).cast("long")


def source_rates(df: DataFrame, seconds: int = 1) -> DataFrame:
    """(source, buckets, median): the median rows of a source's non-empty buckets."""
    counts = df.filter("timestamp IS NOT NULL").groupBy("source", bucket(seconds).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.count("*").alias("buckets"), F.median("n").alias("median"))


def spike_buckets(df: DataFrame, multiplier: float = 10.0, seconds: int = 1, least: int = 10) -> DataFrame:
    """(source, bucket, n, median) of buckets with over ``multiplier`` times the median, in sources of ``least`` buckets or more."""
    counts = df.filter("timestamp IS NOT NULL").groupBy("source", bucket(seconds).alias("bucket")).agg(F.count("*").alias("n"))
    rates = counts.groupBy("source").agg(F.count("*").alias("buckets"), F.median("n").alias("median"))
    return counts.join(rates.filter(F.col("buckets") >= least), "source").filter(F.col("n") > multiplier * F.col("median")).select("source", "bucket", "n", "median")


def flag_spikes(df: DataFrame, multiplier: float = 10.0, seconds: int = 1, least: int = 10) -> DataFrame:
    """``df`` with ``is_spike``; spike buckets are few against the rows, and the join is by (source, bucket)."""
    hot = spike_buckets(df, multiplier, seconds, least).select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), F.lit(True).alias("__hot"))
    rows = df.withColumn("__bucket", bucket(seconds))
    rows = rows.join(hot, (F.col("source") == F.col("__s")) & (F.col("__bucket") == F.col("__b")), "left")
    return rows.withColumn("is_spike", F.coalesce("__hot", F.lit(False))).drop("__s", "__b", "__hot", "__bucket")


def error_window(df: DataFrame, seconds: int = 60, share: float = 0.1, margin: int = 900) -> DataFrame:
    """(since, until) around the peak bucket of errors: neighbours above ``share`` of the peak, ``margin`` seconds more each way.

    No row where there is no error. Ties for the peak go to the earliest. Buckets, not rows, are ordered: one
    small row for each minute that has an error.
    """
    errors = df.filter((F.col("level") >= L.ERROR) & F.col("timestamp").isNotNull())
    counts = errors.groupBy(bucket(seconds).alias("bucket")).agg(F.count("*").alias("n"))
    peak = counts.agg(F.max("n").alias("top"))
    dense = counts.join(F.broadcast(peak), F.col("n") > share * F.col("top"))
    island = F.col("bucket") - F.row_number().over(Window.orderBy("bucket"))
    islands = dense.withColumn("island", island).groupBy("island").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.max("n").alias("most"))
    best = islands.orderBy(F.desc("most"), "first").limit(1)
    since, until = F.col("first") * seconds - margin, (F.col("last") + 1) * seconds + margin
    return best.select(F.timestamp_seconds(since).alias("since"), F.timestamp_seconds(until).alias("until"))


def auto_window(df: DataFrame, seconds: int = 60, share: float = 0.1, margin: int = 900) -> DataFrame:
    """Rows inside the window (both ends), and those without a timestamp; all rows if there is no error.

    The window is one row; read by the driver, it becomes a plain range filter.
    """
    w = error_window(df, seconds, share, margin).first()
    if w is None:
        return df
    ts = F.col("timestamp")
    return df.filter(ts.isNull() | ts.between(F.lit(w["since"]), F.lit(w["until"])))
