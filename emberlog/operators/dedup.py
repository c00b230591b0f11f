"""Dedup by signature: the first occurrences stay, many more become one summary row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import signature

#: The one order of log rows: no timestamp first, then time, source and line.
ORDER = ("timestamp", "source", "line_number")


def order() -> list[Column]:
    return [F.col("timestamp").asc_nulls_first(), F.col("source"), F.col("line_number")]


def with_signature(df: DataFrame) -> DataFrame:
    return df.withColumn("signature", signature(F.coalesce("message", F.lit(""))))


def _first(df: DataFrame) -> DataFrame:
    """Per signature: how often, the last timestamp, and the first row's fields. Partial before the shuffle."""
    place = F.struct(F.col("timestamp").isNotNull(), "timestamp", "source", "line_number")
    head = F.min_by(F.struct("timestamp", "level", "source", "message"), place)
    return df.groupBy("signature").agg(F.count("*").alias("total"), F.max("timestamp").alias("last"), head.alias("head"))


def kept(df: DataFrame, keep: int = 5) -> DataFrame:
    """The first ``keep`` rows of each signature, numbered, with the signature's first timestamp.

    Ranked alone, the limit is pushed below the shuffle, so a hot signature sends few rows.
    """
    w = Window.partitionBy("signature").orderBy(*order())
    rows = df.withColumn("occurrence_count", F.row_number().over(w).cast("long")).filter(F.col("occurrence_count") <= keep)
    first = F.first("timestamp").over(w)
    return rows.withColumn("first_seen", first).withColumn("last_seen", F.col("timestamp"))


def summaries(df: DataFrame, keep: int = 5) -> DataFrame:
    """One row for each signature with more than ``keep`` rows: the first row's fields and the whole count."""
    many = _first(df).filter(F.col("total") > keep)
    return many.select("signature", "head.*", F.col("total").alias("occurrence_count"), F.col("head.timestamp").alias("first_seen"), F.col("last").alias("last_seen"))


def union(kept_rows: DataFrame, summary_rows: DataFrame) -> DataFrame:
    """Both, told apart by ``is_dedup_summary``; summaries lack a raw line, number and metadata."""
    a = kept_rows.withColumn("is_dedup_summary", F.lit(False))
    return a.unionByName(summary_rows.withColumn("is_dedup_summary", F.lit(True)), allowMissingColumns=True)


def unique_signatures(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("signature").alias("unique_signatures"))
