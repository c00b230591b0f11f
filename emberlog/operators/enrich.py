"""Fields out of messages and metadata, deployment events, and correlation of sources in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def _meta(key: str) -> Column:
    return F.try_element_at("metadata", F.lit(key))


def _first_text(keys: list[str], pattern: str) -> Column:
    found = [F.when(_meta(k) != "", _meta(k)) for k in keys]
    inside = F.regexp_extract(F.coalesce("message", F.lit("")), pattern, 1)
    return F.coalesce(*found, F.when(inside != "", inside))


def http_status() -> Column:
    """A metadata value from 100 to 599, else one in the message; null if none."""
    def valid(c):
        n = F.trim(c).try_cast("int")
        return F.when(n.between(100, 599), n)

    inside = F.regexp_extract(F.coalesce("message", F.lit("")), P.HTTP_STATUS, 1)
    return F.coalesce(*(valid(_meta(k)) for k in P.STATUS_KEYS), valid(inside))


def error_type() -> Column:
    return _first_text(P.ERROR_KEYS, P.ERROR_TYPE)


def trace_id() -> Column:
    return _first_text(P.TRACE_KEYS, P.TRACE_ID)


def is_deployment() -> Column:
    """Deployment words in the metadata, or a deployment pattern in the message."""
    told = [F.lower(_meta(k)).contains(v) for k in P.DEPLOY_KEYS for v in P.DEPLOY_VALUES]
    said = F.coalesce("message", F.lit("")).rlike("(?i)(" + "|".join(P.DEPLOY) + ")")
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in told)) | said


def fields(df: DataFrame) -> DataFrame:
    """``df`` with http_status, error_type, trace_id and is_deployment."""
    if "metadata" not in df.columns:
        df = df.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    return df.withColumns({"http_status": http_status(), "error_type": error_type(), "trace_id": trace_id(), "is_deployment": is_deployment()})


def correlate(df: DataFrame, seconds: float = 5.0, key: tuple[str, ...] = ("timestamp", "source", "line_number")) -> DataFrame:
    """``df`` with ``correlated_with``: other sources that have an earlier row within ``seconds``, sorted.

    Looks back only; rows at the same time count as earlier by source. Time is cut into buckets as wide as
    the window, and of each source in a bucket only its first and last time matter: in a row's own bucket
    another source counts if its first time is before the row's, in the bucket before if its last is near
    enough. So rows meet one small row for each bucket in an equi-join, never each other.
    """
    rows = df.withColumn("__t", F.unix_micros("timestamp"))
    width = int(seconds * 1_000_000)
    at = rows.filter("__t IS NOT NULL")
    if width <= 0:
        # equal times only: sources at the same microsecond that sort before the row's own
        same = at.select("__t", "source").distinct().groupBy("__t").agg(F.array_sort(F.collect_set("source")).alias("__all"))
        out = rows.join(same, "__t", "left")
        return out.withColumn("correlated_with", F.coalesce(F.filter("__all", lambda s: s < F.col("source")), F.array().cast("array<string>"))).drop("__t", "__all")
    times = at.groupBy(F.floor(F.col("__t") / width).alias("__b"), "source").agg(F.min("__t").alias("lo"), F.max("__t").alias("hi"))
    packed = times.groupBy("__b").agg(F.collect_list(F.struct("source", "lo", "hi")).alias("near"))
    before = packed.select((F.col("__b") + 1).alias("__b"), F.col("near").alias("old"))
    out = rows.withColumn("__b", F.floor(F.col("__t") / width)).join(packed, "__b", "left").join(before, "__b", "left")
    t, me = F.col("__t"), F.col("source")
    now = F.filter("near", lambda x: (x["source"] != me) & ((x["lo"] < t) | ((x["lo"] == t) & (x["source"] < me))))
    old = F.filter("old", lambda x: (x["source"] != me) & (x["hi"] >= t - width))
    none = F.array().cast("array<string>")
    names = F.concat(F.coalesce(F.transform(now, lambda x: x["source"]), none), F.coalesce(F.transform(old, lambda x: x["source"]), none))
    return out.withColumn("correlated_with", F.array_sort(F.array_distinct(names))).drop("__t", "__b", "near", "old")
