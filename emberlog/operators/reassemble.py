"""Physical lines to logical entries: continuation lines join the entry they follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P


def starts_entry(text: Column, fmt: Column) -> Column:
    """Whether a line begins an entry in its source's format."""
    after_bar = F.regexp_replace(text, r"(?d)^.*? \| ", "")
    return (
        F.when(fmt.isin("json", "docker-json", "cloudwatch"), text.startswith("{"))
        .when(fmt == "docker-compose", text.contains(" | ") & after_bar.rlike(P.GENERIC))
        .when(fmt == "kubernetes", text.rlike(P.KUBERNETES) | text.rlike(P.KUBE_PREFIXED))
        .when(fmt == "syslog-rfc5424", text.rlike(P.SYSLOG_5424))
        .when(fmt == "syslog-rfc3164", text.rlike(P.SYSLOG_3164))
        .when(fmt == "clf", text.rlike(P.CLF))
        .when(fmt == "logfmt", F.regexp_count(text, F.lit(P.LOGFMT_PAIR)) >= 3)
        .when(fmt == "csv", text != "")
        .when(fmt == "generic", text.rlike(P.GENERIC))
        .otherwise(True)
    )


def entries(lines: DataFrame, chunk: int = 65_536) -> DataFrame:
    """(source, format, line_number, text) of logical entries, from lines with ``format``.

    A line starts an entry if it looks like one, or if nothing is open: at the source's beginning and after
    a blank line. All state comes from lines before, so it is carried between chunks of ``chunk`` lines by
    one small row each, and a single huge file is spread over many tasks.
    """
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    rows = lines.withColumn("__chunk", F.floor(F.col("line_number") / chunk)).withColumn("__blank", blank)
    rows = rows.withColumn("__new", ~F.col("__blank") & starts_entry(F.col("text"), F.col("format")))

    def carried(df: DataFrame, **marks: Column) -> DataFrame:
        """Each mark's greatest value over all lines strictly before the current one, as columns named after it."""
        inside = Window.partitionBy("source", "__chunk").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
        ahead = Window.partitionBy("source").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = df.groupBy("source", "__chunk").agg(*(F.max(v).alias(k) for k, v in marks.items()))
        sums = sums.select("source", "__chunk", *(F.max(k).over(ahead).alias(f"{k}_before") for k in marks))
        df = df.withColumns({f"{k}_inside": F.max(v).over(inside) for k, v in marks.items()}).join(sums, ["source", "__chunk"])
        return df.withColumns({k: F.coalesce(f"{k}_inside", f"{k}_before", F.lit(0)) for k in marks}).drop(*(f"{k}_{x}" for k in marks for x in ("inside", "before")))

    n = F.col("line_number")
    rows = carried(rows, __start=F.when(F.col("__new"), n), __gap=F.when(F.col("__blank"), n))
    # open: an entry began since the last blank line; orphans open nothing
    first = F.col("__new") | (F.col("__start") <= F.col("__gap"))
    rows = rows.filter(~F.col("__blank")).withColumn("__first", first)
    rows = carried(rows, __group=F.when(F.col("__first"), n))
    group = F.when(F.col("__first"), n).otherwise(F.col("__group"))
    parts = rows.groupBy("source", "format", group.alias("line_number")).agg(F.array_sort(F.collect_list(F.struct("line_number", "text"))).alias("parts"))
    return parts.select("source", "format", "line_number", F.array_join(F.col("parts.text"), "\n").alias("text"))
