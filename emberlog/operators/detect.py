"""Format of each line, and of each source by vote over its first lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import MARK, let

FORMATS = ["json", "docker-json", "cloudwatch", "kubernetes", "syslog-rfc5424", "syslog-rfc3164", "clf", "csv", "logfmt", "docker-compose", "generic", "raw"]


def _one_object(text: Column) -> Column:
    """Whether the first brace closes with the last: strings and all but braces left out, what stands inside cancels out."""
    braces = F.regexp_replace(F.regexp_replace(text, r'(?s)"(?:[^"\\]|\\.)*"', ""), r"[^{}]+", "")
    inside = let(F.substr(braces, F.lit(2), F.length(braces) - 2), lambda x: F.aggregate(F.sequence(F.lit(0), F.length(x)), x, lambda left, _: F.replace(left, F.lit("{}"))))
    # most lines have one brace of each kind, or none inside strings
    return (F.length(text) - F.length(F.replace(text, F.lit("{"))) == 1) & (F.length(text) - F.length(F.replace(text, F.lit("}"))) == 1) | (inside == "")


def json_map(text: Column) -> Column:
    """Keys and values (as text) of a JSON object; null for all else.

    Spark's reader is lenient; one object from the first brace to the last and double quotes are asked for here.
    """
    strict = text.rlike(r"(?s)^\s*\{.*\}\s*$") & _one_object(text)
    return F.when(strict, F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}))


def csv_fields(text: Column) -> Column:
    """Fields of one CSV line: quoted ones unquoted with doubled quotes made single, others as they are."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(r',([ \t]*"[^"]*(?:""[^"]*)*"[^,]*|[^,]*)'), F.lit(1))

    def bare(x):
        inside = F.regexp_replace(x, r'(?s)^[ \t]*"([^"]*(?:""[^"]*)*)".*\z', f"{MARK}$1")
        unquoted = let(inside, lambda y: F.when(y.startswith(MARK), F.replace(F.substr(y, F.lit(2)), F.lit('""'), F.lit('"'))).otherwise(x))
        return F.when(x.contains('"'), unquoted).otherwise(x)

    return F.transform(raw, bare)


def is_csv_header(text: Column) -> Column:
    """Two fields or more, and two or more of them known column names."""
    known = F.filter(csv_fields(text), lambda x: F.lower(F.trim(x)).isin(P.CSV_HEADERS))
    return F.size(known) >= 2


def line_format(text: Column) -> Column:
    """The most specific format that a line fits; null for blank lines."""
    text = F.coalesce(text, F.lit(""))

    def of_json(keys):
        has = lambda *names: F.size(F.array_intersect(keys, F.array(*map(F.lit, names)))) == len(names)
        out = F.when(has("log", "stream", "time"), "docker-json").when(has("@timestamp", "@message"), "cloudwatch")
        return out.when(F.arrays_overlap(keys, F.array(*map(F.lit, ("level", "severity", "msg", "message")))), "json")

    out = F.when(F.trim(text) == "", F.lit(None).cast("string"))
    json_like = F.when(text.startswith("{"), let(F.map_keys(json_map(text)), of_json))
    rest = F.when(text.rlike(P.KUBERNETES) | text.rlike(P.KUBE_PREFIXED), "kubernetes")
    rest = rest.when(text.rlike(P.SYSLOG_5424), "syslog-rfc5424").when(text.rlike(P.SYSLOG_3164), "syslog-rfc3164")
    rest = rest.when(text.rlike(P.CLF), "clf").when(is_csv_header(text) | text.rlike(P.CSV_DATA), "csv")
    rest = rest.when(F.regexp_count(text, F.lit(P.LOGFMT_PAIR)) >= 3, "logfmt").when(text.rlike(P.COMPOSE), "docker-compose")
    return out.otherwise(F.coalesce(json_like, rest.when(text.rlike(P.GENERIC), "generic"), F.lit("raw")))


def source_formats(lines: DataFrame, sample: int = 100, share: float = 0.6) -> DataFrame:
    """(source, format): the format of over ``share`` of the recognised lines among the first ``sample``.

    Without such a majority: csv if any line votes for it, else generic if any does, else raw. A source whose
    inner name ends in .csv is csv.
    """
    votes = lines.filter(F.col("line_number") <= sample).select("source", line_format(F.col("text")).alias("format"))
    counts = votes.filter("format IS NOT NULL").groupBy("source", "format").agg(F.count("*").alias("n"))
    known = F.when(F.col("format") != "raw", F.col("n"))
    best = counts.groupBy("source").agg(
        F.max_by("format", F.when(F.col("format") != "raw", F.struct("n", "format"))).alias("top"),
        F.max(known).alias("top_n"),
        F.sum(known).alias("all_n"),
        F.max(F.col("format") == "csv").alias("any_csv"),
        F.max(F.col("format") == "generic").alias("any_generic"),
    )
    voted = F.when(F.col("top_n") > share * F.col("all_n"), F.col("top")).when(F.col("any_csv"), "csv").when(F.col("any_generic"), "generic").otherwise("raw")
    inner = F.lower(F.regexp_extract("source", r"([^:]*)$", 1))
    every = lines.select("source").distinct().join(best, "source", "left")
    return every.select("source", F.when(inner.endswith(".csv"), "csv").otherwise(F.coalesce(voted, F.lit("raw"))).alias("format"))
