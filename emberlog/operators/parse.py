"""Parsers: one logical entry to (timestamp, level, message, metadata), or null where it is rejected.

All are Column expressions; ``parse`` picks by format, so that a row pays for its own parser alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions import patterns as P
from ..functions import timestamps as T
from ..functions.text import groups, let, once
from .detect import csv_fields, is_csv_header, json_map

#: What a parser finds: the time's text, the level as a word or rank, and whether a time is a must.
ENTRY = "struct<ts:string,word:string,level:int,message:string,metadata:map<string,string>,timed:boolean>"
#: Keys of the common fields, the first present one counts.
TIME_KEYS = ["timestamp", "ts", "time", "@timestamp", "t"]
LEVEL_KEYS = ["level", "severity", "lvl"]
MESSAGE_KEYS = ["msg", "message", "log"]


def _entry(ts: Column, word: Column, level: Column | int, message: Column, metadata: Column | None = None, timed: bool = False) -> Column:
    meta = F.lit(None) if metadata is None else metadata
    level = F.lit(level) if isinstance(level, int) else level
    return F.struct(ts.alias("ts"), word.alias("word"), level.alias("level"), message.alias("message"), meta.alias("metadata"), F.lit(timed).alias("timed")).cast(ENTRY)


def _pairs(**columns: Column) -> Column:
    """A map of the given columns without those that are null or empty."""
    every = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns.values()))
    return F.map_filter(every, lambda k, v: F.coalesce(v != "", F.lit(False)))


def _from_map(m: Column) -> Column:
    """Common fields out of a map, each by the first of its keys that is present; what is left is metadata."""
    present = lambda keys: F.get(F.filter(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(m, k)), F.lit(0))

    def entry(taken):
        ts, level, message = (F.try_element_at(m, F.get(taken, F.lit(k))) for k in range(3))
        rest = F.map_filter(m, lambda k, _: ~F.coalesce(F.array_contains(taken, k), F.lit(False)))
        return let(rest, lambda left: _entry(ts, level, L.UNKNOWN, F.coalesce(message, F.lit("")), F.when(F.size(left) > 0, left)))

    return F.when(m.isNotNull(), let(F.array(present(TIME_KEYS), present(LEVEL_KEYS), present(MESSAGE_KEYS)), entry))


def _word(message: Column, colon: bool = True) -> Column:
    """The word before the first space, which may name the level."""
    first = F.regexp_extract(message, r"^([^ ]+) ", 1)
    return F.regexp_replace(first, ":+$", "") if colon else first


def json(text: Column) -> Column:
    return let(json_map(text), _from_map)


def logfmt(text: Column) -> Column:
    """key=value pairs; quoted values with backslash escapes; reading stops at the first thing that is no pair."""
    pair = r'(?s)\G[ \t]*([^= \t][^=]*)=("(?:\\.|[^"\\])*(?:"|\\?\z)|[^ \t"][^ \t]*|)'

    def bare(v):
        quoted = F.regexp_replace(F.regexp_replace(v, r'(?s)^"(.*?)"?\z', "$1"), r"(?s)\\(.?)", "$1")
        return F.when(v.startswith('"'), quoted).otherwise(v)

    def entry(found):  # a key has no "=", so the first one ends it
        keys = F.transform(found, lambda x: F.trim(F.regexp_replace(F.substring_index(x, "=", 1), r"^[ \t]+", "")))
        values = F.transform(found, lambda x: bare(F.substr(x, F.instr(x, "=") + 1)))
        return let(_last_wins(keys, values), _from_map)

    return let(F.regexp_extract_all(text, F.lit(pair), F.lit(0)), lambda found: F.when(F.size(found) > 0, entry(found)))


def _last_wins(keys: Column, values: Column) -> Column:
    """A map whose repeated keys keep the last value, whatever the session's policy for them."""
    def unique(both):
        last = F.filter(both, lambda x, i: ~F.exists(F.slice(both, i + 2, F.size(both)), lambda y: y["k"] == x["k"]))
        return F.map_from_entries(F.when(F.size(F.array_distinct(both["k"])) == F.size(both), both).otherwise(last))

    return let(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), unique)


def syslog_3164(text: Column) -> Column:
    def entry(g):
        level = L.severity(F.pmod(g(1).try_cast("int"), F.lit(8)))
        return _entry(F.concat_ws(" ", g(2), g(3), g(4)), F.lit(None), level, g(8), _pairs(hostname=g(5), app=g(6), pid=g(7)))

    return groups(text, P.SYSLOG_3164_FULL, 8, entry)


def syslog_5424(text: Column) -> Column:
    def entry(g):
        pid = F.when(g(6) != "-", g(6)).otherwise("")
        level = L.severity(F.pmod(g(1).try_cast("int"), F.lit(8)))
        return _entry(g(3), F.lit(None), level, F.regexp_replace(g(8), P.SYSLOG_5424_DATA, ""), _pairs(hostname=g(4), app=g(5), pid=pid))

    return groups(text, P.SYSLOG_5424_FULL, 8, entry)


def clf(text: Column) -> Column:
    def entry(g):
        status = g(6).try_cast("int")
        level = F.when(status >= 500, L.ERROR).when(status >= 400, L.WARN).otherwise(L.INFO)
        return _entry(g(4), F.lit(None), level, F.concat_ws(" ", g(5), g(6)), _pairs(host=g(1), request=g(5), status=g(6), size=g(7)))

    return groups(text, P.CLF_FULL, 7, entry)


def docker_json(text: Column) -> Column:
    def entry(m):
        at = lambda k: F.try_element_at(m, F.lit(k))
        message = F.regexp_replace(F.coalesce(at("log"), F.lit("")), r"\n+\z", "")
        level = F.when(at("stream") == "stderr", L.ERROR).otherwise(L.INFO)
        return F.when(at("stream").isin("stdout", "stderr"), _entry(at("time"), _word(message), level, message, _pairs(stream=at("stream"))))

    return let(json_map(text), entry)


def docker_compose(text: Column) -> Column:
    name, rest = F.regexp_extract(text, r"(?d)^(.*?) \| ", 1), F.regexp_replace(text, r"(?d)^.*? \| ", "")
    head = T.prefix(rest)
    message = F.when(head != "", F.ltrim(F.substr(rest, F.length(head) + 1))).otherwise(rest)
    return F.when(text.contains(" | "), _entry(head, _word(message), L.UNKNOWN, message, _pairs(container=F.trim(name))))


def cloudwatch(text: Column) -> Column:
    def entry(m):
        at = lambda k: F.try_element_at(m, F.lit(k))
        message = at("@message")
        return F.when(at("@timestamp").isNotNull() & message.isNotNull(), _entry(at("@timestamp"), _word(message), L.UNKNOWN, message, _pairs(logStream=at("@logStream"))))

    return let(json_map(text), entry)


def kubernetes(text: Column) -> Column:
    """Container runtime lines (time, stream, flag, message) and lines that a ``[resource]`` stands before."""
    def runtime(parts):
        stream, message = F.get(parts, F.lit(1)), F.coalesce(F.get(parts, F.lit(3)), F.lit(""))
        level = F.when(stream == "stderr", L.ERROR).otherwise(L.INFO)
        return F.when((F.size(parts) == 4) & stream.isin("stdout", "stderr"), _entry(F.get(parts, F.lit(0)), _word(message), level, message, _pairs(stream=stream)))

    rest = F.ltrim(F.regexp_replace(text, r"(?d)^\[[^\]]*\]", ""))
    head = T.prefix(rest)
    body = F.ltrim(F.substr(rest, F.length(head) + 1))
    prefixed = F.when(head != "", _entry(head, _word(body), L.UNKNOWN, body, _pairs(resource=F.regexp_extract(text, r"^\[([^\]]*)\]", 1)), True))
    return F.when(text.startswith("["), prefixed).otherwise(let(F.split(text, " ", 4), runtime))


def generic(text: Column) -> Column:
    head = T.prefix(text)
    message = F.ltrim(F.substr(text, F.length(head) + 1))
    return F.when(head != "", _entry(head, _word(message, colon=False), L.UNKNOWN, message, timed=True))


def raw(text: Column) -> Column:
    return _entry(F.lit(None), F.lit(None), L.UNKNOWN, text)


def csv(text: Column, header: Column) -> Column:
    """By the names of ``header``, lower-cased; a source without a header row has all its lines rejected."""
    names = F.transform(header, lambda x: F.lower(F.trim(x)))

    def entry(both):  # as many columns as both have
        n = F.least(F.size(both["names"]), F.size(both["fields"]))
        m = _last_wins(F.slice(both["names"], F.lit(1), n), F.slice(both["fields"], F.lit(1), n))
        return let(F.map_filter(m, lambda k, v: v != ""), _from_map)

    return F.when(header.isNotNull(), let(F.struct(names.alias("names"), csv_fields(text).alias("fields")), entry))


def with_headers(entries: DataFrame) -> DataFrame:
    """Adds ``header``, the fields of a csv source's first entry if that is a header row, and drops that entry.

    One aggregate over csv rows gives a row for each csv source; there is nothing else to carry.
    """
    first = entries.filter("format = 'csv'").groupBy("source").agg(F.min_by("text", "line_number").alias("__first"), F.min("line_number").alias("__at"))
    first = first.select("source", "__at", F.when(is_csv_header(F.col("__first")), csv_fields(F.col("__first"))).alias("header"))
    out = entries.join(first, "source", "left")
    return out.filter(~(F.col("header").isNotNull() & (F.col("line_number") == F.col("__at")))).drop("__at")


def parsed(text: Column, fmt: Column, header: Column | None = None, formats: list[str] | None = None) -> Column:
    """What the format's parser finds; null where it rejects the text. ``formats``: those that occur, if known."""
    parsers = {
        "json": json, "logfmt": logfmt, "syslog-rfc3164": syslog_3164, "syslog-rfc5424": syslog_5424, "clf": clf,
        "docker-json": docker_json, "docker-compose": docker_compose, "cloudwatch": cloudwatch, "kubernetes": kubernetes, "generic": generic,
    }
    out = raw(text)
    for name, p in parsers.items():
        if formats is None or name in formats:
            out = F.when(fmt == name, p(text)).otherwise(out)
    return out if header is None or formats is not None and "csv" not in formats else F.when(fmt == "csv", csv(text, header)).otherwise(out)


def finished(rows: DataFrame, ref_year: int) -> DataFrame:
    """``log_entry`` rows from rows with ``__p``, what parsers found: times and levels are read once, for all formats.

    A level word that names a level goes before the parser's own rank; what is still unknown is inferred
    from the message. Only RFC 3164 times, which lack a year, take ``ref_year``.
    """
    rows = rows.filter("__p IS NOT NULL")
    ts = T.parse(F.col("__p.ts"), ref_year)
    ts = F.when((F.col("format") == "syslog-rfc3164") | ~F.coalesce(F.col("__p.ts"), F.lit("")).rlike("^[A-Z][a-z]{2} +[0-9]{1,2} [0-9]"), ts)
    named = let(L.rank(F.col("__p.word")), lambda k: F.when(k > 0, k).otherwise(F.col("__p.level")))
    level = let(named, lambda k: F.when((k == 0) & (F.col("__p.message") != ""), L.infer(F.col("__p.message"))).otherwise(k))
    rows = once(rows, __ts=ts, __level=level).filter("NOT __p.timed OR __ts IS NOT NULL")
    return rows.select(F.col("__ts").alias("timestamp"), F.col("__level").alias("level"), "source", F.col("__p.message").alias("message"), F.col("text").alias("raw_line"), "line_number", F.col("__p.metadata").alias("metadata"), "format")


def parse(entries: DataFrame, ref_year: int, formats: list[str] | None = None) -> DataFrame:
    """``log_entry`` rows: timestamp, level, source, message, raw_line, line_number, metadata (and format).

    Entries that their parser rejects are left out. With the ``formats`` that occur (there are twelve) only
    their parsers go into the plan.
    """
    rows = with_headers(entries) if formats is None or "csv" in formats else entries.withColumn("header", F.lit(None).cast("array<string>"))
    return finished(once(rows, __p=parsed(F.col("text"), F.col("format"), F.col("header"), formats)), ref_year)


def source_stats(entries: DataFrame) -> DataFrame:
    """(source, format, level, n): entries of each source by level."""
    return entries.groupBy("source", "format", "level").agg(F.count("*").alias("n"))


def numbered(df: DataFrame, by: str = "source") -> DataFrame:
    """``line_number`` for rows that have none, in the order they come in."""
    return df.withColumn("line_number", F.row_number().over(Window.partitionBy(by).orderBy(F.monotonically_increasing_id())))
