"""Functions, sources, parsers, chains, compaction and the whole run on small logs."""

import gzip
import json
import random
import tarfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.functions import levels as L
from emberlog.functions import timestamps as T
from emberlog.functions.text import signature, tokens
from emberlog.operators import anomaly, chains, compact, dedup, detect, enrich, filters, parse, reassemble
from emberlog.plans import analyze, render
from emberlog.plans.config import Config, duration, moment
from emberlog.plans.providers import provider, sse
from emberlog.sources import files


def column(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("v"))).collect()]


def test_levels(spark):
    words = ["warn", " ERR ", "f", "crit", "0", "3", "5", "6", "7", "T", "debug", "123", "", None]
    assert column(spark, words, L.rank) == [4, 5, 6, 6, 6, 5, 4, 3, 2, 1, 2, 0, 0, 0]
    messages = ["[ERROR] broke", "12 34 warn: x", "a b c error", "I think", "nothing", "", None]
    assert column(spark, messages, L.infer) == [5, 4, 5, 3, 0, 0, 0]


def test_timestamps(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123456789+02:00", "2024-01-02 03:04:05,250", "02/Jan/2024:03:04:05 +0000", "Jan 2, 2024 @ 03:04:05.250", "Jan  2 03:04:05", "1704164645", "1704164645000", "2024-01-02", "99", "x", None]
    got = column(spark, texts, lambda c: F.unix_micros(T.parse(c, 2024)))
    base = 1704164645 * 10**6
    assert got == [base, base - 7200 * 10**6 + 123456, base + 250000, base, base + 250000, base, base, base, None, None, None, None]


def test_timestamp_fractions(spark):
    """Every layout, without and with a fraction after a dot or a comma."""
    layouts = ["2024-01-02T03:04:05{}Z", "2024-01-02T05:04:05{}+02:00", "2024-01-02T03:04:05{}", "2024-01-02 03:04:05{}", "02/Jan/2024:03:04:05{} +0000", "Jan  2 03:04:05{}", "Jan 2 03:04:05{}"]
    base = 1704164645 * 10**6
    for fraction, micros in (("", 0), (".5", 500_000), (",123", 123_000), (".123456789", 123_456)):
        got = column(spark, [x.format(fraction) for x in layouts], lambda c: F.unix_micros(T.parse(c, 2024)))
        assert got == [base + micros] * len(layouts), fraction
    assert column(spark, ["Jan 2, 2024 @ 03:04:05,250"], lambda c: F.unix_micros(T.parse(c, 2024))) == [base + 250_000]
    texts = ["2024-01-15T10:30:45,123 ERROR x", "02/Jan/2024:03:04:05 +0000 x", "1704164645      x", "2024-01-02 03:04:05.5Z x", "x 2024", "12 short"]
    assert column(spark, texts, T.prefix) == ["2024-01-15T10:30:45,123", "02/Jan/2024:03:04:05 +0000", "1704164645     ", "2024-01-02 03:04:05.5", "", ""]
    lines = raw_lines(spark, {"g": ["2024-01-15T10:30:45,123 ERROR one", "2024-01-15 10:30:46,5 WARN two"]})
    assert [(r["level"], r["message"], r["timestamp"].microsecond) for r in analyze.ingest(lines, 2024).orderBy("line_number").collect()] == [(5, "ERROR one", 123_000), (4, "WARN two", 500_000)]


def test_json_is_one_object(spark):
    texts = ['{"a":{"b":"}{"},"c":[{"d":1},{}]}', '{"a":1} {"b":2}', '{"a":"\\"}{"}', '{}', '{"a":1}}', '{"a":1} x', "{'a':1}", '{"a":NaN}', '  {"a":{}}  ', '["a"]', ""]
    assert [m is not None for m in column(spark, texts, detect.json_map)] == [True, False, True, True, False, False, False, False, True, False, False]


def test_parsers_are_evaluated_once(spark):
    from emberlog.functions import patterns as P

    for fmt, pattern in (("clf", P.CLF_FULL), ("syslog-rfc3164", P.SYSLOG_3164_FULL), ("json", "from_json"), ("logfmt", "regexp_extract_all"), ("csv", "regexp_extract_all")):
        lines = raw_lines(spark, {fmt: LINES[fmt]}).withColumn("format", F.lit(fmt))
        plan = parse.parse(lines, 2024, [fmt]).filter("level > 2").select("message", "timestamp")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.replace("entries", "from_json").count(pattern) <= (4 if fmt == "csv" else 2), fmt  # csv: its header row too


def test_signature(spark):
    texts = ['user 12 from 10.0.0.1:80', 'id 550e8400-e29b-41d4-a716-446655440000', 'at 2024-01-02T03:04:05 in /var/log/a.log', '"quoted 1" deadbeef99', 'say "550e8400-e29b-41d4-a716-446655440000"', "é12345678", ""]
    want = ["user <NUM> from <IP>:<NUM>", "id <UUID>", "at <TS> in <PATH>", "<STR> <HEX>", "say <UUID>", "é<HEX>", ""]
    assert column(spark, texts, signature) == want
    assert column(spark, ["", "abcdefg", "é", None], tokens) == [0, 2, 1, 0]


LINES = {
    "json": ['{"level":"error","msg":"a","ts":"2024-01-02T03:04:05Z","host":"h"}', '{"level":"info","msg":"b"}'],
    "logfmt": ['time=2024-01-02T03:04:05Z level=warn msg="say \\"hi\\"" k=1', "time=x level=info msg=b k=2"],
    "csv": ["timestamp,level,message", '2024-01-02T03:04:05Z,ERROR,"a, ""b"""'],
    "syslog-rfc3164": ["<11>Jan  2 03:04:05 h app[7]: boom"],
    "syslog-rfc5424": ['<12>1 2024-01-02T03:04:05Z h app - - [a b="c"] hello'],
    "clf": ['1.2.3.4 - - [02/Jan/2024:03:04:05 +0000] "GET / HTTP/1.1" 503 12'],
    "docker-json": ['{"log":"WARN: x\\n","stream":"stderr","time":"2024-01-02T03:04:05Z"}'],
    "docker-compose": ["web-1  | 2024-01-02T03:04:05Z ERROR down", "web-1  | plain"],
    "cloudwatch": ['{"@timestamp":"2024-01-02T03:04:05Z","@message":"ERROR: x","@logStream":"s"}'],
    "kubernetes": ["2024-01-02T03:04:05.5Z stderr F oh no", "[pod/a/b] 2024-01-02 03:04:05,1 WARN x"],
    "generic": ["2024-01-02 03:04:05 ERROR broke", "  at line 2", "2024-01-02 03:04:06 INFO fine"],
    "raw": ["just text", "ERROR: not so"],
}


def raw_lines(spark, lines=LINES):
    rows = [(f, k, x) for f, xs in lines.items() for k, x in enumerate(xs, 1)]
    return spark.createDataFrame(rows, files.RAW_LINE)


def test_formats_and_parsers(spark):
    lines = raw_lines(spark)
    assert {r["source"]: r["format"] for r in detect.source_formats(lines).collect()} == {f: f for f in LINES}
    got = {(r["source"], r["line_number"]): r for r in analyze.ingest(lines, 2024).collect()}
    levels = {k: r["level"] for k, r in got.items()}
    assert levels == {
        ("json", 1): 5, ("json", 2): 3, ("logfmt", 1): 4, ("logfmt", 2): 3, ("csv", 2): 5, ("syslog-rfc3164", 1): 5, ("syslog-rfc5424", 1): 4, ("clf", 1): 5, ("docker-json", 1): 4,
        ("docker-compose", 1): 5, ("cloudwatch", 1): 5, ("kubernetes", 1): 5, ("kubernetes", 2): 4, ("generic", 1): 5, ("generic", 3): 3, ("raw", 1): 0, ("raw", 2): 5,
    }
    assert got["docker-compose", 1]["message"] == "ERROR down\nweb-1  | plain"
    assert got["logfmt", 1]["message"] == 'say "hi"' and got["csv", 2]["message"] == 'a, "b"'
    assert got["generic", 1]["message"] == "ERROR broke\n  at line 2"
    assert got["json", 1]["metadata"] == {"host": "h"} and got["clf", 1]["metadata"]["status"] == "503"
    assert got["syslog-rfc3164", 1]["timestamp"] == got["json", 1]["timestamp"].replace(tzinfo=None)


def test_reassembly_matches_the_sequential_rule(spark):
    rng = random.Random(2)
    data = {f"s{s}": [rng.choice(["2024-01-01 00:00:00 x", "more", "", "  "]) for _ in range(40)] for s in range(30)}
    want = {}
    for s, lines in data.items():
        at = None
        for n, x in enumerate(lines, 1):
            if not x.strip():
                at = None
            elif x.startswith("2024"):
                at = n
                want[s, n] = x
            elif at:
                want[s, at] += "\n" + x
            else:
                want[s, n] = x
    lines = raw_lines(spark, data).withColumn("format", F.lit("generic"))
    for chunk in (7, 65536):
        assert {(r["source"], r["line_number"]): r["text"] for r in reassemble.entries(lines, chunk).collect()} == want


def test_sources(spark, tmp_path):
    text = "".join(f"line {k}\n" for k in range(1, 400))
    (tmp_path / "a.log").write_text(text)
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("x\ny\n")
    (tmp_path / "c.bin").write_text("no")
    with tarfile.open(tmp_path / "d.tar.gz", "w:gz") as t:
        t.add(tmp_path / "a.log", "in/a.log")
    found = files.expand(spark, [str(tmp_path), str(tmp_path / "a.log"), str(tmp_path / "missing")])
    assert sorted(p.rpartition("/")[2] for p in found) == ["a.log", "b.log.gz", "d.tar.gz"]
    by = {}
    for r in files.read(spark, [str(tmp_path)]).collect():
        by.setdefault(r["source"].rpartition("/")[2], {})[r["line_number"]] = r["text"]
    assert by["a.log"] == {k: f"line {k}" for k in range(1, 400)}
    assert by["b.log.gz:b.log"] == {1: "x", 2: "y"}
    broken = (tmp_path / "b.log.gz").read_bytes()
    (tmp_path / "e.log.gz").write_bytes(gzip.compress(text.encode())[:-300])
    (tmp_path / "f.tgz").write_bytes((tmp_path / "d.tar.gz").read_bytes()[:-40])
    (tmp_path / "g.log.gz").write_bytes(b"not gzip at all" + broken)
    again = files.read(spark, [str(tmp_path)])
    assert again.filter(F.col("source").endswith("a.log") & ~F.col("source").contains(":")).count() == 399
    assert again.filter(F.col("source").endswith("b.log")).count() == 2 and again.filter(F.col("source").contains("e.log")).count() < 399
    whole = {(r["source"], r["line_number"]): r["text"] for r in files.read_text(spark, [str(tmp_path / "a.log")], whole=True).collect()}
    assert len(whole) == 399


def entries(spark, rows):
    """rows: (seconds or None, level, source, message)."""
    data = [(None if t is None else datetime.fromtimestamp(1704164645 + t, timezone.utc), level, s, m, m, k, None) for k, (t, level, s, m) in enumerate(rows, 1)]
    return spark.createDataFrame(data, "timestamp timestamp, level int, source string, message string, raw_line string, line_number long, metadata map<string,string>")


def test_dedup_keeps_and_sums_up(spark):
    df = dedup.with_signature(entries(spark, [(k, 5, "s", f"job {k} failed") for k in range(3)]))
    one = dedup.summaries(df, 1).collect()[0]
    assert (one["occurrence_count"], one["message"]) == (3, "job 0 failed") and (one["last_seen"] - one["first_seen"]).seconds == 2
    assert dedup.union(dedup.kept(df, 1), dedup.summaries(df, 1)).count() == 2


def test_spikes(spark):
    calm = [(k, 5, "s", "x") for k in range(30)]
    df = entries(spark, calm + [(31, 5, "s", "x")] * 20 + [(None, 5, "s", "x")])
    assert anomaly.flag_spikes(df).filter("is_spike").count() == 20
    assert anomaly.flag_spikes(entries(spark, calm[:2])).filter("is_spike").count() == 0


def test_auto_window(spark):
    warns = [(60 * k, 4, "s", "w") for k in range(120)]
    errors = [(3600 + 5 * k, 5, "s", "e") for k in range(110)]
    df = anomaly.auto_window(entries(spark, warns + errors + [(None, 4, "s", "w")]))
    assert df.filter("level = 5").count() == 110 and 0 < df.filter("level = 4 AND timestamp IS NOT NULL").count() < 120 and df.filter("timestamp IS NULL").count() == 1
    assert anomaly.auto_window(entries(spark, warns)).count() == 120


def test_fields(spark):
    df = entries(spark, [(0, 5, "s", 'HTTP/1.1 503 request_id="abcdefgh-1"'), (1, 5, "s", "Caused by: java.io.Err"), (2, 3, "s", "Rolling update")])
    df = df.withColumn("metadata", F.when(F.col("line_number") == 2, F.create_map(F.lit("status"), F.lit("999"), F.lit("status_code"), F.lit(" 404 "))))
    got = enrich.fields(df).orderBy("line_number").select("http_status", "error_type", "trace_id", "is_deployment").collect()
    assert [tuple(r) for r in got] == [(503, None, "abcdefgh-1", False), (404, "java.io.Err", None, False), (None, None, None, True)]


def test_correlation(spark):
    rng = random.Random(4)
    rows = sorted(((rng.randrange(60), 5, f"s{rng.randrange(4)}", "x") for _ in range(80)), key=lambda r: (r[0], r[2]))
    for window in (0, 1, 5):
        got = {r["line_number"]: r["correlated_with"] for r in enrich.correlate(entries(spark, rows), window).collect()}
        for k, (t, _, s, _) in enumerate(rows):
            near = {s2 for j, (t2, _, s2, _) in enumerate(rows) if j < k and s2 != s and t - t2 <= window}
            assert got[k + 1] == sorted(near), (window, k)


RULES = [chains.Chain("one", 20, tuple(chains.Stage(p, 0) for p in ("a", "b", "c"))), chains.Chain("two", 7, tuple(chains.Stage(p, 0) for p in ("b", "c", "a")))]


def test_chains_match_the_automaton(spark):
    rng = random.Random(5)
    for trial in range(4):
        times = sorted(rng.randrange(90) for _ in range(50))
        rows = [(None if trial == 3 and k < 6 else t, 5, "s", "".join(rng.sample("abcx", rng.randint(1, 2)))) for k, t in enumerate(times)]
        fits = [(None if t is None else t * 1_000_000, {(c, k) for c, rule in enumerate(RULES) for k, s in enumerate(rule.stages) if s.pattern in m}) for t, _, _, m in rows]
        want = {k: i for k, i in enumerate(chains.run_automaton(fits, RULES), 1) if i}
        df = entries(spark, rows)
        assert {r["line_number"]: r["chain_id"] for r in chains.matched(df, RULES).collect()} == want
        hits = chains.hits(df, RULES, ["source", "line_number"])
        key = ["source", "line_number"]
        assert {r["line_number"]: r["chain_id"] for r in chains.named(chains.automaton(hits, RULES, key, 100), RULES, key).collect()} == want


def test_chain_cap(spark):
    rows = [(0, 5, "s", "a")] * 150 + [(1, 5, "s", "b"), (2, 5, "s", "c")]
    ids = [r["chain_id"] for r in chains.matched(entries(spark, rows), RULES[:1]).collect()]
    assert len(set(ids)) == 100 and "one-100" in ids


def test_chain_cap_by_pattern_and_gap(spark):
    rng = random.Random(7)
    times = sorted(rng.randrange(30) + 200 * rng.randrange(3) for _ in range(240))
    rows = [(None if k < 5 else t, 5, "s", rng.choice("aaabbcx")) for k, t in enumerate(times)]
    fits = [(None if t is None else t * 1_000_000, {(c, k) for c, rule in enumerate(RULES) for k, s in enumerate(rule.stages) if s.pattern in m}) for t, _, _, m in rows]
    for cap in (3, 8, 20):
        want = {k: i for k, i in enumerate(chains.run_automaton(fits, RULES, cap), 1) if i}
        assert {r["line_number"]: r["chain_id"] for r in chains.matched(entries(spark, rows), RULES, cap=cap).collect()} == want, cap


def test_builtin_chains(spark):
    said = ["lock timeout", "too many connections", "query failed"]
    got = chains.matched(entries(spark, [(k, 5, "s", m) for k, m in enumerate(said)])).collect()
    assert {r["chain_id"] for r in got} == {"db-connection-exhaustion-1"}


def test_whole_run(spark, tmp_path):
    rows = [f"2024-01-02 03:04:{k:02d} INFO fine {k}" for k in range(30)]
    rows += [f"2024-01-02 03:05:{k:02d} ERROR job {k} failed status=500" for k in range(20)]
    rows += ["2024-01-02 03:06:00 WARN deadlock found", "2024-01-02 03:06:01 ERROR too many connections", "2024-01-02 03:06:02 ERROR query failed", "2024-01-02 03:06:03 ERROR GET /healthz no"]
    (tmp_path / "app.log").write_text("\n".join(rows) + "\n")
    r = analyze.analyze(spark, [str(tmp_path)], analyze.Options(ref_year=2024))
    s = r.stats
    assert s["ingested"] == 54 and s["survived"] == 5 + 1 + 3 and s["dropped"] == 45
    assert sum(s["drops"].values()) == 31 and s["drops"] == {"level": 30, "noise": 1}
    assert "db-connection-exhaustion-" in r.summary and "(none)" in r.summary and "×20" in r.summary
    assert len(r.summary.encode()) <= 8192 * 7 // 2
    assert json.loads(render.as_json(r.summary, s))["stats"]["ingested"] == 54
    assert "| Ingested | 54 |" in render.as_markdown(r.summary, s)
    assert render.as_text(r.summary, False) == r.summary and "\x1b[1m" in render.as_text(r.summary, True)
    assert "dropped by level: 30" in render.stats_table(s)
    assert analyze.Options.command_line().correlation_seconds == 0
    empty = entries(spark, [])
    assert compact.summary(analyze.enriched(analyze.filtered(empty, filters.FilterOptions()), analyze.Options())) == "No significant log entries found."


def test_streaming(spark, tmp_path):
    from emberlog.streaming import jobs

    (tmp_path / "x.log").write_text("\n".join(f"2024-01-02 03:04:{k:02d} ERROR {m}" for k, m in enumerate(["lock timeout", "too many connections", "query failed", "job 1", "job 2"])))
    rows = jobs.entries(jobs.lines(spark, str(tmp_path)), "generic", 2024)
    assert jobs.drained(jobs.window_counts(rows), "t_counts", "complete").agg(F.sum("n")).first()[0] == 5
    assert jobs.drained(jobs.first_of_signature(rows), "t_first").count() == 4
    assert [r["chain_id"] for r in jobs.drained(jobs.chain_events(rows), "t_chains").collect()] == ["db-connection-exhaustion-1"]
    assert jobs.drained(jobs.chain_events(rows, cap=0), "t_no_chains").count() == 0
    with pytest.raises(ValueError):
        jobs.entries(rows, "csv", 2024)


def test_streaming_correlation_and_late_rows(spark, tmp_path):
    from emberlog.streaming import jobs

    schema = "timestamp timestamp, source string, line_number long"
    at = lambda rows: spark.createDataFrame([(datetime.fromtimestamp(1704164645 + t, timezone.utc), s, n) for t, s, n in rows], schema)
    parts = [[(0, "a", 1), (3, "b", 2), (3, "a", 3), (20, "c", 4)], [(7, "c", 5), (5000, "a", 6)], [(2, "d", 7), (5001, "d", 8)]]
    for k, rows in enumerate(parts):
        at(rows).coalesce(1).write.json(str(tmp_path / f"in{k}"))
    out, place = [], str(tmp_path / "state")
    for k in range(len(parts)):  # one folder for each run, so that the watermark moves between them
        folder = tmp_path / "feed"
        folder.mkdir(exist_ok=True)
        for f in (tmp_path / f"in{k}").glob("part-*.json"):
            f.rename(folder / f"{k}-{f.name}")
        stream = spark.readStream.schema(schema).json(str(folder))
        jobs.correlated(stream, 5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    out = {(r["line_number"], r["other"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # row 7 comes when the watermark is past it
    assert out == {(2, "a"), (5, "a"), (5, "b"), (8, "a")}


def test_config(tmp_path):
    assert duration("1h30m").total_seconds() == 5400
    now = datetime(2024, 1, 2, tzinfo=timezone.utc)
    assert moment("1h", now).hour == 23 and moment("2024-01-01T00:00:00Z").year == 2024
    (tmp_path / "c.toml").write_text('level = "error"\nbudget = 100\n')
    c = Config.load({"budget": 5, "format": None}, str(tmp_path / "c.toml"), {"EMBERLOG_LEVEL": "info"})
    assert (c.level, c.budget, c.min_level, c.format) == ("info", 5, 3, "text")
    for wrong in ({"level": "loud"}, {"since": "soon"}, {"until": "2024-99-01"}, {"format": "xml"}, {"noise_file": str(tmp_path / "none")}):
        with pytest.raises((ValueError, OSError)):
            Config.load(wrong, env={}).options()
    with pytest.raises(ValueError):
        _ = Config(ai_timeout="0s").timeout_seconds
    (tmp_path / "noise.txt").write_text("# own\nheartbeat\n")
    o = Config.load({"level": "error", "since": "1h", "noise_file": str(tmp_path / "noise.txt")}, env={}).options(now)
    assert (o.filter.min_level, o.filter.since.hour, o.filter.noise, o.filter.auto_window, o.correlation_seconds) == (5, 23, ["heartbeat"], True, 0.0)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io

    from emberlog.__main__ import main
    from emberlog.plans import providers

    (tmp_path / "app.log").write_text("2024-01-02 03:04:05 ERROR disk full\n2024-01-02 03:04:06 INFO fine\n2024-01-02 03:04:07 ERROR heartbeat lost\n")
    (tmp_path / "noise").write_text("heartbeat\n")
    run = lambda *a: (main([str(tmp_path / "app.log"), "--config", str(tmp_path / "none"), *a], spark, out := io.StringIO()), out.getvalue())
    code, text = run("--noise-file", str(tmp_path / "noise"))
    assert code == 0 and "disk full" in text and "heartbeat" not in text and "\x1b" not in text and "ingested: 3" in capsys.readouterr().err
    code, text = run("--format", "json", "--level", "info")
    assert code == 0 and json.loads(text)["stats"]["survived"] == 3
    code, text = run("--format", "markdown", "--output", str(tmp_path / "r.md"))
    assert code == 0 and text == "" and (tmp_path / "r.md").read_text().startswith("# Log Analysis")
    for wrong in (["--level", "loud"], ["--format", "xml"], ["--since", "x"], ["--ai-provider", "none"], ["--ai-provider", "ollama", "--ai-timeout", "0s"]):
        assert run(*wrong) == (2, "")
    monkeypatch.setattr(providers.Http, "stream", lambda self, system, prompt: iter(["it was ", "the disk"]))
    code, text = run("--ai-provider", "ollama", "--model", "m")
    assert code == 0 and text.startswith("it was the disk\n") and "## " in text
    code, text = run("--ai-provider", "ollama", "--format", "json")
    assert json.loads(text)["analysis"] == "it was the disk"


def test_providers():
    assert [*sse(["event: a", "data: 1", ": no", "data: 2", "", "data: x"])] == [("a", "1\n2"), ("message", "x")]
    p = provider("openai", "m", key="k")
    assert [*p.texts(['data: {"choices":[{"delta":{"content":"hi"}}]}', "", "data: [DONE]", ""])] == ["hi"]
    assert [*provider("ollama", "m").texts(['{"message":{"content":"yo"}}', ""])] == ["yo"]
    with pytest.raises(ValueError):
        provider("none", "m")


def test_noise_file():
    assert filters.noise_patterns("# no\n\n a b \n") == ["a b"]
    assert parse.TIME_KEYS[0] == "timestamp"
