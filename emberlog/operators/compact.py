"""Scoring, sections and the budgeted summary."""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions.text import tokens

#: Weights of a score, and each section's share of the budget.
LEVEL_WEIGHT = {L.FATAL: 100, L.ERROR: 60, L.WARN: 20, L.INFO: 5}
SPIKE, CHAIN, DEPLOY, PER_LOG, MOST_COUNTED = 40, 50, 30, 5, 20
SHARES = {"overview": 5, "chains": 45, "anomalies": 20, "critical": 10, "context": 20}
TITLES = {"overview": "Overview", "chains": "Error Chains", "anomalies": "Anomalies", "critical": "Critical Errors", "context": "Context"}
BUDGET, HEADING = 8192, 5


def score() -> Column:
    """Level, spike, chain and deployment weights, and five for each doubling of occurrences up to twenty."""
    level = F.lit(0)
    for k, w in LEVEL_WEIGHT.items():
        level = F.when(F.col("level") == k, w).otherwise(level)
    n = F.least(F.coalesce("occurrence_count", F.lit(1)), F.lit(MOST_COUNTED))
    often = F.when(n > 1, PER_LOG * (F.length(F.bin(n)) - 1)).otherwise(0)
    flag = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0)
    total = level + flag(F.col("is_spike"), SPIKE) + flag(F.coalesce("chain_id", F.lit("")) != "", CHAIN) + flag(F.col("is_deployment"), DEPLOY) + often
    return total.cast("long")


def section() -> Column:
    """The first section that claims a row; null if none does."""
    bad = F.col("level") >= L.ERROR
    out = F.when((F.coalesce("chain_id", F.lit("")) != "") & bad, "chains")
    out = out.when(F.coalesce("is_spike", F.lit(False)), "anomalies").when(bad, "critical")
    return out.when(F.col("level").isin(L.WARN, L.INFO), "context")


def entry_text() -> Column:
    """``time [LEVEL] source: message {tags}``; a row without a time shows the zero time."""
    ts = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("0001-01-01T00:00:00Z"))
    tag = lambda label, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(label), c.cast("string")))
    tags = F.concat_ws(
        " ", tag("chain:", F.col("chain_id")), F.when(F.col("is_deployment"), "deploy"), F.when(F.col("is_spike"), "spike"), F.when(F.col("occurrence_count") > 1, F.concat(F.lit("×"), F.col("occurrence_count").cast("string"))),
        tag("http:", F.col("http_status")), tag("err:", F.col("error_type")), tag("trace:", F.col("trace_id")),
    )
    head = F.concat(ts, F.lit(" ["), L.name(F.col("level")), F.lit("] "), F.coalesce("source", F.lit("")), F.lit(": "), F.coalesce("message", F.lit("")))
    return F.when(tags == "", head).otherwise(F.concat(head, F.lit(" {"), tags, F.lit("}")))


def rank_order() -> list[Column]:
    """Best first; a total order."""
    return [F.desc("score"), F.col("timestamp").asc_nulls_first(), F.col("source"), F.col("line_number").asc_nulls_last(), F.col("message")]


def scored(df: DataFrame) -> DataFrame:
    """Rows of INFO and above with score and section; of each chain only the best row in its section stays."""
    rows = df.filter(F.col("level") >= L.INFO).withColumn("score", score()).withColumn("section", section())
    best = F.row_number().over(Window.partitionBy("section", "chain_id").orderBy(*rank_order()))
    chained = rows.filter("section = 'chains'").withColumn("__best", best).filter("__best = 1").drop("__best")
    return rows.filter("section IS NULL OR section <> 'chains'").unionByName(chained)


def budget_of(name: str, budget: int = BUDGET) -> int:
    return max(0, budget * SHARES[name] // 100 - HEADING)


def budgeted(df: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of each section that its budget holds: best first, the first always, until one doesn't fit.

    Every shown row costs a token or more, so rows past the budget's number cannot be shown: the ranks are
    cut there first, which Spark does below the shuffle, and the running sum sees at most ``budget`` rows.
    """
    rows = df.filter("section IS NOT NULL").withColumn("entry", entry_text()).withColumn("tokens", tokens(F.concat(F.col("entry"), F.lit("\n"))))
    place = Window.partitionBy("section").orderBy(*rank_order())
    rows = rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= budget)
    running = F.sum("tokens").over(Window.partitionBy("section").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    limit = F.lit(0)
    for name in SHARES:
        limit = F.when(F.col("section") == name, budget_of(name, budget)).otherwise(limit)
    return rows.withColumn("running", running).filter((F.col("running") <= limit) | (F.col("place") == 1))


def overview(df: DataFrame) -> DataFrame:
    """One row: window, counts, spikes, sources (the first five and how many) and chains in order of rank."""
    timed = df.filter("timestamp IS NOT NULL")
    count = lambda c: F.count_if(c)
    rank = F.struct(-F.col("score"), F.col("timestamp"), F.col("source"))
    chains = timed.filter("chain_id IS NOT NULL").groupBy("chain_id").agg(F.min(rank).alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "chain_id"))), lambda x: x["chain_id"]), ", ").alias("chains"))
    main = timed.agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        count(F.col("level") == L.FATAL).alias("fatal"), count(F.col("level") == L.ERROR).alias("error"), count(F.col("level") == L.WARN).alias("warn"),
        count(F.col("is_spike")).alias("spikes"),
        F.count_distinct("source").alias("n_sources"),
    )
    names = timed.filter("source <> ''").groupBy("source").agg(F.lit(1).alias("one")).orderBy("source").limit(5).agg(F.array_sort(F.collect_list("source")).alias("sources"))
    return main.join(chains, F.lit(True)).join(names, F.lit(True))


def _duration(seconds: int) -> str:
    """Hours, minutes and seconds, the larger ones only where needed."""
    h, m, s = seconds // 3600, seconds // 60 % 60, seconds % 60
    return (f"{h}h" if h else "") + (f"{m}m" if h or m else "") + f"{s}s"


def _overview_text(df: DataFrame) -> str:
    r = overview(df).first()
    if r is None or r["first"] is None:
        return "No significant log entries found."
    utc = lambda t: t.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    more = f", +{r['n_sources'] - 5} more" if r["n_sources"] > 5 else ""
    span = round((r["last"] - r["first"]).total_seconds())
    out = [f"Window: {utc(r['first'])} — {utc(r['last'])} ({_duration(span)})", f"Sources: {r['n_sources']} ({', '.join(r['sources'])}{more})", f"Events: {r['fatal']} fatal, {r['error']} error, {r['warn']} warn"]
    out += [f"Error chains detected: {r['chains']}"] if r["chains"] else []
    out += [f"Rate spikes: {r['spikes']}"] if r["spikes"] else []
    return "\n".join(out)


def truncated(text: str, budget: int) -> str:
    """Cut to the budget's bytes (3.5 for a token), back to the last line end."""
    raw = text.encode()
    most = budget * 7 // 2
    if len(raw) <= most:
        return text
    cut = raw[:most]
    at = cut.rfind(b"\n")
    return (cut[:at] if at > 0 else cut).decode(errors="ignore")


def summary(df: DataFrame, budget: int = BUDGET) -> str:
    """The summary text. Only rows that the budget holds, and counts, come to the driver."""
    rows = scored(df)
    shown: dict[str, list[str]] = {k: [] for k in SHARES}
    for r in budgeted(rows, budget).orderBy("section", "place").select("section", "entry").collect():
        shown[r["section"]].append(r["entry"])
    totals = {r["section"]: r["n"] for r in rows.filter("section IS NOT NULL").groupBy("section").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return "No significant log entries found."
    head = truncated(_overview_text(df.filter(F.col("level") >= L.INFO).withColumn("score", score())), budget_of("overview", budget))
    out = [f"## {TITLES['overview']}\n{head}"]
    for name in [*SHARES][1:]:
        rest = totals.get(name, 0) - len(shown[name])
        lines = shown[name] + ([f"({rest} more entries omitted)"] if rest else [])
        out.append(f"## {TITLES[name]}\n" + ("\n".join(lines) or "(none)"))
    return "\n\n".join(out) + "\n"
