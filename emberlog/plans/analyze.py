"""The whole analysis as one lazy plan: sources to entries to filters to enrichment to a summary."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels as L
from ..operators import anomaly, chains, compact, dedup, detect, enrich, parse, reassemble
from ..operators.filters import FilterOptions, apply, drop_counts
from ..sources import files


@dataclass
class Options:
    filter: FilterOptions = field(default_factory=FilterOptions)
    correlation_seconds: float = 5.0
    budget: int = compact.BUDGET
    ref_year: int = field(default_factory=lambda: datetime.now().year)
    chains: list[chains.Chain] = field(default_factory=lambda: [*chains.BUILTIN])

    @classmethod
    def command_line(cls, **kw) -> Options:
        """What the command line runs with: automatic window on, and only equal times correlate."""
        out = cls(**kw)
        out.filter.auto_window, out.correlation_seconds = True, 0.0
        return out


def ingest(lines: DataFrame, ref_year: int, sample: int = 100) -> DataFrame:
    """``log_entry`` rows from ``raw_line`` rows. The vote on formats reads the first lines twice: for the plan, and in it."""
    formats = detect.source_formats(lines, sample)
    names = [r["format"] for r in formats.select("format").distinct().collect()]
    return parse.parse(reassemble.entries(lines.join(formats, "source")), ref_year, names)


def filtered(entries: DataFrame, opts: FilterOptions, stdin: bool = False) -> DataFrame:
    """Survivors and summaries: filters, dedup, spikes, automatic window."""
    rows = dedup.with_signature(apply(entries, opts.filters()))
    kept = anomaly.flag_spikes(dedup.kept(rows, opts.dedup_keep), opts.spike_multiplier)
    if opts.auto_window and not stdin and not (opts.since or opts.until):
        kept = anomaly.auto_window(kept)
    out = dedup.union(kept, dedup.summaries(rows, opts.dedup_keep))
    return out.withColumn("is_spike", F.coalesce("is_spike", F.lit(False)))


def enriched(rows: DataFrame, opts: Options) -> DataFrame:
    return enrich.correlate(chains.with_chains(enrich.fields(rows), opts.chains), opts.correlation_seconds)


def filter_stats(entries: DataFrame, survivors: DataFrame, opts: FilterOptions) -> dict:
    """Counts of a run. Dropped is what didn't survive, summaries counted as survivors."""
    drops = {r["reason"]: r["n"] for r in drop_counts(entries, opts.filters()).collect()}
    one = survivors.agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.count_distinct("signature").alias("sig"), F.count_if(F.col("is_dedup_summary")).alias("sums")).first()
    by = survivors.filter((F.col("level") >= L.ERROR) & ~F.col("is_dedup_summary")).groupBy("source").agg(F.count("*").alias("n"))
    ingested = sum(drops.values())
    return {
        "ingested": ingested, "survived": one["n"], "dropped": ingested - one["n"], "drops": {k: v for k, v in drops.items() if k != "kept"}, "unique_signatures": one["sig"], "summaries": one["sums"],
        "window_start": one["a"], "window_end": one["b"], "source_breakdown": {r["source"]: r["n"] for r in by.orderBy("source").toLocalIterator()},
    }


@dataclass
class Result:
    """Rows are lazy; survivors are in the order of the log (no timestamp first, then time, source, line)."""

    entries: DataFrame
    survivors: DataFrame
    enriched: DataFrame
    stats: dict
    summary: str
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give back what was kept for further reading; the rows can still be read, from the sources."""
        for df in self.held:
            df.unpersist()


def analyze(spark: SparkSession, sources: Iterable[str] = (), opts: Options | None = None, lines: DataFrame | None = None, whole: bool = False) -> Result:
    """All stages. DataFrames in the result are lazy; stats and summary are small and computed here."""
    opts = opts or Options()
    sources = [*sources]
    raw = files.read(spark, sources, whole) if lines is None else lines
    entries = ingest(raw, opts.ref_year)
    survivors = filtered(entries, opts.filter, lines is None and sources in ([], ["-"])).cache()
    rich = enriched(survivors, opts).cache()  # statistics and every section of the summary read these two
    return Result(entries, survivors.orderBy(*dedup.order()), rich, filter_stats(entries, survivors, opts.filter), compact.summary(rich, opts.budget), [survivors, rich])
