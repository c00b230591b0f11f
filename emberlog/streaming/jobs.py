"""Structured Streaming forms of the batch operators.

Rates, level counts, dedup and correlation are windows and joins with a watermark; error chains keep open chains as
state of one group for each pattern, so there are as many groups as patterns. A row that comes after the watermark has
passed it takes no part, and so cannot revive an expired chain; rows without a timestamp take part in nothing that looks
at time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once, signature
from ..operators.chains import BUILTIN, CAP, Chain, _fits
from ..operators.parse import finished, parsed


def lines(spark: SparkSession, folder: str, source: str = "stream", per_trigger: int = 16) -> DataFrame:
    """``raw_line``-like rows of text files as they appear in a folder."""
    found = spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(folder)
    return found.select(F.lit(source).alias("source"), F.col("value").alias("text"))


def entries(rows: DataFrame, fmt: str, ref_year: int) -> DataFrame:
    """Parsed entries of one-line formats; the format is told, as a vote over a stream's first lines isn't possible."""
    if fmt == "csv":
        raise ValueError("csv needs its header row, which a stream's micro-batches don't carry")
    ready = rows.withColumn("format", F.lit(fmt)).withColumn("line_number", F.lit(None).cast("long"))
    return finished(once(ready, __p=parsed(F.col("text"), F.col("format"))), ref_year)


def window_counts(df: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, source, level, n) of tumbling windows."""
    rows = df.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "source", "level").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "source", "level", "n")


def first_of_signature(df: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first row of each signature within the watermark; state is dropped as the watermark passes."""
    return df.withColumn("signature", signature(F.coalesce("message", F.lit("")))).withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["signature"])


def correlated(df: DataFrame, seconds: float = 5.0, late: str = "10 minutes") -> DataFrame:
    """(timestamp, source, line_number, other): each other source that has a row up to ``seconds`` before a row, or at its time if it sorts first.

    A join of the stream with itself on time buckets as wide as the window, in which a row meets those of its own
    and of the bucket before; what the watermark has passed leaves the state. Each pair comes once.
    """
    width = max(int(seconds * 1_000_000), 1)
    rows = df.filter("timestamp IS NOT NULL").withWatermark("timestamp", late).select("timestamp", "source", "line_number")
    bucket = F.floor(F.unix_micros("timestamp") / width)
    before = df.filter("timestamp IS NOT NULL").select(F.col("timestamp").alias("other_time"), F.col("source").alias("other")).withWatermark("other_time", late)
    at = F.floor(F.unix_micros("other_time") / width)
    before = before.withColumn("__b", F.explode(F.array(at, at + 1)))
    near = f"__a = __b AND other <> source AND other_time >= timestamp - INTERVAL {width} MICROSECONDS AND other_time <= timestamp AND (other_time < timestamp OR other < source)"
    pairs = rows.withColumn("__a", bucket).join(before, F.expr(near)).select("timestamp", "source", "line_number", "other")
    return pairs.dropDuplicatesWithinWatermark(["source", "line_number", "other"])


def chain_events(df: DataFrame, chains: list[Chain] | None = None, cap: int = CAP) -> DataFrame:
    """(chain_id, chain, start_us, end_us) of chains as they complete, numbered within their pattern in order of starts.

    State is the next stage, start and number of each chain that hasn't expired (at most ``cap`` for a pattern,
    completed ones included), the newest time seen and the last number.
    """
    chains = chains or BUILTIN
    hit = F.explode(F.array_compact(F.array(*(F.when(_fits(s), F.struct(F.lit(c).alias("chain"), F.lit(k).alias("stage"))) for c, x in enumerate(chains) for k, s in enumerate(x.stages)))))
    rows = df.filter("timestamp IS NOT NULL").withWatermark("timestamp", "10 minutes").select("timestamp", F.unix_micros("timestamp").alias("t"), hit.alias("hit")).select("timestamp", "t", "hit.chain", "hit.stage")
    widths = [c.seconds * 1_000_000 for c in chains]
    names = [c.name for c in chains]

    def step(key, batches: Iterator, state):
        import pandas as pd

        chain, width = int(key[0]), widths[int(key[0])]
        newest, number, alive = json.loads(state.get[0]) if state.exists else [0, 0, []]
        pdf = pd.concat([*batches]).sort_values(["t", "stage"], kind="stable")
        done = []
        for t, own in pdf.groupby("t", sort=True):
            t, stages = int(t), set(own["stage"])
            newest = max(newest, t)
            alive = [a for a in alive if newest - a[1] <= width]
            for a in alive:
                if a[0] in stages:
                    a[0] += 1
                    if a[0] == 3:
                        done.append((f"{names[chain]}-{a[2]}", names[chain], a[1], t))
            if 0 in stages and len(alive) < cap:
                number += 1
                alive.append([1, t, number])
        state.update((json.dumps([newest, number, alive]),))
        yield pd.DataFrame(done, columns=["chain_id", "chain", "start_us", "end_us"])

    return rows.groupBy("chain").applyInPandasWithState(step, "chain_id string, chain string, start_us long, end_us long", "state string", "append", "NoTimeout")


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a query over all that is there now and return its rows."""
    spark = df.sparkSession
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
