"""Error chains: ordered three-stage sequences of messages within a time bound.

A row advances every open chain whose next stage it fits, then opens one for every pattern whose first
stage it fits; a chain expires when more than its window has passed since its start. As every open chain
of a pattern waits for the same kind of row, its course follows from "the next row of stage 1, and the
next of stage 2 after that", so chains are found with windows over the stage hits instead of a scan with
state. Hits are cut into time slices for that, so no task holds a pattern's whole history: whatever lies
beyond a chain's window cannot matter.

The closed form assumes that the cap on open chains (100 of a pattern) isn't reached. ``matched`` looks for
patterns that might reach it and runs the automaton for those, over their hits alone: each pattern for itself, and
apart wherever a whole slice without a hit leaves nothing open. Its state is the open chains, so hits stream by.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P


@dataclass(frozen=True)
class Stage:
    pattern: str
    least: int


@dataclass(frozen=True)
class Chain:
    name: str
    seconds: int
    stages: tuple[Stage, Stage, Stage]


BUILTIN = [Chain(name, seconds, tuple(Stage(p, level) for p, level in stages)) for name, seconds, stages in P.CHAINS]
CAP = 100


def _fits(stage: Stage) -> Column:
    return (F.col("level") >= stage.least) & F.coalesce("message", F.lit("")).rlike(f"(?d)(?i){stage.pattern}")


def hits(df: DataFrame, chains: list[Chain], key: list[str]) -> DataFrame:
    """(chain, stage, t, key columns): a row for each stage that a log row fits; rows that fit none are gone."""
    found = [F.when(_fits(s), F.struct(F.lit(c).cast("int").alias("chain"), F.lit(k).cast("int").alias("stage"))) for c, chain in enumerate(chains) for k, s in enumerate(chain.stages)]
    rows = df.select(*key, F.unix_micros("timestamp").alias("t"), F.explode(F.array_compact(F.array(*found))).alias("hit"))
    return rows.select("hit.chain", "hit.stage", "t", *key)


def matched(df: DataFrame, chains: list[Chain] | None = None, key: list[str] | None = None, cap: int | None = CAP) -> DataFrame:
    """(key columns, chain_id): the rows of ``df`` that belong to a chain.

    A row's chain is the last that it completes, else the first that it advances, else the first that it
    opens. Chains are numbered in order of their starts, over all patterns. A ``cap`` of None leaves the
    number of open chains unbounded.
    """
    chains, key = chains or BUILTIN, key or ["source", "line_number"]
    found = hits(df, chains, key)
    full = [] if cap is None else _full(found, chains, cap)
    rest = found.filter(~F.col("chain").isin(full)) if full else found
    starts = closed_form(rest, chains, key)
    if full:
        starts = starts.union(automaton(found.filter(F.col("chain").isin(full)), chains, key, cap))
    return named(starts, chains, key)


def _width(chains: list[Chain]) -> Column:
    return F.element_at(F.array(*(F.lit(c.seconds * 1_000_000) for c in chains)), F.col("chain") + 1)


def _place(key: list[str]) -> Column:
    """Where a row stands in the order of the log."""
    return F.struct(F.col("t").isNotNull().alias("timed"), "t", *key)


def _full(found: DataFrame, chains: list[Chain], cap: int) -> list[int]:
    """The patterns of which two slices next to each other could hold more starts than the cap."""
    starts = found.filter("stage = 0").groupBy("chain", F.floor(F.col("t") / _width(chains)).alias("slot")).agg(F.count("*").alias("n"))
    return sorted(r["chain"] for r in starts.filter(F.col("n") > cap // 2).select("chain").distinct().collect())


def closed_form(found: DataFrame, chains: list[Chain], key: list[str]) -> DataFrame:
    """(chain, at, at1, at2): the places of each chain's rows, null where it didn't come so far."""
    rows = found.select("chain", "stage", _place(key).alias("at"), _width(chains).alias("width"))
    # A chain's rows lie within one width of its start: slices of that width, each with a copy of the next
    # one's hits, hold all that matters. Rows without a time sort first and form a slice of their own;
    # chains that start there are expired by the first row with a time.
    rows = rows.withColumn("slot", F.coalesce(F.floor(F.col("at.t") / F.col("width")), F.lit(-1)))
    both = rows.withColumn("own", F.lit(True)).union(rows.filter("slot > 0").withColumn("slot", F.col("slot") - 1).withColumn("own", F.lit(False)))
    # hits of one row share its place, and only strictly later places count; backwards, as Spark carries a frame on from its start but not from its end
    ranked = both.withColumn("no", F.dense_rank().over(Window.partitionBy("chain", "slot").orderBy("at")))
    later = Window.partitionBy("chain", "slot").orderBy(F.desc("no")).rangeBetween(Window.unboundedPreceding, -1)
    nxt = lambda k: F.min(F.when(F.col("stage") == k, F.struct("no", "at"))).over(later)
    ranked = ranked.withColumn("n1", nxt(1)).withColumn("n2", nxt(2))
    # a row of stage 1 knows its own next row of stage 2; carry that along with the next row of stage 1
    via = F.min(F.when(F.col("stage") == 1, F.struct("no", "at", "n2"))).over(later)
    ranked = ranked.withColumn("via", via)
    start = ranked.filter("own AND stage = 0")
    near = lambda c: F.when(F.col("at.t").isNull() & c["t"].isNull() | (c["t"] - F.col("at.t") <= F.col("width")), c)
    start = start.withColumn("at1", near(F.col("via.at"))).withColumn("at2", F.when(F.col("at1").isNotNull(), near(F.col("via.n2.at"))))
    return start.select("chain", "at", "at1", "at2")


def named(starts: DataFrame, chains: list[Chain], key: list[str]) -> DataFrame:
    """(key columns, chain_id) from the chains' places: numbers in order of starts, counts of hours first, then inside an hour."""
    start = starts.withColumn("hour", F.coalesce(F.floor(F.col("at.t") / 3_600_000_000), F.lit(-1)))
    totals = start.groupBy("hour").agg(F.count("*").alias("n"))
    totals = totals.select("hour", F.coalesce(F.sum("n").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    start = start.join(totals, "hour").withColumn("n", F.col("before") + F.row_number().over(Window.partitionBy("hour").orderBy("at", "chain")))
    name = F.element_at(F.array(*(F.lit(c.name) for c in chains)), F.col("chain") + 1)
    start = start.withColumn("chain_id", F.concat(name, F.lit("-"), F.col("n").cast("string")))
    part = lambda col, kind, n: F.struct(F.col(col).alias("at"), F.lit(kind).alias("kind"), n.alias("order"), F.col("chain_id"))
    # completed: the last counts; advanced and opened: the first
    roles = F.array(part("at", 2, F.col("n")), part("at1", 1, F.col("n")), part("at2", 0, -F.col("n")))
    rows = start.select(F.explode(roles).alias("r")).filter("r.at IS NOT NULL").select(*(F.col(f"r.at.{k}").alias(k) for k in key), F.col("r.kind").alias("kind"), F.col("r.order").alias("order"), F.col("r.chain_id").alias("chain_id"))
    return rows.groupBy(*key).agg(F.min_by("chain_id", F.struct("kind", "order")).alias("chain_id"))


def run_automaton(rows: list[tuple], chains: list[Chain], cap: int = CAP) -> list[str | None]:
    """The definition, step by step: rows are (t or None, [(chain, stage), ...]) in log order; a chain_id or None for each."""
    alive: list[list] = []  # [chain, next stage, start, number]
    out, newest, number = [], None, 0
    for t, fits in rows:
        if t is not None and (newest is None or t > newest):
            newest = t
        if newest is not None:
            alive = [a for a in alive if a[2] is not None and newest - a[2] <= chains[a[0]].seconds * 1_000_000]
        done, moved, opened = None, None, None
        for a in alive:
            if (a[0], a[1]) in fits:
                a[1] += 1
                label = f"{chains[a[0]].name}-{a[3]}"
                if a[1] == 3:
                    done = label
                else:
                    moved = moved or label
        for c in range(len(chains)):
            if (c, 0) in fits and sum(a[0] == c for a in alive) < cap:
                number += 1
                alive.append([c, 1, t, number])
                opened = opened or f"{chains[c].name}-{number}"
        out.append(done or moved or opened)
    return out


def automaton(found: DataFrame, chains: list[Chain], key: list[str], cap: int) -> DataFrame:
    """(chain, at, at1, at2) as ``closed_form`` gives it, by the definition, cap included.

    Two hits with an empty slice of a window's width between them are over a window apart. So the runs of
    neighbouring slices of a pattern are independent; one small row for each slice tells the runs apart.
    """
    rows = found.select("chain", "stage", _place(key).alias("at"), F.floor(F.col("t") / _width(chains)).alias("slot"))
    slots = rows.filter("slot IS NOT NULL").select("chain", "slot").distinct()
    slots = slots.withColumn("run", F.col("slot") - F.row_number().over(Window.partitionBy("chain").orderBy("slot")))
    rows = rows.join(slots.withColumnsRenamed({"chain": "__c", "slot": "__s"}), (F.col("chain") == F.col("__c")) & (F.col("slot") == F.col("__s")), "left")
    # rows without a time have no slot and are a run of their own
    rows = rows.select("chain", F.struct(F.col("run").isNull().alias("untimed"), "run").alias("run"), "at", "stage")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "chain", "run").sortWithinPartitions("chain", "run", "at")
    widths = [c.seconds * 1_000_000 for c in chains]

    def run(batches):
        import pyarrow as pa

        alive: list[dict] = []  # open and completed chains of the run that haven't expired; "next" is the stage each waits for
        now, place, stages = None, None, set()

        def settle(out):  # the row at ``place`` is whole
            t = place["t"]
            if t is not None:
                gone = [a for a in alive if a["at"]["t"] is None or t - a["at"]["t"] > widths[a["chain"]]]
                out += gone
                alive[:] = [a for a in alive if a not in gone]
            for a in alive:
                if a["next"] in stages:
                    a[f"at{a['next']}"] = place
                    a["next"] += 1
            if 0 in stages and len(alive) < cap:
                alive.append({"chain": now[0], "at": place, "at1": None, "at2": None, "next": 1})

        def table(out, kind):
            return pa.RecordBatch.from_arrays([pa.array([a["chain"] for a in out], pa.int32()), *(pa.array([a[k] for a in out], kind) for k in ("at", "at1", "at2"))], ["chain", "at", "at1", "at2"])

        kind = None
        for b in batches:
            out: list[dict] = []
            kind = b.schema.field("at").type
            for chain, of, at, stage in zip(*(c.to_pylist() for c in b.columns)):
                own = (chain, of["untimed"], of["run"])
                if place is not None and (own != now or at != place):
                    settle(out)
                    stages = set()
                if own != now:
                    out += alive
                    alive.clear()
                now, place = own, at
                stages.add(stage)
            yield table(out, kind)
        if place is not None:
            out = []
            settle(out)
            yield table(out + alive, kind)

    at = rows.schema["at"].dataType.simpleString()
    return rows.mapInArrow(run, f"chain int, at {at}, at1 {at}, at2 {at}")


def with_chains(df: DataFrame, chains: list[Chain] | None = None, key: list[str] | None = None) -> DataFrame:
    """``df`` with ``chain_id``. Dedup summaries take no part."""
    key = key or ["source", "line_number"]
    own = df.filter("NOT is_dedup_summary") if "is_dedup_summary" in df.columns else df
    found = matched(own, chains, key)
    found = found.select(*(F.col(k).alias(f"__{k}") for k in key), "chain_id")
    cond = [F.col(k) == F.col(f"__{k}") for k in key]
    if "is_dedup_summary" in df.columns:
        cond.append(~F.col("is_dedup_summary"))
    return df.join(found, cond, "left").drop(*(f"__{k}" for k in key))
