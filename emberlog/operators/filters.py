"""Row filters, in the order in which they are charged, and the counters of what each dropped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions import patterns as P
from ..functions.text import let


@dataclass(frozen=True)
class RowFilter:
    """A named predicate; rows it isn't true for are dropped. The hook for callers' own filters."""

    name: str
    keep: Callable[[DataFrame], Column]


def level_filter(least: int = L.WARN) -> RowFilter:
    """Unknown levels pass; so does everything from ``least`` up (0 stands for WARN)."""
    least = least or L.WARN
    return RowFilter("level", lambda df: (df["level"] == L.UNKNOWN) | (df["level"] >= least))


def time_filter(since: datetime | Column | None = None, until: datetime | Column | None = None) -> RowFilter:
    """Both ends are inside; rows without a timestamp pass."""
    def keep(df):
        ts, out = df["timestamp"], F.lit(True)
        if since is not None:
            out = out & (ts >= (since if isinstance(since, Column) else F.lit(since)))
        if until is not None:
            out = out & (ts <= (until if isinstance(until, Column) else F.lit(until)))
        return ts.isNull() | out

    return RowFilter("time", keep)


def noise_patterns(text: str) -> list[str]:
    """Patterns of a noise file: one in a line, blank lines and lines that begin with # left out."""
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def noise_filter(extra: list[str] | None = None, builtin: bool = True) -> RowFilter:
    """Drops messages that contain a pattern, whatever the case; empty messages pass."""
    found = [p.lower() for p in [*(P.NOISE if builtin else []), *(extra or [])]]

    def keep(df):
        return ~let(F.lower(F.coalesce(df["message"], F.lit(""))), lambda m: reduce(lambda a, b: a | b, (m.contains(p) for p in found), F.lit(False)))

    return RowFilter("noise", keep)


def drop_reason(df: DataFrame, filters: list[RowFilter]) -> Column:
    """The first filter that a row fails; null if it passes all."""
    out = F.lit(None).cast("string")
    for f in reversed(filters):
        out = F.when(~F.coalesce(f.keep(df), F.lit(False)), f.name).otherwise(out)
    return out


def apply(df: DataFrame, filters: list[RowFilter]) -> DataFrame:
    """The rows that pass; predicates reach the scan like any other filter."""
    for f in filters:
        df = df.filter(f.keep(df))
    return df


def drop_counts(df: DataFrame, filters: list[RowFilter]) -> DataFrame:
    """(reason, n): one aggregate over a single pass; ``kept`` counts what passes."""
    return df.groupBy(F.coalesce(drop_reason(df, filters), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@dataclass
class FilterOptions:
    """What a run is told; the library's defaults."""

    min_level: int = L.WARN
    since: datetime | None = None
    until: datetime | None = None
    noise: list[str] = field(default_factory=list)
    extra: list[RowFilter] = field(default_factory=list)
    dedup_keep: int = 5
    spike_multiplier: float = 10.0
    auto_window: bool = False

    def filters(self) -> list[RowFilter]:
        timed = [time_filter(self.since, self.until)] if self.since or self.until else []
        return [level_filter(self.min_level), *timed, noise_filter(self.noise), *self.extra]
