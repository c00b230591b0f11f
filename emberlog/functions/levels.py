"""Severity: ranks 0 (unknown) to 6 (fatal), their spellings, and inference from a message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN, TRACE, DEBUG, INFO, WARN, ERROR, FATAL = range(7)
NAMES = ["UNKNOWN", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]

#: Spellings of each rank, in upper case; digits are syslog severities.
SPELLINGS = {
    TRACE: ["TRACE", "T"],
    DEBUG: ["DEBUG", "D", "7"],
    INFO: ["INFO", "I", "6"],
    WARN: ["WARN", "WARNING", "W", "4", "5"],
    ERROR: ["ERROR", "ERR", "E", "3"],
    FATAL: ["FATAL", "CRITICAL", "CRIT", "F", "0", "1", "2"],
}


def rank(text: Column) -> Column:
    """The rank that a level's spelling names; 0 for null and anything else."""
    named = F.create_map(*(F.lit(x) for level, spellings in SPELLINGS.items() for word in spellings for x in (word, level)))
    return F.coalesce(F.try_element_at(named, F.upper(F.trim(text))), F.lit(UNKNOWN)).cast("int")


def name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), (level + 1).cast("int"))


def meets(level: Column, least: int) -> Column:
    return (level >= least) & (level != UNKNOWN)


def severity(code: Column) -> Column:
    """Rank of a syslog severity 0 to 7."""
    return F.when(code <= 2, FATAL).when(code == 3, ERROR).when(code <= 5, WARN).when(code == 6, INFO).when(code == 7, DEBUG).otherwise(UNKNOWN).cast("int")


def infer(message: Column) -> Column:
    """Rank of the first level word among a message's first five words, brackets, dashes and the like taken off.

    Words that are only digits name no level here but count among the five.
    """
    heads = F.slice(F.filter(F.split(F.coalesce(message, F.lit("")), " +", 7), lambda w: w != ""), 1, 5)
    bare = F.transform(heads, lambda w: F.btrim(w, F.lit("[]():=-")))
    ranks = F.transform(bare, lambda w: F.when(F.translate(w, "0123456789", "") == "", UNKNOWN).otherwise(rank(w)))
    return F.coalesce(F.get(F.filter(ranks, lambda r: r > 0), F.lit(0)), F.lit(UNKNOWN))
