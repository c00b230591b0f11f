"""Message-level functions: signatures and size estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P

#: A noncharacter of Unicode, which no text may hold for interchange; it marks places inside one expression.
MARK = "\uFDD0"
#: No variable part begins with another character, so most places are passed by at a glance.
_ANY = '(?=["/0-9]|[a-fA-F](?:[0-9a-fA-F]{7}|[0-9a-fA-F]{0,3}:))(?:' + "|".join(p for _, p in P.VARIABLE) + ")"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for a row, whatever later filters and projections do with them.

    Neighbouring projections are merged and filters pushed below them, each use with a copy of the expression;
    neither goes past a generator.
    """
    kinds = {name: column.alias(name) for name, column in columns.items()}
    held = df.select("*", F.explode(F.array(F.struct(*kinds.values()))).alias("__once"))
    return held.select(*(c for c in df.columns if c not in columns), *(F.col("__once").getField(name).alias(name) for name in columns))


def groups(text: Column, pattern: str, n: int, body) -> Column:
    """``body`` of the array of a pattern's ``n`` groups (from 1; "" where one takes no part), all from one match; null without one.

    The pattern must begin with ^. A ``MARK`` in the text is left out.
    """
    marked = F.regexp_replace(F.translate(text, MARK, ""), pattern, MARK + "".join(f"${k}{MARK}" for k in range(1, n + 1)))
    return let(F.split(marked, MARK, n + 2), lambda parts: F.when(F.size(parts) == n + 2, body(lambda k: F.get(parts, F.lit(k)))))


def signature(message: Column) -> Column:
    """The message with its variable parts replaced by placeholders.

    Parts are found in one pass; each is then named by the first kind found *inside* it, so a quoted text
    that holds a UUID is a UUID. Replacing kind after kind would not give the same.
    """
    def placeholder(part):
        out = F.lit("<NUM>")
        for tag, pattern in reversed(P.VARIABLE[:-1]):
            out = F.when(part.rlike(pattern), tag).otherwise(out)
        return out

    # one pass marks the parts; between marks stand text and parts by turns
    pieces = F.split(F.regexp_replace(F.translate(message, MARK, ""), f"({_ANY})", f"{MARK}$1{MARK}"), MARK, -1)
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, placeholder(x)).otherwise(x)), "")


def tokens(text: Column) -> Column:
    """Estimated tokens of a text: two sevenths of its bytes, rounded up."""
    return F.floor((F.octet_length(F.coalesce(text, F.lit(""))) * 2 + 6) / 7).cast("long")
