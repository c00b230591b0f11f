"""Timestamps in the layouts that logs use, always UTC; null where nothing fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Layouts, stated as what a text must look like. Seconds may have a fraction, after a dot or a comma.
_FRACTION = r"([.,]\d+)?"
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}" + _FRACTION + r"(Z|[+-]\d{2}:\d{2})?$"
_SPACED = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}" + _FRACTION + "$"
_CLF = r"^\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}" + _FRACTION + r" [+-]\d{4}$"
_KIBANA = r"^[A-Z][a-z]{2} \d{1,2}, \d{4} @ \d{2}:\d{2}:\d{2}[.,]\d{3}$"
_BSD = r"^[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}" + _FRACTION + "$"
#: What may stand before a message: layouts that begin with a digit, as far as they go, and epochs padded to 15 characters.
PREFIX = (
    r"^(\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})?| \d{2}:\d{2}:\d{2}(?:[.,]\d+)?)"
    r"|\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}(?:[.,]\d+)? [+-]\d{4}|\d{10} {5}|\d{11} {4}|\d{12} {3}|\d{13} {2}|\d{14} |\d{15}(?!\d))"
)


def parse(text: Column, ref_year: int | None = None) -> Column:
    """The timestamp that the whole text is: ISO with or without zone, spaced, CLF, Kibana, BSD (with ``ref_year``), epoch.

    Digits past microseconds are cut off. Epochs: above 10^15 nothing, above 10^12 milliseconds, above 10^9
    seconds, else nothing.
    """
    def read(s: Column) -> Column:
        whole = F.regexp_replace(F.regexp_replace(s, r"(:\d{2}),(\d)", "$1.$2"), r"(:\d{2}\.\d{6})\d+", "$1")
        number = F.try_to_number(F.when(s.rlike(r"^\d{10,16}$"), s), F.lit("9" * 16)).cast("long")
        epoch = F.when(number > 10**15, F.lit(None).cast("timestamp")).when(number > 10**12, F.timestamp_millis(number)).when(number > 10**9, F.timestamp_seconds(number))
        out = F.when(s.rlike(_ISO) | s.rlike(_SPACED), whole.try_cast("timestamp"))
        out = out.when(s.rlike(_CLF), F.try_to_timestamp(whole, F.lit("dd/MMM/yyyy:HH:mm:ss[.SSSSSS] Z")))
        out = out.when(s.rlike(_KIBANA), F.try_to_timestamp(whole, F.lit("MMM d, yyyy '@' HH:mm:ss.SSS")))
        if ref_year is not None:
            out = out.when(s.rlike(_BSD), F.try_to_timestamp(F.concat(F.lit(f"{ref_year} "), F.regexp_replace(whole, " +", " ")), F.lit("yyyy MMM d HH:mm:ss[.SSSSSS]")))
        return out.otherwise(epoch)

    return let(F.trim(text), read)


def prefix(text: Column) -> Column:
    """The text of the timestamp that a text begins with; empty if none."""
    return F.regexp_extract(text, PREFIX, 1)
