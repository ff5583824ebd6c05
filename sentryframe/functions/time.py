"""Column functions over instants.  Session zone is UTC throughout."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The one looser form that is not a reordering of year, month and day.
TWELVE_HOUR = "MM/dd/yyyy h:mm:ss a"


def micros(span: timedelta | int) -> int:
    """A timedelta (or a number of seconds) in microseconds."""
    if isinstance(span, timedelta):
        return (span.days * 86_400 + span.seconds) * 1_000_000 + span.microseconds
    return int(span) * 1_000_000


def parse_event_time(c: Column) -> Column:
    """RFC-3339 text to a timestamp, else a lenient reading, else null.

    Lenient readings: a space for ``T``, lower case, a date alone, slashes with the year first
    or last, a twelve-hour clock.  Spark keeps microseconds: fraction digits beyond the sixth
    are dropped.
    """
    cut = F.regexp_replace(F.upper(F.trim(c)), r"(\.[0-9]{6})[0-9]+", "$1")
    dashed = F.regexp_replace(cut, r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", "$1-$2-$3")
    ordered = F.regexp_replace(dashed, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", "$3-$1-$2")
    read = F.when(ordered.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), ordered.try_cast("timestamp"))
    return F.coalesce(read, F.try_to_timestamp(c, F.lit(TWELVE_HOUR)))


def between_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, truncated toward zero."""
    return ((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000).cast("long")
