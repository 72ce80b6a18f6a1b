"""Column expressions shared by the quality and lineage operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty text, else null."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def truncated_percentage(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent, cut to an integer; null if ``whole`` is 0.

    The ratio is taken in doubles before the multiplication, so 29 of 100 gives 28.
    """
    return (F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)).cast("int")


def iso_utc(timestamp: Column) -> Column:
    """ISO-8601 text in UTC with ``Z``; no fraction where the microseconds are 0."""
    utc = F.to_utc_timestamp(timestamp, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    exact = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.when(F.pmod(F.unix_micros(timestamp), F.lit(1_000_000)) == 0, whole).otherwise(exact)


def derived_run_id(*identity: Column) -> Column:
    """A UUID-shaped id computed from the columns that identify an event.

    The same event gets the same id in every query and after every retry.
    """
    digest = F.md5(F.to_json(F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in identity))))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
