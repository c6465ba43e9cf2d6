"""Calendar helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_start(year: Column) -> Column:
    """January 1st of a year, without a time zone."""
    return F.make_date(year.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")


def day_code(day: Column) -> Column:
    """Two-digit year and day of the year, as one number (YYddd)."""
    return ((F.year(day) % 100) * 1000 + F.dayofyear(day)).cast("int")
