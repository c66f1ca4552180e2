"""Time arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000

# The timestamp layouts tried, in order.
TIMESTAMP_LAYOUTS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(text: Column | str) -> Column:
    """First layout that reads the text; null when none does.  1 to 6 fraction digits are accepted."""
    value = _col(text)
    fraction = F.regexp_extract(value, r"\.(\d{1,6})$", 1)
    padded = F.when(
        fraction != "", F.concat(F.regexp_extract(value, r"^(.*\.)\d+$", 1), F.rpad(fraction, 6, "0"))
    ).otherwise(value)
    tries = [F.try_to_timestamp(padded if "SSS" in f else value, F.lit(f)) for f in TIMESTAMP_LAYOUTS]
    return F.coalesce(*tries)


def micros(c: Column | str) -> Column:
    return F.unix_micros(_col(c).cast("timestamp"))


def fractional_hours(later: Column | str, earlier: Column | str) -> Column:
    """Elapsed hours as a double."""
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS_PER_HOUR))


def whole_hours(later: Column | str, earlier: Column | str) -> Column:
    """Elapsed hours truncated toward zero, so up to an hour before the start is still hour 0."""
    return fractional_hours(later, earlier).cast("bigint")


def hour_span(start: Column | str, end: Column | str) -> Column:
    """Array of the hours start..end; empty when end < start (``sequence`` alone would descend)."""
    first, last = _col(start).cast("bigint"), _col(end).cast("bigint")
    return F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))


def explode_hours(df: DataFrame, start: str, end: str, name: str = "hours", floor: int | None = 0) -> DataFrame:
    """Spread an interval row over its hours.  Hours below ``floor`` are never generated."""
    first = F.col(start) if floor is None else F.greatest(F.col(start), F.lit(floor))
    return df.withColumn(name, F.explode(hour_span(first, end))).drop(start, end)


def base_grid(stays: DataFrame, keys: list[str], start: str = "intime", end: str = "outtime") -> DataFrame:
    """One row per stay and hour 0..floor(length)."""
    return stays.select(*keys, F.explode(hour_span(F.lit(0), whole_hours(end, start))).alias("hours"))
