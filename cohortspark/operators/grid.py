"""Dense hourly grids: assembly, clipping, padding, skeleton extension."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.times import base_grid, whole_hours


def on_stay_clock(
    events: DataFrame, stays: DataFrame, keys: Sequence[str], time: str = "charttime", start: str = "intime", name: str = "hours"
) -> DataFrame:
    """Whole hours since the stay began; rows before hour 0 are dropped."""
    clock = stays.select(*keys, F.col(start).alias("_start"))
    out = events.join(clock, list(keys)).withColumn(name, whole_hours(time, "_start")).drop("_start")
    return out.filter(F.col(name) >= 0)


def intervals_on_stay_clock(
    events: DataFrame, stays: DataFrame, keys: Sequence[str], start: str = "starttime", end: str = "endtime", intime: str = "intime"
) -> DataFrame:
    """start_hours and end_hours of interval rows, both truncated toward zero."""
    clock = stays.select(*keys, F.col(intime).alias("_start"))
    joined = events.join(clock, list(keys))
    return joined.withColumns(
        {"start_hours": whole_hours(start, "_start"), "end_hours": whole_hours(end, "_start")}
    ).drop("_start")


def hour_grid(stays: DataFrame, keys: Sequence[str], start: str = "intime", end: str = "outtime", at_least: int | None = None) -> DataFrame:
    """Grid rows of every stay; optionally only stays reaching a number of hours, decided before exploding."""
    if at_least is not None:
        stays = stays.filter(whole_hours(end, start) >= at_least)
    return base_grid(stays, list(keys), start, end)


def assemble(grid: DataFrame, sources: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Grid left-joined to each wide source.  All sides are partitioned by the same keys, so the grid is
    shuffled once and keeps its partitioning through the chain."""
    return reduce(lambda left, right: left.join(right, list(on), "left"), sources, grid)


def assemble_long(
    grid: DataFrame, sources: Sequence[DataFrame], on: Sequence[str], features: Sequence[str], how: Column | None = None
) -> DataFrame:
    """The same from long sources (on, feature, value): one union, one pivot, one join."""
    stacked = reduce(DataFrame.unionByName, [s.select(*on, "feature", "value") for s in sources])
    wide = stacked.groupBy(*on).pivot("feature", list(features)).agg(how if how is not None else F.avg("value"))
    return grid.join(wide, list(on), "left")


def clip(df: DataFrame, keys: Sequence[str], order: Sequence[str], steps: int, step: str = "step") -> DataFrame:
    """First ``steps`` rows of each key, with the 0-based row number.  The limit applies before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(step, F.row_number().over(w)).filter(F.col(step) <= steps)
    return out.withColumn(step, (F.col(step) - 1).cast("bigint"))


def clip_pad(df: DataFrame, keys: Sequence[str], order: Sequence[str], steps: int, pad: bool = True, step: str = "step") -> DataFrame:
    """Clip to ``steps`` rows and pad shorter stays with rows that hold only the keys and the row number."""
    clipped = clip(df, keys, order, steps, step)
    if not pad:
        return clipped
    return _repeat_last(clipped, keys, step, F.lit(steps - 1).cast("bigint"))


def _repeat_last(df: DataFrame, keys: Sequence[str], place: str, until: Column) -> DataFrame:
    """After the last row of each key, add rows up to place ``until`` that hold only the keys and the place.

    The last row itself is exploded, so the input is read once and stays in its partitions.
    """
    w = Window.partitionBy(*keys).orderBy(place)
    last = df.withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    here = F.col(place).cast("bigint")
    places = F.when(F.col("_last") & (until > here), F.sequence(here, F.greatest(here, until))).otherwise(F.array(here))
    grown = last.withColumn("_place", F.explode(places))
    own = F.col("_place") == here
    cells = []
    for c, kind in df.dtypes:
        if c in keys:
            cells.append(F.col(f"`{c}`"))
        elif c == place:
            cells.append(F.col("_place").cast(kind).alias(c))
        else:
            cells.append(F.when(own, F.col(f"`{c}`")).alias(c))
    return grown.select(*cells)


def extend_hours(df: DataFrame, keys: Sequence[str], rows: int = 30, hour: str = "hours") -> DataFrame:
    """Stays with fewer rows than ``rows`` get the missing number of hours after their last one, values null."""
    w = Window.partitionBy(*keys).orderBy(hour)
    numbered = df.withColumn("_rn", F.row_number().over(w))
    until = F.col(hour).cast("bigint") + F.lit(rows) - F.col("_rn")
    return _repeat_last(numbered, keys, hour, until).drop("_rn")


def sequence_arrays(
    df: DataFrame, keys: Sequence[str], step: str, columns: Sequence[str], pad_value: float | None = -1.0, name: str = "sequence"
) -> DataFrame:
    """(keys, sequence): one array of row vectors per stay, in step order, nulls replaced by ``pad_value``."""
    cell = lambda c: F.col(f"`{c}`").cast("double")
    vector = F.array(*[cell(c) if pad_value is None else F.coalesce(cell(c), F.lit(pad_value)) for c in columns])
    rows = df.select(*keys, F.struct(F.col(step).alias("s"), vector.alias("v")).alias("_r"))
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_r")).alias("_a"))
    return packed.select(*keys, F.transform("_a", lambda r: r["v"]).alias(name))


def flatten_sequences(df: DataFrame, keys: Sequence[str], step: str, columns: Sequence[str], pad_value: float = -1.0, name: str = "vector") -> DataFrame:
    """(keys, vector): T rows of a stay as one flat vector, nulls replaced."""
    seq = sequence_arrays(df, keys, step, columns, pad_value, "_seq")
    return seq.select(*keys, F.flatten("_seq").alias(name))


