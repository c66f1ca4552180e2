"""Ordered computations without a one-task window.

A window with an ORDER BY and few partitions sends a whole feature (or the whole table) to one task.
The functions here deal the rows by ranges of (group, order), as many as the rows need, total each range, and add
the totals of the earlier ranges to a running sum taken inside the range.  One group may reach over many ranges
and one range hold many groups.  The only unsplit window runs over the range totals, one row for each range that
a group reaches into.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.session import settled

RANGE_ROWS = 1 << 17  # rows of a range


def portable_hash(id_col: Column | str, seed: int | str | Column = 0) -> Column:
    """Seeded mixing hash of a number or text that any SQL engine can repeat: hex ``md5(seed || ':' || id)``.

    The order of the hashes is a new random order for every seed.
    """
    value = F.col(id_col) if isinstance(id_col, str) else id_col
    start = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(start.cast("string"), F.lit(":"), value.cast("string")))


def hash_number(hash_col: Column, digits: int = 13) -> Column:
    """The leading hexadecimal digits of a portable hash as a number; 13 digits are 52 bits."""
    return F.conv(F.substring(hash_col, 1, digits), 16, 10).cast("bigint")


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "_range") -> tuple[DataFrame, int]:
    """``df``, settled, with ``name``: which range of (by, order) a row is in, ascending; and the number of ranges.

    Ranges hold about RANGE_ROWS rows, so their number follows the rows; the splitters come from a sample that
    Spark takes in proportion to their number.  Rows may be split anywhere, inside a group and between equal rows.
    """
    held = settled(df)
    parts = max(1, ceil(held.count() / RANGE_ROWS))
    if parts == 1:
        return held.withColumn(name, F.lit(0)), 1
    dealt = held.repartitionByRange(parts, *[F.col(f"`{c}`") for c in (*by, *order)])
    return settled(dealt.withColumn(name, F.spark_partition_id())), parts


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add ``<c>_before`` (sum over earlier rows of the group) and ``<c>_total`` for each column.

    Rows must be unique in (by, order); aggregate first.
    """
    by = list(by)
    ranged, parts = in_ranges(df, by, order)
    keys = by if by else ["_all"]
    if not by:
        ranged = ranged.withColumn("_all", F.lit(0))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = {c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}
    whole = Window.partitionBy(*keys)
    if parts == 1:
        whole = Window.partitionBy(*keys, "_range")
        out = ranged.withColumns({f"{c}_total": F.sum(c).over(whole) for c in sums} | {f"{c}_before": v for c, v in own.items()})
        return out.select(*df.columns, *[f"{c}_total" for c in sums], *[f"{c}_before" for c in sums])
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in [*keys, "_range"]],
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(whole).alias(f"{c}_total") for c in sums],
    )
    same = F.lit(True)
    for k in [*keys, "_range"]:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = ranged.withColumns({f"{c}_before": v for c, v in own.items()}).join(offsets, same)
    out = joined.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"_o_{c}") for c in sums})
    return out.select(*df.columns, *[f"{c}_total" for c in sums], *[f"{c}_before" for c in sums])


def ranked(df: DataFrame, by: Sequence[str], id_col: str, seed: int | Column = 0, name: str = "rank") -> DataFrame:
    """Random but repeatable 1-based rank inside each group, by portable hash then id.

    Adds ``name`` and ``name + '_of'`` (the group size).  Ids, numbers or text, must be unique inside a group.
    """
    hashed = df.withColumns({"_h": portable_hash(id_col, seed), "_one": F.lit(1).cast("bigint")})
    out = running_sum(hashed, by, ["_h", id_col], ["_one"])
    return out.withColumns({name: F.col("_one_before") + 1, f"{name}_of": F.col("_one_total")}).drop(
        "_h", "_one", "_one_before", "_one_total"
    )


def value_counts(df: DataFrame, by: Sequence[str], value: str, name: str = "n") -> DataFrame:
    """Non-null values of each group with their multiplicity; the map-side combine absorbs hot values."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias(name))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact linearly interpolated quantiles per group without a per-group value buffer."""
    by = list(by)
    ranks = running_sum(value_counts(df, by, value, "_n"), by, [value], ["_n"])

    def at(index: Column) -> Column:
        inside = (F.col("_n_before") <= index) & (index < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    aggs = []
    for i, p in enumerate(probs):
        pos = F.col("_n_total") * F.lit(float(p)) - F.lit(float(p))
        aggs += [
            at(F.floor(pos)).alias(f"_lo{i}"),
            at(F.ceil(pos)).alias(f"_hi{i}"),
            F.max(pos - F.floor(pos)).alias(f"_fr{i}"),
        ]
    out = ranks.groupBy(*by).agg(*aggs)
    return out.select(
        *by,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_fr{i}")).alias(n)
            for i, n in enumerate(names)
        ],
    )
