"""Imputation over row position inside a subject, and window statistics.

A subject may own a large share of the table, so the windows run inside (subject, chunk) when a chunk column
is given (the stay, or a time period; it must grow with the order).  Only one summary row per chunk is then
windowed over the whole subject, to carry the last and next observed value across chunk borders.

Backward fills use a descending running window: a frame that ends at UNBOUNDED FOLLOWING is quadratic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.filters import unpivot
from cohortspark.operators.ordered import exact_quantiles, in_ranges, running_sum
from cohortspark.session import settled

_UP = (Window.unboundedPreceding, 0)
_BEFORE = (Window.unboundedPreceding, -1)


def nearest_observed(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], chunk: str | None = None) -> DataFrame:
    """Add ``_pos`` and, per column i, ``_p{i}`` / ``_n{i}``: (pos, x) of the last value at or before the row and
    of the first value at or after it.

    Rows are scanned inside (by, chunk), one summary row of each chunk inside ``by``.  ``chunk`` is monotone in the
    order; without it, chunks are ranges of rows, so that a subject with any share of the rows is split.
    """
    if chunk is None:
        ranged, parts = in_ranges(df, by, order)
        if parts > 1:
            return nearest_observed(ranged, by, order, columns, "_range").drop("_range")
        df = ranged.drop("_range")
    group = [*by, chunk] if chunk else list(by)
    w = Window.partitionBy(*group).orderBy(*[F.col(o) for o in order])
    back = Window.partitionBy(*group).orderBy(*[F.col(o).desc() for o in order])
    local = df.withColumn("_pos", F.row_number().over(w))
    seen = {i: F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col(f"`{c}`").alias("x"))) for i, c in enumerate(columns)}
    local = local.withColumns({f"_o{i}": s for i, s in seen.items()})
    local = local.withColumns(
        {f"_p{i}": F.last(f"_o{i}", True).over(w.rowsBetween(*_UP)) for i in seen}
        | {f"_n{i}": F.last(f"_o{i}", True).over(back.rowsBetween(*_UP)) for i in seen}
    )
    if chunk is None:
        return local.drop(*[f"_o{i}" for i in seen])
    sums = local.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_len"),
        *[F.max(f"_o{i}").alias(f"_l{i}") for i in seen],
        *[F.min(f"_o{i}").alias(f"_f{i}") for i in seen],
    )
    cw, cback = Window.partitionBy(*by).orderBy(chunk), Window.partitionBy(*by).orderBy(F.col(chunk).desc())
    sums = sums.withColumn("_off", F.coalesce(F.sum("_len").over(cw.rowsBetween(*_BEFORE)), F.lit(0)))

    def shifted(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.pos") + F.col("_off")).alias("pos"), F.col(f"{c}.x").alias("x")))

    carry = sums.withColumns({f"_sl{i}": shifted(f"_l{i}") for i in seen} | {f"_sf{i}": shifted(f"_f{i}") for i in seen})
    carry = carry.select(
        *[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(group)],
        "_off",
        *[F.last(f"_sl{i}", True).over(cw.rowsBetween(*_BEFORE)).alias(f"_cp{i}") for i in seen],
        *[F.last(f"_sf{i}", True).over(cback.rowsBetween(*_BEFORE)).alias(f"_cn{i}") for i in seen],
    )
    same = F.lit(True)
    for i, c in enumerate(group):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}"))
    out = local.join(carry, same).drop(*[f"_by{i}" for i in range(len(group))])
    out = out.withColumns(
        {f"_p{i}": F.coalesce(shifted(f"_p{i}"), F.col(f"_cp{i}")) for i in seen}
        | {f"_n{i}": F.coalesce(shifted(f"_n{i}"), F.col(f"_cn{i}")) for i in seen}
    )
    out = out.withColumn("_pos", F.col("_pos") + F.col("_off"))
    return out.drop("_off", *[f"_{k}{i}" for i in seen for k in ("o", "cp", "cn")])


def _clean(df: DataFrame, n: int) -> DataFrame:
    return df.drop("_pos", *[f"_{k}{i}" for i in range(n) for k in ("p", "n")])


def _between(i: int) -> Column:
    a, b = F.col(f"_p{i}"), F.col(f"_n{i}")
    gap = F.nullif((b["pos"] - a["pos"]).cast("double"), F.lit(0.0))
    slope = (b["x"].cast("double") - a["x"].cast("double")) * (F.col("_pos") - a["pos"]) / gap
    return F.coalesce(a["x"].cast("double") + slope, a["x"].cast("double"))


def overall_statistics(df: DataFrame, columns: Sequence[str], method: str) -> Column:
    """Scalar map column -> mean or exact median of the whole table."""
    if method == "mean":
        cells = [F.avg(F.col(f"`{c}`")).cast("double") for c in columns]
        return df.agg(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*cells)).alias("m")).scalar()
    if method == "median":
        q = exact_quantiles(unpivot(df, columns), ["feature"], "value", [0.5], ["q"])
        return q.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", "q"))).alias("m")).scalar()
    raise ValueError("method is mean or median")


def impute_linear(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], method: str = "mean", chunk: str | None = None
) -> DataFrame:
    """Linear interpolation by row position, ends extended both ways; a subject without any value gets the
    overall statistic.  (A subject with a value is filled completely, so its own statistic is never used.)"""
    near = nearest_observed(df, by, order, columns, chunk)
    overall = overall_statistics(df, columns, method)
    out = {}
    for i, c in enumerate(columns):
        filled = F.coalesce(_between(i), F.col(f"_n{i}")["x"].cast("double"), F.element_at(overall, c))
        out[c] = F.coalesce(F.col(f"`{c}`").cast("double"), filled)
    return _clean(near.withColumns(out), len(columns))


def impute_forward(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], method: str = "median", chunk: str | None = None
) -> DataFrame:
    """Forward interpolation, forward fill, backward fill, then the overall statistic.

    The backward fill closes the leading gap with the first value, as extending both ends does, so the result
    is that of :func:`impute_linear` with another default statistic.
    """
    return impute_linear(df, by, order, columns, method, chunk)


def impute_by_type(
    df: DataFrame, by: Sequence[str], order: Sequence[str], types: dict[str, str], method: str = "mean", chunk: str | None = None
) -> DataFrame:
    """Numerical: interpolate and fill forward, leading gap by the group's then the overall statistic.
    Categorical: 'NA'.  Binary: 0."""
    numeric = [c for c, k in types.items() if k == "Numerical"]
    fills = {c: F.coalesce(F.col(f"`{c}`"), F.lit("NA")) for c, k in types.items() if k == "Categorical"}
    fills |= {c: F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c, k in types.items() if k == "Binary"}
    if numeric:
        near = nearest_observed(df, by, order, numeric, chunk)
        overall = overall_statistics(df, numeric, method)
        if method == "mean":
            groups = df.groupBy(*by).agg(*[F.avg(F.col(f"`{c}`")).alias(f"_g{i}") for i, c in enumerate(numeric)])
        else:
            q = exact_quantiles(unpivot(df, numeric, by), [*by, "feature"], "value", [0.5], ["q"])
            own = [F.max(F.when(F.col("feature") == c, F.col("q"))).alias(f"_g{i}") for i, c in enumerate(numeric)]
            groups = q.groupBy(*by).agg(*own)
        groups = groups.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)})
        same = F.lit(True)
        for i, c in enumerate(by):
            same &= F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}"))
        near = near.join(groups, same, "left").drop(*[f"_by{i}" for i in range(len(by))])
        for i, c in enumerate(numeric):
            fills[c] = F.coalesce(F.col(f"`{c}`").cast("double"), _between(i), F.col(f"_g{i}"), F.element_at(overall, c))
        out = _clean(near.withColumns(fills), len(numeric))
        return out.drop(*[f"_g{i}" for i in range(len(numeric))])
    return df.withColumns(fills) if fills else df


def overall_mode(df: DataFrame, column: str) -> Column:
    """Scalar most frequent non-null value, the smallest on ties."""
    counts = df.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy().agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("m")).scalar()


def overall_modes(df: DataFrame, columns: Sequence[str]) -> Column:
    """Scalar map column -> most frequent value as text (smallest in the column's own order on ties), one pass."""
    kinds = dict(df.dtypes)
    order = lambda c: F.col(f"`{c}`").cast("double") if kinds[c] != "string" else F.lit(None).cast("double")
    cells = [F.struct(F.lit(c).alias("f"), F.col(f"`{c}`").cast("string").alias("v"), order(c).alias("o")) for c in columns]
    counts = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter(F.col("v").isNotNull())
    counts = counts.groupBy("f", "v", "o").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("f").agg(F.min_by("v", F.struct(-F.col("n"), F.col("o"), F.col("v"))).alias("m"))
    return top.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("f", "m")))).scalar()


def impute_category(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], chunk: str | None = None) -> DataFrame:
    """Forward then backward fill inside the subject; a subject without any value gets the overall mode."""
    near = nearest_observed(df, by, order, columns, chunk)
    modes, kinds = overall_modes(df, columns), dict(df.dtypes)
    out = {
        c: F.coalesce(F.col(f"_p{i}")["x"], F.col(f"_n{i}")["x"], F.try_element_at(modes, F.lit(c)).try_cast(kinds[c]))
        for i, c in enumerate(columns)
    }
    return _clean(near.withColumns(out), len(columns))


def forward_fill(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    near = nearest_observed(df, by, order, columns)
    filled = {c: F.col(f"_p{i}")["x"] for i, c in enumerate(columns)}
    return _clean(near.withColumns(filled), len(columns)).select(*[F.col(f"`{c}`") for c in df.columns])


def hour_index(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "hour_index") -> DataFrame:
    """0-based running row index per patient."""
    near = nearest_observed(df, by, order, [])
    return near.withColumn(name, (F.col("_pos") - 1).cast("bigint")).drop("_pos")


def midrank(df: DataFrame, by: Sequence[str], value: str, name: str = "midrank") -> DataFrame:
    """(by, value, n, midrank): average rank of each distinct value among all values of its group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranks = running_sum(counts, by, [value], ["n"])
    return ranks.withColumn(name, F.col("n_before") + (F.col("n") + 1) / 2.0).drop("n_before", "n_total")


def lagged_pairs(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], lag: int = 1) -> DataFrame:
    """Adds ``<c>_lag``: the value ``lag`` rows earlier inside the sequence.

    Rows meet the earlier ones by their place in the sequence, so a long sequence is no single task's.
    """
    placed = settled(hour_index(df, by, [order], "_at"))
    earlier = placed.select(
        *[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)],
        (F.col("_at") + lag).alias("_then"),
        *[F.col(f"`{c}`").alias(f"{c}_lag") for c in columns],
    )
    same = F.col("_at") == F.col("_then")
    for i, c in enumerate(by):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}"))
    return placed.join(earlier, same, "left").drop("_at", "_then", *[f"_by{i}" for i in range(len(by))])
