"""Surgical-episode tables: operations, observations, diagnoses and medications, each with its mask."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import flags
from cohortspark.operators import filters, impute, rollup
from cohortspark.session import settled


def _finish(
    wide: DataFrame,
    keys: Sequence[str],
    time: Sequence[str],
    thresholds: Mapping[str, tuple[float, float]] | None,
    fill: str | None,
) -> tuple[DataFrame, dict[str, str]]:
    """Types, ``<column>_mask`` columns, threshold outliers to missing, fills by type inside the keys."""
    names = [c for c in wide.columns if c not in (*keys, *time)]
    wide = settled(wide)
    types = rollup.infer_types(wide, names)
    masked = flags.add_masks(wide, names)
    if thresholds:
        masked = filters.outliers_to_missing(masked, thresholds)
    if fill:
        masked = impute.impute_by_type(masked, list(keys), list(time) or list(keys), types, fill)
    return masked, types


def operations(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], thresholds: Mapping[str, tuple[float, float]] | None = None, fill: str | None = "mean"
) -> tuple[DataFrame, dict[str, str]]:
    """Durations and mortality flags added; one row per operation."""
    return _finish(flags.operation_durations(rows), keys, order, thresholds, fill)


def observations(
    rows: DataFrame,
    keys: Sequence[str],
    time: Sequence[str],
    item: str = "item_name",
    value: str = "value",
    min_share: float = 0.01,
    thresholds: Mapping[str, tuple[float, float]] | None = None,
    fill: str | None = "mean",
) -> tuple[DataFrame, dict[str, str]]:
    """Mean of each frequent item per (keys, time), one column per item."""
    names = _frequent(rows, item, min_share)
    wide = rollup.pivot(rows.filter(F.col(item).isin(names)), [*keys, *time], item, F.avg(value), names)
    return _finish(wide, keys, time, thresholds, fill)


def diagnosis_flags(rows: DataFrame, keys: Sequence[str], time: Sequence[str], code: str = "icd10_cm", min_share: float = 0.01) -> DataFrame:
    """0/1 column per frequent code and (keys, time)."""
    names = _frequent(rows, code, min_share)
    return rollup.code_flags(rows.filter(F.col(code).isin(names)), [*keys, *time], code, "", names)


def medication_flags(
    rows: DataFrame, keys: Sequence[str], time: Sequence[str], names: Sequence[str] = ("drug_name", "drug_name2", "drug_name3"), route: str = "route", min_share: float = 0.01
) -> DataFrame:
    """0/1 column per frequent drug and route over several name columns."""
    return rollup.presence_pivot_many(rows, [*keys, *time], names, route, min_share)


def _frequent(rows: DataFrame, column: str, min_share: float) -> list:
    """Levels reaching the share of all rows: at most 1 / min_share of them."""
    total = rows.groupBy().agg(F.count(F.lit(1)).alias("t")).scalar()
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return sorted(r[0] for r in counts.filter(F.col("_n") >= total * min_share).select(column).collect())
