"""Cohort building: join, filters, one row per stay, attrition table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.text import unknown_if_nan
from cohortspark.operators import filters, joins, rollup

# Key columns of a stay; default filters (age 15..100, stay length 0.5..10 days).
KEYS = ("subject_id", "hadm_id", "stay_id")


@dataclass(frozen=True)
class CohortOptions:
    only_stays: bool = True
    drop_unit_transfers: bool = False
    first_stay_only: bool = False
    age: tuple[float, float] | None = (15, 100)
    length: tuple[float, float | None] | None = (0.5, 10)


def cohort_steps(patients: DataFrame, admissions: DataFrame, stays: DataFrame, options: CohortOptions = CohortOptions(), keys: Sequence[str] = KEYS) -> dict[str, DataFrame]:
    """The cohort after each step, in order; the last one is the cohort."""
    if "admission_type" in admissions.columns:
        admissions = admissions.withColumn("admission_type", unknown_if_nan("admission_type"))
    steps = {"start": joins.build_cohort(patients, admissions, stays, options.only_stays)}
    current = steps["start"]
    if options.drop_unit_transfers:
        current = steps["unit transfers removed"] = filters.same_first_last_unit(current)
    if options.first_stay_only:
        current = steps["first stay only"] = joins.first_stay(current)
    if options.age:
        current = steps["age"] = filters.age_between(current, *options.age)
    if options.length:
        current = steps["length of stay"] = filters.stay_length(current, *options.length)
    ties = [c for c in current.columns if c not in keys]
    steps["one row per stay"] = joins.keep_first(current, list(keys), ties)
    return steps


def tagged_cohort(
    patients: DataFrame, admissions: DataFrame, stays: DataFrame, options: CohortOptions = CohortOptions(), keys: Sequence[str] = KEYS
) -> tuple[DataFrame, list[str]]:
    """All rows of the first step with ``_passed``, the position of the last step each passes, and the steps' names."""
    if "admission_type" in admissions.columns:
        admissions = admissions.withColumn("admission_type", unknown_if_nan("admission_type"))
    rows, names = joins.build_cohort(patients, admissions, stays, options.only_stays).withColumn("_passed", F.lit(0)), ["start"]

    def step(rows: DataFrame, name: str, keep: Column) -> DataFrame:
        names.append(name)
        at = len(names) - 1
        on = (F.col("_passed") == at - 1) & F.coalesce(keep, F.lit(False))
        return rows.withColumn("_passed", F.when(on, at).otherwise(F.col("_passed")))

    def first(by: Sequence[str], order: Sequence[str]) -> Column:
        """Whether a row is the first of its key among the rows that got this far."""
        return F.row_number().over(Window.partitionBy(*by, F.col("_passed") == len(names) - 1).orderBy(*order)) == 1

    if options.drop_unit_transfers:
        rows = step(rows, "unit transfers removed", filters.in_one_unit())
    if options.first_stay_only:
        rows = step(rows, "first stay only", first(["hadm_id"], ["intime", "stay_id"]))
    if options.age:
        rows = filters.with_age(rows)
        rows = step(rows, "age", F.col("anchor_age").between(*options.age))
    if options.length:
        rows = step(rows, "length of stay", filters.length_between(*options.length))
    ties = [c for c in rows.columns if c not in keys and c != "_passed"]
    return step(rows, "one row per stay", first(list(keys), ties)), names


def build(patients: DataFrame, admissions: DataFrame, stays: DataFrame, options: CohortOptions = CohortOptions(), keys: Sequence[str] = KEYS) -> DataFrame:
    return list(cohort_steps(patients, admissions, stays, options, keys).values())[-1]


def attrition(
    patients: DataFrame, admissions: DataFrame, stays: DataFrame, options: CohortOptions = CohortOptions(), keys: Sequence[str] = KEYS
) -> DataFrame:
    """(position, step, subjects, admissions, stays, rows) of the cohort's steps, from one pass over the joined tables."""
    rows, names = tagged_cohort(patients, admissions, stays, options, keys)
    return rollup.attrition(rows, names, {"subjects": "subject_id", "admissions": "hadm_id", "stays": "stay_id"})


def key_frame(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.select(*[F.col(k) for k in keys])
