"""Cohort, dictionary, interval and merge joins.

No join carries a broadcast hint unless the hinted side has a bound by construction.  Dictionaries and key
sets are left to the optimiser, which broadcasts them only when their size is below the session's threshold
and sort-merges (with skew splitting) otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.text import lower_trim
from cohortspark.functions.times import micros
from cohortspark.operators.filters import select_matching

HOUR = 3_600_000_000


def shared(keys: Sequence[str], *frames: DataFrame) -> list[str]:
    return [k for k in keys if all(k in f.columns for f in frames)]


def build_cohort(patients: DataFrame, admissions: DataFrame, stays: DataFrame, only_stays: bool = True) -> DataFrame:
    """patients ⋈ admissions ⋈ stays; the stay join is outer on the left when ``only_stays`` is off."""
    joined = patients.join(admissions, "subject_id")
    return joined.join(stays, ["subject_id", "hadm_id"], "inner" if only_stays else "left")


def restrict_to_cohort(events: DataFrame, cohort: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events of the cohort on whichever keys both sides have.

    Rows agreeing on the shared keys are taken once, as a semi join does.
    """
    on = shared(keys, events, cohort)
    return events.join(cohort.select(*on), on, "left_semi")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in the stated order.  The rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def restrict_and_dedupe(
    events: DataFrame, cohort: DataFrame, keys: Sequence[str], subset: Sequence[str], order: Sequence[Column | str] | None = None
) -> DataFrame:
    """Cohort restriction, then one row per (shared keys, subset); ties broken by the remaining columns."""
    kept = restrict_to_cohort(events, cohort, keys)
    on = [*shared(keys, events, cohort), *subset]
    ties = list(order) if order else [c for c in kept.columns if c not in on]
    return keep_first(kept, on, ties or on)


def first_stay(stays: DataFrame, by: str = "hadm_id", start: str = "intime", tie: str = "stay_id") -> DataFrame:
    return keep_first(stays, [by], [start, tie])


def decode_items(events: DataFrame, items: DataFrame, on: str = "itemid") -> DataFrame:
    return events.join(items, on)


def keep_items(events: DataFrame, items: Sequence[str], keep_label: bool = False) -> DataFrame:
    """Rows whose lower-cased label is listed."""
    out = events.withColumn("label_lower", lower_trim("label")).filter(F.col("label_lower").isin(*items))
    return out if keep_label else out.drop("label_lower")


def relabel_items(events: DataFrame, item_map: DataFrame, keep_label: bool = False) -> DataFrame:
    """Keep mapped items and replace their label; ``item_map`` is (itemid, new_label)."""
    out = events.join(item_map.select("itemid", "new_label"), "itemid")
    if keep_label:
        out = out.withColumn("label_original", F.col("label"))
    return out.withColumn("label", F.col("new_label")).drop("new_label")


def canonical_labels(events: DataFrame, label_map: DataFrame, column: str = "label", drop: str = "Others") -> DataFrame:
    """Map labels through (raw, canonical); unmapped rows and the 'Others' label are dropped."""
    mapping = label_map.select(F.col("raw").alias(column), "canonical").filter(
        F.col("canonical").isNotNull() & (F.col("canonical") != drop)
    )
    return events.join(mapping, column).withColumn(column, F.col("canonical")).drop("canonical")


def header_detail(header: DataFrame, detail: DataFrame, on: Sequence[str]) -> DataFrame:
    return header.join(detail, list(on), "left")


def unit_lookup(df: DataFrame, units: DataFrame, on: str = "medication") -> DataFrame:
    return df.join(units, on, "left")


def subject_weight(df: DataFrame, streams: Sequence[DataFrame], key: str = "subject_id", weight: str = "patientweight") -> DataFrame:
    """Mean weight of a subject over several streams, joined to every row."""
    stacked = reduce(DataFrame.unionByName, [s.select(key, weight) for s in streams])
    return df.join(stacked.groupBy(key).agg(F.avg(weight).alias(weight)), key, "left")


def translate_codes(df: DataFrame, code_map: DataFrame, keep: bool = False, drop_missing: bool = True) -> DataFrame:
    """Version 9 codes to version 10 by their first mapping (smallest target); others stay as they are.

    ``code_map`` is (icd_9, icd_10).  ``keep`` leaves the original column and adds ``icd10_code``.
    """
    first = code_map.groupBy(F.col("icd_9").alias("_c9")).agg(F.min("icd_10").alias("_c10"))
    lookup = F.when(F.col("icd_version") == 9, F.col("icd_code"))
    out = df.withColumn("_l", lookup).join(first, F.col("_l") == F.col("_c9"), "left")
    new = F.when(F.col("icd_version") == 9, F.col("_c10")).otherwise(F.col("icd_code"))
    out = out.withColumn("icd10_code", new).drop("_l", "_c9", "_c10")
    if not keep:
        out = out.withColumns({"icd_code": F.col("icd10_code"), "icd_version": F.lit(10)}).drop("icd10_code")
    return out.filter(F.col("icd_code").isNotNull()) if drop_missing else out


def translation_rate(df: DataFrame, code_map: DataFrame) -> DataFrame:
    """Per version: codes, codes with a translation, percent."""
    out = translate_codes(df, code_map, keep=True, drop_missing=False).groupBy("icd_version").agg(
        F.count("icd_code").alias("codes"), F.count("icd10_code").alias("translated")
    )
    return out.withColumn("percent", F.col("translated") * 100.0 / F.nullif(F.col("codes"), F.lit(0)))


# ---- interval joins -----------------------------------------------------------------------------

LISTED = 8  # nodes that an interval fills at its level

def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    point: str,
    start: str,
    end: str,
    closed_end: bool = True,
    slot_hours: int = 24,
) -> DataFrame:
    """Points inside intervals of the same key.

    Time is cut into slots, slots into nodes of 2 ** level slots.  An interval is listed under the nodes it touches
    at the one level where these are at most LISTED + 1, however long it is; a point under its node at every level
    that some interval has, usually one.  The join is an equi-join on (key, level, node) with the exact condition
    as residual.  A busy key is thus spread over its nodes and is never paired in full; each pair is produced once,
    because an interval has one level and a point one node there.
    """
    width = slot_hours * HOUR
    first, last = F.floor(micros(start) / width), F.floor(micros(end) / width)
    level = F.greatest(F.lit(0), F.ceil(F.log2((last - first + 1) / LISTED))).cast("int")
    i = intervals.filter(F.col(start) <= F.col(end)).withColumns({"_first": first, "_last": last, "_level": level})
    levels = i.agg(F.collect_set("_level")).scalar()  # at most one for each power of two
    size = F.expr("shiftleft(1L, _level)")
    i = i.withColumn("_node", F.explode(F.sequence(F.floor(F.col("_first") / size), F.floor(F.col("_last") / size))))
    p = points.withColumn("_slot", F.floor(micros(point) / width)).withColumn("_level", F.explode(levels))
    p = p.withColumn("_node", F.floor(F.col("_slot") / size))
    joined = p.drop("_slot").join(i.drop("_first", "_last"), [*on, "_level", "_node"])
    after = F.col(point) >= F.col(start)
    before = F.col(point) <= F.col(end) if closed_end else F.col(point) < F.col(end)
    return joined.filter(after & before).drop("_level", "_node")


def episode_lookup(
    rows: DataFrame,
    episodes: DataFrame,
    row_id: str,
    patient: str = "subject_id",
    start: str = "admission_time",
    end: str = "discharge_time",
    time: str = "chart_time",
    target: str = "op_id",
    order: str | None = None,
    slot_hours: int = 24,
) -> DataFrame:
    """Fill a missing episode id with the first episode of the patient that contains the row's time.

    "First" follows ``order`` of the episodes (the episode id by default).
    """
    rank = F.struct(F.col(order or "_ep"), F.col("_ep"))
    eps = episodes.select(patient, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(target).alias("_ep"),
                          *([order] if order and order not in (patient, start, end, target) else []))
    if order in (start, end):
        rank = F.struct(F.col("_s" if order == start else "_e"), F.col("_ep"))
    elif order == target:
        rank = F.struct(F.col("_ep"))
    has_target = target in rows.columns
    todo = rows.filter(F.col(target).isNull()) if has_target else rows
    hits = interval_join(todo.select(row_id, patient, time), eps, [patient], time, "_s", "_e", True, slot_hours)
    found = hits.groupBy(row_id).agg(F.min_by("_ep", rank).alias("_found"))
    out = rows.join(found, row_id, "left")
    value = F.coalesce(F.col(target), F.col("_found")) if has_target else F.col("_found")
    return out.withColumn(target, value).drop("_found")


def sample_timepoints(
    rows: DataFrame, windows: DataFrame, on: Sequence[str], keys: Sequence[str], time: str, start: str, end: str, n: int,
    slot_hours: int = 24,
) -> DataFrame:
    """First ``n`` distinct times of each key inside the half-open window [start, end)."""
    inside = interval_join(rows, windows, on, time, start, end, False, slot_hours)
    once = inside.select(*keys, time).distinct()
    w = Window.partitionBy(*keys).orderBy(time)
    return once.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# ---- merges -------------------------------------------------------------------------------------


def merge_tables(
    tables: Sequence[DataFrame], keys: Sequence[Sequence[str]], names: Sequence[str] | None = None, how: str = "outer"
) -> DataFrame:
    """Join tables one after another on the keys each shares with the previous one; colliding columns of the
    later table get the suffix ``__<name>``."""
    out, previous = tables[0], list(keys[0])
    for position, (table, own) in enumerate(zip(tables[1:], keys[1:]), start=1):
        on = [k for k in previous if k in own]
        suffix = f"__{names[position]}" if names else "__"
        renames = {c: f"{c}{suffix}" for c in table.columns if c in out.columns and c not in on}
        out = out.join(table.withColumnsRenamed(renames), on, how)
        previous = list(own)
    return out


def merge_type_dicts(types: Sequence[Mapping[str, str]], names: Sequence[str] | None = None) -> dict[str, str]:
    merged: dict[str, str] = {}
    for position, own in enumerate(types):
        suffix = f"__{names[position]}" if names else "__"
        merged.update({(k + suffix if k in merged else k): v for k, v in own.items()})
    return merged


def static_with_codes(cohort: DataFrame, code_tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(lambda left, right: left.join(right, shared(keys, left, right), "left"), code_tables, cohort)


def cohort_with_diagnoses(
    cohort: DataFrame,
    diagnoses: DataFrame,
    key_pattern: str = "_id",
    code_pattern: str = "icd_",
    columns: Sequence[str] | None = None,
    one_per_admission: bool = True,
    tie: Sequence[str] = ("stay_id",),
) -> DataFrame:
    """Cohort ⋈ diagnoses on (subject, admission), optionally one stay per admission, columns by pattern."""
    on = ["subject_id", "hadm_id"]
    left = keep_first(cohort, on, list(tie)) if one_per_admission else cohort
    joined = left.join(diagnoses, on)
    if columns is None:
        return joined
    return joined.select(*[F.col(f"`{c}`") for c in select_matching(joined, key_pattern, columns, code_pattern)])


def split_rows(data: DataFrame, splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Carry the split of each key to a temporal table; rows of unsplit keys are dropped."""
    return data.join(splits.select(*keys, "split").distinct(), list(keys))


def present_in(static: DataFrame, temporal: DataFrame, keys: Sequence[str]) -> DataFrame:
    return static.join(temporal.select(*keys), list(keys), "left_semi")


def repeat_static(static: DataFrame, temporal: DataFrame, key: str = "patient_id") -> DataFrame:
    """Static columns next to every hour of their patient."""
    return temporal.join(static, key)


def spread_join(df: DataFrame, lookup: DataFrame, on: Sequence[str], weight: str, share: int = 1000) -> DataFrame:
    """Left equi-join with a table of one row per key whose ``weight`` is the number of rows of ``df`` with that key.

    Keys that make 1 / ``share`` of all rows are broadcast, at most ``share`` of them, and their rows stay where they are.
    Only rows of other keys are shuffled.  ``df`` is read twice.
    """
    names = [c for c in lookup.columns if c not in on and c != weight]
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    often = F.col(weight) * F.lit(share) >= F.lit(total)
    hot, cold = F.broadcast(lookup.filter(often).select(*on, *names)), lookup.filter(~often).select(*on, *names)
    columns = [*df.columns, *names]
    served = df.join(hot, list(on)).select(*columns)
    rest = df.join(hot.select(*on), list(on), "left_anti").join(cold, list(on), "left").select(*columns)
    return served.unionByName(rest)
