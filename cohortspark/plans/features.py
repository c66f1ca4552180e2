"""Extraction of codes, transfers, medications and events of a cohort.

Every result is written to the checkpoint folder once: later steps read it several times, and plans that
carried all earlier steps along would grow with every use.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import flags, text, times, units
from cohortspark.functions.columns import compute_once
from cohortspark.operators import filters, joins, rollup
from cohortspark.plans.cohort import KEYS
from cohortspark.session import settled

# Prefixes of the flag families.
DIAGNOSES_PREFIX = "icd-10-cm_"
PROCEDURES_PREFIX = "icd-10-pcs_"
PROC_PREFIX = "proc_"
DETAIL_KEYS = ("subject_id", "hadm_id", "stay_id", "emar_id", "itemid", "emar_seq", "pharmacy_id")


def code_flags(codes: DataFrame, cohort: DataFrame, prefix: str, threshold: float = 0.01, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per admission, one 0/1 column per frequent code, rare codes folded into Others."""
    own = settled(joins.restrict_and_dedupe(codes, cohort, keys, ["seq_num"], ["icd_code"]))
    folded = rollup.fold_rare(own, "icd_code", threshold)
    return settled(rollup.code_flags(folded, joins.shared(keys, codes), "icd_code", prefix))


def diagnoses(codes: DataFrame, cohort: DataFrame, threshold: float = 0.01, code_map: DataFrame | None = None) -> DataFrame:
    if code_map is not None:
        codes = joins.translate_codes(codes, code_map)
    return code_flags(codes, cohort, DIAGNOSES_PREFIX, threshold)


def procedures(codes: DataFrame, cohort: DataFrame, threshold: float = 0.01, code_map: DataFrame | None = None) -> DataFrame:
    if code_map is not None:
        codes = joins.translate_codes(codes, code_map)
    return code_flags(codes, cohort, PROCEDURES_PREFIX, threshold)


def transfers(rows: DataFrame, cohort: DataFrame, threshold: float = 0.01, keys: Sequence[str] = KEYS) -> DataFrame:
    """Care-unit one-hot columns and a transfer flag."""
    own = settled(joins.restrict_and_dedupe(rows, cohort, keys, ["intime", "outtime"]))
    folded = rollup.fold_rare(own, "careunit", threshold)
    return settled(flags.one_hot(folded, "careunit", "careunit").withColumn("transfer", text.text_flag("eventtype", "transfer")))


def medications(
    emar: DataFrame,
    detail: DataFrame,
    cohort: DataFrame,
    label_map: DataFrame,
    standard_units: DataFrame,
    weight_streams: Sequence[DataFrame],
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Infusion rates in standard units.  Needs the cleaned input and procedure events for the weights."""
    own = joins.restrict_and_dedupe(emar, cohort, keys, ["charttime"]).filter(F.col("emar_type") == "Note")
    own = own.withColumn("charttime", times.parse_timestamp("charttime"))
    rows = joins.header_detail(own, detail, list(DETAIL_KEYS)).select(*keys, "medication", "charttime", "event_txt", "note_txt")
    rows = joins.canonical_labels(rows, label_map, "medication")
    rows = joins.unit_lookup(rows, standard_units)
    rows = compute_once(
        rows,
        {
            "hr_value": text.rate_value("note_txt", "/hr"),
            "hr_unit": text.rate_unit("note_txt", "/hr"),
            "min_value": text.rate_value("note_txt", "/min"),
            "min_unit": text.rate_unit("note_txt", "/min"),
        },
    )
    rows = compute_once(rows, {"hr_unit": units.clean_unit("hr_unit"), "min_unit": units.clean_unit("min_unit")})
    rows = rows.withColumns(
        {
            "infusion_rate": units.reading_for_standard("standard_unit", "hr_value", "min_value"),
            "infusion_rate_unit": units.reading_for_standard("standard_unit", "hr_unit", "min_unit"),
        }
    ).filter(F.col("infusion_rate").isNotNull() & F.col("infusion_rate_unit").isNotNull())
    rows = joins.subject_weight(rows, weight_streams)
    rows = units.convert_rates(rows, "infusion_rate", unit="infusion_rate_unit")
    rows = rows.filter((F.col("infusion_rate") > 0) & units.within_rate_bounds("medication", "infusion_rate"))
    rows = rows.withColumn("infusion_rate", units.repair_decimal_slip("medication", "infusion_rate"))
    return settled(rows.select(*keys, "medication", "charttime", "event_txt", "infusion_rate", "infusion_rate_unit", "standard_unit"))


def _labelled(events: DataFrame, cohort: DataFrame, label_map: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct events of the cohort with canonical labels; ``events`` already carry their item labels."""
    own = joins.restrict_to_cohort(events, cohort, keys).dropDuplicates()
    return joins.canonical_labels(own, label_map)


def chart_events(events: DataFrame, cohort: DataFrame, label_map: DataFrame, check_scores: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, charttime, value, label): numeric readings, text for the ventilator mode, out-of-range coma scores nulled."""
    rows = filters.pick_value_source(_labelled(events, cohort, label_map, keys))
    if check_scores:
        rows = filters.valid_scores(rows)
    return settled(filters.drop_placeholders(rows).select(*keys, "charttime", "value", "label"))


def output_events(events: DataFrame, cohort: DataFrame, label_map: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    rows = filters.numeric_only(filters.drop_placeholders(_labelled(events, cohort, label_map, keys)))
    return settled(rows.select(*keys, "charttime", "value", "label"))


def lab_events(events: DataFrame, cohort: DataFrame, label_map: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    rows = _labelled(events, cohort, label_map, keys).withColumn("value", F.col("valuenum"))
    return settled(rows.filter(F.col("value").isNotNull()).select(*keys, "charttime", "value", "label"))


def input_events(events: DataFrame, cohort: DataFrame, label_map: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    rows = _labelled(events, cohort, label_map, keys).withColumn("amount", text.amount_or_cc("amount"))
    return settled(rows.filter(F.col("amount").isNotNull()).select(*keys, "starttime", "endtime", "label", "amount", "patientweight"))


def procedure_events(events: DataFrame, cohort: DataFrame, label_map: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return settled(_labelled(events, cohort, label_map, keys).select(*keys, "starttime", "endtime", "label", "patientweight"))


def all_events(streams: Sequence[DataFrame]) -> DataFrame:
    """Union of point event streams, distinct, without missing values."""
    as_text = [s.withColumn("value", F.col("value").cast("string")) for s in streams]
    return reduce(DataFrame.unionByName, as_text).dropDuplicates().dropna(subset=["value"])
