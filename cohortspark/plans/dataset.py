"""Static and temporal tables of a cohort, typed, cleaned, split, clipped and padded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import flags
from cohortspark.functions.text import number_or_null
from cohortspark.functions.times import explode_hours
from cohortspark.operators import filters, grid, impute, joins, rollup, sampling
from cohortspark.plans.cohort import KEYS
from cohortspark.plans.features import DIAGNOSES_PREFIX, PROC_PREFIX, PROCEDURES_PREFIX
from cohortspark.session import settled

# Cohort columns that are not static features.
NOT_FEATURES = ("anchor_age", "admittime", "dischtime", "edregtime", "edouttime", "deathtime", "intime", "outtime")
VENT = filters.TEXT_VALUE_LABEL
SCORE_LABEL = "Glasgow coma scale"


@dataclass(frozen=True)
class DatasetOptions:
    target: str = "icu_expire_flag"
    patient: str = "subject_id"
    train: float = 0.7
    test: float = 0.3
    val: float | None = None
    steps: int = 30
    pad: bool = True
    at_least_hours: int = 12
    share: float = 0.01
    seed: int = 0
    type_threshold: int = 7
    limits: Mapping[str, Mapping] = field(default_factory=dict)


@dataclass
class Dataset:
    """Values and masks with a ``split`` column, and the metadata of their columns."""

    data: DataFrame
    mask: DataFrame
    feature_type: dict[str, str]
    dtypes: dict[str, str]
    output_dimension: dict[str, int]


def _without_constants(data: DataFrame, mask: DataFrame, types: dict, keep: Sequence[str]) -> tuple[DataFrame, DataFrame, dict]:
    """Drop columns with one distinct value in the training rows, everywhere."""
    names = [c for c in data.columns if c not in keep]
    gone = filters.constant_columns(data.filter(F.col("split") == "train"), names)
    return data.drop(*gone), mask.drop(*gone), {c: k for c, k in types.items() if c not in gone}


def static_features(cohort: DataFrame, diagnoses: DataFrame, procedures: DataFrame, options: DatasetOptions = DatasetOptions(), keys: Sequence[str] = KEYS) -> Dataset:
    wide = joins.static_with_codes(cohort, [diagnoses, procedures], keys)
    target = wide.select(*keys, options.target, "intime")
    for prefix in (DIAGNOSES_PREFIX, PROCEDURES_PREFIX):
        if any(c.startswith(prefix) for c in wide.columns):
            wide = flags.fill_flag_family(wide, prefix)
    wide = settled(wide.drop(*NOT_FEATURES))
    dtypes = flags.dtypes_of(wide)
    names = [c for c in wide.columns if c not in keys]
    mask = flags.missing_mask(wide, names, keys)
    types = rollup.infer_types(wide, names, options.type_threshold)
    typed = flags.cast_by_type(wide, types)
    typed = rollup.fold_rare_many(typed, {c: "Others" for c, k in types.items() if k == "Categorical"}, options.share, fold_null=True)
    families = (DIAGNOSES_PREFIX, PROCEDURES_PREFIX)
    types = {c: "Listwise" if c.startswith(families) else k for c, k in types.items()}
    dimensions = rollup.output_dimensions(typed, types, families)
    splits = sampling.patient_split(
        target, options.patient, options.target, ["intime", *keys], options.train, options.test, options.val, options.seed
    ).select(*keys, "split")
    data, mask = typed.join(splits, list(keys)), mask.join(splits, list(keys))
    data = settled(data)
    data, mask, types = _without_constants(data, mask, types, [*keys, "split"])
    return Dataset(data, mask, types, {c: d for c, d in dtypes.items() if c in data.columns}, dimensions)


# ---- temporal -----------------------------------------------------------------------------------


def transfer_hours(stays: DataFrame, transfers: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, hours, careunit): unit of each hour; the first unit column wins when several are set."""
    moved = transfers.withColumnsRenamed({"intime": "starttime", "outtime": "endtime"})
    on = joins.shared(keys, stays, moved)
    inside = joins.interval_join(moved, stays.select(*keys, "intime", "outtime"), on, "starttime", "intime", "outtime")
    inside = inside.withColumn("endtime", F.coalesce("endtime", "outtime")).drop("intime", "outtime")
    clocked = grid.intervals_on_stay_clock(inside, stays, keys)
    columns = sorted(c for c in transfers.columns if c.startswith("careunit_"))
    hourly = explode_hours(clocked.select(*keys, "start_hours", "end_hours", *columns), "start_hours", "end_hours")
    top = hourly.groupBy(*keys, "hours").agg(*[F.max(f"`{c}`").alias(c) for c in columns])
    return top.select(*keys, "hours", flags.first_maximum(columns).alias("careunit"))


def medication_hours(stays: DataFrame, meds: DataFrame, share: float = 0.01, keys: Sequence[str] = KEYS) -> DataFrame:
    own = joins.restrict_to_cohort(meds, stays, keys)
    kept = settled(rollup.medication_cutoff(own, "medication", share))
    clocked = grid.on_stay_clock(kept, stays, keys)
    return rollup.hourly_pivot_mean(clocked, keys, "medication", value="infusion_rate")


def point_hours(stays: DataFrame, events: DataFrame, share: float = 0.01, keys: Sequence[str] = KEYS) -> DataFrame:
    """Hourly means, one column per label."""
    kept = settled(rollup.share_cutoff(joins.restrict_to_cohort(events, stays, keys), "label", share))
    clocked = grid.on_stay_clock(kept, stays, keys)
    return rollup.hourly_pivot_mean(clocked, keys)


def chart_hours(stays: DataFrame, events: DataFrame, share: float = 0.01, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(numeric hourly means, first ventilator mode per hour with rare modes folded)."""
    kept = settled(rollup.share_cutoff(joins.restrict_to_cohort(events, stays, keys), "label", share))
    clocked = grid.on_stay_clock(kept, stays, keys)
    numeric = clocked.filter(F.col("label") != VENT).withColumn("value", number_or_null("value"))
    vent = rollup.hourly_first(clocked.filter(F.col("label") == VENT), keys).withColumnRenamed("value", VENT)
    return rollup.hourly_pivot_mean(numeric, keys), rollup.fold_rare(settled(vent), VENT, share)


def interval_hours(stays: DataFrame, inputs: DataFrame, share: float = 0.01, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    kept = settled(rollup.share_cutoff(joins.restrict_to_cohort(inputs, stays, keys), "label", share))
    clocked = grid.intervals_on_stay_clock(kept, stays, keys)
    return rollup.interval_mean(clocked, keys, "label", "amount"), rollup.interval_weight(clocked, keys)


def procedure_hours(stays: DataFrame, procs: DataFrame, share: float = 0.01, keys: Sequence[str] = KEYS, prefix: str = PROC_PREFIX) -> tuple[DataFrame, DataFrame]:
    kept = settled(rollup.share_cutoff(joins.restrict_to_cohort(procs, stays, keys), "label", share).dropna(subset=["starttime", "endtime"]))
    clocked = grid.intervals_on_stay_clock(kept, stays, keys)
    return rollup.interval_flag(clocked, keys, "label", prefix), rollup.interval_weight(clocked, keys)


def temporal_grid(stays: DataFrame, tables: Mapping[str, DataFrame], options: DatasetOptions = DatasetOptions(), keys: Sequence[str] = KEYS) -> DataFrame:
    """Hour grid joined to every source.  ``tables``: transfers, medications, inputs, procedures, charts, outputs, labs."""
    stays = settled(stays)
    chart, vent = chart_hours(stays, tables["charts"], options.share, keys)
    amounts, weight_a = interval_hours(stays, tables["inputs"], options.share, keys)
    procs, weight_b = procedure_hours(stays, tables["procedures"], options.share, keys)
    sources = [
        transfer_hours(stays, tables["transfers"], keys),
        medication_hours(stays, tables["medications"], options.share, keys),
        amounts,
        procs,
        chart,
        vent,
        point_hours(stays, tables["outputs"], options.share, keys),
        point_hours(stays, tables["labs"], options.share, keys),
        rollup.merge_weights([weight_a, weight_b], keys),
    ]
    sources = [settled(s) for s in sources]
    base = grid.hour_grid(stays, keys, at_least=options.at_least_hours)
    return grid.assemble(base, sources, [*keys, "hours"])


def temporal_features(wide: DataFrame, stays: DataFrame, splits: DataFrame, options: DatasetOptions = DatasetOptions(), keys: Sequence[str] = KEYS) -> Dataset:
    """Types, limits, masks, imputation, folding, split, clip and pad of an assembled grid."""
    names = [c for c in wide.columns if c not in (*keys, "hours")]
    if any(c.startswith(PROC_PREFIX) for c in names):
        wide = flags.fill_flag_family(wide, PROC_PREFIX)
        names = [c for c in wide.columns if c not in (*keys, "hours")]
    wide = settled(wide)
    dtypes = flags.dtypes_of(wide)
    types = rollup.infer_types(wide, names, options.type_threshold)
    numeric = [c for c in names if types[c] == "Numerical"]
    category = [c for c in names if types[c] in ("Categorical", "Binary")]

    limited = filters.null_outside_limits(wide, {c: s for c, s in options.limits.items() if c in numeric})
    mask = flags.missing_mask(limited, names, [*keys, "hours"])
    # fills run over a patient's stays in time order; a stay is the chunk, so no task holds more than a stay's rows
    starts = stays.select(*keys, F.struct(F.col("intime"), F.col("stay_id")).alias("_stay"))
    ordered = limited.join(starts, list(keys))
    ordered = settled(ordered)
    filled = impute.impute_linear(ordered, [options.patient], ["_stay", "hours"], numeric, "mean", "_stay") if numeric else ordered
    filled = impute.impute_category(settled(filled), [options.patient], ["_stay", "hours"], category, "_stay") if category else filled
    filled = settled(filled.drop("_stay"))
    folds = [c for c in category if types[c] == "Categorical" and SCORE_LABEL not in c]
    filled = filled.withColumns({c: F.col(f"`{c}`").cast("string") for c in folds}) if folds else filled
    filled = rollup.fold_rare_many(filled, {c: f"{c}_Others" for c in folds}, options.share, fold_null=True)
    scores = [c for c in numeric if SCORE_LABEL in c]
    filled = filled.withColumns({c: F.col(f"`{c}`").cast("int") for c in scores}) if scores else filled

    types = {c: "Listwise" if c.startswith(PROC_PREFIX) else k for c, k in types.items()} | {"hours": "Numerical"}
    dimensions = rollup.output_dimensions(filled, types, (PROC_PREFIX,))
    data = joins.split_rows(filled, splits, keys)
    marks = joins.split_rows(mask, splits, keys)
    group = [*keys, "split"]
    data = grid.clip_pad(data, group, ["hours"], options.steps, options.pad)
    marks = grid.clip_pad(marks, group, ["hours"], options.steps, options.pad)
    data, marks, types = _without_constants(settled(data), marks, types, [*keys, "split", "step", "hours"])
    return Dataset(data, marks, types, {c: d for c, d in dtypes.items() if c in data.columns}, dimensions)


def total_features(static: Dataset, temporal: Dataset, keys: Sequence[str] = KEYS) -> tuple[Dataset, Dataset]:
    """Static rows reduced to the stays present in the temporal table."""
    present = temporal.data.select(*keys).distinct()
    cut = lambda df: joins.present_in(df, present, keys)
    return Dataset(cut(static.data), cut(static.mask), static.feature_type, static.dtypes, static.output_dimension), temporal
