"""Fidelity, privacy and utility reports of a real and a synthetic table pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.flags import outcome_group
from cohortspark.operators import encode, fidelity, filters, neighbours, privacy, rollup, sampling, utility
from cohortspark.operators.ordered import running_sum

# Age, vitals, coma scores and labs of the outcome task.
TASK_FEATURES = (
    "age",
    "RR",
    "HR",
    "SBP",
    "DBP",
    "BT",
    "SpO2",
    "Glasgow coma scale(eye)",
    "Glasgow coma scale(verbal)",
    "Glasgow coma scale(motor)",
    "ALT",
    "AST",
    "Albumin",
    "BUN",
    "Bilirubin, total",
    "Chloride, serum",
    "Creatinine",
    "Glucose",
    "Hb",
    "PT (INR)",
    "PLT",
    "Potassium, serum",
    "Sodium, serum",
    "WBC",
    "aPTT",
)


def fidelity_report(
    real: DataFrame,
    synthetic: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    flags: Sequence[str] = (),
    stay: str | None = None,
    step: str = "step",
    steps: int = 30,
    interval: int = 6,
    lags: Sequence[int] = (1, 12, 24, 29),
) -> dict[str, DataFrame]:
    """Named report tables.  With a ``stay`` column the tables have one row per stay and step, steps dense."""
    out = {"statistics": fidelity.data_statistics(real, synthetic, numeric)}
    if flags:
        pairs = fidelity.dimension_probability(real, synthetic, flags)
        out["probability"], out["probability_summary"] = pairs, fidelity.probability_summary(pairs)
    a, b = fidelity.pearson_pairs(real, numeric), fidelity.pearson_pairs(synthetic, numeric)
    out["pearson"] = fidelity.matrix_compare(a, b)
    out["top_pairs"] = fidelity.top_pairs(a)
    if len(categorical) > 1:
        out["cramers_v"] = fidelity.matrix_compare(fidelity.cramers_v(real, categorical), fidelity.cramers_v(synthetic, categorical))
    if stay:
        x, y = (fidelity.temporal_correlation(df, stay, step, numeric, interval, steps) for df in (real, synthetic))
        out["temporal"] = fidelity.temporal_compare(x, y)
        out["windows"] = fidelity.window_errors(x, y)
        out["window_summary"] = fidelity.window_summary(out["windows"])
        fa, fb = (fidelity.flat_positions(df, stay, step, steps) for df in (real, synthetic))
        out["acf"] = fidelity.acf_table(fa, fb, "pos", numeric, lags)
        out["acf_best"] = fidelity.acf_extremes(out["acf"], smallest=True)
        out["acf_worst"] = fidelity.acf_extremes(out["acf"], smallest=False)
        out["trajectory"] = fidelity.trajectory(fidelity.tagged_union(real, synthetic), step, numeric)
    return out


def subgroup_report(real: DataFrame, synthetic: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), icu: str = "icu_expire_flag", hospital: str = "hospital_expire_flag") -> dict[str, DataFrame]:
    """Box statistics and shares per outcome group and source."""
    both = fidelity.tagged_union(real, synthetic).withColumn("outcome", outcome_group(icu, hospital))
    out = {"box": fidelity.box_statistics(both, numeric, ["source", "outcome"])}
    for c in categorical:
        out[f"share:{c}"] = fidelity.count_share(both, c, ["source", "outcome"])
    return out


def model_free_privacy(
    real: DataFrame,
    synthetic: DataFrame,
    row_id: str,
    columns: Sequence[str],
    quasi: Sequence[str] = (),
    sensitive: Sequence[str] = (),
    rounds: int = 100,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """Risks of a synthetic table cut to the size of the real one, with their null thresholds.

    One row per stay on both sides; missing values count as -1.
    """
    cut = sampling.downsample_to(synthetic, row_id, real, seed)
    number = lambda df: _numbered(df, row_id, columns, quasi, sensitive)
    a, b = number(real), number(cut)
    out = {
        "single_out": privacy.single_out_risk(a, b, list(columns)),
        "inference": privacy.inferential_risk(a, b, "pos"),
        "thresholds": privacy.risk_thresholds(real, row_id, columns, rounds, seed=seed),
    }
    if quasi and sensitive:
        out["attribution"] = privacy.attribution_probability(a, b, "pos")
        out["attribution_thresholds"] = privacy.attribution_thresholds(real, row_id, quasi, sensitive, rounds, seed=seed)
    return out


def _numbered(df: DataFrame, row_id: str, columns: Sequence[str], quasi: Sequence[str], sensitive: Sequence[str]) -> DataFrame:
    """Row numbers shared by both tables, and the row vectors."""
    ids = df.select(row_id).withColumn("_one", F.lit(1).cast("bigint"))
    index = running_sum(ids, [], [row_id], ["_one"]).select(row_id, F.col("_one_before").alias("pos"))
    out = df.join(index, row_id)
    vectors = {"vector": neighbours.vector_of(columns)}
    if quasi and sensitive:
        vectors |= {"quasi": neighbours.vector_of(quasi), "sensitive": neighbours.vector_of(sensitive)}
    return out.withColumns(vectors)


def attack_report(
    real: DataFrame, synthetic: DataFrame, row_id: str, columns: Sequence[str], target: str | None = None, seed: int = 0
) -> dict[str, DataFrame]:
    """Membership, re-identification and attribute inference attacks."""
    parts = sampling.holdout_split(real, row_id, 0.5, seed)
    train, holdout = parts.filter("part = 'train'").drop("part"), parts.filter("part = 'holdout'").drop("part")
    vec = lambda df: df.select(row_id, neighbours.vector_of(columns).alias("vector"))
    half = len(columns) // 2
    out = {
        "membership": privacy.membership_attack(vec(train), vec(holdout), vec(synthetic), row_id),
        "reidentification": privacy.reidentification_attack(train, holdout, synthetic, row_id, columns[:half], columns[half:]),
    }
    if target:
        inputs = [c for c in columns if c != target]
        scored = []
        for name, df in (("real", real), ("synthetic", synthetic)):
            halves = sampling.holdout_split(df.select(row_id, target, neighbours.vector_of(inputs).alias("vector")), row_id, 0.8, seed)
            auc = privacy.attribute_attack(halves.filter("part = 'train'"), halves.filter("part = 'holdout'"), row_id, target)
            scored.append(auc.select(F.lit(name).alias("source"), "auc"))
        out["attribute"] = scored[0].unionByName(scored[1])
    return out


def task_table(
    temporal: DataFrame,
    static: DataFrame,
    stay: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str,
    include: Sequence[str] | None = None,
    hours: int = utility.TASK_HOURS,
    step: str = "step",
) -> DataFrame:
    """One row per stay over its first hours, with the target; optionally a feature subset."""
    joined = temporal.join(static, stay)
    table = rollup.stay_summary(joined, stay, numeric, categorical, [target], hours, step)
    return filters.select_features(table, include=[stay, *include, target]) if include else table


def utility_report(
    real: DataFrame,
    synthetic: DataFrame,
    row_id: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str,
    rates: Sequence[float] = (0.0, 0.1, 0.25, 0.5),
    rounds: int = 100,
    models=utility.default_models,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Bootstrap scores, tests against the zero rate, and the starred result table."""
    encoder = encode.EvaluationEncoder.fit(real, numeric, categorical)
    a, b = encoder.apply(real, [row_id, target]), encoder.apply(synthetic, [row_id, target])
    scores = utility.bootstrap_scores(a, b, target, row_id, models, rates, rounds, seed=seed)
    tests = utility.bootstrap_tests(scores)
    table = utility.bootstrap_table(scores, target)
    settings = [c for c in table.columns if c not in ("target", "model", "metric")]
    final = utility.result_table(table, tests, settings)
    orders = {"model": utility.MODEL_ORDER, "metric": utility.METRIC_ORDER}
    return {"scores": scores, "tests": tests, "table": fidelity.ordered_results(final, orders)}
