"""Repeatable sampling and splitting.

Every draw is a rank by a seeded integer hash (ties by id) computed with range-split running counts, so exact
class sizes hold without sorting a class in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.flags import levels_of, pick_level
from cohortspark.operators.encode import named_rows, stochastic_fit, stochastic_inverse, uniform
from cohortspark.operators.ordered import hash_number, portable_hash, ranked
from cohortspark.session import settled

DRAWS_PER_TASK = 1 << 16


def patient_labels(df: DataFrame, patient: str, label: str, order: Sequence[str]) -> DataFrame:
    """(patient, label): the label of the patient's first row in the stated order."""
    rank = F.struct(*[F.col(c) for c in order])
    return df.groupBy(patient).agg(F.min_by(label, rank).alias(label)).filter(F.col(label).isNotNull())


def patient_split(
    df: DataFrame,
    patient: str,
    label: str,
    order: Sequence[str],
    train: float = 0.8,
    test: float = 0.2,
    val: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """Adds ``split``.  Per label, floor(train·n) patients of which the last fifth (or val·n) validate, then
    floor(test·n) test patients; patients left over by rounding have no split."""
    people = ranked(patient_labels(df, patient, label, order), [label], patient, seed)
    n = F.col("rank_of")
    n_train = F.floor(F.lit(float(train)) * n)
    n_val = F.floor(F.lit(0.2) * n_train) if val is None else F.floor(F.lit(float(val)) * n)
    n_test = F.floor(F.lit(float(test)) * n)
    split = (
        F.when(F.col("rank") <= n_train - n_val, "train")
        .when(F.col("rank") <= n_train, "val")
        .when(F.col("rank") <= n_train + n_test, "test")
    )
    return df.join(people.select(patient, split.alias("split")), patient, "left")


def patient_sample(df: DataFrame, patient: str, label: str, order: Sequence[str], ratio: float = 0.7, seed: int = 0) -> DataFrame:
    """Rows of floor(ratio·n) patients per label."""
    people = ranked(patient_labels(df, patient, label, order), [label], patient, seed)
    chosen = people.filter(F.col("rank") <= F.floor(F.lit(float(ratio)) * F.col("rank_of"))).select(patient)
    return df.join(chosen, patient, "left_semi")


def holdout_split(df: DataFrame, row_id: str, ratio: float = 0.5, seed: int = 0) -> DataFrame:
    """Adds ``part``: 'train' for n - ceil((1 - ratio)·n) rows, 'holdout' for the rest."""
    out = ranked(df, [], row_id, seed)
    n_train = F.col("rank_of") - F.ceil(F.lit(1.0 - ratio) * F.col("rank_of"))
    part = F.when(F.col("rank") <= n_train, "train").otherwise("holdout")
    return out.withColumn("part", part).drop("rank", "rank_of")


def stratified_rows(df: DataFrame, row_id: str, label: str, train: float = 0.8, seed: int = 0) -> DataFrame:
    """Adds ``part``: floor(train·n) rows per label train, the rest test."""
    out = ranked(df, [label], row_id, seed)
    part = F.when(F.col("rank") <= F.floor(F.lit(float(train)) * F.col("rank_of")), "train").otherwise("test")
    return out.withColumn("part", part).drop("rank", "rank_of")


def stratified_folds(df: DataFrame, row_id: str, label: str, folds: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    out = ranked(df, [label], row_id, seed)
    return out.withColumn(name, F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int")).drop("rank", "rank_of")


def class_quotas(real: DataFrame, target: str, rate: float = 1.0, even: bool = False) -> DataFrame:
    """(target, quota): rounded share of floor(rate·n) per class of the real table."""
    counts = real.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy().agg(F.sum("_n")).scalar()
    share = F.lit(0.5) if even else F.col("_n") / total
    return counts.select(target, F.bround(share * F.floor(F.lit(float(rate)) * total), 0).cast("bigint").alias("quota"))


def match_class_shares(real: DataFrame, synthetic: DataFrame, target: str, row_id: str, seed: int = 0) -> DataFrame:
    """Synthetic rows drawn without replacement so that class counts equal the real ones; too few rows raise."""
    quotas = class_quotas(real, target)
    rows = ranked(synthetic, [target], row_id, seed).join(quotas, target)
    enough = F.when(F.col("rank_of") < F.col("quota"), F.raise_error(F.lit("not enough synthetic rows of a class")).cast("boolean"))
    return rows.filter(enough.otherwise(F.col("rank") <= F.col("quota"))).drop("rank", "rank_of", "quota")


def numbered(counts: DataFrame, n: Column, name: str = "draw") -> DataFrame:
    """Rows 1..n per input row, made in chunks so that no task makes them all."""
    chunks = counts.withColumn("_n", n).withColumn(
        "_c", F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / DRAWS_PER_TASK))).otherwise(F.array().cast("array<bigint>")))
    )
    first = F.col("_c") * DRAWS_PER_TASK + 1
    last = F.least(F.col("_n"), (F.col("_c") + 1) * DRAWS_PER_TASK)
    return chunks.repartition("_c").withColumn(name, F.explode(F.sequence(first, last))).drop("_c", "_n")


def draw_index(draw: Column, size: Column, seed: int, group: Column | None = None) -> Column:
    """Repeatable 1-based index in 1..size for a draw number or key; ``group`` gives every group draws of its own."""
    start = F.lit(f"draw {seed}") if group is None else F.concat_ws(" ", F.lit(f"draw {seed}"), group.cast("string"))
    return F.pmod(hash_number(portable_hash(draw, start)), size) + 1


def incremental_samples(
    real: DataFrame,
    synthetic: DataFrame,
    target: str,
    row_id: str,
    rates: Sequence[float],
    even: bool = False,
    seed: int = 42,
) -> DataFrame:
    """(rate, draw, columns of the synthetic table): nested samples with replacement.

    There is one ordered sequence of draws per class; the sample at a rate is its prefix, so every sample
    contains the previous one.
    """
    wanted = [class_quotas(real, target, r, even).withColumn("rate", F.lit(float(r))) for r in sorted(rates)]
    quotas = wanted[0]
    for more in wanted[1:]:
        quotas = quotas.unionByName(more)
    most = quotas.groupBy(target).agg(F.max("quota").alias("_most"))
    pool = ranked(synthetic, [target], row_id, seed)
    sizes = synthetic.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("_size"))
    draws = numbered(most.join(sizes, target), F.col("_most")).withColumn("rank", draw_index(F.col("draw"), F.col("_size"), seed, F.col(target)))
    picked = draws.drop("_most", "_size").join(pool.drop("rank_of"), [target, "rank"]).drop("rank")
    return picked.join(quotas, target).filter(F.col("draw") <= F.col("quota")).drop("quota")


def downsample_to(df: DataFrame, row_id: str, other: DataFrame, seed: int = 0) -> DataFrame:
    """As many rows as ``other`` has."""
    n = other.agg(F.count(F.lit(1))).scalar()
    return ranked(df, [], row_id, seed).filter(F.col("rank") <= n).drop("rank", "rank_of")


def repeat_rows(df: DataFrame, times: int, name: str = "copy") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(times))))


def bootstrap_padding(
    synthetic: DataFrame, patterns: DataFrame, stay: str, step: str, columns: Sequence[str], pattern_id: str = "pattern", seed: int = 0
) -> DataFrame:
    """Give every synthetic stay the padding pattern of a drawn real stay: values of padded rows become null.

    ``patterns`` is (pattern_id, length): how many rows of the real stay are not padding.
    """
    pool = ranked(patterns.select(pattern_id, "length"), [], pattern_id, seed).select("rank", "length")
    size = patterns.agg(F.count(F.lit(1))).scalar()
    picks = synthetic.select(stay).distinct().withColumn("rank", draw_index(F.col(stay), size, seed))
    lengths = picks.join(pool, "rank").select(stay, "length")
    joined = synthetic.join(lengths, stay)
    return joined.withColumns({c: F.when(F.col(step) < F.col("length"), F.col(f"`{c}`")) for c in columns}).drop("length")


def generate_rows(
    real: DataFrame,
    conditions: DataFrame,
    by: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    times: int = 1,
    seed: int = 0,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Synthetic rows drawn feature by feature inside each condition.

    Keeps the per-condition distribution and missing rate of every feature, not the dependence between
    features.  ``conditions`` holds one row per wanted row (or per ``times`` rows) with the ``by`` columns.  Draws
    follow the seed, the feature and the row's ``keys`` (the row's place if not given).
    """
    levels = {c: levels_of(real, c) for c in categorical}
    coded = real.withColumns(
        {c: F.array_position(F.array(*[F.lit(v) for v in levels[c]]), F.col(c)).cast("double") for c in categorical}
    ).withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in categorical})
    columns = [*numeric, *categorical]
    params = settled(stochastic_fit(coded, columns, by=by))
    rates = coded.groupBy(*by).agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"_m_{c}") for c in columns])
    wanted = repeat_rows(conditions, times) if times > 1 else conditions
    own = [*keys, "copy"] if keys and times > 1 else keys
    draws = named_rows(wanted, own).join(rates, list(by))
    name = lambda what, c: F.concat_ws(":", F.lit(what), F.lit(c), "_name")
    draws = draws.withColumns(
        {c: F.when(uniform(name("missing", c), seed) >= F.col(f"_m_{c}"), uniform(name("value", c), seed)) for c in columns}
    ).drop("_row", "_name", *[f"_m_{c}" for c in columns])
    out = stochastic_inverse(draws, params, columns, by=by)
    return out.withColumns(
        {c: pick_level(levels[c], F.col(c)) for c in categorical}
    )


def score_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a user's model to Arrow batches of the table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


