"""Fidelity statistics of a real and a synthetic table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.stats import kolmogorov_p
from cohortspark.functions.text import correlation_band
from cohortspark.operators.filters import unpivot
from cohortspark.operators.impute import lagged_pairs
from cohortspark.operators.ordered import exact_quantiles, running_sum
from cohortspark.operators.rollup import aggregate_fn, infer_types

ACF_CHUNK = 4096
WIDE = 16  # more columns than this: moments are summed as matrices instead of one aggregate per pair


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def tagged_union(real: DataFrame, synthetic: DataFrame, labels: Sequence[str] = ("real", "synthetic"), name: str = "source") -> DataFrame:
    return real.withColumn(name, F.lit(labels[0])).unionByName(synthetic.withColumn(name, F.lit(labels[1])))


# ---- distribution -------------------------------------------------------------------------------


def ks_table(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], decimals: int | None = 3) -> DataFrame:
    """(feature, ks, p_value): two-sample statistic with nulls left out and the asymptotic p-value."""
    a = unpivot(real, columns).withColumns({"a": F.lit(1), "b": F.lit(0)})
    b = unpivot(synthetic, columns).withColumns({"a": F.lit(0), "b": F.lit(1)})
    counts = a.unionByName(b).groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = running_sum(counts, ["feature"], ["value"], ["a", "b"])
    gap = F.abs((F.col("a_before") + F.col("a")) / F.nullif(F.col("a_total"), F.lit(0)) - (F.col("b_before") + F.col("b")) / F.nullif(F.col("b_total"), F.lit(0)))
    out = sums.groupBy("feature").agg(F.max(gap).alias("ks"), F.max("a_total").alias("n"), F.max("b_total").alias("m"))
    size = F.col("n") * F.col("m") / (F.col("n") + F.col("m"))
    out = out.select("feature", "ks", kolmogorov_p(F.col("ks") * F.sqrt(size)).alias("p_value"))
    if decimals is None:
        return out
    return out.select("feature", F.round("ks", decimals).alias("ks"), F.round("p_value", decimals).alias("p_value"))


def data_statistics(
    real: DataFrame,
    synthetic: DataFrame,
    columns: Sequence[str],
    functions: Sequence[str] = ("mean", "std"),
    decimals: int | None = 3,
    labels: Sequence[str] = ("real", "synthetic"),
) -> DataFrame:
    """Per feature: each statistic of both tables side by side, missing rates, KS statistic and p-value."""
    long = tagged_union(unpivot(real, columns, keep_null=True), unpivot(synthetic, columns, keep_null=True), labels)
    shown = (lambda c: c) if decimals is None else (lambda c: F.round(c, decimals))
    aggs = [shown(aggregate_fn(f)(F.col("value"))).alias(f) for f in functions]
    aggs.append(F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"))
    wide = long.groupBy("feature").pivot("source", list(labels)).agg(*aggs)
    names = [*functions, "missing_rate"]
    out = wide.select("feature", *[F.col(f"{s}_{n}").alias(f"{n}_{s}") for n in names for s in labels])
    return out.join(ks_table(real, synthetic, columns, decimals), "feature", "left")


def dimension_probability(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, p_real, p_synthetic): column means over the rows without any null."""

    def means(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(_q(c)).alias(name)) for c in columns])
        return df.dropna(subset=list(columns)).agg(cells.alias("m")).select(F.explode("m").alias("m")).select("m.*")

    return means(real, "p_real").join(means(synthetic, "p_synthetic"), "feature")


def probability_summary(pairs: DataFrame) -> DataFrame:
    """Correlation, RMSE, mean absolute difference and shares inside 0.01 and 0.05 of a probability table."""
    x, y = F.col("p_real"), F.col("p_synthetic")
    gap = F.abs(y - x)
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return pairs.agg(
        F.try_divide(F.covar_pop(x, y), spread).alias("correlation"),
        F.sqrt(F.avg((x - y) * (x - y))).alias("rmse"),
        F.avg(gap).alias("mean_abs_diff"),
        F.avg((gap <= 0.01).cast("double")).alias("within_01"),
        F.avg((gap <= 0.05).cast("double")).alias("within_05"),
    )


# ---- correlation matrices -----------------------------------------------------------------------


def _known(name: str) -> Column:
    """The column as a double, null where it is NaN: the two ways to sum moments then agree on what is missing."""
    value = _q(name).cast("double")
    return F.when(~F.isnan(value), value)


def _moment_sums(df: DataFrame, columns: Sequence[str], diagonal: bool) -> tuple[DataFrame, list[float]]:
    """Pairwise-complete sums of many columns (i, j, n, sx, sy, sxx, syy, sxy): masked matrix products per
    partition, then sums per pair; also the range of both columns (low_x, high_x, low_y, high_y).

    Values are centred by the column means first, so the sums do not cancel; the means are returned.
    """
    means = df.agg(*[F.avg(_known(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([0.0 if m is None else m for m in means])
    d = len(columns)
    names = [f"x{i}" for i in range(d)]
    sums, lows, highs = ("n", "sx", "sy", "sxx", "syy", "sxy"), ("low_x", "low_y"), ("high_x", "high_y")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, d, d))
        low, high = np.full((d, d), np.inf), np.full((d, d), -np.inf)  # of column i where j is present
        seen = False
        for batch in batches:
            raw = batch[names].to_numpy(np.float64)
            ok = (~np.isnan(raw)).astype(np.float64)
            x = np.nan_to_num(raw - centre)
            total += np.stack([ok.T @ ok, x.T @ ok, ok.T @ x, (x * x).T @ ok, ok.T @ (x * x), x.T @ x])
            for k in range(d):
                both = (ok * ok[:, [k]]) > 0
                low[k] = np.minimum(low[k], np.where(both, raw[:, [k]], np.inf).min(axis=0, initial=np.inf))
                high[k] = np.maximum(high[k], np.where(both, raw[:, [k]], -np.inf).max(axis=0, initial=-np.inf))
            seen = True
        if seen:
            i, j = np.triu_indices(d, 0 if diagonal else 1)
            flat = total[:, i, j]
            ranges = {"low_x": low[i, j], "low_y": low[j, i], "high_x": high[i, j], "high_y": high[j, i]}
            yield pd.DataFrame({"i": i, "j": j, **{k: flat[n] for n, k in enumerate(sums)}, **ranges})

    schema = ", ".join(["i int", "j int", *[f"{k} double" for k in (*sums, *lows, *highs)]])
    parts = df.select(*[_known(c).alias(n) for c, n in zip(columns, names)]).mapInPandas(moments, schema)
    folds = [*[F.sum(k).alias(k) for k in sums], *[F.min(k).alias(k) for k in lows], *[F.max(k).alias(k) for k in highs]]
    return parts.groupBy("i", "j").agg(*folds), [float(c) for c in centre]


def _moment_pairs(df: DataFrame, columns: Sequence[str], diagonal: bool) -> DataFrame:
    s, _ = _moment_sums(df, columns, diagonal)
    labels = F.array(*[F.lit(c) for c in columns])
    n = F.nullif(F.col("n"), F.lit(0.0))
    var_x = F.greatest(F.col("sxx") - F.col("sx") * F.col("sx") / n, F.lit(0.0))
    var_y = F.greatest(F.col("syy") - F.col("sy") * F.col("sy") / n, F.lit(0.0))
    flat = (F.col("low_x") == F.col("high_x")) | (F.col("low_y") == F.col("high_y"))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    r = F.when(~flat, F.try_divide(cov, F.sqrt(var_x * var_y)))
    return s.select(
        F.element_at(labels, F.col("i") + 1).alias("a"),
        F.element_at(labels, F.col("j") + 1).alias("b"),
        F.col("n").cast("bigint").alias("n"),
        r.alias("r"),
    )


def _aggregate_pairs(df: DataFrame, columns: Sequence[str], diagonal: bool) -> DataFrame:
    picks = combinations_with_replacement(columns, 2) if diagonal else combinations(columns, 2)
    cells = []
    for a, b in picks:
        both = _known(a).isNotNull() & _known(b).isNotNull()
        x, y = F.when(both, _known(a)), F.when(both, _known(b))
        spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
        flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
        r = F.when(~flat, F.try_divide(F.covar_pop(x, y), spread))
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"), r.alias("r")))
    return df.agg(F.array(*cells).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def pearson_pairs(df: DataFrame, columns: Sequence[str], flat: str = "null", diagonal: bool = False) -> DataFrame:
    """(a, b, n, r) for each pair in column order, over the rows where both are present.

    Null and NaN are missing.  Fewer than two rows give null.  A constant column gives null, or 0 with ``flat='zero'``.
    """
    pairs = (_moment_pairs if len(columns) > WIDE else _aggregate_pairs)(df, columns, diagonal)
    r = F.when(F.col("n") >= 2, F.coalesce("r", F.lit(0.0)) if flat == "zero" else F.col("r"))
    return pairs.withColumn("r", r)


def cramers_v(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, r): bias-corrected Cramér's V of each pair of categorical columns.

    Cells of every pair are counted in one pass with map-side combine.  The statistic needs no empty cells:
    Σ(O−E)²/E over the full grid is Σ O²/E − n, and in a 2×2 grid all |O−E| are equal, which gives the
    continuity-corrected value from the margins.
    """
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _q(a).cast("string").alias("x"), _q(b).cast("string").alias("y"))
        for a, b in combinations(columns, 2)
    ]
    counts = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").dropna(subset=["x", "y"])
    counts = counts.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("o"))
    rows = counts.groupBy("a", "b", "x").agg(F.sum("o").alias("rx"))
    cols = counts.groupBy("a", "b", "y").agg(F.sum("o").alias("cy"))
    rm = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("r"), F.sum("rx").alias("n"), F.sum(F.lit(1.0) / F.col("rx")).alias("ir"))
    cm = cols.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.sum(F.lit(1.0) / F.col("cy")).alias("ic"))
    joined = counts.join(rows, ["a", "b", "x"]).join(cols, ["a", "b", "y"])
    stat = joined.groupBy("a", "b").agg(
        F.sum(F.col("o") * F.col("o") / (F.col("rx") * F.col("cy"))).alias("s"),
        F.max(F.struct(F.col("o"), F.col("rx"), F.col("cy"))).alias("one"),
    )
    m = stat.join(rm, ["a", "b"]).join(cm, ["a", "b"])
    n = F.col("n").cast("double")
    gap = F.abs(F.col("one.o") - F.col("one.rx") * F.col("one.cy") / n)
    yates = F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2.0)) * n * F.col("ir") * F.col("ic")
    chi2 = F.when((F.col("r") == 2) & (F.col("k") == 2), yates).otherwise(n * (F.col("s") - 1.0))
    rest = F.nullif(n - 1.0, F.lit(0.0))
    r1, k1 = F.col("r") - 1.0, F.col("k") - 1.0
    phi = F.when(n > 1, F.greatest(F.lit(0.0), chi2 / n - k1 * r1 / rest)).otherwise(0.0)
    rc = F.col("r") - F.coalesce(r1 * r1 / rest, F.lit(0.0))
    kc = F.col("k") - F.coalesce(k1 * k1 / rest, F.lit(0.0))
    low = F.least(rc - 1.0, kc - 1.0)
    v = F.when(low > 0, F.sqrt(phi / F.nullif(low, F.lit(0.0)))).otherwise(0.0)
    return m.select("a", "b", F.col("n").cast("bigint").alias("n"), v.alias("r"))


def matrix_compare(real: DataFrame, synthetic: DataFrame, tau: float = 0.05) -> DataFrame:
    """Off-diagonal comparison of two pair tables, nulls as 0: mean absolute difference, share within tau,
    sign agreement in percent."""
    pairs = real.select("a", "b", F.coalesce("r", F.lit(0.0)).alias("x")).join(
        synthetic.select("a", "b", F.coalesce("r", F.lit(0.0)).alias("y")), ["a", "b"]
    )
    gap = F.abs(F.col("x") - F.col("y"))
    return pairs.agg(
        F.avg(gap).alias("mad"),
        F.avg((gap <= tau).cast("double")).alias("coverage"),
        (F.avg((F.signum("x") == F.signum("y")).cast("double")) * 100).alias("sign_agreement"),
    )


def band_agreement(real: DataFrame, synthetic: DataFrame, n_columns: int) -> DataFrame:
    """Share of equal bands and mean absolute difference over the full matrix, diagonal included."""
    pairs = real.select("a", "b", F.col("r").alias("x")).join(synthetic.select("a", "b", F.col("r").alias("y")), ["a", "b"])
    same = F.sum(F.coalesce((correlation_band("x") == correlation_band("y")).cast("int"), F.lit(0)))
    total = float(n_columns * n_columns)
    return pairs.agg(
        ((same * 2 + n_columns) / total).alias("band_agreement"),
        (F.sum(F.abs(F.col("x") - F.col("y"))) * 2 / total).alias("mean_abs_diff"),
    )


def temporal_windows(df: DataFrame, stay: str, hour: str, columns: Sequence[str], interval: int) -> DataFrame:
    """(stay, feature, window, value): mean of a feature in each time window of a stay."""
    w = F.floor(F.col(hour) / interval).cast("int")
    means = df.groupBy(stay, w.alias("window")).agg(*[F.avg(_q(c)).alias(c) for c in columns])
    return unpivot(means, columns, [stay, "window"])


def temporal_correlation(df: DataFrame, stay: str, hour: str, columns: Sequence[str], interval: int, steps: int) -> DataFrame:
    """(a, b, n, r) over feature × window columns named '<feature>_<first>-<last>', diagonal included."""
    if steps % interval:
        raise ValueError("steps must be a multiple of interval")
    names = [f"{c}_{k * interval}-{(k + 1) * interval - 1}" for c in columns for k in range(steps // interval)]
    long = temporal_windows(df.filter(F.col(hour) < steps), stay, hour, columns, interval)
    start = F.col("window") * interval
    label = F.concat(F.col("feature"), F.lit("_"), start.cast("string"), F.lit("-"), (start + interval - 1).cast("string"))
    wide = long.withColumn("label", label).groupBy(stay).pivot("label", names).agg(F.max("value"))
    return pearson_pairs(wide, names, flat="zero", diagonal=True)


def temporal_compare(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Sign accuracy and mean absolute difference over the full matrix of two temporal pair tables."""
    pairs = real.select("a", "b", F.col("r").alias("x")).join(synthetic.select("a", "b", F.col("r").alias("y")), ["a", "b"])
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    same = F.coalesce((F.signum("x") == F.signum("y")).cast("double"), F.lit(0.0))
    gap = F.abs(F.col("x") - F.col("y"))
    return pairs.agg(
        (F.sum(same * twice) / F.sum(twice)).alias("sign_accuracy"),
        (F.sum(gap * twice) / F.sum(F.when(gap.isNotNull(), twice))).alias("mean_abs_diff"),
    )


def window_errors(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(window, mad, mad_std, sign_accuracy) over the off-diagonal pairs inside the same window."""
    pairs = real.select("a", "b", F.col("r").alias("x")).join(synthetic.select("a", "b", F.col("r").alias("y")), ["a", "b"])
    tail = lambda c: F.regexp_extract(c, r"_(\d+-\d+)$", 1)
    inside = pairs.filter((tail("a") == tail("b")) & (F.col("a") != F.col("b")))
    gap = F.abs(F.col("x") - F.col("y"))
    same = F.coalesce((F.signum("x") == F.signum("y")).cast("double"), F.lit(0.0))
    return inside.groupBy(tail("a").alias("window")).agg(
        F.avg(gap).alias("mad"), F.stddev_pop(gap).alias("mad_std"), F.avg(same).alias("sign_accuracy")
    )


def window_summary(errors: DataFrame) -> DataFrame:
    return errors.agg(
        F.avg("mad").alias("mad_mean"),
        F.stddev_pop("mad").alias("mad_std"),
        F.avg("sign_accuracy").alias("sign_mean"),
        F.stddev_pop("sign_accuracy").alias("sign_std"),
    )


def lagged_correlation(real: DataFrame, synthetic: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], lag: int = 1) -> DataFrame:
    """(feature, r_real, r_synthetic): correlation of each value with the one ``lag`` rows earlier."""

    def one(df: DataFrame, name: str) -> DataFrame:
        lagged = lagged_pairs(df.select(*by, order, *[_q(c) for c in columns]), by, order, columns, lag)
        cells = []
        for c in columns:
            both = _q(c).isNotNull() & _q(f"{c}_lag").isNotNull()
            x, y = F.when(both, _q(c).cast("double")), F.when(both, _q(f"{c}_lag").cast("double"))
            r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
            cells.append(F.struct(F.lit(c).alias("feature"), r.alias(name)))
        return lagged.agg(F.array(*cells).alias("p")).select(F.explode("p").alias("p")).select("p.*")

    return one(real, "r_real").join(one(synthetic, "r_synthetic"), "feature")


# ---- autocorrelation ----------------------------------------------------------------------------


def flat_positions(df: DataFrame, stay: str, hour: str, steps: int, name: str = "pos") -> DataFrame:
    """Position of a row in the concatenation of all stays: dense stay index · steps + hour."""
    ids = df.select(stay).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    index = running_sum(ids, [], [stay], ["_one"]).select(stay, F.col("_one_before").alias("_i"))
    return df.join(index, stay).withColumn(name, F.col("_i") * steps + F.col(hour)).drop("_i")


def acf(df: DataFrame, position: str, columns: Sequence[str], lags: Sequence[int], within: Sequence[str] = ()) -> DataFrame:
    """(feature, lag, acf) with global mean and variance and denominator n.

    The series is cut into chunks of positions; the last max(lag) rows of a chunk are also sent to the next
    one as context, so a lag is a range frame inside the chunk and no long sort is needed.  ``within`` keeps
    lags inside a group instead of running across stays.
    """
    long = unpivot(df, columns, [*within, position])
    means = long.groupBy("feature").agg(F.avg("value").alias("_m"))
    x = long.join(F.broadcast(means), "feature").withColumn("x", F.col("value") - F.col("_m"))  # one row per column
    deepest = max(max(lags), 1)
    size = max(ACF_CHUNK, 2 * deepest)
    chunk = F.floor(F.col(position) / size)
    late = F.pmod(F.col(position), F.lit(size)) >= size - deepest
    homes = F.when(late, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = x.withColumn("_home", chunk).withColumn("_chunk", F.explode(homes))
    w = Window.partitionBy("feature", *within, "_chunk").orderBy(position)
    earlier = [F.first("x").over(w.rangeBetween(-k, -k)).alias(f"_l{k}") if k else F.col("x").alias("_l0") for k in lags]
    own = spread.select("feature", "_home", "_chunk", "x", *earlier).filter(F.col("_home") == F.col("_chunk"))
    sums = own.groupBy("feature").agg(F.sum(F.col("x") * F.col("x")).alias("_v"), *[F.sum(F.col("x") * F.col(f"_l{k}")).alias(f"_s{k}") for k in lags])
    cells = [
        F.struct(F.lit(k).alias("lag"), F.try_divide(F.coalesce(F.col(f"_s{k}"), F.lit(0.0)), F.col("_v")).alias("acf")) for k in lags
    ]
    return sums.select("feature", F.explode(F.array(*cells)).alias("c")).select("feature", "c.lag", "c.acf")


def acf_table(
    real: DataFrame, synthetic: DataFrame, position: str, columns: Sequence[str], lags: Sequence[int] = (1, 12, 24, 29), within: Sequence[str] = ()
) -> DataFrame:
    a = acf(real, position, columns, lags, within).withColumnRenamed("acf", "acf_real")
    b = acf(synthetic, position, columns, lags, within).withColumnRenamed("acf", "acf_synthetic")
    return a.join(b, ["feature", "lag"]).withColumn("abs_diff", F.abs(F.col("acf_real") - F.col("acf_synthetic")))


def acf_pivot(table: DataFrame, value: str = "abs_diff", lags: Sequence[int] = (1, 12, 24, 29)) -> DataFrame:
    return table.groupBy("feature").pivot("lag", list(lags)).agg(F.max(value))


def acf_rmse(real: DataFrame, synthetic: DataFrame, position: str, columns: Sequence[str], lags: int = 30) -> DataFrame:
    """(feature, rmse) of the two curves for lags 0..n."""
    table = acf_table(real, synthetic, position, columns, list(range(lags + 1)))
    return table.groupBy("feature").agg(F.sqrt(F.avg(F.col("abs_diff") * F.col("abs_diff"))).alias("rmse"))


# ---- tables behind the plots --------------------------------------------------------------------


def trajectory(df: DataFrame, hour: str, columns: Sequence[str], by: Sequence[str] = ("source",)) -> DataFrame:
    long = unpivot(df, columns, [*by, hour])
    return long.groupBy(*by, "feature", hour).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def count_share(df: DataFrame, column: str, by: Sequence[str] = ("source",)) -> DataFrame:
    counts = df.filter(_q(column).isNotNull()).groupBy(*by, _q(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    return counts.join(totals, list(by)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, bin, n, density) on bins shared by all groups of a feature."""
    long = unpivot(df, columns, by)
    ends = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    x = long.join(F.broadcast(ends), "feature")  # one row per column
    width = F.nullif((F.col("_hi") - F.col("_lo")) / bins, F.lit(0.0))
    place = F.coalesce(F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = x.groupBy(*by, "feature", place.alias("bin"), width.alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by, "feature").agg(F.sum("n").alias("_t"))
    out = counts.join(totals, [*by, "feature"])
    return out.withColumn("density", F.col("n") / (F.col("_t") * F.col("_w"))).drop("_t", "_w")


def ecdf(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, value, cumulative share)."""
    group = [*by, "feature"]
    counts = unpivot(df, columns, by).groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    sums = running_sum(counts, group, ["value"], ["n"])
    return sums.select(*group, "value", ((F.col("n_before") + F.col("n")) / F.col("n_total")).alias("ecdf"))


def box_statistics(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Count, extremes and exact quartiles per group and feature."""
    long = unpivot(df, columns, by)
    group = [*by, "feature"]
    q = exact_quantiles(long, group, "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    ends = long.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))
    return ends.join(q, group)


def outcome_rate(df: DataFrame, category: str, outcome: str, by: Sequence[str] = ("source",)) -> DataFrame:
    return df.groupBy(*by, _q(category).alias("level")).agg(F.avg(_q(outcome)).alias("rate"), F.count(F.lit(1)).alias("n"))


def compare_distributions(real: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None, bins: int = 50) -> dict[str, DataFrame]:
    """Per-type comparison: count shares of categories, histogram and ECDF of numbers, probabilities of flags."""
    types = infer_types(real, columns, threshold=5, nulls_count=True)
    both = tagged_union(real, synthetic)
    numeric = [c for c, k in types.items() if k == "Numerical"]
    flags = [c for c, k in types.items() if k == "Binary"]
    out: dict[str, DataFrame] = {}
    for c in (c for c, k in types.items() if k == "Categorical"):
        out[f"share:{c}"] = count_share(both, c)
    if numeric:
        out["histogram"] = histogram(both, numeric, bins, ["source"])
        out["ecdf"] = ecdf(both, numeric, ["source"])
    if flags:
        out["probability"] = dimension_probability(real, synthetic, flags)
    return out


def moment_distance(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean squared difference of the means plus that of the sample covariances (full matrix)."""
    d = len(columns)

    def wide(df: DataFrame, name: str) -> DataFrame:
        sums, centre = _moment_sums(df, columns, True)
        names, means = F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(m) for m in centre])
        cov = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)
        a, b = F.element_at(names, F.col("i") + 1), F.element_at(names, F.col("j") + 1)
        covs = sums.select(a.alias("a"), b.alias("b"), F.lit("cov").alias("k"), cov.alias(name))
        mean = F.element_at(means, F.col("i") + 1) + F.col("sx") / F.col("n")
        own = sums.filter(F.col("i") == F.col("j")).select(a.alias("a"), b.alias("b"), F.lit("mean").alias("k"), mean.alias(name))
        return covs.unionByName(own)

    def narrow(df: DataFrame, name: str) -> DataFrame:
        cell = lambda a, b, k, v: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("k"), v.alias(name))
        x = _known
        cells = [cell(c, c, "mean", F.avg(x(c))) for c in columns]
        cells += [cell(a, b, "cov", F.covar_samp(x(a), x(b))) for a, b in combinations_with_replacement(columns, 2)]
        return df.agg(F.array(*cells).alias("p")).select(F.explode("p").alias("p")).select("p.*")

    moments = wide if d > WIDE else narrow
    pairs = moments(real, "x").join(moments(synthetic, "y"), ["a", "b", "k"])
    square = (F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))
    weight = F.when(F.col("k") == "mean", F.lit(1.0 / d)).when(F.col("a") == F.col("b"), 1.0 / (d * d)).otherwise(2.0 / (d * d))
    return pairs.agg(F.sum(square * weight).alias("moment_distance"))


def confusion_counts(df: DataFrame, true: str, predicted: str, levels: Sequence) -> DataFrame:
    """(actual, predicted, n) on the full grid of the stated levels."""
    counts = df.groupBy(_q(true).alias("actual"), _q(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(a, b) for a in levels for b in levels], df.select(_q(true).alias("actual"), _q(predicted).alias("predicted")).schema)
    return grid.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def distance_difference(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("a", "b"), value: str = "distance", decimals: int = 3) -> DataFrame:
    """Difference of two group-distance tables, each rounded first."""
    x = first.select(*keys, F.round(value, decimals).alias("first"))
    y = second.select(*keys, F.round(value, decimals).alias("second"))
    return x.join(y, list(keys)).withColumn("difference", F.round(F.col("first") - F.col("second"), decimals))


# ---- top-k --------------------------------------------------------------------------------------


def top_pairs(pairs: DataFrame, k: int = 20, highest: bool = True) -> DataFrame:
    """The k strongest (or weakest) pairs by absolute value, names as tie-break, nulls as 0."""
    strength = F.abs(F.coalesce("r", F.lit(0.0)))
    ranked = pairs.withColumn("strength", strength)
    return ranked.orderBy(F.desc("strength") if highest else F.asc("strength"), "a", "b").limit(k)


def pair_variables(pairs: DataFrame, k: int = 20, highest: bool = True) -> DataFrame:
    """(feature): variables appearing in the k strongest (or weakest) pairs."""
    return top_pairs(pairs, k, highest).select(F.explode(F.array("a", "b")).alias("feature")).distinct()


def acf_extremes(table: DataFrame, k: int = 20, smallest: bool = True) -> DataFrame:
    """(feature, mean_error): the k features with the smallest or largest mean ACF error."""
    mean = table.groupBy("feature").agg(F.avg("abs_diff").alias("mean_error"))
    return mean.orderBy(F.asc("mean_error") if smallest else F.desc("mean_error"), "feature").limit(k)


def ordered_results(df: DataFrame, orders: Mapping[str, Sequence[str]]) -> DataFrame:
    """Sort by fixed category orders, column after column; unknown levels last."""
    keys = []
    for column, levels in orders.items():
        rank = F.when(F.lit(False), F.lit(0))
        for i, v in enumerate(levels):
            rank = rank.when(_q(column) == v, i)
        keys.append(rank.otherwise(len(levels)))
    return df.orderBy(*keys)
