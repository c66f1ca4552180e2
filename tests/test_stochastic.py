"""Stochastic encoding at the borders of ranges, with hot values, and against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import encode, sampling


def plain_inverse(u, hi, value):
    at = np.searchsorted(hi, u)
    return [None if np.isnan(x) or k == len(hi) else value[k] for x, k in zip(u, at)]


@pytest.mark.parametrize("parts", ["1", "13"])
def test_intervals_are_carried_over_borders(spark, parts):
    """Many draws between two intervals and many intervals between two draws; ends, NaN, null and repeated rows."""
    old, aqe = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(1)
        fine = np.sort(rng.random(700)) * 0.5
        ends = {"a": np.append(fine, [0.9]), "b": np.array([0.25, 1.0]), "c": np.array([0.5])}
        params = [(f, float(10 * k), 0.0, float(h)) for f, hi in ends.items() for k, h in enumerate(hi)]
        u = np.concatenate([rng.random(900), fine[:50], np.full(300, 0.7), [0.0, -1.0, 1.0, 2.0, np.nan]])
        rows = [(i, *[None if (i + k) % 17 == 0 else float(x) for k in range(3)], "x") for i, x in enumerate(u)] * 2
        df = spark.createDataFrame(rows, "i int, a double, b double, c double, other string")
        out = encode.stochastic_inverse(df, spark.createDataFrame(params, "feature string, value double, lo double, hi double"), ["a", "b", "c"])
        assert out.columns == df.columns
        want = {f: plain_inverse(u, hi, [10.0 * k for k in range(len(hi))]) for f, hi in ends.items()}
        full = [(i, *[None if (i + k) % 17 == 0 else want[f][i] for k, f in enumerate("abc")], "x") for i in range(len(u))] * 2
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(full, key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)


def test_a_million_distinct_values(spark):
    n = 1_000_000
    params = spark.range(n).select(F.lit("x").alias("feature"), F.col("id").cast("double").alias("value"), ((F.col("id") + 1) / n).alias("hi"))
    draws = spark.range(200_000).select("id", ((F.col("id") * 7919 % n + 0.5) / n).alias("x"))
    got = encode.stochastic_inverse(draws, params, ["x"]).filter(F.col("x") != F.col("id") * 7919 % n)
    assert got.isEmpty()


def joins_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Join ")


def test_as_many_joins_for_many_columns(spark):
    df = spark.range(2000).select("id", *[(F.col("id") % (k + 2)).cast("double").alias(f"c{k}") for k in range(8)])
    names = [f"c{k}" for k in range(8)]
    params = encode.stochastic_fit(df, names)
    for step in (
        lambda c: encode.stochastic_transform(df, params, c, 1, keys=["id"]),
        lambda c: encode.stochastic_inverse(df, params, c),
        lambda c: sampling.generate_rows(df.withColumn("g", F.col("id") % 2), df.select("id", (F.col("id") % 2).alias("g")), ["g"], c, keys=["id"]),
    ):
        assert joins_of(step(names[:2])) == joins_of(step(names))
    out = encode.stochastic_transform(df, params, names, 1, keys=["id"])
    assert encode.stochastic_inverse(out, params, names).exceptAll(df).isEmpty()


def test_draws_are_even_and_follow_the_keys(spark):
    df = spark.range(4000).select("id", F.lit(5.0).alias("hot"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("x"))
    params = encode.stochastic_fit(df, ["hot", "x"])
    one = {r.id: r for r in encode.stochastic_transform(df, params, ["hot", "x"], 1, keys=["id"]).collect()}
    two = {r.id: r for r in encode.stochastic_transform(df.repartition(7), params, ["hot", "x"], 1, keys=["id"]).collect()}
    other = {r.id: r for r in encode.stochastic_transform(df, params, ["hot", "x"], 2, keys=["id"]).collect()}
    assert one == two and one != other and len(one) == 4000
    hot = np.array([r.hot for r in one.values()])
    assert abs(hot.mean() - 0.5) < 4 / np.sqrt(12 * 4000) and 0 <= hot.min() and hot.max() < 1


def test_generated_rows(spark):
    real = spark.createDataFrame([(g, None if k % 4 == 0 else float(k % 5 + 10 * g), "ab"[k % 2]) for g in (0, 1) for k in range(400)], "g int, x double, c string")
    wanted = spark.range(3000).select("id", (F.col("id") % 2).cast("int").alias("g"))
    got = sampling.generate_rows(real, wanted, ["g"], ["x"], ["c"], 2, 5, ["id"]).collect()
    assert len(got) == 6000 and {r.copy for r in got} == {1, 2}
    assert len({(r.id, r.x, r.c) for r in got}) > 3000  # copies have draws of their own
    for g in (0, 1):
        own = [r for r in got if r.g == g]
        assert {r.x for r in own} == {None, *[v + 10.0 * g for v in range(5)]}
        assert abs(sum(r.x is None for r in own) / len(own) - 0.25) < 0.04
        assert {r.c for r in own} == {"a", "b"}


def test_rows_of_hot_values_are_not_shuffled(spark):
    """Values of many rows meet their intervals where they are; null, unknown and rare values are joined all the same."""
    from cohortspark.operators.joins import spread_join

    values = [float(i % 3) for i in range(3000)] + [10.0 + i for i in range(5)] + [None, -1.0]
    df = spark.createDataFrame([(i, "f", v) for i, v in enumerate(values)], "_row long, feature string, value double")
    known = [("f", v, values.count(v), v / 2) for v in sorted({v for v in values if v is not None and v >= 0})]
    out = spread_join(df, spark.createDataFrame(known, "feature string, value double, _n long, lo double"), ["feature", "value"], "_n")
    assert out.columns == ["_row", "feature", "value", "lo"]
    assert {r._row: r.lo for r in out.collect()} == {i: None if v is None or v < 0 else v / 2 for i, v in enumerate(values)} and out.count() == len(values)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "_salt" not in plan
