"""Running sums, ranks, fills and lags when the rows need many ranges and one group has half of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import rows

from cohortspark.operators import encode, fidelity, impute, ordered, utility


@pytest.fixture()
def small_ranges(monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 40)


def series(spark, n=600):
    rng = random.Random(7)
    table = []
    for i in range(n):
        who = "big" if i % 2 else f"p{rng.randrange(30)}" if i % 6 else None
        table.append((who, i, None if rng.random() < 0.6 else float(rng.randrange(50)), "ab"[i % 2] if rng.random() < 0.2 else None))
    return table, spark.createDataFrame(table, "who string, at int, x double, c string").repartition(3)


def test_ranges_follow_the_rows(spark, monkeypatch):
    df = spark.range(1000).withColumn("g", F.lit(1))
    assert ordered.in_ranges(df, ["g"], ["id"])[1] == 1
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    few, parts = ordered.in_ranges(df, ["g"], ["id"])
    many, more = ordered.in_ranges(spark.range(4000).withColumn("g", F.lit(1)), ["g"], ["id"])
    assert (parts, more) == (10, 40)
    sizes = [r["count"] for r in many.groupBy("_range").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400  # one group, split
    assert few.groupBy("_range").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("_range").collect()[0].a == 0


def test_running_sums(spark, small_ranges):
    table, df = series(spark)
    got = {r["at"]: (r.one_before, r.one_total) for r in ordered.running_sum(df.withColumn("one", F.lit(2)), ["who"], ["at"], ["one"]).collect()}
    for who, at, *_ in table:
        own = [t[1] for t in table if t[0] == who]
        assert got[at] == (2 * sum(a < at for a in own), 2 * len(own))
    flat = ordered.running_sum(df.withColumn("one", F.lit(1)), [], ["at"], ["one"]).collect()
    assert all(r.one_before == r["at"] and r.one_total == len(table) for r in flat)


def test_ranks_and_quantiles_do_not_depend_on_ranges(spark, monkeypatch):
    _, df = series(spark)
    steps = [
        lambda: ordered.ranked(df, ["who"], "at", 3),
        lambda: ordered.exact_quantiles(df, ["who"], "x", [0.1, 0.5, 0.99], ["a", "b", "c"]),
        lambda: fidelity.ks_table(df, df.withColumn("x", F.col("x") + 3), ["x"]),
        lambda: encode.stochastic_fit(df, ["x"], by=["c"]),
        lambda: impute.midrank(df, ["who"], "x"),
        lambda: utility.wilcoxon(df.withColumn("y", F.lit(20.0)), "x", "y"),
        lambda: encode.nearest_known(df.select(F.lit("x").alias("feature"), (F.col("x") + 0.3).alias("value")).dropna(), encode.stochastic_fit(df, ["x"])),
    ]
    once = [[tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows(step())] for step in steps]
    monkeypatch.setattr(ordered, "RANGE_ROWS", 7)
    again = [[tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows(step())] for step in steps]
    assert once == again and all(once)


def test_fills_and_lags_of_a_hot_patient(spark, small_ranges):
    table, df = series(spark)
    by = {}
    for who, at, x, c in table:
        by.setdefault(who, []).append((at, x, c))
    filled = {r["at"]: r.x for r in impute.forward_fill(df, ["who"], ["at"], ["x"]).collect()}
    index = {r["at"]: r.hour_index for r in impute.hour_index(df, ["who"], ["at"]).collect()}
    lagged = {r["at"]: (r.x, r.x_lag) for r in impute.lagged_pairs(df, ["who"], "at", ["x"], 3).collect()}
    linear = {r["at"]: r.x for r in impute.impute_linear(df, ["who"], ["at"], ["x"]).collect()}
    typed = {r["at"]: r.x for r in impute.impute_by_type(df, ["who"], ["at"], {"x": "Numerical"}, "median").collect()}
    assert len(filled) == len(index) == len(lagged) == len(linear) == len(table)
    for own in by.values():
        last = None
        known = [(k, x) for k, (_, x, _) in enumerate(own) if x is not None]
        for k, (at, x, _) in enumerate(own):
            last = x if x is not None else last
            assert filled[at] == last and index[at] == k
            assert lagged[at] == (x, own[k - 3][1] if k >= 3 else None)
            if known:
                want = np.interp(k, [p for p, _ in known], [v for _, v in known])
                assert abs(linear[at] - want) < 1e-9
                lead = np.median([v for _, v in known]) if k < known[0][0] else want
                assert abs(typed[at] - lead) < 1e-9


def test_attrition_in_one_pass(spark):
    """Each step's counts are those of its own table; steps that nobody passes are there with zeros."""
    from cohortspark.operators import rollup
    from cohortspark.plans import cohort

    rng = random.Random(1)
    patients = spark.createDataFrame([(k, f"{rng.randrange(1, 110)} years") for k in range(60)], "subject_id int, anchor_age string")
    admissions = spark.createDataFrame([(k, f"h{k}-{v}", "nan") for k in range(60) for v in range(2)], "subject_id int, hadm_id string, admission_type string")
    stays = [(k, f"h{k}-{v}", f"s{k}-{v}-{n % 3}", n, "AB"[rng.randrange(2)], "AB"[rng.randrange(2)], rng.random() * 14) for k in range(60) for v in range(2) for n in range(5)]
    stays = spark.createDataFrame(stays, "subject_id int, hadm_id string, stay_id string, intime int, first_careunit string, last_careunit string, los double")
    options = cohort.CohortOptions(drop_unit_transfers=True, first_stay_only=True)
    for own in (options, cohort.CohortOptions()):
        steps = cohort.cohort_steps(patients, admissions, stays, own)
        got = {r.step: (r.subjects, r.admissions, r.stays, r.rows) for r in cohort.attrition(patients, admissions, stays, own).collect()}
        for name, df in steps.items():
            want = [df.select(c).distinct().count() for c in ("subject_id", "hadm_id", "stay_id")]
            assert got[name] == (*want, df.count()), name
        assert set(got) == set(steps)
    empty = cohort.attrition(patients.limit(0), admissions, stays).collect()
    assert [r.rows for r in empty] == [0] * 4
    assert rollup.output_dimensions(spark.createDataFrame([(0.0, "a", 1), (-0.0, None, 2)], "x double, c string, p_1 int"), {"x": "Binary", "c": "Categorical", "p_1": "Listwise", "n": "Numerical"}, ["p_"]) == {"x": 1, "c": 1, "p_": 1, "n": 1}
