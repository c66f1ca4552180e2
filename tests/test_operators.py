"""Operators against hand-worked answers and brute force, with hot keys and copies."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tables import rows
from cohortspark.operators import encode, fidelity, filters, grid, impute, joins, neighbours, ordered, privacy, rollup, sampling, utility


def test_running_sum_and_quantiles_with_a_hot_value(spark):
    rng = random.Random(1)
    values = [("a", 5.0)] * 400 + [("a", rng.uniform(0, 10)) for _ in range(900)] + [("b", float(i)) for i in range(7)]
    df = spark.createDataFrame(values, "g string, v double")
    got = ordered.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.999], ["x", "y", "z"]).collect()
    for r in got:
        own = [v for g, v in values if g == r["g"]]
        assert np.allclose([r["x"], r["y"], r["z"]], np.quantile(own, [0.1, 0.5, 0.999]))
    alone = ordered.exact_quantiles(df, [], "v", [0.25], ["q"]).first()
    assert abs(alone["q"] - np.quantile([v for _, v in values], 0.25)) < 1e-12


def test_ranked_is_a_permutation(spark):
    df = spark.range(5000).withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    out = ordered.ranked(df, ["g"], "id", 7)
    for g, n in ((0, 3333), (1, 1667)):
        ranks = sorted(r["rank"] for r in out.filter(F.col("g") == g).collect())
        assert ranks == list(range(1, n + 1))


def test_fold_rare_needs_more_than_one_rare_level(spark):
    df = spark.createDataFrame([("a",)] * 60 + [("b",)] * 38 + [("c",), ("d",)] + [(None,)] * 5, "k string")
    assert dict(rows(rollup.fold_rare(df, "k", 0.05).groupBy("k").count())) == {"a": 60, "b": 38, "Others": 2, None: 5}
    assert dict(rows(rollup.fold_rare(df, "k", 0.05, fold_null=True).groupBy("k").count())) == {"a": 60, "b": 38, "Others": 7}
    one = df.filter("k <> 'd'")
    assert dict(rows(rollup.fold_rare(one, "k", 0.05).groupBy("k").count())) == {"a": 60, "b": 38, "c": 1}


def test_share_cutoff_rounds_half_even(spark):
    df = spark.createDataFrame([("a",)] * 988 + [("b",)] * 6 + [("c",)] * 5 + [("d",)], "k string")
    assert {r["k"] for r in rollup.share_cutoff(df, "k", 0.01).collect()} == {"a", "b"}


def test_types(spark):
    df = spark.createDataFrame([(0, 1.0, "x", 1.5, None), (1, 2.0, "y", 2.0, None), (1, None, None, None, None)], "f int, c double, t string, n double, e double")
    assert rollup.infer_types(df) == {"f": "Binary", "c": "Categorical", "t": "Categorical", "n": "Numerical", "e": "Binary"}
    assert rollup.infer_types(df, nulls_count=True)["c"] == "Numerical"
    assert filters.constant_columns(spark.createDataFrame([(1, 2, None), (1, 3, None)], "a int, b int, c int")) == ["a"]


def test_presence_pivot_merges_columns(spark):
    df = spark.createDataFrame([(1, "x", None, "iv"), (1, "y", "x", "iv"), (2, None, "x", "po")], "k int, d1 string, d2 string, route string")
    out = rollup.presence_pivot_many(df, ["k"], ["d1", "d2"], "route", 0.0)
    assert out.columns == ["k", "x_iv", "x_po"] or "x_iv" in out.columns
    assert {r["k"]: r["x_po"] for r in out.collect()} == {1: 0, 2: 1}


def test_interval_join_with_a_busy_key(spark):
    rng = random.Random(5)
    start = datetime(2023, 1, 1)
    pts = [(i, 1 if i % 3 == 0 else i % 20, start + timedelta(minutes=rng.randrange(60 * 24 * 40))) for i in range(600)]
    ivs = [(j, 1 if j % 3 == 0 else j % 20, start + timedelta(minutes=rng.randrange(60 * 24 * 40))) for j in range(150)]
    ivs = [(j, k, s, s + timedelta(minutes=rng.randrange(-50, 60 * 100))) for j, k, s in ivs]
    p = spark.createDataFrame(pts, "pid int, k int, t timestamp")
    i = spark.createDataFrame(ivs, "iid int, k int, s timestamp, e timestamp")
    for closed in (True, False):
        want = sorted((a[0], b[0]) for a in pts for b in ivs if a[1] == b[1] and b[2] <= a[2] and (a[2] <= b[3] if closed else a[2] < b[3]))
        assert rows(joins.interval_join(p, i, ["k"], "t", "s", "e", closed), "pid", "iid") == sorted(want, key=repr)


@pytest.mark.parametrize("chunk", [None, "c"])
def test_linear_imputation(spark, chunk):
    data = [(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, None), (1, 4, 5.0), (1, 5, None), (2, 0, None), (2, 1, None)]
    df = spark.createDataFrame(data, "s int, h int, v double").withColumn("c", F.floor(F.col("h") / 2))
    out = impute.impute_linear(df, ["s"], ["h"], ["v"], "mean", chunk)
    assert [r[2] for r in rows(out, "s", "h", "v")] == [2.0, 2.0, 3.0, 4.0, 5.0, 5.0, 3.5, 3.5]


def test_clip_and_pad(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0), (2, 5, 9.0)], "k int, hours bigint, v double")
    assert rows(grid.clip_pad(df, ["k"], ["hours"], 2), "k", "step", "v") == sorted([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 9.0), (2, 1, None)], key=repr)
    assert rows(grid.extend_hours(df, ["k"], 2), "k", "hours") == [(1, 0), (1, 1), (1, 2), (2, 5), (2, 6)]


def test_stochastic_encoding(spark):
    x = spark.createDataFrame([(v,) for v in [1.0] + [2.0] * 6 + [11.0, 3.0, 3.0, None, None]], "dbp double")
    params = encode.stochastic_fit(x, ["dbp"]).orderBy("value").collect()
    assert [r["value"] for r in params] == [1.0, 2.0, 3.0, 11.0]
    w = np.array([1.1, 1.6, 1.2, 1.1]) ** 2
    assert np.allclose([r["hi"] for r in params], np.cumsum(w) / w.sum()) and params[0]["lo"] == 0.0
    fitted = encode.stochastic_fit(x, ["dbp"])
    fresh = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 14.0, 7.0, 2.5, None, -4.0])], "i int, dbp double")
    u = encode.stochastic_transform(fresh, fitted, ["dbp"], 3)
    back = encode.stochastic_inverse(u, fitted, ["dbp"])
    assert [r[1] for r in rows(back, "i", "dbp")] == [1.0, 11.0, 3.0, 2.0, None, 1.0]  # ties go to the lower value
    edge = spark.createDataFrame([(0, 0.0), (1, 1.5), (2, None)], "i int, dbp double")
    assert [r[1] for r in rows(encode.stochastic_inverse(edge, fitted, ["dbp"]), "i", "dbp")] == [1.0, None, None]


def test_encoder_roundtrip_and_state(spark, folder):
    df = spark.createDataFrame([(1, 0, "M", 23.0, "Asian"), (2, 1, "F", 35.0, "Asian"), (3, 0, "M", 40.0, "Asian"), (4, 0, None, 57.0, "Asian")], "i int, mortality int, gender string, age double, race string")
    types = {"mortality": "Binary", "gender": "Categorical", "age": "Numerical", "race": "Categorical"}
    enc = encode.Encoder.fit(df, types, drop_first=False)
    enc.save(spark, folder)
    again = encode.Encoder.load(spark, folder)
    assert rows(again.inverse(again.transform(df, ["i"]), ["i"]), *df.columns) == rows(df)
    assert [r["offset"] for r in enc.layout(spark).orderBy("position").collect()] == [0, 1, 3, 4]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    ref = np.round(rng.normal(size=(400, 4)), 1)
    ref[:130] = ref[0]  # a third of the rows are copies
    ask = np.vstack([np.round(rng.normal(size=(150, 4)), 1), np.repeat(ref[:1], 70, axis=0)])
    frame = lambda m, name: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} bigint, vector array<double>")
    for metric in ("euclidean", "hamming"):
        d = ((ask[:, None] - ref[None]) ** 2) if metric == "euclidean" else (ask[:, None] != ref[None])
        total = sum(d[:, :, k].astype(float) for k in range(4)) / (1 if metric == "euclidean" else 4)
        for k in (1, 4):
            got = neighbours.knn_join(frame(ask, "q"), frame(ref, "r"), "q", "r", k=k, metric=metric, pivots=8).collect()
            order = np.argsort(total, axis=1, kind="stable")[:, :k]
            assert {(r["q"], r["rank"]): r["r"] for r in got} == {(i, j + 1): int(order[i, j]) for i in range(len(ask)) for j in range(k)}
    x, y = ref[:200], ask
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / 2).mean()
    got = neighbours.mmd(frame(x, "q"), frame(y, "q")).first()[0]
    assert abs(got - (kernel(x, x) + kernel(y, y) - 2 * kernel(x, y))) < 1e-12


def test_correlation_paths_agree(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 20)) + 1e6
    m[:, 3] = 7.0
    data = [[None if (i * j) % 11 == 3 else float(v) for j, v in enumerate(row)] for i, row in enumerate(m)]
    names = [f"c{i}" for i in range(20)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in names))
    wide = {(r["a"], r["b"]): (r["n"], r["r"]) for r in fidelity.pearson_pairs(df, names).collect()}
    few = {(r["a"], r["b"]): (r["n"], r["r"]) for r in fidelity.pearson_pairs(df, names[:6]).collect()}
    assert len(wide) == 190
    for key, (n, r) in few.items():
        assert wide[key][0] == n and (r is None) == (wide[key][1] is None) and (r is None or abs(r - wide[key][1]) < 1e-9)
    assert few[("c0", "c3")][1] is None


def test_ks_of_equal_tables_is_zero(spark):
    df = spark.createDataFrame([(float(i % 9), None if i % 4 else 1.0) for i in range(50)], "a double, b double")
    assert {r["ks"] for r in fidelity.ks_table(df, df, ["a", "b"]).collect()} == {0.0}


def test_acf_across_chunks(spark):
    x = np.sin(np.arange(9000) / 7.0) + np.arange(9000) % 5
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "pos bigint, v double")
    got = {r["lag"]: r["acf"] for r in fidelity.acf(df, "pos", ["v"], [0, 1, 12, 29]).collect()}
    c = x - x.mean()
    for lag, value in got.items():
        assert abs(value - (c[lag:] * c[: len(c) - lag]).sum() / (c * c).sum()) < 1e-10


def test_privacy_small_table(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "a", "y"), (2, "b", "x"), (2, "b", "x"), (None, "b", "z")], "q int, g string, s string")
    assert privacy.k_anonymity(df, ["q", "g"]).first()[0] == 2
    assert privacy.l_diversity(df, ["q", "g"], "s").first()[0] == 1
    assert abs(privacy.t_closeness(df, ["q", "g"], "s").first()[0] - np.log(2)) < 1e-12
    a = spark.createDataFrame([(1, None), (2, 2)], "x int, y int")
    b = spark.createDataFrame([(1, None), (2, 3), (2, 2), (2, 2)], "x int, y int")
    assert privacy.single_out_risk(a, b, ["x", "y"]).first()[0] == 0.75


def test_auc_symmetry_and_tests(spark):
    rng = random.Random(9)
    data = [(rng.randrange(2), rng.randrange(12) / 3.0, rng.random()) for _ in range(300)]
    df = spark.createDataFrame(data, "y int, s double, t double")
    up = utility.roc_auc(df, "y", "s").first()[0]
    down = utility.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first()[0]
    assert abs(up + down - 1) < 1e-12
    same = utility.delong(df.withColumn("t", F.col("s") * 2), "y", "s", "t").first()
    assert abs(same["auc1"] - up) < 1e-12 and same["z"] is None
    pairs = spark.createDataFrame([(0.7, 0.6), (0.8, 0.75), (0.6, 0.6), (0.9, 0.7), (0.65, 0.7)], "a double, b double")
    w = utility.wilcoxon(pairs, "a", "b").first()
    assert w["n"] == 4 and w["w"] <= 5
    assert not utility.plateaued([0.5] * 20) and utility.plateaued([0.5] * 40)


def test_splits(spark):
    df = spark.createDataFrame([(p, i, p % 2) for p in range(100) for i in range(2)], "p int, i int, y int")
    out = sampling.patient_split(df, "p", "y", ["i"], 0.7, 0.3, None, 1)
    counts = dict(rows(out.select("p", "split").distinct().groupBy("split").count()))
    assert counts == {"train": 56, "val": 14, "test": 30}
    real, synth = df.filter("p < 40"), df.filter("p >= 40").withColumn("id", F.col("p") * 2 + F.col("i"))
    draws = sampling.incremental_samples(real, synth, "y", "id", [0.1, 0.5]).collect()
    small = {(r["y"], r["draw"], r["id"]) for r in draws if r["rate"] == 0.1}
    large = {(r["y"], r["draw"], r["id"]) for r in draws if r["rate"] == 0.5}
    assert len(small) == 8 and len(large) == 40 and small < large


def _test_part(spark, ids, seed):
    parts = sampling.holdout_split(spark.createDataFrame([(i,) for i in ids], ["id"]), "id", 0.8, seed)
    return {r["id"] for r in parts.filter("part = 'holdout'").collect()}


@pytest.mark.parametrize("ids", [list(range(2000)), [f"stay-{i}" for i in range(2000)]], ids=["number", "text"])
def test_seeds_give_new_samples(spark, ids):
    samples = [_test_part(spark, ids, seed) for seed in (1, 2, 997)]
    for a in range(3):
        assert len(samples[a]) == 400
        for b in range(a):
            assert abs(len(samples[a] & samples[b]) / 400 - 0.2) < 4 * (0.2 * 0.8 * 0.8 / 400) ** 0.5


def test_halves_are_independent(spark):
    df = spark.createDataFrame([(i,) for i in range(400)], ["id"])
    halves = {}
    for r in privacy.random_halves(df, "id", 100).filter("half = 'a'").select("round", "id").collect():
        halves.setdefault(r["round"], set()).add(r["id"])
    assert {len(h) for h in halves.values()} == {200}
    shares = [len(halves[1] & halves[k]) / 200 for k in range(2, 101)]
    spread = (0.25 / 200 * 0.5) ** 0.5
    mean = sum(shares) / 99
    assert abs(mean - 0.5) < 4 * spread / 99**0.5
    assert 0.7 * spread < (sum((s - mean) ** 2 for s in shares) / 98) ** 0.5 < 1.3 * spread


def test_draws_with_replacement(spark):
    df = spark.range(2000).withColumn("at", sampling.draw_index(F.col("id"), F.lit(2000), 5))
    assert abs(df.select("at").distinct().count() / 2000 - 0.632) < 0.03
    assert {r["g"]: r["n"] for r in df.groupBy((F.floor((F.col("at") - 1) / 1000)).alias("g")).agg(F.count("*").alias("n")).collect()}.keys() == {0, 1}


@pytest.mark.parametrize("wide", [False, True])
def test_pearson_is_the_same_at_every_width(spark, wide):
    """Null and NaN are missing and a constant column has no correlation, whichever way the moments are summed."""
    rng = np.random.default_rng(5)
    data = rng.normal(size=(60, 17)) + 1e6
    data[:, 1] += 2 * data[:, 0]
    data[:, 2] = 0.1
    data[:7, 1] = np.nan
    table = [[None if (r, c) in ((8, 0), (9, 1)) else float(data[r, c]) for c in range(17)] for r in range(60)]
    columns = [f"c{i}" for i in range(17)]
    df = spark.createDataFrame(table, ", ".join(f"{c} double" for c in columns))
    got = fidelity.pearson_pairs(df, columns if wide else columns[:4]).collect()
    pair = {(r["a"], r["b"]): r for r in got}
    used = [r for r in range(7, 60) if r not in (8, 9)]
    assert pair["c0", "c1"]["n"] == len(used)
    assert abs(pair["c0", "c1"]["r"] - np.corrcoef(data[used, 0], data[used, 1])[0, 1]) < 1e-6
    assert pair["c0", "c2"]["r"] is None and pair["c1", "c2"]["n"] == 52


def test_round_risks_do_not_depend_on_scale(spark):
    rng = random.Random(3)
    table = [(i, float(rng.randrange(40)), float(rng.randrange(40)), float(rng.randrange(3))) for i in range(200)]
    small = spark.createDataFrame(table, "id long, x double, y double, s double")
    large = small.withColumns({"x": F.col("x") * 2.0**30, "y": F.col("y") * 2.0**30})
    one, two = (sorted(map(tuple, privacy.risk_rounds(d, "id", ["x", "y"], 3).collect())) for d in (small, large))
    assert [r[:3] for r in one] == [r[:3] for r in two] and len(one) == 3
    one, two = (sorted(map(tuple, privacy.attribution_rounds(d, "id", ["x", "y"], ["s"], 3).collect())) for d in (small, large))
    assert one == two


def test_default_models_train_as_long_as_the_reference(spark):
    models = utility.default_models()
    assert models["Logistic Regression"].getMaxIter() == 1000
    assert models["GBDT"].getMaxIter() == 100
    assert models["Random Forest"].getNumTrees() == 100
