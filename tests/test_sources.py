"""Readers over small files: CSV, gzip, discovery, conversion, mapping tables; and a short parameter search."""

import gzip
import os

from pyspark.sql import functions as F

from tables import rows
from cohortspark.operators import utility
from cohortspark.sources import readers, writers


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "wt") as f:
        f.write(text)


def test_csv_readers(spark, folder):
    put(f"{folder}/hosp/patients.csv", "anchor_age,subject_id,sex\n63 years,1,M\n10 months,2.0,F\n")
    put(f"{folder}/icu/d_items.csv.gz", "itemid,label,linksto\n1,a,chartevents\n1,a,chartevents\n2,b,inputevents\n")
    put(f"{folder}/columns.txt", "subject_id\nanchor_age")
    got = readers.read_raw(spark, folder, "patients", "csv", included=f"{folder}/columns.txt")
    assert got.dtypes == [("subject_id", "bigint"), ("anchor_age", "string")] and got.count() == 2
    assert rows(readers.read_items(spark, folder, "chartevents", extension="csv.gz")) == [(1, "a")]
    assert readers.read_raw(spark, folder, "patients", "csv", rows=1).count() == 1
    found = readers.find_files(spark, folder, ".csv", exclude="nothing")
    assert len(found) == 1 and found[0].endswith("patients.csv")
    readers.csv_to_parquet(spark, f"{folder}/hosp/patients.csv", f"{folder}/p.parquet")
    readers.csv_to_parquet(spark, f"{folder}/hosp/patients.csv", f"{folder}/p.parquet")
    assert spark.read.parquet(f"{folder}/p.parquet").count() == 2


def test_mapping_tables(spark, folder):
    put(f"{folder}/labels.csv", "raw,n,x,canonical\nHR,5,,heart rate\nzz,1,,Others\n")
    put(f"{folder}/limits.csv", "label_modified,lower_limit,upper_limit,include_lower,include_upper\nHR,0,300,1,\n")
    put(f"{folder}/map.csv", "icd_9|icd_10\n001|A1\n001|A1\n002|B2\n")
    put(f"{folder}/features.csv", "b\na\n")
    assert rows(readers.read_label_map(spark, f"{folder}/labels.csv")) == [("HR", "heart rate"), ("zz", "Others")]
    assert readers.read_limits(spark, f"{folder}/limits.csv") == {"HR": {"lower_limit": 0.0, "upper_limit": 300.0, "include_lower": 1.0, "include_upper": None}}
    assert rows(readers.read_code_map(spark, f"{folder}/map.csv", "|")) == [("001", "A1"), ("002", "B2")]
    assert readers.read_feature_list(spark, f"{folder}/features.csv") == ["b", "a"]
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "k int, v array<double>")
    writers.save_vectors(vectors, f"{folder}/v", ["k"], "v")
    writers.save_table(vectors.select("k"), f"{folder}/k", "csv")
    assert rows(spark.read.parquet(f"{folder}/v")) == [(1, [1.0, 2.0])] and readers.read_file(spark, f"{folder}/k/*.csv").count() == 1


def test_parameter_search(spark):
    df = spark.range(120).select("id", (F.col("id") % 7).cast("double").alias("a"), ((F.col("id") % 7 > 3) | (F.col("id") % 11 == 0)).cast("int").alias("y"))
    draw = lambda name, rng: {"regParam": rng.random() / 100, "maxIter": 10}
    best, score = utility.tune(df, "y", "id", "Logistic Regression", trials=2, folds=2, batch=2, draw=draw)
    assert set(best) == {"regParam", "maxIter"} and score > 0.8


def test_parameters_mean_what_they_say(spark):
    """C and class weights as in the usual objective: the fit is that of gradient descent on C · loss + |w|² / 2."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0.8).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id int, a double, b double, y int")
    rows = utility.with_class_weights(utility.assemble(df.drop("id"), "y"))
    for balanced in (False, True):
        model = utility.model_from_params("Logistic Regression", {"C": 0.05, "balanced": balanced, "maxIter": 500}, rows=200).fit(rows)
        weight = np.where(y == 1, 100 / y.sum(), 100 / (200 - y.sum())) if balanced else np.ones(200)
        w, b = np.zeros(2), 0.0
        for _ in range(20000):
            p = 1 / (1 + np.exp(-(x @ w + b)))
            w -= 0.01 * (w + 0.05 * x.T @ (weight * (p - y)))
            b -= 0.01 * 0.05 * (weight * (p - y)).sum()
        assert np.allclose(model.coefficients.toArray(), w, atol=2e-3) and abs(model.intercept - b) < 5e-3


def test_mapping_tables_have_one_row_per_key(spark, tmp_path):
    labels = tmp_path / "labels.csv"
    labels.write_text("raw,b,c,canonical\nHR,,,pulse\nHR,,,heart rate\nHR,,,pulse\n")
    assert rows(readers.read_label_map(spark, str(labels))) == [("HR", "heart rate")]
    levels = tmp_path / "levels.csv"
    levels.write_text("itemid,label,LEVEL1,LEVEL2\n7,a,x,q\n7,a,x,p\n")
    assert rows(readers.read_item_levels(spark, str(levels))) == [(7, "p")]
