"""From raw tables to split data sets and reports on a small generated hospital."""

from pyspark.sql import functions as F

import fixture
from tables import rows
from cohortspark.operators import encode, joins, sampling
from cohortspark.plans import cohort, dataset, features, reports
from cohortspark.sources import readers, writers

KEYS = list(cohort.KEYS)


def test_pipeline(spark, folder):
    raw = fixture.build(spark)
    for name, df in raw.items():
        df.coalesce(1).write.parquet(f"{folder}/raw/{readers.FOLDERS.get(name, 'hosp')}/{name}.parquet")
    read = lambda name: readers.read_raw(spark, f"{folder}/raw", name)
    events = lambda name: readers.read_events(spark, f"{folder}/raw", name)
    labels = fixture.label_map(spark)

    sources = read("patients"), read("admissions"), read("icustays")
    steps = cohort.cohort_steps(*sources)
    counted = {r["step"]: r["stays"] for r in cohort.attrition(*sources).collect()}
    people = 40
    stays = people + people // 2
    assert counted["start"] == stays
    assert counted["age"] == stays - 2  # the five-month-old has two stays
    assert counted["length of stay"] == stays - 2 - 1  # the three-hour stay
    own = list(steps.values())[-1]
    own.write.parquet(f"{folder}/cohort")
    own = spark.read.parquet(f"{folder}/cohort")
    assert own.filter("admission_type = 'nan'").count() == 0

    diagnoses = features.diagnoses(read("diagnoses_icd"), own, 0.05)
    assert "icd-10-cm_Others" in diagnoses.columns and "icd-10-cm_A1" in diagnoses.columns
    procedures = features.procedures(read("procedures_icd"), own, 0.05)
    moved = features.transfers(read("transfers"), own)
    inputs = features.input_events(events("inputevents"), own, labels)
    assert {r["amount"] for r in inputs.collect()} == {50.0, 75.5}
    procs = features.procedure_events(events("procedureevents"), own, labels)
    meds_map = spark.createDataFrame([("Drug N", "Norepinephrine"), ("Drug S", "Normal saline")], "raw string, canonical string")
    standard = spark.createDataFrame([("Norepinephrine", "mcg/min"), ("Normal saline", "cc/hr")], "medication string, standard_unit string")
    meds = features.medications(read("emar"), read("emar_detail"), own, meds_map, standard, [inputs, procs])
    first = meds.filter("medication = 'Norepinephrine'").join(own.select("subject_id", "hadm_id"), ["subject_id", "hadm_id"]).collect()
    assert all(abs(r["infusion_rate"] - 0.2 * (61.0 + r["subject_id"])) < 1e-9 for r in first)
    assert {r["infusion_rate"] for r in meds.filter("medication = 'Normal saline'").collect()} == {80.0}
    charts = features.chart_events(events("chartevents"), own, labels)
    assert charts.filter("label = 'Glasgow coma scale(eye)' AND CAST(value AS DOUBLE) > 4").count() == 0
    outputs = features.output_events(events("outputevents"), own, labels)
    labs = features.lab_events(events("labevents"), own, labels)
    union = features.all_events([charts, outputs, labs])
    assert union.filter("value IS NULL").count() == 0

    options = dataset.DatasetOptions(steps=12, limits={"systolic pressure": {"lower_limit": 50, "upper_limit": 300}})
    static = dataset.static_features(own, diagnoses, procedures, options)
    split = {r["split"] for r in static.data.select("split").distinct().collect()}
    assert {"train", "val", "test"} <= split
    per_patient = static.data.groupBy("subject_id").agg(F.count_distinct("split").alias("n"))
    assert per_patient.filter("n > 1").count() == 0

    tables = {"transfers": moved, "medications": meds, "inputs": inputs, "procedures": procs, "charts": charts, "outputs": outputs, "labs": labs}
    wide = dataset.temporal_grid(own.select(*KEYS, "intime", "outtime"), tables, options)
    hours = wide.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("hours").alias("m"))
    assert hours.filter("n <> m + 1").count() == 0
    temporal = dataset.temporal_features(wide, own, static.data.filter("split IS NOT NULL"), options)
    assert temporal.feature_type["systolic pressure"] == "Numerical"
    assert temporal.data.groupBy(*KEYS).count().filter("count <> 12").count() == 0
    assert temporal.data.filter("hours IS NOT NULL AND `systolic pressure` IS NULL").count() == 0
    assert temporal.data.agg(F.max("systolic pressure")).first()[0] <= 300
    static, temporal = dataset.total_features(static, temporal)
    assert static.data.count() == temporal.data.select(*KEYS).distinct().count()

    writers.save_split(temporal.data, f"{folder}/temporal", temporal.feature_type, temporal.dtypes, temporal.output_dimension)
    back, meta = readers.read_split(spark, f"{folder}/temporal", "train")
    assert meta["feature_type"]["systolic pressure"] == "Numerical"
    assert back.count() == temporal.data.filter("split = 'train'").count()

    kinds = {c: k for c, k in temporal.feature_type.items() if c in back.columns and k in ("Numerical",)}
    encoder, encoded = writers.fit_or_load(spark, back, kinds, [*KEYS, "step"], f"{folder}/state", f"{folder}/encoded")
    again, same = writers.fit_or_load(spark, back, kinds, [*KEYS, "step"], f"{folder}/state", f"{folder}/encoded")
    assert [b.column for b in again.blocks] == [b.column for b in encoder.blocks] and rows(same) == rows(encoded)

    s_kinds = {c: k for c, k in static.feature_type.items() if k in ("Numerical", "Categorical") and c in static.data.columns}
    ready = encode.model_ready(static.data.filter("split = 'train'"), back, KEYS, encode.Encoder.fit(static.data, s_kinds), encoder, 12)
    shape = ready.select(F.size("sequence").alias("t"), F.size(F.element_at("sequence", 1)).alias("f")).distinct().collect()
    assert [(r["t"], r["f"]) for r in shape] == [(12, len(encoder.blocks))]


def test_reports(spark):
    base = spark.range(160).withColumn("hadm", F.col("id") % 4)
    value = lambda k: (F.pmod(F.col("id") * k, F.lit(97)) / 10.0)
    real = base.select("id", value(31).alias("a"), value(53).alias("b"), value(7).alias("c"), F.pmod(F.col("id") * 13, F.lit(2)).cast("int").alias("f"), (F.pmod(F.col("id") * 29, F.lit(97)) > 48).cast("int").alias("y"))
    synth = real.withColumns({"a": F.col("a") + 0.5, "b": F.col("b") * 1.1})
    stays = real.withColumns({"stay": F.floor(F.col("id") / 8), "step": F.col("id") % 8})
    stays_hat = synth.withColumns({"stay": F.floor(F.col("id") / 8), "step": F.col("id") % 8})
    fid = reports.fidelity_report(stays, stays_hat, ["a", "b", "c"], ["f", "y"], ["f"], "stay", steps=8, interval=4, lags=(1, 2))
    for name, df in fid.items():
        assert df.count() >= 1, name
    ks = {r["feature"]: r["ks"] for r in fid["statistics"].collect()}
    assert ks["c"] == 0.0 and ks["a"] > 0
    sub = reports.subgroup_report(real.withColumns({"icu_expire_flag": F.col("f"), "hospital_expire_flag": F.col("y")}), synth.withColumns({"icu_expire_flag": F.col("f"), "hospital_expire_flag": F.col("y")}), ["a"], ["f"])
    assert sub["box"].count() == 6
    free = reports.model_free_privacy(real, synth, "id", ["a", "b"], ["a"], ["f"], rounds=3)
    assert free["thresholds"].count() == 6 and free["attribution_thresholds"].count() == 3
    assert free["single_out"].first()[0] <= 1.0
    attacks = reports.attack_report(real, synth, "id", ["a", "b", "c", "f"], "y")
    assert 0 <= attacks["membership"].first()[0] <= 1 and attacks["attribute"].count() == 2
    task = reports.task_table(stays.select("stay", "step", "a", "b"), stays.groupBy("stay").agg(F.max("y").alias("y")), "stay", ["a", "b"], [], "y", ["a"], 4)
    assert task.columns == ["stay", "a", "y"] and task.count() == 20


def test_nearest_known_and_generated_rows(spark):
    real = spark.createDataFrame([(0, 1.0, "x"), (0, 2.0, "y"), (1, 10.0, "x"), (1, None, None)], "cond int, v double, k string")
    made = sampling.generate_rows(real, real.select("cond"), ["cond"], ["v"], ["k"], 50, 1)
    seen = {(r["cond"], r["v"]) for r in made.collect()}
    assert seen == {(0, 1.0), (0, 2.0), (1, 10.0), (1, None)}
    assert {r["k"] for r in made.filter("cond = 0").collect()} == {"x", "y"}
    assert {r["k"] for r in made.filter("cond = 1").collect()} == {"x", None}
    assert joins.merge_type_dicts([{"a": "x"}, {"a": "y", "b": "z"}], ["p", "q"]) == {"a": "x", "a__q": "y", "b": "z"}
