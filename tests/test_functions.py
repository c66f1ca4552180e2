"""Column functions on literal inputs with answers worked by hand."""

import math
from datetime import datetime

from pyspark.sql import functions as F

from tables import rows
from cohortspark.functions import flags, stats, text, times, units


def one(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_numbers_and_keys(spark):
    values = ["5", " 1.5e2 ", "5d", "-", "nan", "1_000", None, ".5"]
    assert one(spark, values, "string", text.number_or_null) == [5.0, 150.0, None, None, None, 1000.0, None, 0.5]
    assert one(spark, ["nan", "-inf", "x", "3"], "string", text.is_number) == [True, True, False, True]
    assert one(spark, ["12.0", "12.05", "nan", "", None], "string", text.clean_key) == ["12", "12.05", None, None, None]


def test_ages_amounts_and_rates(spark):
    got = one(spark, ["63 years", "6 months", "365 days", "3 weeks"], "string", text.age_in_years)
    assert got[:2] == [63.0, 0.5] and abs(got[2] - 365 / 365.25) < 1e-12 and got[3] is None
    assert one(spark, ["50 cc", "7.5", "none", None], "string", text.amount_or_cc) == [50.0, 7.5, None, None]
    notes = ["0.05 mcg/kg/min", "given 5 mcg/70kg/min now", "80cc/hr", "no rate", None]
    assert one(spark, notes, "string", lambda c: text.rate_value(c, "/min")) == ["0.05", "5", None, None, None]
    assert one(spark, notes, "string", lambda c: text.rate_unit(c, "/min")) == ["mcg/kg/min", "mcg/70kg/min", None, None, None]
    assert one(spark, notes, "string", lambda c: text.rate_unit(c, "/hr")) == [None, None, "cc/hr", None, None]


def test_races_stars_and_bands(spark):
    values = ["ASIAN - X", "WHITE", "BLACK/Y", "HISPANIC OR LATINO", "UNABLE TO OBTAIN", "else", None]
    assert one(spark, values, "string", text.race_class) == ["ASIAN", "WHITE", "BLACK", "HISPANIC/LATINO", "UNKNOWN", "OTHER", "OTHER"]
    assert one(spark, [0.0005, 0.005, 0.05, None], "double", text.significance_stars) == ["***", "**", "", ""]
    assert one(spark, [-0.6, -0.5, -0.1, 0.1, 0.5, None], "double", text.correlation_band) == [0, 1, 3, 4, 6, None]


def test_timestamps_and_hours(spark):
    values = ["2023-01-02 03:04:05.5", "2023-01-02T03:04:05", "2023-01-02 03:04:05", "bad"]
    got = one(spark, values, "string", times.parse_timestamp)
    assert got[0] == datetime(2023, 1, 2, 3, 4, 5, 500000) and got[1] == got[2] == datetime(2023, 1, 2, 3, 4, 5) and got[3] is None
    df = spark.createDataFrame([(datetime(2023, 1, 1, 0, 30), datetime(2023, 1, 1, 1, 0)), (datetime(2023, 1, 1, 3, 59), datetime(2023, 1, 1, 1, 0))], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(times.whole_hours("a", "b")).collect()] == [0, 2]  # half an hour before is hour 0
    spans = spark.createDataFrame([(3, 1), (1, 3), (-2, 1)], "s bigint, e bigint")
    assert [r[0] for r in spans.select(times.hour_span("s", "e")).collect()] == [[], [1, 2, 3], [-2, -1, 0, 1]]
    assert rows(times.explode_hours(spans, "s", "e")) == [(0,), (1,), (1,), (2,), (3,)]


def test_units(spark):
    assert one(spark, ["cc/hr", "ccc/hr", "", "/hr", "mg/hr", None], "string", units.clean_unit) == ["cc/hr", "cc/hr", "cc/hr", "cc/hr", "mg/hr", None]
    cases = [
        ("Norepinephrine", 0.5, "mcg/kg/min", "mcg/min", 60.0, 30.0),
        ("Norepinephrine", 5.0, "mcg/kg/min", "mcg/min", 60.0, 5.0),
        ("Norepinephrine", 2.0, "mcg/50kg/min", "mcg/min", None, 100.0),
        ("Remifentanil", 6.0, "mcg/kg/min", "mcg/kg/min", 60.0, 0.05),
        ("Remifentanil", 3.0, "mcg/min", "mcg/kg/min", 60.0, 0.05),
        ("Propofol", 9.0, "mcg/min", "mcg/kg/min", None, 9.0),
        ("Other", 6.0, "mg/hr", "mcg/kg/min", 50.0, 2.0),
        ("Other", 6.0, "mg/hr", "mcg/kg/min", 0.0, None),
        ("Other", 30.0, "unit/min", "unit/hr", None, 1800.0),
        ("Other", 30.0, "cc/hr", "mg/hr", 50.0, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, medication string, r double, unit string, standard_unit string, patientweight double, want double")
    for r in units.convert_rates(df, "r", output="got").collect():
        assert (r["got"] is None) == (r["want"] is None) and (r["want"] is None or abs(r["got"] - r["want"]) < 1e-9), r
    slips = spark.createDataFrame([("Dexmedetomidine", 40.0), ("Dexmedetomidine", 3.0), ("Dexmedetomidine", 1.0), ("X", 40.0)], "m string, r double")
    assert [round(r[0], 6) for r in slips.select(units.repair_decimal_slip("m", "r")).collect()] == [0.4, 0.3, 1.0, 40.0]


def test_tail_probabilities(spark):
    xs = [0.0, 0.3, 1.0, 2.4, 2.6, 5.0]
    got = one(spark, xs, "double", stats.erfc)
    assert all(abs(g - math.erfc(x)) < 1e-10 * max(1.0, math.erfc(x)) for g, x in zip(got, xs))
    assert abs(got[-1] / math.erfc(5.0) - 1) < 1e-9
    k = one(spark, [0.0, 1.3581, 3.0], "double", stats.kolmogorov_p)
    assert k[0] == 1.0 and abs(k[1] - 0.05) < 1e-4 and k[2] < 1e-6


def test_flags(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, c string")
    assert rows(flags.one_hot(df, "c", "c")) == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]
    family = spark.createDataFrame([(1, 1, None), (2, None, None)], "i int, p_a int, p_b int")
    assert rows(flags.fill_flag_family(family, "p_"), "p_a", "p_b", "p_Others") == [(0, 0, 1), (1, 0, 1)]
    wide = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (None, None, None)], "x int, y int, z int")
    assert [r[0] for r in wide.select(flags.first_maximum(["x", "y", "z"])).collect()] == ["y", "x", None]
    logits = spark.createDataFrame([([1.0, 1.0, 3.0],)], "a array<double>")
    out = logits.select(flags.softmax("a").alias("s"), flags.activate("a", "sigmoid", 0.8).alias("b"), flags.block_argmax("a").alias("m")).first()
    assert abs(sum(out["s"]) - 1) < 1e-12 and out["b"] == [0.0, 0.0, 1.0] and out["m"] == 2
