"""Feature extraction plans, and operators between them and the model-ready tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.catalog.cohort import _COHORT, _build, _codes
from cohortspark.catalog.registry import Tables, query, rnd
from cohortspark.catalog.roles import KEYS, events, items
from cohortspark.functions import flags, text
from cohortspark.operators import encode, fidelity, filters, grid, joins, rollup, utility
from cohortspark.operators.impute import hour_index
from cohortspark.plans import cohort, features, reports

_OWN = f"{_COHORT}, own AS (SELECT DISTINCT subject_id, hadm_id FROM cohort)"


def _set_flags(df: DataFrame, prefix: str) -> Column:
    """Names of the flag columns that are set, in order."""
    names = sorted(c for c in df.columns if c.startswith(prefix))
    return F.concat_ws(",", *[F.when(F.col(f"`{c}`") == 1, c[len(prefix) :]) for c in names])


@query(
    "diagnosis_features",
    f"""{_OWN}, codes AS (SELECT subject_id, hadm_id, seq_num, min(p_brand) AS code FROM events_ JOIN items USING (itemid) JOIN own USING (subject_id, hadm_id) GROUP BY ALL),
    s AS (SELECT code, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS share FROM codes GROUP BY code),
    f AS (SELECT subject_id, hadm_id, CASE WHEN share >= 0.03 THEN code ELSE 'Others' END AS code FROM codes JOIN s USING (code))
    SELECT subject_id, hadm_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM f GROUP BY ALL""",
)
def diagnosis_features(t: Tables):
    """Codes of the cohort's admissions, one per place, rare ones folded, one flag column each."""
    wide = features.diagnoses(_codes(t).drop("stay_id", "icd_version"), _build(t), 0.03)
    return wide.select("subject_id", "hadm_id", _set_flags(wide, features.DIAGNOSES_PREFIX).alias("codes"))


@query(
    "transfer_features",
    f"""{_OWN}, rows AS (SELECT subject_id, hadm_id, starttime AS intime, endtime AS outtime, CASE WHEN seq_num % 2 = 0 THEN 'transfer' ELSE 'admit' END AS eventtype,
      'unit ' || (itemid % 60) % 37 AS careunit FROM events_ JOIN own USING (subject_id, hadm_id)),
    one AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY subject_id, hadm_id, intime, outtime ORDER BY eventtype, careunit) = 1),
    s AS (SELECT careunit, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS share FROM one GROUP BY careunit)
    SELECT subject_id, hadm_id, intime, outtime, CASE WHEN share >= 0.02 THEN careunit ELSE 'Others' END AS careunit, (eventtype = 'transfer')::INT AS transfer FROM one JOIN s USING (careunit)""",
)
def transfer_features(t: Tables):
    """Moves of the cohort, one per time span, with a column per unit and a transfer flag."""
    e = events(t)
    rows = e.select(
        "subject_id", "hadm_id", F.when(F.col("seq_num") % 2 == 0, "transfer").otherwise("admit").alias("eventtype"),
        F.concat(F.lit("unit "), (F.col("itemid") % 60 % 37).cast("string")).alias("careunit"), F.col("starttime").alias("intime"), F.col("endtime").alias("outtime"),
    )
    wide = features.transfers(rows, _build(t), 0.02)
    return wide.select("subject_id", "hadm_id", "intime", "outtime", _set_flags(wide, "careunit_").alias("careunit"), "transfer")


_LABELS = """CASE p_type WHEN 'ECONOMY' THEN 'Vent mode' WHEN 'LARGE' THEN 'Glasgow coma scale(eye)' WHEN 'PROMO' THEN 'Others' ELSE lower(p_type) END"""
_POINTS = f"""{_COHORT}, pts AS (SELECT DISTINCT e.subject_id, e.hadm_id, e.stay_id, charttime, {_LABELS} AS label, CASE WHEN seq_num = 3 THEN '-' ELSE 'mode ' || seq_num END AS value,
      CASE WHEN seq_num = 4 THEN NULL ELSE valuenum END AS valuenum FROM events_ e JOIN items USING (itemid)
      WHERE EXISTS (SELECT 1 FROM cohort c WHERE c.subject_id = e.subject_id AND c.hadm_id = e.hadm_id AND c.stay_id = e.stay_id))"""


def _points(t: Tables) -> DataFrame:
    e = events(t).join(items(t).select("itemid", F.col("p_type").alias("label")), "itemid")
    value = F.when(F.col("seq_num") == 3, "-").otherwise(F.concat(F.lit("mode "), F.col("seq_num").cast("string")))
    return e.select(*KEYS, "charttime", "label", value.alias("value"), F.when(F.col("seq_num") != 4, F.col("valuenum")).alias("valuenum"))


def _label_map(t: Tables) -> DataFrame:
    special = {"ECONOMY": "Vent mode", "LARGE": "Glasgow coma scale(eye)", "PROMO": "Others"}
    canonical = F.lower("p_type")
    for raw, name in special.items():
        canonical = F.when(F.col("p_type") == raw, name).otherwise(canonical)
    return t.part.select(F.col("p_type").alias("raw"), canonical.alias("canonical")).distinct()


@query(
    "chart_features",
    f"""{_POINTS}, v AS (SELECT *, CASE WHEN label = 'Vent mode' THEN value ELSE CAST(valuenum AS VARCHAR) END AS v FROM pts WHERE label <> 'Others')
    SELECT stay_id, charttime, label, CASE WHEN label = 'Vent mode' THEN v END AS mode, CASE WHEN label <> 'Vent mode' THEN valuenum END AS number FROM v
    WHERE v IS NOT NULL AND v <> '-' AND (label <> 'Glasgow coma scale(eye)' OR (valuenum BETWEEN 1 AND 4 AND valuenum = floor(valuenum)))""",
)
def chart_features(t: Tables):
    """Readings of the cohort: numbers, text for the ventilator mode, scores only in their range."""
    out = features.chart_events(_points(t), _build(t), _label_map(t))
    vent = F.col("label") == "Vent mode"
    return out.select("stay_id", "charttime", "label", F.when(vent, F.col("value")).alias("mode"), F.when(~vent, F.col("value").try_cast("double")).alias("number"))


@query(
    "all_event_features",
    f"""{_POINTS}, lab AS (SELECT subject_id, hadm_id, stay_id, charttime, label, valuenum AS v FROM pts WHERE label <> 'Others' AND valuenum IS NOT NULL)
    SELECT DISTINCT stay_id, charttime, label, v AS number FROM lab""",
)
def all_event_features(t: Tables):
    """The union of the lab stream with itself: each event once."""
    labs = features.lab_events(_points(t), _build(t), _label_map(t))
    both = features.all_events([labs, labs])
    return both.select("stay_id", "charttime", "label", F.col("value").cast("double").alias("number"))


@query(
    "procedure_features",
    f"""{_COHORT} SELECT DISTINCT e.stay_id, starttime, endtime, lower(p_type) AS label, patientweight FROM events_ e JOIN items USING (itemid)
    WHERE p_type NOT IN ('PROMO', 'ECONOMY', 'LARGE') AND EXISTS (SELECT 1 FROM cohort c WHERE c.subject_id = e.subject_id AND c.hadm_id = e.hadm_id AND c.stay_id = e.stay_id)""",
)
def procedure_features(t: Tables):
    e = events(t).join(items(t).select("itemid", F.col("p_type").alias("label")), "itemid")
    own = features.procedure_events(e.select(*KEYS, "starttime", "endtime", "label", "patientweight"), _build(t), _label_map(t))
    return own.filter("label NOT IN ('Vent mode', 'Glasgow coma scale(eye)')").select("stay_id", "starttime", "endtime", "label", "patientweight")


@query("cohort_keys", f"{_COHORT} SELECT DISTINCT subject_id, hadm_id, stay_id FROM cohort")
def cohort_keys(t: Tables):
    return cohort.key_frame(_build(t))


@query(
    "text_rules",
    """SELECT o_orderkey, lower(trim(' ' || o_orderpriority || ' ')) AS low, CASE WHEN o_custkey % 5 = 0 THEN 'Unknown' ELSE o_orderpriority END AS named,
    (o_orderpriority = '1-URGENT' AND o_orderpriority IS NOT NULL)::INT AS urgent,
    CASE WHEN o_custkey % 100 < 1 THEN '***' WHEN o_custkey % 100 < 2 THEN '**' WHEN o_custkey % 100 < 5 THEN '*' ELSE '' END AS stars FROM orders""",
)
def text_rules(t: Tables):
    gaps = F.when(F.col("o_custkey") % 10 == 0, "nan").when(F.col("o_custkey") % 10 != 5, F.col("o_orderpriority"))
    p = F.when(F.col("o_custkey") % 100 < 1, 0.0005).when(F.col("o_custkey") % 100 < 2, 0.005).when(F.col("o_custkey") % 100 < 5, 0.02)
    return t.orders.select(
        "o_orderkey",
        text.lower_trim(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("low"),
        text.unknown_if_nan(gaps).alias("named"),
        text.text_flag("o_orderpriority", "1-URGENT").alias("urgent"),
        text.significance_stars(p).alias("stars"),
    )


@query(
    "typed_table",
    """SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice, 2) AS DOUBLE) AS price, CASE WHEN l_linenumber = 1 THEN 'nan' ELSE l_returnflag END AS flag,
    CAST(l_quantity > 25 AS INT) AS bulk FROM lineitem""",
)
def typed_table(t: Tables):
    """Types applied and stored types given back, with two decimals."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("string").alias("price"), F.when(F.col("l_linenumber") != 1, F.col("l_returnflag")).alias("flag"), (F.col("l_quantity") > 25).alias("bulk"))
    cast = flags.cast_by_type(li, {"price": "Numerical", "flag": "Categorical", "bulk": "Binary", "absent": "Binary"})
    return flags.restore_dtypes(cast, {"price": "double"})


@query(
    "masked_values",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS l_quantity, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS l_tax,
    greatest((l_linenumber % 3 <> 0)::INT, (l_linenumber % 2 = 0)::INT) AS any_mask FROM lineitem""",
)
def masked_values(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", (F.col("l_linenumber") % 3 != 0).cast("int").alias("l_quantity_mask"), (F.col("l_linenumber") % 2 == 0).cast("int").alias("l_tax_mask"))
    return flags.apply_masks(li.withColumn("any_mask", flags.family_mask(["l_quantity_mask", "l_tax_mask"])), ["l_quantity", "l_tax"])


@query(
    "fold_with_missing",
    """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS VARCHAR) END AS v FROM part),
    s AS (SELECT v, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS share FROM x WHERE v IS NOT NULL GROUP BY v)
    SELECT p_partkey, CASE WHEN share >= 0.02 THEN x.v ELSE 'Others' END AS v FROM x LEFT JOIN s ON x.v = s.v""",
)
def fold_with_missing(t: Tables):
    """Missing values are folded too."""
    p = t.part.select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("string")).alias("v"))
    return rollup.fold_rare_many(p, {"v": "Others"}, 0.02, fold_null=True)


@query("types_with_missing", "SELECT * FROM (VALUES ('l_linenumber', 'Categorical'), ('half', 'Numerical'), ('flag', 'Binary'), ('l_quantity', 'Numerical'), ('l_returnflag', 'Categorical')) t(feature, feature_type)")
def types_with_missing(t: Tables):
    """A missing value breaks the whole-number and flag tests."""
    li = t.lineitem.select("l_linenumber", F.when(F.col("l_linenumber") > 1, 1).alias("half"), (F.col("l_tax") > 0.05).cast("int").alias("flag"), "l_quantity", "l_returnflag")
    return rollup.type_table(li, threshold=7, nulls_count=True)


@query("constant_columns", "SELECT 'one' AS feature UNION ALL SELECT 'gap'")
def constant_columns(t: Tables):
    """Columns of the table with one distinct value, missing ones aside."""
    li = t.lineitem.select("l_tax", F.lit(1).alias("one"), F.when(F.col("l_linenumber") == 2, "x").alias("gap"))
    chosen = filters.select_features(li, include=["one", "gap", "l_tax"])
    return t.spark.createDataFrame([(c,) for c in filters.constant_columns(chosen)], "feature string")


@query(
    "unit_lookup",
    "SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS standard_unit FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey",
)
def unit_lookup(t: Tables):
    units = t.part.filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("standard_unit"))
    return joins.unit_lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), units, "l_partkey")


_PAIRS = """WITH x AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber::DOUBLE AS l_linenumber FROM lineitem),
  p AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM x"
    for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])
    for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"][i + 1 :]
) + ")"


@query("weakest_pairs", f"{_PAIRS} SELECT a, b, round(abs(r), 7) AS strength FROM p ORDER BY abs(r), a, b LIMIT 4")
def weakest_pairs(t: Tables):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    x = t.lineitem.withColumn("l_linenumber", F.col("l_linenumber").cast("double"))
    return fidelity.top_pairs(fidelity.pearson_pairs(x, names), 4, False).select("a", "b", rnd("strength", 7).alias("strength"))


@query(
    "ordered_results",
    "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders ORDER BY 2 LIMIT 20",
)
def ordered_results(t: Tables):
    """The first rows of a report in the stated order of its levels."""
    top = fidelity.ordered_results(t.orders.withColumn("rank", F.lit("x")), {"o_orderstatus": ["P", "O"]})
    first = top.select("o_orderkey", "o_orderstatus").orderBy(F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2), "o_orderkey").limit(20)
    rows = [(r["o_orderkey"], i) for i, r in enumerate(first.collect(), 1)]  # a report of 20 rows
    return t.spark.createDataFrame(rows, "o_orderkey bigint, place bigint")


@query(
    "flat_sequences",
    """WITH s AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS step, o_totalprice FROM orders),
    g AS (SELECT o_custkey, unnest(range(0, 3)) AS step FROM (SELECT DISTINCT o_custkey FROM orders))
    SELECT o_custkey, string_agg(CAST(round(coalesce(o_totalprice, -1)) AS BIGINT), ',' ORDER BY step) AS cells FROM g LEFT JOIN s USING (o_custkey, step) GROUP BY o_custkey""",
)
def flat_sequences(t: Tables):
    """The first three steps of each sequence as one flat vector, padded."""
    s = grid.clip_pad(t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3)
    flat = grid.flatten_sequences(s, ["o_custkey"], "step", ["o_totalprice"])
    return flat.select("o_custkey", F.array_join(F.transform("vector", lambda x: F.round(x).cast("bigint").cast("string")), ",").alias("cells"))


@query("encoder_layout", "SELECT * FROM (VALUES ('l_quantity', 'Numerical', 1, 0), ('l_returnflag', 'Categorical', 2, 1), ('l_linestatus', 'Binary', 1, 3)) t(feature, family, width, place)")
def encoder_layout(t: Tables):
    encoder = encode.Encoder.fit(t.lineitem, {"l_quantity": "Numerical", "l_returnflag": "Categorical", "l_linestatus": "Binary"})
    return encoder.layout(t.spark).select(F.col("column").alias("feature"), "family", "width", F.col("offset").alias("place"))


@query(
    "model_ready",
    """WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), s AS (SELECT l_orderkey, l_quantity, l_returnflag,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS step FROM lineitem)
    SELECT o_orderkey, (o_orderstatus = 'O')::INT AS condition, round(sum((l_quantity - lo) / (hi - lo)), 6) AS quantities, count(*) AS steps,
      count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned FROM orders JOIN s ON l_orderkey = o_orderkey, b WHERE step < 3 GROUP BY ALL""",
)
def model_ready(t: Tables):
    """One row per order: encoded static vector, sequence of encoded lines, condition; folded to sums for the comparison."""
    static = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority")
    lines = grid.clip_pad(t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag"), ["k"], ["l_linenumber", "l_partkey", "l_extendedprice"], 3, False)
    a = encode.Encoder.fit(static, {"o_orderpriority": "Categorical"})
    b = encode.Encoder.fit(t.lineitem, {"l_quantity": "Numerical", "l_returnflag": "Categorical"})
    out = encode.model_ready(static, lines, ["k"], a, b, 3, condition=(F.col("o_orderstatus") == "O").cast("int"))
    total = F.aggregate("sequence", F.lit(0.0), lambda x, row: x + F.element_at(row, 1))
    back = F.aggregate("sequence", F.lit(0.0), lambda x, row: x + F.element_at(row, 3))
    return out.select(F.col("k").alias("o_orderkey"), "condition", rnd(total).alias("quantities"), F.size("sequence").cast("bigint").alias("steps"), back.cast("bigint").alias("returned"))


@query(
    "starred_results",
    """SELECT 'y' AS target, l_returnflag AS model, l_linestatus AS metric, CAST(count(*) AS VARCHAR) AS "0.0",
    CAST(count(*) + 1 AS VARCHAR) || CASE WHEN count(*) % 3 = 0 THEN ' ***' WHEN count(*) % 3 = 1 THEN ' *' ELSE '' END AS "0.5" FROM lineitem GROUP BY ALL""",
)
def starred_results(t: Tables):
    """Scores with the stars of their tests."""
    n = t.lineitem.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    table = n.select(F.lit("y").alias("target"), "model", "metric", F.col("n").cast("string").alias("0.0"), (F.col("n") + 1).cast("string").alias("0.5"))
    p = F.when(F.col("n") % 3 == 0, 0.0001).when(F.col("n") % 3 == 1, 0.04).otherwise(0.5)
    return utility.result_table(table, n.select("model", "metric", F.lit("0.5").alias("setting"), p.alias("p_value")), ["0.0", "0.5"])


@query(
    "compared_distributions",
    """SELECT source, l_linenumber AS level, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 8) AS share
    FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'real' ELSE 'synthetic' END AS source, l_linenumber FROM lineitem) GROUP BY source, l_linenumber""",
)
def compared_distributions(t: Tables):
    """The comparison of one column, which the types of the real table choose."""
    own = t.lineitem.select(F.when(F.col("l_linenumber") < 5, F.col("l_linenumber")).otherwise(F.col("l_linenumber")).alias("l_linenumber"), "l_linestatus", F.col("l_linenumber").cast("string").alias("level"))
    real, synthetic = own.filter("l_linestatus = 'O'").select("level"), own.filter("l_linestatus <> 'O'").select("level")
    share = fidelity.compare_distributions(real, synthetic, ["level"])["share:level"]
    return share.select("source", F.col("level").cast("int").alias("level"), rnd("share", 8).alias("share"))


@query(
    "task_table",
    """WITH s AS (SELECT o_custkey, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS step FROM orders),
    x AS (SELECT * FROM s WHERE step < 3), c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM x GROUP BY ALL),
    m AS (SELECT o_custkey, arg_min(o_orderstatus, (-n, o_orderstatus)) AS o_orderstatus FROM c GROUP BY o_custkey)
    SELECT x.o_custkey AS stay, round(avg(o_totalprice), 4) AS o_totalprice, m.o_orderstatus, (c_acctbal < 0)::INT AS target
    FROM x JOIN m ON m.o_custkey = x.o_custkey JOIN customer ON c_custkey = x.o_custkey GROUP BY ALL""",
)
def task_table(t: Tables):
    """The first three steps of each sequence as one row, with the target of its static row."""
    s = hour_index(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "step").withColumnRenamed("o_custkey", "stay")
    static = t.customer.select(F.col("c_custkey").alias("stay"), (F.col("c_acctbal") < 0).cast("int").alias("target"))
    out = reports.task_table(s, static, "stay", ["o_totalprice"], ["o_orderstatus"], "target", hours=3)
    return out.withColumn("o_totalprice", rnd("o_totalprice", 4))
