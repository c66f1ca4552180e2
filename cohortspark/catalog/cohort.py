"""Cohort, code and category queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.catalog.registry import NUDGE_SQL, Tables, query, rnd, snap
from cohortspark.catalog.roles import CLINICAL, KEYS, admissions, events, items, patients, stays
from cohortspark.functions import flags, text, times, units
from cohortspark.functions.columns import compute_once
from cohortspark.operators import filters, joins, rollup
from cohortspark.plans import cohort as plan

_AGE = """CASE WHEN anchor_age LIKE '%days' THEN CAST(regexp_extract(anchor_age, '(\\d+)', 1) AS DOUBLE) / 365.25::DOUBLE
       WHEN anchor_age LIKE '%months' THEN CAST(regexp_extract(anchor_age, '(\\d+)', 1) AS DOUBLE) / 12
       ELSE CAST(regexp_extract(anchor_age, '(\\d+)', 1) AS DOUBLE) END"""

_COHORT = f"""{CLINICAL}, joined AS (
  SELECT p.subject_id, a.hadm_id, s.stay_id, p.sex, a.admission_type, s.los, s.intime, s.outtime,
         CAST(regexp_extract(anchor_age, '(\\d+)', 1) AS INT) AS age, {_AGE} AS years, a.hospital_expire_flag, s.o_orderkey
  FROM patients p JOIN admissions a ON p.subject_id = a.subject_id
  JOIN stays s ON s.subject_id = a.subject_id AND s.hadm_id = a.hadm_id),
aged AS (SELECT * FROM joined WHERE years BETWEEN 15 AND 100),
cohort AS (SELECT * FROM aged WHERE los >= 0.5 AND los < 10)"""


def _build(t: Tables):
    s = stays(t).drop("o_orderstatus", "o_orderpriority")
    return plan.build(patients(t), admissions(t), s)


@query(
    "cohort_build",
    f"{_COHORT} SELECT subject_id, hadm_id, stay_id, sex, admission_type, age, round(years, 6) AS years, round(los, 6) AS los FROM cohort",
)
def cohort_build(t: Tables):
    c = _build(t)
    return c.select(*KEYS, "sex", "admission_type", "age", rnd("anchor_age").alias("years"), rnd("los").alias("los"))


def _step(name: str, position: int, step: str) -> str:
    return (
        f"SELECT {position} AS position, '{step}' AS step, count(DISTINCT subject_id) AS subjects, "
        f"count(DISTINCT hadm_id) AS admissions, count(DISTINCT stay_id) AS stays, count(*) AS rows FROM {name}"
    )


@query(
    "cohort_attrition",
    f"{_COHORT} {_step('joined', 0, 'start')} UNION ALL {_step('aged', 1, 'age')} UNION ALL "
    f"{_step('cohort', 2, 'length of stay')} UNION ALL {_step('cohort', 3, 'one row per stay')}",
)
def cohort_attrition(t: Tables):
    return plan.attrition(patients(t), admissions(t), stays(t))


_DIMENSIONS = {"l_returnflag": "Categorical", "l_linestatus": "Binary", "l_quantity": "Numerical", "l_linenumber": "Listwise", "l_shipdate": "Other", "l_tax": "Categorical"}


@query(
    "output_dimensions",
    """SELECT 'l_returnflag' AS feature, count(DISTINCT l_returnflag) AS width FROM lineitem UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem
    UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem UNION ALL SELECT 'l_quantity', 1 UNION ALL SELECT 'l_shipdate', 1 UNION ALL SELECT 'l_linen', 1""",
)
def output_dimensions(t: Tables):
    return rollup.dimension_table(t.lineitem, _DIMENSIONS, ["l_linen"])


@query("length_summary", f"{_COHORT} SELECT round(min(los), 6) AS los_min, round(avg(los), 6) AS los_mean, round(max(los), 6) AS los_max FROM cohort")
def length_summary(t: Tables):
    return rollup.length_summary(_build(t)).select(*[rnd(c).alias(c) for c in ("los_min", "los_mean", "los_max")])


@query("first_stay_per_patient", f"{CLINICAL} SELECT subject_id, stay_id FROM stays QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY intime, stay_id) = 1")
def first_stay_per_patient(t: Tables):
    return joins.first_stay(stays(t), "subject_id").select("subject_id", "stay_id")


@query(
    "same_unit_stays",
    f"{CLINICAL} SELECT stay_id, 'U' || CAST(o_orderkey % 3 AS VARCHAR) AS unit FROM stays WHERE o_orderkey % 3 = subject_id % 3",
)
def same_unit_stays(t: Tables):
    unit = lambda c: F.concat(F.lit("U"), (F.col(c) % 3).cast("string"))
    s = stays(t).withColumns({"first_careunit": unit("o_orderkey"), "last_careunit": unit("subject_id")})
    return filters.same_first_last_unit(s).select("stay_id", F.col("first_careunit").alias("unit"))


@query(
    "hospital_mortality",
    f"""{CLINICAL} SELECT hadm_id, CASE WHEN dod IS NOT NULL AND admittime <= dod AND dod <= dischtime THEN 1 ELSE 0 END AS mortality_inhospital
    FROM admissions""",
)
def hospital_mortality(t: Tables):
    dead, alive = filters.split_by_mortality(admissions(t))
    return dead.unionByName(alive).select("hadm_id", "mortality_inhospital")


@query("age_parse", f"{CLINICAL} SELECT subject_id, round({_AGE}, 6) AS years FROM patients")
def age_parse(t: Tables):
    return patients(t).select("subject_id", rnd(text.age_in_years("anchor_age")).alias("years"))


@query(
    "events_on_cohort",
    f"""{_COHORT} SELECT p_type AS label, count(*) AS n, round(sum(valuenum), 4) AS total
    FROM events_ e JOIN items i USING (itemid)
    WHERE EXISTS (SELECT 1 FROM cohort c WHERE c.subject_id = e.subject_id AND c.hadm_id = e.hadm_id AND c.stay_id = e.stay_id)
      AND p_type <> 'PROMO' GROUP BY p_type""",
)
def events_on_cohort(t: Tables):
    own = joins.restrict_to_cohort(events(t), _build(t), KEYS)
    decoded = joins.decode_items(own, items(t).select("itemid", "label"))
    mapping = items(t).select(F.col("label").alias("raw"), F.when(F.col("p_type") == "PROMO", "Others").otherwise(F.col("p_type")).alias("canonical")).distinct()
    return joins.canonical_labels(decoded, mapping).groupBy("label").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("valuenum"), 4).alias("total"))


@query(
    "header_detail_join",
    f"""{CLINICAL} SELECT e.stay_id, e.seq_num, e.itemid, d.p_size AS note FROM events_ e
    LEFT JOIN (SELECT p_partkey, p_size FROM part WHERE p_size > 25) d ON e.itemid = d.p_partkey""",
)
def header_detail_join(t: Tables):
    detail = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("itemid"), F.col("p_size").alias("note"))
    return joins.header_detail(events(t), detail, ["itemid"]).select("stay_id", "seq_num", "itemid", "note")


@query(
    "subject_weight",
    f"""{CLINICAL}, w AS (SELECT subject_id, patientweight FROM events_ UNION ALL SELECT subject_id, amount / 1000 FROM events_ WHERE seq_num = 1),
    m AS (SELECT subject_id, avg(patientweight) AS patientweight FROM w GROUP BY subject_id)
    SELECT p.subject_id, round(m.patientweight + {NUDGE_SQL}, 6) AS patientweight FROM patients p LEFT JOIN m ON p.subject_id = m.subject_id""",
)
def subject_weight(t: Tables):
    e = events(t)
    second = e.filter("seq_num = 1").select("subject_id", (F.col("amount") / 1000).alias("patientweight"))
    out = joins.subject_weight(patients(t), [e.select("subject_id", "patientweight"), second])
    return out.select("subject_id", snap("patientweight").alias("patientweight"))


def _codes(t: Tables):
    e = events(t).join(items(t).select("itemid", "p_brand"), "itemid")
    return e.select(*KEYS, "seq_num", F.col("p_brand").alias("icd_code"), F.when(F.col("seq_num") % 2 == 1, 9).otherwise(10).alias("icd_version"))


def _code_map(t: Tables):
    return t.part.filter("p_size <= 40 AND p_brand < 'Brand#7'").select(
        F.col("p_brand").alias("icd_9"), F.concat_ws("-", F.lit("X"), "p_brand", "p_type").alias("icd_10")
    ).distinct()


_CODES = f"""{CLINICAL}, codes AS (SELECT subject_id, hadm_id, stay_id, seq_num, p_brand AS icd_code, CASE WHEN seq_num % 2 = 1 THEN 9 ELSE 10 END AS icd_version
  FROM events_ JOIN items USING (itemid)),
m AS (SELECT p_brand AS icd_9, min('X-' || p_brand || '-' || p_type) AS icd_10 FROM part WHERE p_size <= 40 AND p_brand < 'Brand#7' GROUP BY p_brand)"""


@query(
    "code_translate",
    f"""{_CODES} SELECT icd_code, count(*) AS n FROM (SELECT CASE WHEN icd_version = 9 THEN icd_10 ELSE icd_code END AS icd_code
    FROM codes LEFT JOIN m ON icd_version = 9 AND icd_code = icd_9) WHERE icd_code IS NOT NULL GROUP BY icd_code""",
)
def code_translate(t: Tables):
    return joins.translate_codes(_codes(t), _code_map(t)).groupBy("icd_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "translation_rate",
    f"""{_CODES} SELECT icd_version, count(icd_code) AS codes, count(CASE WHEN icd_version = 9 THEN icd_10 ELSE icd_code END) AS translated,
    round(count(CASE WHEN icd_version = 9 THEN icd_10 ELSE icd_code END) * 100.0::DOUBLE / count(icd_code), 6) AS percent
    FROM codes LEFT JOIN m ON icd_version = 9 AND icd_code = icd_9 GROUP BY icd_version""",
)
def translation_rate(t: Tables):
    return joins.translation_rate(_codes(t), _code_map(t)).withColumn("percent", rnd("percent"))


@query(
    "codes_on_cohort",
    f"""{_COHORT}, codes AS (SELECT e.subject_id, e.hadm_id, e.seq_num, p_brand AS icd_code FROM events_ e JOIN items USING (itemid)
      WHERE EXISTS (SELECT 1 FROM cohort c WHERE c.subject_id = e.subject_id AND c.hadm_id = e.hadm_id))
    SELECT subject_id, hadm_id, seq_num, min(icd_code) AS icd_code FROM codes GROUP BY ALL""",
)
def codes_on_cohort(t: Tables):
    return joins.restrict_and_dedupe(_codes(t).drop("stay_id", "icd_version"), _build(t), KEYS, ["seq_num"], ["icd_code"])


@query(
    "code_pivot",
    f"""{_CODES} SELECT subject_id, hadm_id, """
    + ", ".join(f"max(CASE WHEN icd_code = 'Brand#{i}' THEN 1 ELSE 0 END) AS \"icd_Brand#{i}\"" for i in range(1, 26))
    + " FROM codes GROUP BY subject_id, hadm_id",
)
def code_pivot(t: Tables):
    return rollup.code_flags(_codes(t), ["subject_id", "hadm_id"], "icd_code", "icd_", [f"Brand#{i}" for i in range(1, 26)])


_ICD = [str(k) for k in range(1, 26)]  # all codes


@query(
    "cohort_with_diagnoses",
    f"""{_COHORT}, one AS (SELECT * FROM cohort QUALIFY row_number() OVER (PARTITION BY subject_id, hadm_id ORDER BY stay_id) = 1),
    d AS (SELECT subject_id, hadm_id, {', '.join(f"max(CASE WHEN p_brand = 'Brand#{k}' THEN 1 ELSE 0 END) AS icd_{k}" for k in _ICD)} FROM events_ JOIN items USING (itemid) GROUP BY ALL)
    SELECT one.subject_id, one.hadm_id, one.stay_id, one.sex, {', '.join(f'icd_{k}' for k in _ICD)} FROM one JOIN d USING (subject_id, hadm_id)""",
)
def cohort_with_diagnoses(t: Tables):
    flags_ = rollup.code_flags(_codes(t).withColumn("code", F.regexp_replace("icd_code", "Brand#", "")), ["subject_id", "hadm_id"], "code", "icd_", _ICD)
    return joins.cohort_with_diagnoses(_build(t), flags_, "_id$", "^icd_", ["sex"])


@query(
    "rare_fold",
    """WITH c AS (SELECT p_size, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS share FROM part GROUP BY p_size),
    r AS (SELECT count(*) AS rare FROM c WHERE share < 0.02::DOUBLE)
    SELECT p_partkey, CASE WHEN (SELECT rare FROM r) <= 1 OR share >= 0.02::DOUBLE THEN CAST(p_size AS VARCHAR) ELSE 'Others' END AS size_class
    FROM part JOIN c USING (p_size)""",
)
def rare_fold(t: Tables):
    p = t.part.withColumn("size_class", F.col("p_size").cast("string"))
    return rollup.fold_rare(p, "size_class", 0.02).select("p_partkey", "size_class")


@query(
    "share_cutoff",
    """WITH c AS (SELECT p_size FROM part GROUP BY p_size HAVING round_even(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM part), 2) >= 0.02::DOUBLE)
    SELECT p_partkey, p_size FROM part WHERE p_size IN (SELECT p_size FROM c)""",
)
def share_cutoff(t: Tables):
    return rollup.share_cutoff(t.part, "p_size", 0.02).select("p_partkey", "p_size")


@query(
    "grouped_share_cutoff",
    """WITH n AS (SELECT p_type = 'PROMO' AS g, p_brand, count(*) AS n FROM part GROUP BY ALL),
    c AS (SELECT g, p_brand FROM n QUALIFY round_even(n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY g), 2) >= 0.04::DOUBLE)
    SELECT p_partkey, p_type, part.p_brand FROM part JOIN c ON c.g = (p_type = 'PROMO') AND c.p_brand = part.p_brand""",
)
def grouped_share_cutoff(t: Tables):
    out = rollup.share_cutoff(t.part, "p_brand", 0.04, F.col("p_type") == "PROMO")
    return out.select("p_partkey", "p_type", "p_brand")


@query(
    "ratio_cutoff",
    """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN
    (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(*) * 1.0::DOUBLE / (SELECT count(*) FROM lineitem) >= 0.01::DOUBLE)""",
)
def ratio_cutoff(t: Tables):
    return rollup.ratio_cutoff(t.lineitem, "l_suppkey", 0.01).select("l_orderkey", "l_linenumber", "l_suppkey")


@query(
    "topk_categories",
    """WITH top AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5)
    SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'Others' END AS brand FROM part""",
)
def topk_categories(t: Tables):
    p = t.part.select("p_partkey", F.col("p_brand").alias("brand"))
    return rollup.keep_top_categories(p, ["brand"], 6)[0]


@query("category_shares", "SELECT p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM part GROUP BY p_type")
def category_shares(t: Tables):
    return rollup.category_shares(t.part, "p_type").select("p_type", "n", rnd("share", 8).alias("share"))


@query(
    "duplicate_check",
    "SELECT CAST(count(*) AS BIGINT) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem",
)
def duplicate_check(t: Tables):
    return rollup.duplicate_count(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "missing_check",
    "SELECT count(*) FILTER (p_size IS NULL OR p_size > 40) AS missing, count(*) AS rows FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
)
def missing_check(t: Tables):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return filters.missing_count(j.withColumn("s", F.when(F.col("p_size") <= 40, F.col("p_size"))), "s")


@query(
    "nway_outer_merge",
    """WITH c AS (SELECT c_nationkey AS nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS balance FROM customer WHERE c_acctbal > 8000 GROUP BY 1),
    s AS (SELECT s_nationkey AS nationkey, count(*) AS n, round(avg(s_acctbal), 6) AS balance FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
    SELECT nationkey, c.n, c.balance, s.n AS n__supplier, s.balance AS balance__supplier, n_name
    FROM c FULL JOIN s USING (nationkey) FULL JOIN (SELECT n_nationkey AS nationkey, n_name FROM nation) USING (nationkey)""",
)
def nway_outer_merge(t: Tables):
    def side(df, key, value, keep):
        return df.filter(keep).groupBy(F.col(key).alias("nationkey")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(value)).alias("balance"))

    c = side(t.customer, "c_nationkey", "c_acctbal", "c_acctbal > 8000")
    s = side(t.supplier, "s_nationkey", "s_acctbal", "s_acctbal > 5000")
    n = t.nation.select(F.col("n_nationkey").alias("nationkey"), "n_name")
    return joins.merge_tables([c, s, n], [["nationkey"]] * 3, ["customer", "supplier", "nation"])


# ---- texts and units ----------------------------------------------------------------------------

_UNITS = ("mcg/kg/min", "mcg/min", "mcg/70kg/min", "mg/hr", "ccc/hr", "unit/hr", "mcg/hr")
_MEDS = ("Norepinephrine", "Remifentanil", "Propofol", "Dexmedetomidine", "Insulin", "Plasma solution A")
_STANDARDS = ("mcg/min", "mcg/kg/min", "mcg/kg/min", "mcg/kg/min", "unit/hr", "cc/hr")


def _pick(key: str, values: tuple[str, ...]):
    out = F.when(F.lit(False), F.lit(""))
    for i, v in enumerate(values):
        out = out.when(F.expr(key) == i, v)
    return out


def _case(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _notes(t: Tables):
    """Free-text rates made from the line items."""
    li = t.lineitem
    lead = F.when(F.col("l_suppkey") % 4 == 0, "rate: ").when(F.col("l_suppkey") % 4 == 1, "now ").otherwise("")
    tail = F.when(F.col("l_suppkey") % 4 == 2, " given").otherwise("")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        _pick("l_partkey % 6", _MEDS).alias("medication"),
        _pick("l_partkey % 6", _STANDARDS).alias("standard_unit"),
        (F.col("l_suppkey") % 40 + 40).cast("double").alias("patientweight"),
        F.concat(lead, (F.col("l_quantity") / 2).cast("string"), F.lit(" "), _pick("(l_partkey + l_suppkey) % 7", _UNITS), tail).alias("note"),
    )


_NOTES = f"""WITH notes AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_case('l_partkey % 6', _MEDS)} AS medication,
  {_case('l_partkey % 6', _STANDARDS)} AS standard_unit, CAST(l_suppkey % 40 + 40 AS DOUBLE) AS patientweight,
  CASE l_suppkey % 4 WHEN 0 THEN 'rate: ' WHEN 1 THEN 'now ' ELSE '' END || CAST(l_quantity / 2 AS VARCHAR) || ' '
  || {_case('(l_partkey + l_suppkey) % 7', _UNITS)} || CASE WHEN l_suppkey % 4 = 2 THEN ' given' ELSE '' END AS note FROM lineitem)"""


def _rate_sql(unit: str) -> str:
    return f"(\\d+(?:\\.\\d+)?)\\s*([a-zA-Z]+(?:/\\d*\\.?\\d*kg|/kg)?{unit})"


_READ = f"""{_NOTES}, read AS (SELECT *, nullif(regexp_extract(note, '{_rate_sql("/min")}', 1), '') AS min_value,
  nullif(regexp_extract(note, '{_rate_sql("/min")}', 2), '') AS min_unit, nullif(regexp_extract(note, '{_rate_sql("/hr")}', 1), '') AS hr_value,
  nullif(regexp_extract(note, '{_rate_sql("/hr")}', 2), '') AS hr_unit FROM notes)"""


def _read(t: Tables):
    return compute_once(
        compute_once(_notes(t), {"note": F.col("note")}),
        {
            "min_value": text.rate_value("note", "/min"),
            "min_unit": text.rate_unit("note", "/min"),
            "hr_value": text.rate_value("note", "/hr"),
            "hr_unit": text.rate_unit("note", "/hr"),
        },
    )


@query("rate_extract", f"{_READ} SELECT l_orderkey, l_linenumber, note, min_value, min_unit, hr_value, hr_unit FROM read")
def rate_extract(t: Tables):
    return _read(t).select("l_orderkey", "l_linenumber", "note", "min_value", "min_unit", "hr_value", "hr_unit")


_CLEAN = """CASE WHEN u IS NULL THEN NULL WHEN contains('c/hr', u) THEN 'cc/hr' WHEN contains('ccc/hr', u) THEN 'cc/hr' WHEN contains('cxc/hr', u) THEN 'cc/hr'
  WHEN contains('units/hr', u) THEN 'unit/hr' WHEN contains('u/hr', u) THEN 'unit/hr' WHEN contains('unti/hr', u) THEN 'unit/hr'
  WHEN contains('ui/hr', u) THEN 'unit/hr' ELSE u END"""


@query("unit_clean", f"{_READ} SELECT unit, count(*) AS n FROM (SELECT {_CLEAN} AS unit FROM (SELECT lower(trim(coalesce(hr_unit, min_unit))) AS u FROM read)) GROUP BY unit")
def unit_clean(t: Tables):
    u = units.clean_unit(F.coalesce("hr_unit", "min_unit"))
    return _read(t).select(u.alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unit_convert",
    f"""{_READ}, merged AS (SELECT l_orderkey, l_linenumber, l_partkey, medication, standard_unit, patientweight AS w,
      CAST(CASE WHEN standard_unit LIKE '%hr%' THEN hr_value ELSE min_value END AS DOUBLE) AS v,
      CASE WHEN standard_unit LIKE '%hr%' THEN (SELECT {_CLEAN} FROM (SELECT lower(trim(hr_unit)) AS u)) ELSE lower(trim(min_unit)) END AS u FROM read),
    conv AS (SELECT *, CASE
      WHEN medication = 'Norepinephrine' THEN CASE WHEN u = 'mcg/min' THEN v WHEN u = 'mcg/kg/min' THEN CASE WHEN v < 1 THEN v * w ELSE v END
        WHEN u = 'mcg/70kg/min' THEN v * 70 END
      WHEN medication = 'Remifentanil' THEN CASE WHEN u = 'mcg/kg/min' THEN CASE WHEN v >= 5 THEN 0.05 ELSE v END
        WHEN u = 'mcg/min' THEN CASE WHEN v < 1 THEN v ELSE v / w END WHEN u = 'mcg/70kg/min' THEN v END
      WHEN medication = 'Propofol' THEN CASE WHEN u IN ('mcg/kg/min', 'mcg/min', 'mcg/70kg/min') THEN v END
      WHEN standard_unit = 'mcg/kg/min' THEN CASE WHEN u = 'mcg/kg/min' THEN v WHEN u = 'mcg/min' THEN v / w WHEN u = 'mcg/hr' THEN v / 60 / w
        WHEN u = 'mg/hr' THEN v * 1000 / 60 / w WHEN u = 'mcg/70kg/min' THEN v END
      WHEN standard_unit = 'unit/hr' THEN CASE WHEN u = 'unit/hr' THEN v END
      WHEN standard_unit = 'cc/hr' THEN CASE WHEN u IN ('cc/hr', 'c/hr', 'ccc/hr') THEN v END END AS rate FROM merged)
    SELECT l_orderkey, l_linenumber, medication, u AS unit, round(CASE WHEN medication = 'Dexmedetomidine' AND rate >= 20 THEN rate / 100
      WHEN medication = 'Dexmedetomidine' AND rate >= 2 THEN rate / 10 ELSE rate END, 8) AS rate FROM conv
    WHERE rate > 0 AND NOT (medication = 'Plasma solution A' AND rate < 0.11) AND NOT (medication = 'Remifentanil' AND rate > 2)""",
)
def unit_convert(t: Tables):
    r = compute_once(_read(t), {"hr_unit": units.clean_unit("hr_unit"), "min_unit": units.clean_unit("min_unit")})
    r = r.withColumns(
        {
            "rate": units.reading_for_standard("standard_unit", "hr_value", "min_value"),
            "unit": units.reading_for_standard("standard_unit", "hr_unit", "min_unit"),
        }
    )
    r = units.convert_rates(r, "rate").filter((F.col("rate") > 0) & units.within_rate_bounds("medication", "rate"))
    return r.select("l_orderkey", "l_linenumber", "medication", "unit", rnd(units.repair_decimal_slip("medication", "rate"), 8).alias("rate"))


@query(
    "race_map",
    """SELECT c_custkey, CASE WHEN contains(r, 'ASIAN') THEN 'ASIAN' WHEN contains(r, 'WHITE') THEN 'WHITE' WHEN contains(r, 'BLACK') THEN 'BLACK'
      WHEN contains(r, 'HISPANIC/LATINO') OR r = 'HISPANIC OR LATINO' THEN 'HISPANIC/LATINO' WHEN r IN ('UNABLE TO OBTAIN', 'UNKNOWN') THEN 'UNKNOWN' ELSE 'OTHER' END AS race
    FROM (SELECT c_custkey, CASE c_nationkey % 6 WHEN 0 THEN 'ASIAN - ' || c_name WHEN 1 THEN c_name || '/WHITE' WHEN 2 THEN 'BLACK/' || c_name
      WHEN 3 THEN 'HISPANIC OR LATINO' WHEN 4 THEN 'UNKNOWN' ELSE c_name END AS r FROM customer)""",
)
def race_map(t: Tables):
    name, key = F.col("c_name"), F.col("c_nationkey") % 6
    raw = (
        F.when(key == 0, F.concat(F.lit("ASIAN - "), name))
        .when(key == 1, F.concat(name, F.lit("/WHITE")))
        .when(key == 2, F.concat(F.lit("BLACK/"), name))
        .when(key == 3, "HISPANIC OR LATINO")
        .when(key == 4, "UNKNOWN")
        .otherwise(name)
    )
    return text.transform_static(t.customer.select("c_custkey", raw.alias("race")))


@query(
    "number_parse",
    """SELECT event_id, TRY_CAST(v AS DOUBLE) AS value FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '-' WHEN 1 THEN CAST(value AS VARCHAR) || 'd'
      ELSE CAST(value AS VARCHAR) END AS v FROM events) WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL""",
)
def number_parse(t: Tables):
    v = F.col("value").cast("string")
    e = t.events.select("event_id", F.when(F.col("event_id") % 4 == 0, "-").when(F.col("event_id") % 4 == 1, F.concat(v, F.lit("d"))).otherwise(v).alias("value"))
    return filters.numeric_only(filters.drop_placeholders(e))


@query(
    "amount_parse",
    """SELECT event_id, coalesce(TRY_CAST(a AS DOUBLE), TRY_CAST(nullif(regexp_extract(a, '(\\d+)\\s*cc', 1), '') AS DOUBLE)) AS amount
    FROM (SELECT event_id, regexp_extract(props, '(\\d+)', 1) || CASE WHEN event_id % 3 = 0 THEN ' cc' WHEN event_id % 3 = 1 THEN ' ml' ELSE '' END AS a FROM events)""",
)
def amount_parse(t: Tables):
    tail = F.when(F.col("event_id") % 3 == 0, " cc").when(F.col("event_id") % 3 == 1, " ml").otherwise("")
    return t.events.select("event_id", text.amount_or_cc(F.concat(F.regexp_extract("props", r"(\d+)", 1), tail)).alias("amount"))


@query(
    "timestamp_parse",
    """SELECT event_id, epoch_us(ts) - (CASE WHEN event_id % 3 = 0 THEN 0 ELSE epoch_us(ts) % 1000000 END) AS micros FROM events""",
)
def timestamp_parse(t: Tables):
    ts = F.col("ts")
    shown = (
        F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    )
    return t.events.select("event_id", times.micros(times.parse_timestamp(shown)).alias("micros"))


@query(
    "measurement_units",
    """SELECT l_orderkey, l_linenumber, label, round(CASE WHEN label = 'weight' AND uom = 'oz' THEN v * (0.45359237::DOUBLE / 16) WHEN label = 'weight' THEN v * 0.45359237::DOUBLE
      WHEN label = 'height' THEN v * 2.54::DOUBLE WHEN uom = 'F' THEN (v - 32) * (5.0::DOUBLE / 9) ELSE v END, 8) AS value
    FROM (SELECT l_orderkey, l_linenumber, l_quantity AS v, CASE l_linenumber % 4 WHEN 0 THEN 'weight' WHEN 1 THEN 'weight' WHEN 2 THEN 'height' ELSE 'temperature' END AS label,
      CASE l_linenumber % 4 WHEN 0 THEN 'oz' WHEN 1 THEN 'lbs' WHEN 2 THEN 'in' ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'F' ELSE 'C' END END AS uom FROM lineitem)""",
)
def measurement_units(t: Tables):
    label = _pick("l_linenumber % 4", ("weight", "weight", "height", "temperature"))
    uom = F.when(F.col("l_linenumber") % 4 == 3, F.when(F.col("l_suppkey") % 2 == 0, "F").otherwise("C")).otherwise(_pick("l_linenumber % 4", ("oz", "lbs", "in")))
    df = t.lineitem.select("l_orderkey", "l_linenumber", label.alias("label"), uom.alias("valueuom"), F.col("l_quantity").alias("value"))
    return units.convert_measurement(df).select("l_orderkey", "l_linenumber", "label", rnd("value", 8).alias("value"))


@query(
    "outcome_groups",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '3' THEN 'ICU mortality' WHEN o_orderstatus = 'F' THEN 'Hospital mortality' ELSE 'Alive' END AS outcome,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '3' THEN 1 WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS condition FROM orders""",
)
def outcome_groups(t: Tables):
    dead = text.text_flag("o_orderstatus", "F")
    icu = dead * (F.col("o_orderpriority") < "3").cast("int")
    return t.orders.select("o_orderkey", flags.outcome_group(icu, dead).alias("outcome"), flags.condition_class(icu, dead).alias("condition"))


@query(
    "key_cleaning",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END AS stay_id FROM lineitem",
)
def key_cleaning(t: Tables):
    raw = F.when(F.col("l_linenumber") % 5 == 0, "nan").otherwise(F.concat(F.col("l_orderkey").cast("string"), F.lit(".0")))
    return t.lineitem.select("l_orderkey", "l_linenumber", text.clean_key(raw).alias("stay_id"))

