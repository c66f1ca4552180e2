"""The checker's tables in clinical roles, as frames and as the same SQL.

customer: patients.  orders: stays (and admissions, one per patient and year).  lineitem with part: events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.catalog.registry import Tables

KEYS = ["subject_id", "hadm_id", "stay_id"]


def patients(t: Tables) -> DataFrame:
    age = (F.floor(F.abs("c_acctbal")).cast("bigint") % 110).cast("string")
    unit = F.when(F.col("c_custkey") % 10 == 0, " months").when(F.col("c_custkey") % 10 == 1, " days").otherwise(" years")
    return t.customer.select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("sex"), F.concat(age, unit).alias("anchor_age"))


PATIENTS = """patients AS (
  SELECT c_custkey AS subject_id, c_mktsegment AS sex,
         CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 110 AS VARCHAR)
         || CASE c_custkey % 10 WHEN 0 THEN ' months' WHEN 1 THEN ' days' ELSE ' years' END AS anchor_age
  FROM customer)"""


def stays(t: Tables) -> DataFrame:
    hours = (F.floor("o_totalprice").cast("bigint") % 300).cast("int")
    return t.orders.select(
        F.col("o_custkey").alias("subject_id"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.year("o_orderdate").cast("string")).alias("hadm_id"),
        F.col("o_orderkey").cast("string").alias("stay_id"),
        F.col("o_orderdate").alias("intime"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hours)).alias("outtime"),
        (hours.cast("double") / 24.0).alias("los"),
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
    )


STAYS = """stays AS (
  SELECT o_custkey AS subject_id, CAST(o_custkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS hadm_id,
         CAST(o_orderkey AS VARCHAR) AS stay_id, o_orderdate AS intime,
         o_orderdate + to_hours(CAST(floor(o_totalprice) AS BIGINT) % 300) AS outtime,
         CAST(CAST(floor(o_totalprice) AS BIGINT) % 300 AS DOUBLE) / 24.0::DOUBLE AS los,
         o_orderkey, o_orderstatus, o_orderpriority
  FROM orders)"""


def admissions(t: Tables) -> DataFrame:
    s = stays(t)
    return s.groupBy("subject_id", "hadm_id").agg(
        F.min("o_orderpriority").alias("admission_type"),
        F.min("intime").alias("admittime"),
        F.max("outtime").alias("dischtime"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("outtime"))).alias("dod"),
        F.max((F.col("o_orderstatus") == "F").cast("int")).alias("hospital_expire_flag"),
    )


ADMISSIONS = """admissions AS (
  SELECT subject_id, hadm_id, min(o_orderpriority) AS admission_type, min(intime) AS admittime,
         max(outtime) AS dischtime, max(CASE WHEN o_orderstatus = 'F' THEN outtime END) AS dod,
         max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS hospital_expire_flag
  FROM stays GROUP BY ALL)"""


def events(t: Tables) -> DataFrame:
    """Point and interval events of stays: itemid from part, times from keys."""
    li, o = t.lineitem, stays(t).select("subject_id", "hadm_id", "stay_id", "o_orderkey", "intime")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.col("intime") + F.make_dt_interval(F.lit(0), (F.col("l_partkey") % 240 - 5).cast("int"), (F.col("l_suppkey") % 60).cast("int"))
    end_h = (F.col("l_partkey") % 240 - 6 + F.floor(F.col("l_quantity") / 8).cast("bigint")).cast("int")
    end = F.col("intime") + F.make_dt_interval(F.lit(0), end_h, (F.col("l_suppkey") % 60).cast("int"))
    return j.select(
        "subject_id",
        "hadm_id",
        "stay_id",
        start.alias("charttime"),
        start.alias("starttime"),
        end.alias("endtime"),
        F.col("l_partkey").alias("itemid"),
        F.col("l_linenumber").alias("seq_num"),
        F.col("l_quantity").alias("valuenum"),
        F.col("l_extendedprice").alias("amount"),
        (F.col("l_suppkey") % 50 + 50).cast("double").alias("patientweight"),
        F.col("l_suppkey"),
    )


EVENTS = """events_ AS (
  SELECT subject_id, hadm_id, stay_id,
         intime + to_hours(l_partkey % 240 - 5) + to_minutes(l_suppkey % 60) AS charttime,
         intime + to_hours(l_partkey % 240 - 5) + to_minutes(l_suppkey % 60) AS starttime,
         intime + to_hours(l_partkey % 240 - 6 + CAST(floor(l_quantity / 8) AS BIGINT)) + to_minutes(l_suppkey % 60) AS endtime,
         l_partkey AS itemid, l_linenumber AS seq_num, l_quantity AS valuenum, l_extendedprice AS amount,
         CAST(l_suppkey % 50 + 50 AS DOUBLE) AS patientweight, l_suppkey
  FROM lineitem JOIN stays ON l_orderkey = o_orderkey)"""


def items(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("itemid"), F.concat_ws(" ", "p_type", "p_brand").alias("label"), "p_type", "p_brand")


ITEMS = "items AS (SELECT p_partkey AS itemid, p_type || ' ' || p_brand AS label, p_type, p_brand FROM part)"

CLINICAL = f"WITH {PATIENTS}, {STAYS}, {ADMISSIONS}, {EVENTS}, {ITEMS}"

# truncated whole hours between two timestamps
HOURS = "CAST(trunc((epoch_us({a}) - epoch_us({b})) / 3600000000.0::DOUBLE) AS BIGINT)"


def hours_sql(later: str, earlier: str) -> str:
    return HOURS.format(a=later, b=earlier)
