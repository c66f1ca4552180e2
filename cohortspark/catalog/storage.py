"""Sources and sinks: tables are written in the shared folder and read again, in every format and layout."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.catalog.registry import Tables, query, rnd
from cohortspark.catalog.roles import CLINICAL, events, items, stays
from cohortspark.operators import encode
from cohortspark.session import ensure_checkpoint_dir
from cohortspark.sources import readers, writers

_KINDS = {"l_quantity": "Numerical", "l_returnflag": "Categorical", "l_linestatus": "Binary"}


def _folder(t: Tables) -> str:
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/storage-{uuid.uuid4().hex}"


def _lines(df: DataFrame, path: str) -> None:
    """A small text file: one value a line, in the order of the first column."""
    df.coalesce(1).sortWithinPartitions(df.columns[0]).select(df.columns[-1]).write.mode("overwrite").text(path)


@query(
    "csv_roundtrip",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag, l_shipdate FROM lineitem",
)
def csv_roundtrip(t: Tables):
    """A table as CSV and back: some of its columns, in another order, typed and with dates."""
    path = f"{_folder(t)}/lines.csv"
    writers.save_table(t.lineitem, path, "csv")
    schema = "l_orderkey bigint, l_linenumber int, l_extendedprice double, l_returnflag string"
    return readers.read_file(t.spark, path, schema, ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"], dates=["l_shipdate"])


@query(
    "csv_to_parquet",
    "SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice, o_orderpriority FROM orders",
)
def csv_to_parquet(t: Tables):
    """A CSV folder converted once; a second conversion leaves the result alone."""
    base = _folder(t)
    own = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    writers.save_table(own, f"{base}/orders.csv", "csv")
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"
    readers.csv_to_parquet(t.spark, f"{base}/orders.csv", f"{base}/orders.parquet", schema)
    writers.save_table(own.filter("o_custkey < 0"), f"{base}/orders.csv", "csv")
    readers.csv_to_parquet(t.spark, f"{base}/orders.csv", f"{base}/orders.parquet", schema)
    return t.spark.read.parquet(f"{base}/orders.parquet").withColumn("o_totalprice", rnd("o_totalprice", 4))


@query(
    "raw_table",
    f"{CLINICAL} SELECT subject_id, CASE WHEN subject_id % 10 <> 0 THEN hadm_id END AS hadm_id, stay_id, round(los, 6) AS los FROM stays",
)
def raw_table(t: Tables):
    """A raw table with the columns of a list file; text ids lose a trailing '.0' and 'nan' is missing."""
    base = _folder(t)
    s = stays(t).withColumns(
        {
            "stay_id": F.concat("stay_id", F.when(F.col("subject_id") % 2 == 0, ".0").otherwise("")),
            "hadm_id": F.when(F.col("subject_id") % 10 == 0, "nan").otherwise(F.col("hadm_id")),
            "subject_id": F.concat(F.col("subject_id").cast("string"), F.lit(".0")),
        }
    )
    writers.save_table(s, f"{base}/icu/icustays.csv", "csv")
    names = t.spark.createDataFrame([(0, "subject_id, hadm_id"), (1, "stay_id,los")], "i int, line string")
    _lines(names, f"{base}/icustays_included.txt")
    raw = readers.read_raw(t.spark, base, "icustays", "csv", included=f"{base}/icustays_included.txt")
    return raw.withColumn("los", rnd("los"))


def _raw_events(t: Tables) -> str:
    base = _folder(t)
    e = events(t).select("subject_id", "hadm_id", "stay_id", "charttime", "itemid", F.col("valuenum").cast("string").alias("value"), "valuenum", F.lit("u").alias("valueuom"))
    writers.save_table(e, f"{base}/icu/chartevents.parquet")
    d = items(t).select("itemid", "label", F.when(F.col("itemid") % 3 == 0, "inputevents").otherwise("chartevents").alias("linksto"))
    writers.save_table(d.unionByName(d), f"{base}/icu/d_items.parquet")
    writers.save_table(items(t).select("itemid", F.col("p_brand").alias("label")), f"{base}/hosp/d_labitems.parquet")
    return base


@query("event_reader", f"{CLINICAL} SELECT stay_id, itemid, charttime, valuenum, label FROM events_ JOIN items USING (itemid) WHERE itemid % 3 <> 0")
def event_reader(t: Tables):
    """Events with the labels of their own table's items, once each although the dictionary repeats."""
    return readers.read_events(t.spark, _raw_events(t), "chartevents").select("stay_id", "itemid", "charttime", "valuenum", "label")


@query(
    "item_dictionary",
    f"""{CLINICAL} SELECT itemid, label, 'chart' AS kind FROM items WHERE itemid % 3 <> 0 UNION ALL SELECT itemid, label, 'all' FROM items
    UNION ALL SELECT itemid, p_brand, 'lab' FROM items""",
)
def item_dictionary(t: Tables):
    base = _raw_events(t)
    chart = readers.read_items(t.spark, base, "chartevents").withColumn("kind", F.lit("chart"))
    whole = readers.read_items(t.spark, base, ["chartevents", "inputevents"], keep=True).drop("linksto").withColumn("kind", F.lit("all"))
    return chart.unionByName(whole).unionByName(readers.read_lab_items(t.spark, base).withColumn("kind", F.lit("lab")))


@query(
    "code_map",
    "SELECT DISTINCT CAST(p_size AS VARCHAR) AS icd_9, p_brand AS icd_10 FROM part",
)
def code_map(t: Tables):
    """Code pairs of a file with another separator, distinct, as text."""
    base = _folder(t)
    pairs = t.part.select(F.col("p_size").alias("icd_9"), F.col("p_brand").alias("icd_10"), "p_name")
    pairs.write.option("header", True).option("sep", "|").csv(f"{base}/map.csv")
    return readers.read_code_map(t.spark, f"{base}/map.csv", "|")


@query(
    "label_maps",
    """SELECT 'label' AS kind, p_type AS key, min(p_brand) AS value FROM part GROUP BY p_type
    UNION ALL SELECT 'item', CAST(p_partkey AS VARCHAR), p_type FROM part
    UNION ALL SELECT 'unit', CAST(p_partkey AS VARCHAR), p_brand FROM part""",
)
def label_maps(t: Tables):
    """Canonical labels, item levels and standard units from their files, one row per key."""
    base = _folder(t)
    writers.save_table(t.part.select("p_type", "p_name", "p_size", "p_brand"), f"{base}/labels.csv", "csv")
    writers.save_table(t.part.select(F.col("p_partkey").alias("itemid"), F.col("p_name").alias("LEVEL1"), F.col("p_type").alias("LEVEL2")), f"{base}/levels.csv", "csv")
    writers.save_table(t.part.select(F.col("p_partkey").alias("label_modified"), F.col("p_brand").alias("unit")), f"{base}/units.csv", "csv")
    one = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(value).alias("value"))
    labels = one(readers.read_label_map(t.spark, f"{base}/labels.csv"), "label", "raw", "canonical")
    levels = one(readers.read_item_levels(t.spark, f"{base}/levels.csv"), "item", "itemid", "new_label")
    return labels.unionByName(levels).unionByName(one(readers.read_standard_units(t.spark, f"{base}/units.csv"), "unit", "medication", "standard_unit"))


@query(
    "limit_table",
    "SELECT n_name AS variable, CAST(n_nationkey AS DOUBLE) AS lower_limit, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 10.5::DOUBLE END AS upper_limit FROM nation",
)
def limit_table(t: Tables):
    """Ranges of variables; what is no number is missing."""
    base = _folder(t)
    upper = F.when(F.col("n_nationkey") % 4 != 0, (F.col("n_nationkey") * 10.5).cast("string")).otherwise("none")
    n = t.nation.select(F.col("n_name").alias("label_modified"), F.col("n_nationkey").alias("lower_limit"), upper.alias("upper_limit"), F.lit(1).alias("include_lower"), F.lit(0).alias("include_upper"))
    writers.save_table(n, f"{base}/limits.csv", "csv")
    limits = readers.read_limits(t.spark, f"{base}/limits.csv")
    rows = [(k, v["lower_limit"], v["upper_limit"]) for k, v in limits.items()]  # one row for each variable
    return t.spark.createDataFrame(rows, "variable string, lower_limit double, upper_limit double")


@query("feature_list", "SELECT row_number() OVER (ORDER BY n_nationkey DESC) AS place, n_name AS feature FROM nation")
def feature_list(t: Tables):
    """Names in the order of their file."""
    base = _folder(t)
    _lines(t.nation.select(-F.col("n_nationkey"), "n_name"), f"{base}/features.txt")
    names = readers.read_feature_list(t.spark, f"{base}/features.txt")
    return t.spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], "place bigint, feature string")


@query("found_files", "SELECT DISTINCT 'flag=' || l_returnflag AS folder FROM lineitem WHERE l_returnflag <> 'N'")
def found_files(t: Tables):
    """Files below a folder by extension, without those of one partition."""
    base = _folder(t)
    t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("flag")).write.partitionBy("flag").parquet(f"{base}/lines")
    paths = readers.find_files(t.spark, base, ".parquet", exclude="flag=N")
    return t.spark.createDataFrame([(p.split("/")[-2],) for p in paths], "folder string").distinct()


@query(
    "partition_overwrite",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_quantity + 100 ELSE l_quantity END AS l_quantity, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')",
)
def partition_overwrite(t: Tables):
    """One partition of a written table is replaced, the others stay; two are read back, with a stated schema."""
    path = f"{_folder(t)}/lines"
    own = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    writers.save_partitions(own, path, ["l_returnflag"])
    changed = own.filter("l_returnflag = 'R'").withColumn("l_quantity", F.col("l_quantity") + 100)
    writers.save_partitions(changed, path, ["l_returnflag"])
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_returnflag string"
    return readers.read_partitions(t.spark, path, schema, l_returnflag=["A", "R"])


@query(
    "split_roundtrip",
    """SELECT 'data' AS kind, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT * FROM (VALUES ('feature_type', 'o_custkey', 'Numerical'), ('feature_type', 'o_orderpriority', 'Categorical'), ('dtype', 'o_custkey', 'bigint'), ('output_dimension', 'o_orderpriority', '5'))""",
)
def split_roundtrip(t: Tables):
    """The training rows of a written split and its metadata."""
    path = f"{_folder(t)}/split"
    split = F.element_at(F.array(*[F.lit(s) for s in ("train", "val", "test")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    types = {"o_custkey": "Numerical", "o_orderpriority": "Categorical"}
    own = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", split.alias("split"))
    extra = own.limit(5).withColumn("split", F.lit(None).cast("string"))  # rows without a split are left out
    writers.save_split(own.unionByName(extra), path, types, {"o_custkey": "bigint"}, {"o_orderpriority": 5})
    data, meta = readers.read_split(t.spark, path, "train")
    rows = [(kind, c, str(v)) for kind in ("feature_type", "dtype", "output_dimension") for c, v in meta[kind].items()]
    cells = data.select(F.lit("data").alias("kind"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").cast("string").alias("value"))
    return cells.unionByName(t.spark.createDataFrame(rows, "kind string, key string, value string"))


@query("result_file", "SELECT l_returnflag AS model, round(avg(l_quantity), 6) AS score FROM lineitem GROUP BY 1")
def result_file(t: Tables):
    """A report table as one CSV file."""
    path = f"{_folder(t)}/results.csv"
    writers.save_results(t.lineitem.groupBy(F.col("l_returnflag").alias("model")).agg(rnd(F.avg("l_quantity")).alias("score")), path)
    return readers.read_file(t.spark, path, "model string, score double")


@query("vector_store", "SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 7) AS total, len(embedding) AS width FROM embeddings")
def vector_store(t: Tables):
    path = f"{_folder(t)}/vectors"
    writers.save_vectors(t.embeddings, path, ["vec_id"], "embedding")
    v = t.spark.read.schema("vec_id bigint, embedding array<double>").parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", rnd(total, 7).alias("total"), F.size("embedding").cast("bigint").alias("width"))


_ENCODED = """WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 8) AS e1, (l_returnflag = 'N')::INT::DOUBLE AS e2, (l_returnflag = 'R')::INT::DOUBLE AS e3,
    (l_linestatus = 'O')::INT::DOUBLE AS e4 FROM lineitem, b"""


def _cells(encoded: DataFrame) -> DataFrame:
    e = [F.element_at("encoded", i) for i in range(1, 5)]
    return encoded.select("l_orderkey", "l_linenumber", rnd(e[0], 8).alias("e1"), *[c.alias(f"e{i}") for i, c in enumerate(e[1:], 2)])


@query("encoder_state", _ENCODED)
def encoder_state(t: Tables):
    """An encoder fitted, saved, loaded and applied."""
    base = _folder(t)
    encode.Encoder.fit(t.lineitem, _KINDS).save(t.spark, base)
    return _cells(encode.Encoder.load(t.spark, base).transform(t.lineitem, ["l_orderkey", "l_linenumber"]))


@query("fit_or_load", _ENCODED)
def fit_or_load(t: Tables):
    """Fitted and saved by the first call, loaded by the second, though that one is given other rows."""
    base = _folder(t)
    own = dict(spark=t.spark, types=_KINDS, keys=["l_orderkey", "l_linenumber"], state_path=f"{base}/state", data_path=f"{base}/data")
    writers.fit_or_load(data=t.lineitem, **own)
    return _cells(writers.fit_or_load(data=t.lineitem.limit(10), **own)[1])
