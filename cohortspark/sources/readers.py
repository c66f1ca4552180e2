"""Readers: raw tables, dictionaries, mappings, intermediate tables, splits."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.text import clean_key
from cohortspark.operators.joins import decode_items
from cohortspark.sources.schemas import FOLDERS, KEY_TYPES, RAW


def read_file(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    columns: Sequence[str] | None = None,
    rows: int | None = None,
    sep: str = ",",
    dates: Sequence[str] = (),
    as_text: Sequence[str] = (),
) -> DataFrame:
    """CSV (plain or gzip) or Parquet, by extension; a column subset, date columns and a row limit.

    Columns of a CSV named in ``as_text`` stay text whatever the schema says.

    Prefer Parquet or plain CSV: a gzip file cannot be split, so one task reads all of it.
    """
    if ".csv" in Path(path).name:
        reader = spark.read.option("header", True).option("sep", sep)
        # the header names the columns; the stated types are applied after selecting, so column order is free
        df = reader.csv(path)
        if schema:
            for field in spark.createDataFrame([], schema).schema.fields:
                if field.name in df.columns and field.name not in as_text:
                    df = df.withColumn(field.name, F.col(f"`{field.name}`").try_cast(field.dataType))
    else:
        df = spark.read.parquet(path)
    if columns is not None:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    if dates:
        df = df.withColumns({c: F.col(c).try_cast("timestamp") for c in dates if c in df.columns})
    return df.limit(rows) if rows is not None else df


def normalise_keys(df: DataFrame, types: dict[str, str] = KEY_TYPES) -> DataFrame:
    """Cast key columns, strip a trailing '.0', 'nan' to null."""
    return df.withColumns({k: clean_key(k, t) for k, t in types.items() if k in df.columns})


def read_column_list(spark: SparkSession, path: str) -> list[str]:
    """Column names from a small text file, separated by commas or new lines; read by Spark, from any file system."""
    lines = [r[0] for r in spark.read.text(path, wholetext=True).collect()]
    return [c.strip() for text in lines for line in text.splitlines() for c in line.split(",") if c.strip()]


def read_raw(
    spark: SparkSession,
    root: str,
    table: str,
    extension: str = "parquet",
    columns: Sequence[str] | None = None,
    included: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """A raw hospital table under ``root/<hosp|icu>/<table>.<extension>`` with normalised keys."""
    path = f"{root}/{FOLDERS.get(table, 'hosp')}/{table}.{extension}"
    wanted = list(columns) if columns is not None else (read_column_list(spark, included) if included else None)
    # keys come as text, so that '7.0' is not lost in a cast before it is cleaned
    return normalise_keys(read_file(spark, path, RAW[table], wanted, rows, as_text=(*KEY_TYPES, "icustay_id")))


def read_items(spark: SparkSession, root: str, linksto: str | Sequence[str] | None = None, keep: bool = False, extension: str = "parquet") -> DataFrame:
    """Item dictionary, optionally of one or several event tables, distinct."""
    items = read_raw(spark, root, "d_items", extension)
    if linksto is not None:
        items = items.filter(F.col("linksto").isin([linksto] if isinstance(linksto, str) else list(linksto)))
    return (items if keep else items.drop("linksto")).dropDuplicates()


def read_lab_items(spark: SparkSession, root: str, extension: str = "parquet") -> DataFrame:
    return read_raw(spark, root, "d_labitems", extension).dropDuplicates()


def read_events(spark: SparkSession, root: str, table: str, extension: str = "parquet", columns: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """Event table with its item labels; ``icustay_id`` is renamed to ``stay_id``."""
    events = read_raw(spark, root, table, extension, columns, rows=rows)
    events = normalise_keys(events.withColumnRenamed("icustay_id", "stay_id"))
    items = read_lab_items(spark, root, extension) if table == "labevents" else read_items(spark, root, table, extension=extension)
    return decode_items(events, items)


def read_code_map(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(icd_9, icd_10) as text, distinct."""
    return read_file(spark, path, columns=["icd_9", "icd_10"], sep=sep).select(F.col("icd_9").cast("string"), F.col("icd_10").cast("string")).dropDuplicates()


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(raw, canonical): first and fourth column of the label table, one row per raw label.

    Of several canonical labels the smallest is taken, so that a join with the table never repeats an event.
    """
    df = read_file(spark, path)
    pairs = df.select(F.col(f"`{df.columns[0]}`").alias("raw"), F.col(f"`{df.columns[3]}`").alias("canonical"))
    return pairs.groupBy("raw").agg(F.min("canonical").alias("canonical"))


def read_limits(spark: SparkSession, path: str) -> dict[str, dict]:
    """Per-variable range table as a dict; one entry per variable."""
    df = read_file(spark, path)
    number = lambda c: F.col(c).try_cast("double").alias(c)
    rows = df.select("label_modified", *[number(c) for c in ("lower_limit", "upper_limit", "include_lower", "include_upper")]).collect()
    return {r["label_modified"]: {k: r[k] for k in ("lower_limit", "upper_limit", "include_lower", "include_upper")} for r in rows}


def read_standard_units(spark: SparkSession, path: str) -> DataFrame:
    return read_file(spark, path).select(F.col("label_modified").alias("medication"), F.col("unit").alias("standard_unit"))


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    """One name per line, no header, file order kept."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return [line.strip() for line in text.splitlines() if line.strip()]


def read_item_levels(spark: SparkSession, path: str, level: str = "LEVEL2") -> DataFrame:
    """(itemid, new_label) at a level of the item hierarchy, one row per item; of several labels the smallest."""
    items = read_file(spark, path).select(F.col("itemid").cast("bigint"), F.col(level).alias("new_label"))
    return items.groupBy("itemid").agg(F.min("new_label").alias("new_label"))


def find_files(spark: SparkSession, root: str, extension: str, exclude: str | None = None) -> list[str]:
    """Paths below a folder by extension, recursively; listed by Spark, so any file system works."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").load(root).select("path")
    )
    if exclude:
        found = found.filter(~F.col("path").contains(exclude))
    return sorted(r[0] for r in found.collect())


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: str | None = None) -> None:
    """Convert a CSV file or folder; text stays text, an existing target is left alone."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(source) if schema else reader.option("inferSchema", True).csv(source)
    df.write.mode("ignore").parquet(target)


def read_partitions(spark: SparkSession, path: str, schema: str, **values) -> DataFrame:
    """Rows of some partitions of a partitioned Parquet table: ``column=value`` or ``column=[values]``.

    The schema is stated, so no file is opened to find it; partitions that are not asked for are not listed as input.
    """
    df = spark.read.schema(schema).parquet(path)
    for column, value in values.items():
        df = df.filter(F.col(column).isin(list(value) if isinstance(value, (list, tuple, set)) else [value]))
    return df


def read_split(spark: SparkSession, path: str, mode: str | None = None) -> tuple[DataFrame, dict]:
    """A split table and its metadata (feature types, dtypes, output dimensions)."""
    df = spark.read.parquet(f"{path}/data")
    if mode is not None:
        df = df.filter(F.col("split") == mode)
    rows = spark.read.parquet(f"{path}/metadata").collect()
    return df, {
        "feature_type": {r["column"]: r["feature_type"] for r in rows if r["feature_type"] is not None},
        "dtype": {r["column"]: r["dtype"] for r in rows if r["dtype"] is not None},
        "output_dimension": {r["column"]: r["output_dimension"] for r in rows if r["output_dimension"] is not None},
    }


