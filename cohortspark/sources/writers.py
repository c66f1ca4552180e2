"""Sinks: CSV and Parquet tables, splits with metadata, result tables, vectors; fit-or-load."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.encode import Encoder


PARTITION_FILES = 8  # files of a partition, so that one with most of the rows is no single task's


def save_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def save_split(
    df: DataFrame,
    path: str,
    feature_type: Mapping[str, str],
    dtypes: Mapping[str, str] | None = None,
    output_dimension: Mapping[str, int] | None = None,
) -> None:
    """Table partitioned by ``split`` beside one metadata row per column.  Rows without a split are left out."""
    kept = df.filter(F.col("split").isNotNull())
    kept.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    dtypes, output_dimension = dtypes or {}, output_dimension or {}
    names = list(dict.fromkeys([*feature_type, *dtypes, *output_dimension]))
    rows = [(c, feature_type.get(c), dtypes.get(c), output_dimension.get(c)) for c in names]
    meta = df.sparkSession.createDataFrame(rows, "column string, feature_type string, dtype string, output_dimension int")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def save_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write a partitioned table, or replace exactly those partitions of it that ``df`` has rows of."""
    spread = df.repartition(*by, F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(PARTITION_FILES)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def save_results(df: DataFrame, path: str) -> None:
    """A report table (bounded by models, metrics and settings) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_vectors(df: DataFrame, path: str, keys: Sequence[str], vector: str) -> None:
    df.select(*keys, F.col(vector).cast("array<double>")).write.mode("overwrite").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(conf).exists(hadoop)


def fit_or_load(
    spark: SparkSession,
    data: DataFrame,
    types: Mapping[str, str],
    keys: Sequence[str],
    state_path: str,
    data_path: str,
    fit: Callable[[DataFrame, Mapping[str, str]], Encoder] = Encoder.fit,
    load: bool = True,
    save: bool = True,
) -> tuple[Encoder, DataFrame]:
    """Saved encoder and encoded table when present, otherwise fit, transform and save them."""
    if load and exists(spark, f"{state_path}/blocks"):
        encoder = Encoder.load(spark, state_path)
        if exists(spark, data_path):
            return encoder, spark.read.parquet(data_path)
    else:
        encoder = fit(data, types)
        if save:
            encoder.save(spark, state_path)
    encoded = encoder.transform(data, keys)
    if not save:
        return encoder, encoded
    encoded.write.mode("overwrite").parquet(data_path)
    return encoder, spark.read.parquet(data_path)
