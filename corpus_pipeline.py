"""Cleaning of the document table in five stages, each written as Parquet and read again by the next.

Every stage judges each row that the stage before kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cohortspark.llm import byte_bpe, decontaminate, exact_dedup, path_join, quality  # noqa: E402
from cohortspark.llm.text import keep_rows, ship_package  # noqa: E402
from cohortspark.session import ensure_checkpoint_dir  # noqa: E402

LEAST_QUALITY = 0.3


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, each row by itself: repeats stay, null and empty texts have
    the score of a text without words.  Without labels no row is rejected; an empty table stays empty."""
    labels = ship_package(spark).read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.train_quality(docs, labels)
    return quality.keep_quality(docs, weights, LEAST_QUALITY)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id (null is smallest), of repeated rows one.  Null text equals empty
    text; an empty table stays empty."""
    ship_package(spark)
    return keep_rows(docs, exact_dedup.exact_duplicates(docs).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id (null is largest), of repeated
    rows one.  Null, empty and wordless texts are groups of their own; an empty table stays empty."""
    ship_package(spark)
    return keep_rows(docs, path_join.near_duplicates(docs).filter("stays"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth, each row by itself: repeats stay, and so do null
    and empty texts.  An empty benchmark drops nothing; an empty table stays empty."""
    benchmark = ship_package(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, with digests of the ids and of their decoding."""
    ship_package(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what passes between two stages is a table in the shared folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    mark = spark.range(1).select(F.expr("uuid()")).first()[0]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{base}/pipeline-{mark}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
