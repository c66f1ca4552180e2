"""Fixtures of the text operators' tests: hard cases that every operator must take."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.StringType()),  # columns whose names clash with results
        T.StructField("size", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", None, "y", "r", "k") for i, t in zip(ids, texts)], SCHEMA)


def prose(seed, n, vocabulary=400):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}" for _ in range(n))


HARD = [
    None,
    "",
    "   \n\t ",
    "!!! ???",
    "one",
    "Ünïcode ẞ \U0001f600 end",
    "a" * 30_000,
    prose(1, 20_000),
    "same text here for you",
    "SAME text here for you",
    "same text here for you",
]
