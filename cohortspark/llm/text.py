"""What the text operators share: word splitting, per-task text functions, label samples, row identity."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.session import ensure_checkpoint_dir

# Words are maximal runs of digits, a-z and everything beyond ASCII, after lower-casing A-Z only.  On UTF-8
# bytes that is one table: every byte of a non-ASCII character is 0x80 or more and stays as it is.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
MEMO_LIMIT = 500_000  # entries of a per-task memo; it starts anew when full, which changes speed only


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, for clusters where it is not installed.

    Arrow batches of the session are cut to BATCH_BYTES, as texts are long and each Python worker holds a few batches.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH, None) in (None, "64m", "67108864", "67108864b"):  # left as it was
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="run-"), "cohortspark_code")
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(root), os.path.basename(root)))
        _shipped.add(context.applicationId)
    return spark


def words(text: str) -> list[bytes]:
    """Words of a text as UTF-8 bytes."""
    return text.encode().translate(_WORD_BYTES).split()


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only; the number of code points stays."""
    return text.encode().lower().decode()


class Memo(dict):
    """Cache of a pure function of one key, emptied when it holds ``limit`` entries."""

    def __init__(self, compute: Callable, limit: int = MEMO_LIMIT):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def word_hashes(limit: int = MEMO_LIMIT) -> Callable[[list[bytes]], np.ndarray]:
    """Function from words to their 64-bit hashes."""
    memo = Memo(xxhash.xxh3_64_intdigest, limit)
    return lambda ws: np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))


def mix64(x: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def per_text(build: Callable[[], Callable[[list[str]], dict]], returns: str):
    """Arrow-batched column function of a text column.

    ``build()`` runs once per task and gives a function from a list of texts (null becomes empty) to a dict
    of result columns, which become the fields of the struct ``returns``.
    """

    @F.pandas_udf(returns)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = build()
        for part in parts:
            yield pd.DataFrame(work([t if isinstance(t, str) else "" for t in part]))

    return run


def id_fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; rows with 0 (and rows without an id) are held out and never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)), F.lit(0))


def label_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int]) -> DataFrame:
    """(doc_id, text, label): a bounded sample of labelled rows outside the held-out fold.

    At most ``per_class[c]`` ids of each class, those whose md5 comes first; so the sample is the same on
    every run, and the joined table has a proven bound and may be broadcast.  Ids with several labels
    take the largest.
    """
    known = labels.filter((id_fold(F.col("doc_id")) != 0) & F.col(label).isin(*per_class))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    taken = None
    for value, limit in per_class.items():
        one = known.filter(F.col("label") == value).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
        taken = one if taken is None else taken.unionByName(one)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(taken), "doc_id").dropDuplicates(["doc_id", "text"])


def keep_rows(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """Rows of ``docs`` named by ``stays`` (doc_id, text_hash = xxhash64 of the text), one for each name.

    Rows are found by id and text, so two texts under one id are told apart, and a row that is there twice
    stays once.
    """
    named = docs.withColumn("_llm_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    chosen = stays.select(F.col("doc_id").alias("_llm_id"), F.col("text_hash").alias("_llm_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_text") == F.col("_llm_hash"))
    joined = named.join(chosen, same, "left_semi")
    return first_of_each(joined, ["doc_id", "_llm_text"]).drop("_llm_text")


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The table written in the shared folder and read again, and its path."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """The table written in the shared folder and read again, so that the planner knows its size.

    A small one is then broadcast instead of shuffling what it is joined with; a larger one is shuffled.
    """
    return stored_at(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored_at`` when all that was made of it is written elsewhere."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def first_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key; rows of a key are told to be equal, so any of them will do."""
    w = Window.partitionBy(*keys).orderBy(F.lit(0))
    return df.withColumn("_llm_rn", F.row_number().over(w)).filter(F.col("_llm_rn") == 1).drop("_llm_rn")
