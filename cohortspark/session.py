"""Session factory.  Library code never relies on it: every operator works on the caller's session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


# Spark 4.1 lets a union keep the hash partitioning of its inputs; when adaptive execution then coalesces the
# inputs differently, a following aggregation on the same keys returns split groups.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def safe_unions(spark: SparkSession) -> SparkSession:
    """Switch the union partitioning shortcut off in a session that was built elsewhere."""
    if spark.conf.get(UNION_PARTITIONING, "true") == "true":
        spark.conf.set(UNION_PARTITIONING, "false")
    return spark


def get_session(master: str | None = None, app_name: str = "cohortspark", **conf: str) -> SparkSession:
    """Build or reuse a session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        UNION_PARTITIONING: "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; fall back to a fresh local one only if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp")))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """Compute a fitted table once and cut its lineage, in reliable storage that outlives an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
