"""A spread of registered queries against their SQL twins on the smallest tables; the tool runs all of them."""

import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle  # noqa: E402
from cohortspark.catalog import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SPREAD = [
    "cohort_build",
    "code_pivot",
    "grouped_share_cutoff",
    "rate_extract",
    "hourly_pivot_mean",
    "interval_explode_flag",
    "episode_lookup",
    "impute_by_type",
    "incremental_sample",
    "encode_table",
    "cramers_v",
    "single_out",
    "k_nearest",
    "average_precision",
]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not mounted")
@pytest.mark.parametrize("name", SPREAD)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in check_oracle.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    text, _, ok = check_oracle.compare(spark, FOLDER, name, con)
    assert ok, text
