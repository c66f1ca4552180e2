"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from cohortspark import get_session
from cohortspark.catalog import QUERIES

HEADLINE = [
    "cohort_build",
    "events_on_cohort",
    "code_pivot",
    "unit_convert",
    "hourly_pivot_mean",
    "interval_explode_mean",
    "grid_assemble",
    "containment_join",
    "impute_linear",
    "rare_fold",
    "patient_split",
    "stochastic_fit",
    "ks_stat",
    "pearson_pairs",
    "cramers_v",
    "acf_table",
    "box_by_group",
    "single_out",
    "t_closeness",
    "nearest_neighbour",
    "roc_auc",
    "delong",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        f"local[{cpus}]",
        "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM side
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
