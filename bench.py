"""Times the headline queries over whole tables and prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores. Each query starts from the input
tables: stage tables of earlier queries are not reused.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from claimscope import build_session  # noqa: E402
from claimscope.catalog import QUERIES, stages  # noqa: E402
from claimscope.session import clean_up  # noqa: E402

HEADLINES = [
    "flagship_price_outliers", "r1_profile_claims", "r2_provider_features", "m3_baseline_rank", "r3_score_providers",
    "r7_extract_cohort_claims", "r8_cohort_features", "m6_cohort_risk", "a24_code_mix", "r16_build_networks",
    "m7_match_individuals_tiered", "r17_match_organisations", "r18_match_deactivated", "r19_spending_exposure",
    "m10_network_risk", "w1_rank_claims",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": cpus, "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("a1_distinct_ids", "a4_peer_rollup", "w2_rank_min"):  # JVM warm-up, not timed
        QUERIES[name](spark, sf_dir).collect()
    times = {}
    for name in HEADLINES:
        stages.clear()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    clean_up(spark)
    spark.stop()


if __name__ == "__main__":
    main()
