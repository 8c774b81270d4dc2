"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import costbook.plans  # noqa: E402, F401
from costbook.plans.registry import REGISTRY  # noqa: E402
from costbook.session import local_session  # noqa: E402
from costbook.sources.bindings import Tables  # noqa: E402

HEADLINE = (
    "a11_usage_ledger", "w02_latest_price_row", "a07_coverage_matrix", "e03_price_list", "e06_coverage", "j09_norms_using_resource",
    "a12_norm_cost", "a27_unit_rate", "a16_subtree_count", "h01_ancestor_chain", "j13_two_level_mapping", "j19_boq_code_resolution",
    "w05_continued_table_fill", "d04_code_columns", "x21_clean_amount", "j21_gap_match",
)


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].run(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


if __name__ == "__main__":
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    names = sys.argv[1:] or HEADLINE
    # JVM and file listing warm-up, not counted
    run(spark, folder, "j02_usage_resource")
    seconds = {name: round(run(spark, folder, name), 3) for name in names}
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
