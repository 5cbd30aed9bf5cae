"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores; names as arguments choose queries, ``all`` runs every registered one.
"""

from __future__ import annotations

import json
import os
import sys
import time

from rankloom import catalog
from rankloom.session import local_session

HEADLINE = (
    "p4_numeric_summary",
    "p9_price_histogram",
    "p16_booking_rate_by_price_rank",
    "p18_spearman",
    "x1_csv_to_typed_parquet",
    "x2_base_features",
    "g2_item_profile",
    "g9_r5_r7_market_zscores",
    "g10_frequencies",
    "g12_group_transform",
    "t2_out_of_fold_item_rates",
    "t4_out_of_fold_market_item_rates",
    "x3_feature_table",
    "x4_classic_features",
    "m3_mean_ndcg_relevant_queries",
    "m4_ndcg_with_hot_query",
    "e3_preference_pairs",
    "e4_lambda_gradients",
    "e5_boosted_ranking_trees",
    "e8_o2_ranked_output",
    "q1_quality_per_group",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    known = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    if list(names) == ["all"]:
        names = list(known)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start the JVM's pools
    times = {}
    for name in names:
        start = time.perf_counter()
        # every column of every row is computed; nothing is collected
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
