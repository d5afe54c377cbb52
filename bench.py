"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from trackloom import build_session
from trackloom.plans import all_queries

HEADLINE = (
    # Bins, targets, intersection, subtraction, merging, overlaps, and the composites.
    "track_bins", "shape_project_on_genes", "track_intersect", "shape_signal_outside_genes",
    "shape_merge_strong_signal", "track_loc_overlaps", "shape_long_genes", "shape_count_genes",
    "shape_consensus_bins", "shape_shifted_strands",
    "track_intersect_product_each", "track_discretize_avg_each", "track_discretize_max_each",
    "track_coalesce_avg", "track_exclusive", "track_project_avg_each", "track_pair_closest",
    "shape_intersect_then_merge",
    "agg_pricing_summary", "agg_cube_distinct", "agg_grouping_id_present_bits", "agg_ngrams_2",
    "join_three_way", "join_unique_preserve_outer_two", "window_row_number", "window_rows_frames",
    "window_large_ranks", "npath_view_clicks_purchase", "generate_explode_words",
    "storage_multi_insert", "storage_bucketed_join",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    named = all_queries()
    # One query that is not counted starts the JVM code and the Python workers.
    named["agg_cube"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        named[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1).rstrip(".")) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
