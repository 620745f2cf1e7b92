"""Headline queries: one JSON line with wall seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from fleetlens.plans import registry
from fleetlens.session import build_session

HEADLINE = [
    "a01_image_score", "a02_score_cut", "a03_car_aggregate", "a08_visible_damages", "a15_call_rollup",
    "a17_session_rollup", "a20_metric_histogram", "j03_car_counts", "j11_overlap_pairs", "k02_coco_annotations",
    "m01_near_duplicates", "m02_nms", "m03_collapse_clusters", "m04_merge_tiles", "m05_stratified_pick", "m07_curate",
    "p15_parse_response", "w08_dedup_damage_in_case", "d01_match_detections", "d03_map50", "d06_model_agreement",
    "i01_image_metrics", "s02_read_photo_export", "t01_stream_session_totals", "t05_annotation_log",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"), spark__cleaner__referenceTracking__cleanCheckpoints="true",
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not part of any query
    seconds = {}
    for name in wanted:
        start = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
