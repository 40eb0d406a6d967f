"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from cloudloom.plans import catalog
from cloudloom.session import build_session

HEADLINE = [
    "prd2_in_obb", "prd3_in_prism", "prd4_in_tube", "prd7_ops_chain", "jn1_points_in_boxes", "jn1_points_in_prisms", "agg1_segment_summary",
    "agg2_segment_metadata", "agg9_compare_per_class", "agg10_confusion_top", "agg12_region_stats", "agg22_instance_pca_obb",
    "win2_merge_priority", "win3_merge_vote", "lab3_reassign", "exp3_filters_remap", "smp4_voxel_downsample", "smp6_voxel_segments",
    "clu1_components", "jn3_knn_dense_cloud", "clu3_dbscan", "lab9_replay_small_volumes", "cam2_visible", "cam9_class_votes", "snk2_labeled_ply",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["agg5_class_histogram"](spark, folder).collect()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
