"""Headline queries on the benchmark tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from skyfold.session import local_session

HEADLINE = [
    "b10_telemetry_quality", "c9_gps_quality", "c10_nearest_sync", "flagship_track_report", "e1_voxel_merge", "e2_voxel_downsample", "f1_height_raster",
    "f4_dsm_error", "f7_occupancy", "f12_error_grid", "d5_coverage_buckets", "d7_adaptive_pairs", "d10_environment_score", "g1_checkpoint_metrics", "h1_voxel_diff",
    "i1_face_geometry", "i3_topology", "i4_vertex_components", "k2_lexical_rank", "l6_skyline", "l10_stage_profile", "l16_alerts", "e13_spacing_field",
]


def main() -> None:
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from skyfold.plans import QUERIES

    QUERIES["b7_gps_status"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up: starts the session, compiles common code
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
