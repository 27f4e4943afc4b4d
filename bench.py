"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import time

from swathline.plans import all_queries
from swathline.session import build_session

HEADLINE = [
    "flood_tiles",
    "flood_total",
    "flood_tiles_otsu",
    "flood_mask",
    "random_pixel_lookup",
    "random_window_read",
    "aoi_mean_per_time",
    "cube_mean",
    "build_cube",
    "mosaic_first",
    "reproject_match",
    "boxcar",
    "lee_filter",
    "interferogram",
    "rf_features",
    "zone_flood_stats",
    "st_within",
    "merge_upsert",
    "rechunk",
    "ks_two_sample",
    "connected_components",
    "polygonize",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session("swathline-bench", master=f"local[{cores}]", cores=cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # One warm-up, so that the first query does not pay for JVM start and class loading.
    queries["flood_tiles"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
