"""Times the headline raster queries; prints one JSON line. BENCH_SF_DIR: tables, BENCH_CPUS: threads, BENCH_RUNS: runs after a warm-up (the median counts).
BENCH_LARGE=1 adds single runs over one image of 24 megapixels, under "large": seconds, rows and bytes of pixels (8 a pixel) a second."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from rasterloom.operators.compose import to_pixels8
from rasterloom.plans.compiler import run
from rasterloom.plans.spec import Pipeline
from rasterloom.queries import QUERIES
from rasterloom.sources.images import sample
from rasterloom.sources.tables import ingest

HEADLINE = ["pipeline_flagship", "pipeline_chain", "exposure", "invert", "crop", "rotate_90", "rotate_45_expand", "blur_one_image", "blur", "sharpen", "resize_nearest", "resize_bilinear", "resize_catmull_rom", "resize_lanczos3", "redact_pixelate", "beautify", "draw_arrow", "overlay", "diff_stats", "trim"]


LARGE = {
    "exposure": [{"op": "exposure", "stops": 0.5}],
    "blur_8": [{"op": "blur", "radius": 8}],
    "resize_1920": [{"op": "resize", "width": 1920}],
    "chain": [{"op": "resize", "width": 1920}, {"op": "exposure", "stops": 0.5}, {"op": "crop", "x": 100, "y": 100, "width": 1000, "height": 800}, {"op": "grayscale"}],
}


def large(spark: SparkSession, width: int = 6000, height: int = 4000) -> dict:
    """One image, written once: what is timed reads it, runs a pipeline and encodes 8-bit pixels."""
    out = {}
    with tempfile.TemporaryDirectory() as folder:
        sample(spark, width, height).write.parquet(f"{folder}/px")
        px = ingest(spark.read.parquet(f"{folder}/px"))
        for name, steps in LARGE.items():
            began = time.monotonic()
            to_pixels8(run(px, Pipeline.parse(steps), [(width, height)])).write.format("noop").mode("overwrite").save()
            seconds = time.monotonic() - began
            out[name] = {"sec": round(seconds, 2), "rows_per_sec": round(width * height / seconds), "bytes_per_sec": round(8 * width * height / seconds)}
    return out


def main() -> None:
    folder, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            began = time.monotonic()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.monotonic() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    more = {"large": large(spark)} if os.environ.get("BENCH_LARGE") else {}
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")} | more))


if __name__ == "__main__":
    main()
