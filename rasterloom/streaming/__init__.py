"""Pipelines over streams of image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.compose import to_pixels8
from ..packaging import ship
from ..plans.compiler import run
from ..plans.spec import Pipeline
from ..sources.images import decoded_files, decoded_others, encode_files, format_of
from ..sources.tables import ingest


def watch_folder(spark: SparkSession, folder: str, pipeline: Pipeline, output: str, checkpoint: str, files_per_batch: int = 64, kind: str = "png", quality: int = 90) -> StreamingQuery:
    """Runs a pipeline over png, jpeg and webp files as they arrive.

    Appends path, img_id, and png, jpeg or webp to a Parquet folder, by batch; files that can't be decoded, and those whose size the pipeline doesn't fit, are rows of path, error in
    `output`/_errors and stop nothing. Each file is handled in one micro-batch; a batch that is run again after a failure overwrites its own folders, so results appear once.
    """
    ship(spark)
    kind = format_of(f"a.{kind}")
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{png,PNG,jpg,jpeg,JPG,JPEG,webp,WEBP}").option("maxFilesPerTrigger", str(files_per_batch)).load(folder)

    def handle(batch: DataFrame, number: int) -> None:
        own = F.xxhash64("path").alias("img_id")
        is_jpeg = F.coalesce(F.substring("content", 1, 3) == F.unhex(F.lit("FFD8FF")), F.lit(False))
        named = batch.select(own, "path").persist()
        found = decoded_files(batch.where(~is_jpeg).select(own, "path", "content"))
        jpegs = [r["path"] for r in batch.where(is_jpeg).select("path").collect()]  # files_per_batch at most
        if jpegs:
            images = spark.read.format("image").option("dropInvalid", "false").load(jpegs).select("image.*")
            # The source may write a path another way; ids go by the stream's.
            ids = named.select("img_id", F.regexp_replace("path", "^file:/+", "/").alias("plain"))
            images = images.join(F.broadcast(ids), F.regexp_replace("origin", "^file:/+", "/") == F.col("plain")).drop("plain")
            found = found.unionByName(decoded_others(images))
        found = found.persist()
        pixels = ingest(found.where("error is null").drop("path", "error"))
        done = to_pixels8(run(pixels, pipeline, on_error="quarantine"))
        done = named.join(encode_files(done, kind, quality), "img_id")
        done.write.mode("overwrite").parquet(f"{output}/batch={number}")
        written = spark.read.schema("img_id long").parquet(f"{output}/batch={number}")
        bad = found.where("error is not null").select("img_id", "path", "error")
        unfit = named.join(written, "img_id", "left_anti").join(bad, "img_id", "left_anti").select("img_id", "path", F.lit("the pipeline doesn't fit this image").alias("error"))
        bad.unionByName(unfit).write.mode("overwrite").parquet(f"{output}/_errors/batch={number}")
        found.unpersist()
        named.unpersist()

    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
