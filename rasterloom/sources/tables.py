"""Rasters derived from the test tables: dense grids keyed by image and position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import decode8

C = F.col


def with_size(df: DataFrame, width, height) -> DataFrame:
    as_int = lambda v: v.cast("int") if hasattr(v, "cast") else F.lit(v).cast("int")
    return df.withColumns({"width": as_int(width), "height": as_int(height)})


def ingest(df: DataFrame) -> DataFrame:
    """8-bit straight-alpha pixels (r8, g8, b8, a8) to linear premultiplied ones."""
    a = C("a8") / 255.0
    return df.select("img_id", "x", "y", "width", "height", *((decode8(C(f"{c}8")) * a).alias(c) for c in "rgb"), a.alias("a"))


def orders_px8(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = C("o_orderkey")
    px = o.select(
        F.expr("o_orderkey div 500").alias("img_id"), (k % 500 % 25).cast("int").alias("x"), F.expr("(o_orderkey % 500) div 25").cast("int").alias("y"),
        (C("o_custkey") % 256).cast("int").alias("r8"), (F.floor("o_totalprice") % 256).cast("int").alias("g8"), (k * 7 % 256).cast("int").alias("b8"),
        F.when(C("o_orderstatus") == "P", 128).otherwise(255).cast("int").alias("a8"),
    )
    return with_size(px, 25, 20)


def orders_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 x 20 images of colours and partial transparency."""
    return ingest(orders_px8(spark, sf_dir))


def emb_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images of linear grey values, some of them negative."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(C("vec_id").alias("img_id"), F.posexplode("embedding").alias("pos", "v"))
    v = C("v").cast("double")
    px = e.select("img_id", (C("pos") % 8).cast("int").alias("x"), F.expr("cast(pos div 8 as int)").alias("y"), v.alias("r"), v.alias("g"), v.alias("b"), F.lit(1.0).alias("a"))
    return with_size(px, 8, 8)


def events_px8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image of width 100; the last row is left out where it isn't full."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.agg(F.floor((F.max("event_id") + 1) / 100).cast("int")).first()[0] or 0
    kind = F.when(C("event_type") == "click", 0).when(C("event_type") == "error", 64).when(C("event_type") == "purchase", 128).when(C("event_type") == "signup", 192).otherwise(255)
    px = e.where(C("event_id") < rows * 100).select(
        F.lit(0).cast("long").alias("img_id"), (C("event_id") % 100).cast("int").alias("x"), F.expr("cast(event_id div 100 as int)").alias("y"),
        (F.floor("value") % 256).cast("int").alias("r8"), (C("user_id") % 256).cast("int").alias("g8"), kind.alias("b8"), F.lit(255).alias("a8"),
    )
    return with_size(px, 100, rows)
