"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..packaging import ship

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPACE = r"[\x20\x09-\x0D]+"
#: Longs of a bit set; its size doesn't depend on the rows in it.
BIT_WORDS = 1 << 14


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one under the warehouse where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes a DataFrame to the shared checkpoint folder and reads it from there, so that later stages don't recompute it and a lost executor doesn't lose it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Tables that one run writes to the shared folder, as compressed Parquet. A table is dropped when its last reader is done."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.folder = spark, fresh_dir(spark, kind)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables, and lets Spark's cleaner see which plans are dead, so that their shuffle files go too."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        free(self.spark)


def free(spark: SparkSession) -> None:
    """Spark keeps the shuffle files of a plan until the driver's garbage collector finds that nothing refers to it; on a driver with memory to spare that may be never."""
    gc.collect()
    spark._jvm.System.gc()


def release() -> None:
    """Gives memory that a Python worker, which outlives its tasks, no longer uses back to the machine."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """mapInArrow, whose tasks release what they held."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def by_size(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A written table to join with: broadcast if it has few rows, else left to the optimizer."""
    return F.broadcast(df) if df.count() <= most_rows else df


def own(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own: extra columns, whatever they are called, stay out."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _bit(*columns: str) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(*columns), F.lit(64 * BIT_WORDS))
    return F.shiftright(h, 6).cast("int"), h.bitwiseAND(63).cast("int")


def bit_set(rows: DataFrame, *columns: str) -> list[int]:
    """A bit for the hash of each row's columns; BIT_WORDS longs, whatever the number of rows. A filter before a semi-join, which stays exact: the set only rules out."""
    word, bit = _bit(*columns)
    out = [0] * BIT_WORDS
    for w, x in rows.select(word.alias("w"), bit.alias("b")).selectExpr("w", "shiftleft(1L, b) x").groupBy("w").agg(F.bit_or("x").alias("x")).collect():  # at most BIT_WORDS rows
        out[w] = x
    return out


def in_bit_set(bits: list[int], *columns: str) -> Column:
    word, bit = _bit(*columns)
    return F.getbit(F.get(array_literal(bits), word), bit) == 1


def array_literal(values: Iterable[int], kind: str = "bigint") -> Column:
    """Whole numbers as one array, which the optimizer folds to a literal; handed over as one string, not number by number."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
