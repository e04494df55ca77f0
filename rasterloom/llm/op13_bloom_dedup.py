"""Operator 13: exact duplicates of texts by two passes over a Bloom filter.

The first pass puts the hash of every text into a Bloom filter whose bits say "met twice or more". The second pass asks the
filter: a text one of whose bits is not set is met once, for certain, and passes straight through. Only the rest, the texts that
repeat and a few false alarms, is shuffled and grouped by the SHA-256 of the text, so the result is exact.

The filter is blocked: all bits of a hash lie in one chunk of 65,536 bits, so asking it is a broadcast join on the chunk's number. It
has `BITS_A_ROW` bits a row. Hashes (never texts) are written once to the shared folder, sorted within each file by slice: a slice is
a range of hashes of about `SLICE_ROWS` rows, and has a filter of its own, so what is broadcast is bounded by SLICE_ROWS * BITS_A_ROW bits at any size
and a slice reads little more than its own part of the files.

Equal texts: identical after lower-casing A-Z only; null counts as empty. Of equal texts the row with the largest id stays; a null id is
less than all others; of repeated rows (equal in id too) one stays. Extra columns are left out by `exact_duplicates` and kept, whatever their
names, by `drop_duplicates`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..packaging import ship
from .bitmaps import CHUNK, SPARSE, merged, power_of_two, sparse_counts
from .shared import Scratch, by_size, documents, map_arrow, own

BITS_A_ROW, PROBES = 16, 4
#: Rows of a slice; its filter has two bytes a row, 32 MB at most.
SLICE_ROWS = 1 << 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes a task holds at a time.
_HELD = 1 << 19


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)


def text_hash(text: Column) -> Column:
    """32 bytes of the SHA-256 of the normalised text in UTF-8."""
    return F.unhex(F.sha2(normalised(text), 256))


def _long(digest: Column, start: int) -> Column:
    """Eight bytes of a digest as a long."""
    return F.conv(F.hex(F.substring(digest, start, 8)), 16, -10).cast("long")


def _probes(chunk_hash: str = "h2") -> list[Column]:
    """PROBES places in a chunk, 16 bits of the second long each."""
    return [F.shiftrightunsigned(chunk_hash, 16 * i).bitwiseAND(F.lit(CHUNK - 1)) for i in range(PROBES)]


def met_twice(hashes: DataFrame, chunks: int) -> DataFrame:
    """chunk, bits: the filter's bits that two rows of (h1, h2) or more have set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            h1, h2 = (np.concatenate(x).view(np.uint64) for x in (held, held2))
            base = (h1 % np.uint64(chunks)) * np.uint64(CHUNK)
            places = np.sort(np.stack([(h2 >> np.uint64(16 * i)) & np.uint64(CHUNK - 1) for i in range(PROBES)]), axis=0)
            own_bits = np.r_[np.ones((1, len(h1)), bool), places[1:] != places[:-1]]  # a row counts once for a bit
            return sparse_counts((base + places)[own_bits], 2)

        held, held2, n = [], [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            held2.append(batch.column(1).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= _HELD:
                yield flush()
                held, held2, n = [], [], 0
        if n:
            yield flush()

    return merged(map_arrow(hashes.select("h1", "h2"), run, SPARSE), 2)


def filters(hashes: DataFrame, scratch: Scratch, slice_rows: int = SLICE_ROWS) -> tuple[list[DataFrame], int]:
    """The filter of each slice of written hashes (h1, h2, slice), and the number of its chunks."""
    n = hashes.count()
    slices = _slices(n, slice_rows)
    chunks = power_of_two(-(-n * BITS_A_ROW // slices), CHUNK) // CHUNK  # n / slices is slice_rows at most
    return [scratch.table(f"filter-{k}", met_twice(hashes.where(F.col("slice") == k), chunks)) for k in range(slices)], chunks


def asked(rows: DataFrame, bits: list[DataFrame], chunks: int) -> DataFrame:
    """rows with a boolean column `perhaps`: false where the filter knows that the row's (h1, h2, slice) is met once."""
    parts = []
    for k, table in enumerate(bits):
        placed = rows.where(F.col("slice") == k).withColumn("chunk", F.col("h1").bitwiseAND(F.lit(chunks - 1)).cast("int"))
        found = placed.join(F.broadcast(table), "chunk", "left")  # chunks * 8 KB: slice_rows * BITS_A_ROW / 8 bytes at most
        every = reduce(lambda a, b: a & b, (F.getbit(F.get("bits", F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1 for p in _probes()))
        parts.append(found.withColumn("perhaps", F.coalesce(every, F.lit(False))).drop("chunk", "bits"))
    return reduce(DataFrame.unionByName, parts)


def _slices(n: int, slice_rows: int) -> int:
    return -(-max(1, n) // slice_rows)


def _hashed(df: DataFrame, slices: int) -> DataFrame:
    """h1, h2, slice of each row's digest."""
    h = df.withColumns({"h1": _long(F.col("digest"), 1), "h2": _long(F.col("digest"), 9)})
    return h.withColumn("slice", F.pmod(F.shiftrightunsigned("h1", 32), F.lit(slices)).cast("int"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size long, kept boolean, text_sha256 string: a row per row of df."""
    scratch, slices = Scratch(df.sparkSession, "exact"), _slices(df.count(), slice_rows)
    docs = own(df, id_col, text_col).select("doc_id", text_hash(F.col("text")).alias("digest"))
    hashes = _hashed(docs, slices).withColumn("row", F.monotonically_increasing_id())
    hashes = scratch.table("hashes", hashes.sortWithinPartitions("slice") if slices > 1 else hashes)  # from here on a row has its number
    return _grouped(asked(hashes, *filters(hashes, scratch, slice_rows)), scratch)


def _grouped(flagged: DataFrame, scratch: Scratch) -> DataFrame:
    repeated = flagged.where("perhaps").select("doc_id", "digest", "row")
    groups = repeated.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))  # combined before the shuffle
    # Groups are written, so that rows meet them in a join of its own: broadcast where groups are few, else one whose large partitions are split.
    met = repeated.join(by_size(scratch.table("groups", groups)), "digest").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "digest")
    alone = flagged.where("not perhaps").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return alone.unionByName(met).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The rows of df, all columns, that stay. Rows that the filter says are met once are not moved; of the others those with the largest id of their group are."""
    ship(df.sparkSession)
    scratch, slices = Scratch(df.sparkSession, "exact"), _slices(df.count(), slice_rows)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("given")).withColumns({"digest": text_hash(F.col(f"given.`{text_col}`")), "doc_id": F.col(f"given.`{id_col}`").cast("long")})
    rows = _hashed(rows, slices)
    keys = rows.select("doc_id", "digest", "h1", "h2", "slice")
    keys = scratch.table("hashes", keys.sortWithinPartitions("slice") if slices > 1 else keys)
    bits, chunks = filters(keys, scratch, slice_rows)
    groups = asked(keys, bits, chunks).where("perhaps").groupBy(F.col("digest").alias("g_digest")).agg(F.max("doc_id").alias("keep_id"))
    groups = scratch.table("groups", groups)
    flagged = asked(rows, bits, chunks)
    largest = flagged.where("perhaps").join(groups, (F.col("digest") == F.col("g_digest")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    one = largest.select("digest", "given").dropDuplicates(["digest"])
    return flagged.where("not perhaps").select("given").union(one.select("given")).select(*(F.col(f"given.`{c}`").alias(c) for c in df.columns))


def op13_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


OP13_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
