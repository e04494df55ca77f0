"""Operator 6: best-fit-decreasing packing of token sequences into bins of fixed capacity.

Lengths are whole numbers up to the capacity, so all that best-fit decreasing needs to know of the corpus is how many
pieces have each length: a histogram of `capacity` counts, summed by Spark. The plan is made from it as if piece by
piece: a segment tree over remaining capacities finds the tightest open bin that takes a piece in logarithmic time, and
runs of equal pieces that meet equal bins are placed together, so the plan's size depends on the capacity and not on
the corpus. A piece then finds its place by its length and its rank among the pieces of that length.

Defined results: a null or empty text is one piece that holds the end id; null ids stay null; repeated rows are packed
each; extra columns are left out; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import REMEMBERED
from .op4_token_records import encoder, slices
from .shared import array_literal, cut, documents, map_arrow, own

#: Pieces in a bucket of the ranking, about; a length has as many buckets as it needs.
BUCKET_ROWS = 1000


class CapacityTree:
    """A segment tree over remaining capacities; a node counts the open bins below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.bins = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        node = remaining + self.size
        while node:
            self.bins[node] += n
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that takes a piece of this length."""
        node = length + self.size
        if self.bins[node]:
            return length
        while node > 1:
            if not node & 1 and self.bins[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.bins[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_decreasing(counts: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """counts[n]: pieces of length n. Rows of (length, first rank, first bin, pieces a bin, offset of a bin's first), and the number of bins.

    Where the tightest bin takes k pieces of the length at hand, best fit puts the next k there one after another, as
    each leaves it the tightest; so k pieces go to each bin of a run of equal ones.
    """
    tree, open_bins, plan, bins = CapacityTree(capacity), {}, [], 0

    def leave(remaining: int, start: int, n: int) -> None:
        if remaining and n:
            open_bins.setdefault(remaining, []).append((start, n))
            tree.add(remaining, n)

    for length in range(capacity, 0, -1):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, k = capacity, capacity // length
                start, n = bins, -(-left // k)
                bins += n
            else:
                k = remaining // length
                start, n = open_bins[remaining].pop()
                tree.add(remaining, -n)
            full = min(n, left // k)
            rest = left - full * k if full < n else 0
            plan.append((length, rank, start, k, capacity - remaining))
            rank, left = rank + full * k + rest, left - full * k - rest
            leave(remaining - k * length, start, full)
            if rest:
                leave(remaining - rest * length, start + full, 1)
            leave(remaining, start + full + (rest > 0), n - full - (rest > 0))
    return np.array(plan, np.int64).reshape(-1, 5), bins


def token_pieces(df: DataFrame, tokenizer_path: str, end_id: int | None = 2, capacity: int = 1024, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Tokens of each text in pieces of at most `capacity`, of which the first may be shorter: doc_id, piece, start, length, ids_crc32, and ids (binary, 4 bytes each) if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path, remembered).encode, np.array([end_id] if end_id is not None else [], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids += end
                    start, stop, piece = 0, (len(ids) // 4 - 1) % capacity + 1, 0
                    while start < len(ids) // 4:
                        own_ids = ids[4 * start : 4 * stop]
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(own_ids), *([own_ids] if keep_ids else [])))
                        start, stop, piece = stop, stop + capacity, piece + 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if keep_ids else []))
                columns = list(zip(*rows)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(types)])

    return map_arrow(own(df, id_col, text_col), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, piece, length and ids_crc32. Reads `pieces` more than once: hand over a written table or a checkpoint."""
    counts = [0] * (capacity + 1)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
        counts[length] = n
    plan, _ = best_fit_decreasing(counts, capacity)
    # Rank among the pieces of a length: ranked within buckets, after the buckets before.
    n_buckets = F.get(array_literal(n // BUCKET_ROWS + 1 for n in counts), F.col("length").cast("int"))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), n_buckets))
    before = bucketed.groupBy("length", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = bucketed.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within")).drop("bucket", "before", "within")
    names = [*pieces.columns, "sequence_id", "offset"]
    keys = plan[:, 0] << 40 | plan[:, 1]
    order = np.argsort(keys)
    keys, plan = keys[order], plan[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, length << 40 | rank, "right") - 1]
            step, nth = np.divmod(rank - row[:, 1], row[:, 3])
            columns = {x: batch.column(x) for x in names[:-2]} | {"sequence_id": pa.array(row[:, 2] + step), "offset": pa.array(row[:, 4] + nth * length)}
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int | None = 2, capacity: int = 1024, keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Tokenizes, cuts and packs (remembered: bytes of a worker's memory of pieces): doc_id long, piece int, start, length, ids_crc32, sequence_id, offset long."""
    return pack(cut(token_pieces(df, tokenizer_path, end_id, capacity, keep_ids, remembered=remembered)), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
