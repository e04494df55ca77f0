"""Bucket counts and bitmaps of hashes, counted where the rows are and merged by chunk.

A bucket is a place in a bitmap of `bits` bits (a power of two). Each task counts the buckets of its own rows and sends, per chunk of
65,536 buckets, the offsets that it met and their counts; counts stop at the threshold, so a byte holds them. Chunks are dealt out to
tasks and added up there: no task, and never the driver, holds counts of all buckets. What comes out is a bit per bucket, set where the
count reached the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_arrow

CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS
SPARSE = "chunk int, offsets binary, counts binary"
DENSE = "chunk int, bits array<long>"


def power_of_two(n: int, least: int = 1, most: int = 1 << 62) -> int:
    """The least power of two from n on, between two others."""
    return min(most, max(least, 1 << max(0, int(n) - 1).bit_length()))


def sparse_counts(buckets: np.ndarray, threshold: int) -> pa.RecordBatch:
    """Counts of the buckets met, up to the threshold (255 at most), a row per chunk."""
    met, counts = np.unique(buckets.astype(np.uint64), return_counts=True)
    counts = np.minimum(counts, threshold).astype(np.uint8)
    chunk = (met >> np.uint64(CHUNK_BITS)).astype(np.int32)
    offsets = (met & np.uint64(CHUNK - 1)).astype("<u2")
    starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(met) else np.empty(0, int)
    ends = np.r_[starts[1:], len(met)] if len(met) else starts
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk[starts], pa.int32()), pa.array([offsets[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()), pa.array([counts[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())],
        ["chunk", "offsets", "counts"],
    )


def merged(sparse: DataFrame, threshold: int) -> DataFrame:
    """chunk int, bits array<long>: the bits of the buckets whose counts add up to the threshold; chunks without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, offsets, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total = totals.setdefault(chunk, np.zeros(CHUNK, np.uint8))
                at = np.frombuffer(offsets, "<u2")
                total[at] = np.minimum(total[at].astype(np.uint16) + np.frombuffer(counts, np.uint8), threshold).astype(np.uint8)
        for chunk, total in totals.items():
            if (full := total >= threshold).any():
                bits = np.packbits(full, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([bits], pa.list_(pa.int64()))], ["chunk", "bits"])

    if not 1 <= threshold <= 255:
        raise ValueError("a threshold is a number from 1 to 255")
    return map_arrow(sparse.repartition("chunk"), run, DENSE)


def gathered(dense: DataFrame, bits: int) -> np.ndarray:
    """The whole bitmap as bytes, on the driver: bits / 8 of them, whatever the rows are."""
    out = np.zeros(bits // 64, "<i8")
    found = dense.select("chunk", "bits").toArrow()
    for chunk, values in zip(found.column(0).to_pylist(), found.column(1)):
        out[chunk * (CHUNK // 64) : (chunk + 1) * (CHUNK // 64)] = values.values.to_numpy()
    return out.view(np.uint8)


def is_set(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[(buckets >> np.uint64(3)).astype(np.int64)] >> (buckets & np.uint64(7)).astype(np.uint8)) & 1 == 1
