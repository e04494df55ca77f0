"""Operator 3: byte-level BPE encoding and decoding of whole texts.

Each match of the pretoken pattern is encoded separately (see `bpe`), as the tiktoken library does without special tokens.

Defined results: a null or empty text has no ids and decodes to nothing; a null id stays null; repeated rows each get a
row; extra columns are left out; an empty table gives an empty result. A task holds one Arrow batch of texts and a
bounded memory of encoded pieces, so long texts need memory in proportion to their own length only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import Codec, read_ranks
from .shared import documents, own


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker; its memory of pieces lasts over tasks."""
    return Codec(read_ranks(path), pattern)


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(ranks_path, pattern).encode
        for batch in batches:
            for part in _parts(batch):
                ids = [np.frombuffer(x, "<i4") for x in encode(part.column(1).to_pylist())]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4")
                values = np.concatenate(ids) if ids else np.empty(0, "i4")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])

    return own(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id long, decoded binary; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(ranks_path, pattern).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes the ids, and returns digests of both without moving the ids: doc_id, n_tokens long, ids_sha256, decoded_sha256 string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for part in _parts(batch):
                counts, ids_sha, decoded_sha = [], [], []
                for encoded in c.encode(part.column(1).to_pylist()):
                    ids = np.frombuffer(encoded, "<u4").tolist()
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return own(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _parts(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices that bound what a task holds as Python objects."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
