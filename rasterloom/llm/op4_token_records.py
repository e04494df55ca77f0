"""Operator 4: token ids as length-delimited binary records with an offset index.

A data file is a row of frames. A frame is: length of the payload (8 bytes, little-endian), masked CRC-32 of those 8
bytes (4 bytes), payload, masked CRC-32 of the payload (4 bytes). The mask turns a checksum right by 15 bits and adds a
constant, so that a checksum over data that holds checksums stays meaningful. The payload is: flags (1 byte; 1: the id
is null), width of a token id in bytes (1 byte), document id (8 bytes, signed), token ids. Beside `X.rec` lies `X.idx`:
per record the frame's offset (8 bytes, unsigned) and the document id (8 bytes, signed), for shuffled reads.

Each task writes its range of document ids to files of about `ROLL` bytes, whose names no other attempt uses; the manifest, written as Parquet
after all tasks, names the files of the attempts that count, so retried or speculative attempts leave no trace in it.

Defined results: null or empty texts hold the end id alone; null document ids come first and stay null; repeated rows
each get a record (in order of a hash of their text); extra columns are left out; an empty table gives no records.
"""

from __future__ import annotations

import random
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import REMEMBERED, Chunks
from .shared import documents, fresh_dir, map_arrow, own

#: Fixed values of the file format.
_MASK, _HEAD, _PAYLOAD = 0xA282EAD8, struct.Struct("<QI"), struct.Struct("<BBq")
_INDEX = [("offset", "<u8"), ("doc_id", "<i8")]

_INNER_SPACE = re.compile(r"[\s\x1c-\x1f\x85]")
#: A word of Latin letters, a space or line feed before it and ASCII marks after it (but apostrophes), and how a byte-level tokenizer that parts these splits such a text.
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_MARKED = re.compile(rf"([ \n]?)([{_LATIN}]+)([!-&(-/:-@\[-`{{-~]*)")
_SPACE, _FEED = "Ġ", "Ċ"
_PROBE, _PROBE_PARTS = " ab.,;:!? Ab! a$_~\nC,\nd", [f"{_SPACE}ab", ".,;:!?", f"{_SPACE}Ab", "!", f"{_SPACE}a", "$_~", _FEED, "C", ",", _FEED, "d"]


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def record(doc_id: int | None, width: int, ids: bytes) -> bytes:
    """The frame of a document's token ids."""
    return frame(_PAYLOAD.pack(doc_id is None, width, doc_id or 0) + ids)


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs) and the path in it."""
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


#: Bytes after which a task starts another data file.
ROLL = 128 << 20


@cache
def encoder(tokenizer_path: str, remembered: int = REMEMBERED) -> Chunks:
    """One per Python worker: the library's own encoding, special tokens' strings included, of pieces that it is asked for once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    t.no_padding(), t.no_truncation()
    feed = t.encode("\n", add_special_tokens=False).ids
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    unfit = re.compile("|".join([_INNER_SPACE.pattern, *map(re.escape, special)]))

    def each(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for s in range(0, len(texts), 10_000) for e in t.encode_batch_fast(texts[s : s + 10_000], add_special_tokens=False)]

    def encode_pieces(chunks: list[str]) -> list[bytes]:
        """Pieces without white space but a leading space, and without the string of an added token, go many to a text, a line each: no token spans a line feed, so its id parts them."""
        plain = [i for i, x in enumerate(chunks) if len(feed) == 1 and x and (x[0] == " " or not x[0].isspace()) and not unfit.search(x, x[0] == " ")]
        out = [b""] * len(chunks)
        lines = [[chunks[i] for i in plain[s : s + 200]] for s in range(0, len(plain), 200)]
        at = 0
        for block, ids in zip(lines, each(["\n".join(x) for x in lines])):
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == feed[0])).tolist()
            for start, end in zip([0, *(x + 4 for x in ends)], [*ends, len(raw)], strict=True):
                out[plain[at]] = raw[start:end]
                at += 1
        others = sorted(set(range(len(chunks))).difference(plain))  # few
        for i, ids in zip(others, each([chunks[i] for i in others])):
            out[i] = ids.tobytes()
        return out

    tokenize = t.model.tokenize

    def packed(pretoken: str) -> bytes:
        ids = [x.id for x in tokenize(pretoken)]
        return struct.pack(f"<{len(ids)}I", *ids)

    of_marks = lru_cache(1000)(packed)
    spelled = lambda text: [x for x, _ in t.pre_tokenizer.pre_tokenize_str(text)]
    plainly = t.normalizer is None and t.pre_tokenizer is not None and spelled(_PROBE) == _PROBE_PARTS
    # No added token is all of letters before marks, so none is in such a piece.
    plainly = plainly and not any(re.fullmatch(rf"[ \n]?[{_LATIN}]*[^\w\s]*_*[^\w\s]*", x) for x in special)
    if not plainly:
        return Chunks(encode_pieces, remembered)
    letters = {i: spelled(chr(i))[0] for i in range(0xC0, 0x100) if chr(i).isalpha()}

    def encode(chunks: list[str]) -> list[bytes]:
        """A word of letters, and marks after it, are pretokens as they are, so the library's model is asked for them at once, without its search for pretokens."""
        out, others = [b""] * len(chunks), []
        for i, x in enumerate(chunks):
            if m := _MARKED.fullmatch(x):
                before, word, marks = m.groups()
                word = word if word.isascii() else word.translate(letters)
                ids = packed(_SPACE + word) if before == " " else of_marks(_FEED) + packed(word) if before else packed(word)
                out[i] = ids + of_marks(marks) if marks else ids
            else:
                others.append(i)
        for i, ids in zip(others, encode_pieces([chunks[i] for i in others])):
            out[i] = ids
        return out

    return Chunks(encode, remembered)


def slices(batch: pa.RecordBatch, rows: int = 1000, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices that bound what a task holds as Python objects: by rows, and by the bytes of the batch a row has on average."""
    rows = max(1, min(rows, most * batch.num_rows // max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


class _Writer:
    """Data files of one task, each with its index, which is written as records are."""

    def __init__(self, folder: str, number: int):
        self.fs, self.folder = file_system(folder)
        self.number, self.data, self.done = number << 20, None, []

    def add(self, doc_id: int | None, width: int, ids: bytes) -> None:
        if self.data is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.name, self.at, self.records, self.tokens = f"part-{self.number:014d}-{uuid.uuid4().hex}", 0, 0, 0
            self.data, self.index = (self.fs.open_output_stream(f"{self.folder}/{self.name}.{x}") for x in ("rec", "idx"))
        f = record(doc_id, width, ids)
        self.data.write(f)
        self.index.write(struct.pack("<Qq", self.at, doc_id or 0))
        self.at, self.records, self.tokens = self.at + len(f), self.records + 1, self.tokens + len(ids) // width
        if self.at >= ROLL:
            self.close()

    def close(self) -> None:
        if self.data is not None:
            self.data.close(), self.index.close()
            self.done.append((self.number, self.name, self.records, self.tokens))
            self.data, self.number = None, self.number + 1


def write_records(df: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes records in ascending order of document ids to path/data, and the manifest to path/manifest: file long, name string, n_records long, n_tokens long. Raises ValueError for an id that `width` bytes can't hold."""
    data = f"{path}/data"
    kind, limit = {2: "<u2", 4: "<u4"}[width], 1 << 8 * width
    if end_id is not None and not 0 <= end_id < limit:
        raise ValueError(f"id {end_id} doesn't fit {width} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(tokenizer_path).encode, np.array([end_id] if end_id is not None else [], kind).tobytes()
        out = _Writer(data, TaskContext.get().partitionId())
        for batch in batches:
            for part in slices(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids = np.frombuffer(ids, "<u4")
                    if len(ids) and int(ids.max()) >= limit:
                        raise ValueError(f"id {int(ids.max())} doesn't fit {width} bytes")
                    out.add(doc_id, width, ids.astype(kind).tobytes() + end)
        out.close()
        if out.done:
            yield pa.RecordBatch.from_pydict(dict(zip(("file", "name", "n_records", "n_tokens"), zip(*out.done))))

    order = F.asc_nulls_first("doc_id"), F.xxhash64("text")  # the second key spreads rows of one id
    ordered = own(df, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    map_arrow(ordered, run, "file long, name string, n_records long, n_tokens long").write.parquet(f"{path}/manifest")


def frames(stream) -> Iterator[bytes]:
    """The payloads of a data file, one at a time; raises ValueError where a checksum differs or the file ends too soon."""
    at = 0
    while head := stream.read(_HEAD.size):
        length, crc = _HEAD.unpack(head) if len(head) == _HEAD.size else (0, -1)
        if crc != masked(head[:8]):
            raise ValueError(f"damaged record at offset {at}")
        body = stream.read(length + 4)
        if len(body) != length + 4 or struct.unpack_from("<I", body, length)[0] != masked(body[:length]):
            raise ValueError(f"damaged record at offset {at}")
        yield body[:length]
        at += _HEAD.size + length + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Reads all records, frame by frame, verifying checksums: file long, record long, doc_id long, ids binary (little-endian unsigned 32-bit)."""
    data = f"{path}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(data)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["file", "record", "doc_id", "ids"])
        for batch in batches:
            for number, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(f"{folder}/{name}.rec", buffer_size=1 << 20) as f:
                    rows, held = [], 0
                    for nth, payload in enumerate(frames(f)):
                        rows.append((number, nth, *_record(payload)))
                        held += len(payload)
                        if len(rows) >= 500 or held >= 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    manifest = spark.read.parquet(f"{path}/manifest").select("file", "name")
    return manifest.repartition(max(1, min(manifest.count(), 100_000)), "file").mapInArrow(run, "file long, record long, doc_id long, ids binary")


def _record(payload: bytes) -> tuple[int | None, bytes]:
    null, width, doc_id = _PAYLOAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_PAYLOAD.size).astype("<u4").tobytes()


def shuffled_read(path: str, name: str, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of one file in a shuffled order, by its index."""
    fs, folder = file_system(f"{path}/data")
    with fs.open_input_file(f"{folder}/{name}.idx") as f:
        offsets = np.frombuffer(f.read(), _INDEX)["offset"].tolist()  # at most ROLL bytes of records
    random.Random(seed).shuffle(offsets)
    with fs.open_input_file(f"{folder}/{name}.rec") as f:
        for at in offsets:
            f.seek(at)
            doc_id, ids = _record(next(frames(f)))
            yield doc_id, np.frombuffer(ids, "<u4")


def with_starts(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Digests of the records read: doc_id, start, n_tokens, ids_crc32 long. Where a file starts comes from the manifest, a row per file; within a file, from the records before."""
    # One task orders the manifest: a row per file of ROLL bytes, a millionth of the data.
    starts = manifest.select("file", (F.sum("n_tokens").over(Window.orderBy("file")) - F.col("n_tokens")).alias("file_start"))
    own_tokens = (F.length("ids") / 4).cast("long")
    narrow = records.select("file", "record", "doc_id", own_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("record")) - F.col("n_tokens")
    return narrow.withColumn("within", within).join(starts, "file").select("doc_id", (F.col("file_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_dir(spark, "token-records")
    write_records(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return with_starts(read_records(spark, path), spark.read.parquet(f"{path}/manifest"))
