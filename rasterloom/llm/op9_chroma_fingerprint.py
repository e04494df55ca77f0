"""Operator 9: chroma audio fingerprints of a media column, and alignment of recordings.

A recording's samples are cut into overlapping frames of the same duration at every sample rate, long enough to part
semitones; a frame's spectrum is folded into twelve pitch classes. Sixteen rectangle filters over a few frames and classes,
answered in constant time from an integral image, give two bits each: one packed 32-bit integer per position. Recordings that share an index key are aligned by the histogram of
position differences, and the bit errors along the overlap at the best difference tell how alike they are. A key is the signs
of all filters at three positions, `STEP` apart (in short recordings also at two): less easily changed by noise than an integer, and far less often shared by
recordings that have nothing else in common. Of a run of equal keys the first counts, and silence doesn't count. This is an index: tests measure its recall.
Two recordings that share a stretch share all of its keys at one difference: the join gives a row where such a stretch starts, not one per key. The histogram
over all keys of a pair is counted per pair, at the differences found so.

Recordings with equal fingerprints are one class from the start, so copies are compared once.

Defined results: null or empty media have no integers and match nothing; media that can't be read (damaged or unknown
files) neither, and say why in `error`; shorter media than one fingerprint window are padded with silence; the shorter an overlap, the fewer errors it may have
(`allowed`): below ten positions, where unrelated recordings may be equal by chance, media match as copies only; queries are ids for which `query` holds; repeated rows each get a row; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..packaging import ship
from .shared import Scratch, bit_set, documents, in_bit_set

#: Samples a second of raw media, seconds of a frame (4096 samples at that rate), frames of a fingerprint window, and samples that are worked on at once, about.
RATE, SECONDS, SPAN, AT_ONCE = 11025, 4096 / 11025, 8, 1 << 22
#: Least and greatest frequency that counts, in Hz.
LOW, HIGH = 60.0, 3520.0
#: Greatest share of differing bits of a match, and the least share of the shorter recording that the overlap covers, in percent.
MOST_ERRORS, LEAST_OVERLAP = 0.15, 50
#: Share of bits in which unrelated recordings differ, and the positions of an overlap from which MOST_ERRORS is far enough below it.
UNRELATED, SURE_POSITIONS = 0.3, 40
#: Positions of the shortest overlap that may be a match: `allowed` is negative below.
LEAST_POSITIONS = 10
#: Positions between those of a key, and positions of a recording below which keys of two positions are added to those of three: short ones have few chances for a key without an error.
STEP, SHORT = 2, 40


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the rectangle filters, by a rule: kinds in turn over heights and widths."""
    heights, widths = (12, 6, 4, 3), (8, 4, 6, 2)
    return [(i % 6, 3 * i % (13 - heights[i // 4]), heights[i // 4], widths[(i + i // 4) % 4]) for i in range(16)]


def frame_of(rate: int) -> tuple[int, int]:
    """Samples of a frame and between the starts of frames."""
    hop = max(4, round(SECONDS * rate / 4))
    return 4 * hop, hop


def samples(media: bytes, width: int = 1, rate: int = RATE) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1 and their rate, of a WAV file's bytes (channels averaged) or of raw PCM: unsigned 8-bit, or signed little-endian of 2, 3 or 4 bytes. Raises ValueError for what can't be read."""
    channels = 1
    if media[:4] == b"RIFF" and media[8:12] == b"WAVE":
        try:
            with wave.open(io.BytesIO(media)) as w:
                channels, width, rate, media = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
        except (wave.Error, EOFError, struct.error) as e:
            raise ValueError(f"WAV: {e}") from e
    if width not in (1, 2, 3, 4) or channels < 1 or not 100 <= rate <= 1_000_000:
        raise ValueError(f"{width} bytes a sample, {channels} channels, {rate} samples a second")
    media = media[: len(media) // (width * channels) * width * channels]
    if width == 1:
        x = (np.frombuffer(media, np.uint8).astype(np.float32) - 128) / 128
    else:
        if width == 3:  # as the upper three bytes of four
            wide = np.zeros((len(media) // 3, 4), np.uint8)
            wide[:, 1:] = np.frombuffer(media, np.uint8).reshape(-1, 3)
            media, width = wide.tobytes(), 4
        x = np.frombuffer(media, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    return (x.reshape(-1, channels).mean(1) if channels > 1 else x), rate


def chroma_matrix(rate: int = RATE) -> np.ndarray:
    frame, _ = frame_of(rate)
    f = np.arange(frame // 2 + 1) * rate / frame
    out = np.zeros((len(f), 12), np.float32)
    use = (f >= LOW) & (f <= HIGH)
    out[np.flatnonzero(use), np.round(12 * np.log2(f[use] / 440)).astype(int) % 12] = 1
    return out


def chroma(buffer: np.ndarray, rate: int, matrix: np.ndarray) -> np.ndarray:
    """Pitch-class energies of frames, each of unit length; of silent frames 0."""
    frame, hop = frame_of(rate)
    window = np.hanning(frame).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(buffer, frame)[::hop]
    out = np.empty((len(frames), 12), np.float32)
    rows = max(1, (2 << 20) // frame)
    for s in range(0, len(frames), rows):
        x = frames[s : s + rows]
        x = (x - x.mean(1, keepdims=True)) * window
        out[s : s + rows] = (np.abs(np.fft.rfft(x)) ** 2) @ matrix
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def packed_integers(image: np.ndarray) -> np.ndarray:
    """One integer for each position at which SPAN frames start."""
    n = len(image) - SPAN + 1
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.astype(np.float64).cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return integral[at + t1, y1] - integral[at + t0, y1] - integral[at + t1, y0] + integral[at + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        all_of = area(0, w, y, y + h)
        if kind == 0:
            a, b = all_of, area(0, w, 0, 12) * (h / 12) if h < 12 else area(SPAN - w, SPAN, y, y + h) if w < SPAN else np.full(n, 2.3 * w)
        elif kind == 1:
            a = area(0, w, y + h // 2, y + h)
            b = area(0, w, y, y + h // 2)
        elif kind == 2:
            a = area(w // 2, w, y, y + h)
            b = area(0, w // 2, y, y + h)
        elif kind == 3:
            a = area(0, w // 2, y + h // 2, y + h) + area(w // 2, w, y, y + h // 2)
            b = all_of - a
        elif kind == 4:
            a = area(0, w, y + h // 3, y + h - h // 3) * 2
            b = area(0, w, y, y + h // 3) + area(0, w, y + h - h // 3, y + h)
        else:
            a = area(w // 3, w - w // 3, y, y + h) * 2
            b = area(0, w // 3, y, y + h) + area(w - w // 3, w, y, y + h)
        answer = np.log((1 + a) / (1 + b))
        level = (answer > -0.1).astype(np.uint32) + (answer > 0) + (answer > 0.1)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))  # neighbouring levels differ in one bit
    return out


def prints_of(recordings: list[np.ndarray], rate: int, matrix: np.ndarray) -> list[np.ndarray]:
    """The integers of recordings of one rate; none of one without samples."""
    frame, hop = frame_of(rate)
    parts, starts, counts, at = [], [], [], 0
    for x in recordings:
        size = max((SPAN - 1) * hop + frame, -(-len(x) // hop) * hop + frame - hop) if len(x) else 0
        parts.append(np.pad(x, (0, size - len(x))))
        starts.append(at // hop)
        counts.append((size - frame) // hop + 1 - SPAN + 1 if size else 0)
        at += size
    codes = packed_integers(chroma(np.concatenate(parts), rate, matrix)).view(np.int32) if at else np.empty(0, np.int32)
    return [codes[s : s + n] for s, n in zip(starts, counts)]


def fingerprints(df: DataFrame, id_col: str, media_col: str, width: int = 1, rate: int = RATE) -> DataFrame:
    """doc_id, class_key binary (digest of the integers), prints array<int>, error string; media without integers have no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices: dict[int, np.ndarray] = {}

        def batch_of(ids: list, read: list[tuple[np.ndarray, int]], errors: list) -> pa.RecordBatch:
            prints: list[np.ndarray] = [np.empty(0, np.int32)] * len(read)
            for r in {r for _, r in read}:
                own = [i for i, x in enumerate(read) if x[1] == r]
                for i, p in zip(own, prints_of([read[i][0] for i in own], r, matrices.setdefault(r, chroma_matrix(r)))):
                    prints[i] = p
            keys = [hashlib.blake2b(p.tobytes(), digest_size=16).digest() if len(p) else None for p in prints]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(prints, pa.list_(pa.int32())), pa.array(errors, pa.string())], _PRINTS)

        for batch in batches:
            ids, read, errors, held = [], [], [], 0
            for i in range(batch.num_rows):
                media, error = batch.column(1)[i].as_py(), None
                try:
                    x = samples(media, width, rate) if media else (np.empty(0, np.float32), rate)
                except ValueError as e:
                    x, error = (np.empty(0, np.float32), rate), str(e)
                ids.append(batch.column(0)[i].as_py()), read.append(x), errors.append(error)
                held += len(x[0])
                if held >= AT_ONCE:
                    yield batch_of(ids, read, errors)
                    ids, read, errors, held = [], [], [], 0
            if ids:
                yield batch_of(ids, read, errors)

    ship(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{media_col}`").cast("binary").alias("media"))
    return rows.mapInArrow(run, "doc_id long, class_key binary, prints array<int>, error string")


_PRINTS = ["doc_id", "class_key", "prints", "error"]


def signs(codes: np.ndarray) -> np.ndarray:
    """Of each integer the 16 bits that say whether a filter's answer is above 0."""
    u, out = codes.view(np.uint32), np.zeros(len(codes), np.int64)
    for k in range(15, -1, -1):
        out = out << 1 | (u >> np.uint32(2 * k + 1) & np.uint32(1))
    return out


def index_keys(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys, and keys, of the integers of recordings one after another; row: the recording of each, ascending."""
    s, still = signs(codes), int(signs(packed_integers(np.zeros((SPAN, 12), np.float32)))[0])
    lengths = np.bincount(row) if len(row) else np.zeros(0, np.int64)
    places, keys = [], []
    for taken, tag in ((3, 0), (2, 1 << 62)):
        n, silence = max(0, len(codes) - (taken - 1) * STEP), 0
        key = np.full(n, tag, np.int64)
        for i in range(taken):
            key |= s[i * STEP : i * STEP + n] << 16 * (taken - 1 - i)
            silence |= still << 16 * (taken - 1 - i)
        use = (row[:n] == row[(taken - 1) * STEP : (taken - 1) * STEP + n]) & (key != (silence | tag))
        use[1:] &= (key[1:] != key[:-1]) | (row[1:n] != row[: n - 1]) if n else True
        if tag:
            use &= lengths[row[:n]] < SHORT
        places.append(np.flatnonzero(use))
        keys.append(key[places[-1]])
    at = np.concatenate(places)
    order = np.argsort(at, kind="stable")
    return at[order], np.concatenate(keys)[order]


def keyed(classes: DataFrame) -> DataFrame:
    """classes and keys array<long>, at array<int>: keys and their places; none of recordings in which no overlap is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                prints = part.column("prints")
                lengths = prints.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(lengths)), lengths)
                within = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                at, key = index_keys(prints.flatten().to_numpy(), row)
                enough = lengths[row[at]] >= LEAST_POSITIONS
                at, key = at[enough], key[enough]
                offsets = pa.array(np.searchsorted(row[at], np.arange(len(lengths) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((key, pa.int64()), (within[at], pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, "keys", "at"])

    return classes.mapInArrow(run, StructType([*classes.schema.fields, StructField("keys", ArrayType(LongType())), StructField("at", ArrayType(IntegerType()))]))


def postings(classes: DataFrame) -> DataFrame:
    """node long, asks boolean, n int (positions), key long, at int, before long (hash of the recording's key before it and of how far that is; null where there is none): a row per key."""
    before = lambda i: F.when(i > 0, F.xxhash64(F.get("keys", i - 1), F.get("at", i) - F.get("at", i - 1)))
    entries = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.get("at", i).alias("at"), before(i).alias("before")))
    return classes.where(F.size("keys") > 0).select("node", "asks", F.size("prints").alias("n"), F.inline(entries))


def allowed(overlap: Column) -> Column:
    """Greatest share of errors of a match over an overlap of some positions: as many standard deviations below what unrelated recordings have as MOST_ERRORS is at SURE_POSITIONS, and MOST_ERRORS beyond. Negative, so never met, where that many lie below nothing."""
    return F.least(F.lit(MOST_ERRORS), UNRELATED - (UNRELATED - MOST_ERRORS) * F.sqrt(F.lit(float(SURE_POSITIONS)) / F.greatest(overlap, F.lit(1))))


def align(df: DataFrame, query: Column, id_col: str = "doc_id", media_col: str = "media", width: int = 1, rate: int = RATE) -> DataFrame:
    """Membership and matches. Each row of df: doc_id, class_id (least id with the same fingerprint), n_prints, error. Each match of a class with a
    query (`query` over doc_id) and another class, both by class_id: doc_id null, class_id, match_id, shift (position in match_id less
    position in class_id), hits, overlap long, errors double (share of bits)."""
    scratch = Scratch(df.sparkSession, "media")
    found = scratch.table("prints", fingerprints(df, id_col, media_col, width, rate))
    classes = found.where("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.max(F.coalesce(query, F.lit(False))).alias("asks"), F.first("prints").alias("prints"))
    classes = scratch.table("classes", keyed(classes.withColumn("node", F.monotonically_increasing_id())))
    scratch.drop()
    post = postings(classes)
    asked = post.where("asks").select("key", F.col("node").alias("q"), F.col("n").alias("q_n"), F.col("at").alias("q_at"), F.col("before").alias("q_before"))
    met = asked.join(post.select("key", F.col("node").alias("m"), F.col("n").alias("m_n"), F.col("asks").alias("m_asks"), F.col("at").alias("m_at"), "before"), "key")
    met = met.where("q <> m and (not m_asks or q < m)")  # a pair of asking classes once
    # Differences at which the two don't overlap far enough are left out at once.
    common = F.least("q_at", "m_at") + F.least(F.col("q_n") - F.col("q_at"), F.col("m_n") - F.col("m_at"))
    met = met.where((common >= LEAST_POSITIONS) & (100 * common >= LEAST_OVERLAP * F.least("q_n", "m_n")))
    starts = met.where(~F.coalesce(F.col("q_before") == F.col("before"), F.lit(False)))
    # No more differences than the two recordings have positions.
    candidates = scratch.table("candidates", starts.groupBy("q", "m").agg(F.collect_set(F.col("m_at") - F.col("q_at")).alias("shifts")))
    scratch.drop()
    placed = F.transform("keys", lambda k, i: F.xxhash64(k, F.get("at", i)))
    # Of classes that met no other nothing moves.
    meeting = [classes.where(in_bit_set(bit_set(candidates.select(F.col(side).alias("node")), "node"), "node")) for side in ("q", "m")]
    keys = candidates.join(meeting[0].select(F.col("node").alias("q"), "keys", "at"), "q").join(meeting[1].select(F.col("node").alias("m"), placed.alias("placed")), "m")
    hits = lambda shift: F.size(F.array_intersect(F.transform("keys", lambda k, i: F.xxhash64(k, F.get("at", i) + shift)), "placed"))
    best = F.array_max(F.transform("shifts", lambda x: F.struct(hits(x).cast("long").alias("hits"), (-F.abs(x)).alias("near"), x.alias("shift"))))
    best = scratch.table("best", keys.select("q", "m", best.alias("best")).select("q", "m", "best.shift", "best.hits"))
    scratch.drop("candidates")
    of = lambda node, some: some.select(F.col("node").alias(node), F.col("class_id").alias(f"id_{node}"), F.col("prints").alias(f"prints_{node}"))
    pairs = best.join(of("q", meeting[0]), "q").join(of("m", meeting[1]), "m")
    from_q, from_m = F.greatest(F.lit(0), -F.col("shift")), F.greatest(F.lit(0), F.col("shift"))
    overlap = F.least(F.size("prints_q") - from_q, F.size("prints_m") - from_m)
    differing = F.aggregate(F.zip_with(F.slice("prints_q", from_q + 1, overlap), F.slice("prints_m", from_m + 1, overlap), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    null = lambda kind: F.lit(None).cast(kind)
    measured = pairs.select(null("long").alias("doc_id"), F.col("id_q").alias("class_id"), null("long").alias("n_prints"), null("string").alias("error"), F.col("id_m").alias("match_id"), F.col("shift").cast("long").alias("shift"), "hits", overlap.cast("long").alias("overlap"), (differing / (32.0 * overlap)).alias("errors"), F.least(F.size("prints_q"), F.size("prints_m")).alias("shorter"))
    matched = measured.where((F.col("errors") <= allowed(F.col("overlap"))) & (100 * F.col("overlap") >= LEAST_OVERLAP * F.col("shorter"))).drop("shorter")
    nothing = [null(t).alias(c) for c, t in (("match_id", "long"), ("shift", "long"), ("hits", "long"), ("overlap", "long"), ("errors", "double"))]
    members = found.select("doc_id", "class_key", F.size("prints").cast("long").alias("n_prints"), "error").join(classes.select("class_key", "class_id"), "class_key", "left").select("doc_id", "class_id", "n_prints", "error", *nothing)
    return members.union(matched)


#: Samples a second that the query takes a text's bytes to be: frames are 256 bytes then, and texts of all lengths have some.
TEXT_RATE = 689


def op9_chroma_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables hold no audio; the bytes of each document's text are taken as 8-bit PCM samples of a low rate, which gives recordings of all lengths with copies, near copies and shared passages."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("media"))
    return align(docs, F.col("doc_id") % 50 == 0, rate=TEXT_RATE)
