"""Image files in and out, samples.

PNG and lossless WebP files are decoded and encoded here, jpeg files are decoded by Spark's image source and encoded here; work is dealt out by files when decoding and by bands
of lines when encoding (a WebP image has to fit a task: its format has no parts that can be coded apart).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CodecError
from ..packaging import ship
from . import jpeg
from .png import SIGNATURE, compressed_band, decode_png, encode_png, file_of_bands
from .tables import ingest, with_size
from .webp import decode_webp, encode_webp

__all__ = ["bad_files", "catalog", "decode_png", "decode_pngs", "encode_files", "encode_jpegs", "encode_png", "encode_pngs", "encode_webps", "flatten_alpha", "format_of", "load_images", "read_images", "sample", "sniff"]
C = F.col
PIXELS8 = "img_id long, x int, y int, width int, height int, r8 int, g8 int, b8 int, a8 int"
_NAMES = [c.split()[0] for c in PIXELS8.split(", ")]
_LISTED = PIXELS8 + ", path string, error string"


def format_of(path: str) -> str:
    """The format a file name asks for: png, jpeg or webp; raises CodecError for others."""
    kind = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "webp": "webp"}.get(path.rpartition(".")[2].lower() if "." in path else "")
    if kind is None:
        raise CodecError(f"unknown image format: {path}")
    return kind


def sniff(data: bytes) -> str:
    """The format of encoded bytes."""
    if data[:8] == SIGNATURE:
        return "png"
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    raise CodecError("not a png, jpeg or webp file")


def explode_image(img_id: int, rgba: np.ndarray, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Pixels of one image as rows of PIXELS8, some lines at a time."""
    height, width = rgba.shape[:2]
    step = max(1, most // width)
    for top in range(0, height, step):
        part = rgba[top : top + step]
        n = part.shape[0] * width
        y, x = np.divmod(np.arange(n, dtype=np.int32), np.int32(width))
        fixed = lambda v, t: pa.array(np.full(n, v, t))  # noqa: E731, B023
        columns = [fixed(img_id, np.int64), pa.array(x), pa.array(y + np.int32(top)), fixed(width, np.int32), fixed(height, np.int32), *(pa.array(part[..., c].ravel().astype(np.int32)) for c in range(4))]
        yield pa.RecordBatch.from_arrays(columns, _NAMES)


def _bad(img_id: int, path: str, error: str) -> pa.RecordBatch:
    """The row of a file that can't be decoded."""
    return pa.RecordBatch.from_arrays([pa.array([img_id], pa.int64()), *(pa.nulls(1, pa.int32()) for _ in _NAMES[1:]), pa.array([path]), pa.array([error])], [*_NAMES, "path", "error"])


def _good(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.string()), pa.nulls(batch.num_rows, pa.string())], [*_NAMES, "path", "error"])


def decoded_files(files: DataFrame) -> DataFrame:
    """PIXELS8 and null path and error, from img_id, path, content of png and webp files, told from their content; one row with path and error for each that can't be decoded."""

    own = {"png": decode_png, "webp": decode_webp}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                try:
                    data = data.as_py() or b""
                    if sniff(data) not in own:
                        raise CodecError(f"named otherwise, but it holds {sniff(data)}")
                    rgba = own[sniff(data)](data)
                except CodecError as e:
                    yield _bad(i, path, str(e))
                    continue
                yield from map(_good, explode_image(i, rgba))

    return files.select(C("img_id").cast("long").alias("img_id"), "path", "content").mapInArrow(run, _LISTED)


def decoded_others(files: DataFrame) -> DataFrame:
    """The same from rows of Spark's image source with an img_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if not r["data"]:
                    yield _bad(r["img_id"], r["origin"], "can't be decoded")
                    continue
                px = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                rgba = np.full((r["height"], r["width"], 4), 255, np.uint8)
                rgba[..., :3] = px[..., :1] if r["nChannels"] == 1 else px[..., 2::-1]  # the source gives blue first
                if r["nChannels"] == 4:
                    rgba[..., 3] = px[..., 3]
                yield from map(_good, explode_image(r["img_id"], rgba))

    return files.select("img_id", "width", "height", "nChannels", "data", "origin").mapInArrow(run, _LISTED)


#: Names that Spark's image source is asked for; PNG and WebP files are decoded here, as that source knows neither WebP nor a PNG's 16-bit samples exactly.
_OTHERS = "*.{jpg,jpeg,JPG,JPEG,Jpg,Jpeg,gif,GIF,bmp,BMP}"
_OWN = "*.{png,PNG,Png,webp,WEBP,WebP,Webp}"


def load_images(spark: SparkSession, path: str, img_id: Column | None = None) -> DataFrame:
    """PIXELS8, path, error of all png, webp, jpeg, gif and bmp files at a path: pixels with neither path nor error, and one row with both, without pixels, for each file that can't be decoded. Files are dealt to tasks by their bytes; Spark passes over those without any. `img_id`: an expression of `path`, its hash by default."""
    ship(spark)
    own_id = F.xxhash64("path") if img_id is None else img_id
    own = spark.read.format("binaryFile").option("pathGlobFilter", _OWN).load(path)
    found = decoded_files(own.select(own_id.alias("img_id"), "path", "content"))
    others = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", _OTHERS).load(path).select("image.*")
    return found.unionByName(decoded_others(others.withColumn("path", C("origin")).withColumn("img_id", own_id.cast("long"))))


def read_images(spark: SparkSession, path: str, img_id: Column | None = None, on_error: str = "fail") -> DataFrame:
    """Linear pixels of all image files at a path, decoded on the executors. on_error: `fail` raises CodecError's message for a file that can't be decoded, `quarantine` leaves it out (`bad_files` lists them)."""
    loaded = load_images(spark, path, img_id)
    if on_error == "quarantine":
        loaded = loaded.where(C("error").isNull())
    else:
        told = F.concat(F.lit("can't decode "), F.coalesce("path", F.lit("")), F.lit(": "), F.coalesce("error", F.lit("")))
        loaded = loaded.where(F.when(C("error").isNull(), True).otherwise(F.raise_error(told).cast("boolean")))
    return ingest(loaded.drop("path", "error"))


def bad_files(spark: SparkSession, path: str) -> DataFrame:
    """path, error of files that can't be decoded."""
    return load_images(spark, path).where("error is not null").select("path", "error")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row per image file: origin, width, height, n_channels; pixels are not exploded."""
    return spark.read.format("image").load(path).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("n_channels"))


def banded(pixels8: DataFrame, lines: int, encode: Callable[[np.ndarray], tuple], names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """A row per band of `lines` lines of an image: img_id, band, width, lines, and what `encode` makes of its (lines, width, 4) bytes.

    Bands, not images, are dealt out and sorted, and stream through the tasks: no task holds more than a band. A band with holes raises CodecError.
    """
    ship(pixels8.sparkSession)
    schema = pa.schema([("img_id", pa.int64()), ("band", pa.int32()), ("width", pa.int32()), ("lines", pa.int32()), *zip(names, kinds)])

    def made(key: tuple[int, int], parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        width, n = int(rows[:, 1].max()) + 1, int(rows[:, 0].max()) % lines + 1
        if len(rows) != width * n or (rows[:, 1] != np.arange(len(rows)) % width).any() or rows[0, 0] % lines:
            raise CodecError(f"image {key[0]} has holes in lines {key[1] * lines} to {key[1] * lines + n - 1}")
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, width, n, *encode(rows[:, 2:].reshape(n, width, 4).astype(np.uint8))), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, parts = None, []
        for batch in batches:
            ids, band = (batch.column(i).to_numpy() for i in range(2))
            rows = np.stack([batch.column(i).to_numpy() for i in range(2, 8)], 1)
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (band[1:] != band[:-1])]) if len(ids) else []
            for s, e in zip(starts, [*starts[1:], len(ids)]):
                key = int(ids[s]), int(band[s])
                if key != open_key and parts:
                    yield made(open_key, parts)
                    parts = []
                open_key = key
                parts.append(rows[s:e])
        if parts:
            yield made(open_key, parts)

    whole = pixels8.select(C("img_id").cast("long").alias("img_id"), F.expr(f"cast(y div {lines} as int)").alias("band"), "y", "x", "r8", "g8", "b8", "a8")
    return whole.repartition("img_id", "band").sortWithinPartitions("img_id", "band", "y", "x").mapInArrow(run, spark_schema(schema))


def spark_schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _joined(bands: DataFrame, lines: int, columns: list[str], name: str, join: Callable[[int, int, list], bytes]) -> DataFrame:
    """One encoded file an image, of its bands in order; only encoded bytes of an image meet."""
    images = bands.groupBy("img_id").agg(F.sort_array(F.collect_list(F.struct("band", "width", "lines", *columns))).alias("bands"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = parts.as_py()
                if [p["band"] for p in parts] != list(range(len(parts))) or len({p["width"] for p in parts}) > 1 or any(p["lines"] != lines for p in parts[:-1]):
                    raise CodecError(f"image {i} has holes")
                data = join(parts[0]["width"], sum(p["lines"] for p in parts), [tuple(p[c] for c in columns) for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([data], pa.binary())], ["img_id", name])

    return images.mapInArrow(run, f"img_id long, {name} binary")


def encode_pngs(pixels8: DataFrame, lines: int = 64) -> DataFrame:
    """img_id, png (binary) from img_id, x, y, r8, g8, b8, a8: bands of lines are compressed apart and joined."""
    bands = banded(pixels8, lines, compressed_band, ["data", "total", "size"], [pa.binary(), pa.int64(), pa.int64()])
    return _joined(bands, lines, ["data", "total", "size"], "png", file_of_bands)


def encode_jpegs(pixels8: DataFrame, quality: int = 90) -> DataFrame:
    """img_id, jpeg (binary) from img_id, x, y, r8, g8, b8, a8, by bands of eight lines; translucent pixels are laid over white."""
    bands = banded(pixels8, jpeg.BAND, lambda rgba: (jpeg.coded_band(rgba, quality),), ["data"], [pa.binary()])
    return _joined(bands, jpeg.BAND, ["data"], "jpeg", lambda w, h, parts: jpeg.file_of_bands(w, h, [p[0] for p in parts], quality))


def encode_webps(pixels8: DataFrame, lines: int = 64) -> DataFrame:
    """img_id, webp (binary) from img_id, x, y, r8, g8, b8, a8, lossless. Lines meet in the task that encodes their image."""
    bands = banded(pixels8, lines, lambda rgba: (rgba.tobytes(),), ["data"], [pa.binary()])
    return _joined(bands, lines, ["data"], "webp", lambda w, h, parts: encode_webp(np.frombuffer(b"".join(p[0] for p in parts), np.uint8).reshape(h, w, 4)))


def encode_files(pixels8: DataFrame, kind: str, quality: int = 90) -> DataFrame:
    """img_id and the encoded files in a column named after their kind: png, jpeg or webp."""
    return {"png": lambda: encode_pngs(pixels8), "jpeg": lambda: encode_jpegs(pixels8, quality), "webp": lambda: encode_webps(pixels8)}[kind]()


def decode_pngs(files: DataFrame) -> DataFrame:
    """PIXELS8 rows from img_id, png; a file that can't be decoded raises CodecError."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from explode_image(i, decode_png(data.as_py() or b""))

    return files.select(C("img_id").cast("long").alias("img_id"), "png").mapInArrow(run, PIXELS8)


def flatten_alpha(pixels8: DataFrame) -> DataFrame:
    """What a format without alpha stores: colours over white, in whole numbers and gamma space."""
    return pixels8.select("img_id", "x", "y", *(F.expr(f"cast(({c}8 * a8 + 255 * (255 - a8)) div 255 as int)").alias(f"{c}8") for c in "rgb"))


def sample(spark: SparkSession, width: int = 6000, height: int = 4000, img_id: int = 0) -> DataFrame:
    """8-bit pixels of a test image: gradients, rings and noise that depends on the position only, so any partitioning makes the same image."""
    px = spark.range(width * height).select((C("id") % width).cast("int").alias("x"), F.expr(f"cast(id div {width} as int)").alias("y"), F.pmod(F.xxhash64("id"), F.lit(32)).cast("int").alias("noise"))
    ring = (F.sin(F.sqrt(F.pow(C("x") - width / 2, 2.0) + F.pow(C("y") - height / 2, 2.0)) / 40.0) * 40 + 40).cast("int")
    values = {"r8": F.floor(C("x") * 200 / width) + C("noise"), "g8": F.floor(C("y") * 200 / height) + C("noise"), "b8": ring + C("noise") + 60}
    px = px.select(F.lit(img_id).cast("long").alias("img_id"), "x", "y", *(F.least(v.cast("int"), F.lit(255)).alias(k) for k, v in values.items()), F.lit(255).alias("a8"))
    return with_size(px, width, height)
