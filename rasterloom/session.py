"""A session of immutable image handles over one Spark session.

Handles are `img-1`, `img-2`, ...; each is a registered temporary view of pixels. Results of operations are new handles. `StepCache` keeps the
results of steps by content: the key of a result is a digest of its input's key and the operation, so equal work is done
once, and changing a parameter recomputes only what follows it.
"""

from __future__ import annotations

import hashlib
import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .errors import CodecError, PipelineError, SessionError
from .functions.color import Rgba
from .operators import compose, geometry
from .operators.compose import to_pixels8
from .plans.compiler import apply, run
from .plans.spec import Op, Pipeline, Size
from .sources.images import decoded_files, decoded_others, encode_files, format_of, sniff
from .sources.jpeg import MOST
from .sources.tables import ingest


def digest(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


@dataclass
class StepStat:
    """A step of a chain. Of a step that has run: its rows, the seconds that it took beyond the steps before it, and whether storage still held its result, so that nothing of it was computed."""

    name: str
    rows: int | None = None
    seconds: float | None = None
    hit: bool = False


@dataclass
class StepCache:
    """Persisted step results by key, dropped oldest first beyond `most`. Spark's storage spills to disk and recomputes what an executor lost."""

    most: int = 32
    kept: dict[str, DataFrame] = field(default_factory=dict)
    hits: int = 0
    misses: int = 0
    ran: dict[str, int] = field(default_factory=dict)

    def get(self, key: str, make) -> tuple[DataFrame, bool]:
        if key in self.kept:
            self.hits += 1
            self.kept[key] = self.kept.pop(key)  # now the newest
            return self.kept[key], True
        self.misses += 1
        self.kept[key] = df = make().persist()
        while len(self.kept) > self.most:
            oldest = next(iter(self.kept))
            self.kept.pop(oldest).unpersist()
            self.ran.pop(oldest, None)
        return df, False

    def clear(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()
        self.ran.clear()

    def run(self, key: str, name: str) -> StepStat:
        """Computes a kept result, if storage doesn't hold it yet, and says what that took."""
        df, hit, rows = self.kept[key], key in self.ran, Observation()
        began = time.monotonic()
        df.observe(rows, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        self.ran[key] = rows.get["rows"]
        return StepStat(name, self.ran[key], time.monotonic() - began, hit)


@dataclass(frozen=True)
class Handle:
    id: str
    width: int
    height: int
    key: str
    df: DataFrame = field(repr=False, compare=False)

    @property
    def size(self) -> Size:
        return self.width, self.height


class Session:
    def __init__(self, spark: SparkSession, cache: StepCache | None = None):
        self.spark, self.cache = spark, cache or StepCache()
        self.handles: dict[str, Handle] = {}
        self.stats: list[StepStat] = []
        self._next = 1

    def __getitem__(self, handle: str) -> Handle:
        if handle not in self.handles:
            raise SessionError(f"no such image: {handle}")
        return self.handles[handle]

    def add(self, df: DataFrame, size: Size | None = None, key: str | None = None) -> Handle:
        """Registers pixels of one image as a new handle and view."""
        if size is None:
            found = df.agg(F.max("width"), F.max("height")).first()
            if found[0] is None:
                raise SessionError("an image needs at least one pixel")
            size = found[0], found[1]
        name = f"img-{self._next}"
        self._next += 1
        h = Handle(name, *size, key or digest("source", name), df.withColumn("img_id", F.lit(0).cast("long")))
        h.df.createOrReplaceTempView(name.replace("-", "_"))
        self.handles[name] = h
        return h

    def drop(self, handle: str) -> None:
        self.spark.catalog.dropTempView(self[handle].id.replace("-", "_"))
        del self.handles[handle]

    def open_image(self, path: str) -> Handle:
        """Reads a png, jpeg or webp file, told from its content; it is decoded on an executor. The identity of the handle is its content's."""
        files = self.spark.read.format("binaryFile").load(path)
        try:
            row = files.select(F.substring("content", 1, 12).alias("head"), F.sha2("content", 256).alias("digest")).first()
        except Exception as e:
            raise SessionError(f"can't read {path}: {e}") from e
        if row is None:
            raise SessionError(f"can't read {path}")
        kind = sniff(bytes(row["head"]))
        own = F.lit(0).cast("long").alias("img_id")
        found = decoded_files(files.select(own, "path", "content")) if kind != "jpeg" else decoded_others(self.spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*", own))
        size = found.agg(F.max("width"), F.max("height"), F.max("error")).first()
        if size[2] is not None:
            raise CodecError(f"{path}: {size[2]}")
        return self.add(ingest(found.drop("path", "error")), (size[0], size[1]), digest("source", row["digest"]))

    def image_info(self, handle: str) -> dict:
        h = self[handle]
        return {"image_id": h.id, "width": h.width, "height": h.height}

    def apply(self, handle: str, op: str, **params) -> Handle:
        return self.run_pipeline(handle, Pipeline((Op.of(op, **params),)))

    def run_pipeline(self, handle: str, pipeline: Pipeline | str | list | dict, measure: bool = False) -> Handle:
        """Validates the whole chain first, then makes one new handle; each step's result is cached by content. `measure`: runs the steps one after another, each from the result of the one before, and adds what they took to `stats`."""
        h, p = self[handle], pipeline if isinstance(pipeline, Pipeline) else Pipeline.parse(pipeline)
        sizes = p.validate(h.size)
        df, key = h.df, h.key
        for op in p.steps:
            if op.name == "trim":
                return self._trimmed_then(df, key, p, op, measure)
            key = digest(key, op.canonical())
            df, _ = self.cache.get(key, lambda df=df, op=op: apply(df, op))
            self.stats.append(self.cache.run(key, op.name) if measure else StepStat(op.name))
        return self.add(df, sizes[-1] if sizes else h.size, key)

    def _trimmed_then(self, df: DataFrame, key: str, p: Pipeline, op: Op, measure: bool) -> Handle:
        at = p.steps.index(op)
        mid = self._trim(df, key, op["color"], op["tolerance"])
        return self.run_pipeline(mid.id, Pipeline(p.steps[at + 1 :], p.version), measure) if p.steps[at + 1 :] else mid

    def _trim(self, df: DataFrame, key: str, color: Rgba | None, tolerance: float) -> Handle:
        bounds = geometry.content_bounds(df, color, tolerance).first()
        if bounds is None:
            raise SessionError("trim: nothing but background")
        w, h = bounds["right"] - bounds["left"] + 1, bounds["bottom"] - bounds["top"] + 1
        return self.add(geometry.crop(df, bounds["left"], bounds["top"], w, h), (w, h), digest(key, "trim", str(color), str(tolerance)))

    def trim(self, handle: str, color=None, tolerance: float = 0.01) -> Handle:
        return self._trim(self[handle].df, self[handle].key, None if color is None else Rgba.parse(color), tolerance)

    def overlay(self, base: str, top: str, x: int = 0, y: int = 0, opacity: float = 1.0) -> Handle:
        b, t = self[base], self[top]
        return self.add(compose.overlay(b.df, t.df, x, y, opacity), b.size, digest("overlay", b.key, t.key, f"{x},{y},{opacity}"))

    def collage(self, handles: list[str], target_width: int = 1600, row_height: int = 320, gap: int = 12, background="white") -> Handle:
        if not handles:
            raise SessionError("collage: needs at least one image")
        own = [self[h] for h in handles]
        all_of = None
        for i, h in enumerate(own):
            df = h.df.withColumn("img_id", F.lit(i).cast("long"))
            all_of = df if all_of is None else all_of.unionByName(df)
        _, size = compose.collage_layout([h.size for h in own], target_width, row_height, gap)
        out = compose.collage(all_of, list(range(len(own))), target_width, row_height, gap, Rgba.parse(background))
        return self.add(out, size, digest("collage", *(h.key for h in own), f"{target_width},{row_height},{gap},{background}"))

    def diff(self, a: str, b: str, view: str = "difference", threshold: float = 0.0) -> tuple[Handle, dict]:
        """A view as a new handle, and {fraction, max} (both None where sizes differ). `sxs` and `side-by-side` are accepted too."""
        view = {"sxs": "side_by_side", "side-by-side": "side_by_side"}.get(view, view)
        p, q = self[a], self[b]
        if view in ("difference", "heatmap") and p.size != q.size:
            raise SessionError(f"diff: {p.id} is {p.width}x{p.height}, {q.id} is {q.width}x{q.height}")
        stats = compose.diff_stats(p.df, q.df, threshold).first()
        handle = self.add(compose.diff(p.df, q.df, view), None, digest("diff", view, p.key, q.key))
        return handle, {"fraction": stats["fraction"], "max": stats["max_diff"]}

    def export(self, handle: str, path: str, quality: int = 90) -> dict:
        """Writes one image to a local file: {path, bytes}. It is encoded by bands on the executors; the encoded file comes here. For batches: `sources.sink.write_images`."""
        h, kind = self[handle], format_of(path)
        if kind == "jpeg" and max(h.size) > MOST:
            raise CodecError(f"jpeg: width and height are at most {MOST}")
        data = bytes(encode_files(to_pixels8(h.df), kind, quality).first()[kind])
        with open(path, "wb") as f:
            f.write(data)
        return {"path": os.path.abspath(path), "bytes": len(data)}

    def report(self) -> str:
        """A line per step since the session began; steps that nobody measured are planned only."""
        told = lambda s: "planned" if s.seconds is None else f"{s.seconds * 1000:9.1f} ms  {s.rows:12d} rows  {'from storage' if s.hit else 'computed'}"
        return "\n".join(f"{s.name:24} {told(s)}" for s in self.stats)


def run_batch(df: DataFrame, pipeline: Pipeline | str | list | dict, on_error: str = "fail") -> DataFrame:
    """A pipeline over a DataFrame of many images."""
    return run(df, pipeline if isinstance(pipeline, Pipeline) else Pipeline.parse(pipeline), on_error=on_error)


__all__ = ["Handle", "PipelineError", "Session", "StepCache", "run_batch"]
