"""Operations on two or more images: overlay, diff, collage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PipelineError, SessionError
from ..functions.color import Rgba, decode_value, encode8
from ..packaging import ship
from .geometry import KEYS, grid, images
from .stencil import resize_to

C = F.col
VIEWS = ("difference", "heatmap", "side_by_side")
#: Gap between the two halves of a side-by-side view, and its background.
SIDE_GAP, SIDE_BACKGROUND = 8, (20, 20, 20)


def to_pixels8(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Straight-alpha 8-bit pixels: img_id, x, y, other columns to keep, r8, g8, b8, a8."""
    straight = {f"{c}8": F.when(C("a") <= 0, 0).otherwise(encode8(C(c) / F.when(C("a") > 0, C("a")).otherwise(1.0))).cast("int") for c in "rgb"}
    a8 = F.floor(F.least(F.greatest(C("a"), F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int")
    return df.select("img_id", C("x").cast("int").alias("x"), C("y").cast("int").alias("y"), *keep, *(v.alias(k) for k, v in straight.items()), a8.alias("a8"))


def overlay(base: DataFrame, top: DataFrame, x: int = 0, y: int = 0, opacity: float = 1.0) -> DataFrame:
    """Source-over of top, moved by (x, y), on base of the same img_id; the result has base's size. Adaptive execution broadcasts top where its measured size allows."""
    opacity = min(max(opacity, 0.0), 1.0)
    moved = top.select("img_id", (C("x") + x).cast("int").alias("x"), (C("y") + y).cast("int").alias("y"), *(C(c).alias(f"t_{c}") for c in "rgba")).where(C("t_a") * opacity > 0)
    both = base.join(moved, ["img_id", "x", "y"], "left")
    seen = F.coalesce("t_a", F.lit(0.0)) * opacity
    return both.withColumns({c: F.coalesce(f"t_{c}", F.lit(0.0)) * opacity + C(c) * (1.0 - seen) for c in "rgba"}).select(*KEYS, *"rgba")


def _paired(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """8-bit pixels and sizes of both images of an id, with the largest colour difference m."""
    sides = []
    for df, side in ((a, "a"), (b, "b")):
        eight = to_pixels8(df, keep=("width", "height"))
        sides.append(eight.select("img_id", "x", "y", *(C(c).alias(f"{side}_{c}") for c in ("width", "height")), *(C(f"{c}8").alias(f"{side}_{c}") for c in "rgb")))
    both = sides[0].join(sides[1], ["img_id", "x", "y"], how)
    return both.withColumn("m", F.greatest(*(F.abs(C(f"a_{c}") - C(f"b_{c}")) for c in "rgb")))


def _sizes_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    sizes = images(a).alias("p").join(images(b).alias("q"), "img_id", "full")
    return sizes.select("img_id", (F.coalesce(C("p.width") != C("q.width"), F.lit(True)) | F.coalesce(C("p.height") != C("q.height"), F.lit(True))).alias("differ"))


def diff_stats(a: DataFrame, b: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per id: fraction of pixels whose largest 8-bit colour difference exceeds the threshold (0 to 1), and the largest difference (0 to 1); null where sizes differ or one image is missing. One join of pixels, which carry their sizes."""
    limit = int(min(max(threshold, 0.0), 1.0) * 255)
    sides = {f"{side}_{v}": F.max(f"{side}_{v}").alias(f"{side}_{v}") for side in "ab" for v in ("width", "height")}
    stats = _paired(a, b, "full").groupBy("img_id").agg(*sides.values(), F.avg(F.when(C("m") > limit, 1.0).otherwise(0.0)).alias("fraction"), (F.max("m") / 255.0).alias("max_diff"))
    same = F.coalesce((C("a_width") == C("b_width")) & (C("a_height") == C("b_height")), F.lit(False))
    return stats.select("img_id", F.when(same, C("fraction")).alias("fraction"), F.when(same, C("max_diff")).alias("max_diff"))


def diff(a: DataFrame, b: DataFrame, view: str = "difference") -> DataFrame:
    """A view of the differences between images of equal id; `difference` and `heatmap` need equal sizes."""
    if view not in VIEWS:
        raise PipelineError("BadParam", f"diff: no such view: {view!r}")
    if view == "side_by_side":
        return _side_by_side(a, b)
    uneven = _sizes_differ(a, b).where("differ").first()
    if uneven is not None:
        raise SessionError(f"diff: images of {uneven['img_id']} differ in size")
    both = _paired(a, b)
    if view == "difference":
        channels = [F.abs(C(f"a_{c}") - C(f"b_{c}")) for c in "rgb"]
    else:
        gray = (0.299 * C("a_r") + 0.587 * C("a_g") + 0.114 * C("a_b")) * 0.35
        rest = F.floor(gray * (1.0 - C("m") / 255.0))
        channels = [F.floor(F.least(gray + C("m"), F.lit(255.0))), rest, rest]
    linear = from_pixels8(both.select("img_id", "x", "y", *(v.cast("int").alias(f"{c}8") for c, v in zip("rgb", channels)), F.lit(255).alias("a8")))
    return linear.join(images(a), "img_id").select(*KEYS, *"rgba")


def from_pixels8(df: DataFrame) -> DataFrame:
    """img_id, x, y, linear premultiplied r, g, b, a; without sizes."""
    from ..functions.color import decode8

    a = C("a8") / 255.0
    return df.select("img_id", "x", "y", *((decode8(C(f"{c}8")) * a).alias(c) for c in "rgb"), a.alias("a"))


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = images(a), images(b).select("img_id", C("width").alias("w2"), C("height").alias("h2"))
    sizes = left.join(right, "img_id")
    canvas = grid(sizes.select("img_id", (C("width") + SIDE_GAP + C("w2")).alias("width"), F.greatest("height", "h2").alias("height")))
    moved = b.join(left.select("img_id", C("width").alias("w1")), "img_id").select("img_id", (C("x") + C("w1") + SIDE_GAP).cast("int").alias("x"), "y", *"rgba")
    placed = a.select("img_id", "x", "y", *"rgba").unionByName(moved)
    back = dict(zip("rgba", (*(decode_value(v / 255) for v in SIDE_BACKGROUND), 1.0)))
    both = canvas.join(placed.select("img_id", "x", "y", *(C(c).alias(f"t_{c}") for c in "rgba")), ["img_id", "x", "y"], "left")
    seen = F.coalesce("t_a", F.lit(0.0))
    return both.select(*KEYS, *((F.coalesce(f"t_{c}", F.lit(0.0)) + F.lit(v) * (1.0 - seen)).alias(c) for c, v in back.items()))


def collage_layout(sizes: list[tuple[int, int]], target_width: int = 1600, row_height: int = 320, gap: int = 12) -> tuple[list[tuple[int, int, int, int]], tuple[int, int]]:
    """Cells (x, y, width, height) of images in justified rows, and the canvas size. A row ends with the image that fills it, and is scaled to the width that gaps leave (1 at least); a last row that isn't full keeps its height. 32-bit arithmetic throughout."""
    if not sizes:
        raise SessionError("a collage of no images")
    f = np.float32
    half_up = lambda v: np.floor(v + f(0.5)).astype(int)
    row_height = max(1, row_height)
    wide = np.array([f(row_height) * f(w) / f(h) for w, h in sizes], f)
    room, cells, top, rest = f(max(1, target_width - 2 * gap)), [], f(gap), wide
    while len(rest):
        filled = np.cumsum(rest, dtype=f) + np.arange(len(rest), dtype=f) * f(gap) >= room
        n = int(filled.argmax()) + 1 if filled.any() else len(rest)
        row, rest = rest[:n], rest[n:]
        scale = max(f(1), room - f((n - 1) * gap)) / np.cumsum(row, dtype=f)[-1] if filled.any() else f(1)
        row, height = row * scale, f(row_height) * scale
        left = np.cumsum(np.concatenate([[f(gap)], row[:-1] + f(gap)]), dtype=f)
        cells += [(int(x), int(half_up(top)), max(1, int(w)), max(1, int(half_up(height)))) for x, w in zip(half_up(left), half_up(row))]
        top += height + f(gap)
    return cells, (max(1, target_width), max(1, int(half_up(top))))


def layouts(df: DataFrame, groups: DataFrame, target_width: int = 1600, row_height: int = 320, gap: int = 12) -> DataFrame:
    """The cell of each image of `groups` (img_id, collage long, position: a row per image) in its collage: left, top, to_width, to_height, img_id, collage, position, canvas_width, canvas_height. A task lays out one collage at a time, from its sizes."""
    ship(df.sparkSession)

    def layout(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["position", "img_id"])
        cells, canvas = collage_layout(list(zip(rows["width"].tolist(), rows["height"].tolist())), target_width, row_height, gap)
        out = pd.DataFrame(cells, columns=["left", "top", "to_width", "to_height"])
        return out.assign(img_id=rows["img_id"].to_numpy(), collage=rows["collage"].to_numpy(), position=rows["position"].to_numpy(), canvas_width=canvas[0], canvas_height=canvas[1])

    id_type = df.schema["img_id"].dataType.simpleString()
    sizes = images(df).join(groups.select("img_id", C("collage").cast("long").alias("collage"), "position"), "img_id")
    return sizes.groupBy("collage").applyInPandas(layout, f"left int, top int, to_width int, to_height int, img_id {id_type}, collage long, position int, canvas_width int, canvas_height int")


def collages(df: DataFrame, groups: DataFrame, target_width: int = 1600, row_height: int = 320, gap: int = 12, background: Rgba = Rgba(255, 255, 255)) -> DataFrame:
    """One image per collage of `groups` (img_id, collage long, position: a row per image). Pixels of all collages are resized and placed together."""
    cells = layouts(df, groups, target_width, row_height, gap)
    canvas = grid(cells.groupBy("collage").agg(F.max("canvas_width").alias("width"), F.max("canvas_height").alias("height")).withColumnRenamed("collage", "img_id"))
    small = resize_to(df.join(cells.select("img_id", "to_width", "to_height").distinct(), "img_id"), "lanczos3")
    at = cells.select(C("img_id").alias("i"), "collage", "position", "left", "top", C("to_width").alias("cell_width"), C("to_height").alias("cell_height"))
    parts = small.join(at, (C("img_id") == C("i")) & (C("width") == C("cell_width")) & (C("height") == C("cell_height")))
    parts = parts.select(C("collage").alias("img_id"), "position", (C("x") + C("left")).cast("int").alias("x"), (C("y") + C("top")).cast("int").alias("y"), *(C(c).alias(f"t_{c}") for c in "rgba"))
    # Rounded cells may touch: where two meet, the later one is on top.
    upper = parts.groupBy("img_id", "x", "y").agg(F.max_by(F.struct(*(f"t_{c}" for c in "rgba")), "position").alias("t")).select("img_id", "x", "y", "t.*")
    seen = F.coalesce("t_a", F.lit(0.0))
    both = canvas.join(upper, ["img_id", "x", "y"], "left")
    return both.select(*KEYS, *((F.coalesce(f"t_{c}", F.lit(0.0)) + F.lit(v) * (1.0 - seen)).alias(c) for c, v in zip("rgba", background.premultiplied())))


def collage(df: DataFrame, order: list, target_width: int = 1600, row_height: int = 320, gap: int = 12, background: Rgba = Rgba(255, 255, 255)) -> DataFrame:
    """One image (img_id of the first) of the images named in `order`, each resized to its cell."""
    if not order:
        raise SessionError("a collage of no images")
    chosen = df.where(C("img_id").isin(list(order)))
    known = {r["img_id"] for r in images(chosen).collect()}
    if missing := [i for i in order if i not in known]:
        raise SessionError(f"no image {missing[0]} to put into a collage")
    id_type = df.schema["img_id"].dataType.simpleString()
    groups = df.sparkSession.createDataFrame([(i, 0, k) for k, i in enumerate(order)], f"img_id {id_type}, collage long, position int")
    return collages(chosen, groups, target_width, row_height, gap, background).withColumn("img_id", F.lit(order[0]).cast(id_type))
