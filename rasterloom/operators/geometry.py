"""Operations on keys: crop is a filter, flips and quarter turns are key arithmetic, padding adds a generated border."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import Rgba
from ..packaging import ship
from ..plans.spec import quarter_turns, rotation

C = F.col
KEYS = ("img_id", "x", "y", "width", "height")


def _int(c) -> Column:
    return c.cast("int") if isinstance(c, Column) else F.lit(c).cast("int")


def sized(df: DataFrame, width, height) -> DataFrame:
    return df.withColumns({"width": _int(width), "height": _int(height)})


def crop(df: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = df.where((C("x") >= x) & (C("x") < x + width) & (C("y") >= y) & (C("y") < y + height))
    return sized(inside.withColumns({"x": _int(C("x") - x), "y": _int(C("y") - y)}), width, height)


def flip(df: DataFrame, op) -> DataFrame:
    side, size = ("x", "width") if op["axis"] == "horizontal" else ("y", "height")
    return df.withColumn(side, _int(C(size) - 1 - C(side)))


def images(df: DataFrame) -> DataFrame:
    """A row per image: img_id, width, height."""
    return df.groupBy("img_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))


def grid(sizes: DataFrame) -> DataFrame:
    """All pixel keys of images given by img_id, width, height; rows are generated first, so one large image is dealt over many tasks after a shuffle."""
    rows = sizes.where("width > 0 and height > 0").withColumn("y", F.explode(F.sequence(F.lit(0), C("height") - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), C("width") - 1))).select(*(_int(C(c)).alias(c) if c != "img_id" else C(c) for c in KEYS))


def rotate(df: DataFrame, op) -> DataFrame:
    """Quarter turns are exact. Other angles read four neighbours around the turned-back position; outside is transparent."""
    k = quarter_turns(op["degrees"])
    w, h, x, y = C("width"), C("height"), C("x"), C("y")
    if k is not None:
        to = {0: (x, y, w, h), 1: (h - 1 - y, x, h, w), 2: (w - 1 - x, h - 1 - y, w, h), 3: (y, w - 1 - x, h, w)}[k]
        return df.withColumns(dict(zip(("x", "y", "width", "height"), map(_int, to))))
    return _turned(df, op["degrees"], op["expand"])


#: Sides of the blocks that source pixels and turned-back positions are brought together by, and pixels of a group of blocks, about.
BLOCK, GROUP = 64, 1 << 18
#: Positions that fit the keys that neighbours are looked up by.
FARTHEST = 1 << 23


def _turned(df: DataFrame, degrees: float, expand: bool) -> DataFrame:
    """Every source pixel moves once, and those at the left or upper border of a block twice; neighbours are then looked up in numpy, many blocks at a time."""
    ship(df.sparkSession)
    s, c = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
    sizes = images(df)
    groups = (sizes.agg(F.sum(C("width").cast("long") * C("height"))).first()[0] or 0) // GROUP + 1
    box = np.abs(rotation(degrees)).tolist()
    side = lambda row: F.greatest(F.ceil(C("width").cast("float") * F.lit(row[0]).cast("float") + C("height").cast("float") * F.lit(row[1]).cast("float")), F.lit(1)).cast("int")
    to_w, to_h = (side(box[0]), side(box[1])) if expand else (C("width"), C("height"))
    turned = sizes.select("img_id", C("width").alias("in_w"), C("height").alias("in_h"), to_w.alias("width"), to_h.alias("height"))
    cells = grid(turned).join(turned.select("img_id", "in_w", "in_h"), "img_id")
    dx, dy = C("x") + 0.5 - C("width") / 2.0, C("y") + 0.5 - C("height") / 2.0
    cells = cells.select(*KEYS, (C("in_w") / 2.0 + c * dx + s * dy - 0.5).alias("sx"), (C("in_h") / 2.0 - s * dx + c * dy - 0.5).alias("sy"))
    block = lambda v: F.floor(v / BLOCK)
    group = lambda i, j: F.pmod(F.xxhash64("img_id", i, j), F.lit(groups)).alias("batch")
    cells = cells.withColumns({"i": block(F.floor("sx")), "j": block(F.floor("sy"))}).select(group("i", "j"), C("img_id").alias("img_id"), *KEYS[1:], "sx", "sy")
    # A pixel serves the block it is in, and as the right or lower neighbour the blocks of the positions before it.
    reach = lambda v: F.array_distinct(F.array(block(C(v)), block(C(v) - 1)))
    source = df.withColumn("i", F.explode(reach("x"))).withColumn("j", F.explode(reach("y"))).select(group("i", "j"), C("img_id").alias("of"), C("x").alias("at_x"), C("y").alias("at_y"), *(C(ch).alias(f"of_{ch}") for ch in "rgba"))

    def interpolated(own: pa.Table, asked: pa.Table) -> pa.Table:
        names = [*KEYS, *"rgba"]
        _, code = np.unique(np.concatenate([own.column("of").to_numpy(), asked.column("img_id").to_numpy()]), return_inverse=True)
        place = lambda code, x, y: (code << 48) + ((y.astype(np.int64) + 2) << 24) + x.astype(np.int64) + 2
        key = place(code[: own.num_rows], own.column("at_x").to_numpy(), own.column("at_y").to_numpy())
        order = np.argsort(key)
        key, pixels = key[order], np.stack([own.column(f"of_{ch}").to_numpy()[order] for ch in "rgba"]) if own.num_rows else np.zeros((4, 0))
        sx, sy = asked.column("sx").to_numpy(), asked.column("sy").to_numpy()
        if max(np.abs(asked.column(k).to_numpy()).max(initial=0) for k in ("width", "height", "sx", "sy")) >= FARTHEST:
            raise ValueError(f"rotate: sides from {FARTHEST} pixels on aren't turned by angles other than quarters")
        fx, fy, of = np.floor(sx), np.floor(sy), code[own.num_rows :]
        out = np.zeros((4, asked.num_rows))
        near = (fx >= -2) & (fy >= -2)
        for j in (0, 1):
            for i in (0, 1):
                wanted = place(of, np.where(near, fx + i, -2), np.where(near, fy + j, -2))
                at = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
                found = (key[at] == wanted) & near if len(key) else np.zeros(len(wanted), bool)
                weight = (sx - fx if i else 1 - (sx - fx)) * (sy - fy if j else 1 - (sy - fy))
                out[:, found] += pixels[:, at[found]] * weight[found]
        return pa.table([*(asked.column(k) for k in KEYS), *(pa.array(v) for v in out)], names=names)

    id_type = df.schema["img_id"].dataType.simpleString()
    schema = f"img_id {id_type}, x int, y int, width int, height int, r double, g double, b double, a double"
    return source.groupBy("batch").cogroup(cells.groupBy("batch")).applyInArrow(interpolated, schema)


def pad(df: DataFrame, left: int, right: int, top: int, bottom: int, color: Rgba) -> DataFrame:
    """The source moved by (left, top), and border rows generated from the images' sizes."""
    moved = sized(df.withColumns({"x": _int(C("x") + left), "y": _int(C("y") + top)}), C("width") + left + right, C("height") + top + bottom)
    sizes = images(df).select("img_id", (C("width") + left + right).alias("width"), (C("height") + top + bottom).alias("height"))
    inside = (C("x") >= left) & (C("x") < C("width") - right) & (C("y") >= top) & (C("y") < C("height") - bottom)
    border = grid(sizes).where(~inside)
    for ch, v in zip("rgba", color.premultiplied()):
        border = border.withColumn(ch, F.lit(v))
    return moved.select(*KEYS, *"rgba").unionByName(border.select(*KEYS, *"rgba"))


def content_bounds(df: DataFrame, reference: Rgba | None = None, tolerance: float = 0.0) -> DataFrame:
    """Per image with content: img_id, left, top, right, bottom (inclusive) of the pixels that differ from the reference colour (the pixel at the origin) on any channel."""
    if reference is None:
        origin = df.where("x = 0 and y = 0").select("img_id", *(C(ch).alias(f"o_{ch}") for ch in "rgba"))
        df = df.join(origin, "img_id")
        aim = {ch: C(f"o_{ch}") for ch in "rgba"}
    else:
        aim = dict(zip("rgba", map(F.lit, reference.premultiplied())))
    differs = F.greatest(*(F.abs(C(ch) - aim[ch]) for ch in "rgba")) > max(tolerance, 0.0)
    return df.where(differs).groupBy("img_id").agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"))


def trim(df: DataFrame, reference: Rgba | None = None, tolerance: float = 0.01) -> DataFrame:
    """Crops each image to its content. Images without content have no rows in the result; `content_bounds` tells which."""
    bounds = content_bounds(df, reference, tolerance)
    inside = (C("x") >= C("left")) & (C("x") <= C("right")) & (C("y") >= C("top")) & (C("y") <= C("bottom"))
    kept = df.join(bounds, "img_id").where(inside)
    out = {"x": C("x") - C("left"), "y": C("y") - C("top"), "width": C("right") - C("left") + 1, "height": C("bottom") - C("top") + 1}
    return kept.withColumns({k: _int(v) for k, v in out.items()}).drop("left", "top", "right", "bottom")
