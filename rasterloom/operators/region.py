"""Operations on a rectangle of each image (redact), and framing (beautify)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import Rgba, over
from ..functions.shapes import coverage, rounded_box
from .geometry import KEYS, pad
from .stencil import blur, filter_pass

C = F.col


def _bounds(op) -> tuple[int, int, int, int]:
    """The rectangle's whole pixels, still open to the right and below: left, top, right, bottom (exclusive)."""
    return max(0, math.floor(op["x"])), max(0, math.floor(op["y"])), max(0, math.ceil(op["x"] + op["width"])), max(0, math.ceil(op["y"] + op["height"]))


def _inside(left: int, top: int, right: int, bottom: int) -> Column:
    return (C("x") >= left) & (C("x") < right) & (C("y") >= top) & (C("y") < bottom)


def redact(df: DataFrame, op) -> DataFrame:
    left, top, right, bottom = _bounds(op)
    kind, value = op["mode"]
    inside = _inside(left, top, right, bottom)
    if right <= left or bottom <= top:
        return df
    if kind == "fill":
        tinted = over(tuple(map(C, "rgba")), tuple(map(F.lit, value.premultiplied())), F.when(inside, 1.0).otherwise(0.0))
        return df.withColumns(dict(zip("rgba", tinted)))
    if kind == "pixelate":
        # Cells start at the region's corner; their means are aggregated apart, so that no cell is a window's buffer.
        cell = {"cx": F.floor((C("x") - left) / F.lit(value)), "cy": F.floor((C("y") - top) / F.lit(value))}
        region = df.where(inside).withColumns(cell)
        means = region.groupBy("img_id", "cx", "cy").agg(*(F.avg(c).alias(f"m_{c}") for c in "rgba"))
        changed = region.join(means, ["img_id", "cx", "cy"]).select(*KEYS, *(C(f"m_{c}").alias(c) for c in "rgba"))
        return df.where(~inside).select(*KEYS, *"rgba").unionByName(changed)
    if value <= 0:
        return df
    # Only the region and a margin of the kernel's reach are blurred.
    reach = max(1, math.ceil(3 * value))
    margin = df.where(_inside(max(0, left - reach), max(0, top - reach), right + reach, bottom + reach))
    back = blur(margin, value)
    return df.where(~inside).select(*KEYS, *"rgba").unionByName(back.where(inside).select(*KEYS, *"rgba"))


def beautify(df: DataFrame, op) -> DataFrame:
    """A rounded copy of the image over its soft shadow over a background, with a margin on all sides. The margin is generated beside the moved pixels, and the shadow runs through the line passes with the colours it belongs to: nothing is joined."""
    margin, background = op["padding"], op["background"].premultiplied()
    source = df
    if op["corner_radius"] > 0:
        w, h = C("width") / 2.0, C("height") / 2.0
        radius = F.least(F.lit(op["corner_radius"]), F.least(w, h))
        source = df.withColumn("cover", coverage(rounded_box(w, h, w, h, radius)))
        source = source.withColumns({c: C(c) * C("cover") for c in "rgba"}).drop("cover")
    canvas = pad(source, margin, margin, margin, margin, Rgba(0, 0, 0, 0))
    under = {c: F.lit(v) for c, v in zip("rgba", background)}
    if op["shadow_opacity"] > 0:
        down = math.floor(abs(op["shadow_offset"]) + 0.5) * (1 if op["shadow_offset"] >= 0 else -1)
        canvas = canvas.withColumn("shade", C("a") * op["shadow_opacity"])
        how = "gauss" if op["shadow_radius"] > 0 else "none"
        if how != "none":
            canvas = filter_pass(canvas, "x", how, ("shade",), op["shadow_radius"], keep=tuple("rgba"))
        if how != "none" or down:
            canvas = filter_pass(canvas, "y", how, ("shade",), op["shadow_radius"], keep=tuple("rgba"), shift=down)
        under = {c: v * (1 - C("shade")) + (C("shade") if c == "a" else 0.0) for c, v in under.items()}
    return canvas.withColumns({c: C(c) + v * (1 - C("a")) for c, v in under.items()}).select(*KEYS, *"rgba")
