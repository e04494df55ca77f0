"""From a pipeline to one DataFrame plan.

Before columns are emitted, the list of operations is rewritten: operations that do nothing go, neighbouring operations
that are linear in red, green and blue become one matrix, and a crop moves before blurs and pointwise operations, with a
margin of the kernel's reach, and through a resize as the window of pixels that its taps read, so that pixels outside it are never read into a stencil. Everything else (filter pushdown
to the scan, column pruning, fusion of projections) is Catalyst's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from types import MappingProxyType

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PipelineError
from ..operators import geometry, region, stencil
from ..operators.draw import DRAW
from ..operators.pointwise import POINTWISE, linear, linear_matrix
from .spec import Op, Pipeline, Size

C = F.col


@dataclass(frozen=True)
class Linear:
    """Operations joined to one matrix."""

    matrix: tuple

    name = "linear"


@dataclass(frozen=True)
class Halo:
    """Keeps the pixels that a crop needs after a stencil of some reach; keys and sizes stay."""

    x: int
    y: int
    width: int
    height: int
    reach: int

    name = "halo"


@dataclass(frozen=True)
class Resampled:
    """A resize of which only a window (left, top, right, bottom) of the result is wanted."""

    op: Op
    window: tuple[int, int, int, int]

    name = "resampled"


def does_nothing(op: Op) -> bool:
    p = op.params
    return (
        op.name == "blur" and p["radius"] <= 0
        or op.name == "sharpen" and (p["amount"] == 0 or p["radius"] <= 0)
        or op.name == "vignette" and p["amount"] <= 0
        or op.name == "draw_text" and not p["text"].strip()
        or op.name == "exposure" and p["stops"] == 0
        or op.name == "redact" and p["mode"][0] == "blur" and p["mode"][1] <= 0
    )


def _reach(op) -> int | None:
    """How far a result depends on its input around; None where position matters otherwise."""
    if op.name in ("blur", "sharpen"):
        return max(1, math.ceil(3 * op["radius"]))
    return 0 if isinstance(op, Linear) or op.name in ("invert", "brightness_contrast", "saturation", "levels", "curves", "gradient_map") else None


def rewrite(steps: tuple[Op, ...]) -> list:
    out: list = []
    for op in steps:
        if does_nothing(op):
            continue
        m = linear_matrix(op)
        if m is None:
            out.append(op)
        elif out and isinstance(out[-1], Linear):
            out[-1] = Linear(tuple(map(tuple, np.array(m) @ np.array(out[-1].matrix))))
        else:
            out.append(Linear(tuple(map(tuple, m))))
    for i in [i for i, op in enumerate(out) if op.name == "crop"][::-1]:
        at, reach = i, 0
        while at and (r := _reach(out[at - 1])) is not None:
            at, reach = at - 1, reach + r
        crop = out[i]
        if at and out[at - 1].name == "resize":
            out[at - 1] = Resampled(out[at - 1], (crop["x"] - reach, crop["y"] - reach, crop["x"] + crop["width"] + reach, crop["y"] + crop["height"] + reach))
        elif reach:  # without a stencil in between Catalyst moves the filter itself
            out.insert(at, Halo(crop["x"], crop["y"], crop["width"], crop["height"], reach))
    return out


def _halo(df: DataFrame, h: Halo) -> DataFrame:
    return df.where((C("x") >= h.x - h.reach) & (C("x") < h.x + h.width + h.reach) & (C("y") >= h.y - h.reach) & (C("y") < h.y + h.height + h.reach))


def apply(df: DataFrame, op) -> DataFrame:
    """One operation over all images of df (img_id, x, y, width, height, r, g, b, a)."""
    if isinstance(op, Halo):
        return _halo(df, op)
    if isinstance(op, Linear):
        return linear(df, op.matrix)
    if isinstance(op, Resampled):
        return stencil.resize(df, op.op["width"], op.op["height"], op.op["filter"], op.window)
    if (m := linear_matrix(op)) is not None:
        return linear(df, m)
    if op.name in POINTWISE:
        return POINTWISE[op.name](df, op)
    if op.name in DRAW:
        return DRAW[op.name](df, op)
    p: MappingProxyType = op.params
    return {
        "crop": lambda: geometry.crop(df, p["x"], p["y"], p["width"], p["height"]),
        "flip": lambda: geometry.flip(df, op),
        "rotate": lambda: geometry.rotate(df, op),
        "pad": lambda: geometry.pad(df, p["left"], p["right"], p["top"], p["bottom"], p["color"]),
        "trim": lambda: geometry.trim(df, p["color"], p["tolerance"]),
        "resize": lambda: stencil.resize(df, p["width"], p["height"], p["filter"]),
        "blur": lambda: stencil.blur(df, p["radius"]),
        "sharpen": lambda: stencil.sharpen(df, p["amount"], p["radius"]),
        "redact": lambda: region.redact(df, op),
        "beautify": lambda: region.beautify(df, op),
    }[op.name]()


def sizes_of(df: DataFrame) -> list[Size]:
    """Distinct sizes of a batch; metadata, combined on the map side."""
    return [(r["width"], r["height"]) for r in df.select("width", "height").distinct().collect()]


def fits(op, width: Column, height: Column) -> Column | None:
    """Whether an image of a size that only the run knows fits a step; None where every size does."""
    if op.name == "crop":
        return (width >= op["x"] + op["width"]) & (height >= op["y"] + op["height"])
    if op.name in ("pad", "beautify"):
        more = (op["left"] + op["right"], op["top"] + op["bottom"]) if op.name == "pad" else (2 * op["padding"],) * 2
        return (width <= MOST_SIDE - more[0]) & (height <= MOST_SIDE - more[1])
    return None


#: Positions are 32-bit numbers.
MOST_SIDE = 2**31 - 1


def _checked(df: DataFrame, op, step: int, on_error: str) -> DataFrame:
    """After a trim: images that a step doesn't fit are an error or are left out, whole, before any of their pixels are."""
    fit = fits(op, C("width"), C("height"))
    if fit is None:
        return df
    if on_error == "quarantine":
        return df.where(fit)
    told = F.concat(F.lit(f"step {step}: {op.name} doesn't fit image "), C("img_id").cast("string"), F.lit(" of "), C("width").cast("string"), F.lit("x"), C("height").cast("string"))
    return df.where(F.when(fit, True).otherwise(F.raise_error(told).cast("boolean")))


def _parts(steps: tuple[Op, ...]) -> list[tuple[tuple[int, Op], ...]]:
    """Numbered steps, cut so that each step of which sizes are known at run time only, and that not every size fits, begins a part: rewrites stay within parts."""
    parts, unknown = [[]], False
    for i, op in enumerate(steps):
        if unknown and fits(op, C("width"), C("height")) is not None:
            parts.append([])
        parts[-1].append((i, op))
        unknown = unknown or op.name == "trim"
    return [tuple(p) for p in parts]


def run(df: DataFrame, pipeline: Pipeline, sizes: list[Size] | None = None, on_error: str = "fail") -> DataFrame:
    """Validates against all sizes of the batch, then compiles. on_error: `fail` raises, `quarantine` leaves out images whose size the pipeline doesn't fit. What follows a trim is checked per image as it runs, with the same outcome."""
    bad = []
    for size in sizes_of(df) if sizes is None else sizes:
        try:
            pipeline.validate(size)
        except PipelineError:
            if on_error == "fail":
                raise
            bad.append(size)
    if bad:
        packed = C("width").cast("long") * (1 << 32) + C("height").cast("long")
        df = df.where(~packed.isin([(w << 32) + h for w, h in bad]))
    for k, part in enumerate(_parts(pipeline.steps)):
        if k:
            df = _checked(df, part[0][1], part[0][0], on_error)
        for op in rewrite(tuple(op for _, op in part)):
            df = apply(df, op)
    return df
