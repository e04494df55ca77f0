"""Pointwise operations: projections of a pixel's own columns (and position), which Catalyst fuses and prunes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import Rgba, clamp, decode, encode, hue_matrix, luma601, over
from ..functions.shapes import coverage, rounded_box

RGB = ("r", "g", "b")
C = F.col


def linear_matrix(op) -> list[list[float]] | None:
    """The 3x3 matrix of an operation that is linear in premultiplied red, green and blue; None for others."""
    if op.name == "exposure":
        return np.diag([2.0 ** op["stops"]] * 3).tolist()
    if op.name == "grayscale":
        return [[0.2126, 0.7152, 0.0722]] * 3
    if op.name == "hue_rotate":
        return hue_matrix(op["degrees"])
    if op.name == "white_balance":
        return np.diag([max(1 + 0.4 * op["temperature"], 0), max(1 - 0.4 * op["tint"], 0), max(1 - 0.4 * op["temperature"], 0)]).tolist()
    return None


def linear(df: DataFrame, m: list[list[float]]) -> DataFrame:
    def row(weights: list[float]) -> Column:
        terms = [C(c) * w for c, w in zip(RGB, weights) if w]
        return sum(terms[1:], terms[0]) if terms else F.lit(0.0)

    return df.withColumns({c: row(w) for c, w in zip(RGB, m)})


def in_srgb(df: DataFrame, f: Callable[[Column, Column, Column], tuple[Column, Column, Column]]) -> DataFrame:
    """Applies f to straight sRGB values of pixels that aren't fully transparent. One projection per step keeps each transfer computed once."""
    seen = C("a") > 0
    df = df.withColumns({f"s_{c}": F.when(seen, encode(C(c) / C("a"))).otherwise(0.0) for c in RGB})
    df = df.withColumns(dict(zip(("s_r", "s_g", "s_b"), f(C("s_r"), C("s_g"), C("s_b")))))
    return df.withColumns({c: F.when(seen, decode(C(f"s_{c}")) * C("a")).otherwise(C(c)) for c in RGB}).drop("s_r", "s_g", "s_b")


def invert(df: DataFrame, op) -> DataFrame:
    return in_srgb(df, lambda *s: tuple(1.0 - x for x in s))


def brightness_contrast(df: DataFrame, op) -> DataFrame:
    return in_srgb(df, lambda *s: tuple(clamp((x - 0.5) * (1 + op["contrast"]) + 0.5 + op["brightness"]) for x in s))


def saturation(df: DataFrame, op) -> DataFrame:
    def f(r: Column, g: Column, b: Column) -> tuple:
        l = luma601(r, g, b)
        return tuple(clamp(l + (x - l) * op["amount"]) for x in (r, g, b))

    return in_srgb(df, f)


def levels(df: DataFrame, op) -> DataFrame:
    span = max(abs(op["in_white"] - op["in_black"]), 1e-6)
    level = lambda x: clamp(F.pow(clamp((x - op["in_black"]) / span), F.lit(1 / op["gamma"])) * (op["out_white"] - op["out_black"]) + op["out_black"])
    return in_srgb(df, lambda *s: tuple(map(level, s)))


def curve_table(points: tuple) -> list[float]:
    """256 values of the polyline through the points, flat outside them; without points the identity."""
    at = np.arange(256) / 255
    if not points:
        return at.tolist()
    x, y = zip(*sorted(points, key=lambda p: p[0]))
    return np.clip(np.interp(at, x, y), 0, 1).tolist()


def curves(df: DataFrame, op) -> DataFrame:
    table = F.lit(np.array(curve_table(op["points"])))
    return in_srgb(df, lambda *s: tuple(F.element_at(table, F.floor(clamp(x) * 255 + 0.5).cast("int") + 1) for x in s))


def gradient_map(df: DataFrame, op) -> DataFrame:
    low, high, mid = (None if c is None else c.srgb() for c in (op["low"], op["high"], op["mid"]))

    def f(r: Column, g: Column, b: Column) -> tuple:
        l = clamp(luma601(r, g, b))
        if mid is None:
            return tuple(a + (z - a) * l for a, z in zip(low, high))
        return tuple(F.when(l < 0.5, a + (m - a) * (l * 2)).otherwise(m + (z - m) * (l * 2 - 1)) for a, m, z in zip(low, mid, high))

    return in_srgb(df, f)


def paint(df: DataFrame, color: Rgba, cover: Column) -> DataFrame:
    """Composites a colour over every pixel at a coverage."""
    df = df.withColumn("cover", cover)
    channels = over((C("r"), C("g"), C("b"), C("a")), tuple(map(F.lit, color.premultiplied())), C("cover"))
    return df.withColumns(dict(zip("rgba", channels))).drop("cover")


def vignette(df: DataFrame, op) -> DataFrame:
    if op["amount"] <= 0:
        return df
    cx, cy = C("width") / 2.0, C("height") / 2.0
    far = F.greatest(F.sqrt(cx * cx + cy * cy), F.lit(1e-6))
    d = F.sqrt(F.pow(C("x") + 0.5 - cx, 2.0) + F.pow(C("y") + 0.5 - cy, 2.0)) / far
    inner = 1 - min(max(op["feather"], 0.0), 1.0)
    t = clamp((d - inner) / max(1 - inner, 1e-6))
    # The coverage isn't clamped: an amount above 1 overshoots.
    df = df.withColumn("cover", op["amount"] * t * t * (3.0 - 2.0 * t))
    color = op["color"].premultiplied()
    return df.withColumns({c: F.when(C("cover") > 0, p * C("cover") + C(c) * (1 - color[3] * C("cover"))).otherwise(C(c)) for c, p in zip("rgba", color)}).drop("cover")


def spotlight(df: DataFrame, op) -> DataFrame:
    hw, hh = op["width"] / 2, op["height"] / 2
    d = rounded_box(op["x"] + hw, op["y"] + hh, hw, hh, min(op["corner_radius"], max(min(hw, hh), 0.0)))
    inside = coverage(d) if op["feather"] <= 0 else clamp(0.5 - d / op["feather"])
    return paint(df, op["color"], (1.0 - inside) * min(max(op["dim"], 0.0), 1.0))


POINTWISE = {f.__name__: f for f in (invert, brightness_contrast, saturation, levels, curves, gradient_map, vignette, spotlight)}
