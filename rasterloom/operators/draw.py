"""Annotations: shapes by signed distance as projections, and text by a mask of coverages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import Rgba
from ..functions.shapes import coverage, ellipse, rounded_box, segment, stroke
from ..functions.text import mask
from .pointwise import paint

C = F.col
#: Pixels of a text's mask up to which it goes to all tasks; larger masks are joined by a shuffle.
BROADCAST_MASK = 1_000_000


def _near(cover: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """The coverage, computed only around the shape."""
    box = (C("x") >= math.floor(left - 1)) & (C("x") < math.ceil(right + 1)) & (C("y") >= math.floor(top - 1)) & (C("y") < math.ceil(bottom + 1))
    return F.when(box, cover).otherwise(0.0)


def _filled_and_stroked(df: DataFrame, op, distance: Column) -> DataFrame:
    reach = op["stroke_width"] / 2 if op["stroke"] is not None else 0.0
    box = op["x"] - reach, op["y"] - reach, op["x"] + op["width"] + reach, op["y"] + op["height"] + reach
    if op["fill"] is not None:
        df = paint(df, op["fill"], _near(coverage(distance), *box))
    if op["stroke"] is not None:
        df = paint(df, op["stroke"], _near(stroke(distance, op["stroke_width"]), *box))
    return df


def draw_rect(df: DataFrame, op) -> DataFrame:
    hw, hh = op["width"] / 2, op["height"] / 2
    return _filled_and_stroked(df, op, rounded_box(op["x"] + hw, op["y"] + hh, hw, hh, min(op["corner_radius"], hw, hh)))


def draw_ellipse(df: DataFrame, op) -> DataFrame:
    rx, ry = op["width"] / 2, op["height"] / 2
    return df if rx <= 0 or ry <= 0 else _filled_and_stroked(df, op, ellipse(op["x"] + rx, op["y"] + ry, rx, ry))


def _stroked(df: DataFrame, color: Rgba, thickness: float, lines: list[tuple[float, float, float, float]]) -> DataFrame:
    half = thickness / 2
    distances = [segment(*l) - half for l in lines]
    nearest = F.least(*distances) if len(distances) > 1 else distances[0]
    xs, ys = [v for l in lines for v in (l[0], l[2])], [v for l in lines for v in (l[1], l[3])]
    return paint(df, color, _near(coverage(nearest), min(xs) - half, min(ys) - half, max(xs) + half, max(ys) + half))


def draw_line(df: DataFrame, op) -> DataFrame:
    return _stroked(df, op["color"], op["thickness"], [(op["x1"], op["y1"], op["x2"], op["y2"])])


#: Cosine and sine of the angle between an arrow's shaft and its head.
HEAD = (0.88, 0.475)


def arrow_lines(op) -> list[tuple[float, float, float, float]]:
    x1, y1, x2, y2 = (op[k] for k in ("x1", "y1", "x2", "y2"))
    lines = [(x1, y1, x2, y2)]
    length = math.hypot(x2 - x1, y2 - y1)
    if length > 1e-6 and op["head_length"] > 0:
        ux, uy = (x2 - x1) / length, (y2 - y1) / length
        for sine in (HEAD[1], -HEAD[1]):
            lines.append((x2, y2, x2 - op["head_length"] * (ux * HEAD[0] - uy * sine), y2 - op["head_length"] * (ux * sine + uy * HEAD[0])))
    return lines


def draw_arrow(df: DataFrame, op) -> DataFrame:
    return _stroked(df, op["color"], op["thickness"], arrow_lines(op))


def draw_text(df: DataFrame, op) -> DataFrame:
    cells = mask(op["text"], op["x"], op["y"], op["font_size"], op["align_x"], op["align_y"], op["line_height"], op["font"])
    if not cells:
        return df
    table = df.sparkSession.createDataFrame(cells, "mask_x int, mask_y int, mask_cover double")
    table = F.broadcast(table) if len(cells) <= BROADCAST_MASK else table
    joined = df.join(table, (C("x") == C("mask_x")) & (C("y") == C("mask_y")), "left")
    return paint(joined, op["color"], F.coalesce("mask_cover", F.lit(0.0))).select(*df.columns)


DRAW = {f.__name__: f for f in (draw_rect, draw_ellipse, draw_line, draw_arrow, draw_text)}
