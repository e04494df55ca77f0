"""Signed distances to shapes at pixel centres, as column expressions over x and y (negative inside)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import clamp


def _centre() -> tuple[Column, Column]:
    return F.col("x") + 0.5, F.col("y") + 0.5


def coverage(distance: Column) -> Column:
    """Share of a pixel on the inner side, one pixel of ramp around the edge."""
    return clamp(0.5 - distance)


def stroke(distance: Column, width: float) -> Column:
    return coverage(F.abs(distance) - width / 2)


def rounded_box(cx, cy, half_w, half_h, radius) -> Column:
    """All arguments numbers or columns."""
    px, py = _centre()
    qx, qy = F.abs(px - cx) - half_w + radius, F.abs(py - cy) - half_h + radius
    zero = F.lit(0.0)
    ox, oy = F.greatest(qx, zero), F.greatest(qy, zero)
    return F.least(F.greatest(qx, qy), zero) + F.sqrt(ox * ox + oy * oy) - radius


def ellipse(cx: float, cy: float, rx: float, ry: float) -> Column:
    """First-order estimate: with the axes scaled to 1, u^2 + v^2 - 1 over the length of its gradient 2 (u / rx, v / ry)."""
    px, py = _centre()
    u, v = (px - cx) / rx, (py - cy) / ry
    steepness = 2.0 * F.hypot(u / rx, v / ry)
    level = u * u + v * v - 1.0
    return F.when(steepness <= 1e-9, level).otherwise(level / steepness)


def segment(ax: float, ay: float, bx: float, by: float) -> Column:
    """In the segment's own frame: how far beside its line, and how far before its start or beyond its end."""
    px, py = _centre()
    length = math.hypot(bx - ax, by - ay)
    ux, uy = ((bx - ax) / length, (by - ay) / length) if length else (1.0, 0.0)
    ahead, beside = (px - ax) * ux + (py - ay) * uy, (py - ay) * ux - (px - ax) * uy
    return F.hypot(beside, F.greatest(-ahead, ahead - length, F.lit(0.0)))
