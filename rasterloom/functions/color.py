"""Colours and the transfer between 8-bit sRGB and linear light, as column expressions.

Pixels are linear-light and premultiplied: columns r, g, b, a of type double, not clamped unless an operation says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import cache
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PipelineError

#: Named colours as red, green, blue, alpha.
NAMED = {
    "black": (0, 0, 0, 255), "white": (255, 255, 255, 255), "transparent": (0, 0, 0, 0), "red": (255, 0, 0, 255),
    "green": (0, 176, 0, 255), "blue": (0, 90, 255, 255), "yellow": (255, 210, 0, 255), "orange": (255, 140, 0, 255),
    "cyan": (0, 200, 220, 255), "magenta": (230, 0, 200, 255), "gray": (128, 128, 128, 255), "grey": (128, 128, 128, 255),
}


@dataclass(frozen=True)
class Rgba:
    """An authored colour: straight-alpha sRGB, 0 to 255."""

    r: int
    g: int
    b: int
    a: int = 255

    @classmethod
    def parse(cls, value) -> "Rgba":
        """From a colour, a name, #RGB, #RGBA, #RRGGBB, #RRGGBBAA, a mapping with r, g, b and maybe a, or a sequence."""
        if isinstance(value, Rgba):
            return value
        if isinstance(value, dict):
            channels = [value.get("r"), value.get("g"), value.get("b"), value.get("a", 255)]
        elif isinstance(value, str):
            text = value.strip().lower()
            if text in NAMED:
                return cls(*NAMED[text])
            digits = text.removeprefix("#")
            if len(digits) in (3, 4):
                digits = "".join(2 * d for d in digits)
            if not text.startswith("#") or len(digits) not in (6, 8) or any(d not in "0123456789abcdef" for d in digits):
                raise PipelineError("BadColor", f"not a colour: {value!r}")
            channels = [int(digits[i : i + 2], 16) for i in range(0, len(digits), 2)]
        else:
            channels = list(value)
        if len(channels) not in (3, 4) or any(not isinstance(c, int) or not 0 <= c <= 255 for c in channels):
            raise PipelineError("BadColor", f"not a colour: {value!r}")
        return cls(*channels)

    def json(self) -> dict:
        return {"r": self.r, "g": self.g, "b": self.b, "a": self.a}

    def srgb(self) -> tuple[float, float, float]:
        return self.r / 255, self.g / 255, self.b / 255

    def premultiplied(self) -> tuple[float, float, float, float]:
        """Linear-light, premultiplied red, green, blue and alpha."""
        a = self.a / 255
        return (*(decode_value(c) * a for c in self.srgb()), a)


def decode_value(c: float) -> float:
    return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4


def encode_value(c: float) -> float:
    c = min(max(c, 0.0), 1.0)
    return 12.92 * c if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def decode(c: Column) -> Column:
    """sRGB, clamped to 0..1, to linear light."""
    c = clamp(c)
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def encode(c: Column) -> Column:
    """Linear light, clamped to 0..1, to sRGB."""
    c = clamp(c)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def _table(values: Iterable, kind: str) -> Column:
    """A literal array, handed over as one string."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


@cache
def _encoded16() -> tuple[int, ...]:
    return tuple(math.floor(encode_value(i / 65535) * 255 + 0.5) for i in range(65536))


def decode8(v: Column) -> Column:
    """0..255 to linear light, by a table of all 256 values."""
    return F.get(_table((decode_value(i / 255) for i in range(256)), "double"), v.cast("int"))


def encode8(c: Column) -> Column:
    """Linear light to 0..255, by way of 16 bits as all writers of this format do; so a table of 65,536 values holds all there is to compute."""
    return F.get(_table(_encoded16(), "smallint"), F.floor(clamp(c) * 65535.0 + 0.5).cast("int")).cast("int")


def luma601(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def over(columns: tuple[Column, Column, Column, Column], paint: tuple, coverage: Column) -> list[Column]:
    """Source-over of a premultiplied paint (floats or columns) at a coverage, per channel."""
    c = clamp(coverage)
    keep = 1.0 - paint[3] * c
    return [F.when(c > 0, p * c + d * keep).otherwise(d) for d, p in zip(columns, paint)]


def hue_matrix(degrees: float) -> list[list[float]]:
    """Rotation about the grey axis. The luma weights and the sine part of the SVG standard's hueRotate."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    luma = (0.213, 0.715, 0.072)
    turn = ((-0.213, -0.715, 0.928), (0.143, 0.140, -0.283), (-0.787, 0.715, 0.072))
    return [[luma[j] + c * ((i == j) - luma[j]) + s * turn[i][j] for j in range(3)] for i in range(3)]
