"""TrueType outlines: character map, metrics, kerning, glyphs, and coverages of pixels by exact areas.

What is read: `head`, `maxp`, `hhea`, `OS/2`, `hmtx`, `loca`, `glyf`, `cmap` (formats 4 and 12), `kern` (format 0) and `name`. Fonts with other outlines, and
damaged files, raise CodecError.
"""

from __future__ import annotations

import math
import os
import struct
from functools import lru_cache

import numpy as np

from ..errors import CodecError

#: Where families are looked for.
FOLDERS = ("/usr/share/fonts", "/usr/local/share/fonts", "~/.fonts", "~/.local/share/fonts")
#: Largest distance of a flattened curve from the curve, in pixels, and how deep glyphs may be made of glyphs.
FLATNESS, DEPTH = 0.05, 6


class TrueType:
    def __init__(self, data: bytes):
        self.data, self._outlines = data, {}
        try:
            start = struct.unpack_from(">I", data, 12)[0] if data[:4] == b"ttcf" else 0
            if data[start : start + 4] not in (b"\0\1\0\0", b"true"):
                raise CodecError("font: not a TrueType file")
            self.tables = {name.decode("latin-1"): (at, size) for name, _, at, size in (struct.unpack_from(">4sIII", data, start + 12 + 16 * i) for i in range(struct.unpack_from(">H", data, start + 4)[0]))}
            for needed in ("head", "maxp", "hhea", "hmtx", "loca", "glyf", "cmap"):
                if needed not in self.tables:
                    raise CodecError(f"font: no `{needed}` table")
            self.units, self._long = self._read("head", 18, "H"), self._read("head", 50, "h")
            self.count, self.wide = self._read("maxp", 4, "H"), self._read("hhea", 34, "H")
            self.ascender, self.descender, self.gap = (self._read("hhea", at, "h") for at in (4, 6, 8))
            if "OS/2" in self.tables and self._read("OS/2", 62, "H") & 128:  # the file asks for the typographic ones
                self.ascender, self.descender, self.gap = (self._read("OS/2", at, "h") for at in (68, 70, 72))
            self.chars, self.pairs = self._cmap(), self._kern()
            if self.ascender <= self.descender:
                raise CodecError("font: no height")
        except (struct.error, IndexError, ValueError) as e:
            raise CodecError(f"font: damaged file: {e}") from e

    def _read(self, table: str, at: int, kind: str) -> int:
        return struct.unpack_from(">" + kind, self.data, self.tables[table][0] + at)[0]

    def _cmap(self) -> dict[int, int]:
        base = self.tables["cmap"][0]
        kinds = {struct.unpack_from(">HH", self.data, base + 4 + 8 * i): struct.unpack_from(">I", self.data, base + 8 + 8 * i)[0] for i in range(struct.unpack_from(">H", self.data, base + 2)[0])}
        for key in ((3, 10), (0, 6), (0, 4), (3, 1), (0, 3), (0, 2), (0, 1), (0, 0)):
            if key in kinds:
                at = base + kinds[key]
                form = struct.unpack_from(">H", self.data, at)[0]
                if form in (4, 12):
                    return self._segments(at) if form == 4 else self._groups(at)
        raise CodecError("font: no character map that is known here")

    def _groups(self, at: int) -> dict[int, int]:
        out = {}
        for first, last, glyph in struct.iter_unpack(">III", self.data[at + 16 : at + 16 + 12 * struct.unpack_from(">I", self.data, at + 12)[0]]):
            if last > 0x10FFFF:
                raise CodecError("font: damaged character map")
            out.update((c, glyph + c - first) for c in range(first, last + 1))
        return out

    def _segments(self, at: int) -> dict[int, int]:
        n = struct.unpack_from(">H", self.data, at + 6)[0] // 2
        numbers = lambda start, kind="H": struct.unpack_from(f">{n}{kind}", self.data, start)
        ends, starts, deltas, offsets = numbers(at + 14), numbers(at + 16 + 2 * n), numbers(at + 16 + 4 * n), numbers(at + 16 + 6 * n)
        out = {}
        for i in range(n):
            for c in range(starts[i], min(ends[i], 0xFFFE) + 1):
                if offsets[i]:
                    glyph = struct.unpack_from(">H", self.data, at + 16 + 6 * n + 2 * i + offsets[i] + 2 * (c - starts[i]))[0]
                    glyph = (glyph + deltas[i]) & 0xFFFF if glyph else 0
                else:
                    glyph = (c + deltas[i]) & 0xFFFF
                if glyph:
                    out[c] = glyph
        return out

    def _kern(self) -> dict[tuple[int, int], int]:
        out: dict[tuple[int, int], int] = {}
        if "kern" not in self.tables or self._read("kern", 0, "H"):
            return out
        at = self.tables["kern"][0] + 4
        for _ in range(self._read("kern", 2, "H")):
            _, size, cover, n = struct.unpack_from(">HHHH", self.data, at)
            if cover >> 8 == 0 and cover & 7 == 1:  # format 0; horizontal, no minima, not across
                for a, b, v in struct.iter_unpack(">HHh", self.data[at + 14 : at + 14 + 6 * n]):
                    out.setdefault((a, b), v)
                size = max(size, 14 + 6 * n)
            at += size
        return out

    @property
    def names(self) -> dict[int, str]:
        """Names by number: 1 and 16 are families, 2 and 17 styles."""
        if "name" not in self.tables:
            return {}
        base, out = self.tables["name"][0], {}
        n, strings = struct.unpack_from(">HH", self.data, base + 2)
        for i in range(n):
            platform, _, language, number, size, at = struct.unpack_from(">HHHHHH", self.data, base + 6 + 12 * i)
            raw = self.data[base + strings + at : base + strings + at + size]
            if platform != 1 or number not in out:
                text = raw.decode("latin-1" if platform == 1 else "utf-16-be", "replace")
                if number not in out or language in (0, 0x409):
                    out[number] = text
        return out

    @property
    def regular(self) -> tuple[int, int, int]:
        """How far from upright, of normal width and weight; less is nearer."""
        if "OS/2" not in self.tables:
            return 0, 0, 0
        return self._read("OS/2", 62, "H") & 1, abs(self._read("OS/2", 6, "H") - 5), abs(self._read("OS/2", 4, "H") - 400)

    def glyph(self, char: str) -> int:
        return self.chars.get(ord(char), 0)

    # Metrics, in pixels: the font's height, from ascender to descender, is `size`.
    def scale(self, size: float) -> float:
        return size / (self.ascender - self.descender)

    def ascent(self, size: float) -> float:
        return self.ascender * self.scale(size)

    def pitch(self, size: float) -> float:
        return size + self.gap * self.scale(size)

    def advance(self, char: str, size: float) -> float:
        at = min(self.glyph(char), self.wide - 1)
        return self._read("hmtx", 4 * at, "H") * self.scale(size)

    def kern(self, left: str, right: str, size: float) -> float:
        return self.pairs.get((self.glyph(left), self.glyph(right)), 0) * self.scale(size)

    def outline(self, glyph: int, depth: int = 0) -> list[np.ndarray]:
        """Contours of (x, y, on the curve) in units of the font."""
        if glyph not in self._outlines:
            try:
                self._outlines[glyph] = self._outline(glyph, depth)
            except (struct.error, IndexError, ValueError) as e:
                raise CodecError(f"font: damaged glyph {glyph}: {e}") from e
        return self._outlines[glyph]

    def _outline(self, glyph: int, depth: int) -> list[np.ndarray]:
        if glyph >= self.count:
            return []
        at, end = (self._read("loca", 4 * g, "I") if self._long else 2 * self._read("loca", 2 * g, "H") for g in (glyph, glyph + 1))
        if end <= at:
            return []
        at += self.tables["glyf"][0]
        n = struct.unpack_from(">h", self.data, at)[0]
        return self._simple(at + 10, n) if n >= 0 else self._composite(at + 10, depth)

    def _simple(self, at: int, n: int) -> list[np.ndarray]:
        ends = struct.unpack_from(f">{n}H", self.data, at)
        total = ends[-1] + 1 if n else 0
        at += 2 * n
        at += 2 + struct.unpack_from(">H", self.data, at)[0]  # without the instructions
        flags: list[int] = []
        while len(flags) < total:
            f = self.data[at]
            at += 1
            again = 1
            if f & 8:
                again += self.data[at]
                at += 1
            flags += [f] * again
        points = np.zeros((total, 3), np.int64)
        points[:, 2] = [f & 1 for f in flags[:total]]
        for axis, short, same in ((0, 2, 16), (1, 4, 32)):
            value = 0
            for i, f in enumerate(flags[:total]):
                if f & short:
                    value += self.data[at] if f & same else -self.data[at]
                    at += 1
                elif not f & same:
                    value += struct.unpack_from(">h", self.data, at)[0]
                    at += 2
                points[i, axis] = value
        return np.split(points, [e + 1 for e in ends[:-1]]) if n else []

    def _composite(self, at: int, depth: int) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        if depth >= DEPTH:
            raise CodecError("font: glyphs of glyphs go too deep")
        more = True
        while more:
            flags, part = struct.unpack_from(">HH", self.data, at)
            at += 4
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", self.data, at)
            at += 4 if flags & 1 else 2
            n = 1 if flags & 8 else 2 if flags & 64 else 4 if flags & 128 else 0
            v = [x / 16384 for x in struct.unpack_from(f">{n}h", self.data, at)]
            at += 2 * n
            turn = np.array({0: [[1, 0], [0, 1]], 1: [[v[0], 0], [0, v[0]]] if n == 1 else 0, 2: [[v[0], 0], [0, v[1]]] if n == 2 else 0, 4: [v[:2], v[2:]] if n == 4 else 0}[n], float)
            for contour in self._outline(part, depth + 1):
                moved = contour.astype(float)
                moved[:, :2] = moved[:, :2] @ turn + ([dx, dy] if flags & 2 else [0, 0])
                out.append(moved)
            more = bool(flags & 32)
        return out

    def patch(self, char: str, x: float, baseline: float, size: float) -> tuple[int, int, np.ndarray] | None:
        """Coverage of a glyph drawn at a pen position: left, top, (height, width) values from 0 to 1; None without an outline."""
        k = self.scale(size)
        lines = [l for contour in self.outline(self.glyph(char)) for l in flattened(contour, k, x, baseline)]
        return exact_areas(np.concatenate(lines)) if lines else None


def flattened(contour: np.ndarray, k: float, x: float, baseline: float) -> list[np.ndarray]:
    """A closed contour as (x0, y0, x1, y1) in pixels, y downwards: two neighbouring points off the curve have one on it halfway."""
    points = [(x + k * p[0], baseline - k * p[1], bool(p[2])) for p in contour.tolist()]
    if len(points) < 2:
        return []
    full = []
    for i, p in enumerate(points):
        q = points[i - 1]
        if not p[2] and not q[2]:
            full.append(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2, True))
        full.append(p)
    first = next(i for i, p in enumerate(full) if p[2])
    full = full[first:] + full[: first + 1]
    path = [full[0][:2]]
    i = 1
    while i < len(full):
        if full[i][2]:
            path.append(full[i][:2])
            i += 1
            continue
        (ax, ay), (bx, by), (cx, cy) = path[-1], full[i][:2], full[i + 1][:2]
        n = max(1, math.ceil(math.sqrt(math.hypot(ax - 2 * bx + cx, ay - 2 * by + cy) / (4 * FLATNESS))))
        for j in range(1, n + 1):
            t = j / n
            path.append(((1 - t) ** 2 * ax + 2 * t * (1 - t) * bx + t * t * cx, (1 - t) ** 2 * ay + 2 * t * (1 - t) * by + t * t * cy))
        i += 2
    p = np.array(path)
    return [np.hstack([p[:-1], p[1:]])]


def exact_areas(lines: np.ndarray) -> tuple[int, int, np.ndarray]:
    """The share of each pixel inside closed lines (x0, y0, x1, y1), by signed areas: a piece of line within one pixel covers what is right of it, by its height."""
    left, top = int(np.floor(lines[:, 0::2].min())), int(np.floor(lines[:, 1::2].min()))
    width, height = int(np.ceil(lines[:, 0::2].max())) - left, int(np.ceil(lines[:, 1::2].max())) - top
    area = np.zeros((max(1, height) + 1, max(1, width) + 2))
    for x0, y0, x1, y1 in lines - [left, top, left, top]:
        if y0 == y1:
            continue
        cuts = [np.array([0.0, 1.0])]
        for a, b in ((x0, x1), (y0, y1)):
            if a != b:
                cuts.append((np.arange(math.floor(min(a, b)) + 1, math.ceil(max(a, b))) - a) / (b - a))
        t = np.unique(np.clip(np.concatenate(cuts), 0, 1))
        y = y0 + t * (y1 - y0)
        middle = (t[1:] + t[:-1]) / 2
        mx, my = x0 + middle * (x1 - x0), y0 + middle * (y1 - y0)
        cx, cy = np.floor(mx).astype(int), np.floor(my).astype(int)
        rise, right = np.diff(y), cx + 1 - mx
        np.add.at(area, (cy, cx), rise * right)
        np.add.at(area, (cy, cx + 1), rise * (1 - right))
    return left, top, np.minimum(np.abs(np.cumsum(area, axis=1)), 1.0)[: max(1, height), : max(1, width)]


@lru_cache(maxsize=16)
def load(path: str) -> TrueType:
    with open(path, "rb") as f:
        return TrueType(f.read())


@lru_cache(maxsize=8)
def families(folders: tuple[str, ...] = FOLDERS) -> dict[str, str]:
    """Family name in lower case to the file of its upright face of normal weight and width (or the nearest to that). Files that can't be read are passed over."""
    best: dict[str, tuple] = {}
    for folder in folders:
        for where, _, files in os.walk(os.path.expanduser(folder)):
            for name in files:
                if name.lower().endswith((".ttf", ".ttc")):
                    path = os.path.join(where, name)
                    try:
                        font = load(path)
                        named, rank = font.names, (*font.regular, path)
                    except (CodecError, OSError, struct.error):
                        continue
                    for family in {named.get(1), named.get(16)} - {None}:
                        best[family.lower()] = min(best.get(family.lower(), (rank, path)), (rank, path))
    return {family: path for family, (_, path) in best.items()}


def find(font: str | None, folders: tuple[str, ...] = FOLDERS) -> TrueType | None:
    """The font of a file, or of a family in some folders; None for no name and for a family that isn't there."""
    font = (font or "").strip()
    if not font:
        return None
    path = font if os.path.isfile(font) else families(tuple(folders)).get(font.lower())
    return load(path) if path else None
