"""DuckDB SQL for the raster queries, written apart from the DataFrame code.

Floating-point results are rounded to six digits on both sides, as sums and powers differ in their last bits.
"""

from __future__ import annotations

import math

import numpy as np

from .functions.color import Rgba

KEY = "img_id, x, y"


def n(v: float) -> str:
    return f"({float(v)!r}::DOUBLE)"


def clamp(e: str) -> str:
    return f"least(greatest({e}, {n(0)}), {n(1)})"


def dec(e: str) -> str:
    c = clamp(e)
    return f"(CASE WHEN {c} <= {n(0.04045)} THEN {c} / {n(12.92)} ELSE pow(({c} + {n(0.055)}) / {n(1.055)}, {n(2.4)}) END)"


def enc(e: str) -> str:
    c = clamp(e)
    return f"(CASE WHEN {c} <= {n(0.0031308)} THEN {c} * {n(12.92)} ELSE {n(1.055)} * pow({c}, {n(1 / 2.4)}) - {n(0.055)} END)"


def enc8(e: str) -> str:
    return f"CAST(floor({enc(f'(floor({clamp(e)} * {n(65535)} + {n(.5)}) / {n(65535)})')} * {n(255)} + {n(.5)}) AS INTEGER)"


ORDERS8 = """o8 AS (SELECT o_orderkey // 500 AS img_id, CAST(o_orderkey % 500 % 25 AS INTEGER) AS x, CAST((o_orderkey % 500) // 25 AS INTEGER) AS y, 25 AS width, 20 AS height,
  CAST(o_custkey % 256 AS INTEGER) AS r8, CAST(floor(o_totalprice) AS BIGINT) % 256 AS g8, o_orderkey * 7 % 256 AS b8, CASE WHEN o_orderstatus = 'P' THEN 128 ELSE 255 END AS a8 FROM orders)"""
EVENTS8 = """o8 AS (SELECT CAST(0 AS BIGINT) AS img_id, CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, 100 AS width, CAST((SELECT (max(event_id) + 1) // 100 FROM events) AS INTEGER) AS height,
  CAST(floor(value) AS BIGINT) % 256 AS r8, user_id % 256 AS g8, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 64 WHEN 'purchase' THEN 128 WHEN 'signup' THEN 192 ELSE 255 END AS b8, 255 AS a8
  FROM events WHERE event_id < (SELECT (max(event_id) + 1) // 100 * 100 FROM events))"""
INGEST = "px AS MATERIALIZED (SELECT img_id, x, y, width, height, " + ", ".join(f"{dec(f'({c}8 / {n(255)})')} * (a8 / {n(255)}) AS {c}" for c in "rgb") + f", a8 / {n(255)} AS a FROM o8)"
EMB = """px AS MATERIALIZED (SELECT img_id, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y, 8 AS width, 8 AS height, v AS r, v AS g, v AS b, 1::DOUBLE AS a
  FROM (SELECT vec_id AS img_id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"""
ORDERS = f"{ORDERS8}, {INGEST}"
EVENTS = f"{EVENTS8}, {INGEST}"


def out8(cte: str) -> str:
    straight = ", ".join(f"CASE WHEN a <= 0 THEN 0 ELSE {enc8(f'{c} / CASE WHEN a > 0 THEN a ELSE 1 END')} END AS {c}8" for c in "rgb")
    return f"SELECT img_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {straight}, CAST(floor({clamp('a')} * {n(255)} + {n(.5)}) AS INTEGER) AS a8 FROM {cte}"


def out6(cte: str, columns: str = "rgba") -> str:
    return f"SELECT img_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {', '.join(f'round({c}, 6) + 0::DOUBLE AS {c}' for c in columns)} FROM {cte}"


def query(source: str, steps: list[str], out: str) -> str:
    return f"WITH {', '.join([source, *steps])} {out}"


def step(name: str, columns: dict[str, str], of: str = "px", where: str = "") -> str:
    """A projection of all pixel columns, some replaced."""
    names = ["img_id", "x", "y", "width", "height", "r", "g", "b", "a"]
    return f"{name} AS (SELECT {', '.join(f'{columns.get(c, c)} AS {c}' for c in names)} FROM {of}{f' WHERE {where}' if where else ''})"


def linear(m: list[list[float]]) -> dict[str, str]:
    return {c: " + ".join(f"{n(w)} * {s}" for w, s in zip(row, "rgb")) for c, row in zip("rgb", m)}


def srgb_step(f) -> list[str]:
    """Steps s (straight sRGB) and t (mapped) from px; f takes and returns SQL of r, g, b."""
    seen = ", ".join(f"{enc(f'({c} / a)')} AS s{c}" for c in "rgb")
    mapped = ", ".join(f"{dec(e)} * a AS {c}" for c, e in zip("rgb", f("sr", "sg", "sb")))
    return [f"s AS (SELECT *, {seen} FROM px WHERE a > 0)", f"t AS (SELECT img_id, x, y, width, height, {mapped}, a FROM s UNION ALL SELECT img_id, x, y, width, height, r, g, b, a FROM px WHERE a <= 0)"]


def over(paint: tuple, cover: str) -> dict[str, str]:
    """Source-over of a premultiplied paint at SQL coverage."""
    c = clamp(cover)
    return {ch: f"CASE WHEN {c} > 0 THEN {n(p)} * {c} + {ch} * (1 - {n(paint[3])} * {c}) ELSE {ch} END" for ch, p in zip("rgba", paint)}


def box_distance(cx: str, cy: str, hw: str, hh: str, r: str) -> str:
    qx, qy = f"(abs(x + 0.5::DOUBLE - {cx}) - {hw} + {r})", f"(abs(y + 0.5::DOUBLE - {cy}) - {hh} + {r})"
    return f"(least(greatest({qx}, {qy}), 0) + sqrt(pow(greatest({qx}, 0), 2) + pow(greatest({qy}, 0), 2)) - {r})"


def ellipse_distance(cx: float, cy: float, rx: float, ry: float) -> str:
    dx, dy = f"(x + 0.5::DOUBLE - {n(cx)})", f"(y + 0.5::DOUBLE - {n(cy)})"
    f = f"({dx} * {dx} / {n(rx * rx)} + {dy} * {dy} / {n(ry * ry)} - 1)"
    g = f"sqrt(pow(2 * {dx} / {n(rx * rx)}, 2) + pow(2 * {dy} / {n(ry * ry)}, 2))"
    return f"(CASE WHEN {g} > 1e-9 THEN {f} / {g} ELSE {f} END)"


def segment_distance(ax: float, ay: float, bx: float, by: float) -> str:
    vx, vy = bx - ax, by - ay
    t = clamp(f"(((x + 0.5::DOUBLE - {n(ax)}) * {n(vx)} + (y + 0.5::DOUBLE - {n(ay)}) * {n(vy)}) / {n(vx * vx + vy * vy)})")
    return f"sqrt(pow(x + 0.5::DOUBLE - {n(ax)} - {t} * {n(vx)}, 2) + pow(y + 0.5::DOUBLE - {n(ay)} - {t} * {n(vy)}, 2))"


def aa(d: str) -> str:
    return clamp(f"({n(.5)} - {d})")


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(n(v) if isinstance(v, float) else str(v) for v in r) + ')' for r in rows)})"


def _kernel(how: str, t: float) -> float:
    t = abs(t)
    if how == "nearest":
        return float(t < 0.5)
    if how == "bilinear":
        return max(0.0, 1 - t)
    if how == "catmull_rom":
        return 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0
    sinc = lambda v: math.sin(math.pi * v) / (math.pi * v) if v else 1.0
    return sinc(t) * sinc(t / 3) if t < 3 else 0.0


def taps(name: str, n_in: int, n_out: int, how: str) -> str:
    """Of every output sample the weight of every input sample, by the kernel's definition."""
    rows, wide = [], max(n_in / n_out, 1)
    for o in range(n_out):
        weights = [_kernel(how, (i + 0.5 - (o + 0.5) * n_in / n_out) / wide) for i in range(n_in)]
        if not any(weights):  # between two samples: the later one
            weights[min(math.floor((o + 0.5) * n_in / n_out), n_in - 1)] = 1.0
        rows += [(o, i, w / sum(weights)) for i, w in enumerate(weights) if w]
    return values(name, "o, i, w", rows)


def blur_taps(name: str, size: int, sigma: float) -> str:
    half = max(1, math.ceil(3 * sigma))
    bell = {k: math.exp(-(k**2) / 2 / sigma**2) for k in range(-half, half + 1)}
    return values(name, "o, i, w", [(o, sorted((0, o + k, size - 1))[1], v / sum(bell.values())) for o in range(size) for k, v in bell.items()])


def arrow_segments(x1: float, y1: float, x2: float, y2: float, head: float, cosine: float = 0.88, sine: float = 0.475) -> list[tuple[float, float, float, float]]:
    """The shaft, and the two strokes of the head: the way back along the shaft, turned to either side."""
    back = complex(x1 - x2, y1 - y2) / abs(complex(x1 - x2, y1 - y2)) * head
    ends = [complex(x2, y2) + back * complex(cosine, k * sine) for k in (1, -1)]
    return [(x1, y1, x2, y2), *((x2, y2, e.real, e.imag) for e in ends)]


def blurred(source: str, name: str, sigma: float) -> list[str]:
    """Two passes over images of any size, by offsets from each pixel."""
    half = max(1, math.ceil(3 * sigma))
    bell = {k: math.exp(-(k**2) / 2 / sigma**2) for k in range(-half, half + 1)}
    one = lambda of, side, size, other: f"(SELECT c.img_id, c.x, c.y, c.width, c.height, {', '.join(f'sum(p.{ch} * w) AS {ch}' for ch in 'rgba')} FROM {of} c, bell JOIN {of} p ON p.img_id = c.img_id AND p.{other} = c.{other} AND p.{side} = least(greatest(c.{side} + k, 0), c.{size} - 1) GROUP BY ALL)"
    return [values("bell", "k, w", [(k, v / sum(bell.values())) for k, v in bell.items()]), f"{name}_h AS {one(source, 'x', 'width', 'y')}", f"{name} AS {one(f'{name}_h', 'y', 'height', 'x')}"]


def separable(source: str, name: str, along_x: str, along_y: str, width: int, height: int, columns: str = "rgba") -> list[str]:
    """Two passes as joins with tap tables."""
    sums = ", ".join(f"sum({c} * w) AS {c}" for c in columns)
    return [
        f"{name}_h AS (SELECT img_id, o AS x, y, {sums} FROM {source} JOIN {along_x} ON x = i GROUP BY img_id, o, y)",
        f"{name} AS (SELECT img_id, x, o AS y, {width} AS width, {height} AS height, {sums} FROM {name}_h JOIN {along_y} ON y = i GROUP BY img_id, x, o)",
    ]


def turned(degrees: float, w: int, h: int, out_w: int, out_h: int) -> list[str]:
    s, c = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
    cells = f"""g AS (SELECT img_id, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y,
      {n(w / 2)} + {n(c)} * (gx + 0.5::DOUBLE - {n(out_w / 2)}) + {n(s)} * (gy + 0.5::DOUBLE - {n(out_h / 2)}) - 0.5::DOUBLE AS sx,
      {n(h / 2)} - {n(s)} * (gx + 0.5::DOUBLE - {n(out_w / 2)}) + {n(c)} * (gy + 0.5::DOUBLE - {n(out_h / 2)}) - 0.5::DOUBLE AS sy
      FROM (SELECT DISTINCT img_id FROM px), (SELECT unnest(range({out_w})) AS gx), (SELECT unnest(range({out_h})) AS gy))"""
    tap = " UNION ALL ".join(f"SELECT img_id, x, y, CAST(floor(sx) AS INTEGER) + {i} AS px0, CAST(floor(sy) AS INTEGER) + {j} AS py0, {'(sx - floor(sx))' if i else '(1 - (sx - floor(sx)))'} * {'(sy - floor(sy))' if j else '(1 - (sy - floor(sy)))'} AS w FROM g" for i in (0, 1) for j in (0, 1))
    sums = ", ".join(f"sum(coalesce(p.{c} * w, 0)) AS {c}" for c in "rgba")
    return [cells, f"q AS ({tap})", f"t AS (SELECT q.img_id, q.x, q.y, {sums} FROM q LEFT JOIN px p ON p.img_id = q.img_id AND p.x = q.px0 AND p.y = q.py0 GROUP BY q.img_id, q.x, q.y)"]


def grid(name: str, width: int, height: int) -> str:
    return f"{name} AS (SELECT img_id, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y FROM (SELECT DISTINCT img_id FROM px), (SELECT unnest(range({width})) AS gx), (SELECT unnest(range({height})) AS gy))"


def placed(name: str, canvas: str, top: str, dx: int, dy: int, opacity: float = 1.0, back: tuple | None = None) -> str:
    """top moved by (dx, dy) over a canvas with its own colours, or over a fixed colour."""
    under = {c: n(v) if back else f"c.{c}" for c, v in zip("rgba", back or (0, 0, 0, 0))}
    blended = ", ".join(f"coalesce(t.{c} * {n(opacity)}, 0) + {under[c]} * (1 - coalesce(t.a * {n(opacity)}, 0)) AS {c}" for c in "rgba")
    return f"{name} AS (SELECT c.img_id, c.x, c.y, {blended} FROM {canvas} c LEFT JOIN {top} t ON t.img_id = c.img_id AND t.x + {dx} = c.x AND t.y + {dy} = c.y)"


#: The strokes of some letters of the built-in font, in a cell of unit size with the baseline at 1.
_LETTERS = {
    "H": [(0, 0, 0, 1), (1, 0, 1, 1), (0, 0.5, 1, 0.5)], "O": [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)], "!": [(0.5, 0, 0.5, 0.5), (0.5, 0.92, 0.5, 1)],
    "i": [(0.5, 0.35, 0.5, 1), (0.5, 0.06, 0.5, 0.14)], "k": [(0, 0, 0, 1), (1, 0.35, 0, 0.68), (0, 0.68, 1, 1)],
}


def text_cover(lines: list[str], middle: float, top: float, size: float) -> str:
    """Coverage by lines of text that are centred and hang from `top`: cells half as wide as the size and 0.7 as high, 0.14 apart, strokes of 0.09, lines of 1.2 with the baseline at 0.8."""
    strokes = []
    for row, line in enumerate(lines):
        left = middle - (0.64 * len(line) - 0.14) * size / 2
        for i, letter in enumerate(line):
            ox, oy = left + 0.64 * size * i, top + (1.2 * row + 0.1) * size
            strokes += [segment_distance(ox + 0.5 * size * a, oy + 0.7 * size * b, ox + 0.5 * size * c, oy + 0.7 * size * d) for a, b, c, d in _LETTERS[letter]]
    return aa(f"(least({', '.join(strokes)}) - {n(0.045 * size)})")


def beautified(width: int, height: int, pad: int, radius: float, sigma: float, opacity: float, down: int, background: Rgba) -> list[str]:
    ow, oh = width + 2 * pad, height + 2 * pad
    cover = aa(box_distance(n(width / 2), n(height / 2), n(width / 2), n(height / 2), n(min(radius, width / 2, height / 2))))
    rounded = step("src", {c: f"{c} * {cover}" for c in "rgba"})
    silhouette = f"sil AS (SELECT c.img_id, c.x, c.y, coalesce(s.a * {n(opacity)}, 0) AS a FROM canvas c LEFT JOIN src s ON s.img_id = c.img_id AND s.x + {pad} = c.x AND s.y + {pad + down} = c.y)"
    b = background.premultiplied()
    shaded = f"shaded AS (SELECT img_id, x, y, {', '.join(f'{n(v)} * (1 - a) AS {c}' for c, v in zip('rgb', b))}, a + {n(b[3])} * (1 - a) AS a FROM soft)"
    return [rounded, grid("canvas", ow, oh), silhouette, blur_taps("bx", ow, sigma), blur_taps("bv", oh, sigma), *separable("sil", "soft", "bx", "bv", ow, oh, "a"), shaded, placed("t", "shaded", "src", pad, pad)]


def hue(degrees: float) -> list[list[float]]:
    """The standard's hueRotate: what its grey part, its cosine part and its sine part add up to, row by row."""
    c, s = math.cos(degrees * math.pi / 180), math.sin(degrees * math.pi / 180)
    return [
        [0.213 + 0.787 * c - 0.213 * s, 0.715 - 0.715 * c - 0.715 * s, 0.072 - 0.072 * c + 0.928 * s],
        [0.213 - 0.213 * c + 0.143 * s, 0.715 + 0.285 * c + 0.140 * s, 0.072 - 0.072 * c - 0.283 * s],
        [0.213 - 0.213 * c - 0.787 * s, 0.715 - 0.715 * c + 0.715 * s, 0.072 + 0.928 * c + 0.072 * s],
    ]


def curve_values(points: list) -> list[float]:
    at = np.arange(256) / 255
    x, y = zip(*sorted(points))
    return np.clip(np.interp(at, x, y), 0, 1).tolist()


