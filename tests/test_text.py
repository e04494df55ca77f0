"""Text: the built-in font, TrueType outlines made here and, where there is one, an installed font."""

import os
import struct

import numpy as np
import pytest

from rasterloom.errors import CodecError
from rasterloom.functions import truetype
from rasterloom.functions.text import GLYPHS, StrokeFont, mask
from rasterloom.functions.truetype import TrueType, exact_areas, find, flattened
from rasterloom.operators.compose import to_pixels8
from rasterloom.plans.compiler import run
from rasterloom.plans.spec import Pipeline
from rasterloom.sources.images import sample
from rasterloom.sources.tables import ingest

INSTALLED = "/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf"


def glyph(contours):
    """A simple glyph of contours of (x, y, on)."""
    points = [p for c in contours for p in c]
    ends = np.cumsum([len(c) for c in contours]) - 1
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    deltas = lambda v: [b - a for a, b in zip([0, *v], v)]
    body = struct.pack(">hhhhh", len(contours), min(xs), min(ys), max(xs), max(ys)) + struct.pack(f">{len(ends)}H", *ends) + struct.pack(">H", 0)
    body += bytes(p[2] for p in points) + b"".join(struct.pack(">h", d) for v in (xs, ys) for d in deltas(v))
    return body + b"\0" * (-len(body) % 4)


BOX = [[(0, 0, 1), (0, 700, 1), (500, 700, 1), (500, 0, 1)]]
RING = [[(0, 0, 1), (0, 600, 1), (600, 600, 1), (600, 0, 1)], [(150, 150, 1), (450, 150, 1), (450, 450, 1), (150, 450, 1)]]
ROUND = [[(0, 0, 0), (0, 500, 0), (500, 500, 0), (500, 0, 0)]]  # no point on the curve
PLACED = struct.pack(">hhhhh", -1, 0, 0, 0, 0) + struct.pack(">HHbb", 2 | 32, 1, 0, 0) + struct.pack(">HHhhh", 1 | 2 | 8, 1, 600, 100, 8192) + b"\0\0"  # the box, and it again at half size


def family(name="Own Sans", weight=400, glyphs=(BOX, RING, ROUND), kern=((1, 2, -120),), twelve=False):
    bodies = [b"", *(glyph(g) for g in glyphs), PLACED]
    places = np.cumsum([0, *map(len, bodies)])
    if twelve:
        cmap = struct.pack(">HHHHI", 0, 1, 3, 10, 12) + struct.pack(">HHIIIIII", 12, 0, 28, 0, 1, ord("A"), ord("D"), 1)
    else:
        cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HHHHHhhHH", ord("D"), 0xFFFF, 0, ord("A"), 0xFFFF, 1 - ord("A"), 1, 0, 0)
    text = name.encode("utf-16-be")
    tables = {
        "OS/2": struct.pack(">HhHHH", 4, 0, weight, 5, 0) + bytes(52) + struct.pack(">HHHhhh", 0, 0, 0, 0, 0, 0) + bytes(10), "cmap": cmap, "glyf": b"".join(bodies), "head": bytes(18) + struct.pack(">H", 1000) + bytes(30) + struct.pack(">hh", 1, 0),
        "hhea": struct.pack(">Ihhh", 0x10000, 800, -200, 100) + bytes(24) + struct.pack(">H", 2), "hmtx": struct.pack(">HhHh", 300, 0, 640, 0) + bytes(2 * (len(bodies) - 2)),
        "kern": struct.pack(">HH", 0, 1) + struct.pack(">HHHHHHH", 0, 14 + 6 * len(kern), 1, len(kern), 0, 0, 0) + b"".join(struct.pack(">HHh", *k) for k in kern),
        "loca": struct.pack(f">{len(places)}I", *places), "maxp": struct.pack(">IH", 0x10000, len(bodies)), "name": struct.pack(">HHH", 0, 1, 18) + struct.pack(">HHHHHH", 3, 1, 0x409, 1, len(text), 0) + text,
    }
    out, at = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), 12 + 16 * len(tables)
    for tag, body in tables.items():
        out += struct.pack(">4sIII", tag.encode(), 0, at, len(body))
        at += len(body)
    return out + b"".join(tables.values())


def sampled(lines, left, top, shape, n=24):
    """Shares of pixels inside closed lines by the winding number of many points."""
    at = (np.arange(n) + 0.5) / n
    out = np.zeros(shape)
    for j in range(shape[0]):
        for i in range(shape[1]):
            px, py = np.meshgrid(left + i + at, top + j + at)
            winding = np.zeros_like(px, int)
            for x0, y0, x1, y1 in lines:
                if y0 != y1:
                    met = ((y0 <= py) != (y1 <= py)) & (x0 + (py - y0) / (y1 - y0) * (x1 - x0) < px)
                    winding += np.where(met, 1 if y1 > y0 else -1, 0)
            out[j, i] = (winding != 0).mean()
    return out


@pytest.fixture
def fonts(tmp_path):
    (tmp_path / "regular.ttf").write_bytes(family())
    (tmp_path / "bold.ttf").write_bytes(family(weight=700))
    (tmp_path / "other.ttf").write_bytes(family("Other", twelve=True))
    (tmp_path / "broken.ttf").write_bytes(family("Broken")[:300])
    truetype.families.cache_clear()
    return str(tmp_path)


@pytest.mark.parametrize("twelve", [False, True])
def test_metrics_and_kerning(twelve):
    f = TrueType(family(twelve=twelve))
    assert [f.glyph(c) for c in "ABCDEa"] == [1, 2, 3, 4, 0, 0]
    assert f.ascent(50) == 40 and f.pitch(50) == 55  # a height of 1000 units
    assert f.advance("A", 50) == 32 and f.advance("C", 50) == 32 and f.kern("A", "B", 50) == -6 and f.kern("B", "A", 50) == 0


def test_areas_are_exact():
    f, k = TrueType(family()), 0.0371
    for char, units in (("A", 500 * 700), ("B", 600**2 - 300**2), ("D", 500 * 700 * 1.25)):
        lines = np.concatenate([l for c in f.outline(f.glyph(char)) for l in flattened(c, k, 3.3, 40.7)])
        left, top, cover = exact_areas(lines)
        assert np.isclose(cover.sum(), units * k * k) and cover.min() >= 0 and cover.max() <= 1
        assert np.abs(cover - sampled(lines, left, top, cover.shape)).max() < 0.07
    lines = np.concatenate([l for c in f.outline(f.glyph("C")) for l in flattened(c, k, 0.2, 30.1)])
    left, top, cover = exact_areas(lines)
    x0, y0, x1, y1 = lines.T
    assert np.isclose(cover.sum(), abs((x0 * y1 - x1 * y0).sum()) / 2)
    assert abs(cover.sum() / (k * k) - 500 * 500 * 5 / 6) < 1500  # four parabolas cut a sixth off their square


def test_mask_with_a_font(fonts):
    path = os.path.join(fonts, "regular.ttf")
    a, b = (dict(((x, y), c) for x, y, c in mask(t, 10, 50, 50, font=path)) for t in "AB")
    both = dict(((x, y), c) for x, y, c in mask("AB", 10, 50, 50, font=path))
    moved = {}
    for (x, y), c in a.items():
        moved[x, y] = max(moved.get((x, y), 0), c)
    for (x, y), c in b.items():
        moved[x + 26, y] = max(moved.get((x + 26, y), 0), c)  # 32 less 6 of kerning
    assert both.keys() == moved.keys() and all(np.isclose(both[p], moved[p]) for p in both)
    right = mask("A", 100, 50, 50, "right", font=path)
    assert min(x for x, *_ in right) == 68 and min(y for _, y, _ in right) == 50 - 35
    two = mask("A\nA", 0, 0, 50, "left", "top", font=path)
    assert max(y for _, y, _ in two) == 40 + 55 - 1
    assert max(y for _, y, _ in mask("A\nA", 0, 0, 50, "left", "top", 20, font=path)) == 40 + 20 - 1
    assert not mask(" \n ", 0, 0, 20)


def test_families(fonts):
    assert find("own sans", (fonts,)).regular[2] == 0 and find("OTHER", (fonts,)).glyph("B") == 2
    assert find(None) is None and find("  ") is None and find("No Such Family 123", (fonts,)) is None and find("Broken", (fonts,)) is None
    assert mask("A", 0, 20, 20, font="Own Sans", folders=(fonts,)) != mask("A", 0, 20, 20) == mask("A", 0, 20, 20, font="No Such Family 123", folders=(fonts,))


def test_damaged_fonts():
    whole = family()
    for data in (b"", b"OTTO" + whole[4:], whole[:100], whole[:250], whole[:-3].replace(b"glyf", b"glyx")):
        with pytest.raises(CodecError):
            f = TrueType(data)
            f.patch("A", 0, 10, 10)
    loop = struct.pack(">hhhhh", -1, 0, 0, 0, 0) + struct.pack(">HHbb", 2, 4, 0, 0)
    looped = TrueType(whole.replace(PLACED, loop + b"\0" * (len(PLACED) - len(loop))))
    with pytest.raises(CodecError):
        looped.patch("D", 0, 10, 10)


def test_built_in_font():
    assert {*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"} <= GLYPHS.keys()
    assert mask("a", 0, 30, 30) != mask("A", 0, 30, 30) and mask("é", 0, 30, 30) == mask("e", 0, 30, 30)
    heights = {c: 30 - min(y for _, y, _ in mask(c, 0, 30, 30)) for c in "xXh"}
    assert heights["x"] < heights["h"] == heights["X"]
    assert max(y for _, y, _ in mask("p", 0, 30, 30)) > 31 and StrokeFont().kern("A", "V", 30) == 0


@pytest.mark.skipif(not os.path.isfile(INSTALLED), reason="the font isn't installed")
def test_installed_font():
    f = find(INSTALLED)
    assert "dejavu sans" in truetype.families() and f.kern("A", "V", 100) < 0
    for char in "aß&Яé%":
        lines = np.concatenate([l for c in f.outline(f.glyph(char)) for l in flattened(c, f.scale(30), 2.4, 25.6)])
        left, top, cover = exact_areas(lines)
        assert np.abs(cover - sampled(lines, left, top, cover.shape)).max() < 0.08
    assert len(mask("AV", 0, 60, 60, font=INSTALLED)) and max(x for x, *_ in mask("AV", 0, 60, 60, font=INSTALLED)) < max(x for x, *_ in mask("V", f.advance("A", 60), 60, 60, font=INSTALLED))


def test_pipeline_with_a_font(spark, fonts):
    px = ingest(sample(spark, 40, 30))
    path = os.path.join(fonts, "regular.ttf")
    step = {"op": "draw_text", "x": 5, "y": 25, "text": "A", "color": "red", "font_size": 20, "font": path}
    p = Pipeline.parse([step])
    assert p.validate((40, 30)) == [(40, 30)] and Pipeline.parse(p.json()) == p
    red = {(r.x, r.y) for r in to_pixels8(run(px, p)).where("r8 = 255 and g8 = 0 and b8 = 0").collect()}
    assert red == {(x, y) for x, y, c in mask("A", 5, 25, 20, font=path) if c > 0.999} and len(red) == 10 * 14
