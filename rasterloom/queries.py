"""The raster queries: one per operation, and its SQL. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as o
from .functions.color import Rgba, decode8, encode8
from .operators import compose, geometry
from .operators.compose import to_pixels8
from .plans.compiler import run, sizes_of
from .plans.spec import Op, Pipeline
from .sources.tables import emb_px, events_px8, ingest, orders_px, orders_px8

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def out6(df: DataFrame, columns: str = "rgba") -> DataFrame:
    return df.select("img_id", C("x").cast("int").alias("x"), C("y").cast("int").alias("y"), *((F.round(c, 6) + 0.0).alias(c) for c in columns))


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def _op(name: str, op: str, steps: list[str], source: str = "orders", of: str = "t", exact8: bool = True, **params) -> None:
    """A query of one operation over a source, as 8-bit pixels or rounded linear ones."""
    read, sql, size = {"orders": (orders_px, o.ORDERS, (25, 20)), "emb": (emb_px, o.EMB, (8, 8))}[source]
    pipeline = Pipeline((Op.of(op, **params),))
    add(name, lambda spark, d: (to_pixels8 if exact8 else out6)(run(read(spark, d), pipeline, [size])), o.query(sql, steps, (o.out8 if exact8 else o.out6)(of)))


# Transfer, ingest, probes.
add("srgb_decode", lambda s, d: orders_px8(s, d).select("img_id", "x", "y", F.round(decode8(C("r8")), 9).alias("lin")), f"WITH {o.ORDERS8} SELECT img_id, x, y, round({o.dec(f'(r8 / {o.n(255)})')}, 9) AS lin FROM o8")
add("srgb_encode", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", encode8(C("o_totalprice") - F.floor("o_totalprice")).alias("v8")), f"SELECT o_orderkey, {o.enc8('(o_totalprice - floor(o_totalprice))')} AS v8 FROM orders")
add("ingest_premul", lambda s, d: out6(orders_px(s, d)), o.query(o.ORDERS, [], o.out6("px")))
add("egress_round_trip", lambda s, d: to_pixels8(orders_px(s, d)), o.query(o.ORDERS, [], o.out8("px")))
add("pixel_probe", lambda s, d: out6(orders_px(s, d).where("x = 3 AND y = 4")), o.query(o.ORDERS, [], o.out6("px WHERE x = 3 AND y = 4")))
add(
    "tile_grid",
    lambda s, d: orders_px8(s, d).groupBy("img_id", F.expr("x div 8").alias("tcol"), F.expr("y div 8").alias("trow")).agg(F.count(F.lit(1)).alias("pixels"), F.sum("r8").alias("sum_r")),
    f"WITH {o.ORDERS8} SELECT img_id, CAST(x // 8 AS BIGINT) AS tcol, CAST(y // 8 AS BIGINT) AS trow, count(*) AS pixels, CAST(sum(r8) AS BIGINT) AS sum_r FROM o8 GROUP BY ALL",
)
add("image_info", lambda s, d: geometry.images(orders_px8(s, d)), f"WITH {o.ORDERS8} SELECT img_id, max(width) AS width, max(height) AS height FROM o8 GROUP BY img_id")

# Pointwise.
_op("exposure", "exposure", [o.step("t", {c: f"{c} * {o.n(2 ** .5)}" for c in "rgb"})], stops=0.5)
_op("grayscale", "grayscale", [o.step("t", o.linear([[0.2126, 0.7152, 0.0722]] * 3))])
_op("hue_rotate", "hue_rotate", [o.step("t", o.linear(o.hue(40)))], degrees=40)
_op("white_balance", "white_balance", [o.step("t", {"r": f"r * {o.n(1.2)}", "g": f"g * {o.n(0.9)}", "b": f"b * {o.n(0.8)}"})], temperature=0.5, tint=0.25)
_op("invert", "invert", o.srgb_step(lambda *s: [f"(1 - {x})" for x in s]))
_op("brightness_contrast", "brightness_contrast", o.srgb_step(lambda *s: [o.clamp(f"(({x} - {o.n(.5)}) * {o.n(1.3)} + {o.n(.5)} + {o.n(.1)})") for x in s]), brightness=0.1, contrast=0.3)
_LUMA = f"({o.n(.299)} * sr + {o.n(.587)} * sg + {o.n(.114)} * sb)"
_op("saturation", "saturation", o.srgb_step(lambda *s: [o.clamp(f"({_LUMA} + ({x} - {_LUMA}) * {o.n(1.6)})") for x in s]), amount=1.6)
_op("levels", "levels", o.srgb_step(lambda *s: [o.clamp(f"(pow({o.clamp(f'(({x} - {o.n(.1)}) / {o.n(.8)})')}, {o.n(1 / 1.4)}) * {o.n(.85)} + {o.n(.05)})") for x in s]), in_black=0.1, in_white=0.9, gamma=1.4, out_black=0.05, out_white=0.9)
_POINTS = [[0.0, 0.05], [0.4, 0.6], [1.0, 0.9]]
_op("curves", "curves", o.srgb_step(lambda *s: [f"([{', '.join(map(o.n, o.curve_values(_POINTS)))}])[CAST(floor({x} * {o.n(255)} + {o.n(.5)}) AS INTEGER) + 1]" for x in s]), points=_POINTS)
_LOW, _MID, _HIGH = Rgba(20, 0, 80), Rgba(200, 60, 60), Rgba(255, 240, 180)
_op(
    "gradient_map",
    "gradient_map",
    o.srgb_step(lambda *s: [f"CASE WHEN {o.clamp(_LUMA)} < {o.n(.5)} THEN {o.n(a)} + ({o.n(m - a)}) * ({o.clamp(_LUMA)} * 2) ELSE {o.n(m)} + ({o.n(z - m)}) * ({o.clamp(_LUMA)} * 2 - 1) END" for a, m, z in zip(_LOW.srgb(), _MID.srgb(), _HIGH.srgb())]),
    low=_LOW, mid=_MID, high=_HIGH,
)
_V = f"((sqrt(pow(x + 0.5::DOUBLE - 12.5::DOUBLE, 2) + pow(y + 0.5::DOUBLE - 10::DOUBLE, 2)) / {o.n((12.5**2 + 10**2) ** .5)} - {o.n(.4)}) / {o.n(.6)})"
_op("vignette", "vignette", [f"v AS (SELECT *, {o.n(.7)} * pow({o.clamp(_V)}, 2) * (3 - 2 * {o.clamp(_V)}) AS cov FROM px)", o.step("t", {c: f"CASE WHEN cov > 0 THEN {c} * (1 - cov){' + cov' if c == 'a' else ''} ELSE {c} END" for c in "rgba"}, "v")], amount=0.7, feather=0.6)
_op("spotlight", "spotlight", [o.step("t", o.over(Rgba(0, 0, 60).premultiplied(), f"((1 - {o.clamp(f'({o.n(.5)} - {o.box_distance(o.n(11), o.n(9.5), o.n(6), o.n(4.5), o.n(3))} / {o.n(2)})')}) * {o.n(.6)})"))], x=5, y=5, width=12, height=9, corner_radius=3, dim=0.6, color=Rgba(0, 0, 60), feather=2)

# Geometry.
_op("crop", "crop", [o.step("t", {"x": "x - 4", "y": "y - 3"}, where="x >= 4 AND x < 20 AND y >= 3 AND y < 15")], x=4, y=3, width=16, height=12)
_op("flip_horizontal", "flip", [o.step("t", {"x": "24 - x"})], axis="horizontal")
_op("flip_vertical", "flip", [o.step("t", {"y": "19 - y"})], axis="v")
_op("rotate_90", "rotate", [o.step("t", {"x": "19 - y", "y": "x"})], degrees=90)
_op("rotate_180", "rotate", [o.step("t", {"x": "24 - x", "y": "19 - y"})], degrees=-180)
_op("rotate_270", "rotate", [o.step("t", {"x": "y", "y": "24 - x"})], degrees=270)
_op("rotate_45_expand", "rotate", o.turned(45, 8, 8, 12, 12), "emb", exact8=False, degrees=45)
_op("rotate_30_in_place", "rotate", o.turned(30, 8, 8, 8, 8), "emb", exact8=False, degrees=30, expand=False)
_op("pad", "pad", [o.grid("g", 33, 24), o.placed("t", "g", "px", 3, 1, 1.0, Rgba(255, 0, 0, 128).premultiplied()), "u AS (SELECT g.img_id, g.x, g.y, CASE WHEN g.x >= 3 AND g.x < 28 AND g.y >= 1 AND g.y < 21 THEN p.r ELSE t.r END AS r, CASE WHEN g.x >= 3 AND g.x < 28 AND g.y >= 1 AND g.y < 21 THEN p.g ELSE t.g END AS g, CASE WHEN g.x >= 3 AND g.x < 28 AND g.y >= 1 AND g.y < 21 THEN p.b ELSE t.b END AS b, CASE WHEN g.x >= 3 AND g.x < 28 AND g.y >= 1 AND g.y < 21 THEN p.a ELSE t.a END AS a FROM g JOIN t USING (img_id, x, y) LEFT JOIN px p ON p.img_id = g.img_id AND p.x + 3 = g.x AND p.y + 1 = g.y)"], of="u", left=3, right=5, top=1, bottom=3, color=Rgba(255, 0, 0, 128))
_BOUNDS = "WITH {0}, bounds AS (SELECT p.img_id, min(p.x) AS l, min(p.y) AS t, max(p.x) AS r, max(p.y) AS b FROM px p JOIN px q ON p.img_id = q.img_id AND q.x = 0 AND q.y = 0 WHERE greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b), abs(p.a - q.a)) > 0.5::DOUBLE GROUP BY p.img_id)"
add("content_bounds", lambda s, d: geometry.content_bounds(emb_px(s, d), None, 0.5), _BOUNDS.format(o.EMB) + ' SELECT img_id, l AS "left", t AS top, r AS "right", b AS bottom FROM bounds')
add("trim", lambda s, d: out6(geometry.trim(emb_px(s, d), None, 0.5)), _BOUNDS.format(o.EMB) + ", k AS (SELECT px.img_id, px.x - l AS x, px.y - t AS y, px.r, px.g, px.b, px.a FROM px JOIN bounds ON px.img_id = bounds.img_id WHERE px.x BETWEEN l AND bounds.r AND px.y BETWEEN t AND bounds.b) " + o.out6("k"))

# Stencils.
_op("blur", "blur", [o.blur_taps("bx", 8, 1.2), *o.separable("px", "t", "bx", "bx", 8, 8)], "emb", exact8=False, radius=1.2)
_op("sharpen", "sharpen", [o.blur_taps("bx", 8, 1.0), *o.separable("px", "soft", "bx", "bx", 8, 8), "t AS (SELECT img_id, x, y, " + ", ".join(f"p.{c} + 1.5::DOUBLE * (p.{c} - s.{c}) AS {c}" for c in "rgb") + ", p.a AS a FROM px p JOIN soft s USING (img_id, x, y))"], "emb", exact8=False, amount=1.5, radius=1.0)
for _how in ("nearest", "bilinear", "catmull_rom", "lanczos3"):
    _op(f"resize_{_how}", "resize", [o.taps("tx", 8, 5, _how), o.taps("ty", 8, 11, _how), *o.separable("px", "t", "tx", "ty", 5, 11)], "emb", exact8=False, width=5, height=11, filter=_how)
_op("resize_keep_aspect", "resize", [o.taps("tx", 25, 15, "lanczos3"), o.taps("ty", 20, 12, "lanczos3"), *o.separable("px", "t", "tx", "ty", 15, 12)], exact8=False, width=15)
add("blur_one_image", lambda s, d: out6(run(ingest(events_px8(s, d)), Pipeline((Op.of("blur", radius=2.0),)))), o.query(o.EVENTS, ["p1 AS (SELECT * FROM px WHERE y < height)", *o.blurred("p1", "t", 2.0)], o.out6("t")))

# Regions.
_op("redact_fill", "redact", [o.step("t", o.over(Rgba(10, 200, 30, 200).premultiplied(), "CASE WHEN x >= 2 AND x < 12 AND y >= 4 AND y < 14 THEN 1 ELSE 0 END"))], x=2.5, y=4.2, width=9, height=9.5, mode={"type": "fill", "color": Rgba(10, 200, 30, 200)})
_op(
    "redact_pixelate", "redact",
    ["cell AS (SELECT img_id, (x - 3) // 4 AS cx, (y - 2) // 4 AS cy, " + ", ".join(f"avg({c}) AS {c}" for c in "rgba") + " FROM px WHERE x >= 3 AND x < 17 AND y >= 2 AND y < 13 GROUP BY ALL)",
     "t AS (SELECT img_id, x, y, r, g, b, a FROM px WHERE NOT (x >= 3 AND x < 17 AND y >= 2 AND y < 13) UNION ALL SELECT p.img_id, x, y, c.r, c.g, c.b, c.a FROM px p JOIN cell c ON p.img_id = c.img_id AND (p.x - 3) // 4 = cx AND (p.y - 2) // 4 = cy WHERE x >= 3 AND x < 17 AND y >= 2 AND y < 13)"],
    exact8=False, x=3, y=2, width=14, height=11, mode={"type": "mosaic", "block": 4},
)
_op(
    "redact_blur", "redact",
    [o.blur_taps("bx", 25, 1.0), o.blur_taps("bv", 20, 1.0), *o.separable("px", "soft", "bx", "bv", 25, 20), "t AS (SELECT p.img_id, p.x, p.y, " + ", ".join(f"CASE WHEN p.x >= 6 AND p.x < 15 AND p.y >= 5 AND p.y < 12 THEN s.{c} ELSE p.{c} END AS {c}" for c in "rgba") + " FROM px p JOIN soft s USING (img_id, x, y))"],
    exact8=False, x=6, y=5, width=9, height=7, mode={"type": "blur", "radius": 1.0},
)
_BACK = Rgba(30, 60, 90, 255)
_op("beautify", "beautify", o.beautified(8, 8, 4, 3.0, 1.5, 0.5, 2, _BACK), "emb", exact8=False, padding=4, corner_radius=3, shadow_radius=1.5, shadow_opacity=0.5, shadow_offset=2, background=_BACK)

# Annotations.
_RED, _BLUE = Rgba(230, 30, 30), Rgba(20, 40, 250, 160)


def _near(e: str, l: float, t: float, r: float, b: float) -> str:
    return f"CASE WHEN x >= floor({l} - 1) AND x < ceil({r} + 1) AND y >= floor({t} - 1) AND y < ceil({b} + 1) THEN {e} ELSE 0 END"


def _layers(distance: str, box: tuple, width: float) -> list[str]:
    l, t, w, h = box
    k = width / 2
    outer = (l - k, t - k, l + w + k, t + h + k)
    return [o.step("f", o.over(_BLUE.premultiplied(), _near(o.aa(distance), *outer))), o.step("t", o.over(_RED.premultiplied(), _near(o.aa(f"(abs({distance}) - {o.n(k)})"), *outer)), "f")]


_op("draw_rect", "draw_rect", [o.step("t", o.over(_BLUE.premultiplied(), _near(o.aa(o.box_distance(o.n(9), o.n(7.75), o.n(6), o.n(4.25), o.n(0))), 3, 3.5, 15, 12)))], x=3, y=3.5, width=12, height=8.5, fill=_BLUE)
_op("draw_rect_rounded_stroke", "draw_rect", _layers(o.box_distance(o.n(10), o.n(9), o.n(7), o.n(5), o.n(2.5)), (3, 4, 14, 10), 2.0), x=3, y=4, width=14, height=10, corner_radius=2.5, fill=_BLUE, stroke=_RED, stroke_width=2)
_op("draw_ellipse", "draw_ellipse", _layers(o.ellipse_distance(11, 9, 8, 5), (3, 4, 16, 10), 1.5), x=3, y=4, width=16, height=10, fill=_BLUE, stroke=_RED, stroke_width=1.5)
_op("draw_line", "draw_line", [o.step("t", o.over(_RED.premultiplied(), o.aa(f"({o.segment_distance(2, 3, 20, 16)} - {o.n(1)})")))], x1=2, y1=3, x2=20, y2=16, color=_RED, thickness=2)
_ARROW = {"x1": 3.0, "y1": 15.0, "x2": 20.0, "y2": 4.0, "color": _RED, "thickness": 1.5, "head_length": 6.0}
_op("draw_arrow", "draw_arrow", [o.step("t", o.over(_RED.premultiplied(), o.aa(f"(least({', '.join(o.segment_distance(*l) for l in o.arrow_segments(3.0, 15.0, 20.0, 4.0, 6.0))}) - {o.n(.75)})")))], **_ARROW)
_TEXT = {"text": "Hi!\nOk", "x": 12.0, "y": 2.0, "font_size": 8.0, "align_x": "center", "align_y": "top"}
_op("draw_text", "draw_text", [o.step("t", o.over(_RED.premultiplied(), o.text_cover(["Hi!", "Ok"], 12.0, 2.0, 8.0)))], color=_RED, **_TEXT)


# Several images: each image of the orders raster with the next one.
def _next(df: DataFrame) -> DataFrame:
    return df.withColumn("img_id", C("img_id") - 1)


_PAIRS = "nx AS (SELECT img_id - 1 AS img_id, x, y, width, height, r, g, b, a FROM px)"
_BOTH = "ids AS (SELECT DISTINCT px.img_id FROM px JOIN nx USING (img_id))"


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    px = orders_px(spark, d)
    return px, _next(px).where("img_id >= 0")


add("overlay", lambda s, d: to_pixels8(compose.overlay(*_two(s, d), x=5, y=4, opacity=0.6)), o.query(o.ORDERS, [_PAIRS, o.placed("t", "px", "nx", 5, 4, 0.6)], o.out8("t")))
add("overlay_negative_offset", lambda s, d: to_pixels8(compose.overlay(*_two(s, d), x=-7, y=-3)), o.query(o.ORDERS, [_PAIRS, o.placed("t", "px", "nx", -7, -3)], o.out8("t")))


def _matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Images that have a next one, and that."""
    a, b = _two(spark, d)
    last = a.agg(F.max("img_id")).first()[0]
    return a.where(C("img_id") < (last or 0)), b


_A8, _B8 = o.out8("px"), o.out8("nx")
_DIFF = [_PAIRS, f"a8 AS ({_A8})", f"b8 AS ({_B8})", "d AS (SELECT img_id, x, y, " + ", ".join(f"p.{c}8 AS p{c}, q.{c}8 AS q{c}" for c in "rgb") + ", greatest(abs(p.r8 - q.r8), abs(p.g8 - q.g8), abs(p.b8 - q.b8)) AS m FROM a8 p JOIN b8 q USING (img_id, x, y))"]
add("diff_stats", lambda s, d: compose.diff_stats(*_matched(s, d), threshold=0.2).select("img_id", F.round("fraction", 6).alias("fraction"), F.round("max_diff", 6).alias("max_diff")), o.query(o.ORDERS, _DIFF, "SELECT img_id, round(avg(CASE WHEN m > 51 THEN 1::DOUBLE ELSE 0 END), 6) AS fraction, round(max(m) / 255::DOUBLE, 6) AS max_diff FROM d GROUP BY img_id"))
add("diff_difference", lambda s, d: to_pixels8(compose.diff(*_matched(s, d))), o.query(o.ORDERS, _DIFF, "SELECT img_id, x, y, abs(pr - qr) AS r8, abs(pg - qg) AS g8, abs(pb - qb) AS b8, 255 AS a8 FROM d"))
_GRAY = f"(({o.n(.299)} * pr + {o.n(.587)} * pg + {o.n(.114)} * pb) * {o.n(.35)})"
add("diff_heatmap", lambda s, d: to_pixels8(compose.diff(*_matched(s, d), view="heatmap")), o.query(o.ORDERS, _DIFF, f"SELECT img_id, x, y, CAST(floor(least({_GRAY} + m, 255)) AS INTEGER) AS r8, CAST(floor({_GRAY} * (1 - m / 255::DOUBLE)) AS INTEGER) AS g8, CAST(floor({_GRAY} * (1 - m / 255::DOUBLE)) AS INTEGER) AS b8, 255 AS a8 FROM d"))
add(
    "side_by_side",
    lambda s, d: to_pixels8(compose.diff(*_matched(s, d), view="side_by_side")),
    o.query(o.ORDERS, [_PAIRS, _BOTH, o.grid("g0", 58, 20), "g AS (SELECT g0.* FROM g0 JOIN ids USING (img_id))", "both_sides AS (SELECT img_id, x, y, r, g, b, a FROM px UNION ALL SELECT img_id, x + 33, y, r, g, b, a FROM nx)", o.placed("t", "g", "both_sides", 0, 0, 1.0, (*(((20 / 255 + 0.055) / 1.055) ** 2.4,) * 3, 1.0))], o.out8("t")),
)


def _threes(df: DataFrame) -> DataFrame:
    """Each image of a source in a collage with its neighbours: three ids a collage."""
    return geometry.images(df).select("img_id", F.floor(C("img_id") / 3).cast("long").alias("collage"), (C("img_id") % 3).cast("int").alias("position"))


def _collages(spark: SparkSession, d: str) -> DataFrame:
    px = orders_px(spark, d)
    return to_pixels8(compose.collages(px, _threes(px), target_width=60, row_height=16, gap=2))


def _layout(spark: SparkSession, d: str) -> DataFrame:
    px = orders_px8(spark, d)
    cells = compose.layouts(px, _threes(px), target_width=60, row_height=16, gap=2)
    return cells.select("collage", C("position").alias("cell"), C("left").alias("x"), C("top").alias("y"), C("to_width").alias("width"), C("to_height").alias("height"))


# 25 x 20 px images are 20 wide at height 16; two leave 14 of a row of 56 (with a gap of 2), so the third fills it: 60 wide, scaled by 52 / 60.
# A last collage of one or two images isn't full and keeps its height.
_CELLS = [o.values("whole_rows", "cell, x, y, width, height", [(0, 2, 2, 17, 14), (1, 21, 2, 17, 14), (2, 41, 2, 17, 14)]), o.values("part_rows", "cell, x, y, width, height", [(0, 2, 2, 20, 16), (1, 24, 2, 20, 16)])]
_NAMED = "named AS (SELECT img_id, img_id // 3 AS collage, CAST(img_id % 3 AS INTEGER) AS cell, count(*) OVER (PARTITION BY img_id // 3) AS n FROM (SELECT DISTINCT img_id FROM px))"
_PLACES = "places AS (SELECT img_id, collage, n, f.* FROM named JOIN whole_rows f USING (cell) WHERE n = 3 UNION ALL SELECT img_id, collage, n, s.* FROM named JOIN part_rows s USING (cell) WHERE n < 3)"
add("collage_layout", _layout, o.query(o.ORDERS, [*_CELLS, _NAMED, _PLACES], "SELECT collage, cell, x, y, width, height FROM places"))
_SMALL = [o.taps("fx", 25, 17, "lanczos3"), o.taps("fy", 20, 14, "lanczos3"), o.taps("sx", 25, 20, "lanczos3"), o.taps("sy", 20, 16, "lanczos3"), *o.separable("px", "small", "fx", "fy", 17, 14), *o.separable("px", "large", "sx", "sy", 20, 16)]
_SHEETS = [
    "sheet AS (SELECT DISTINCT collage AS img_id, CASE n WHEN 3 THEN 18 ELSE 20 END AS height FROM places)",
    "canvas AS (SELECT img_id, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y FROM sheet, (SELECT unnest(range(60)) AS gx), (SELECT unnest(range(20)) AS gy) WHERE gy < height)",
    "tops AS (SELECT p.collage AS img_id, s.x + p.x AS x, s.y + p.y AS y, s.r, s.g, s.b, s.a FROM places p JOIN small s ON s.img_id = p.img_id AND n = 3 UNION ALL SELECT p.collage, s.x + p.x, s.y + p.y, s.r, s.g, s.b, s.a FROM places p JOIN large s ON s.img_id = p.img_id AND n < 3)",
    o.placed("t", "canvas", "tops", 0, 0, 1.0, (1.0, 1.0, 1.0, 1.0)),
]
add("collage", _collages, o.query(o.ORDERS, [*_CELLS, _NAMED, _PLACES, *_SMALL, *_SHEETS], o.out8("t")))

# Whole pipelines.
FLAGSHIP = Pipeline.parse([{"op": "resize", "width": 15}, {"op": "exposure", "stops": 0.5}, {"op": "crop", "x": 2, "y": 1, "width": 10, "height": 8}, {"op": "grayscale"}])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resize, exposure, crop, grayscale of every image of the orders raster, as 8-bit pixels."""
    return to_pixels8(run(orders_px(spark, sf_dir), FLAGSHIP, [(25, 20)]))


_GRAYED = [o.taps("tx", 25, 15, "lanczos3"), o.taps("ty", 20, 12, "lanczos3"), *o.separable("px", "small", "tx", "ty", 15, 12), o.step("e", {c: f"{c} * {o.n(2 ** .5)}" for c in "rgb"} | {"x": "x - 2", "y": "y - 1"}, "small", "x >= 2 AND x < 12 AND y >= 1 AND y < 9"), o.step("t", o.linear([[0.2126, 0.7152, 0.0722]] * 3), "e")]
add("pipeline_flagship", flagship, o.query(o.ORDERS, _GRAYED, o.out8("t")))
CHAIN = Pipeline.parse({"steps": [{"op": "exposure", "stops": 0.25}, {"op": "hue_rotate", "degrees": 30}, {"op": "flip", "axis": "horizontal"}, {"op": "rotate", "degrees": 90}, {"op": "crop", "x": 1, "y": 2, "width": 15, "height": 18}, {"op": "invert"}]})
add(
    "pipeline_chain",
    lambda s, d: to_pixels8(run(orders_px(s, d), CHAIN, [(25, 20)])),
    o.query(o.ORDERS.replace("px AS MATERIALIZED", "p0 AS MATERIALIZED"), [o.step("p1", {c: f"{c} * {o.n(2 ** .25)}" for c in "rgb"}, "p0"), o.step("p2", o.linear(o.hue(30)), "p1"), o.step("p3", {"x": "19 - y", "y": "24 - x"}, "p2"), o.step("px", {"x": "x - 1", "y": "y - 2"}, "p3", "x >= 1 AND x < 16 AND y >= 2 AND y < 20"), *o.srgb_step(lambda *s: [f"(1 - {x})" for x in s])], o.out8("t")),
)


def _identity(spark: SparkSession, d: str) -> DataFrame:
    """A digest of all pixels of an image: of its lines' digests, in order."""
    pixel = F.concat_ws(":", "r8", "g8", "b8", "a8")
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("v")))), lambda s: s["v"]), ",")
    lines = orders_px8(spark, d).groupBy("img_id", "y").agg(F.sha2(ordered("x", pixel), 256).alias("line"))
    return lines.groupBy("img_id").agg(F.sha2(ordered("y", C("line")), 256).alias("identity"))


add("source_identity", _identity, f"WITH {o.ORDERS8} SELECT img_id, sha256(string_agg(line, ',' ORDER BY y)) AS identity FROM (SELECT img_id, y, sha256(string_agg(concat_ws(':', r8, g8, b8, a8), ',' ORDER BY x)) AS line FROM o8 GROUP BY img_id, y) GROUP BY img_id")
def _flow(spark: SparkSession, d: str) -> DataFrame:
    """The size of every image after each step of the flagship."""
    px = orders_px8(spark, d)
    sizes = [spark.createDataFrame([(w, h, i, *after) for w, h in sizes_of(px) for i, after in enumerate(FLAGSHIP.validate((w, h)))], "w int, h int, step int, width int, height int")]
    return geometry.images(px).withColumnsRenamed({"width": "w", "height": "h"}).join(F.broadcast(sizes[0]), ["w", "h"]).select("img_id", "step", "width", "height")  # a row per distinct size and step


add("size_flow", _flow, f"WITH {o.ORDERS8}, sizes AS (SELECT img_id, max(width) AS w, max(height) AS h FROM o8 GROUP BY img_id), first AS (SELECT img_id, 15 AS w, CAST(floor(h * 15 / w + 0.5) AS INTEGER) AS h FROM sizes) SELECT img_id, step, CASE WHEN step < 2 THEN w ELSE 10 END AS width, CASE WHEN step < 2 THEN h ELSE 8 END AS height FROM first, (VALUES (0), (1), (2), (3)) t(step)")
