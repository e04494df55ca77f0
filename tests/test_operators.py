import pytest
from pyspark.sql import functions as F

from rasterloom.errors import PipelineError, SessionError
from rasterloom.functions.color import Rgba
from rasterloom.operators import compose, geometry
from rasterloom.operators.compose import to_pixels8
from rasterloom.plans.compiler import apply, rewrite, run
from rasterloom.plans.spec import Op, Pipeline


def do(df, *steps):
    return run(df, Pipeline(tuple(Op.of(name, **p) for name, p in steps)))


def near(a, b, tolerance=1e-6):
    return a.keys() == b.keys() and all(abs(u - v) <= tolerance for k in a for u, v in zip(a[k], b[k]))


def test_flips_and_turns_are_identities(ramp, pixels):
    df = ramp(13, 7)
    want = pixels(df)
    assert pixels(do(df, ("flip", {"axis": "h"}), ("flip", {"axis": "horizontal"}))) == want
    assert pixels(do(df, *[("rotate", {"degrees": 90})] * 4)) == want
    turned = pixels(do(df, ("rotate", {"degrees": 90})))
    assert turned[(7 - 1 - 2, 5)] == want[(5, 2)]
    assert pixels(do(df, ("rotate", {"degrees": 180}))) == pixels(do(df, ("flip", {"axis": "h"}), ("flip", {"axis": "v"})))


def test_crop_composes_and_undoes_pad(ramp, pixels):
    df = ramp(20, 12)
    once = pixels(do(df, ("crop", {"x": 5, "y": 4, "width": 6, "height": 5})))
    assert once == pixels(do(df, ("crop", {"x": 2, "y": 3, "width": 12, "height": 8}), ("crop", {"x": 3, "y": 1, "width": 6, "height": 5})))
    assert once[(0, 0)][:2] == (5.0, 4.0)
    padded = do(df, ("pad", {"left": 3, "top": 2, "right": 1, "color": "#ff0000"}))
    assert pixels(do(padded, ("crop", {"x": 3, "y": 2, "width": 20, "height": 12}))) == pixels(df)
    assert pixels(padded)[(0, 0)] == (1.0, 0.0, 0.0, 1.0)


def test_solids_stay_solid(solid, pixels):
    df = solid(21, 15, (0.2, 0.4, 0.6, 1.0))
    for step in (("blur", {"radius": 2.5}), ("resize", {"width": 8, "height": 30}), ("sharpen", {}), ("rotate", {"degrees": 90})):
        assert all(abs(u - v) < 1e-9 for p in pixels(do(df, step)).values() for u, v in zip(p, (0.2, 0.4, 0.6, 1.0))), step


def test_identity_resize_and_pixelate_mean(ramp, pixels):
    df = ramp(16, 8)
    assert near(pixels(do(df, ("resize", {"width": 16, "height": 8}))), pixels(df), 1e-9)
    cells = pixels(do(df, ("redact", {"x": 4, "y": 0, "width": 8, "height": 4, "mode": {"type": "pixelate", "block": 4}})))
    assert cells[(4, 0)][0] == cells[(7, 3)][0] == 5.5 and cells[(8, 0)][0] == 9.5 and cells[(3, 0)][0] == 3.0 and cells[(4, 4)][0] == 4.0


@pytest.mark.parametrize("how", ["nearest", "bilinear", "catmull_rom", "lanczos3"])
def test_crop_through_resize(spark, ramp, solid, pixels, how):
    """Only what the crop's taps read takes part in a resize, with the same result, for images of several sizes."""
    df = ramp(50, 40).withColumn("r", F.sin("x") * F.cos("y")).unionByName(ramp(33, 61).withColumn("img_id", F.lit(1).cast("long")))
    for size in ({"width": 21, "height": 90}, {"height": 19}, {"width": 120}):
        steps = ("resize", size | {"filter": how}), ("exposure", {"stops": 1}), ("blur", {"radius": 0.4}), ("crop", {"x": 3, "y": 5, "width": 7, "height": 9})
        plain = df
        for name, p in steps:
            plain = apply(plain, Op.of(name, **p))
        for i in (0, 1):
            assert near(pixels(do(df, *steps).where(f"img_id = {i}")), pixels(plain.where(f"img_id = {i}")), 1e-9)
    seen = do(df, ("resize", {"width": 200, "height": 200, "filter": how}), ("crop", {"x": 0, "y": 0, "width": 4, "height": 4}))
    assert [type(op).__name__ for op in rewrite((Op.of("resize", width=5), Op.of("crop", x=0, y=0, width=1, height=1)))] == ["Resampled", "Op"]
    scans = [l for l in seen._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in l]
    assert any("width" in l or "cast(" in l for l in scans)


def test_what_follows_a_trim_is_checked(spark, solid, pixels):
    """Of two images, one is large enough for the crop after its trim: the other is an error, or is left out whole."""
    def card(i, side):
        return solid(20, 16, (1.0, 1.0, 1.0, 1.0), i).withColumns({c: F.when((F.col("x") >= 2) & (F.col("x") < 2 + side) & (F.col("y") >= 3) & (F.col("y") < 3 + side), 0.0).otherwise(1.0) for c in "rgb"})

    df = card(1, 5).unionByName(card(2, 12))
    for steps in (("trim", {}), ("crop", {"x": 1, "y": 1, "width": 8, "height": 8})), (("trim", {}), ("blur", {"radius": 1.0}), ("crop", {"x": 6, "y": 6, "width": 2, "height": 2})):
        p = Pipeline(tuple(Op.of(name, **given) for name, given in steps))
        with pytest.raises(Exception, match=f"step {len(steps) - 1}: crop doesn't fit image 1 of 5x5"):
            run(df, p).collect()
        kept = run(df, p, on_error="quarantine")
        assert {r.img_id for r in kept.select("img_id").distinct().collect()} == {2}
        assert len(pixels(kept)) == steps[-1][1]["width"] ** 2
    both = run(df, Pipeline((Op.of("trim"), Op.of("crop", x=0, y=0, width=5, height=5))))
    assert both.groupBy("img_id").count().collect().__len__() == 2 and both.count() == 50
    assert run(df, Pipeline((Op.of("trim"), Op.of("pad", all=1)))).where("img_id = 1").count() == 49


def test_sizes_that_do_not_fit_are_left_out(solid):
    df = solid(5, 5, img_id=1).unionByName(solid(9, 9, img_id=2)).unionByName(solid(9, 4, img_id=3)).unionByName(solid(12, 12, img_id=4))
    got = run(df, Pipeline((Op.of("crop", x=0, y=0, width=8, height=8),)), on_error="quarantine")
    assert {r.img_id for r in got.select("img_id").distinct().collect()} == {2, 4}


def test_beautify_by_hand(spark, solid, pixels):
    """A shadow of radius 0 is the silhouette itself, moved down; the margin is the background."""
    df = solid(4, 3, (0.5, 0.5, 0.5, 1.0))
    got = pixels(do(df, ("beautify", {"padding": 3, "corner_radius": 0, "shadow_radius": 0, "shadow_opacity": 0.5, "shadow_offset": 2, "background": "white"})))
    for (x, y), v in got.items():
        inside, under = 3 <= x < 7 and 3 <= y < 6, 3 <= x < 7 and 5 <= y < 8
        assert near({0: v}, {0: (0.5, 0.5, 0.5, 1.0) if inside else (0.5, 0.5, 0.5, 1.0) if under else (1.0, 1.0, 1.0, 1.0)})
    assert len(got) == 10 * 9
    plan = do(df, ("beautify", {}))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_diff_of_missing_and_uneven_images(solid):
    a = solid(4, 4, img_id=1).unionByName(solid(3, 3, img_id=2)).unionByName(solid(2, 2, img_id=3))
    b = solid(4, 4, (0.0, 0.5, 0.9, 1.0), img_id=1).unionByName(solid(3, 4, img_id=2)).unionByName(solid(2, 2, img_id=5))
    got = {r.img_id: (r.fraction, r.max_diff) for r in compose.diff_stats(a, b).collect()}
    assert got.keys() == {1, 2, 3, 5} and got[1][0] == 1.0 and all(got[i] == (None, None) for i in (2, 3, 5))
    assert compose.diff_stats(a, b)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_far_positions_are_refused(spark):
    wide = spark.createDataFrame([(0, 0, 0, 1 << 24, 1, 0.0, 0.0, 0.0, 1.0)], "img_id long, x int, y int, width int, height int, r double, g double, b double, a double")
    with pytest.raises(Exception, match="rotate: sides from"):
        do(wide, ("rotate", {"degrees": 45, "expand": False})).count()


def test_halo_changes_nothing(ramp, pixels):
    """A crop through blurs gives what blurring the whole image gives."""
    df = ramp(40, 30)
    steps = ("blur", {"radius": 1.5}), ("exposure", {"stops": 1}), ("sharpen", {"radius": 1.0}), ("crop", {"x": 9, "y": 7, "width": 10, "height": 11})
    plain = df
    for name, p in steps:
        plain = apply(plain, Op.of(name, **p))
    assert near(pixels(do(df, *steps)), pixels(plain), 1e-9)


def test_fused_matrices(ramp, pixels):
    df = ramp(6, 5)
    steps = ("exposure", {"stops": 0.7}), ("hue_rotate", {"degrees": 80}), ("white_balance", {"temperature": 0.3, "tint": -0.2}), ("grayscale", {})
    plain = df
    for name, p in steps:
        plain = apply(plain, Op.of(name, **p))
    assert near(pixels(do(df, *steps)), pixels(plain), 1e-9)


def test_split_runs(solid, pixels):
    df = solid(9, 9, (0.3, 0.1, 0.05, 0.5))
    steps = ("invert", {}), ("saturation", {"amount": 0.5}), ("pad", {"all": 2}), ("vignette", {})
    assert near(pixels(do(df, *steps)), pixels(do(do(df, *steps[:2]), *steps[2:])), 1e-9)


def test_edges_soften_and_sharpen(solid, pixels):
    df = solid(32, 5).withColumns({c: F.when(F.col("x") < 16, 0.2).otherwise(0.8) for c in "rgb"})
    soft = pixels(do(df, ("blur", {"radius": 2})))
    assert 0.2 < soft[(15, 2)][0] < soft[(16, 2)][0] < 0.8 and abs(soft[(0, 2)][0] - 0.2) < 1e-6
    hard = pixels(do(df, ("sharpen", {"amount": 1, "radius": 2})))
    assert hard[(15, 2)][0] < 0.2 and hard[(16, 2)][0] > 0.8 and hard[(15, 2)][3] == 1.0


def test_trim(solid, pixels):
    card = solid(20, 16, (1, 1, 1, 1)).withColumns({c: F.when((F.col("x").between(3, 16)) & F.col("y").between(3, 12), 0.0).otherwise(1.0) for c in "rgb"})
    out = pixels(geometry.trim(card))
    assert len(out) == 14 * 10
    assert geometry.trim(solid(5, 5)).count() == 0


def test_drawing(solid, pixels):
    blank = solid(40, 30, (0, 0, 0, 0))
    box = pixels(do(blank, ("draw_rect", {"x": 5, "y": 5, "width": 20, "height": 10, "fill": "white"})))
    assert box[(10, 10)] == (1, 1, 1, 1) and box[(2, 2)] == (0, 0, 0, 0)
    ring = pixels(do(blank, ("draw_ellipse", {"x": 5, "y": 5, "width": 20, "height": 20, "stroke": "white", "stroke_width": 2})))
    assert ring[(15, 15)][3] == 0 and ring[(5, 15)][3] > 0.4
    text = pixels(do(blank, ("draw_text", {"x": 2, "y": 20, "text": "A", "color": "white", "font_size": 20})))
    assert sum(p[3] > 0.5 for p in text.values()) > 20
    assert pixels(do(blank, ("draw_line", {"x1": 100, "y1": 100, "x2": 120, "y2": 120, "color": "red"}))) == pixels(blank)
    arrow = pixels(do(blank, ("draw_arrow", {"x1": 2, "y1": 15, "x2": 30, "y2": 15, "color": "red", "head_length": 8})))
    assert arrow[(15, 15)][0] > 0.9 and arrow[(25, 12)][3] > 0.2


def test_beautify(solid, pixels):
    out = pixels(do(solid(40, 30), ("beautify", {"padding": 10, "corner_radius": 6, "shadow_radius": 3, "shadow_opacity": 0.5, "shadow_offset": 3})))
    assert len(out) == 60 * 50 and all(abs(u - v) < 1e-9 for u, v in zip(out[(30, 25)], (0.2, 0.5, 0.9, 1.0)))
    assert out[(0, 0)][3] < 0.01 and 0 < out[(30, 42)][3] < 0.5


def test_overlay_and_diff(solid, ramp, pixels):
    base, top = solid(10, 8, (0, 0, 0, 1)), solid(4, 4, (1, 1, 1, 1))
    out = pixels(compose.overlay(base, top, -2, 6, 0.5))
    assert out[(0, 6)][0] == 0.5 and out[(1, 7)][0] == 0.5 and out[(2, 6)][0] == 0.0
    same = compose.diff_stats(base, base).first()
    assert same["fraction"] == 0.0 and same["max_diff"] == 0.0
    white = solid(10, 8, (1, 1, 1, 1))
    assert compose.diff_stats(base, white).first()["fraction"] == 1.0
    assert compose.diff_stats(base, top).first()["fraction"] is None
    with pytest.raises(SessionError):
        compose.diff(base, top)
    assert pixels(compose.diff(base, solid(3, 12), "side_by_side")).keys() == {(x, y) for x in range(21) for y in range(12)}


def test_collage(solid, pixels):
    df = solid(30, 20, (1, 0, 0, 1), 0).unionByName(solid(20, 30, (0, 1, 0, 1), 1))
    out = compose.collage(df, [0, 1], 80, 20, 4, Rgba(0, 0, 255))
    got = pixels(out)
    assert got[(0, 0)] == (0, 0, 1, 1) and abs(got[(10, 10)][0] - 1) < 1e-6
    with pytest.raises(SessionError):
        compose.collage(df, [0, 7])


def test_egress(solid):
    row = to_pixels8(solid(1, 1, (0.1, 0.2, 0.3, 0.0))).first()
    assert (row["r8"], row["g8"], row["b8"], row["a8"]) == (0, 0, 0, 0)


def test_batches(solid):
    df = solid(10, 10, img_id=1).unionByName(solid(4, 4, img_id=2))
    p = Pipeline.parse([{"op": "crop", "x": 0, "y": 0, "width": 6, "height": 6}])
    with pytest.raises(PipelineError):
        run(df, p)
    assert {r["img_id"] for r in run(df, p, on_error="quarantine").select("img_id").distinct().collect()} == {1}
    both = run(df, Pipeline.parse([{"op": "resize", "width": 5}]))
    assert {(r["img_id"], r["width"], r["height"]) for r in both.select("img_id", "width", "height").distinct().collect()} == {(1, 5, 5), (2, 5, 5)}


def test_pushdown(spark, tmp_path, solid):
    """A crop after pointwise steps reaches the scan, and unused channels aren't read."""
    solid(20, 20).write.parquet(str(tmp_path / "px"))
    df = run(spark.read.parquet(str(tmp_path / "px")), Pipeline.parse([{"op": "exposure", "stops": 1}, {"op": "crop", "x": 2, "y": 3, "width": 5, "height": 5}]), [(20, 20)])
    plan = df.select("x", "y", "r")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,2)" in plan and "g:double" not in plan
