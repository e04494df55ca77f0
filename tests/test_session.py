import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.__main__ import main, ops
from rasterloom.errors import CodecError, PipelineError, SessionError
from rasterloom.operators.compose import to_pixels8
from rasterloom.plans.spec import Pipeline
from rasterloom.session import Session
from rasterloom.sources.images import bad_files, decode_png, decode_pngs, encode_jpegs, encode_png, encode_pngs, format_of, read_images, sample, sniff
from rasterloom.sources.jpeg import encode_jpeg
from rasterloom.sources.sink import FileWriter, register, write_images
from rasterloom.sources.tables import ingest
from rasterloom.sources.webp import decode_webp
from rasterloom.streaming import watch_folder


def gradient(width=60, height=40):
    y, x = np.mgrid[:height, :width]
    return np.dstack([x * 255 // width, y * 255 // height, np.full_like(x, 90), np.full_like(x, 255)]).astype(np.uint8)


@pytest.fixture
def png(tmp_path):
    (tmp_path / "a.png").write_bytes(encode_png(gradient()))
    return str(tmp_path / "a.png")


def test_png(spark):
    rgba = gradient()
    rgba[5, 5] = (10, 20, 30, 40)
    assert (decode_png(encode_png(rgba)) == rgba).all() and sniff(encode_png(rgba)) == "png"
    for bad in (b"", b"\x89PNG\r\n\x1a\n", b"GIF89a"):
        with pytest.raises(CodecError):
            decode_png(bad)
    assert format_of("A.JPG") == "jpeg"
    with pytest.raises(CodecError):
        format_of("a.gif")


def test_batch_png(spark):
    px = sample(spark, 30, 20, 4)
    files = encode_pngs(px)
    again = decode_pngs(files)
    assert sorted(map(tuple, px.select("x", "y", "r8", "g8", "b8", "a8").collect())) == sorted(map(tuple, again.select("x", "y", "r8", "g8", "b8", "a8").collect()))


def test_image_source(spark, png):
    rows = {(r["x"], r["y"]): r for r in to_pixels8(read_images(spark, png)).collect()}
    want = gradient()
    assert all([rows[(x, y)][f"{c}8"] for c in "rgba"] == want[y, x].tolist() for x, y in ((0, 0), (59, 39), (20, 10)))


def test_handles(spark, png, tmp_path):
    s = Session(spark)
    a = s.open_image(png)
    assert s.image_info(a.id) == {"image_id": "img-1", "width": 60, "height": 40}
    b = s.apply(a.id, "crop", x=10, y=5, width=23, height=10)
    assert b.size == (23, 10) and s[a.id].size == (60, 40)
    out = s.export(b.id, str(tmp_path / "b.png"))
    assert (decode_png((tmp_path / "b.png").read_bytes()) == gradient()[5:15, 10:33]).all() and out["bytes"] > 0
    padded = s.apply(a.id, "pad", all=8, color="white")
    assert s.trim(padded.id).size == (60, 40)
    with pytest.raises(SessionError, match="img-99"):
        s.apply("img-99", "grayscale")
    with pytest.raises(PipelineError):
        s.apply(a.id, "crop", x=0, y=0, width=500, height=1)
    blank = s.apply(a.id, "levels", out_white=0.0)
    with pytest.raises(SessionError):
        s.trim(blank.id)
    with pytest.raises(SessionError):
        s.collage([])
    with pytest.raises(SessionError):
        s.diff(a.id, b.id)
    assert s.export(a.id, str(tmp_path / "a.webp"))["bytes"] > 0
    again = s.open_image(str(tmp_path / "a.webp"))
    assert again.size == (60, 40) and s.diff(a.id, again.id)[1]["max"] == 0
    for bad, data in (("lossy.webp", b"RIFF\x10\0\0\0WEBPVP8 \4\0\0\0abcd"), ("cut.png", encode_png(gradient())[:50])):
        (tmp_path / bad).write_bytes(data)
        with pytest.raises(CodecError):
            s.open_image(str(tmp_path / bad))
    view, stats = s.diff(a.id, b.id, "sxs")
    assert view.size == (91, 40) and stats == {"fraction": None, "max": None}
    same = s.diff(a.id, a.id)[1]
    assert same == {"fraction": 0.0, "max": 0.0}
    s.export(a.id, str(tmp_path / "a.jpg"), 95)
    jpeg = s.open_image(str(tmp_path / "a.jpg"))
    assert jpeg.size == (60, 40) and s.diff(a.id, jpeg.id)[1]["max"] < 0.1
    assert s.collage([a.id, b.id], 100, 20, 4).width == 100
    s.drop(b.id)
    with pytest.raises(SessionError):
        s[b.id]


def test_cache(spark, png):
    s = Session(spark)
    a = s.open_image(png)
    chain = [{"op": "exposure", "stops": 1}, {"op": "invert"}, {"op": "grayscale"}]
    first = s.run_pipeline(a.id, chain)
    again = s.run_pipeline(a.id, chain)
    assert first.key == again.key and (s.cache.hits, s.cache.misses) == (3, 3)
    s.run_pipeline(a.id, [*chain[:2], {"op": "hue_rotate", "degrees": 9}])
    assert (s.cache.hits, s.cache.misses) == (5, 4) and "invert" in s.report()
    assert sorted(map(tuple, first.df.select("x", "y", "r").collect())) == sorted(map(tuple, again.df.select("x", "y", "r").collect()))
    s.cache.clear()


def test_stats_of_what_ran(spark, png):
    s = Session(spark)
    a = s.open_image(png)
    chain = [{"op": "exposure", "stops": 1}, {"op": "crop", "x": 0, "y": 0, "width": 30, "height": 20}, {"op": "blur", "radius": 1}]
    s.run_pipeline(a.id, chain)
    assert [(x.name, x.rows, x.seconds) for x in s.stats] == [("exposure", None, None), ("crop", None, None), ("blur", None, None)] and s.report().count("planned") == 3
    s.run_pipeline(a.id, chain, measure=True)
    first = s.stats[3:]
    assert [(x.name, x.rows, x.hit) for x in first] == [("exposure", 2400, False), ("crop", 600, False), ("blur", 600, False)] and all(x.seconds > 0 for x in first)
    s.run_pipeline(a.id, [*chain[:2], {"op": "invert"}], measure=True)
    assert [(x.name, x.rows, x.hit) for x in s.stats[6:]] == [("exposure", 2400, True), ("crop", 600, True), ("invert", 600, False)]
    assert s.report().count("from storage") == 2 and s.report().count("computed") == 4
    s.cache.clear()


def test_command_line(spark, png, tmp_path, capsys):
    assert "lanczos3" in ops()
    spec = tmp_path / "p.json"
    spec.write_text(json.dumps({"steps": [{"op": "resize", "width": 30}, {"op": "crop", "x": 0, "y": 0, "width": 10, "height": 10}]}))
    assert main(["run", str(spec), "--in", png, "--out", str(tmp_path / "o.png")]) == 0
    assert decode_png((tmp_path / "o.png").read_bytes()).shape == (10, 10, 4) and "resize" in capsys.readouterr().err
    spec.write_text(json.dumps([{"op": "crop", "x": 0, "y": 0, "width": 100, "height": 1}]))
    assert main(["run", str(spec), "--in", png, "--out", str(tmp_path / "no.png")]) == 1 and not (tmp_path / "no.png").exists()
    assert main(["run", str(spec), "--in", png, "--out", str(tmp_path / "no.gif")]) == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.png").write_bytes(encode_png(gradient(8 + i, 6)))
    query = watch_folder(spark, str(tmp_path / "in"), Pipeline.parse([{"op": "flip", "axis": "h"}]), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {r["path"].rpartition("/")[2]: decode_png(bytes(r["png"])) for r in rows}
    assert len(got) == 3 and all((got[f"{i}.png"] == gradient(8 + i, 6)[:, ::-1]).all() for i in range(3))


def rows8(df):
    return sorted(map(tuple, df.select("img_id", "x", "y", "r8", "g8", "b8", "a8").collect()))


def test_bands_of_many_images(spark):
    px = sample(spark, 30, 20, 4).unionByName(sample(spark, 7, 200, 5)).unionByName(sample(spark, 1, 1, 6)).withColumn("a8", F.pmod(F.xxhash64("x", "y"), F.lit(256)).cast("int")).repartition(7)
    for lines in (1, 13, 64, 500):
        assert rows8(decode_pngs(encode_pngs(px, lines))) == rows8(px)
    holed = px.where("not (img_id = 5 and y = 100 and x = 3)")
    for df in (holed, px.where("not (img_id = 4 and y >= 5 and y < 10)"), px.where("not (img_id = 5 and y < 64)")):
        with pytest.raises(Exception, match="holes"):
            encode_pngs(df).collect()
    assert encode_pngs(px.where("false")).count() == 0


def test_batch_jpeg(spark, tmp_path):
    px = sample(spark, 90, 50, 1).withColumn("r8", F.col("x") * 2).withColumn("g8", F.col("y") * 4).withColumn("b8", F.lit(90)).withColumn("a8", F.when(F.col("x") < 20, 0).otherwise(255))
    px = px.unionByName(px.where("x < 33 and y < 11").withColumn("img_id", F.lit(2).cast("long")))
    write_images(px, str(tmp_path / "out"), "jpg", 95)
    back = to_pixels8(read_images(spark, str(tmp_path / "out"), F.when(F.col("path").endswith("/1.jpg"), 1).otherwise(2).cast("long")))
    both = px.alias("p").join(back.alias("q"), ["img_id", "x", "y"])
    assert both.count() == px.count() == back.count()
    off = both.select(*(F.avg(F.abs(F.when(F.col("p.a8") == 0, 255).otherwise(F.col(f"p.{c}8")) - F.col(f"q.{c}8"))).alias(c) for c in "rgb")).first()
    assert max(off) < 3
    sizes = [sum(len(r.jpeg) for r in encode_jpegs(px, q).collect()) for q in (10, 50, 95)]
    assert sizes == sorted(sizes)


def test_sink(spark, tmp_path):
    px, out = sample(spark, 12, 9, 3).unionByName(sample(spark, 5, 4, 8)), tmp_path / "out"
    write_images(px, str(out), name=F.concat(F.lit("of/"), F.col("img_id")))
    assert sorted(p.name for p in (out / "of").iterdir()) == ["3.png", "8.png"] and (out / "_SUCCESS").exists() and not (out / "_temporary").exists()
    assert rows8(decode_pngs(spark.read.format("binaryFile").load(str(out / "of")).select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("img_id"), F.col("content").alias("png")))) == rows8(px)
    with pytest.raises(Exception, match="exists already"):
        write_images(px, str(out), name=F.concat(F.lit("of/"), F.col("img_id")))
    write_images(px.where("img_id = 3").withColumn("r8", F.lit(1)), str(out), name=F.concat(F.lit("of/"), F.col("img_id")), mode="overwrite")
    assert decode_png((out / "of/3.png").read_bytes())[..., 0].max() == 1 and decode_png((out / "of/8.png").read_bytes())[..., 0].max() > 1
    write_images(px, str(tmp_path / "w"), "webp")
    assert (decode_webp((tmp_path / "w/3.webp").read_bytes()) == decode_png(bytes(encode_pngs(px.where("img_id = 3")).first().png))).all()
    assert read_images(spark, str(tmp_path / "w")).groupBy("width", "height").count().count() == 2
    with pytest.raises(CodecError):
        write_images(px, str(out), "tiff")


def test_sink_leaves_nothing_of_failed_tasks(spark, tmp_path):
    register(spark)
    out = tmp_path / "out"
    files = spark.range(40).select(F.concat(F.col("id"), F.lit(".bin")).alias("name"), F.when(F.col("id") < 35, F.lit(b"abc")).otherwise(F.raise_error(F.lit("task fails"))).cast("binary").alias("data")).repartition(4, "name")
    with pytest.raises(Exception, match="task fails"):
        files.write.format("rasterloom").mode("append").save(str(out))
    assert not out.exists() or not list(out.iterdir())
    for name in ("../up", "/root", ""):
        with pytest.raises(Exception, match="can't be the name"):
            spark.createDataFrame([(name, bytearray(b"x"))], "name string, data binary").write.format("rasterloom").mode("append").save(str(out))
    with pytest.raises(Exception, match="two rows"):
        spark.createDataFrame([("a", bytearray(b"x")), ("a", bytearray(b"y"))], "name string, data binary").write.format("rasterloom").mode("append").save(str(out))
    assert not out.exists() or not [p for p in out.iterdir() if p.name != "_SUCCESS"]
    with pytest.raises(Exception, match="name string, data binary"):
        spark.range(2).write.format("rasterloom").mode("append").save(str(out))


def test_attempts_that_do_not_count(tmp_path):
    """Of two attempts of a task, the files of the one that is committed stay."""
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([b"1"], pa.binary())], ["name", "data"])
    w = FileWriter(str(tmp_path / "out"), False)
    w.write(iter([batch]))
    second = w.write(iter([batch]))
    w.commit([second, None])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_SUCCESS", "a"]
    v = FileWriter(str(tmp_path / "out"), True)
    v.write(iter([batch]))
    v.abort([None])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_SUCCESS", "a"]


def test_bad_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(encode_png(gradient(9, 7)))
    (tmp_path / "b.png").write_bytes(encode_png(gradient())[:90])
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff rest")
    (tmp_path / "d.jpeg").write_bytes(encode_jpeg(gradient(16, 10), 95))
    (tmp_path / "e.png").write_bytes(encode_jpeg(gradient(16, 10), 95))
    (tmp_path / "f.txt").write_bytes(b"no image")
    (tmp_path / "g.png").write_bytes(b"x")
    bad = {r.path.rpartition("/")[2]: r.error for r in bad_files(spark, str(tmp_path)).collect()}
    assert sorted(bad) == ["b.png", "c.jpg", "e.png", "g.png"] and "jpeg" in bad["e.png"]
    sizes = sorted((r.width, r.height, r["count"]) for r in read_images(spark, str(tmp_path), on_error="quarantine").groupBy("img_id", "width", "height").count().collect())
    assert sizes == [(9, 7, 63), (16, 10, 160)]
    with pytest.raises(Exception, match="can't decode"):
        read_images(spark, str(tmp_path)).count()


def test_stream_of_both_kinds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(encode_png(gradient(30, 20)))
    (tmp_path / "in/b.jpg").write_bytes(encode_jpeg(gradient(40, 30), 95))
    (tmp_path / "in/c.jpg").write_bytes(b"\xff\xd8\xff\0")
    (tmp_path / "in/d.png").write_bytes(b"nothing")
    (tmp_path / "in/e.png").write_bytes(encode_png(gradient(5, 5)))
    (tmp_path / "in/f.png").write_bytes(encode_jpeg(gradient(20, 20), 95))
    crop = Pipeline.parse([{"op": "crop", "x": 2, "y": 1, "width": 15, "height": 12}])
    for kind in ("png", "jpeg", "webp"):
        query = watch_folder(spark, str(tmp_path / "in"), crop, str(tmp_path / kind), str(tmp_path / f"ckpt-{kind}"), kind=kind)
        query.awaitTermination()
        done = {r.path.rpartition("/")[2]: bytes(r[kind]) for r in spark.read.parquet(str(tmp_path / kind)).collect()}
        assert sorted(done) == ["a.png", "b.jpg", "f.png"] and sniff(done["a.png"]) == kind
        bad = {r.path.rpartition("/")[2]: r.error for r in spark.read.parquet(str(tmp_path / kind / "_errors")).collect()}
        assert sorted(bad) == ["c.jpg", "d.png", "e.png"] and "fit" in bad["e.png"]
    assert (decode_png({r.path.rpartition("/")[2]: bytes(r.png) for r in spark.read.parquet(str(tmp_path / "png")).collect()}["a.png"]) == gradient(30, 20)[1:13, 2:17]).all()


def test_ingest(spark):
    px = sample(spark, 4, 3)
    assert ingest(px).count() == 12
