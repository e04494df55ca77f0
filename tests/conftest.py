import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(folder / "warehouse")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def solid(spark):
    """Images of one linear premultiplied colour: solid(width, height, rgba, img_id)."""
    from pyspark.sql import functions as F

    def make(width, height, rgba=(0.2, 0.5, 0.9, 1.0), img_id=0):
        px = spark.range(width * height).select(F.lit(img_id).cast("long").alias("img_id"), (F.col("id") % width).cast("int").alias("x"), F.expr(f"cast(id div {width} as int)").alias("y"), F.lit(width).alias("width"), F.lit(height).alias("height"))
        return px.withColumns({c: F.lit(float(v)) for c, v in zip("rgba", rgba)})

    return make


@pytest.fixture
def ramp(solid):
    """r = x, g = y: misplaced pixels show."""
    from pyspark.sql import functions as F

    return lambda width, height: solid(width, height).withColumns({"r": F.col("x").cast("double"), "g": F.col("y").cast("double"), "b": F.lit(0.0)})


@pytest.fixture
def pixels():
    """All pixels as {(x, y): (r, g, b, a)}; checks that the grid is dense."""

    def get(df):
        rows = df.collect()
        out = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in rows}
        assert len(out) == len(rows)
        if rows:
            w, h = rows[0]["width"], rows[0]["height"]
            assert len(rows) == w * h and all(0 <= x < w and 0 <= y < h for x, y in out)
        return out

    return get
