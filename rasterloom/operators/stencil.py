"""Separable neighbourhood operations: blur, sharpen, resize.

Each pass gathers the pixels of an image row (then of a column) into arrays, filters many lines at once with numpy and
hands pixels out again; a group is one line of one image, so its size is bounded by the image's width or height. The
order of summation within a line is fixed, so results don't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stencil import SUPPORT, apply_line
from ..packaging import ship

C = F.col


def _lines(df: DataFrame, along: str, channels: tuple, size: str | None, carry: tuple) -> DataFrame:
    """A row per line: img_id, line, width, height, the first position, samples after the pass (0: as before), columns to carry, and an array per channel in order of `along`."""
    across = "y" if along == "x" else "x"
    packed = F.array_sort(F.collect_list(F.struct(C(along).alias("at"), *(C(c).alias(c) for c in channels))))
    lines = df.groupBy("img_id", C(across).alias("line"), "width", "height", *carry, *([size] if size else [])).agg(packed.alias("p"))
    return lines.select("img_id", "line", "width", "height", C("p")[0]["at"].alias("first"), (C(size) if size else F.lit(0)).cast("int").alias("n_out"), *carry, *(C("p")[c].alias(c) for c in channels))


def filter_pass(df: DataFrame, along: str, how: str, channels: Sequence[str] = "rgba", sigma: float = 0.0, size: str | None = None, carry: tuple[str, ...] = (), keep: tuple[str, ...] = (), shift: int = 0) -> DataFrame:
    """Filters every line along x or y. `size`: column with the samples of a line after it (for resize, where a line may be a part of the whole: its other samples count as zeros); None: as before.
    `carry`: other columns that each image has one value of, and that stay. `keep`: channels that go through as they are. `shift`: places by which samples move up the line before they are filtered, zeros following; `how` none only moves."""
    ship(df.sparkSession)
    channels = tuple(channels)
    lines = _lines(df, along, channels + keep, size, carry)
    n_keys, side = 6 + len(carry), 2 if along == "x" else 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, wanted = np.diff(batch.column(channels[0]).offsets.to_numpy()), batch.column("n_out").to_numpy()
            first = batch.column("first").to_numpy() if size else np.zeros(len(lengths), int)
            full = batch.column(side).to_numpy() if size else lengths
            values = {c: batch.column(c).flatten().to_numpy() for c in channels}
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            out: dict[int, np.ndarray] = {}
            for n, to, begin, whole in np.unique(np.stack([lengths, wanted, first, full]), axis=1).T.tolist():
                rows = np.flatnonzero((lengths == n) & (wanted == to) & (first == begin) & (full == whole))
                at = starts[rows][:, None] + np.arange(n)
                stacked = np.stack([values[c][at] for c in channels])
                if n < whole or shift:
                    moved = np.zeros((len(channels), len(rows), whole))
                    low, high = max(0, begin + shift), min(whole, begin + shift + n)
                    moved[..., low:high] = stacked[..., low - begin - shift : high - begin - shift]
                    stacked = moved
                filtered = stacked.reshape(-1, whole) if how == "none" else apply_line(stacked.reshape(-1, whole), to or whole, how, sigma)
                filtered = filtered.reshape(len(channels), len(rows), -1)
                out |= {int(r): filtered[:, k] for k, r in enumerate(rows)}
            results = [out[i] for i in range(batch.num_rows)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([r.shape[1] for r in results])]).astype(np.int32)) if results else pa.array([0], pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in results]) if results else np.empty(0))) for k in range(len(channels))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_keys)] + arrays + [batch.column(c) for c in keep], [*batch.schema.names[:n_keys], *channels, *keep])

    kept = "".join(f", `{c}` {lines.schema[c].dataType.simpleString()}" for c in carry)
    id_type = df.schema["img_id"].dataType.simpleString()
    done = lines.mapInArrow(run, f"img_id {id_type}, line int, width int, height int, first int, n_out int{kept}, " + ", ".join(f"{c} array<double>" for c in channels + keep))
    across, side_name = ("y", "width") if along == "x" else ("x", "height")
    spread = done.select("img_id", C("line").alias(across), "width", "height", "first", "n_out", *carry, F.posexplode(F.arrays_zip(*channels, *keep)).alias("at", "v"))
    spread = spread.withColumn(along, (C("at") if size else C("first") + C("at")).cast("int"))
    spread = spread.withColumn(side_name, C("n_out")) if size else spread
    return spread.select("img_id", "x", "y", "width", "height", *carry, *(C("v")[c].alias(c) for c in channels + keep))


def blur(df: DataFrame, sigma: float, channels: str = "rgba") -> DataFrame:
    """Gaussian blur of standard deviation sigma; beyond an edge the edge's pixel counts."""
    if sigma <= 0:
        return df
    return filter_pass(filter_pass(df, "x", "gauss", channels, sigma), "y", "gauss", channels, sigma)


def sharpen(df: DataFrame, amount: float, radius: float) -> DataFrame:
    """Adds the difference to a blurred copy to red, green and blue; alpha stays."""
    if amount == 0 or radius <= 0:
        return df
    soft = blur(df, radius, "rgb").select("img_id", "x", "y", *(C(c).alias(f"soft_{c}") for c in "rgb"))
    both = df.join(soft, ["img_id", "x", "y"])
    return both.withColumns({c: C(c) + amount * (C(c) - C(f"soft_{c}")) for c in "rgb"}).select(*df.columns)


def resize_to(df: DataFrame, how: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Resamples along x to the column to_width, then along y to to_height, whatever the sizes: lines of equal lengths are filtered together.

    `window`: left, top, right, bottom (exclusive) of what is wanted of the result. Only the pixels that its taps read are moved; pixels of the result outside it are left out, sizes stay those of the whole."""
    if window is not None:
        left, top, right, bottom = window
        df = df.where(_read("x", "width", "to_width", left, right, how) & _read("y", "height", "to_height", top, bottom, how))
    across = filter_pass(df, "x", how, size="to_width", carry=("to_height",))
    if window is not None:
        across = across.where((C("x") >= left) & (C("x") < right))
    out = filter_pass(across, "y", how, size="to_height")
    return out if window is None else out.where((C("y") >= top) & (C("y") < bottom))


def _read(at: str, size: str, to: str, first: int, last: int, how: str) -> Column:
    """Whether the taps of results from `first` to `last` (exclusive) may read a position; a pixel more on either side."""
    scale = C(size) / C(to)
    reach = SUPPORT[how] * F.greatest(scale, F.lit(1.0)) + 1.5
    return (C(at) >= (first + 0.5) * scale - 0.5 - reach) & (C(at) <= (last - 0.5) * scale - 0.5 + reach)


def resize(df: DataFrame, width: int | None, height: int | None, how: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """With one size given each image keeps its aspect (rounded, halves up, 1 at least)."""
    share = lambda side, of, to: F.greatest(F.expr(f"(2L * {side} * {to} + {of}) div (2L * {of})"), F.lit(1))
    to = {
        "to_width": F.lit(width) if width is not None else share(height, "height", "width"),
        "to_height": F.lit(height) if height is not None else share(width, "width", "height"),
    }
    return resize_to(df.withColumns({k: v.cast("int") for k, v in to.items()}), how, window)
