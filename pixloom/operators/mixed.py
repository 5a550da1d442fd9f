"""Pixel rows of images of many sizes in one plan: what an image's size or orientation decides is looked up by its row.

Pixels are dealt by image as runs, compressed columns of the pixels of one image that a task reads one after another, so that no
exchange or sort moves a row for a pixel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CROP_OUT_OF_BOUNDS, ZERO_SIZE
from ..plans.plan import Format, Plan, Scaler
from ..plans.weights import nearest_index, weights
from .relational import KEYS, ORIENTATIONS, channels_of
from .rows import apply

Size = Callable[[Column, Column], tuple[Column, Column]]
#: Pixels that a task gives out together.
_GIVEN = 1 << 16


# ---- runs of pixels ----------------------------------------------------------------------------------------------


def _runs(px: DataFrame) -> DataFrame:
    """(image_id, width, height, run) dealt by image and sorted by it: each run has all other columns of some of its pixels.

    width and height are those of the whole image. Pixels of null images aren't given.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            image = batch.column(0).dictionary_encode()
            at = image.indices.to_numpy()
            if (at[1:] < at[:-1]).any():
                order = np.argsort(at, kind="stable")
                batch, at = batch.take(pa.array(order)), at[order]
            begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            y, x = (batch.column(i).to_numpy() for i in (1, 2))
            far = [pa.array(np.maximum.reduceat(v, begins) + 1, pa.int32()) for v in (x, y)]
            rest = pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:])
            parts = [_closed(rest.slice(lo, hi - lo)) for lo, hi in zip(begins, [*begins[1:], len(at)], strict=True)]
            yield pa.RecordBatch.from_arrays([image.dictionary.take(pa.array(at[begins])), *far, pa.array(parts, pa.binary())], ["image_id", "width", "height", "run"])

    px = px.select(*KEYS, *(c for c in px.columns if c not in KEYS)).where("image_id IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL")
    kind = px.schema["image_id"].dataType.simpleString()
    runs, image = px.mapInArrow(each, f"image_id {kind}, width int, height int, run binary").repartition("image_id"), Window.partitionBy("image_id")
    return runs.withColumns({c: F.max(c).over(image) for c in ("width", "height")}).sortWithinPartitions("image_id")


def _closed(run: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, run.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(run)
    return sink.getvalue().to_pybytes()


def _open(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches as fewer ones."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.num_rows
        if size >= _GIVEN:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=_GIVEN)
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=_GIVEN)


def with_sizes(px: DataFrame) -> DataFrame:
    """``px``, dealt by image, with each image's width and height beside its pixels."""
    carried = [c for c in px.columns if c not in KEYS]
    names = ["image_id", "y", "x", *carried, "width", "height"]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                run = _open(batch.column(3)[r].as_py())
                own, width, height = (pa.repeat(batch.column(i)[r], run.num_rows) for i in range(3))
                yield pa.RecordBatch.from_arrays([own, *run.columns, width, height], names)

    fields = px.select(*KEYS, *carried).schema
    return _runs(px).mapInArrow(lambda batches: _together(opened(batches)), fields.add("width", "integer").add("height", "integer"))


# ---- geometry ----------------------------------------------------------------------------------------------------


def auto_orient(px: DataFrame, orientation: str = "orientation") -> DataFrame:
    """Upright pixels of images that each have an orientation (1 to 8) and a size of their own, in columns beside their pixels.

    ``px`` has width, height and ``orientation``; unknown and null ones leave an image as it is. The result has width and height as
    they are then, and ``orientation`` 1. No pixel leaves its task.
    """
    sized = px.withColumns({"w": F.col("width"), "h": F.col("height")})  # as the table of orientations calls them
    place = []
    for i, name in enumerate("xy"):
        cases = " ".join(f"WHEN {k} THEN {v[i]}" for k, v in ORIENTATIONS.items())
        place.append(F.expr(f"CAST(CASE {orientation} {cases} ELSE {name} END AS INT)").alias(name))
    swapped = F.coalesce(F.col(orientation).isin(*(k for k, v in ORIENTATIONS.items() if v[2])), F.lit(False))
    sides = [F.when(swapped, b).otherwise(F.col(a)).alias(a) for a, b in (("width", F.col("height")), ("height", F.col("width")))]
    return sized.select("image_id", place[1], place[0], *channels_of(px), *sides, F.lit(1).alias(orientation))


def crop_each(px: DataFrame, box: Callable[[Column, Column], tuple[Column, Column, Column, Column]]) -> DataFrame:
    """Of each image the rectangle (x, y, width, height) that ``box`` makes of its size; one beyond the image raises. ``px`` has width and height."""
    x, y, w, h = box(F.col("width"), F.col("height"))
    fits = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= F.col("width")) & (y + h <= F.col("height"))
    say = F.raise_error(F.concat(F.lit(f"[{CROP_OUT_OF_BOUNDS}] a crop beyond image "), F.col("image_id").cast("string"))).cast("boolean")
    inside = px.where(F.when(fits, F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)).otherwise(say))
    return inside.select("image_id", (F.col("y") - y).cast("int").alias("y"), (F.col("x") - x).cast("int").alias("x"), *channels_of(px), w.cast("int").alias("width"), h.cast("int").alias("height"))


def _half_up(x: Column) -> Column:
    return F.greatest(F.floor(x + 0.5), F.lit(1)).cast("int")


def fit_within(width: int, height: int) -> Size:
    """The largest size of an image's own proportions within a box."""

    def of(w: Column, h: Column) -> tuple[Column, Column]:
        scale = F.least(width / w, height / h)
        return _half_up(w * scale), _half_up(h * scale)

    return of


# ---- resampling --------------------------------------------------------------------------------------------------


def _whole(run: pa.Table, width: int, height: int, names: list[str], format: Format) -> tuple[np.ndarray, np.ndarray]:
    """([height, width, channels], which pixels are there) of an image's pixels; what isn't there is 0, and so is a null sample."""
    at = run["y"].to_numpy().astype(np.int64) * width + run["x"].to_numpy()
    there = np.zeros(width * height, bool)
    there[at] = True
    px = np.zeros((width * height, len(names)), np.float64 if format.floating else np.int64)
    for c, name in enumerate(names):
        np.add.at(px[:, c], at, run[name].fill_null(0).to_numpy())
    return px.reshape(height, width, len(names)), there.reshape(height, width)


def _reached(there: np.ndarray, plan: Plan) -> np.ndarray:
    """Which outputs have a tap on a pixel that is there."""
    for step in plan.steps:
        for axis, i in ((0, 1), (1, 0)):
            a, b = step.src[i], step.dst[i]
            if a != b and step.filter == "nearest":
                there = np.take(there, nearest_index(a, b), axis)
            elif a != b:
                w = weights(a, b, step.filter)
                sums = np.insert(np.cumsum(there, axis), 0, 0, axis)
                there = np.take(sums, w.start + w.size, axis) > np.take(sums, w.start, axis)
    return there


def resample_mixed(px: DataFrame, which: str, target: Size, format: Format = Format(), premultiply: bool = False, single: bool = False) -> DataFrame:
    """Each image from its own size to what ``target`` makes of it, in one plan: vertical, then horizontal, each stored in the format.

    Sizes come from a window over the runs of an image's pixels, which are dealt by image once, whatever the sizes; the runs of one image
    make it whole in its task, where it goes through the plan of its size. An axis
    that keeps its size stays as it is. ``premultiply``: colours are multiplied by alpha where it varies in an
    image. A target side below 1 raises. An image without pixels isn't there, nor is an output none of whose taps meets a pixel.
    The result has width and height beside the pixels.
    """
    names = channels_of(px)
    px = px.select(*KEYS, *names)
    kind = pa.float64() if format.floating else pa.int64()
    w, h = target(F.col("width"), F.col("height"))
    say = F.raise_error(F.lit(f"[{ZERO_SIZE}] a target of no width or height")).cast("int")
    runs = _runs(px).select("image_id", "width", "height", "run", *(F.when(c >= 1, c.cast("int")).otherwise(say).alias(n) for c, n in ((w, "to_width"), (h, "to_height"))))

    def made(image: pa.Scalar, width: int, height: int, to: tuple[int, int], parts: list[bytes]) -> pa.RecordBatch:
        data, there = _whole(pa.Table.from_batches([_open(p) for p in parts]), width, height, names, format)
        blend = premultiply and format.alpha is not None and np.ptp(data[there][:, format.alpha]) != 0
        plan = replace(Scaler(which).plan((width, height), to, format, bool(blend)), single=single)
        out = apply(data, plan).reshape(-1, len(names))
        at = np.arange(len(out)) if there.all() else np.flatnonzero(_reached(there, plan))
        place = [pa.array(v.astype(np.int32)) for v in np.divmod(at, to[0])]
        sides = [pa.repeat(pa.scalar(v, pa.int32()), len(at)) for v in to]
        return pa.RecordBatch.from_arrays([pa.repeat(image, len(at)), *place, *(pa.array(out[at, c], kind, safe=False) for c in range(len(names))), *sides], [*KEYS, *names, "width", "height"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, facts, parts = None, (), []
        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.column(0)[r]
                if parts and own != image:
                    yield made(image, *facts, parts)
                    parts = []
                if not parts:
                    width, height, *to = (batch.column(i)[r].as_py() for i in (1, 2, 4, 5))
                    image, facts = own, (width, height, tuple(to))
                parts.append(batch.column(3)[r].as_py())
        if parts:
            yield made(image, *facts, parts)

    fields = px.select(*KEYS).schema
    for c in names:
        fields = fields.add(c, "double" if format.floating else "long")
    return runs.mapInArrow(lambda batches: _together(each(batches)), fields.add("width", "integer").add("height", "integer"))
