"""Resampling as joins and sums over pixel rows (image_id, y, x, v0, v1, ...), one column per channel.

Everything here is DataFrame operations: Catalyst plans it, and any SQL engine can check it. Rows of an image are brought
together once, by image_id; sums by (image_id, y, x) then need no further shuffle, however many axes and steps there are.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import BUFFER_MISMATCH, CROP_OUT_OF_BOUNDS, ResampleError
from ..functions.kernels import find_filter
from ..plans.frames import weight_frame
from ..plans.plan import Format, Plan, Step
from ..plans.weights import nearest_index, weights

KEYS = ("image_id", "y", "x")
#: Weight rows that are sent to all tasks at most; a larger table is joined by shuffle.
MOST_SENT = 1 << 20
#: Outputs of one pass that a task sums.
SUMMED = 1 << 19


def channels_of(px: DataFrame) -> list[str]:
    return sorted((c for c in px.columns if c[0] == "v" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def by_image(px: DataFrame, growth: float = 1) -> DataFrame:
    """``px`` dealt by image to as many tasks as hold SUMMED outputs each, if every pixel becomes ``growth`` of them: the sums of a pass
    are all held until its last pixel was read. Costs a count of the pixels."""
    spark = px.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, ceil(px.select("image_id").count() * max(growth, 1) / SUMMED))
    return px.repartition(tasks, "image_id")


def _flag(px: DataFrame) -> list[str]:
    """The column that says whether an image's colours are multiplied by alpha, where there is one; it is the same in all of its pixels."""
    return [c for c in px.columns if c == "assoc"]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_SENT else df


# ---- axis passes -------------------------------------------------------------------------------------------------


def _sent(in_size: int, out_size: int, which: str) -> bool:
    """Whether the taps of an axis are few enough to be sent to all tasks."""
    return out_size * 2 * find_filter(which).radius * max(1.0, in_size / out_size) <= MOST_SENT


def weight_rows(spark: SparkSession, in_size: int, out_size: int, which: str) -> DataFrame:
    """(out_idx, in_idx, tap, w, wq): within MOST_SENT rows made here and sent to all tasks, beyond that made by Spark and joined by shuffle."""
    if not _sent(in_size, out_size, which):
        sizes = spark.range(1).select(F.lit(in_size).alias("in_size"), F.lit(out_size).alias("out_size"))
        return weight_frame(sizes, which).select(*(F.col(c).cast("int").alias(c) for c in ("out_idx", "in_idx", "tap")), "w", "wq")
    rows = weights(in_size, out_size, which).rows()
    return F.broadcast(spark.createDataFrame(rows, "out_idx int, in_idx int, tap int, w double, wq long"))


def in_order(met: DataFrame, place: list[str], sent: bool) -> DataFrame:
    """``met``, pixels beside the taps that use them, with the rows of an output side by side and by their source.

    Sums of doubles are added so, as many lie on a tie of the precision that they are stored in, where the last bit decides, and neither
    hash maps nor exchanges keep an order. Rows side by side stay one sum where a map spills. Where taps weren't ``sent``, their join has
    parted the pixels of an image, which meet again by image_id and ``place``.
    """
    met = met if sent else met.repartition("image_id", *place)
    return met.sortWithinPartitions("image_id", *place, "out_idx", "in_idx", *channels_of(met))


def half(x: Column) -> Column:
    """A double as the nearest half-precision number, still a double: splitting it by 2^42 + 1 keeps 11 of its 53 bits."""
    wide = x * 4398046511105.0
    small = F.rint(x * 16777216.0) / 16777216.0  # below 2^-14 steps are of one size
    return F.when(F.abs(x) < 2.0**-14, small).when(F.abs(x) >= 65520.0, x * float("inf")).otherwise(wide - (wide - x))


def stored(x: Column, format: Format) -> Column:
    """A floating-point number as the format stores it."""
    return half(x) if format.sample == "f16" else x.cast("float").cast("double")


def narrow(total: Column, format: Format) -> Column:
    """A sum of weighted samples as a sample: Q15 sums are rounded and shifted, others rounded half away from zero; both clamp."""
    if format.floating:
        return stored(total, format)
    low, high = format.limits
    # Ties are common (weights of sixteenths), so a sum is taken to a millionth first: its order then doesn't matter.
    value = F.shiftright(total + (1 << 14), 15) if format.fixed_point else F.round(F.round(total, 6)).cast("long")
    return F.greatest(F.lit(low), F.least(F.lit(high), value)).cast("long")


def axis_pass(px: DataFrame, axis: str, in_size: int, out_size: int, which: str, format: Format, single: bool = False) -> DataFrame:
    """One axis ('x' or 'y') resampled: pixels meet the taps that use them and are summed by output."""
    taps, names = weight_rows(px.sparkSession, in_size, out_size, which), channels_of(px)
    other = "y" if axis == "x" else "x"
    tap = F.col("wq") if format.fixed_point else F.col("w").cast("float").cast("double") if single else F.col("w")
    met, flag = px.join(taps, px[axis] == taps["in_idx"]), _flag(px)
    if format.floating:
        met = in_order(met, [other], _sent(in_size, out_size, which))
    summed = met.groupBy("image_id", other, F.col("out_idx").alias(axis), *flag).agg(*(F.sum(F.col(c) * tap).alias(c) for c in names))
    return summed.select(*KEYS, *(narrow(F.col(c), format).alias(c) for c in names), *flag)


def nearest_pass(px: DataFrame, step: Step) -> DataFrame:
    """Each output takes one source sample: two joins on index maps, no sums."""
    spark, out = px.sparkSession, px
    for axis, i in (("y", 1), ("x", 0)):
        rows = [(o, int(s)) for o, s in enumerate(nearest_index(step.src[i], step.dst[i]))]
        index = _small(spark.createDataFrame(rows, f"{axis}_out int, {axis} int"), len(rows))
        out = out.join(index, axis).drop(axis).withColumnRenamed(f"{axis}_out", axis)
    return out.select(*KEYS, *channels_of(px), *_flag(px))


# ---- alpha -------------------------------------------------------------------------------------------------------


def premultiplied(color: Column, alpha: Column, format: Format) -> Column:
    if format.floating:
        return stored(color * alpha, format)
    most = format.limits[1]
    if format.depth == 8:  # the usual exact rounding division by 255
        product = color * alpha + 128
        return F.shiftright(product + F.shiftright(product, 8), 8).cast("long")
    if format.depth in (10, 12, 16):
        return F.floor((color * alpha + most // 2) / most).cast("long")
    return F.least(F.lit(most), F.round(color * alpha / most)).cast("long")


def divided(color: Column, alpha: Column, format: Format) -> Column:
    """The inverse. Where alpha is 0, 8-bit and float colours become 0 and 16-bit ones stay."""
    if format.floating:
        return F.when(alpha == 0, F.lit(0.0)).otherwise(stored(color / F.nullif(alpha, F.lit(0.0)), format))
    most = format.limits[1]
    safe = F.greatest(alpha, F.lit(1))
    if format.depth == 8:
        return F.when(alpha == 0, F.lit(0)).otherwise(F.least(F.lit(255), F.floor((color * 255 + F.floor(safe / 2)) / safe))).cast("long")
    return F.when(alpha == 0, color).otherwise(F.least(F.lit(most), F.round(color * most / safe))).cast("long")


def varying_alpha(px: DataFrame, alpha: str) -> Column:
    image = Window.partitionBy("image_id")
    return F.min(alpha).over(image) != F.max(alpha).over(image)


def alpha_nonconstant(px: DataFrame, alpha: str) -> DataFrame:
    """(image_id, nonconstant): whether any alpha differs from another in the image."""
    return px.groupBy("image_id").agg((F.min(alpha) != F.max(alpha)).alias("nonconstant"))


def _blend(px: DataFrame, how: Callable, format: Format, when: str) -> DataFrame:
    names, alpha, flag = channels_of(px), f"v{format.alpha}", _flag(px)
    go = F.lit(True) if when == "always" or not flag else F.col("assoc")
    return px.select(*KEYS, *(F.col(c) if c == alpha else F.when(go, how(F.col(c), F.col(alpha), format)).otherwise(F.col(c)).alias(c) for c in names), *flag)


def premultiply(px: DataFrame, format: Format) -> DataFrame:
    return _blend(px, premultiplied, format, "always")


def unpremultiply(px: DataFrame, format: Format) -> DataFrame:
    return _blend(px, divided, format, "always")


# ---- plans -------------------------------------------------------------------------------------------------------


def within(px: DataFrame, size: tuple[int, int]) -> DataFrame:
    """``px``; a pixel outside of ``size`` raises when it is read, as its image is larger than a plan is for."""
    inside = F.col("x").between(0, size[0] - 1) & F.col("y").between(0, size[1] - 1)
    say = F.raise_error(F.lit(f"[{BUFFER_MISMATCH}] a pixel outside of {size[0]}x{size[1]}"))
    return px.where(F.when(inside, F.lit(True)).otherwise(say.cast("boolean")))


def whole(px: DataFrame, size: tuple[int, int]) -> DataFrame:
    """``px``; an image that hasn't as many pixels as ``size`` raises when it is read. Costs a sort by image."""
    many = F.count("*").over(Window.partitionBy("image_id"))
    say = F.raise_error(F.lit(f"[{BUFFER_MISMATCH}] an image that is not {size[0]}x{size[1]}"))
    return within(px, size).withColumn("_many", many).where(F.when(F.col("_many") == size[0] * size[1], F.lit(True)).otherwise(say.cast("boolean"))).drop("_many")


def run_step(px: DataFrame, step: Step, format: Format, single: bool = False) -> DataFrame:
    """Vertical, then horizontal, each stored in the sample type; an axis of equal sizes is left out."""
    if step.filter == "nearest":
        return nearest_pass(px, step)
    if step.vertical:
        px = axis_pass(px, "y", step.src[1], step.dst[1], step.filter, format, single)
    if step.horizontal:
        px = axis_pass(px, "x", step.src[0], step.dst[0], step.filter, format, single)
    return px


def _growth(plan: Plan) -> float:
    """The most outputs for a source pixel that any pass of the plan has; between its two passes a step has its new height and old width."""
    return max(max(s.dst[0], s.src[0]) * s.dst[1] for s in plan.steps) / (plan.src[0] * plan.src[1])


def resample(px: DataFrame, plan: Plan) -> DataFrame:
    """Pixels of images of the plan's source size, resampled to its target. Pixels beyond that size raise; see also ``whole``.

    The source is counted, read once and dealt by image once, whatever the plan, to tasks that grow in number with what comes out: whether alpha varies is told by a window over the image.
    """
    if not plan.steps:
        return px
    px, format = within(by_image(px, _growth(plan)), plan.src), plan.format
    for step in plan.steps:
        if step.premultiply == "varying":
            px = px.withColumn("assoc", varying_alpha(px, f"v{format.alpha}"))
            px = _blend(px, premultiplied, format, "varying")
        elif step.premultiply == "always":
            px = premultiply(px, format)
        px = run_step(px, step, format, plan.single)
        if step.divide == "varying":
            px = _blend(px, divided, format, "varying").drop("assoc")
        elif step.divide == "always":
            px = unpremultiply(px, format)
    return px


# ---- geometry ----------------------------------------------------------------------------------------------------


def crop(px: DataFrame, size: tuple[int, int], x: int, y: int, width: int, height: int) -> DataFrame:
    """The rectangle from (x, y), moved to the origin. The filter reaches the scan."""
    if x < 0 or y < 0 or width <= 0 or height <= 0 or x + width > size[0] or y + height > size[1]:
        raise ResampleError(CROP_OUT_OF_BOUNDS, f"a crop of {width}x{height} at ({x}, {y}) of {size[0]}x{size[1]}")
    inside = px.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return inside.withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


#: EXIF orientation: the new (x, y) as SQL of x, y, w, h; and whether sides swap.
ORIENTATIONS = {
    1: ("x", "y", False), 2: ("w - 1 - x", "y", False), 3: ("w - 1 - x", "h - 1 - y", False), 4: ("x", "h - 1 - y", False),
    5: ("y", "x", True), 6: ("h - 1 - y", "x", True), 7: ("h - 1 - y", "w - 1 - x", True), 8: ("y", "w - 1 - x", True),
}


def orient(px: DataFrame, size: tuple[int, int], orientation: int) -> DataFrame:
    """Upright pixels; unknown orientations leave them as they are."""
    nx, ny, _ = ORIENTATIONS.get(orientation, ORIENTATIONS[1])
    sized = px.withColumns({"w": F.lit(size[0]), "h": F.lit(size[1])})
    return sized.withColumns({"nx": F.expr(nx), "ny": F.expr(ny)}).select("image_id", F.col("ny").cast("int").alias("y"), F.col("nx").cast("int").alias("x"), *channels_of(px))


def oriented_size(size: tuple[int, int], orientation: int) -> tuple[int, int]:
    return (size[1], size[0]) if ORIENTATIONS.get(orientation, ORIENTATIONS[1])[2] else size


def split_channel(px: DataFrame, channel: int) -> DataFrame:
    return px.select(*KEYS, F.col(f"v{channel}").alias("v0"))


def merge_channels(planes: list[DataFrame]) -> DataFrame:
    out = planes[0]
    for i, plane in enumerate(planes[1:], 1):
        out = out.join(plane.withColumnRenamed("v0", f"v{i}"), list(KEYS))
    return out


def fitted(size: tuple[int, int], box: tuple[int, int], mode: str) -> tuple[int, int]:
    """The size that a mode scales to, before cropping or padding."""
    (w, h), (bw, bh) = size, box
    if mode == "fill":
        return box
    scale = {"fit_width": bw / w, "fit_height": bh / h, "fit": min(bw / w, bh / h), "cover": max(bw / w, bh / h)}.get(mode)
    if scale is None:
        raise ResampleError(13, f"unknown resize mode {mode!r}")
    side = lambda n: max(1, int(n * scale + 0.5))
    return {"fit_width": (bw, side(h)), "fit_height": (side(w), bh)}.get(mode, (side(w), side(h)))


def cover_crop(size: tuple[int, int], box: tuple[int, int]) -> tuple[int, int, int, int]:
    """The centred part (x, y, width, height) of an image that has the box's proportions."""
    scale = max(box[0] / size[0], box[1] / size[1])
    w, h = (min(n, max(1, int(b / scale + 0.5))) for n, b in zip(size, box, strict=True))
    return (size[0] - w) // 2, (size[1] - h) // 2, w, h


def pad(px: DataFrame, size: tuple[int, int], box: tuple[int, int], background: tuple[int, ...]) -> DataFrame:
    """Centred on a canvas of the background's colour; samples keep their type."""
    names, left, top = channels_of(px), (box[0] - size[0]) // 2, (box[1] - size[1]) // 2
    grid = px.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(box[1] - 1))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(box[0] - 1))).alias("x"))
    placed = px.withColumns({"x": F.col("x") + left, "y": F.col("y") + top})
    filled = grid.join(placed, list(KEYS), "left")
    return filled.select(*KEYS, *(F.coalesce(c, F.lit(b).cast(px.schema[c].dataType)).alias(c) for c, b in zip(names, background, strict=False)))


def resize_mode(px: DataFrame, size: tuple[int, int], box: tuple[int, int], mode: str, plan_of: Callable[[tuple[int, int], tuple[int, int]], Plan], background: tuple[int, ...] = (0, 0, 0, 255)) -> DataFrame:
    """fill, fit_width, fit_height, fit (padded to the box) or cover (cropped to its proportions first)."""
    if mode == "cover":
        x, y, w, h = cover_crop(size, box)
        return resample(crop(px, size, x, y, w, h), plan_of((w, h), box))
    to = fitted(size, box, mode)
    out = resample(px, plan_of(size, to))
    return pad(out, to, box, background) if mode == "fit" else out


# ---- packed 10-bit -----------------------------------------------------------------------------------------------


def _swapped(p: Column) -> Column:
    return F.shiftleft(p.bitwiseAND(0xFF), 24).bitwiseOR(F.shiftleft(p.bitwiseAND(0xFF00), 8)).bitwiseOR(F.shiftright(p, 8).bitwiseAND(0xFF00)).bitwiseOR(F.shiftright(p, 24).bitwiseAND(0xFF))


#: Bit positions of red, green, blue and of the two alpha bits.
PACKED = {"ar30": (0, 10, 20, 30), "ra30": (22, 12, 2, 0)}


def unpack30(px: DataFrame, kind: str, order: str = "host") -> DataFrame:
    """(.., v0 = 32-bit pixel) as three 10-bit channels. order 'network' has the bytes reversed."""
    p = F.col("v0").cast("long")
    p = _swapped(p) if order == "network" else p
    return px.select(*KEYS, *(F.shiftright(p, s).bitwiseAND(1023).alias(f"v{i}") for i, s in enumerate(PACKED[kind][:3])))


def pack30(px: DataFrame, kind: str, order: str = "host") -> DataFrame:
    """Back to one 32-bit number; alpha is opaque."""
    *rgb, alpha = PACKED[kind]
    p = F.lit(3 << alpha).cast("long")
    for i, s in enumerate(rgb):
        p = p.bitwiseOR(F.shiftleft(F.col(f"v{i}").cast("long"), s))
    return px.select(*KEYS, (_swapped(p) if order == "network" else p).alias("v0"))


def resample30(px: DataFrame, kind: str, plan: Plan, order: str = "host") -> DataFrame:
    """Packed pixels through 10-bit channels; nearest needs no unpacking."""
    if plan.steps and plan.steps[0].filter == "nearest":
        return resample(px, plan)
    return pack30(resample(unpack30(px, kind, order), plan), kind, order) if plan.steps else px
