"""One image over many tasks: bands of output rows, each with the source rows that its taps need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GENERIC, ResampleError
from ..plans.plan import Plan, Step
from ..plans.weights import nearest_index, weights
from .relational import KEYS, _blend, _sent, _small, alpha_nonconstant, channels_of, divided, in_order, narrow, premultiplied, premultiply, unpremultiply, weight_rows, within

#: Samples of a plane that are worth a task of their own.
AREA = 256 * 256


def band_count(size: tuple[int, int], policy: str | int, most: int) -> int:
    """Bands of an image: one ("single"), a given number, or one for each AREA pixels within ``most`` ("adaptive")."""
    if policy == "single":
        return 1
    if isinstance(policy, int) and not isinstance(policy, bool):
        return max(1, policy)
    if policy == "adaptive":
        return min(max(1, size[0] * size[1] // AREA), max(1, most))
    raise ResampleError(GENERIC, f"no threading policy {policy!r}")


def reach(step: Step, rows: int) -> list[tuple[int, int]]:
    """(y, band): the source rows that the taps of each band of ``rows`` output rows need, those next to it included."""
    if step.filter == "nearest":
        source = nearest_index(step.src[1], step.dst[1])
        return sorted({(int(y), o // rows) for o, y in enumerate(source)})
    if not step.vertical:
        return [(y, y // rows) for y in range(step.src[1])]
    made = weights(step.src[1], step.dst[1], step.filter)
    return sorted({(y, o // rows) for o in range(step.dst[1]) for y in range(int(made.start[o]), int(made.start[o] + made.size[o]))})


def dealt(px: DataFrame, step: Step, bands: int) -> DataFrame:
    """``px`` with a band, a row once for each band that needs it, dealt by image and band."""
    rows = -(-step.dst[1] // bands)
    found = reach(step, rows)
    near = _small(px.sparkSession.createDataFrame(found, "y int, band int"), len(found))
    return px.join(near, "y").repartition("image_id", "band")


def _vertical(px: DataFrame, step: Step, plan: Plan, rows: int) -> DataFrame:
    """The vertical pass within bands: taps of other bands' outputs are left to these."""
    names, format = channels_of(px), plan.format
    taps = weight_rows(px.sparkSession, step.src[1], step.dst[1], step.filter).withColumn("of", F.floor(F.col("out_idx") / rows).cast("int"))
    tap = F.col("wq") if format.fixed_point else F.col("w").cast("float").cast("double") if plan.single else F.col("w")
    met = px.join(taps, (px["y"] == taps["in_idx"]) & (px["band"] == taps["of"]))
    if format.floating:
        met = in_order(met, ["band", "x"], _sent(step.src[1], step.dst[1], step.filter))
    summed = met.groupBy("image_id", "band", "x", F.col("out_idx").alias("y")).agg(*(F.sum(F.col(c) * tap).alias(c) for c in names))
    return summed.select("image_id", "band", "y", "x", *(narrow(F.col(c), format).alias(c) for c in names))


def _horizontal(px: DataFrame, step: Step, plan: Plan) -> DataFrame:
    names, format = channels_of(px), plan.format
    taps = weight_rows(px.sparkSession, step.src[0], step.dst[0], step.filter)
    tap = F.col("wq") if format.fixed_point else F.col("w").cast("float").cast("double") if plan.single else F.col("w")
    met = px.join(taps, px["x"] == taps["in_idx"])
    if format.floating:
        met = in_order(met, ["band", "y"], _sent(step.src[0], step.dst[0], step.filter))
    summed = met.groupBy("image_id", "band", "y", F.col("out_idx").alias("x")).agg(*(F.sum(F.col(c) * tap).alias(c) for c in names))
    return summed.select("image_id", "band", "y", "x", *(narrow(F.col(c), format).alias(c) for c in names))


def _nearest(px: DataFrame, step: Step, rows: int) -> DataFrame:
    spark, names = px.sparkSession, channels_of(px)
    down = [(o, int(y), o // rows) for o, y in enumerate(nearest_index(step.src[1], step.dst[1]))]
    across = [(o, int(x)) for o, x in enumerate(nearest_index(step.src[0], step.dst[0]))]
    px = px.join(_small(spark.createDataFrame(down, "to_y int, y int, band int"), len(down)), ["y", "band"])
    px = px.join(_small(spark.createDataFrame(across, "to_x int, x int"), len(across)), "x")
    return px.select("image_id", F.col("to_y").alias("y"), F.col("to_x").alias("x"), *names)


def resample_banded(px: DataFrame, plan: Plan, policy: str | int = "adaptive") -> DataFrame:
    """As relational.resample, to the same samples, with the work on one image in as many tasks as ``policy`` gives it bands.

    Each step deals pixels by image and band once; rows next to a band go to both. Whether alpha varies in an image is found by
    an aggregate that is combined before it is exchanged, one row for each image.
    """
    if not plan.steps:
        return px
    format = plan.format
    px = within(px, plan.src)
    flags = None
    for step in plan.steps:
        bands = min(band_count(step.dst, policy, px.sparkSession.sparkContext.defaultParallelism), step.dst[1])
        rows = -(-step.dst[1] // bands)
        if step.premultiply == "varying":
            flags = alpha_nonconstant(px, f"v{format.alpha}").withColumnRenamed("nonconstant", "assoc")
            px = _blend(px.join(flags, "image_id"), premultiplied, format, "varying").drop("assoc")
        elif step.premultiply == "always":
            px = premultiply(px, format)
        px = dealt(px, step, bands)
        if step.filter == "nearest":
            px = _nearest(px, step, rows)
        else:
            if step.vertical:
                px = _vertical(px, step, plan, rows)
            if step.horizontal:
                px = _horizontal(px, step, plan)
            px = px.select(*KEYS, *channels_of(px))
        if step.divide == "varying":
            px = _blend(px.join(flags, "image_id"), divided, format, "varying").drop("assoc")
        elif step.divide == "always":
            px = unpremultiply(px, format)
    return px
