"""Tap weights as DataFrames: made by Spark, for a table of sizes, with no loop over sizes or taps on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import tap
from ..functions.kernels import Filter, find_filter
from .weights import LEAST_TAP, MOST_TAP, PRECISION

SIZES = ("in_size", "out_size")
ONE = 1 << PRECISION


def _number(c: str) -> Column:
    return F.col(c).cast("double")


def _windowed(sizes: DataFrame, f: Filter) -> DataFrame:
    """(in_size, out_size, out_idx, in_idx, tap, w) of kernels laid over each output's centre; windows are cut at the edges."""
    scale = _number("in_size") / _number("out_size")
    wide = F.lit(1.0) if f.fixed else F.greatest(scale, F.lit(1.0))
    sized = sizes.withColumns({"scale": scale, "narrow": F.lit(1.0) / wide, "base": F.floor(wide * (2.0 * f.radius) + 0.5)})
    outputs = sized.withColumn("out_idx", F.explode(F.sequence(F.lit(0), F.col("out_size") - 1)))
    centred = outputs.withColumn("centre", F.least((F.col("out_idx") + 0.5) * F.col("scale"), _number("in_size")))
    first = F.greatest(F.floor(F.col("centre") - F.col("base") / 2), F.lit(0))
    last = F.least(F.ceil(F.col("centre") + F.col("base") / 2), first + F.col("base"), F.col("in_size").cast("long"))
    taps = centred.withColumn("first", first).withColumn("many", last - first).where("many > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("tap"))
    placed = taps.withColumn("in_idx", F.col("first") + F.col("tap"))
    distance = F.abs(F.col("in_idx") - (F.col("centre") - 0.5))
    return placed.select(*SIZES, "out_idx", "in_idx", "tap", tap(f, distance, F.col("narrow")).alias("w"))


def _area_growing(sizes: DataFrame) -> DataFrame:
    """Area when it grows: each output lies between two samples, by the share of it that reaches into the second."""
    scale = _number("in_size") / _number("out_size")
    outputs = sizes.withColumn("out_idx", F.explode(F.sequence(F.lit(0), F.col("out_size") - 1)))
    first = F.floor(F.col("out_idx") * scale)
    reach = F.col("out_idx") + 1 - (F.col("first") + 1) / scale
    share = F.when(F.col("reach") <= 0, 0.0).otherwise(F.col("reach") - F.floor("reach"))
    both = outputs.withColumn("first", first).withColumn("reach", reach).withColumn("share", share).withColumn("tap", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    placed = both.withColumn("in_idx", F.col("first") + F.col("tap")).where("in_idx < in_size")
    return placed.select(*SIZES, "out_idx", "in_idx", "tap", F.when(F.col("tap") == 0, 1 - F.col("share")).otherwise(F.col("share")).alias("w"))


def _alone(sizes: DataFrame, in_idx: Column) -> DataFrame:
    """One tap of weight one for each output."""
    return sizes.withColumn("out_idx", F.explode(F.sequence(F.lit(0), F.col("out_size") - 1))).select(*SIZES, "out_idx", in_idx.cast("long").alias("in_idx"), F.lit(0).cast("long").alias("tap"), F.lit(1.0).alias("w"))


def _nearest() -> Column:
    """The source sample of an output, in 32-bit fixed point."""
    step = F.expr("shiftleft(CAST(in_size AS BIGINT), 32) div out_size")
    return F.least(F.shiftright(F.col("out_idx") * step + F.floor(step / 2), 32), F.col("in_size").cast("long") - 1)


def quantised(taps: DataFrame, by: list[str]) -> DataFrame:
    """``taps`` with wq: w in fixed point, so that the taps of each output add up to 2^15.

    What rounding leaves over goes to the largest taps first, to each as much as it has room for; a running sum of the room
    of the taps before it says how much reaches each one.
    """
    q = F.greatest(F.lit(LEAST_TAP), F.least(F.lit(MOST_TAP), F.round(F.col("w") * ONE))).cast("long")
    out = Window.partitionBy(*by)
    before = out.orderBy(F.abs("q").desc(), "tap").rowsBetween(Window.unboundedPreceding, -1)
    left = taps.withColumn("q", q).withColumn("left", ONE - F.sum("q").over(out))
    room = F.when(F.col("left") > 0, MOST_TAP - F.col("q")).otherwise(F.col("q") - LEAST_TAP)
    dealt = left.withColumn("room", room).withColumn("taken", F.coalesce(F.sum("room").over(before), F.lit(0)))
    change = F.signum("left").cast("long") * F.greatest(F.lit(0), F.least(F.col("room"), F.abs("left") - F.col("taken")))
    return dealt.withColumn("wq", F.col("q") + change).drop("q", "left", "room", "taken")


def weight_frame(sizes: DataFrame, which: str | int | None) -> DataFrame:
    """(in_size, out_size, out_idx, in_idx, tap, w, wq): the taps of a filter for every row (in_size, out_size) of ``sizes``.

    Repeated sizes count once; sizes that aren't positive, and nulls, have no taps. Where both are equal there is one tap of weight one,
    which changes nothing in either arithmetic.
    """
    f = find_filter(which)
    sizes = sizes.select(*(F.col(c).cast("int").alias(c) for c in SIZES)).where("in_size > 0 AND out_size > 0").distinct()
    same, other = sizes.where("in_size = out_size"), sizes.where("in_size <> out_size")
    kept = _alone(same, F.col("out_idx")).withColumn("wq", F.lit(ONE).cast("long"))
    if f.name == "nearest":
        return kept.unionByName(_alone(other, _nearest()).withColumn("wq", F.lit(ONE).cast("long")))
    raw = _windowed(other.where("out_size < in_size"), f).unionByName(_area_growing(other.where("out_size > in_size"))) if f.area else _windowed(other, f)
    by = [*SIZES, "out_idx"]
    total = F.sum("w").over(Window.partitionBy(*by))
    normal = raw.withColumn("total", total).withColumn("w", F.when(F.col("total") == 0, 0.0).otherwise(F.col("w") * (1.0 / F.col("total")))).drop("total")
    return kept.unionByName(quantised(normal, by))
