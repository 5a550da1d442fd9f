"""Resampling of images held as arrays, one for each line: passes are functions of arrays inside a row, so no pixel is ever a row.

Built-in higher-order functions do the sums; no Python worker and one exchange, by image, whatever the number of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.plan import Format, Plan, Step
from ..plans.weights import nearest_index, weights
from .relational import _growth, by_image, channels_of, divided, narrow, premultiplied, within


def to_lines(px: DataFrame, growth: float = 1) -> DataFrame:
    """(image_id, v0, v1, ..): each channel an array of lines from the top, each an array of samples from the left. Pixels gather by line, then lines by image.

    ``growth``: of the work that follows for each pixel, which decides the number of tasks.
    """
    names = channels_of(px)
    each = lambda c: F.transform("l", lambda p: p[c]).alias(c)
    inner = F.array_sort(F.collect_list(F.struct("x", *names)))
    lines = by_image(px, growth).groupBy("image_id", "y").agg(inner.alias("l"))
    lines = lines.select("image_id", "y", *map(each, names))
    whole = lines.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", *names))).alias("l"))
    return whole.select("image_id", *map(each, names))


def from_lines(images: DataFrame) -> DataFrame:
    """Back to pixels (image_id, y, x, v0, ..)."""
    names = channels_of(images)
    zipped = images.select("image_id", F.posexplode(F.arrays_zip(*names)).alias("y", "l"))
    return zipped.select("image_id", "y", F.posexplode(F.arrays_zip(*(F.col(f"l.{c}").alias(c) for c in names))).alias("x", "p")).select("image_id", "y", "x", *(F.col(f"p.{c}").alias(c) for c in names))


def _taps(in_size: int, out_size: int, which: str, format: Format, single: bool) -> Column:
    """An array of arrays of (i, w): each output's taps, i counted from 1. A literal of the plan."""
    made = weights(in_size, out_size, which)
    values = made.fixed if format.fixed_point else made.taps.astype("float32") if single else made.taps
    kind = "bigint" if format.fixed_point else "double"
    value = lambda v: f"CAST({float(v)!r} AS DOUBLE)" if kind == "double" else f"{int(v)}L"
    rows = (", ".join(f"named_struct('i', {int(a) + 1 + k}, 'w', {value(v)})" for k, v in enumerate(w[: int(n)])) for a, n, w in zip(made.start, made.size, values, strict=True))
    return F.expr(f"array({', '.join(f'array({r})' for r in rows)})")


def _zero(format: Format) -> Column:
    return F.lit(0).cast("long") if format.fixed_point else F.lit(0.0)


def across(plane: Column, step: Step, format: Format, single: bool = False) -> Column:
    """Every line of a plane resampled along itself."""
    taps = _taps(step.src[0], step.dst[0], step.filter, format, single)

    def sample_of(line: Column, t: Column) -> Column:
        return narrow(F.aggregate(t, _zero(format), lambda total, k: total + F.get(line, k["i"] - 1) * k["w"]), format)

    return F.transform(plane, lambda line: F.transform(taps, lambda t: sample_of(line, t)))


def down(plane: Column, step: Step, format: Format, single: bool = False) -> Column:
    """Output lines as sums of whole source lines, each times its tap."""
    taps = _taps(step.src[1], step.dst[1], step.filter, format, single)
    none = F.array_repeat(_zero(format), step.src[0])

    def line_of(t: Column) -> Column:
        total = F.aggregate(t, none, lambda sums, k: F.zip_with(sums, F.get(plane, k["i"] - 1), lambda x, v: x + v * k["w"]))
        return F.transform(total, lambda v: narrow(v, format))

    return F.transform(taps, line_of)


def _picked(plane: Column, step: Step) -> Column:
    rows, columns = (F.array(*(F.lit(int(i) + 1) for i in nearest_index(step.src[k], step.dst[k]))) for k in (1, 0))
    return F.transform(rows, lambda y: F.transform(columns, lambda x: F.element_at(F.element_at(plane, y), x)))


def _pair(one: Column, two: Column, how) -> Column:
    return F.zip_with(one, two, lambda a, b: F.zip_with(a, b, how))


def resample_lines(images: DataFrame, plan: Plan) -> DataFrame:
    """Images of ``to_lines`` through a plan: vertical, then horizontal, each narrowed to the format; nothing is exchanged.

    Alpha that varies is found in the row. Images of other sizes than the plan's give lines of nulls or are cut; check pixels by
    ``within`` first. A null image stays null; an empty table stays one.
    """
    format, names = plan.format, channels_of(images)
    alpha = f"v{format.alpha}"
    for step in plan.steps:
        if step.premultiply != "no":
            flat = F.flatten(alpha)
            images = _settled(images)
            flag = F.lit(True) if step.premultiply == "always" else F.array_min(flat) != F.array_max(flat)
            images = images.withColumn("_assoc", flag)
            images = _blended(images, premultiplied, format)
        images = _settled(images)
        if step.filter == "nearest":
            images = images.withColumns({c: _picked(F.col(c), step) for c in names})
        else:
            if step.vertical:
                images = images.withColumns({c: down(F.col(c), step, format, plan.single) for c in names})
            if step.horizontal:
                images = images.withColumns({c: across(F.col(c), step, format, plan.single) for c in names})
        if step.divide != "no":
            images = _blended(images, divided, format).drop("_assoc")
    return images.select("image_id", *names)


def _settled(images: DataFrame) -> DataFrame:
    """The same columns, computed here: else the optimizer puts what makes a plane into the function that reads it for every line."""
    return images.select(F.explode(F.array(F.struct(*images.columns))).alias("_row")).select("_row.*")


def _blended(images: DataFrame, how, format: Format) -> DataFrame:
    colors = [c for c in channels_of(images) if c != f"v{format.alpha}"]
    made = {c: F.when(F.col("_assoc"), _pair(F.col(c), F.col(f"v{format.alpha}"), lambda a, b: how(a, b, format))).otherwise(F.col(c)) for c in colors}
    return images.withColumns(made)


def resample_pixels(px: DataFrame, plan: Plan) -> DataFrame:
    """Pixels to pixels by way of lines; the samples are those of relational.resample."""
    return from_lines(resample_lines(to_lines(within(px, plan.src), _growth(plan)), plan)) if plan.steps else px
