"""Resampling in another colour space: samples are converted, resampled as floats (or as linear integers) and converted back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GENERIC, UNSUPPORTED_BIT_DEPTH, ResampleError
from ..functions.colorspaces import ALPHA_STAGES, LINEAR, TRANSFERS, decode, encode, linear_stages, spaces, store
from ..plans.plan import Format, Plan, Scaler
from .relational import KEYS, channels_of, resample


#: Entries of the tables from linear light back to samples, by sample type; single precision, as the entries themselves.
BACK_ENTRIES = {"u8": 1 << 16, "u16": 1 << 18}


@dataclass(frozen=True)
class Curve:
    """A curve as a table: SQL of entry @ (a whole number), how many there are, and what makes a value the number of its entry."""

    entry: str
    entries: int
    scale: int = 1

    def table(self, spark: SparkSession) -> DataFrame:
        """(i, o), made by Spark; a few bytes an entry and at most 2^18 entries, so it may be sent to all tasks."""
        return spark.range(self.entries).selectExpr("CAST(id AS INT) AS i", f"{self.entry.replace('@', 'CAST(id AS DOUBLE)')} AS o")


def through(px: DataFrame, curve: Curve, channels: list[str]) -> DataFrame:
    """``px`` with the channels looked up: each value's entry is the nearest one, those beyond the ends take the last."""
    table = F.broadcast(curve.table(px.sparkSession))
    for c in channels:
        index = F.greatest(F.lit(0), F.least(F.lit(curve.entries - 1), F.round(F.col(c) * curve.scale))).cast("int")
        met = px.withColumn("_i", index).join(table.select(F.col("i").alias("_i"), F.col("o").alias("_o")), "_i")
        px = met.withColumn(c, F.col("_o")).drop("_i", "_o").select(*px.columns)
    return px


def linear_curves(format: Format, transfer: str) -> tuple[Curve, Curve]:
    """From samples to linear light, and from light in 65535 (262143 for 16 bits) steps back to samples, both in single precision."""
    most, back = (1 << format.depth) - 1, BACK_ENTRIES[format.sample]
    there = Curve(f"CAST(CAST({decode(transfer, most)} AS FLOAT) AS DOUBLE)", most + 1)
    light = f"CAST(CAST(@ / {back - 1}e0 AS FLOAT) AS DOUBLE)"
    return there, Curve(store(most).replace("@", encode(transfer).replace("@", light)), back, back - 1)


@dataclass(frozen=True)
class SpacePlan:
    """A plan inside the space; the stages there and back of the colour channels; alpha's expressions, first stage and last.

    curves: of linear light, whose stages are tables.
    """

    plan: Plan
    there: tuple[tuple[str, ...], ...]
    back: tuple[tuple[str, ...], ...]
    alpha: tuple[str, str]
    curves: tuple[Curve, Curve] | None = None


def plan_in(space: str, src: tuple[int, int], dst: tuple[int, int], which, format: Format = Format("u8", "rgb"), transfer: str = "srgb", luminance: float = 203) -> SpacePlan:
    """linear and linear_approx: any layout of u8, or of u16 of 8 bits or more; other spaces: u8 rgb and rgba.

    ``transfer``: of TRANSFERS, the curve between stored samples and light. ``luminance``: of Jzazbz's white.
    """
    if transfer not in TRANSFERS:
        raise ResampleError(GENERIC, f"no transfer function {transfer!r}")
    colors = format.channels - (format.alpha is not None)
    if space in LINEAR:
        if format.sample not in ("u8", "u16"):
            raise ResampleError(GENERIC, f"{space} takes u8 and u16 samples")
        if format.depth < 8:
            raise ResampleError(UNSUPPORTED_BIT_DEPTH, "linear light takes a bit depth of 8 or more")
        approx = space == "linear_approx"
        there, back, alpha = linear_stages(colors, format.sample, format.depth, approx, transfer)
        inside = Format("u16", format.layout, 12 if format.sample == "u8" else 16) if approx else Format("f32", format.layout, 0)
    else:
        if format.sample != "u8" or colors != 3:
            raise ResampleError(GENERIC, f"{space} takes rgb and rgba images of u8")
        (there, back), alpha = spaces(transfer, luminance)[space], ALPHA_STAGES
        inside = Format("f32", format.layout, 0)
    curves = linear_curves(format, transfer) if space == "linear" else None
    return SpacePlan(Scaler(which, "quality").plan(src, dst, inside), there, back, alpha, curves)


def convert(px: DataFrame, steps, alpha: str) -> DataFrame:
    """Stages of expressions over the colour channels; alpha, the channel after them if there is one, changes in the last."""
    for i, stage in enumerate(steps):
        last, more = f"v{len(stage)}", []
        if last in channels_of(px):
            more = [f"{alpha.replace('@', last)} AS {last}" if i == len(steps) - 1 else last]
        px = px.selectExpr(*KEYS, *(f"{e} AS v{j}" for j, e in enumerate(stage)), *more)
    return px


def resample_in(px: DataFrame, made: SpacePlan) -> DataFrame:
    """``px`` resampled by a plan of plan_in. Equal sizes stay as they are, without conversion."""
    if not made.plan.steps:
        return px
    if made.curves is None:
        return convert(resample(convert(px, made.there, made.alpha[0]), made.plan), made.back, made.alpha[1])
    names, format = channels_of(px), made.plan.format
    colors = [c for c in names if c != f"v{format.alpha}"]

    def with_alpha(df: DataFrame, how: str) -> DataFrame:
        return df if format.alpha is None else df.withColumn(f"v{format.alpha}", F.expr(how.replace("@", f"v{format.alpha}")))

    light = with_alpha(through(px, made.curves[0], colors), made.alpha[0])
    return with_alpha(through(resample(light, made.plan), made.curves[1], colors), made.alpha[1]).select(*KEYS, *names)
