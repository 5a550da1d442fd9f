"""Passes whose taps are all equal as running sums: an output is two of them and a remainder, however many samples it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import GENERIC, ResampleError
from ..functions.kernels import find_filter
from ..plans.plan import Format
from ..plans.weights import weights
from .relational import KEYS, _small, by_image, channels_of, narrow


def interval_rows(in_size: int, out_size: int, which: str, fixed: bool) -> list[tuple[int, int, float, float]]:
    """(in_idx, out_idx, of_sum, of_sample): what an output takes of the running sum up to a sample, and of the sample itself.

    Its taps from start to end are all ``even`` but for the first, to which quantising gives what it leaves over.
    """
    made = weights(in_size, out_size, which)
    taps = made.fixed if fixed else made.taps
    out = []
    for o, (start, size) in enumerate(zip(made.start.tolist(), made.size.tolist(), strict=True)):
        even = taps[o, size - 1].item()
        if not (taps[o, 1:size] == even).all():
            raise ResampleError(GENERIC, f"the taps of {which} are not all equal")
        out.append((start + size - 1, o, even, 0 * even))
        if start:
            out.append((start - 1, o, -even, 0 * even))
        out.append((start, o, 0 * even, taps[o, 0].item() - even))
    return out


def interval_pass(px: DataFrame, axis: str, in_size: int, out_size: int, which: str = "box", format: Format = Format()) -> DataFrame:
    """One axis of box, or of area when it shrinks, for integer samples: what axis_pass gives, with three rows for an output and not one for each tap.

    Running sums go along each line, which is dealt with its image already.
    """
    if format.floating or not (find_filter(which).name == "box" or (find_filter(which).area and out_size < in_size)):
        raise ResampleError(GENERIC, "intervals take box, or area that shrinks, and integer samples")
    names, other = channels_of(px), "y" if axis == "x" else "x"
    rows = interval_rows(in_size, out_size, which, format.fixed_point)
    kind = "long" if format.fixed_point else "double"
    table = _small(px.sparkSession.createDataFrame(rows, f"in_idx int, out_idx int, of_sum {kind}, of_sample {kind}"), len(rows))
    line = Window.partitionBy("image_id", other).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    summed = px.select(*KEYS, *names, *(F.sum(c).over(line).alias(f"s_{c}") for c in names))
    met = summed.join(table, summed[axis] == table["in_idx"])
    total = lambda c: F.sum(F.col(f"s_{c}") * F.col("of_sum") + F.col(c) * F.col("of_sample")).alias(c)
    out = met.groupBy("image_id", other, F.col("out_idx").alias(axis)).agg(*map(total, names))
    return out.select(*KEYS, *(narrow(F.col(c), format).alias(c) for c in names))


def shrink(px: DataFrame, src: tuple[int, int], dst: tuple[int, int], which: str = "box", format: Format = Format()) -> DataFrame:
    """Both axes, vertical first; an axis of equal sizes is left out."""
    px = by_image(px)
    for axis, i in (("y", 1), ("x", 0)):
        if src[i] != dst[i]:
            px = interval_pass(px, axis, src[i], dst[i], which, format)
    return px
