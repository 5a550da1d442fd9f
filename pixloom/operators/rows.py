"""Bulk resampling of whole images held as one binary per row: Arrow batches through numpy, no shuffle.

A row's image is two passes of small matrix products along the band of its taps, which are cached in a task; nothing is exchanged. Results
equal those of the relational form to the byte for integer samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import BUFFER_MISMATCH, INVALID_STRIDE, ZERO_SIZE, ResampleError
from ..plans.plan import Format, Plan, Scaler, Step
from ..plans.weights import bands, nearest_index

#: A step from batches to batches, as mapInArrow takes it.
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

KINDS = {"u8": "<u1", "u16": "<u2", "s16": "<i2", "f32": "<f4", "f16": "<f2"}


def view(data: bytes, width: int, height: int, stride: int, format: Format) -> np.ndarray:
    """[height, width, channels] of a buffer whose rows are ``stride`` samples apart (0: no padding)."""
    kind, row = np.dtype(KINDS[format.sample]), width * format.channels
    if width <= 0 or height <= 0:
        raise ResampleError(ZERO_SIZE, "an image of no width or height")
    stride = stride or row
    if stride < row:
        raise ResampleError(INVALID_STRIDE, f"a stride of {stride} for rows of {row} samples")
    if len(data) < (stride * (height - 1) + row) * kind.itemsize:
        raise ResampleError(BUFFER_MISMATCH, f"{len(data)} bytes for {width}x{height} with a stride of {stride}")
    flat = np.frombuffer(data, kind, len(data) // kind.itemsize)
    padded = np.lib.stride_tricks.as_strided(flat, (height, row), (stride * kind.itemsize, kind.itemsize))
    return padded.reshape(height, width, format.channels)


def _narrow(total: np.ndarray, format: Format) -> np.ndarray:
    if format.floating:
        return total.astype(KINDS[format.sample]).astype(np.float64)
    low, high = format.limits
    if format.fixed_point:  # whole numbers below 2^53: the same as shifting them
        total += 1 << 14
        total *= 2.0**-15
        return np.clip(np.floor(total, out=total), low, high, out=total)
    total = np.round(total, 6)  # as the relational form does
    return np.clip(np.sign(total) * np.floor(np.abs(total) + 0.5), low, high)


def _premultiply(px: np.ndarray, format: Format) -> np.ndarray:
    # In the narrowest type that holds the products.
    px = px.astype(np.float64 if format.floating else np.uint16 if format.depth == 8 else np.int64)
    a, out = px[..., format.alpha : format.alpha + 1], px.copy()
    c = px[..., : format.alpha]
    if format.floating:
        out[..., : format.alpha] = (c * a).astype(KINDS[format.sample])
    elif format.depth == 8:
        p = c * a + 128
        out[..., : format.alpha] = (p + (p >> 8)) >> 8
    elif format.depth in (10, 12, 16):
        out[..., : format.alpha] = (c * a + format.limits[1] // 2) // format.limits[1]
    else:
        out[..., : format.alpha] = np.minimum(np.floor(c * a / format.limits[1] + 0.5), format.limits[1])
    return out


def _divide(px: np.ndarray, format: Format) -> np.ndarray:
    px = px.astype(np.float64 if format.floating else np.int64)
    a, out = px[..., format.alpha : format.alpha + 1], px.copy()
    c = px[..., : format.alpha]
    if format.floating:
        out[..., : format.alpha] = np.where(a == 0, 0, (c / np.where(a == 0, 1, a)).astype(KINDS[format.sample]))
        return out
    safe, most = np.maximum(a, 1), format.limits[1]
    if format.depth == 8:
        out[..., : format.alpha] = np.where(a == 0, 0, np.minimum(255, (c * 255 + safe // 2) // safe))
    else:
        out[..., : format.alpha] = np.where(a == 0, c, np.minimum(most, np.floor(c * most / safe + 0.5)))
    return out


def _pass(px: np.ndarray, axis: int, in_size: int, out_size: int, which: str, format: Format, single: bool, load: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """One axis (0: rows, 1: columns) of what ``load`` makes of the pixels, a band at a time.

    Float64 products of integers below 2^53 are exact, and faster than integer ones.
    """
    shape = list(px.shape)
    shape[axis] = out_size
    out = np.empty(shape, np.float64 if format.floating else KINDS[format.sample])
    for to, of, taps in bands(in_size, out_size, which, "fixed" if format.fixed_point else "single" if single else "double"):
        total = np.tensordot(taps, load(px[of]).astype(np.float64), (1, 0)) if axis == 0 else np.matmul(taps, load(px[:, of]).astype(np.float64))
        total = _narrow(total, format)
        if axis == 0:
            out[to] = total
        else:
            out[:, to] = total
    return out


def _step(px: np.ndarray, step: Step, format: Format, single: bool, load: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    if step.filter == "nearest":
        return load(px[nearest_index(step.src[1], step.dst[1])][:, nearest_index(step.src[0], step.dst[0])])
    if step.vertical:
        px, load = _pass(px, 0, step.src[1], step.dst[1], step.filter, format, single, load), _as_is
    if step.horizontal:
        px = _pass(px, 1, step.src[0], step.dst[0], step.filter, format, single, load)
    return px


def _as_is(px: np.ndarray) -> np.ndarray:
    return px


def apply(px: np.ndarray, plan: Plan) -> np.ndarray:
    """One image, [height, width, channels], through a plan."""
    if not plan.steps:
        return px
    format = plan.format
    for step in plan.steps:
        varies = step.premultiply == "always" or (step.premultiply == "varying" and np.ptp(px[..., format.alpha]) != 0)
        # Colours are multiplied a band at a time, so that no wide copy of an image is made.
        load = (lambda part: _premultiply(part, format)) if varies else _as_is
        px = _step(px, step, format, plan.single, load)
        if step.divide == "always" or (step.divide == "varying" and varies):
            px = _divide(px, format)
    return px.astype(KINDS[format.sample])


#: EXIF orientations as turns of [height, width, channels].
TURNS: dict[int, Callable[[np.ndarray], np.ndarray]] = {
    2: lambda px: px[:, ::-1], 3: lambda px: px[::-1, ::-1], 4: lambda px: px[::-1], 5: lambda px: px.transpose(1, 0, 2),
    6: lambda px: np.rot90(px, -1), 7: lambda px: px.transpose(1, 0, 2)[::-1, ::-1], 8: np.rot90,
}


def turned(px: np.ndarray, orientation: int | None) -> np.ndarray:
    """One image upright; unknown orientations leave it as it is."""
    return TURNS.get(orientation, _as_is)(px)


#: Images, and bytes of results, that a task holds before it gives them out.
FEW, _HELD = 1024, 64 << 20


def resample_images(images: DataFrame, scaler: Scaler, target: tuple[int, int], layout: str, premultiply: bool = False) -> DataFrame:
    """``images`` (image_id, width, height, sample, bit_depth, stride, data; other columns pass through) resized to ``target``.

    Rows with null data, width or height keep null data. Sizes and formats may differ from row to row; what a plan
    needs is cached. A bad buffer, stride or depth raises with its code. Repeated rows are each done; an empty table stays one.
    """
    return _resized(images, layout, lambda size, format: scaler.plan(size, target, format, premultiply))


def resample_by(images: DataFrame, scaler: Scaler, size_of: Callable[[int, int], tuple[int, int]], layout: str, premultiply: bool = False) -> DataFrame:
    """As resample_images, to a size that depends on each image's own."""
    return _resized(images, layout, lambda size, format: scaler.plan(size, size_of(*size), format, premultiply))


def run_plan(images: DataFrame, plan: Plan) -> DataFrame:
    """``images``, all of the plan's source size and format, through it; null data stays null."""
    return images.mapInArrow(planned(images.columns, plan), images.schema)


def planned(columns: list[str], plan: Plan) -> Batches:
    """What run_plan does to batches of ``columns``."""

    def kind(format: Format) -> tuple:
        return format.sample, 0 if format.floating else format.depth

    def same(size: tuple[int, int], format: Format) -> Plan:
        if size != plan.src or kind(format) != kind(plan.format):
            raise ResampleError(BUFFER_MISMATCH, f"an image of {size} and {format} in a plan for {plan.src} and {plan.format}")
        return plan

    return _resizing(columns, plan.format.layout, same)


def _resized(images: DataFrame, layout: str, plan_of: Callable[[tuple[int, int], Format], Plan]) -> DataFrame:
    return images.mapInArrow(_resizing(images.columns, layout, plan_of), images.schema)


def _resizing(columns: list[str], layout: str, plan_of: Callable[[tuple[int, int], Format], Plan]) -> Batches:
    at = {c: columns.index(c) for c in ("width", "height", "sample", "bit_depth", "stride", "data")}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[tuple, Plan] = {}

        def one(batch: pa.RecordBatch, r: int) -> tuple[int | None, int | None, bytes | None]:
            w, h, sample, depth, stride, raw = (batch.column(i)[r] for i in at.values())
            size = (w.as_py(), h.as_py())
            if not raw.is_valid or None in size:
                return (*size, None)
            format = Format(sample.as_py() or "u8", layout, depth.as_py() or 0)
            px = view(raw.as_buffer(), *size, stride.as_py() or 0, format)
            if (size, format) not in plans:
                plans[size, format] = plan_of(size, format)
            plan = plans[size, format]
            return (*plan.dst, np.ascontiguousarray(apply(px, plan)).tobytes())

        for batch in batches:
            made, lo, held = [], 0, 0
            for r in range(batch.num_rows):
                made.append(one(batch, r))
                held += len(made[-1][2] or b"")
                if held >= _HELD or len(made) == FEW or r == batch.num_rows - 1:
                    columns = list(batch.slice(lo, len(made)).columns)
                    for name, values in (*zip(("width", "height", "data"), zip(*made, strict=True), strict=True), ("stride", [0] * len(made))):
                        columns[at[name]] = pa.array(values, batch.schema.field(at[name]).type)
                    yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
                    made, lo, held = [], r + 1, 0

    return each
