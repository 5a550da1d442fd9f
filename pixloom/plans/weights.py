"""Tap weights of one axis: which source samples make up an output sample, and how much of each."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ..errors import DESTINATION_TOO_LARGE, ZERO_SIZE, ResampleError
from ..functions.kernels import Filter, find_filter

#: Fixed point: 15 fractional bits in a signed 16-bit tap, so a tap is at most 32767.
PRECISION, LEAST_TAP, MOST_TAP = 15, -32768, 32767


@dataclass(frozen=True)
class Weights:
    """start, size: each output's first source index and number of taps; taps, fixed: [out, widest], zero beyond size."""

    start: np.ndarray
    size: np.ndarray
    taps: np.ndarray
    fixed: np.ndarray

    def rows(self) -> list[tuple[int, int, int, float, int]]:
        """(out_idx, in_idx, tap, w, wq) of every tap."""
        return [
            (o, int(self.start[o]) + t, t, float(self.taps[o, t]), int(self.fixed[o, t]))
            for o in range(len(self.start))
            for t in range(int(self.size[o]))
        ]

    def bands(self, kind: str, outputs: int = 64) -> list[tuple[slice, slice, np.ndarray]]:
        """(outputs, inputs, [outputs, inputs] of taps) of some outputs in a row each: the taps lie along a diagonal, so
        small dense products do what one large one would. ``kind``: fixed, single or double."""
        source = {"fixed": self.fixed, "single": self.taps.astype(np.float32), "double": self.taps}[kind].astype(np.float64)
        out = []
        for lo in range(0, len(self.start), outputs):
            hi = min(lo + outputs, len(self.start))
            a, b = int(self.start[lo:hi].min()), int((self.start + self.size)[lo:hi].max())
            m = np.zeros((hi - lo, b - a))
            row, tap = np.nonzero(np.arange(source.shape[1]) < self.size[lo:hi, None])
            m[row, self.start[lo:hi][row] - a + tap] = source[lo:hi][row, tap]
            out.append((slice(lo, hi), slice(a, b), m))
        return out


def _distances(f: Filter, in_size: int, out_size: int):
    scale = in_size / out_size
    wide = 1.0 if f.fixed else max(scale, 1.0)
    # Halves go up here, as in every rounding of sizes.
    base = int(np.floor(2 * f.radius * wide + 0.5))
    centre = np.minimum((np.arange(out_size) + 0.5) * scale, in_size)
    start = np.maximum(np.floor(centre - base / 2), 0).astype(np.int64)
    end = np.minimum(np.minimum(np.ceil(centre + base / 2), start + base), in_size).astype(np.int64)
    place = start[:, None] + np.arange(max(base, 1))
    return start, end - start, np.abs(place - (centre - 0.5)[:, None]), place < end[:, None], 1 / wide


def _raw(f: Filter, in_size: int, out_size: int):
    start, size, x, valid, narrow = _distances(f, in_size, out_size)
    if f.ewa:
        r = x * narrow
        w = f.kernel(r) if f.window is None else f.kernel(r) * f.window[0](r / f.radius * f.window[1])
        w = np.where(r < f.radius, w, 0.0)
    elif f.window is not None:
        window, span, blur = f.window
        x = x / blur if blur > 0 else x
        w = np.where(x < span, window(x * narrow * span), 0.0) * f.kernel(x * narrow)
    else:
        w = f.kernel(x * narrow)
    return start, size, np.where(valid, w, 0.0)


def _area_up(in_size: int, out_size: int):
    scale = in_size / out_size
    i = np.arange(out_size)
    sx = np.floor(i * scale)
    fx = i + 1 - (sx + 1) / scale
    d = np.where(fx <= 0, 0.0, fx - np.floor(fx))
    size = np.minimum(sx + 2, in_size) - sx
    return sx.astype(np.int64), size.astype(np.int64), np.stack([1 - d, np.where(size > 1, d, 0.0)], 1)


def quantise(taps: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Taps in fixed point that add up to 2^15: what rounding (half away from zero) leaves over goes to the largest taps first,
    to each as much as it has room for. Of taps of equal size the earliest comes first.
    """
    q = np.clip(np.sign(taps) * np.floor(np.abs(taps) * (1 << PRECISION) + 0.5), LEAST_TAP, MOST_TAP).astype(np.int64)
    used = np.arange(q.shape[1]) < np.asarray(size)[:, None]
    q = np.where(used, q, 0)
    left = (1 << PRECISION) - q.sum(1, keepdims=True)
    order = np.argsort(np.where(used, -np.abs(q), 1), axis=1, kind="stable")
    sorted_q = np.take_along_axis(q, order, 1)
    room = np.where(left > 0, MOST_TAP - sorted_q, sorted_q - LEAST_TAP) * np.take_along_axis(used, order, 1)
    before = np.cumsum(room, axis=1) - room
    change = np.sign(left) * np.clip(np.abs(left) - before, 0, room)
    np.put_along_axis(q, order, sorted_q + change, 1)
    return q


@lru_cache(4096)
def weights(in_size: int, out_size: int, which: str) -> Weights:
    """The taps of a filter between two sizes. Windows are cut at the edges and normalised again."""
    if in_size <= 0 or out_size <= 0:
        raise ResampleError(ZERO_SIZE, "an image of no width or height")
    if max(in_size, out_size) >= 1 << 31:
        raise ResampleError(DESTINATION_TOO_LARGE, "a side of over 2^31 samples")
    f = find_filter(which)
    start, size, w = _area_up(in_size, out_size) if f.area and out_size > in_size else _raw(f, in_size, out_size)
    total = w.sum(1, keepdims=True)
    taps = np.where(total != 0, w * (1 / np.where(total == 0, 1, total)), 0.0)
    return Weights(start, size, taps, quantise(taps, size))


@lru_cache(1024)
def bands(in_size: int, out_size: int, which: str, kind: str) -> list[tuple[slice, slice, np.ndarray]]:
    return weights(in_size, out_size, which).bands(kind)


def nearest_index(in_size: int, out_size: int) -> np.ndarray:
    """The source sample of each output, in 32-bit fixed point."""
    k = (in_size << 32) // out_size
    return np.array([min((i * k + k // 2) >> 32, in_size - 1) for i in range(out_size)], np.int64)
