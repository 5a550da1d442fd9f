"""Plans: sizes, format and configuration become a chain of steps; the same plan runs relationally or on whole rows."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil, log2
from typing import TYPE_CHECKING

from ..errors import DESTINATION_TOO_LARGE, GENERIC, UNSUPPORTED_BIT_DEPTH, ZERO_SIZE, ResampleError
from ..functions.kernels import find_filter

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

#: Channels of each layout, and which one is alpha.
LAYOUTS = {"planar": 1, "cbcr": 2, "gray_alpha": 2, "rgb": 3, "rgba": 4}
ALPHA = {"gray_alpha": 1, "rgba": 3}
#: Layouts that each sample type comes in.
SAMPLES = {"u8": tuple(LAYOUTS), "u16": tuple(LAYOUTS), "s16": ("planar",), "f32": tuple(LAYOUTS), "f16": ("planar", "cbcr", "rgb", "rgba")}
#: Depths up to this use fixed-point taps, deeper ones floating point.
FIXED_DEPTH = 12


def half_up(x: float) -> int:
    return int(x + 0.5)


@dataclass(frozen=True)
class Format:
    sample: str = "u8"
    layout: str = "planar"
    bit_depth: int = 8

    def __post_init__(self):
        if self.sample not in SAMPLES or self.layout not in SAMPLES[self.sample]:
            raise ResampleError(13, f"no {self.layout} images of {self.sample}")

    @property
    def channels(self) -> int:
        return LAYOUTS[self.layout]

    @property
    def alpha(self) -> int | None:
        return ALPHA.get(self.layout)

    @property
    def floating(self) -> bool:
        return self.sample in ("f32", "f16")

    @property
    def depth(self) -> int:
        return 8 if self.sample == "u8" else self.bit_depth

    @property
    def fixed_point(self) -> bool:
        return not self.floating and self.depth <= FIXED_DEPTH

    @property
    def limits(self) -> tuple[int, int]:
        half = 1 << (self.depth - 1)
        return (-half, half - 1) if self.sample == "s16" else (0, 2 * half - 1)

    def checked(self) -> Format:
        if self.sample in ("u16", "s16") and not 1 <= self.bit_depth <= 16:
            raise ResampleError(UNSUPPORTED_BIT_DEPTH, f"a bit depth of {self.bit_depth}; 1 to 16 are supported")
        return self


@dataclass(frozen=True)
class Step:
    """One pass over both axes; an axis of equal sizes is left out. premultiply: before it; divide: after it."""

    src: tuple[int, int]
    dst: tuple[int, int]
    filter: str
    premultiply: str = "no"  # no, always, or varying (if alpha isn't constant in the image)
    divide: str = "no"

    @property
    def vertical(self) -> bool:
        return self.src[1] != self.dst[1]

    @property
    def horizontal(self) -> bool:
        return self.src[0] != self.dst[0]


@dataclass(frozen=True)
class Plan:
    src: tuple[int, int]
    dst: tuple[int, int]
    format: Format
    steps: tuple[Step, ...]
    #: Whether floating-point taps are kept in single precision.
    single: bool = False

    @property
    def source_size(self) -> tuple[int, int]:
        return self.src

    @property
    def target_size(self) -> tuple[int, int]:
        return self.dst

    def resize(self, images: DataFrame) -> DataFrame:
        """Image rows through this plan; an image of another size or depth raises."""
        from ..operators.rows import run_plan

        return run_plan(images, self)


@dataclass(frozen=True)
class Scaler:
    """Configuration; setters give a changed copy. Threading is Spark's: partitions and cores.

    quality: "speed" keeps the taps of f32 images in single precision, "quality" in double. Integer samples always use
    double ones (up to 12 bits then quantised), f16 ones single.
    """

    filter: str | int | None = None
    quality: str = "speed"
    multi_step: bool = False
    supersampling: bool = False

    def set_multi_step_upsampling(self, on: bool) -> Scaler:
        return replace(self, multi_step=on)

    def set_supersampling(self, on: bool) -> Scaler:
        return replace(self, supersampling=on)

    def set_workload_strategy(self, quality: str) -> Scaler:
        if quality not in ("speed", "quality"):
            raise ResampleError(GENERIC, f"no workload strategy {quality!r}")
        return replace(self, quality=quality)

    def plan(self, src: tuple[int, int], dst: tuple[int, int], format: Format = Format(), premultiply: bool = False) -> Plan:
        made = build(src, dst, format, self.filter, self.multi_step, self.supersampling, premultiply)
        return replace(made, single=format.sample == "f16" or (format.sample == "f32" and self.quality == "speed"))


def intermediate_sizes(src: tuple[int, int], dst: tuple[int, int], which) -> list[tuple[int, int]]:
    """Sizes between two for growing in steps that a filter's radius suits (1.5 to 4 times), evenly in logarithms."""
    most = min(4.0, max(1.5, find_filter(which).radius))
    steps = max(ceil(log2(d / s) / log2(most)) if d > s else 0 for s, d in zip(src, dst, strict=True))
    out: list[tuple[int, int]] = []
    for i in range(1, steps):
        side = tuple(min(d, max(s, half_up(s * (d / s) ** (i / steps)))) if d > s else d for s, d in zip(src, dst, strict=True))
        if not out or out[-1] != side:
            out.append(side)
    return out


def prefilter(src: tuple[int, int], dst: tuple[int, int]) -> tuple[str, tuple[int, int]] | None:
    """A cheap filter and the size near twice the target to shrink to first, when much is to be shrunk."""
    ratio = max(s / d for s, d in zip(src, dst, strict=True))
    if ratio < 3:
        return None
    between = tuple(max(d, min(2 * d, s)) for s, d in zip(src, dst, strict=True))
    return ("nearest" if ratio >= 4 else "box", between) if between[0] < src[0] or between[1] < src[1] else None


def build(src, dst, format: Format = Format(), which=None, multi_step=False, supersampling=False, premultiply=False) -> Plan:
    """The steps from ``src`` to ``dst`` (width, height). Equal sizes need none, and then no bit depth either."""
    name = find_filter(which).name
    if min(*src, *dst) <= 0:
        raise ResampleError(ZERO_SIZE, "an image of no width or height")
    if dst[0] * dst[1] * format.channels * 4 >= 1 << 63:
        raise ResampleError(DESTINATION_TOO_LARGE, "the target is too large")
    src, dst = tuple(src), tuple(dst)
    if src == dst:
        return Plan(src, dst, format, ())
    format.checked()
    blend = premultiply and format.alpha is not None
    if name == "nearest":
        return Plan(src, dst, format, (Step(src, dst, name),))
    grows, shrinks = dst[0] >= src[0] and dst[1] >= src[1], dst[0] <= src[0] and dst[1] <= src[1]
    if multi_step and grows and (between := intermediate_sizes(src, dst, name)):
        chain = [src, *between, dst]
        steps = [Step(a, b, name) for a, b in zip(chain[:-1], chain[1:], strict=True) if a != b]
        if blend:  # associated before the first step, dissociated after the last
            steps[0] = replace(steps[0], premultiply="always")
            steps[-1] = replace(steps[-1], divide="always")
        return Plan(src, dst, format, tuple(steps))
    if supersampling and shrinks and (first := prefilter(src, dst)):
        cheap, between = first
        steps = [Step(src, between, cheap), Step(between, dst, name)]
        if blend and cheap == "nearest":
            steps[1] = replace(steps[1], premultiply="varying", divide="varying")
        elif blend:
            steps = [replace(steps[0], premultiply="always"), replace(steps[1], divide="always")]
        return Plan(src, dst, format, tuple(s for s in steps if s.src != s.dst))
    kind = "varying" if blend else "no"
    return Plan(src, dst, format, (Step(src, dst, name, kind, kind),))
