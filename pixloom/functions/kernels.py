"""The 53 resampling filters: kernels as numpy functions of the distance from the centre.

Names map to (identifier, kernel, radius, options). Kernels take |x| in source pixels, already scaled when shrinking.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..errors import UNKNOWN_FILTER, ResampleError

Kernel = Callable[[np.ndarray], np.ndarray]

# Fixed values of the filters.
GAUSS_SIGMA, KAISER_BETA = 0.35, 6.33
BLACKMAN = (0.4265907, 0.49656062, 0.07684867)
JINC_ZERO_3, JINC_ZERO_4 = 3.2383154841662362, 4.2410628637960699
BLUR_SHARP, BLUR_SHARPEST, BLUR_SOFT, BLUR_HAASN = 0.9812505837223707, 0.8845120932605005, 1.0164667662867047, 1.11
BC = {
    "mitchell_netravalli": (1 / 3, 1 / 3), "catmull_rom": (0.0, 0.5), "hermite": (0.0, 0.0), "b_spline": (1.0, 0.0),
    "robidoux": (12 / (19 + 9 * 2**0.5), 113 / (58 + 216 * 2**0.5)), "robidoux_sharp": (6 / (13 + 7 * 2**0.5), 7 / (2 + 12 * 2**0.5)),
}
#: Coefficients of each unit interval, from the cubic down, in the distance from its start.
SPLINES = {
    16: ((1, -9 / 5, -1 / 5, 1), (-1 / 3, 4 / 5, -7 / 15, 0)),
    36: ((13 / 11, -453 / 209, -3 / 209, 1), (-6 / 11, 270 / 209, -156 / 209, 0), (1 / 11, -45 / 209, 26 / 209, 0)),
    64: ((49 / 41, -6387 / 2911, -3 / 2911, 1), (-24 / 41, 4032 / 2911, -2328 / 2911, 0), (6 / 41, -1008 / 2911, 582 / 2911, 0), (-1 / 41, 168 / 2911, -97 / 2911, 0)),
}


def bessel_j1(x: np.ndarray) -> np.ndarray:
    """J1 from its integral; the midpoint rule converges geometrically on a periodic integrand."""
    x = np.asarray(x, float)
    t = np.pi * (np.arange(256) + 0.5) / 256
    return np.cos(t - x[..., None] * np.sin(t)).mean(-1)


def sinc(x: np.ndarray) -> np.ndarray:
    return np.sinc(x)


def jinc(x: np.ndarray) -> np.ndarray:
    """2 J1(pi x) / (pi x), 1 at 0."""
    z = np.pi * np.asarray(x, float)
    return np.where(z == 0, 1.0, 2 * bessel_j1(z) / np.where(z == 0, 1, z))


def _within(limit: float, f: Kernel) -> Kernel:
    return lambda x: np.where(x < limit, f(x), 0.0)


def _up_to(limit: float, f: Kernel) -> Kernel:
    return lambda x: np.where(x <= limit, f(np.minimum(x, limit)), 0.0)


def _bc(b: float, c: float) -> Kernel:
    def f(x):
        near = ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + 6 - 2 * b) / 6
        far = ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + 8 * b + 24 * c) / 6
        return np.where(x < 1, near, np.where(x < 2, far, 0.0))

    return f


def _spline(size: int) -> Kernel:
    def f(x):
        out = np.zeros_like(x)
        for i, coefficients in enumerate(SPLINES[size]):
            out = np.where((x >= i) & (x < i + 1), np.polyval(coefficients, x - i), out)
        return out

    return f


def _lagrange(support: int) -> Kernel:
    def f(x):
        n = np.floor(support + x)
        out = np.ones_like(x)
        for i in range(2 * support):
            out = np.where(n == i, out, out * (n - i - x) / np.where(n == i, 1, n - i))
        return np.where(x > support, 0.0, out)

    return f


def _cubic(x):
    return np.where(x < 1, (x * x * (3 * x - 6) + 4) / 6, np.where(x < 2, (x * (x * (6 - x) - 12) + 8) / 6, 0.0))


def _keys(x):
    return np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))


def _sphinx(x):
    t = np.pi * x
    safe = np.where(t * t < 0.01, 1, t)
    return np.where(t * t < 0.01, 1 - t**2 / 10 + t**4 / 280 - t**6 / 15120, 3 * (np.sin(safe) - safe * np.cos(safe)) / safe**3)


def _blackman(x):
    d = x / 2
    return sinc(x) * (BLACKMAN[0] + BLACKMAN[1] * np.cos(np.pi * d) + BLACKMAN[2] * np.cos(2 * np.pi * d))


def _gauss(x):
    return np.exp(-(x * x) / (2 * GAUSS_SIGMA**2)) / (np.sqrt(2 * np.pi) * GAUSS_SIGMA)


def _lanczos(a: int, base: Kernel) -> Kernel:
    return _within(a, lambda x: base(x) * base(x / a))


_hanning = _up_to(1, lambda x: 0.5 + 0.5 * np.cos(np.pi * x))


@dataclass(frozen=True)
class Filter:
    """window: (function, size, blur). ewa: weights are jinc * window, the kernel is not used. fixed: never widened."""

    name: str
    number: int
    kernel: Kernel
    radius: float
    window: tuple[Kernel, float, float] | None = None
    ewa: bool = False
    fixed: bool = False
    area: bool = False


def _filters() -> list[Filter]:
    one = np.ones_like
    plain: list[tuple[str, int, Kernel, float]] = [
        ("bilinear", 0, _within(1, lambda x: 1 - x), 1),
        ("nearest", 1, _within(1, lambda x: 1 - x), 1),
        ("cubic", 2, _cubic, 2),
        ("mitchell_netravalli", 3, _bc(*BC["mitchell_netravalli"]), 2),
        ("catmull_rom", 4, _bc(*BC["catmull_rom"]), 2),
        ("hermite", 5, _bc(*BC["hermite"]), 2),
        ("b_spline", 6, _bc(*BC["b_spline"]), 2),
        ("hann", 7, _up_to(2, lambda x: np.cos(np.pi * x / 4) ** 2 / 4), 3),
        ("bicubic", 8, _keys, 2),
        ("hamming", 9, _within(1, lambda x: 0.54 + 0.46 * np.cos(np.pi * x)), 1),
        ("hanning", 10, _hanning, 2),
        ("blackman", 11, _within(2, _blackman), 2),
        ("welch", 12, _within(1, lambda x: 1 - x * x), 2),
        ("quadric", 13, lambda x: np.where(x < 0.5, 0.75 - x * x, np.where(x < 1.5, 0.5 * (x - 1.5) ** 2, 0.0)), 2),
        ("gaussian", 14, _gauss, 2),
        ("sphinx", 15, _sphinx, 2),
        ("bartlett", 16, lambda x: np.where(x <= 1, 2 * x, 2 - 2 * x), 1),
        ("robidoux", 17, _bc(*BC["robidoux"]), 2),
        ("robidoux_sharp", 18, _bc(*BC["robidoux_sharp"]), 2),
        ("kaiser", 22, _up_to(1, lambda x: np.i0(KAISER_BETA * np.sqrt(1 - x * x)) / np.i0(KAISER_BETA)), 2),
        ("bartlett_hann", 23, _up_to(2, lambda x: 0.62 - 0.12 * x + 0.38 * np.cos(np.pi * x / 2)), 2),
        ("box", 24, one, 2),
        ("bohman", 25, _within(1, lambda x: (1 - x) * np.cos(np.pi * x) + np.sin(np.pi * x) / np.pi), 2),
        ("lagrange2", 44, _lagrange(2), 2),
        ("lagrange3", 45, _lagrange(3), 3),
    ]
    out = [Filter(n, i, k, r) for n, i, k, r in plain]
    out += [Filter(f"spline{s}", i, _spline(s), r, fixed=True) for s, i, r in ((16, 19, 2), (36, 20, 4), (64, 21, 6))]
    out += [Filter(f"lanczos{a}", i, _lanczos(a, sinc), a) for a, i in ((2, 26), (3, 27), (4, 28), (5, 49), (6, 46))]
    out += [Filter(f"lanczos{a}_jinc", i, _lanczos(a, jinc), a) for a, i in ((2, 29), (3, 30), (4, 31), (5, 50), (6, 47))]
    unwindowed = (("ewa_robidoux", 33), ("ewa_blackman", 34), ("ewa_quadric", 35), ("ewa_robidoux_sharp", 36), ("ewa_catmull_rom", 51), ("ewa_mitchell_netravalli", 52))
    out += [Filter(n, i, jinc, 2, ewa=True) for n, i in unwindowed]
    out += [
        Filter("ewa_hanning", 32, jinc, 1, (_hanning, 2, 0), ewa=True),
        Filter("ewa_lanczos3", 37, jinc, 3, ewa=True),
        Filter("ginseng", 38, sinc, 3, (jinc, 3, 1)),
        Filter("ewa_ginseng", 39, jinc, 3, (jinc, JINC_ZERO_3, 1), ewa=True),
        Filter("ewa_lanczos_sharp", 40, jinc, 3, (jinc, JINC_ZERO_3, BLUR_SHARP), ewa=True),
        Filter("ewa_lanczos4_sharpest", 41, jinc, 4, (jinc, JINC_ZERO_4, BLUR_SHARPEST), ewa=True),
        Filter("ewa_lanczos_soft", 42, jinc, 3, (jinc, JINC_ZERO_3, BLUR_SOFT), ewa=True),
        Filter("haasn_soft", 43, jinc, 3, (_hanning, 3, BLUR_HAASN)),
        Filter("area", 48, one, 2, area=True),
    ]
    return sorted(out, key=lambda f: f.number)


FILTERS: dict[str, Filter] = {f.name: f for f in _filters()}
#: What a number that no filter has stands for, and what is used where none is named.
FALLBACK, DEFAULT = "bilinear", "mitchell_netravalli"
#: Names that bindings use.
ALIASES = {"mitchell": "mitchell_netravalli", "catmullrom": "catmull_rom", "bspline": "b_spline", "lanczos": "lanczos3", "linear": "bilinear", "cubic_spline": "cubic"}


def find_filter(which: str | int | Filter | None) -> Filter:
    """A filter by name, number or alias; unknown numbers mean bilinear, unknown names are an error."""
    if which is None:
        return FILTERS[DEFAULT]
    if isinstance(which, Filter):
        return which
    if isinstance(which, int):
        return next((f for f in FILTERS.values() if f.number == which), FILTERS[FALLBACK])
    name = which.strip().lower().replace("-", "_").replace(" ", "_")
    name = ALIASES.get(name, name)
    if name not in FILTERS:
        raise ResampleError(UNKNOWN_FILTER, f"unknown resizing filter {which!r}")
    return FILTERS[name]
