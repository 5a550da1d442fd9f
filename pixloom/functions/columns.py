"""The resampling filters once more, as Spark columns of the distance: Spark makes the taps itself, for any number of sizes at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import BC, BLACKMAN, BLUR_HAASN, GAUSS_SIGMA, JINC_ZERO_3, JINC_ZERO_4, KAISER_BETA, SPLINES, Filter

Kernel = Callable[[Column], Column]
PI = 3.141592653589793
#: Points of the midpoint rule in integrals over half a period, where it converges geometrically.
_POINTS = 128


def _polynomial(x: Column, *falling: float) -> Column:
    return reduce(lambda total, c: total * x + float(c), falling[1:], F.lit(float(falling[0])))


def _pieces(x: Column, *pieces: tuple[float, Column]) -> Column:
    """The piece of the first limit that x is below; 0 from the last on."""
    out = F.when(x < pieces[0][0], pieces[0][1])
    for limit, piece in pieces[1:]:
        out = out.when(x < limit, piece)
    return out.otherwise(0.0)


def _mean(of: Kernel) -> Column:
    """The mean of a function of an angle over half a turn."""
    angles = F.transform(F.sequence(F.lit(0), F.lit(_POINTS - 1)), lambda k: (k + 0.5) * (PI / _POINTS))
    return F.aggregate(F.transform(angles, of), F.lit(0.0), lambda total, v: total + v) / _POINTS


def sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(x * PI) / (x * PI))


def jinc(x: Column) -> Column:
    z = x * PI
    return F.when(x == 0, 1.0).otherwise(2 * _mean(lambda t: F.cos(t - z * F.sin(t))) / z)


def _bc(b: float, c: float) -> Kernel:
    return lambda x: _pieces(
        x, (1, _polynomial(x, 2 - 1.5 * b - c, -3 + 2 * b + c, 0, 1 - b / 3)), (2, _polynomial(x, -b / 6 - c, b + 5 * c, -2 * b - 8 * c, 4 * b / 3 + 4 * c))
    )


def _spline(size: int) -> Kernel:
    return lambda x: _pieces(x, *((i + 1, _polynomial(x - i, *c)) for i, c in enumerate(SPLINES[size])))


def _lagrange(support: int) -> Kernel:
    """The product over all nodes but the one that x falls next to."""

    def f(x: Column) -> Column:
        node = F.floor(x + support).cast("double")
        factors = [F.when(node == i, 1.0).otherwise((node - i - x) / F.when(node == i, 1.0).otherwise(node - i)) for i in range(2 * support)]
        return F.when(x > support, 0.0).otherwise(reduce(lambda a, b: a * b, factors))

    return f


def _lanczos(a: int, base: Kernel) -> Kernel:
    return lambda x: _pieces(x, (a, base(x) * base(x / a)))


def _hanning(x: Column) -> Column:
    return F.when(x <= 1, 0.5 + 0.5 * F.cos(x * PI)).otherwise(0.0)


def _bessel_i0(x: Column) -> Column:
    return _mean(lambda t: F.exp(x * F.cos(t)))


def _sphinx(x: Column) -> Column:
    t = x * PI
    return F.when(t * t < 0.01, 1 - t**2 / 10 + t**4 / 280 - t**6 / 15120).otherwise(3 * (F.sin(t) - t * F.cos(t)) / t**3)


def _plain(name: str) -> Kernel:
    if name in BC:
        return _bc(*BC[name])
    if name.startswith("lanczos"):
        return _lanczos(int(name[7]), jinc if name.endswith("_jinc") else sinc)
    if name.startswith("spline"):
        return _spline(int(name[6:]))
    if name.startswith("lagrange"):
        return _lagrange(int(name[8:]))
    return {
        "bilinear": lambda x: _pieces(x, (1, 1 - x)),
        "cubic": lambda x: _pieces(x, (1, _polynomial(x, 0.5, -1, 0, 2 / 3)), (2, _polynomial(x, -1 / 6, 1, -2, 4 / 3))),
        "bicubic": lambda x: _pieces(x, (1, _polynomial(x, 1.5, -2.5, 0, 1)), (2, _polynomial(x, -0.5, 2.5, -4, 2))),
        "hann": lambda x: F.when(x <= 2, F.cos(x * (PI / 4)) ** 2 / 4).otherwise(0.0),
        "hamming": lambda x: _pieces(x, (1, 0.54 + 0.46 * F.cos(x * PI))),
        "hanning": _hanning,
        "blackman": lambda x: _pieces(x, (2, sinc(x) * (BLACKMAN[0] + BLACKMAN[1] * F.cos(x * (PI / 2)) + BLACKMAN[2] * F.cos(x * PI)))),
        "welch": lambda x: _pieces(x, (1, 1 - x * x)),
        "quadric": lambda x: _pieces(x, (0.5, 0.75 - x * x), (1.5, 0.5 * (x - 1.5) ** 2)),
        "gaussian": lambda x: F.exp(x * x / (-2 * GAUSS_SIGMA**2)) / ((2 * PI) ** 0.5 * GAUSS_SIGMA),
        "sphinx": _sphinx,
        "bartlett": lambda x: F.when(x <= 1, 2 * x).otherwise(2 - 2 * x),
        "kaiser": lambda x: F.when(x <= 1, _bessel_i0(KAISER_BETA * F.sqrt(F.greatest(1 - x * x, F.lit(0.0)))) / _bessel_i0(F.lit(KAISER_BETA))).otherwise(0.0),
        "bartlett_hann": lambda x: F.when(x <= 2, 0.62 - 0.12 * x + 0.38 * F.cos(x * (PI / 2))).otherwise(0.0),
        "box": lambda x: F.lit(1.0),
        "area": lambda x: F.lit(1.0),
        "bohman": lambda x: _pieces(x, (1, (1 - x) * F.cos(x * PI) + F.sin(x * PI) / PI)),
    }[name]


#: Windows of the elliptical filters: (function, span); they stretch over the radius.
_ELLIPTIC = {
    "ewa_hanning": (_hanning, 2), "ewa_ginseng": (jinc, JINC_ZERO_3), "ewa_lanczos_sharp": (jinc, JINC_ZERO_3),
    "ewa_lanczos4_sharpest": (jinc, JINC_ZERO_4), "ewa_lanczos_soft": (jinc, JINC_ZERO_3),
}


def tap(f: Filter, d: Column, narrow: Column) -> Column:
    """The weight of a sample at a distance of ``d`` source samples; ``narrow`` is the kernel's scale when shrinking."""
    x = d * narrow
    if f.ewa:
        w = jinc(x)
        if f.name in _ELLIPTIC:
            window, span = _ELLIPTIC[f.name]
            w = w * window(x / float(f.radius) * float(span))
        return F.when(x < float(f.radius), w).otherwise(0.0)
    if f.name == "ginseng":
        return F.when(d < 3, jinc(x * 3.0)).otherwise(0.0) * sinc(x)
    if f.name == "haasn_soft":
        wide = d / BLUR_HAASN
        return F.when(wide < 3, _hanning(wide * narrow * 3.0)).otherwise(0.0) * jinc(wide * narrow)
    return _plain(f.name)(x)


