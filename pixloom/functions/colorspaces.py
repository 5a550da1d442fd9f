"""Colour spaces as stages of SQL expressions over v0, v1, v2 (and v3, alpha), for Spark and for any engine that checks it.

Published definitions: IEC 61966-2-1 (sRGB), CIE 1976 (L*a*b*, L*u*v*), Ottosson 2020 (Oklab), Safdar et al. 2017 (Jzazbz).
LCh is the polar form of L*u*v*; its hue is resampled as a plain number, as it is by convention of the scaler that has it.
"""

from __future__ import annotations

# Linear sRGB to XYZ (D65) and back; white point.
RGB_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
# Oklab.
RGB_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LMS_OK = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
OK_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
LMS_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
# Jzazbz.
XYZ_JLMS = ((0.41478972, 0.579999, 0.0146480), (-0.2015100, 1.120649, 0.0531008), (-0.0166008, 0.264800, 0.6684799))
JLMS_XYZ = ((1.9242264357876067, -1.0047923125953657, 0.037651404030618), (0.35031676209499907, 0.7264811939316552, -0.06538442294808501), (-0.09098281098284752, -0.3127282905230739, 1.5227665613052603))
LMS_IZ = ((0.5, 0.5, 0.0), (3.524000, -4.066708, 0.542708), (0.199076, 1.096799, -1.295875))
IZ_LMS = ((1.0, 0.1386050432715393, 0.05804731615611886), (1.0, -0.1386050432715393, -0.05804731615611886), (1.0, -0.09601924202631895, -0.8118918960560388))
JZ_B, JZ_G, JZ_D, JZ_D0, PQ_P, PQ_N = 1.15, 0.66, -0.56, 1.6295499532821566e-11, 134.034375, 0.1593017578125
PQ_C = (0.8359375, 18.8515625, 18.6875)

Stage = tuple[str, ...]


def _matrix(m, terms: tuple[str, str, str] = ("v0", "v1", "v2")) -> Stage:
    return tuple("(" + " + ".join(f"{k!r} * ({t})" for k, t in zip(row, terms, strict=True)) + ")" for row in m)


def _each(template: str) -> Stage:
    return tuple(template.replace("@", f"v{i}") for i in range(3))


# Transfer functions as (linear below, its slope, offset, exponent), encoded end of the linear part; or an exponent alone.
_CURVES = {"srgb": (0.0031308, 12.92, 0.055, 2.4, 0.04045), "rec709": (0.018, 4.5, 0.099, 1 / 0.45, 0.081), "smpte240": (0.0228, 4.0, 0.1115, 1 / 0.45, 0.0913)}
_GAMMAS = {"gamma22": 2.2, "gamma28": 2.8, "smpte428": 2.6, "linear": 1.0}
TRANSFERS = (*_CURVES, *_GAMMAS)


def decode(transfer: str = "srgb", most: int = 255) -> str:
    """SQL of a stored sample @ as linear light, 0 to 1."""
    v = f"(@ / {most}e0)"
    if transfer in _GAMMAS:
        return f"power({v}, {_GAMMAS[transfer]!r}e0)"
    _, slope, offset, exponent, end = _CURVES[transfer]
    return f"CASE WHEN {v} <= {end!r}e0 THEN {v} / {slope!r}e0 ELSE power(({v} + {offset!r}e0) / {1 + offset!r}e0, {exponent!r}e0) END"


def encode(transfer: str = "srgb") -> str:
    """SQL of linear light @ as an encoded number, 0 to 1."""
    if transfer in _GAMMAS:
        return f"power(greatest(@, 0e0), 1e0 / {_GAMMAS[transfer]!r}e0)"
    end, slope, offset, exponent, _ = _CURVES[transfer]
    return f"CASE WHEN @ <= {end!r}e0 THEN {slope!r}e0 * @ ELSE {1 + offset!r}e0 * power(greatest(@, 0e0), 1e0 / {exponent!r}e0) - {offset!r}e0 END"


def store(most: int = 255) -> str:
    """SQL of a number @, 0 to 1, as a stored sample."""
    return f"CAST(round({most}e0 * greatest(0e0, least(1e0, @))) AS BIGINT)"


DECODE, ENCODE, STORE = _each(decode()), _each(encode()), _each(store())

_F = "CASE WHEN @ > 216e0 / 24389e0 THEN cbrt(@) ELSE (24389e0 / 27e0 * @ + 16e0) / 116e0 END"
_F_BACK = "CASE WHEN @ > 6e0 / 29e0 THEN @ * @ * @ ELSE (116e0 * @ - 16e0) * 27e0 / 24389e0 END"
_WHITE_U, _WHITE_V = (4 * WHITE[0] / (WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]), 9 * WHITE[1] / (WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]))
_DEN = "(v0 + 15e0 * v1 + 3e0 * v2)"
_LIGHT = "(CASE WHEN v1 > 216e0 / 24389e0 THEN 116e0 * cbrt(v1) - 16e0 ELSE 24389e0 / 27e0 * v1 END)"
_LUV = (
    _LIGHT,
    f"(CASE WHEN {_DEN} = 0 THEN 0e0 ELSE 13e0 * {_LIGHT} * (4e0 * v0 / {_DEN} - {_WHITE_U!r}) END)",
    f"(CASE WHEN {_DEN} = 0 THEN 0e0 ELSE 13e0 * {_LIGHT} * (9e0 * v1 / {_DEN} - {_WHITE_V!r}) END)",
)
_Y = "(CASE WHEN v0 > 8e0 THEN power((v0 + 16e0) / 116e0, 3e0) ELSE v0 * 27e0 / 24389e0 END)"
# u' and v' first, then XYZ.
_LUV_BACK: tuple[Stage, ...] = (
    (_Y, f"(CASE WHEN v0 <= 0 THEN 0e0 ELSE v1 / (13e0 * v0) + {_WHITE_U!r} END)", f"(CASE WHEN v0 <= 0 THEN 1e0 ELSE v2 / (13e0 * v0) + {_WHITE_V!r} END)"),
    ("(v0 * 9e0 * v1 / (4e0 * greatest(v2, 1e-9)))", "v0", "(v0 * (12e0 - 3e0 * v1 - 20e0 * v2) / (4e0 * greatest(v2, 1e-9)))"),
)
_POLAR: Stage = ("v0", "sqrt(v1 * v1 + v2 * v2)", "atan2(v2, v1)")
_POLAR_BACK: Stage = ("v0", "(v1 * cos(v2))", "(v1 * sin(v2))")
_PQ = f"power(({PQ_C[0]} + {PQ_C[1]} * power(greatest(@, 0e0) / 10000e0, {PQ_N})) / (1e0 + {PQ_C[2]} * power(greatest(@, 0e0) / 10000e0, {PQ_N})), {PQ_P})"
_PQ_BACK = f"(10000e0 * power(greatest(({PQ_C[0]} - power(greatest(@, 0e0), 1e0 / {PQ_P})) / ({PQ_C[2]} * power(greatest(@, 0e0), 1e0 / {PQ_P}) - {PQ_C[1]}), 0e0), 1e0 / {PQ_N}))"
_J = f"((1e0 + {JZ_D}) * v0 / (1e0 + {JZ_D} * v0) - {JZ_D0!r})"


def _jz(luminance: float) -> tuple[tuple[Stage, ...], tuple[Stage, ...]]:
    there = (
        _matrix(RGB_XYZ),
        (f"({luminance}e0 * ({JZ_B} * v0 - {JZ_B - 1!r} * v2))", f"({luminance}e0 * ({JZ_G} * v1 - {JZ_G - 1!r} * v0))", f"({luminance}e0 * v2)"),
        _matrix(XYZ_JLMS), _each(_PQ), _matrix(LMS_IZ), (_J, "v1", "v2"),
    )
    iz = f"((v0 + {JZ_D0!r}) / (1e0 + {JZ_D} - {JZ_D} * (v0 + {JZ_D0!r})))"
    back = (
        (iz, "v1", "v2"), _matrix(IZ_LMS), _each(_PQ_BACK), _matrix(JLMS_XYZ),
        (f"((v0 + {JZ_B - 1!r} * v2) / {JZ_B} / {luminance}e0)", "v1", f"(v2 / {luminance}e0)"),
        ("v0", f"((v1 / {luminance}e0 + {JZ_G - 1!r} * v0) / {JZ_G})", "v2"),
        _matrix(XYZ_RGB),
    )
    return there, back


_XYZ = _matrix(RGB_XYZ)
_SCALED = tuple(f"(v{i} / {w!r})" for i, w in enumerate(WHITE))
_UNSCALED = tuple(f"(v{i} * {w!r})" for i, w in enumerate(WHITE))
_SIGMOID = _each("(1e0 / (1e0 + exp(-@ / 255e0)))")
_LOGIT = _each("ln(greatest(@, 1e-9) / greatest(1e0 - @, 1e-9))")


def spaces(transfer: str = "srgb", luminance: float = 203) -> dict[str, tuple[tuple[Stage, ...], tuple[Stage, ...]]]:
    """By name: the stages from stored 8-bit RGB to the space, and back. ``luminance``: of white in Jzazbz, in candela a square metre.

    sigmoidal has no published definition: it is a logistic curve over samples from 0 to 1, and its inverse.
    """
    there, back = _each(decode(transfer)), (_each(encode(transfer)), STORE)
    jz = _jz(luminance)
    return {
        "xyz": ((there, _XYZ), (_matrix(XYZ_RGB), *back)),
        "lab": (
            (there, _XYZ, _SCALED, _each(_F), ("(116e0 * v1 - 16e0)", "(500e0 * (v0 - v1))", "(200e0 * (v1 - v2))")),
            (("((v0 + 16e0) / 116e0 + v1 / 500e0)", "((v0 + 16e0) / 116e0)", "((v0 + 16e0) / 116e0 - v2 / 200e0)"), _each(_F_BACK), _UNSCALED, _matrix(XYZ_RGB), *back),
        ),
        "luv": ((there, _XYZ, _LUV), (*_LUV_BACK, _matrix(XYZ_RGB), *back)),
        "lch": ((there, _XYZ, _LUV, _POLAR), (_POLAR_BACK, *_LUV_BACK, _matrix(XYZ_RGB), *back)),
        "oklab": ((there, _matrix(RGB_LMS), _each("cbrt(@)"), _matrix(LMS_OK)), (_matrix(OK_LMS), _each("(@ * @ * @)"), _matrix(LMS_RGB), *back)),
        "jzazbz": ((there, *jz[0]), (*jz[1], *back)),
        "sigmoidal": ((_SIGMOID,), (_LOGIT, STORE)),
    }


#: Alpha is scaled without a curve.
ALPHA_STAGES = ("(@ / 255e0)", store())
SPACES = tuple(spaces())
LINEAR = ("linear", "linear_approx")


def linear_stages(colors: int, sample: str, depth: int, approx: bool, transfer: str = "srgb") -> tuple[tuple[Stage, ...], tuple[Stage, ...], tuple[str, str]]:
    """Stages for ``colors`` channels to linear light and back, and the expressions of alpha.

    As floats, or ``approx``: as integers of 12 bits for 8-bit samples and of 16 for others, to which alpha is scaled too.
    """
    most, inner = 255 if sample == "u8" else (1 << depth) - 1, 4095 if sample == "u8" else 65535
    each = lambda t: tuple(t.replace("@", f"v{i}") for i in range(colors))
    there, back = each(decode(transfer, most)), (each(encode(transfer)), each(store(most)))
    if not approx:
        return (there,), back, (f"(@ / {most}e0)", store(most))
    return (there, each(f"CAST(round({inner}e0 * @) AS BIGINT)")), (each(f"(@ / {inner}e0)"), *back), (f"CAST(round(@ / {most}e0 * {inner}e0) AS BIGINT)", f"CAST(round(@ / {inner}e0 * {most}e0) AS BIGINT)")
