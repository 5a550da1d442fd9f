"""The engine's semantics once more, as one SQL statement: weights, quantising and sums are computed by the other engine itself."""

from __future__ import annotations

from .functions import colorspaces as C  # matrices and white point: fixed values
from .functions.kernels import BC, BLACKMAN, BLUR_HAASN, GAUSS_SIGMA, JINC_ZERO_3, JINC_ZERO_4, KAISER_BETA, SPLINES, find_filter
from .operators.color import SpacePlan
from .plans.plan import Format, Plan, Step


def _jinc(x: str) -> str:
    """From the integral of J1, at points and in number other than the engine's."""
    z = f"(pi() * ({x}))"
    return f"(CASE WHEN ({x}) = 0 THEN 1e0 ELSE 2e0 * list_avg(list_transform(range(96), lambda k: cos(pi() * (k + 0.5e0) / 96e0 - {z} * sin(pi() * (k + 0.5e0) / 96e0)))) / {z} END)"


def _i0(x: str) -> str:
    return f"list_avg(list_transform(range(96), lambda k: exp(({x}) * cos(pi() * (k + 0.5e0) / 96e0))))"


def _sinc(x: str) -> str:
    return f"(CASE WHEN ({x}) = 0 THEN 1e0 ELSE sin(pi() * ({x})) / (pi() * ({x})) END)"


def _bc(b: float, c: float, x: str = "x") -> str:
    near = f"(({12 - 9 * b - 6 * c!r}) * {x}*{x}*{x} + ({-18 + 12 * b + 6 * c!r}) * {x}*{x} + ({6 - 2 * b!r})) / 6e0"
    far = f"(({-b - 6 * c!r}) * {x}*{x}*{x} + ({6 * b + 30 * c!r}) * {x}*{x} + ({-12 * b - 48 * c!r}) * {x} + ({8 * b + 24 * c!r})) / 6e0"
    return f"CASE WHEN {x} < 1 THEN {near} WHEN {x} < 2 THEN {far} ELSE 0e0 END"


def _spline(size: int) -> str:
    parts = []
    for i, (a, b, c, d) in enumerate(SPLINES[size]):
        t = f"(x - {i})"
        parts.append(f"WHEN x < {i + 1} THEN ((({a!r}) * {t} + ({b!r})) * {t} + ({c!r})) * {t} + ({d!r})")
    return f"CASE {' '.join(parts)} ELSE 0e0 END"


def _lagrange(s: int) -> str:
    terms = " * ".join(f"(CASE WHEN floor({s} + x) = {i} THEN 1e0 ELSE (floor({s} + x) - {i} - x) / (floor({s} + x) - {i}) END)" for i in range(2 * s))
    return f"CASE WHEN x > {s} THEN 0e0 ELSE {terms} END"


def kernel_sql(name: str) -> str:
    """The kernel as SQL of x, a column that holds the scaled distance."""
    if name in BC:
        return _bc(*BC[name])
    if name.startswith("lanczos"):
        a = int(name[7])
        base = _jinc if name.endswith("jinc") else _sinc
        return f"CASE WHEN x < {a} THEN {base('x')} * {base(f'x / {a}e0')} ELSE 0e0 END"
    if name.startswith("spline"):
        return _spline(int(name[6:]))
    if name.startswith("lagrange"):
        return _lagrange(int(name[8:]))
    hanning = "CASE WHEN x < 1 THEN 0.5e0 + 0.5e0 * cos(pi() * x) ELSE 0e0 END"
    if name.startswith("ewa"):
        radius = find_filter(name).radius
        wide = {"ewa_ginseng": JINC_ZERO_3, "ewa_lanczos_sharp": JINC_ZERO_3, "ewa_lanczos_soft": JINC_ZERO_3, "ewa_lanczos4_sharpest": JINC_ZERO_4}
        window = f" * {_jinc(f'x / {radius}e0 * {wide[name]!r}')}" if name in wide else ""
        if name == "ewa_hanning":
            window = " * (CASE WHEN 2e0 * x < 1 THEN 0.5e0 + 0.5e0 * cos(pi() * 2e0 * x) ELSE 0e0 END)"
        return f"CASE WHEN x < {radius} THEN {_jinc('x')}{window} ELSE 0e0 END"
    return {
        "bilinear": "CASE WHEN x < 1 THEN 1 - x ELSE 0e0 END",
        "cubic": "CASE WHEN x < 1 THEN (x * x * (3 * x - 6) + 4) / 6e0 WHEN x < 2 THEN (x * (x * (6 - x) - 12) + 8) / 6e0 ELSE 0e0 END",
        "bicubic": "CASE WHEN x <= 1 THEN 1.5e0 * x*x*x - 2.5e0 * x*x + 1 WHEN x < 2 THEN -0.5e0 * x*x*x + 2.5e0 * x*x - 4 * x + 2 ELSE 0e0 END",
        "hann": "CASE WHEN x <= 2 THEN cos(pi() * x / 4) * cos(pi() * x / 4) / 4 ELSE 0e0 END",
        "hamming": "CASE WHEN x < 1 THEN 0.54e0 + 0.46e0 * cos(pi() * x) ELSE 0e0 END",
        "hanning": hanning,
        "blackman": f"CASE WHEN x < 2 THEN {_sinc('x')} * ({BLACKMAN[0]}e0 + {BLACKMAN[1]}e0 * cos(pi() * x / 2) + {BLACKMAN[2]}e0 * cos(pi() * x)) ELSE 0e0 END",
        "welch": "CASE WHEN x < 1 THEN 1 - x * x ELSE 0e0 END",
        "quadric": "CASE WHEN x < 0.5e0 THEN 0.75e0 - x * x WHEN x < 1.5e0 THEN 0.5e0 * (x - 1.5e0) * (x - 1.5e0) ELSE 0e0 END",
        "gaussian": f"exp(-(x * x) / (2e0 * {GAUSS_SIGMA}e0 * {GAUSS_SIGMA}e0)) / (sqrt(2e0 * pi()) * {GAUSS_SIGMA}e0)",
        "sphinx": "CASE WHEN pi() * x * pi() * x < 0.01e0 THEN 1 - power(pi() * x, 2) / 10 + power(pi() * x, 4) / 280 - power(pi() * x, 6) / 15120 ELSE 3 * (sin(pi() * x) - pi() * x * cos(pi() * x)) / power(pi() * x, 3) END",
        "bartlett": "CASE WHEN x <= 1 THEN 2 * x ELSE 2 - 2 * x END",
        "kaiser": f"CASE WHEN x <= 1 THEN {_i0(f'{KAISER_BETA}e0 * sqrt(greatest(1 - x * x, 0e0))')} / {_i0(f'{KAISER_BETA}e0')} ELSE 0e0 END",
        "bartlett_hann": "CASE WHEN x <= 2 THEN 0.62e0 - 0.12e0 * x + 0.38e0 * cos(pi() * x / 2) ELSE 0e0 END",
        "box": "1e0",
        "area": "1e0",
        "bohman": "CASE WHEN x < 1 THEN (1 - x) * cos(pi() * x) + sin(pi() * x) / pi() ELSE 0e0 END",
        "ginseng": f"CASE WHEN d < 3 THEN {_jinc('x * 3e0')} ELSE 0e0 END * {_sinc('x')}",
        "haasn_soft": f"CASE WHEN d / {BLUR_HAASN}e0 < 3 AND x / {BLUR_HAASN}e0 * 3e0 < 1 THEN 0.5e0 + 0.5e0 * cos(pi() * x / {BLUR_HAASN}e0 * 3e0) ELSE 0e0 END * {_jinc(f'x / {BLUR_HAASN}e0')}",
    }[name]


def _stored(x: str, format: Format) -> str:
    """A number as single precision, or as half precision: rounded to a tenth binary place after its first."""
    if format.sample != "f16":
        return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
    return f"(CASE WHEN {x} = 0 THEN 0e0 ELSE round_even({x} / power(2e0, greatest(floor(log2(abs({x}))), -14e0) - 10e0), 0) * power(2e0, greatest(floor(log2(abs({x}))), -14e0) - 10e0) END)"


def _linear(names: str, matrix, terms: str) -> str:
    """A step that applies a matrix: new names from old ones."""
    cells = ", ".join(f"{row[0]!r} * {terms[0]} + {row[1]!r} * {terms[1]} + {row[2]!r} * {terms[2]} AS {n}" for n, row in zip(names.split(), matrix, strict=True))
    return f"SELECT image_id, y, x@a, {cells} FROM @from"


def _named(**cells: str) -> str:
    return f"SELECT image_id, y, x@a, {', '.join(f'{v} AS {k}' for k, v in cells.items())} FROM @from"


def _space_sql() -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """Steps from linear r, g, b to c0, c1, c2 and back. CIE 15 (L*a*b*, L*u*v*), Ottosson 2020, Safdar et al. 2017."""
    xn, yn, zn = (f"{w!r}" for w in C.WHITE)
    to_xyz, to_rgb = _linear("p q s", C.RGB_XYZ, "rgb"), _linear("r g b", C.XYZ_RGB, "pqs")  # X, Y, Z are p, q, s
    eps, kappa = "(216e0 / 24389e0)", "(24389e0 / 27e0)"
    root = lambda t: f"(CASE WHEN {t} > {eps} THEN cbrt({t}) ELSE ({kappa} * ({t}) + 16e0) / 116e0 END)"
    cube = lambda t: f"(CASE WHEN {t} > 6e0 / 29e0 THEN ({t}) * ({t}) * ({t}) ELSE (116e0 * ({t}) - 16e0) / {kappa} END)"
    lab = (to_xyz, _named(fx=root(f"p / {xn}"), fy=root(f"q / {yn}"), fz=root(f"s / {zn}")), _named(c0="116e0 * fy - 16e0", c1="500e0 * (fx - fy)", c2="200e0 * (fy - fz)"))
    lab_back = (_named(fx="(c0 + 16e0) / 116e0 + c1 / 500e0", fy="(c0 + 16e0) / 116e0", fz="(c0 + 16e0) / 116e0 - c2 / 200e0"), _named(p=f"{cube('fx')} * {xn}", q=f"{cube('fy')} * {yn}", s=f"{cube('fz')} * {zn}"), to_rgb)
    white = f"({xn} + 15e0 * {yn} + 3e0 * {zn})"
    un, vn = f"(4e0 * {xn} / {white})", f"(9e0 * {yn} / {white})"
    luv = (
        to_xyz, _named(p="p", q="q", d="p + 15e0 * q + 3e0 * s"), _named(p="p", q="q", d="d", l=f"CASE WHEN q > {eps} THEN 116e0 * cbrt(q) - 16e0 ELSE {kappa} * q END"),
        _named(c0="l", c1=f"CASE WHEN d = 0 THEN 0e0 ELSE 13e0 * l * (4e0 * p / d - {un}) END", c2=f"CASE WHEN d = 0 THEN 0e0 ELSE 13e0 * l * (9e0 * q / d - {vn}) END"),
    )
    luv_back = (
        _named(q=f"CASE WHEN c0 > 8 THEN power((c0 + 16e0) / 116e0, 3) ELSE c0 / {kappa} END", u=f"CASE WHEN c0 <= 0 THEN 0e0 ELSE c1 / (13e0 * c0) + {un} END", v=f"CASE WHEN c0 <= 0 THEN 1e0 ELSE c2 / (13e0 * c0) + {vn} END"),
        _named(p="q * 9e0 * u / (4e0 * greatest(v, 1e-9))", q="q", s="q * (12e0 - 3e0 * u - 20e0 * v) / (4e0 * greatest(v, 1e-9))"), to_rgb,
    )
    polar, cartesian = _named(c0="c0", c1="sqrt(c1 * c1 + c2 * c2)", c2="atan2(c2, c1)"), _named(c0="c0", c1="c1 * cos(c2)", c2="c1 * sin(c2)")
    oklab = (_linear("p q s", C.RGB_LMS, "rgb"), _named(p="cbrt(p)", q="cbrt(q)", s="cbrt(s)"), _linear("c0 c1 c2", C.LMS_OK, "pqs"))
    oklab_back = (_linear("p q s", C.OK_LMS, ("c0", "c1", "c2")), _named(p="p * p * p", q="q * q * q", s="s * s * s"), _linear("r g b", C.LMS_RGB, "pqs"))
    c1, c2, c3 = C.PQ_C
    pq = lambda t: f"power(({c1} + {c2} * power(greatest({t}, 0e0) / 1e4, {C.PQ_N})) / (1 + {c3} * power(greatest({t}, 0e0) / 1e4, {C.PQ_N})), {C.PQ_P})"
    qp = lambda t: f"1e4 * power(greatest(({c1} - power(greatest({t}, 0e0), 1e0 / {C.PQ_P})) / ({c3} * power(greatest({t}, 0e0), 1e0 / {C.PQ_P}) - {c2}), 0e0), 1e0 / {C.PQ_N})"
    jz = (
        to_xyz, _named(p="203e0 * p", q="203e0 * q", s="203e0 * s"), _named(p=f"{C.JZ_B} * p - ({C.JZ_B} - 1) * s", q=f"{C.JZ_G} * q - ({C.JZ_G} - 1) * p", s="s"),
        _linear("l m n", C.XYZ_JLMS, "pqs"), _named(l=pq("l"), m=pq("m"), n=pq("n")), _linear("i c1 c2", C.LMS_IZ, "lmn"),
        _named(c0=f"(1 + {C.JZ_D}) * i / (1 + {C.JZ_D} * i) - {C.JZ_D0!r}", c1="c1", c2="c2"),
    )
    jz_back = (
        _named(i=f"(c0 + {C.JZ_D0!r}) / (1 + {C.JZ_D} - {C.JZ_D} * (c0 + {C.JZ_D0!r}))", j="c1", k="c2"), _linear("l m n", C.IZ_LMS, "ijk"), _named(l=qp("l"), m=qp("m"), n=qp("n")),
        _linear("p q s", C.JLMS_XYZ, "lmn"), _named(p=f"(p + ({C.JZ_B} - 1) * s) / {C.JZ_B}", q="q", s="s"), _named(p="p / 203e0", q=f"(q + ({C.JZ_G} - 1) * p) / {C.JZ_G} / 203e0", s="s / 203e0"), to_rgb,
    )
    return {
        "xyz": ((to_xyz, _named(c0="p", c1="q", c2="s")), (_named(p="c0", q="c1", s="c2"), to_rgb)), "lab": (lab, lab_back), "luv": (luv, luv_back),
        "lch": ((*luv, polar), (cartesian, *luv_back)), "oklab": (oklab, oklab_back), "jzazbz": (jz, jz_back),
    }


_SPACE_SQL = _space_sql()


class Sql:
    """A chain of common table expressions; ``last`` is the current pixel table."""

    def __init__(self, base: str, channels: int):
        self.parts, self.channels, self.n, self.last = [f"p0 AS MATERIALIZED ({base})"], channels, 0, "p0"

    def add(self, body: str, pixels: bool = True) -> str:
        self.n += 1
        name = f"{'p' if pixels else 't'}{self.n}"
        self.parts.append(f"{name} AS MATERIALIZED ({body})")
        if pixels:
            self.last = name
        return name

    def cells(self, template: str) -> str:
        return ", ".join(f"{template.replace('@', f'v{c}')} AS v{c}" for c in range(self.channels))

    def weights(self, in_size: int, out_size: int, which: str) -> str:
        f = find_filter(which)
        if f.area and out_size > in_size:
            s = self.add(f"SELECT i, CAST(floor(i * {in_size}e0 / {out_size}e0) AS BIGINT) AS s FROM range({out_size}) AS r(i)", False)
            fx = self.add(f"SELECT i, s, i + 1 - (s + 1) / ({in_size}e0 / {out_size}e0) AS fx FROM {s}", False)
            raw = self.add(f"SELECT i, s + k AS j, k, CASE k WHEN 0 THEN 1 - d ELSE d END AS w FROM (SELECT i, s, CASE WHEN fx <= 0 THEN 0e0 ELSE fx - floor(fx) END AS d FROM {fx}) AS q, range(2) AS r(k) WHERE s + k < {in_size}", False)
        else:
            scale = f"({in_size}e0 / {out_size}e0)"
            wide = 1.0 if f.fixed else max(in_size / out_size, 1.0)
            base = int(2 * f.radius * wide + 0.5)
            c = self.add(f"SELECT i, least((i + 0.5e0) * {scale}, {in_size}e0) AS cx FROM range({out_size}) AS r(i)", False)
            b = self.add(f"SELECT i, cx, CAST(greatest(floor(cx - {base / 2}e0), 0) AS BIGINT) AS s, CAST(ceil(cx + {base / 2}e0) AS BIGINT) AS e FROM {c}", False)
            d = self.add(f"SELECT i, s + k AS j, k, abs(s + k - (cx - 0.5e0)) AS d, abs(s + k - (cx - 0.5e0)) * (1e0 / {wide!r}) AS x FROM {b}, range({max(base, 1)}) AS r(k) WHERE s + k < least(e, {in_size})", False)
            raw = self.add(f"SELECT i, j, k, {kernel_sql(f.name)} AS w FROM {d}", False)
        norm = self.add(f"SELECT i, j, k, CASE WHEN t = 0 THEN 0e0 ELSE w * (1e0 / t) END AS w FROM (SELECT *, sum(w) OVER (PARTITION BY i) AS t FROM {raw}) AS q", False)
        q = self.add(f"SELECT *, CAST(greatest(-32768, least(32767, round(w * 32768))) AS BIGINT) AS q FROM {norm}", False)
        left = self.add(f"SELECT *, 32768 - sum(q) OVER (PARTITION BY i) AS r, coalesce(sum(32767 - q) OVER z, 0) AS above, coalesce(sum(q + 32768) OVER z, 0) AS below FROM {q} WINDOW z AS (PARTITION BY i ORDER BY abs(q) DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", False)
        return self.add(f"SELECT i, j, w, CAST(q + CASE WHEN r > 0 THEN greatest(0, least(32767 - q, r - above)) WHEN r < 0 THEN least(0, greatest(-32768 - q, r + below)) ELSE 0 END AS BIGINT) AS wq FROM {left}", False)

    def weights_of(self, sizes: str, which: str) -> str:
        """The taps of a filter for each distinct (m, n) of a table: in_size m, out_size n, output i, source j, tap k, w and wq."""
        f = find_filter(which)
        wide = "1e0" if f.fixed else "greatest(m * 1e0 / n, 1e0)"
        base = self.add(f"SELECT m, n, m * 1e0 / n AS scale, {wide} AS wide, CAST(floor(2e0 * {f.radius} * {wide} + 0.5e0) AS BIGINT) AS base FROM (SELECT DISTINCT m, n FROM {sizes}) AS q WHERE m <> n", False)
        c = self.add(f"SELECT *, least((i + 0.5e0) * scale, m * 1e0) AS cx FROM (SELECT *, unnest(range(n)) AS i FROM {base}) AS q", False)
        b = self.add(f"SELECT *, CAST(greatest(floor(cx - base / 2e0), 0) AS BIGINT) AS s, CAST(ceil(cx + base / 2e0) AS BIGINT) AS e FROM {c}", False)
        t = self.add(f"SELECT *, unnest(range(least(e, s + base, m) - s)) AS k FROM {b}", False)
        d = self.add(f"SELECT m, n, i, s + k AS j, k, abs(s + k - (cx - 0.5e0)) AS d, abs(s + k - (cx - 0.5e0)) * (1e0 / wide) AS x FROM {t}", False)
        raw = self.add(f"SELECT m, n, i, j, k, {kernel_sql(f.name)} AS w FROM {d}", False)
        if f.area:
            s = self.add(f"SELECT m, n, i, CAST(floor(i * scale) AS BIGINT) AS s, i + 1 - (floor(i * scale) + 1) / scale AS fx FROM {c} WHERE n > m", False)
            grow = f"SELECT m, n, i, s + k AS j, k, CASE k WHEN 0 THEN 1 - d ELSE d END AS w FROM (SELECT *, CASE WHEN fx <= 0 THEN 0e0 ELSE fx - floor(fx) END AS d, unnest([0, 1]) AS k FROM {s}) AS q WHERE s + k < m"
            raw = self.add(f"SELECT * FROM {raw} WHERE n < m UNION ALL {grow}", False)
        norm = self.add(f"SELECT m, n, i, j, k, CASE WHEN t = 0 THEN 0e0 ELSE w * (1e0 / t) END AS w FROM (SELECT *, sum(w) OVER (PARTITION BY m, n, i) AS t FROM {raw}) AS q", False)
        q = self.add(f"SELECT *, CAST(greatest(-32768, least(32767, round(w * 32768))) AS BIGINT) AS q FROM {norm}", False)
        left = self.add(f"SELECT *, 32768 - sum(q) OVER (PARTITION BY m, n, i) AS r, coalesce(sum(32767 - q) OVER z, 0) AS above, coalesce(sum(q + 32768) OVER z, 0) AS below FROM {q} WINDOW z AS (PARTITION BY m, n, i ORDER BY abs(q) DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", False)
        same = f"SELECT m, n, i, i AS j, 0 AS k, 1e0 AS w, 32768 AS wq FROM (SELECT m, n, unnest(range(n)) AS i FROM (SELECT DISTINCT m, n FROM {sizes} WHERE m = n) AS q) AS q"
        return self.add(f"SELECT m, n, i, j, k, w, CAST(q + CASE WHEN r > 0 THEN greatest(0, least(32767 - q, r - above)) WHEN r < 0 THEN least(0, greatest(-32768 - q, r + below)) ELSE 0 END AS BIGINT) AS wq FROM {left} UNION ALL {same}", False)

    def mixed(self, width: str, height: str, which: str, format: Format) -> Sql:
        """Each image from its own size w x h to that of two expressions."""
        sizes = self.add(f"SELECT image_id, w, h, CAST({width} AS BIGINT) AS tw, CAST({height} AS BIGINT) AS th FROM (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM {self.last} GROUP BY image_id) AS q", False)
        low, high = format.limits
        total = "CAST(16384 + sum(@ * wq) AS BIGINT) >> 15" if format.fixed_point else "round(round(sum(@ * t.w), 6))"
        for axis, other, m, n in (("y", "x", "h", "th"), ("x", "y", "w", "tw")):
            taps = self.weights_of(f"(SELECT {m} AS m, {n} AS n FROM {sizes})", which)
            store = f"CAST(CASE WHEN s.{m} = s.{n} THEN max(@) ELSE greatest({low}, least({high}, {total})) END AS BIGINT)"
            self.add(f"SELECT p.image_id, p.{other}, CAST(t.i AS INT) AS {axis}, {self.cells(store)} FROM {self.last} AS p JOIN {sizes} AS s USING (image_id) JOIN {taps} AS t ON t.m = s.{m} AND t.n = s.{n} AND t.j = p.{axis} GROUP BY p.image_id, p.{other}, t.i, s.{m}, s.{n}")
        return self

    def axis(self, axis: str, in_size: int, out_size: int, which: str, format: Format, single: bool = False) -> None:
        w, other = self.weights(in_size, out_size, which), "y" if axis == "x" else "x"
        low, high = (0, 0) if format.floating else format.limits
        if format.floating:
            store = _stored(f"sum(@ * {'CAST(CAST(w AS FLOAT) AS DOUBLE)' if single else 'w'})", format)
        elif format.fixed_point:
            store = f"CAST(greatest({low}, least({high}, CAST(16384 + sum(@ * wq) AS BIGINT) >> 15)) AS BIGINT)"
        else:
            store = f"CAST(greatest({low}, least({high}, round(round(sum(@ * w), 6)))) AS BIGINT)"
        self.add(f"SELECT image_id, p.{other}, CAST(i AS INT) AS {axis}, {self.cells(store)} FROM {self.last} AS p JOIN {w} AS w ON p.{axis} = w.j GROUP BY image_id, p.{other}, i")

    def nearest(self, step: Step) -> None:
        joins = []
        for axis, i in (("x", 0), ("y", 1)):
            k = (step.src[i] << 32) // step.dst[i]
            joins.append(f"(SELECT o, (o * {k} + {k // 2}) >> 32 AS s FROM range({step.dst[i]}) AS r(o)) AS n{axis} ON p.{axis} = n{axis}.s")
        cells = ", ".join(f"v{c}" for c in range(self.channels))
        self.add(f"SELECT image_id, CAST(ny.o AS INT) AS y, CAST(nx.o AS INT) AS x, {cells} FROM {self.last} AS p JOIN {joins[0]} JOIN {joins[1]}")

    def blend(self, format: Format, back: bool, flags: str | None) -> None:
        alpha, most = f"v{format.alpha}", 1 if format.floating else format.limits[1]
        if format.floating:
            how = f"CASE WHEN {alpha} = 0 THEN 0e0 ELSE {_stored(f'(@ / nullif({alpha}, 0))', format)} END" if back else _stored(f"(@ * {alpha})", format)
        elif not back:
            how = f"((@ * {alpha}) * 2 + {most}) // {2 * most}"
        elif format.depth == 8:
            how = f"CASE WHEN {alpha} = 0 THEN 0 ELSE least(255, (@ * 255 + {alpha} // 2) // greatest({alpha}, 1)) END"
        else:
            how = f"CASE WHEN {alpha} = 0 THEN @ ELSE CAST(least({most}, round(@ * {most} / greatest({alpha}, 1))) AS BIGINT) END"
        when = "f.assoc" if flags else "true"
        cells = ", ".join(alpha if f"v{c}" == alpha else f"CASE WHEN {when} THEN {how.replace('@', f'v{c}')} ELSE v{c} END AS v{c}" for c in range(self.channels))
        join = f" JOIN {flags} AS f USING (image_id)" if flags else ""
        self.add(f"SELECT image_id, y, x, {cells} FROM {self.last}{join}")

    def resample(self, plan: Plan) -> Sql:
        for step in plan.steps:
            flags = None
            if step.premultiply == "varying":
                alpha = f"v{plan.format.alpha}"
                flags = self.add(f"SELECT image_id, min({alpha}) <> max({alpha}) AS assoc FROM {self.last} GROUP BY image_id", False)
            if step.premultiply != "no":
                self.blend(plan.format, False, flags)
            if step.filter == "nearest":
                self.nearest(step)
            else:
                if step.vertical:
                    self.axis("y", step.src[1], step.dst[1], step.filter, plan.format, plan.single)
                if step.horizontal:
                    self.axis("x", step.src[0], step.dst[0], step.filter, plan.format, plan.single)
            if step.divide != "no":
                self.blend(plan.format, True, flags)
        return self

    def convert(self, steps, alpha: str) -> Sql:
        for i, stage in enumerate(steps):
            last, more = f"v{len(stage)}", ""
            if len(stage) < self.channels:
                more = f", {alpha.replace('@', last)} AS {last}" if i == len(steps) - 1 else f", {last}"
            self.add(f"SELECT image_id, y, x, {', '.join(f'{e} AS v{j}' for j, e in enumerate(stage))}{more} FROM {self.last}")
        return self

    def resample_linear(self, plan: Plan, sample: str, depth: int) -> Sql:
        """sRGB through linear light by the tables' rounding, written from IEC 61966-2-1: the curve of the nearest of 65535 or 262143 steps."""
        most, steps = (1 << depth) - 1, 65535 if sample == "u8" else 262143
        light = f"CAST(CAST(CASE WHEN @ <= 0.04045e0 * {most} THEN @ / {most}e0 / 12.92e0 ELSE power((@ / {most}e0 + 0.055e0) / 1.055e0, 2.4e0) END AS FLOAT) AS DOUBLE)"
        index = f"CAST(CAST(greatest(0, least({steps}, round(@ * {steps}e0))) / {steps}e0 AS FLOAT) AS DOUBLE)"
        back = f"CAST(round({most}e0 * least(1e0, CASE WHEN {index} <= 0.0031308e0 THEN 12.92e0 * {index} ELSE 1.055e0 * power({index}, 1e0 / 2.4e0) - 0.055e0 END)) AS BIGINT)"
        alpha = plan.format.alpha

        def cells(color: str, other: str) -> str:
            return ", ".join(f"{(other if c == alpha else color).replace('@', f'v{c}')} AS v{c}" for c in range(self.channels))

        self.add(f"SELECT image_id, y, x, {cells(light, f'(@ / {most}e0)')} FROM {self.last}")
        self.resample(plan)
        self.add(f"SELECT image_id, y, x, {cells(back, f'CAST(round({most}e0 * greatest(0e0, least(1e0, @))) AS BIGINT)')} FROM {self.last}")
        return self

    def resample_space(self, plan: Plan, space: str) -> Sql:
        """8-bit sRGB through a colour space, written from its publication with named quantities, not from the engine's stages."""
        alpha = self.channels == 4
        carried = ", a" if alpha else ""
        light = lambda v: f"CASE WHEN {v} <= 0.04045e0 * 255 THEN {v} / 255e0 / 12.92e0 ELSE power(({v} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END"
        rgb = f"SELECT image_id, y, x, {light('v0')} AS r, {light('v1')} AS g, {light('v2')} AS b{', v3 / 255e0 AS a' if alpha else ''} FROM {self.last}"
        there, back = _SPACE_SQL[space]
        for step in (rgb, *there):
            table = self.add(step.replace("@from", self.last).replace("@a", carried), False)
            self.last = table
        self.add(f"SELECT image_id, y, x, c0 AS v0, c1 AS v1, c2 AS v2{', a AS v3' if alpha else ''} FROM {self.last}")
        self.resample(plan)
        last = self.add(f"SELECT image_id, y, x, v0 AS c0, v1 AS c1, v2 AS c2{', v3 AS a' if alpha else ''} FROM {self.last}", False)
        for step in back:
            last = self.add(step.replace("@from", last).replace("@a", carried), False)
        stored = lambda v: f"CAST(round(255e0 * greatest(0e0, least(1e0, {v}))) AS BIGINT)"
        encoded = lambda v: stored(f"CASE WHEN {v} <= 0.0031308e0 THEN 12.92e0 * {v} ELSE 1.055e0 * power(greatest({v}, 0e0), 1e0 / 2.4e0) - 0.055e0 END")
        self.add(f"SELECT image_id, y, x, {encoded('r')} AS v0, {encoded('g')} AS v1, {encoded('b')} AS v2{f', {stored(chr(97))} AS v3' if alpha else ''} FROM {last}")
        return self

    def resample_in(self, made: SpacePlan) -> Sql:
        return self.convert(made.there, made.alpha[0]).resample(made.plan).convert(made.back, made.alpha[1])

    def text(self, rounded: bool = False) -> str:
        cells = ", ".join(f"round(v{c}, 3) AS v{c}" if rounded else f"v{c}" for c in range(self.channels))
        return f"WITH {', '.join(self.parts)} SELECT image_id, y, x, {cells} FROM {self.last}"
