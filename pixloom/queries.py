"""One query for each operator of the engine, over rasters derived from the tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures, size_queries
from .functions.colorspaces import LINEAR, SPACES
from .functions.kernels import FILTERS
from .operators import color
from .operators import relational as R
from .oracle import Sql
from .plans.plan import Format, Plan, Scaler
from .sources.images import integers, through_plan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Layouts as queries name them, and the shape of an embedding in each: all of its components, whatever the channels.
KINDS = {"planar": "plane", "cbcr": "cbcr", "gray_alpha": "ga", "rgb": "rgb", "rgba": "rgba"}
SHAPES = {"planar": (8, 8), "cbcr": (8, 4), "gray_alpha": (8, 4), "rgb": (6, 4), "rgba": (4, 4)}
RGB = SHAPES["rgb"]


def _source(width: int, height: int, channels: int, value: str, constant_alpha: bool = False):
    args = (width, height, channels, value, constant_alpha)
    return (lambda spark, d: fixtures.embedding_pixels(spark, d, *args)), lambda: Sql(fixtures.embedding_sql(*args), channels)


def _heat():
    return fixtures.heat_pixels, lambda: Sql(fixtures.heat_sql(), 1)


def _resampling(name: str, source, plan: Plan, rounded: bool = False) -> None:
    make, sql = source

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = R.resample(make(spark, sf_dir), plan)
        return out.select(*R.KEYS, *(F.round(c, 3).alias(c) for c in R.channels_of(out))) if rounded else out

    QUERIES[name], ORACLES[name] = query, sql().resample(plan).text(rounded)


def _register() -> None:
    u8 = Format()
    small = _source(8, 8, 1, "u8")
    for f in FILTERS:
        if f != "nearest":
            _resampling(f"resample_plane8_{f}", small, Scaler(f).plan((8, 8), (5, 3), u8))
    for f in ("bilinear", "catmull_rom", "lanczos3", "area", "spline36", "mitchell_netravalli"):
        _resampling(f"upscale_plane8_{f}", small, Scaler(f).plan((8, 8), (13, 16), u8))
    _resampling("nearest_plane8", small, Scaler("nearest").plan((8, 8), (5, 13), u8))
    _resampling("vertical_only", small, Scaler("lanczos3").plan((8, 8), (8, 4), u8))
    _resampling("horizontal_only", small, Scaler("lanczos3").plan((8, 8), (4, 8), u8))
    _resampling("noop", small, Scaler("lanczos3").plan((8, 8), (8, 8), u8))
    _resampling("default_filter", small, Scaler().plan((8, 8), (4, 4), u8))
    _resampling("multi_step_up", small, Scaler("bilinear", multi_step=True).plan((8, 8), (40, 40), u8))
    _resampling("multi_step_up_lanczos3", small, Scaler("lanczos3", multi_step=True).plan((8, 8), (64, 64), u8))
    _resampling("supersample_box", _heat(), Scaler("lanczos3", supersampling=True).plan(fixtures.HEAT, (8, 10), u8))
    _resampling("supersample_nearest", _heat(), Scaler("lanczos3", supersampling=True).plan(fixtures.HEAT, (6, 6), u8))
    _resampling("downscale_heat_lanczos3", _heat(), Scaler("lanczos3").plan(fixtures.HEAT, (12, 15), u8))
    for layout, channels, width, height in (("rgb", 3, *RGB), ("cbcr", 2, 8, 4), ("rgba", 4, 4, 4), ("gray_alpha", 2, 8, 4)):
        source, to = _source(width, height, channels, "u8"), (3, 3)
        kind = KINDS[layout]
        _resampling(f"resample_{kind}8", source, Scaler("lanczos3").plan((width, height), to, Format("u8", layout, 8)))
        for depth in (10, 12, 14, 16):
            format = Format("u16", layout, depth)
            _resampling(f"resample_{kind}16_d{depth}", _source(width, height, channels, f"u{depth}"), Scaler("bicubic").plan((width, height), to, format))
        _resampling(f"resample_{kind}_f32", _source(width, height, channels, "f32"), Scaler("lanczos3").plan((width, height), to, Format("f32", layout, 0)), True)
        if layout != "gray_alpha":
            _resampling(f"resample_{kind}_f16", _source(width, height, channels, "f16"), Scaler("lanczos3").plan((width, height), to, Format("f16", layout, 0)), True)
        if format.alpha is not None:
            unit = _source(width, height, channels, "unit")
            _resampling(f"resample_{kind}_f32_premul", unit, Scaler("lanczos3").plan((width, height), to, Format("f32", layout, 0), True), True)
            premul = lambda f, w=width, h=height, **k: Scaler("lanczos3", **k).plan((w, h), k.get("to", (3, 3)), f, True)
            _resampling(f"resample_{kind}8_premul", source, premul(Format("u8", layout, 8)))
            _resampling(f"resample_{kind}8_const_alpha", _source(width, height, channels, "u8", True), premul(Format("u8", layout, 8)))
            _resampling(f"resample_{kind}16_d10_premul", _source(width, height, channels, "u10"), premul(Format("u16", layout, 10)))
            _resampling(f"resample_{kind}16_d16_premul", _source(width, height, channels, "u16"), premul(Format("u16", layout, 16)))
            _resampling(f"multi_step_up_{kind}8_premul", source, Scaler("bilinear", multi_step=True).plan((width, height), (width * 4, height * 4), Format("u8", layout, 8), True))
    for depth in (10, 12, 14, 16):
        _resampling(f"resample_plane16_d{depth}", _source(8, 8, 1, f"u{depth}"), Scaler("lanczos3").plan((8, 8), (4, 4), Format("u16", "planar", depth)))
    for depth in (10, 16):
        _resampling(f"resample_s16_d{depth}", _source(8, 8, 1, f"s{depth}"), Scaler("lanczos3").plan((8, 8), (4, 4), Format("s16", "planar", depth)))
    _resampling("resample_plane_f16", _source(8, 8, 1, "f16"), Scaler("lanczos3").plan((8, 8), (4, 4), Format("f16", "planar", 0)), True)
    _resampling("resample_rgba_f16_premul", _source(4, 4, 4, "unit16"), Scaler("bilinear").plan((4, 4), (3, 3), Format("f16", "rgba", 0), True), True)
    for quality in ("speed", "quality"):  # not rounded: single and double taps differ in the last places
        _resampling(f"resample_plane_f32_{quality}", _source(8, 8, 1, "f32"), Scaler("lanczos3", quality).plan((8, 8), (4, 4), Format("f32", "planar", 0)))
    _alpha(), _geometry(), _packed(), _colors(), _bulk()


def _bulk() -> None:
    """Whole images a row: pixels are packed into images, these resized, and unpacked again."""
    depths = {"u8": (8,), "u16": (10, 16), "s16": (10,), "f32": (0,), "f16": (0,)}
    values = {"u8": "u8", "u16": "u{}", "s16": "s{}", "f32": "unit", "f16": "unit16"}
    for sample, each in depths.items():
        for layout, (width, height) in SHAPES.items():
            for depth in each:
                if (sample == "s16" and layout != "planar") or (sample == "f16" and layout == "gray_alpha"):
                    continue
                format = Format(sample, layout, depth)
                plan = Scaler("lanczos3" if depth else "bilinear").plan((width, height), (3, 5), format, True)
                _whole_images(f"bulk_{KINDS[layout]}_{sample}" + (f"_d{depth}" if sample == "u16" else ""), _source(width, height, format.channels, values[sample].format(depth)), plan)


def _whole_images(name: str, source, plan: Plan) -> None:
    make, sql = source
    format = plan.format

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = through_plan(make(spark, sf_dir), plan)
        return out if format.floating else integers(out)

    QUERIES[name], ORACLES[name] = query, sql().resample(plan).text()


def _put(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _alpha() -> None:
    make, sql = _source(4, 4, 4, "u8")
    format = Format("u8", "rgba", 8)
    forward, back = sql(), sql()
    forward.blend(format, False, None), back.blend(format, True, None)
    _put("alpha_premul", lambda s, d: R.premultiply(make(s, d), format), forward.text())
    _put("alpha_unpremul", lambda s, d: R.unpremultiply(make(s, d), format), back.text())
    flat, flat_sql = _source(4, 4, 4, "u8", True)
    base = flat_sql()
    _put("alpha_nonconstant", lambda s, d: R.alpha_nonconstant(flat(s, d), "v3"), f"WITH {base.parts[0]} SELECT image_id, min(v3) <> max(v3) AS nonconstant FROM p0 GROUP BY image_id")


def _geometry() -> None:
    make, sql = _source(8, 8, 1, "u8")
    rgb, rgb_sql = _source(*RGB, 3, "u8")
    cut = sql()
    cut.add("SELECT image_id, CAST(y - 3 AS INT) AS y, CAST(x - 2 AS INT) AS x, v0 FROM p0 WHERE x BETWEEN 2 AND 6 AND y BETWEEN 3 AND 6")
    _put("crop", lambda s, d: R.crop(make(s, d), (8, 8), 2, 3, 5, 4), cut.text())
    wide, wide_sql = _source(8, 4, 2, "u8")
    for k, (nx, ny, _) in R.ORIENTATIONS.items():
        turned = wide_sql()
        turned.add(f"SELECT image_id, CAST({ny} AS INT) AS y, CAST({nx} AS INT) AS x, v0, v1 FROM (SELECT *, 8 AS w, 4 AS h FROM p0) AS q")
        _put(f"orient_{k}", lambda s, d, k=k: R.orient(wide(s, d), (8, 4), k), turned.text())
    one = rgb_sql()
    one.channels = 1
    one.add("SELECT image_id, y, x, v1 AS v0 FROM p0")
    _put("channel_split", lambda s, d: R.split_channel(rgb(s, d), 1), one.text())
    _put("channel_merge", lambda s, d: R.merge_channels([R.split_channel(rgb(s, d), c) for c in range(3)]), rgb_sql().text())
    size, plan_of = (8, 4), lambda a, b: Scaler("catmull_rom").plan(a, b, Format("u8", "cbcr", 8))
    for mode in ("fill", "fit_width", "fit_height", "fit", "cover"):
        text = wide_sql()
        box = (6, 6)
        if mode == "cover":
            x, y, w, h = R.cover_crop(size, box)
            text.add(f"SELECT image_id, CAST(y - {y} AS INT) AS y, CAST(x - {x} AS INT) AS x, v0, v1 FROM p0 WHERE x BETWEEN {x} AND {x + w - 1} AND y BETWEEN {y} AND {y + h - 1}")
            text.resample(plan_of((w, h), box))
        else:
            to = R.fitted(size, box, mode)
            text.resample(plan_of(size, to))
            if mode == "fit":
                left, top = (box[0] - to[0]) // 2, (box[1] - to[1]) // 2
                text.add(f"SELECT i.image_id, CAST(gy AS INT) AS y, CAST(gx AS INT) AS x, coalesce(v0, 7) AS v0, coalesce(v1, 9) AS v1 FROM (SELECT DISTINCT image_id FROM p0) AS i CROSS JOIN range({box[1]}) AS ry(gy) CROSS JOIN range({box[0]}) AS rx(gx) LEFT JOIN {text.last} AS p ON p.image_id = i.image_id AND p.y + {top} = gy AND p.x + {left} = gx")
        _put(f"mode_{mode}", lambda s, d, mode=mode: R.resize_mode(wide(s, d), size, (6, 6), mode, plan_of, (7, 9)), text.text())


def _packed() -> None:
    make, sql = _source(*RGB, 3, "u10")
    for kind, shifts in R.PACKED.items():
        *rgb, alpha = shifts
        pack = " + ".join(f"v{i} * {1 << s}" for i, s in enumerate(rgb))
        for order in ("host", "network"):
            for which in ("lanczos3",) if order == "network" else ("lanczos3", "nearest"):
                plan = Scaler(which).plan(RGB, (3, 3), Format("u16", "rgb", 10))
                text = sql().resample(plan)
                text.add(f"SELECT image_id, y, x, {3 << alpha} + {pack} AS w FROM {text.last}")
                swapped = "(w % 256) * 16777216 + (w // 256 % 256) * 65536 + (w // 65536 % 256) * 256 + w // 16777216"
                text.channels = 1
                text.add(f"SELECT image_id, y, x, CAST({'w' if order == 'host' else swapped} AS BIGINT) AS v0 FROM {text.last}")
                name = f"resample_{kind}" + ("_network" if order == "network" else "") + ("_nearest" if which == "nearest" else "")
                _put(name, lambda s, d, kind=kind, order=order, plan=plan: R.resample30(R.pack30(make(s, d), kind, order), kind, plan, order), text.text())


def _colors() -> None:
    for layout in ("rgb", "rgba"):
        for space in (*LINEAR, *SPACES):
            _space(f"{space}_{layout}", space, Format("u8", layout, 8))
    for space in LINEAR:
        for layout, kind in KINDS.items():
            if layout not in ("rgb", "rgba"):
                _space(f"{space}_{kind}", space, Format("u8", layout, 8))
            _space(f"{space}_{kind}16", space, Format("u16", layout, 12))
    _space("oklab_rec709_rgb", "oklab", Format("u8", "rgb", 8), transfer="rec709")
    _space("jzazbz_gamma22_100_rgba", "jzazbz", Format("u8", "rgba", 8), transfer="gamma22", luminance=100)


def _space(name: str, space: str, format: Format, **how) -> None:
    size = SHAPES[format.layout]
    make, sql = _source(*size, format.channels, "u8" if format.sample == "u8" else f"u{format.bit_depth}")
    plan = color.plan_in(space, size, (3, 3), "lanczos3", format, **how)
    if plan.curves and not how:
        text = sql().resample_linear(plan.plan, format.sample, format.depth)
    elif space in SPACES and space != "sigmoidal" and not how:
        text = sql().resample_space(plan.plan, space)
    else:
        text = sql().resample_in(plan)
    _put(name, lambda s, d: color.resample_in(make(s, d), plan), text.text())


_register()
QUERIES |= size_queries.QUERIES
ORACLES |= size_queries.ORACLES
