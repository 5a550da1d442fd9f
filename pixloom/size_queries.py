"""Queries of what goes by each image's own size or orientation, of bands and of lines, and of the taps themselves; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, fixtures
from .functions.kernels import FILTERS
from .operators import bands, intervals, lines, mixed
from .operators import relational as R
from .oracle import Sql
from .plans.frames import weight_frame
from .plans.plan import Format, Plan, Scaler
from .sources import images

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _put(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


# ---- taps --------------------------------------------------------------------------------------------------------

#: Sides that the lengths and ids of all documents make: what grows and what shrinks.
_IN, _OUT = "2 + length(coalesce(text, '')) % 13", "1 + doc_id % 11"


def _weights(which: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        made = weight_frame(docs.selectExpr(f"{_IN} AS in_size", f"{_OUT} AS out_size"), which)
        whole = [F.col(c).cast("long").alias(c) for c in ("in_size", "out_size", "out_idx", "in_idx", "tap", "wq")]
        # In millionths, cut where no simple fraction lies, so that the last bit of a sum decides nothing; none where taps all but cancel out.
        return made.select(*whole, F.when(F.abs("w") < 1e6, F.floor(F.col("w") * 1e6 + 0.2718)).alias("w_millionths"))

    text = Sql(f"SELECT {_IN} AS m, {_OUT} AS n FROM documents", 0)
    taps = text.weights_of("p0", which)
    _put(f"weights_{which}", query, f"WITH {', '.join(text.parts)} SELECT CAST(m AS BIGINT) AS in_size, CAST(n AS BIGINT) AS out_size, CAST(i AS BIGINT) AS out_idx, CAST(j AS BIGINT) AS in_idx, CAST(k AS BIGINT) AS tap, CAST(wq AS BIGINT) AS wq, CASE WHEN abs(w) < 1e6 THEN CAST(floor(w * 1e6 + 0.2718e0) AS BIGINT) END AS w_millionths FROM {taps}")


# ---- sizes and orientations of each image ------------------------------------------------------------------------


def _documents() -> None:
    """Pages of as many lines as a document needs, each to its own target."""
    for name, which, width, height in (("resample_documents_mixed", "catmull_rom", "12", "greatest(1, h * 3 // 8)"), ("fit_documents_mixed", "bilinear", None, None)):
        target = (lambda w, h: (F.lit(12), F.greatest(F.lit(1), F.floor(h * 3 / 8)))) if width else mixed.fit_within(16, 16)
        scale = "least(16e0 / w, 16e0 / h)"
        width, height = (width, height) if width else (f"greatest(1, floor(w * {scale} + 0.5e0))", f"greatest(1, floor(h * {scale} + 0.5e0))")
        text = Sql(fixtures.document_sql(), 1).mixed(width, height, which, Format())

        def query(spark: SparkSession, sf_dir: str, which=which, target=target) -> DataFrame:
            return mixed.resample_mixed(fixtures.document_pixels(spark, sf_dir), which, target).select(*R.KEYS, "v0")

        _put(name, query, text.text())

    def cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
        box = lambda w, h: (F.floor(w / 4), F.floor(h / 4), F.ceil(w / 2), F.ceil(h / 2))
        return mixed.crop_each(mixed.with_sizes(fixtures.document_pixels(spark, sf_dir)), box).select(*R.KEYS, "v0")

    sized = f"WITH p AS MATERIALIZED ({fixtures.document_sql()}), s AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM p GROUP BY image_id), q AS (SELECT p.*, w, h FROM p JOIN s USING (image_id))"
    _put("crop_documents_mixed", cropped, f"{sized} SELECT image_id, CAST(y - h // 4 AS INT) AS y, CAST(x - w // 4 AS INT) AS x, v0 FROM q WHERE x >= w // 4 AND x < w // 4 + ceil(w / 2) AND y >= h // 4 AND y < h // 4 + ceil(h / 2)")

    def turned(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = mixed.with_sizes(fixtures.document_pixels(spark, sf_dir)).withColumn("orientation", (F.col("image_id") % 8 + 1).cast("int"))
        return mixed.auto_orient(px).select(*R.KEYS, "v0", "width", "height")

    _put("auto_orient_documents", turned, f"{sized} {_turned('q', 'v0, CAST(CASE WHEN o >= 5 THEN h ELSE w END AS INT) AS width, CAST(CASE WHEN o >= 5 THEN w ELSE h END AS INT) AS height')}")


def _turned(table: str, cells: str) -> str:
    """The eight orientations as where mirrored rows and columns go, written from what they do: flips, and sides that swap."""
    fx, fy = "CASE WHEN o IN (2, 3, 7, 8) THEN w - 1 - x ELSE x END", "CASE WHEN o IN (3, 4, 6, 7) THEN h - 1 - y ELSE y END"
    return f"SELECT image_id, CAST(CASE WHEN o >= 5 THEN fx ELSE fy END AS INT) AS y, CAST(CASE WHEN o >= 5 THEN fy ELSE fx END AS INT) AS x, {cells} FROM (SELECT *, {fx} AS fx, {fy} AS fy FROM (SELECT *, image_id % 8 + 1 AS o FROM {table}) AS a) AS b"


def _oriented() -> None:
    args = (6, 4, 3, "u8")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = fixtures.embedding_pixels(spark, sf_dir, *args)
        facts = {"width": F.lit(6), "height": F.lit(4), "orientation": (F.col("image_id") % 8 + 1).cast("int")}
        return mixed.auto_orient(px.withColumns(facts)).select(*R.KEYS, "v0", "v1", "v2")

    _put("auto_orient", query, f"WITH p AS (SELECT *, 6 AS w, 4 AS h FROM ({fixtures.embedding_sql(*args)}) AS e) {_turned('p', 'v0, v1, v2')}")


# ---- other forms of the same plans -------------------------------------------------------------------------------


def _forms() -> None:
    embedding = lambda *a: ((lambda s, d: fixtures.embedding_pixels(s, d, *a)), lambda: Sql(fixtures.embedding_sql(*a), a[2]))
    heat = (fixtures.heat_pixels, lambda: Sql(fixtures.heat_sql(), 1))
    plans: dict[str, tuple[tuple, Plan]] = {
        "plane8_lanczos3": (embedding(8, 8, 1, "u8"), Scaler("lanczos3").plan((8, 8), (5, 3))),
        "nearest_plane8": (embedding(8, 8, 1, "u8"), Scaler("nearest").plan((8, 8), (5, 13))),
        "rgba8_premul": (embedding(4, 4, 4, "u8"), Scaler("lanczos3").plan((4, 4), (3, 3), Format("u8", "rgba", 8), True)),
        "rgba16_d16_premul": (embedding(4, 4, 4, "u16"), Scaler("bicubic").plan((4, 4), (3, 5), Format("u16", "rgba", 16), True)),
        "s16_d10": (embedding(8, 8, 1, "s10"), Scaler("lanczos3").plan((8, 8), (4, 4), Format("s16", "planar", 10))),
        "heat_lanczos3": (heat, Scaler("lanczos3").plan(fixtures.HEAT, (12, 15))),
        "supersample_nearest": (heat, Scaler("lanczos3", supersampling=True).plan(fixtures.HEAT, (6, 6))),
        "multi_step_up_lanczos3": (embedding(8, 8, 1, "u8"), Scaler("lanczos3", multi_step=True).plan((8, 8), (64, 64))),
        "plane_f16": (embedding(8, 8, 1, "f16"), Scaler("lanczos3").plan((8, 8), (4, 4), Format("f16", "planar", 0))),
    }
    for name, ((make, sql), plan) in plans.items():
        text = sql().resample(plan).text(plan.format.floating)
        rounded = lambda df, plan=plan: df.select(*R.KEYS, *(F.round(c, 3).alias(c) if plan.format.floating else c for c in R.channels_of(df)))
        _put(f"lines_{name}", lambda s, d, make=make, plan=plan, rounded=rounded: rounded(lines.resample_pixels(make(s, d), plan)), text)
        if name != "multi_step_up_lanczos3":
            _put(f"banded_{name}", lambda s, d, make=make, plan=plan, rounded=rounded: rounded(bands.resample_banded(make(s, d), plan, 3)), text)


def _intervals() -> None:
    """Box and area as running sums, held against their taps."""
    for name, which, make, text, src, dst, format in (
        ("interval_box", "box", fixtures.heat_pixels, Sql(fixtures.heat_sql(), 1), fixtures.HEAT, (6, 7), Format()),
        ("interval_area", "area", fixtures.heat_pixels, Sql(fixtures.heat_sql(), 1), fixtures.HEAT, (7, 10), Format()),
        ("interval_box_rgba16", "box", lambda s, d: fixtures.embedding_pixels(s, d, 4, 4, 4, "u16"), Sql(fixtures.embedding_sql(4, 4, 4, "u16"), 4), (4, 4), (3, 2), Format("u16", "rgba", 16)),
    ):
        _put(name, lambda s, d, a=(which, make, src, dst, format): intervals.shrink(a[1](s, d), a[2], a[3], a[0], a[4]), text.resample(Scaler(which).plan(src, dst, format)).text())


# ---- whole images ------------------------------------------------------------------------------------------------

_RGB = (6, 4, 3, "u8")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.from_pixels(fixtures.embedding_pixels(spark, sf_dir, *_RGB), 6, 4, Format("u8", "rgb", 8))


def _whole() -> None:
    """Stores, the entry points and checks over one image for each embedding."""
    base = fixtures.embedding_sql(*_RGB)
    hexed = "string_agg(printf('%02x%02x%02x', v0, v1, v2), '' ORDER BY y, x)"
    _put(
        "store_from_pixels", lambda s, d: _images(s, d).select("image_id", "width", "height", "channels", "stride", F.lower(F.hex("data")).alias("data")),
        f"SELECT image_id, CAST(6 AS INT) AS width, CAST(4 AS INT) AS height, CAST(3 AS INT) AS channels, CAST(0 AS INT) AS stride, {hexed} AS data FROM ({base}) AS p GROUP BY image_id",
    )
    _put(
        "store_allocate", lambda s, d: images.allocate(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("image_id")), 3, 2, "rgb", "u16", 10).select("image_id", "width", "height", "channels", "bit_depth", F.hex("data").alias("data")),
        "SELECT vec_id AS image_id, CAST(3 AS INT) AS width, CAST(2 AS INT) AS height, CAST(3 AS INT) AS channels, CAST(10 AS INT) AS bit_depth, repeat('00', 36) AS data FROM embeddings",
    )

    def turned(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = F.struct(*(F.lit(None).cast("binary").alias(c) for c in ("icc", "exif", "xmp")), (F.col("image_id") % 8 + 1).cast("int").alias("orientation"))
        return images.integers(images.to_pixels(_images(spark, sf_dir).withColumn("metadata", facts), "rgb", orient=True))

    _put("auto_orient_images", turned, ORACLES["auto_orient"])
    small = Sql(base, 3).resample(Scaler("lanczos3").plan((6, 4), (3, 5), Format("u8", "rgb", 8))).text()
    pixels = lambda rows: images.integers(images.to_pixels(rows, "rgb"))
    _put("api_resize", lambda s, d: pixels(api.resize(_images(s, d), (3, 5), "RGB", "lanczos3")), small)
    _put("api_plan", lambda s, d: pixels(api.plan((6, 4), (3, 5), "RGB", "lanczos3").resize(_images(s, d))), small)

    def by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
        api.register_formats(spark)
        made = _images(spark, sf_dir).withColumn("data", F.expr("resize_rgb8(data, width, height, 3, 5, 8, 'lanczos3', 0)"))
        return pixels(made.withColumns({"width": F.lit(3), "height": F.lit(5)}))

    _put("sql_resize_rgb8", by_sql, small)

    def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Rasters with a fault each, by their id, against a plan for 6x4 to 3x5."""
        k = F.col("image_id") % 12
        rows = _images(spark, sf_dir).withColumns({
            "width": F.when(k == 1, 0).when(k == 2, 1 << 30).when(k == 9, 3).otherwise(F.col("width")).cast("int"), "height": F.when(k == 2, 1 << 30).otherwise(F.col("height")).cast("int"),
            "sample": F.when(k == 6, "u16").otherwise("u8"), "channels": F.when(k == 2, 1 << 10).otherwise(F.col("channels")).cast("int"), "bit_depth": F.when(k == 6, 17).otherwise(8),
            "stride": F.when(k == 5, 5).otherwise(0), "data": F.when(k == 4, F.substring("data", 1, 71)).otherwise(F.col("data")),
            "to_width": F.when(k == 10, 4).when(k == 3, 2_000_000_000).otherwise(3), "to_height": F.when(k == 3, 2_000_000_000).when(k == 11, 0).otherwise(5),
            "scratch": F.when(k == 8, 89).when(k == 7, F.lit(None)).otherwise(90),
        })
        rows = rows.withColumn("channels", F.when(k == 3, 4).otherwise(F.col("channels")))
        good, bad = images.checked(rows, api.plan((6, 4), (3, 5)))
        return good.select(F.lit(0).alias("code")).union(bad.select("code")).groupBy("code").agg(F.count("*").alias("images"))

    codes = "CASE vec_id % 12 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 6 WHEN 8 THEN 9 WHEN 9 THEN 10 WHEN 10 THEN 11 WHEN 11 THEN 1 ELSE 0 END"
    _put("validate_rows", faults, f"SELECT CAST({codes} AS INT) AS code, count(*) AS images FROM embeddings GROUP BY 1")


for _filter in FILTERS:
    if _filter != "nearest":
        _weights(_filter)
_documents(), _oriented(), _forms(), _intervals(), _whole()
