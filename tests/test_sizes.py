"""What goes by each image's own size, bands of one image, array lines, taps made by Spark, curves by table and running sums."""

import collections
import re

import duckdb
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from pixloom import fixtures, size_queries
from pixloom.errors import ResampleError
from pixloom.functions.kernels import FILTERS
from pixloom.operators import bands, color, intervals, lines, mixed
from pixloom.operators import relational as R
from pixloom.operators.rows import apply
from pixloom.plans.frames import weight_frame
from pixloom.plans.plan import Format, Scaler
from pixloom.plans.weights import nearest_index, weights

CHECKED = [
    "weights_lanczos3", "weights_area", "weights_ewa_lanczos_sharp", "resample_documents_mixed", "fit_documents_mixed", "crop_documents_mixed", "auto_orient_documents", "auto_orient",
    "lines_rgba8_premul", "lines_supersample_nearest", "lines_s16_d10", "banded_rgba16_d16_premul", "banded_heat_lanczos3", "banded_supersample_nearest", "interval_box", "interval_area",
    "interval_box_rgba16", "store_from_pixels", "store_allocate", "auto_orient_images", "api_resize", "sql_resize_rgb8", "validate_rows",
]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for n in ("embeddings", "events", "documents"):
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_spark_and_duckdb_agree(spark, db, name):
    got, want = size_queries.QUERIES[name](spark, DATA), db.sql(size_queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (collections.Counter(map(tuple, rows)) for rows in (got.select(columns).collect(), want.select(*columns).fetchall()))
    assert a == b and a


PAIRS = [(8, 5), (4, 8), (1, 3), (3, 1), (31, 12), (7, 7), (16, 40)]


@pytest.mark.parametrize("which", list(FILTERS))
def test_taps_made_by_spark_are_those_made_by_numpy(spark, which):
    sizes = spark.createDataFrame([*PAIRS, (8, 5), (0, 3), (5, -1), (None, 2)], "in_size int, out_size int")
    got = {(r.in_size, r.out_size, r.out_idx, r.in_idx, r.tap): (r.w, r.wq) for r in weight_frame(sizes, which).collect()}
    want = {}
    for a, b in PAIRS:
        if a == b:
            rows = [(o, o, 0, 1.0, 1 << 15) for o in range(b)]
        elif which == "nearest":
            rows = [(o, int(s), 0, 1.0, 1 << 15) for o, s in enumerate(nearest_index(a, b))]
        else:
            rows = weights(a, b, which).rows()
        want |= {(a, b, *r[:3]): r[3:] for r in rows}
    assert got.keys() == want.keys()
    assert all(got[k][1] == w[1] and abs(got[k][0] - w[0]) < 1e-11 for k, w in want.items())


def made_up(sizes, channels=1, most=255):
    rng = np.random.default_rng(1)
    return {i: rng.integers(0, most + 1, (h, w, channels)) for i, (w, h) in enumerate(sizes)}


def frame(spark, px, channels=1):
    rows = [(i, y, x, *map(int, p[y, x])) for i, p in px.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y int, x int, " + ", ".join(f"v{c} long" for c in range(channels)))


def gathered(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.image_id, {})[r.y, r.x] = [r[c] for c in R.channels_of(df)]
    return {i: np.array([[v[y, x] for x in range(max(k[1] for k in v) + 1)] for y in range(max(k[0] for k in v) + 1)]) for i, v in found.items()}


@pytest.mark.parametrize("which,format", [("lanczos3", Format()), ("area", Format("u8", "rgba", 8)), ("bicubic", Format("u16", "gray_alpha", 16)), ("nearest", Format("u16", "rgb", 10))])
def test_images_of_many_sizes_at_once(spark, which, format):
    sizes = [(1, 1), (9, 4), (4, 9), (6, 6), (13, 2), (6, 6), (3, 8), (5, 7)]
    px = made_up(sizes, format.channels, format.limits[1])
    if format.alpha is not None:
        px[5][..., format.alpha] = 7
    target = lambda w, h: (F.greatest(F.lit(1), F.floor(w * 2 / 3)), F.when(h < 8, h).otherwise(5))
    got = gathered(mixed.resample_mixed(frame(spark, px, format.channels), which, target, format, premultiply=True).select(*R.KEYS, *(f"v{c}" for c in range(format.channels))))
    for i, (w, h) in enumerate(sizes):
        plan = Scaler(which).plan((w, h), (max(1, w * 2 // 3), h if h < 8 else 5), format, True)
        assert np.array_equal(got[i], apply(px[i], plan)), (i, which)


def test_mixed_sizes_deal_pixels_once_and_check_targets(spark):
    px = fixtures.document_pixels(spark, DATA)
    plan = mixed.resample_mixed(px, "bilinear", lambda w, h: (F.lit(4), F.greatest(F.lit(1), F.floor(h / 2))))._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"hashpartitioning\((\w+)#\d+L, \d+\), REPARTITION_BY_COL", plan))
    assert dealt == {"image_id"} and "CartesianProduct" not in plan and "BatchEval" not in plan
    small = frame(spark, made_up([(2, 2)]))
    with pytest.raises(Exception, match=r"\[1\]"):
        mixed.resample_mixed(small, "bilinear", lambda w, h: (F.lit(0), h)).collect()
    assert mixed.resample_mixed(small.limit(0), "bilinear", lambda w, h: (w, h)).collect() == []
    with pytest.raises(Exception, match=r"\[14\]"):
        mixed.crop_each(mixed.with_sizes(small), lambda w, h: (F.lit(1), F.lit(1), w, h)).collect()


def test_bands_spread_one_image_over_tasks(spark):
    px = made_up([(40, 64)])
    plan = Scaler("lanczos3").plan((40, 64), (20, 48))
    table = frame(spark, px)
    whole = gathered(R.resample(table, plan))[0]
    for policy in ("single", 5, "adaptive", 1000):
        assert np.array_equal(gathered(bands.resample_banded(table, plan, policy))[0], whole)
    # By static partitions, so that each band is to be seen where it lies.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = bands.dealt(table, plan.steps[0], 8).withColumn("at", F.spark_partition_id())
        assert spread.select("at").distinct().count() > 1
        rows = spread.select("band", "y").distinct().collect()
        assert len({r.band for r in rows}) == 8 and len(rows) > 64  # rows next to a band are in both
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [bands.band_count((4928, 3279), p, 16) for p in ("single", 3, "adaptive")] == [1, 3, 16] and bands.band_count((100, 100), "adaptive", 16) == 1
    with pytest.raises(ResampleError):
        bands.band_count((1, 1), "many", 4)


def test_lines_make_no_rows_of_pixels(spark):
    made = lines.to_lines(frame(spark, made_up([(8, 8)] * 3)))
    plan = lines.resample_lines(made, Scaler("lanczos3", multi_step=True).plan((8, 8), (64, 64)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Python" not in plan
    assert lines.resample_lines(made.limit(0), Scaler("bilinear").plan((8, 8), (4, 4))).collect() == []


def test_one_read_for_varying_alpha(spark):
    px = fixtures.embedding_pixels(spark, DATA, 4, 4, 4, "u8")
    plan = R.resample(px, Scaler("lanczos3").plan((4, 4), (3, 3), Format("u8", "rgba", 8), True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_long_tables_of_taps_are_made_by_spark(spark, monkeypatch):
    px = made_up([(24, 3)])
    plan = Scaler("lanczos3").plan((24, 3), (10, 2))
    monkeypatch.setattr(R, "MOST_SENT", 20)
    made = R.resample(frame(spark, px), plan)
    assert np.array_equal(gathered(made)[0], apply(px[0], plan)) and "Window" in made._jdf.queryExecution().executedPlan().toString()


def test_curves_go_by_their_tables_rounding(spark):
    there, back = color.linear_curves(Format("u8", "rgb", 8), "srgb")
    assert (there.entries, back.entries) == (256, 1 << 16) and color.linear_curves(Format("u16", "rgb", 10), "srgb")[1].entries == 1 << 18
    curve = lambda v: np.where(v <= 0.0031308, 12.92 * v, 1.055 * np.maximum(v, 0) ** (1 / 2.4) - 0.055)
    # Where the curve crosses from one sample to the next, the table crosses at its nearest entry, so what lies between differs.
    lo, hi = np.zeros(255), np.ones(255)
    for _ in range(60):
        mid = (lo + hi) / 2
        above = curve(mid) * 255 >= np.arange(255) + 0.5
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
    values = np.concatenate([hi - 3e-6, hi + 3e-6, [-0.5, 0.0, 1.0, 1.7]])
    table = spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(values)], "image_id long, y int, x int, v0 double")
    got = [r.v0 for r in color.through(table, back, ["v0"]).orderBy("x").collect()]
    index = np.clip(np.floor(values * 65535 + 0.5), 0, 65535)
    by_table, exact = np.floor(np.clip(curve(index / 65535), 0, 1) * 255 + 0.5), np.floor(np.clip(curve(np.clip(values, 0, 1)), 0, 1) * 255 + 0.5)
    assert got == by_table.tolist()
    differ = np.flatnonzero(by_table != exact)
    assert len(differ) > 50 and set(np.abs(by_table - exact)[differ]) == {1}


def test_intervals_need_equal_taps(spark):
    px = made_up([(24, 31)], 2)
    for which in ("box", "area"):
        got = gathered(intervals.shrink(frame(spark, px, 2), (24, 31), (7, 31), which, Format("u8", "cbcr", 8)))[0]
        assert np.array_equal(got, apply(px[0], Scaler(which).plan((24, 31), (7, 31), Format("u8", "cbcr", 8))))
    rows = intervals.interval_rows(4096, 4, "box", True)
    assert len(rows) < 13  # three for an output of thousands of taps
    for which, src, dst, format in (("bilinear", 8, 4, Format()), ("area", 4, 8, Format()), ("box", 8, 4, Format("f32", "planar", 0))):
        with pytest.raises(ResampleError):
            intervals.interval_pass(frame(spark, px, 2), "x", src, dst, which, format)
