"""What keeps work and memory in proportion to the input: what is exchanged, how many tasks, how much a task holds."""

import __spark_entry__ as entry
import numpy as np
import pyarrow as pa
from conftest import DATA
from pyspark.sql import functions as F
from test_sizes import frame, gathered, made_up

from pixloom import fixtures
from pixloom.operators import lines, mixed
from pixloom.operators import relational as R
from pixloom.operators.rows import apply
from pixloom.plans.plan import Format, Scaler
from pixloom.sources import images


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mixed_sizes_exchange_runs_and_not_pixels(spark):
    px = fixtures.document_pixels(spark, DATA)
    for made in (mixed.with_sizes(px), mixed.resample_mixed(px, "bilinear", mixed.fit_within(16, 16))):
        plan = plan_of(made)
        assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_sizes_of_images_of_many_runs(spark):
    px = frame(spark, made_up([(150, 90), (3, 5), (1, 1)])).withColumn("k", F.concat(F.lit("k"), F.col("image_id")))
    px = px.unionByName(px.limit(1).withColumn("image_id", F.lit(None).cast("long"))).repartition(5)
    got = mixed.with_sizes(px)
    assert got.columns == [*px.columns, "width", "height"]
    assert {tuple(r) for r in got.select("image_id", "k", "width", "height").distinct().collect()} == {(0, "k0", 150, 90), (1, "k1", 3, 5), (2, "k2", 1, 1)}
    assert got.drop("width", "height").exceptAll(px.where("image_id IS NOT NULL")).isEmpty() and got.count() == px.count() - 1


def test_pixels_that_are_missing(spark):
    """They count as 0, for alpha as well not at all; outputs without any aren't there, as in the relational form."""
    format = Format("u8", "gray_alpha", 8)
    px = made_up([(12, 9), (8, 8)], 2)
    px[1][..., 1] = 9
    table = frame(spark, px, 2).where("NOT (image_id = 0 AND (x < 6 AND y < 5 OR x = 8 AND y = 3)) AND NOT (image_id = 1 AND x = 2 AND y = 7)")
    got = {}
    for r in mixed.resample_mixed(table.repartition(3), "bilinear", lambda w, h: (F.lit(5), F.lit(4)), format, premultiply=True).collect():
        got.setdefault(r.image_id, set()).add((r.y, r.x, r.v0, r.v1, r.width, r.height))
    for i, (w, h) in enumerate([(12, 9), (8, 8)]):
        plan = Scaler("bilinear").plan((w, h), (5, 4), format, True)
        assert got[i] == {(r.y, r.x, r.v0, r.v1, 5, 4) for r in R.resample(table.where(F.col("image_id") == i), plan).collect()}
    assert len(got[0]) < 20 and len(got[1]) == 20


def test_an_image_of_several_batches(spark):
    px = made_up([(160, 130)])
    made = mixed.resample_mixed(frame(spark, px), "lanczos3", lambda w, h: (F.lit(33), F.lit(60)))
    assert np.array_equal(gathered(made.select(*R.KEYS, "v0"))[0], apply(px[0], Scaler("lanczos3").plan((160, 130), (33, 60))))


def test_tasks_grow_with_what_comes_out(spark, monkeypatch):
    px = made_up([(8, 8)] * 12)
    plan = Scaler("bilinear", multi_step=True).plan((8, 8), (40, 40))
    monkeypatch.setattr(R, "SUMMED", 1600)
    made = R.resample(frame(spark, px), plan)
    assert "hashpartitioning(image_id" in plan_of(made) and ", 12)" in plan_of(made)  # an image's outputs a task
    assert np.array_equal(gathered(made)[3], apply(px[3], plan))
    assert R._growth(Scaler("box").plan((8, 2), (4, 8))) == 4  # the vertical pass comes first


def test_lines_are_dealt_to_tasks_by_what_comes_out(spark, monkeypatch):
    px = made_up([(8, 8)] * 9)
    plan = Scaler("lanczos3", multi_step=True).plan((8, 8), (64, 64))
    monkeypatch.setattr(R, "SUMMED", 4096)
    made = lines.resample_pixels(frame(spark, px), plan)
    assert ", 9)" in plan_of(made) and "REPARTITION_BY_NUM" in plan_of(made)
    assert np.array_equal(gathered(made)[5], apply(px[5], plan))


def test_whole_images_take_one_python_worker_a_task(spark):
    queries = entry.queries()
    for name, workers in (("bulk_rgb_f16", 1), ("bulk_cbcr_u16_d10", 1), ("bulk_plane_f16", 1), ("auto_orient_images", 2)):
        assert plan_of(queries[name](spark, DATA)).count("MapInArrow") == workers, name


def test_pixels_of_images_come_in_bounded_batches_and_not_one_for_an_image():
    small = [(i, 5, 2, 1, "u8", 8, 6, bytes(range(i % 90, i % 90 + 12)), None) for i in range(3000)]
    large = [(None, 400, 300, 1, "u8", 8, 0, np.arange(120_000).astype(np.uint8).tobytes(), None), (7, 1, 1, 1, "u8", 8, 0, None, None)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.null()]
    batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*small, *large, strict=True), kinds, strict=True)], images.IMAGE.names)
    got = list(images._unpacking(images.IMAGE.names, "planar")(iter([batch])))
    assert len(got) < 6 and max(b.num_rows for b in got) < 2 * images._PIXELS
    rows = pa.Table.from_batches(got).to_pylist()
    assert rows[:30_000] == [{"image_id": r[0], "y": y, "x": x, "v0": float(r[7][6 * y + x])} for r in small for y in range(2) for x in range(5)]
    assert [(r["image_id"], r["y"], r["x"], r["v0"]) for r in rows[30_000:]] == [(None, k // 400, k % 400, float(k % 256)) for k in range(120_000)]
