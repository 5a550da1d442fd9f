"""Sums of doubles are added in the order of their sources, whatever order rows come in and however tasks hold them."""

import random

import numpy as np
import pytest

from pixloom.operators import bands, color
from pixloom.operators import relational as R
from pixloom.plans.plan import Format, Scaler

PLAN = Scaler("lanczos3", "quality").plan((4, 4), (3, 3), Format("f32", "planar", 0))  # taps of sixteenths but for their last bits: one sum in 16 is a tie
MANY = 1500


def planes():
    return np.random.default_rng(4).random((MANY, 4, 4)).astype(np.float32).astype(float)


def frame(spark, px, seed=None):
    rows = [(i, y, x, float(px[i, y, x])) for i in range(len(px)) for y in range(4) for x in range(4)]
    if seed is not None:
        random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "image_id long, y int, x int, v0 double")


def one_after_the_other(spark, px):
    """Down and then across, each sum from the first source to the last, stored in single precision."""
    taps = np.zeros((3, 4))
    for r in R.weight_rows(spark, 4, 3, "lanczos3").collect():
        taps[r.out_idx, r.in_idx] = r.w
    for axis in (1, 2):
        at = lambda k, axis=axis: np.take(px, k, axis)
        sums = []
        for tap in taps:
            total = at(0) * tap[0]
            for k in range(1, 4):
                total = total + at(k) * tap[k]
            sums.append(total.astype(np.float32).astype(float))
        px = np.stack(sums, axis)
    return px


def gathered(made, many=MANY):
    out = np.full((many, 3, 3), np.nan)
    for r in made.collect():
        out[r.image_id, r.y, r.x] = r.v0
    return out


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_single_precision_sums_are_those_of_their_order(spark, seed):
    px = planes()
    table, want = frame(spark, px, seed), one_after_the_other(spark, px)
    assert np.array_equal(gathered(R.resample(table, PLAN)), want)
    assert np.array_equal(gathered(bands.resample_banded(table, PLAN, 2)), want)


def test_sums_over_taps_that_are_joined_by_shuffle(spark, monkeypatch):
    px, plain = planes(), {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    monkeypatch.setattr(R, "MOST_SENT", 0)
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        made = R.resample(frame(spark, px), PLAN)
        assert "SortMergeJoin" in made._jdf.queryExecution().executedPlan().toString()
        assert np.array_equal(gathered(made), one_after_the_other(spark, px))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repeated_pixels_add_up_to_the_same(spark):
    rows = [(0, y, x, v) for y in range(4) for x in range(4) for v in (0.1 * (x + 1), 1e12, -1e12, 0.3 + y)]
    got = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        table = spark.createDataFrame(rows, "image_id long, y int, x int, v0 double")
        got.add(tuple(sorted(map(tuple, R.resample(table, PLAN).collect()))))
    assert len(got) == 1


def test_a_colour_space_adds_in_order_too(spark):
    """sigmoidal_rgba's sums, before they become samples again, of so many images that a task's first hash map doesn't take every output."""
    many = 20_000
    px = spark.range(many * 16).selectExpr("id div 16 AS image_id", "CAST(id div 4 % 4 AS INT) AS y", "CAST(id % 4 AS INT) AS x", *(f"id * 2654435761 % 4294967296 div 16777216 AS v{c}" for c in range(4)))
    plan = color.plan_in("sigmoidal", (4, 4), (3, 3), "lanczos3", Format("u8", "rgba", 8))
    curve = np.array([r.v for r in spark.range(256).selectExpr("id AS v0").selectExpr(f"{plan.there[0][0]} AS v").collect()])
    want = one_after_the_other(spark, curve[np.arange(many * 16) * 2654435761 % 4294967296 >> 24].reshape(many, 4, 4))
    made = R.resample(color.convert(px, plan.there, plan.alpha[0]), plan.plan)
    assert np.array_equal(gathered(made.select(*R.KEYS, "v0"), many), want)
