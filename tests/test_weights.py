import itertools

import duckdb
import numpy as np
import pytest

from pixloom.errors import ResampleError
from pixloom.functions.kernels import BC, FILTERS, find_filter
from pixloom.oracle import Sql
from pixloom.plans.weights import nearest_index, weights

SIZES = [(8, 5), (8, 3), (8, 13), (30, 7), (1, 4), (17, 17), (5, 1)]


def test_there_are_53_filters_numbered_from_0():
    assert sorted(f.number for f in FILTERS.values()) == list(range(53))
    assert find_filter(99).name == "bilinear" and find_filter(None).name == "mitchell_netravalli" and find_filter("Lanczos") is FILTERS["lanczos3"]
    with pytest.raises(ResampleError) as e:
        find_filter("sharpest")
    assert e.value.code == 7


@pytest.mark.parametrize("name", [*BC, "spline16", "spline36", "spline64", "bicubic", "cubic", "bilinear"])
def test_partition_of_unity(name):
    k = FILTERS[name].kernel
    for x in np.linspace(0, 1, 21):
        assert abs(k(np.abs(np.arange(-8, 9) + x)).sum() - 1) < 1e-9


@pytest.mark.parametrize("a", [2, 3, 4, 5, 6])
def test_lanczos_at_whole_numbers(a):
    for kind in ("", "_jinc"):
        k = FILTERS[f"lanczos{a}{kind}"].kernel
        assert abs(k(np.zeros(1))[0] - 1) < 1e-9 and k(np.array([a + 0.5]))[0] == 0
    assert np.allclose(FILTERS[f"lanczos{a}"].kernel(np.arange(1.0, a)), 0, atol=1e-12)


def test_published_constants():
    assert BC["robidoux"] == pytest.approx((0.37821575509399867, 0.31089212245300067))
    assert BC["robidoux_sharp"] == pytest.approx((0.2620145123990142, 0.3689927438004929))


@pytest.mark.parametrize("name,sizes", list(itertools.product(FILTERS, SIZES)))
def test_fixed_taps_sum_to_one(name, sizes):
    w = weights(*sizes, name)
    for o in range(sizes[1]):
        assert w.fixed[o].sum() == (32767 if w.size[o] == 1 else 32768)
        assert w.fixed[o, w.size[o] :].sum() == 0
        assert abs(w.taps[o].sum() - 1) < 1e-6 or not w.taps[o].any() or name in ("bartlett", "ginseng")


def test_equal_filters():
    same = [("ewa_quadric", "ewa_robidoux", "ewa_robidoux_sharp", "ewa_blackman", "ewa_catmull_rom", "ewa_mitchell_netravalli"), ("ewa_ginseng", "ewa_lanczos_sharp", "ewa_lanczos_soft")]
    for group in same:
        for sizes in SIZES:
            first = weights(*sizes, group[0]).taps
            assert all(np.array_equal(first, weights(*sizes, g).taps) for g in group[1:])
    assert np.array_equal(weights(30, 7, "box").fixed, weights(30, 7, "area").fixed)


def test_cases_worked_by_hand():
    bilinear = weights(4, 8, "bilinear")
    assert bilinear.taps[3].tolist() == [0, 1] and bilinear.taps[2].tolist() == [0.25, 0.75]
    assert weights(4, 8, "catmull_rom").fixed[0].tolist()[:2] == [32767, 1]
    assert sorted(weights(8, 4, "box").fixed[1].tolist())[-7:] == [4681] * 6 + [4682]
    assert nearest_index(8, 3).tolist() == [1, 3, 6]


@pytest.mark.parametrize("name", [n for n in FILTERS if n != "nearest"])
def test_sql_computes_the_same_taps(name):
    db = duckdb.connect()
    for a, b in SIZES[:5]:
        s = Sql("SELECT 1", 1)
        last = s.weights(a, b, name)
        found = db.sql(f"WITH {', '.join(s.parts)} SELECT i, j, wq FROM {last} ORDER BY 1, 2").fetchall()
        assert found == [(o, i, q) for o, i, _, _, q in weights(a, b, name).rows()]
