"""A word's counts travel packed: one row a word and task, however many of its neighbours differ."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from pixloom.llm import lm


@pytest.mark.parametrize("counting", ["_neighbours", "_surroundings"])
def test_one_row_for_each_word_of_a_task(counting):
    rng = np.random.default_rng(7)
    texts = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 200, 300)) for _ in range(900)])
    words = np.unique(lm.Words(lm.as_text(texts), 0, len(texts)).hash)
    some, classes = words[::2], 16
    sent = (some, np.arange(len(some)) % (classes - 2), classes)
    sent = SimpleNamespace(value=sent if counting == "_neighbours" else (*sent, 1))
    halves = [pa.record_batch([texts.slice(lo, 450)], ["text"]) for lo in (0, 450)]
    rows = pa.Table.from_batches(getattr(lm, counting)(sent)(iter(halves))).to_pylist()
    rows = [r for r in rows if r["own"] == lm._COUNTS]
    assert len(rows) == len({r["h"] for r in rows}) <= len(words)
    # What is packed are the counts, as the texts have them.
    got = {}
    for r in rows:
        _, at, n = lm._unpacked(pa.array([r["counts"]], pa.binary()))
        got |= {(r["h"], a): c for a, c in zip(at.tolist(), n.tolist(), strict=True)}
    part, want, end = dict(zip(some.tolist(), sent.value[1].tolist(), strict=True)), {}, classes - 1
    w = lm.Words(lm.as_text(texts), 0, len(texts))
    for i in range(len(texts)):
        line = w.row(i).tolist()
        near = [end, *(part.get(h) for h in line), end]
        for k, h in enumerate(line):
            if counting == "_neighbours" and h in part or counting == "_surroundings" and h in part and h % 2 == 0:
                continue
            its = [(0, near[k]), (1, near[k + 2])] + [(2, 0)] * (counting == "_surroundings" and k > 0 and line[k - 1] == h)
            for side, c in its:
                if c is not None:
                    at = (int(np.uint64(h).view(np.int64)), side * classes + c)
                    want[at] = want.get(at, 0) + 1
    assert got == want


def test_large_counts_and_none():
    rows = lm._rows_of(np.array([3, 1, 2], np.uint64), 0, lm._COUNTS, np.array([0, 2, 2, 3]), np.array([0, 128, 4095]), np.array([1, (1 << 43) - 1, 7]))
    row, at, n = lm._unpacked(rows.column(3).slice(1))
    assert (row.tolist(), at.tolist(), n.tolist()) == ([1], [4095], [7])
    row, at, n = lm._unpacked(rows.column(3))
    assert (row.tolist(), at.tolist(), n.tolist()) == ([0, 0, 2], [0, 128, 4095], [1, (1 << 43) - 1, 7])
    assert lm._unpacked(pa.array([b"", b""], pa.binary()))[0].tolist() == []
