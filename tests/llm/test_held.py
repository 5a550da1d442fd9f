"""What a task holds of words while it counts doesn't grow with the texts that come in a batch."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from pixloom.llm import lm


@pytest.mark.parametrize("counting", ["_neighbours", "_surroundings", "_far_surroundings", "_class_pairs"])
def test_numbers_held_while_words_are_counted(counting):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 3000) % 300_000) for _ in range(420)]
    words = np.unique(lm.Words(lm.as_text(pa.array(texts)), 0, 420).hash)
    some, classes = words[::3], 16
    known = (some, np.arange(len(some)) % (classes - 2), classes)
    sent = SimpleNamespace(value=known if counting in ("_neighbours", "_class_pairs") else (*known, 1))
    batch = pa.record_batch([pa.array(texts)], ["text"])
    assert batch.nbytes > 4 << 20
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in getattr(lm, counting)(sent)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows and most < 64 << 20
