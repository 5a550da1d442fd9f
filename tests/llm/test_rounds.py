"""Rounds over all words: no join by word, and equal rows weighed once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixloom.llm import common, lm


def test_a_round_over_known_words_needs_no_join(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=30)) for _ in range(40)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counted = frame.mapInArrow(lm._word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    vocabulary = common.stored(counted.select("h", "n", F.pmod("h", F.lit(6)).alias("part")), "vocabulary")

    def refused(*_, **__):
        raise AssertionError("a join by word")

    monkeypatch.setattr(type(frame), "join", refused)
    after = lm.sweep(frame, vocabulary, 8, 1).collect()
    assert {(r.h, r.n) for r in after} == {(r.h, r.n) for r in vocabulary.collect()}


def weighed_row_by_row(matrix, own, word, side, part, n):
    """exchange() as it was before equal rows were weighed once."""
    count, classes, n = len(own), len(matrix), n.astype(float)
    itself = np.bincount(word[side == 2], n[side == 2], minlength=count)
    sides = np.zeros((2, count, classes))
    np.add.at(sides, (side[side < 2], word[side < 2], part[side < 2]), n[side < 2])
    every = np.arange(count)
    sides[:, every, own] -= itself
    gain = np.zeros((count, classes))
    for c in range(count):
        m = matrix.copy()
        left, right, o, alone = sides[0][c], sides[1][c], own[c], itself[c]
        m[o] -= right
        m[:, o] -= left
        m[o, o] -= alone
        for to in range(classes):
            moved = m.copy()
            moved[to] += right
            moved[:, to] += left
            moved[to, to] += alone
            gain[c, to] = lm.likelihood(moved)
    return gain


@pytest.mark.parametrize("seed", range(3))
def test_rows_weighed_once_choose_as_the_likelihood_does(seed):
    rng = np.random.default_rng(seed)
    classes, words = 9, 30
    own, text = rng.integers(0, classes - 2, words), rng.integers(0, words, 2000)
    parts = np.concatenate([[classes - 1], own[text], [classes - 1]])
    matrix = np.zeros((classes, classes))
    np.add.at(matrix, (parts[:-1], parts[1:]), 1)
    same = np.concatenate([[False], text[1:] == text[:-1]])
    keys = np.concatenate([text * 27 + parts[:-2], text * 27 + 9 + parts[2:], text[same] * 27 + 18])
    key, n = np.unique(keys, return_counts=True)
    got = lm.exchange(matrix, own, key // 27, key % 27 // 9, key % 9, n)
    gain = weighed_row_by_row(matrix, own, key // 27, key % 27 // 9, key % 9, n)[:, : classes - 2]
    assert np.all(gain[np.arange(words), got] >= gain.max(1) - 1e-6) and (got != own).any()
