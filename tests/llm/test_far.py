"""Words beyond those whose classes all tasks know count as neighbours in a round all the same."""

import random

import pytest
from pyspark.sql import functions as F

from pixloom.llm import common, lm


@pytest.mark.parametrize("known", [0, 7, 30])
def test_a_round_does_not_depend_on_how_many_words_tasks_know(spark, monkeypatch, known):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, weights=range(1, 61), k=rng.randrange(1, 40))) for _ in range(60)] + ["", None, "w1 w1 w1 w0 w0"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counted = frame.mapInArrow(lm._word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    classes = 8
    vocabulary = common.stored(counted.select("h", "n", F.pmod("h", F.lit(classes - 2)).alias("part")), "vocabulary")
    seen = {}
    for most in (1 << 19, known):
        monkeypatch.setattr(lm, "KNOWN", most)
        seen[most] = {r.h: r.part for r in lm.sweep(frame, vocabulary, classes, 1).collect()}
    top = {r.h for r in common.most_frequent(vocabulary, known).collect()} if known else set()
    may = {h for h in seen[known] if h % 2 or h not in top}
    own = {r.h: r.part for r in vocabulary.collect()}
    assert all(seen[known][h] == own[h] for h in seen[known].keys() - may)
    # Words of this round's half move as they do when all are known.
    half = [h for h in seen[known] if h % 2]
    assert len(half) > 10 and sum(seen[1 << 19][h] != own[h] for h in half) > 5
    assert all(seen[known][h] == seen[1 << 19][h] for h in half)
