"""What travels to the slabs of the join by n-grams."""

import random

from pyspark.sql import functions as F

from pixloom.llm import ngram_join


def test_small_slabs_travel_without_sketches(spark, monkeypatch):
    """Rows of slabs of up to three hold no hashes; pairs are the same."""
    rng = random.Random(4)
    own = [rng.choices([f"w{i}" for i in range(90)], k=40) for _ in range(12)]
    rows = [(i, " ".join(x if rng.random() > (0.01, 0.02, 0.1)[i % 3] else f"x{rng.randrange(50)}" for x in own[i // 10])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    frame = type(docs)
    repartition = frame.repartition

    def watched(self, *by):
        if by == ("item",):
            seen.append(self.select("item", F.expr("key <> 0 OR exists(sketch, x -> x <> 0)").alias("hashes")).groupBy("item").agg(F.count("*").alias("n"), F.max("hashes").alias("hashes")).collect())
        return repartition(self, *by)

    monkeypatch.setattr(frame, "repartition", watched)
    got = sorted(map(tuple, ngram_join.link_documents(docs).collect()))
    assert seen[0] and all(r.hashes == (r.n > 3) for r in seen[0]) and {r.n > 3 for r in seen[0]} == {False, True}
    monkeypatch.setattr(ngram_join, "_FEW", 0)
    assert got == sorted(map(tuple, ngram_join.link_documents(docs).collect())) and all(r.hashes for r in seen[1])
