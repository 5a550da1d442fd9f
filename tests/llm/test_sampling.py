"""Consistent weighted sampling against the generalised Jaccard likeness that it estimates, and edits against their definition."""

import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from pixloom.llm import queries, sampling

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def bag(text):
    return collections.Counter(WORD.findall((text or "").lower()))


def jaccard(a, b):
    return sum(min(a[t], b[t]) for t in a | b) / max(1, sum(max(a[t], b[t]) for t in a | b))


def edits(rows):
    """(n_chars, edited text, next text) of each id, in order."""
    rows = sorted((i, t or "") for i, t in rows)
    after = [*rows[1:], rows[0]]
    return {i: (len(t), t[: len(t) - len(t) // 2] + n[: len(t) // 2], n) for (i, t), (_, n) in zip(rows, after, strict=True)}


def test_agreement_estimates_the_weighted_jaccard_likeness(spark):
    rng = random.Random(5)
    pairs = []
    for i in range(60):
        a = {t: rng.choice([1, 1, 1, 2, 3, 7, 40]) for t in rng.sample(range(400), rng.randrange(1, 120))}
        b = dict(a)
        for t in rng.sample(range(400), rng.randrange(0, 120)):
            b[t] = rng.choice([0, 1, 2, 5, 30])
        pairs.append((a, {t: w for t, w in b.items() if w} or {0: 1}))
    rows = [(2 * i + j, t, w) for i, p in enumerate(pairs) for j, bag in enumerate(p) for t, w in bag.items()]
    terms = spark.createDataFrame(rows, "key long, t long, weight long").withColumn("term", F.xxhash64("t")).drop("t")
    k = 256
    drawn = {r.key: r.samples for r in sampling.draw(terms, ["key"], k).collect()}
    assert len(drawn) == 120 and all(len(s) == k * sampling.DIGITS for s in drawn.values())
    total = 0
    for i, (a, b) in enumerate(pairs):
        x, y = drawn[2 * i], drawn[2 * i + 1]
        share = sum(x[j : j + 4] == y[j : j + 4] for j in range(0, len(x), 4)) / k
        want = jaccard(collections.Counter(a), collections.Counter(b))
        assert abs(share - want) < 4.5 * (want * (1 - want) / k) ** 0.5 + 0.01
        total += share - want
    assert abs(total / 60) < 4 * 0.5 / (60 * k) ** 0.5  # no bias


def test_terms_are_counted_words(spark):
    texts = {1: "b a B  a\tc a", 2: None, 3: " \n", 4: "x", 5: "A a \x1c a"}
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = collections.defaultdict(list)
    for r in sampling.weighted_terms(frame, "text", ["id"]).collect():
        got[r.id].append((r.term, r.weight))
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in ("a", "b", "c", "x", "\x1c")], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for i, text in texts.items():
        assert sorted(got[i], key=str) == sorted([(hashes[w], n) for w, n in bag(text).items()] or [(None, None)], key=str)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, got = edits(rows), {r.doc_id: r for r in queries.op13_weighted_fingerprint(spark, DATA).collect()}
    assert len(got) == len(rows) and set(got) == set(want)
    off = []
    for (i, text), nxt in zip(sorted(rows), [*sorted(rows)[1:], sorted(rows)[0]], strict=True):
        r, (n, edited, after) = got[i], want[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for near, mine, other, of in ((r.near_edited, r.fingerprint, r.edited_fingerprint, edited), (r.near_next, r.fingerprint, got[nxt[0]].fingerprint, after)):
            if mine and other:
                assert near == sum(mine[j : j + 4] == other[j : j + 4] for j in range(0, len(mine), 4)) / sampling.SAMPLES
            else:
                assert near == float(mine == other)
            off.append(near - (jaccard(bag(text), bag(of)) if bag(text) or bag(of) else 1.0))
    assert abs(sum(off) / len(off)) < 0.03 and sum(map(abs, off)) / len(off) < 0.08
    by_text = collections.defaultdict(set)
    for i, text in rows:
        by_text[text].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "one"), (5, "One"), (5, "One"), (5, "other"), (None, "zwei Wörter 日本"), (7, "é " * 40001), (8, "x" * 70000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n_chars", F.lit("x")).withColumn("_text", F.lit(2.0))
    got = sampling.fingerprint_edits(docs).collect()
    assert len(got) == 9  # (5, "One") is there once
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [len(by[i]) for i in (1, 2, 3, 4, 5, None, 7, 8)] == [1, 1, 1, 1, 2, 1, 1, 1]
    assert by[1][0].fingerprint == by[2][0].fingerprint == by[3][0].fingerprint == ""
    assert by[1][0].near_next == 1.0 and by[3][0].near_next == 0.0 and by[1][0].n_chars == 0
    assert by[4][0].fingerprint in {r.fingerprint for r in by[5]}  # capitals fold
    null = by[None][0]
    assert null.edited_sha256 == hashlib.sha256("zwei Wö".encode()).hexdigest()  # the next, id 1, has no text
    last = by[8][0]
    assert last.edited_sha256 == hashlib.sha256(("x" * 35000 + "zwei Wörter 日本").encode()).hexdigest()
    one = sampling.fingerprint_edits(docs.where("doc_id = 4")).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"ono").hexdigest()
    assert sampling.fingerprint_edits(docs.where("doc_id > 100")).collect() == []


def test_main_path_has_no_python(spark):
    plan = queries.op13_weighted_fingerprint(spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
