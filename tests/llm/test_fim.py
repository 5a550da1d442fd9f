"""The parallel scan against a plain one, and fill-in-middle against its definition."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixloom.llm import fim, queries

DATA = "/root/testdata/sf0.001"


def begins(text, units):
    """Where each unit begins, in code points."""
    if units == "chars":
        return list(range(len(text)))
    if units == "words":
        return [m.start() for m in re.finditer("[^\x20\x09-\x0d]+", text)]
    return [m.start() for m in re.finditer("[^\n]*\n|[^\n]+", text)]


def by_hand(ident, text, units="chars", seed=1, plain=90, spm=20):
    text = text or ""
    at = begins(text, units)
    n = len(at)
    d = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= plain:
        return n, "plain", None, None, text
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    cut = [0 if u == 0 else len(text) if u == n else at[u] for u in (x, y)]
    p, m, s = text[: cut[0]], text[cut[0] : cut[1]], text[cut[1] :]
    if h[3] % 100 < spm:
        return n, "spm", x, y - x, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", x, y - x, f"<P>{p}<S>{s}<M>{m}"


def texts(n=260):
    rng = random.Random(2)
    some = ["", None, " ", "\n", "a", "<P", "x<P>", "<<M>y", "é", "日本語", "a\n\nb\n", "<\U0001f600S>", "\x1c \x0b"]
    for _ in range(n):
        some.append("".join(rng.choice("aé日\U0001f600 \n\t<PSM>x") for _ in range(rng.choice([3, 40, 700, 3000]))))
    return [t if rng.random() < 0.2 else t and re.sub("<([PSM])>", r"<\1", t) for t in some]


@pytest.mark.parametrize("units", ["chars", "words", "lines"])
@pytest.mark.parametrize("piece", [fim.PIECE, 257])
def test_against_the_definition(spark, units, piece):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("x")).withColumn("prefix", F.lit(3)).withColumn("_key", F.col("doc_id"))
    got = fim.fill_in_middle(docs, units=units, piece=piece)
    assert got.columns == ["doc_id", "prefix", "_key", "n", "form", "prefix_units", "middle_units", "output"]
    got = got.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (repr(r[0]), repr(r))
    want = sorted(((i, *by_hand(i, t, units), t or "") for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output, r.again) for r in got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"} and all(r.prefix == 3 and r["_key"] == r.doc_id for r in got)


def test_query_equals_its_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got, want = queries.op12_fill_in_middle(spark, DATA), db.sql(queries.OP12_SQL)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def test_functions_compose_in_any_grouping():
    rng = random.Random(4)
    raw = np.frombuffer("".join(rng.choice("aé <P>S\n") for _ in range(4000)).encode(), np.uint8)
    for units in ("chars", "words", "lines"):
        a = fim.automaton(units)
        cuts = np.array([0, *sorted(rng.sample(range(1, len(raw)), 40)), len(raw)])
        parts = [fim.scan(raw, cuts[i : i + 1], cuts[i + 1 : i + 2], a) for i in range(len(cuts) - 1)]
        left = parts[0]
        for p in parts[1:]:
            left = fim.compose(left, p)
        while len(parts) > 1:
            parts = [fim.compose(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        whole = fim.Scanned(raw, np.array([0, len(raw)]), a)
        state, count = 0, 0
        for b in raw:
            count += a.begins[state, b]
            state = a.next[state, b]
        assert all((x[0] == y[0]).all() and (x[1] == y[1]).all() for x, y in ((left, parts[0]), (left, (whole.next, whole.count))))
        assert (left[0][0, 0], left[1][0, 0]) == (state, count) and a.found[state]


def test_markers_of_any_kind_and_a_giant_text(spark):
    text = "ab " * 100_000 + "é" * 70_001
    docs = spark.createDataFrame([(i, text) for i in range(3)] + [(4, text + "<|mid|>")], "doc_id long, text string")
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    got = {r.doc_id: r for r in fim.fill_in_middle(docs, markers=marks, plain=100, spm=0).withColumn("again", fim.restored(F.col("output"), F.col("form"), marks)).collect()}
    assert [got[i].form for i in (0, 1, 2, 4)] == ["psm"] * 3 + ["plain"]
    for i in range(3):
        assert got[i].again == text and got[i].n == len(text)
        assert len(got[i].output.split("<|suf|>")[0]) == 7 + got[i].prefix_units
    assert fim.fill_in_middle(docs.where("doc_id > 9")).collect() == []
    with pytest.raises(ValueError, match="units"):
        fim.fill_in_middle(docs, units="pages")
