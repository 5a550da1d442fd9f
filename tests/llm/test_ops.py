"""Each operator against a brute-force version, an exact round trip or held-out accuracy; and its awkward inputs."""

import collections
import hashlib
import io
import math
import random
import re
import time
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixloom.llm import common, decontam, embed, langid, lines, lm, mixing, ngram_join, pii, queries, spans, textkit, warc

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for n in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, db, name):
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.sql(queries.ORACLES[name])
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def corpus(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


AWKWARD = [
    (1, None, "en", "b"), (2, "", "en", None), (3, " \t ", None, "b"), (4, "one", "en", "a"), (5, "one", "en", "a"), (5, "one", "en", "a"),
    (None, "two words", "de", None), (None, None, None, None), (7, "Ünïcödé ßtraße " * 4000, "de", "z"), (8, "x" * 60000, "en", "z"), (9, "0 1 2", "xx", "z"),
]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string").withColumn("h", F.lit(1)).withColumn("n", F.lit("other")).withColumn("key", F.lit(2.0))


# ---- words -------------------------------------------------------------------------------------------------------


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["A bc\tABC\n", "", None, "é É  e\x0b\x1cf", "abc a BC", "日本 語", "a\0 a", " ".join("abcdefghijklmnopqrstuvwxyz"[:n] for n in range(1, 27)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefgh"]
    column = textkit.as_text(pa.array(texts))
    seen = {}
    for size in (1, 1 << 20):
        rows = [w.row(i).tolist() for lo, hi in textkit.slices(column, size) for w in [textkit.Words(column, lo, hi)] for i in range(hi - lo)]
        for text, row in zip(texts, rows, strict=True):
            for word, h in zip(words(text), row, strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def mirrored(a, b, n=1024):
    """Two sequences of a and b that sums of powers modulo 2 ** 64 can't tell apart."""
    signs = [bin(i).count("1") % 2 for i in range(n)]
    return [(a, b)[s] for s in signs], [(b, a)[s] for s in signs]


def test_words_and_sequences_that_cancel_out_in_sums_of_powers(spark):
    import pyarrow as pa

    one, two = ("".join(x) for x in mirrored("a", "b"))
    w = textkit.Words(textkit.as_text(pa.array([one, two])), 0, 2)
    assert w.hash[0] != w.hash[1] and w.exact().tolist() == [0, 1]
    long_one, long_two = (" ".join(x) for x in mirrored("a", "b"))
    s = spans.Sentences(textkit.as_text(pa.array([long_one + ".", long_two + "."])), 0, 2)
    assert s.hash1[0] != s.hash1[1]
    docs = [(1, one), (2, two), (3, f"x y z {one} q"), (4, f"x y z {two} q")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.component_id for r in ngram_join.link_documents(frame).collect()) == [1, 2, 3, 4]
    assert [(r.doc_id, r.item_id) for r in decontam.find_leaks(frame.where("doc_id < 3"), spark.createDataFrame([(7, one)], "item_id long, text string")).collect()] == [(1, 7)]
    assert {r.doc_id: r.n_known for r in lm.score(frame, F.col("doc_id") == 1).collect()} == {1: 2, 2: 1, 3: 1 + 1, 4: 1}


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a line of ten. " * 3, "x"), (2, "a line of ten. " * 3, "y")], "doc_id long, text string, _doc string").withColumn("_hashes", F.lit(1)).withColumn("_drops", F.lit(2))
    for got in (lines.dedup_lines(docs), spans.dedup_spans(docs)):
        assert got.columns[:5] == docs.columns and sorted((r._doc, r._hashes, r._drops) for r in got.collect()) == [("x", 1, 2), ("y", 1, 2)]


def test_join_by_key_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = common.stored(spark.createDataFrame([(0 if i < 60 else i % 17, i) for i in range(100)], "k long, i long"), "rows")
    facts = common.stored(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least")).where("n > 1"), "facts")
    want = rows.join(facts.drop("n"), "k")
    assert sorted(map(tuple, common.join_by_key(rows, facts, ["k"], "n").collect())) == sorted(map(tuple, want.collect()))
    common.discard(rows)
    assert common.by_ids(facts, facts.select("k").where("k > 3"), "k", "left_anti").count() == facts.where("k <= 3").count()


def test_most_frequent_keeps_within_its_bound(spark):
    rows = common.stored(spark.createDataFrame([(i, n) for i, n in enumerate([900, 300, 300, 40, 40, 40, 7, 1, 1, 1, 1])], "h long, n long"), "counts")
    sizes = {most: sorted(r.n for r in common.most_frequent(rows, most).collect()) for most in (0, 1, 2, 3, 5, 11, 50)}
    assert sizes[0] == [] and sizes[1] == sizes[2] == [900] and sizes[3] == sizes[5] == [300, 300, 900] and len(sizes[11]) == len(sizes[50]) == 11


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class sparkContext:
            applicationId, master = "other", "spark://host"

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="share"):
        common.scratch(Session)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 -----------------------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (3, 12, 25, 40, 60, 60)]
    docs = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 200))) for _ in range(20)]
    for i, item in enumerate(items):
        own = item.split()
        docs.append(" ".join(rng.choices(vocabulary, k=30) + own + rng.choices(vocabulary, k=30)))
        changed = own[:]
        if len(own) > 20:
            changed[0] = "changed"
        docs.append(" ".join(rng.choices(vocabulary, k=7) + changed).upper().replace(" ", ", "))
        docs.append(" ".join(own[: len(own) // 2]))
    docs.append(items[3].rsplit(" ", 1)[0])  # a little shorter than the item
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}

    def shingles(w, k):
        return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    want = {}
    for d, text in enumerate(docs):
        w = re.findall(r"[a-z0-9]+", text.lower())
        for i, item in enumerate(items):
            t = item.split()
            k, n = min(5, len(t)), min(len(t), len(w))
            for s in range(len(w) - n + 1 if n >= k else 0):
                a, b = shingles(w[s : s + n], k), shingles(t, k)
                j = (a & b).total() / (a | b).total()
                if j >= 0.8:
                    want[d, i] = max(want.get((d, i), 0), j)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 10


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 1 << 16, (300, decontam.BLOCKS)).astype(np.uint16)
    wanted = prints.copy()
    for i in range(300):
        for bit in rng.choice(decontam.BITS, i % 70, replace=False):
            wanted[i, bit // 16] ^= np.uint16(1 << (bit % 16))
    away = np.bitwise_count(wanted[:, None] ^ prints[None, :]).sum(2)
    for radius in (0, 20, 40, 63):
        a, b = decontam.MultiIndex(prints, radius).near(wanted)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(away <= radius)), strict=True))
    # Of fingerprints that have nothing to do with each other few are compared at all.
    index = decontam.MultiIndex(prints)
    assert len(index.looked_up(rng.integers(0, 1 << 16, (300, decontam.BLOCKS)).astype(np.uint16))[0]) < 0.015 * 300 * 300


def test_fingerprints_recall_near_the_threshold():
    """Windows as similar to an item as 0.8 to 0.9: nearly all have fingerprints within the radius."""
    rng = np.random.default_rng(2)
    inside = collections.Counter()
    for _ in range(3000):
        m = int(rng.integers(20, 90))
        item = rng.integers(0, 1 << 63, m).astype(np.uint64)
        other = item.copy()
        lost = rng.choice(m, int(rng.integers(1, max(2, m // 8))), replace=False)
        other[lost] = rng.integers(0, 1 << 63, len(lost)).astype(np.uint64)
        like = decontam.weighted_similarity(item, other)
        if like >= 0.8:
            away = np.bitwise_count(decontam.simhash(item) ^ decontam.simhash(other)).sum()
            inside[like < 0.85, bool(away <= decontam.RADIUS)] += 1
    near, far = (inside[x, True] / (inside[x, True] + inside[x, False]) for x in (True, False))
    assert inside[True, True] > 300 and near > 0.995 and far > 0.999


def test_leaks_awkward(spark):
    items = spark.createDataFrame([(1, "one"), (1, "one"), (None, "two words"), (3, None), (4, "")], "item_id long, text string").withColumn("similarity", F.lit(0))
    got = sorted(map(repr, decontam.find_leaks(awkward(spark), items).select("doc_id", "item_id").collect()))
    assert got == sorted(["Row(doc_id=4, item_id=1)"] * 2 + ["Row(doc_id=5, item_id=1)"] * 4 + ["Row(doc_id=None, item_id=None)"])
    assert decontam.find_leaks(awkward(spark).limit(0), items).count() == 0
    assert decontam.find_leaks(awkward(spark), items.limit(0)).count() == 0


# ---- 2 -----------------------------------------------------------------------------------------------------------


def joined(rows, k=5):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("seed", range(3))
def test_join_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    common_line = "this very line stands in every second text of them"
    rows = []
    for base in range(12):
        own = rng.choices(vocabulary, k=rng.choice([1, 4, 5, 6, 9, 40, 120, 400]))
        for _ in range(rng.choice([1, 2, 12])):
            w = own[:]
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
            rows.append((len(rows), f"{text} {common_line}" if base % 2 else text.upper()))
    rows += [(1000, None), (1001, ""), (1002, rows[0][1])]
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == joined(rows)


def test_join_of_a_dense_family(spark):
    """Many near copies around the threshold: only some pairs link, leaves hold hundreds."""
    rng = random.Random(9)
    own = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        w = own[:]
        for at in rng.sample(range(60), rng.randint(0, 2)):
            w[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == joined(rows)


def test_join_packs_full_slabs(spark, monkeypatch):
    """A slab of many leaves and inner nodes gives what comparing all gives."""
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    monkeypatch.setattr(ngram_join, "INNER", 3)
    rng = random.Random(19)
    start = "these very words stand at the head of them all"
    own = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(250):
        w = rng.choices([f"v{i}" for i in range(400)], k=rng.randint(8, 60)) if i % 5 else own[: rng.randint(30, 50)]
        for at in rng.sample(range(len(w)), rng.randint(0, 1)):
            w[at] = f"x{rng.randrange(40)}"
        rows.append((i, f"{start} {' '.join(w)}"))
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == joined(rows)


def test_join_bounds():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60)).astype(np.uint64) * np.uint64(2))
        keep = a[rng.random(len(a)) < 0.93]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 4)).astype(np.uint64)]))
        if len(b) and ngram_join.linked(a, b, 80):
            fa, fb = (ngram_join.group_counts(x, ngram_join.fine_groups(len(x))) for x in (a, b))
            assert ngram_join.may_link(len(a), len(b), fa, fb, 80)
            assert np.intersect1d(a[: ngram_join.lead_length(len(a))], b[: ngram_join.lead_length(len(b))]).size


def test_join_awkward(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_documents(awkward(spark)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, None), (None, 0, None), (8, 1, 8)} <= got
    assert ngram_join.link_documents(awkward(spark).limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "a b c"), (3, "d e f")], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.link_documents(twice).collect()} == {1}


# ---- 3 -----------------------------------------------------------------------------------------------------------


def test_mix(spark):
    rows = [r.asDict() for r in mixing.mix(corpus(spark)).collect()]
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        assert r["position"] is None or 0 <= r["position"] <= 1
    total = sum(r["size"] for r in rows)
    targets, capped = {}, set()
    order = sorted(by)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r["size"] for r in by[s]) for s in order}
    while True:  # share, cap, share the excess again
        left = 1.5 * total - sum(2 * size[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        targets = {s: 2.0 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if targets[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert by[s][0]["target"] == pytest.approx(targets[s]) and by[s][0]["source_size"] == size[s]
        assert sum(r["taken"] for r in by[s]) == math.floor(by[s][0]["target"] + 1e-9)
    placed = [r["position"] for r in rows if r["position"] is not None]
    assert placed == sorted(placed)


def test_schedule_is_inverted():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    frame = spark.range(0, 101).select((F.col("id") / 100).alias("t"))
    for start, end in ((1.0, 0.5), (1.0, 1.0), (1.0, 2.0)):
        share = (start * F.col("t") + (end - start) * F.col("t") ** 2 / 2) / ((start + end) / 2)
        rows = frame.select("t", mixing.position_of(share, F.lit(start), F.lit(end)).alias("p")).collect()
        assert all(abs(r.t - r.p) < 1e-9 for r in rows)


def test_mix_awkward(spark):
    got = mixing.mix(awkward(spark)).collect()
    assert len(got) == len(AWKWARD) and all(r.target >= 0 for r in got)
    assert mixing.mix(awkward(spark).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(awkward(spark).where("size(split(text, ' ')) < 1 OR text IS NULL")).collect()] == [0, 0]


def test_mix_is_native(spark):
    plan = mixing.mix(corpus(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- 4 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    big, small = "<p>" + "é" * 600, "<p>small"
    pages = [(1, "http://a/ b", big), (2, None, big), (3, "http://c/", small), (4, "http://d", small), (5, "http://e", None), (9, "http://f", big), (9, "http://f", big), (None, "http://g", big), (11, "http://h", "<html>\r\n\r\nHTTP/1.1 x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("file", F.lit(1))
    got = warc.archive(frame, version).collect()
    assert len(got) == len(pages)
    for page, html in {(p, h) for p, _, h in pages}:
        raw = (html or "").encode()
        for r in (r for r in got if r.page_id == page):
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds[9, "response", None] == 1 and kinds[9, "revisit", 9] == 1 and kinds[1, "revisit", 9] == kinds[2, "revisit", 9] == kinds[None, "revisit", 9] == 1
    assert kinds[3, "response", None] == kinds[4, "response", None] == kinds[5, "response", None] == 1
    assert len({r.warc_id for r in got if r.page_id != 9}) == len(pages) - 2 and {r.warc_date for r in got} == {"2024-01-01T00:00:00Z"}
    assert warc.archive(frame.limit(0), version).count() == 0


def test_arc_lengths_are_held_to():
    block = warc.http_block(7, b"body")
    header, record = warc.arc_file_header(1, "n", "2009"), warc.arc_record(1, "http://x/a b", "2009", block)
    read = lambda *parts: [(r.url, r.block) for _, r in warc.read_arc(io.BytesIO(b"".join(parts)))]
    assert read(header, record) == [("http://x/a b", block)]
    assert warc.warc_date("2009") == "2009-01-01T00:00:00Z" and warc.warc_date("20090203040506") == "2009-02-03T04:05:06Z"
    with pytest.raises(ValueError, match="declared"):
        read(header, record[:-9])
    with pytest.raises(ValueError, match="fields"):
        read(warc.arc_file_header(2, "n", "2009"), record.replace(b"a b", b"a"))
    # Uncompressed, a member a record, all in one, and cut anywhere.
    parts = [warc.arc_file_header(2, "n", "2009"), warc.arc_record(2, "u", "2009", block), warc.arc_record(2, "v", "2010", b"x\n\n" * 200000), warc.arc_record(2, "w", "2010", b"")]
    whole, want = b"".join(parts), [("u", block), ("v", b"x\n\n" * 200000), ("w", b"")]
    for packed in ([whole], map(warc.member, parts), [warc.member(whole)], map(warc.member, (whole[:90], whole[90:300000], whole[300000:]))):
        assert read(*packed) == want


def test_old_records_with_wrong_lengths_give_rows(spark, tmp_path):
    block = b"HTTP/1.0 200 OK\r\nContent-Length: 7\r\n\r\n" + b"longer than stated" * 100
    parts = [warc.arc_file_header(1, "n", "2009"), warc.arc_record(1, "u", "2009", block), warc.arc_record(1, "v", "2009", block), warc.arc_record(1, "w", "2009", b"no http at all")]
    (tmp_path / "old.arc").write_bytes(b"".join(parts))
    files = spark.createDataFrame([(f"file://{tmp_path}/old.arc", 3)], "file string, records long")
    got = sorted((r.url, r.payload_bytes, r.record_type, r.intact) for r in warc.read_warc(warc.convert(warc.index_arc(files))).collect())
    assert got == [("u", 1800, "revisit", None), ("v", 1800, "response", True), ("w", 14, "response", True)]


# ---- 5 -----------------------------------------------------------------------------------------------------------


def test_language_model(spark):
    rows = [(r.doc_id, r.text) for r in corpus(spark).collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = collections.Counter()
    for i, t in rows:
        if not held[i]:
            counts.update([*words(t), None])
    total, distinct = counts.total(), len(counts)
    got = {r.doc_id: r for r in queries.op5_class_lm(spark, DATA).collect()}
    for i, t in rows:
        tokens, r = [*words(t), None], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens))
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    out = [got[i] for i in got if held[i]]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_exchange_gain_is_the_likelihoods(spark):
    rng = np.random.default_rng(0)
    n, k = 12, 4
    pairs = rng.integers(0, 20, (n, n)).astype(float)
    part = rng.integers(0, k, n)

    def matrix(p):
        m = np.zeros((k, k))
        np.add.at(m, (p[:, None], p[None, :]), pairs)
        return m

    for w in range(n):
        left, right = (np.bincount(part, pairs[:, w], minlength=k), np.bincount(part, pairs[w], minlength=k))
        best = lm.best_class(matrix(part), int(part[w]), left, right, pairs[w, w])
        scores = []
        for c in range(k):
            moved = part.copy()
            moved[w] = c
            scores.append(lm.likelihood(matrix(moved)))
        assert scores[best] == pytest.approx(max(scores))


def test_leaving_words_go_where_the_likelihood_grows_most():
    rng = np.random.default_rng(1)
    n, k = 9, 7
    other = k - 2
    part = np.append(rng.integers(0, other, n), [k - 1])  # core words and the end; no pair of words of the class of others
    pairs = rng.integers(0, 9, (n + 1, n + 1)).astype(float)
    words = [(rng.integers(0, 4, n + 1), rng.integers(0, 4, n + 1)) for _ in range(40)]

    def matrix(places):
        m = np.zeros((k, k))
        np.add.at(m, (part[:, None], part[None, :]), pairs)
        for (left, right), c in zip(words, places, strict=True):
            np.add.at(m, (part, c), left)
            np.add.at(m, (c, part), right)
        return m

    whole = matrix([other] * 40)
    rows = [(i, side, c, x) for i, sides in enumerate(words) for side in (0, 1) for c, x in enumerate(np.bincount(part, sides[side], minlength=k)) if x]
    got = lm.leave(whole, *(np.array(x) for x in zip(*rows, strict=True)))
    for i in range(40):
        scores = [lm.likelihood(matrix([other] * i + [c] + [other] * (39 - i))) for c in range(k - 1)]
        assert scores[got[i]] == pytest.approx(max(scores), abs=1e-6)


@pytest.mark.parametrize("known", [1 << 19, 50])
def test_scores_against_brute_force(spark, monkeypatch, known):
    """Every class count, transition and emission from the texts themselves, whether words are sent to tasks or joined."""
    import pyarrow as pa

    monkeypatch.setattr(lm, "KNOWN", known)
    docs = [(r.doc_id, r.text) for r in corpus(spark).limit(90).collect()] + [(900, None), (901, "never seen before and never again")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    train = [words(t) for i, t in docs if i % 3 and i < 900]
    model, vocabulary = lm.train(frame.where("doc_id % 3 <> 0 AND doc_id < 900"))
    facts = {r.h: (r.n, r.part) for r in vocabulary.collect()}
    key = lru_cache(None)(lambda w: int(textkit.Words(textkit.as_text(pa.array([w])), 0, 1).hash.view(np.int64)[0]))
    counts = collections.Counter(w for t in train for w in t)
    assert {key(w): n for w, n in counts.items()} == {h: n for h, (n, _) in facts.items()}
    k, end = lm.CLASSES, lm.CLASSES - 1
    total, size = np.zeros(k), np.zeros(k)
    for w, n in counts.items():
        total[facts[key(w)][1]] += n
        size[facts[key(w)][1]] += 1
    total[end], size[end] = len(train), 1
    m = np.zeros((k, k))
    for t in train:
        c = [end, *(facts[key(w)][1] for w in t), end]
        np.add.at(m, (c[:-1], c[1:]), 1)
    n_all, v = sum(counts.values()) + len(train), len(counts) + 1
    share = (total + lm.ALPHA) / (total.sum() + lm.ALPHA * k)
    row = lambda c: share if c is None else (m[c] + lm.ALPHA) / (m[c].sum() + lm.ALPHA * k)
    emit = lambda n, c: (n + lm.DELTA) / (total[c] + lm.DELTA * (size[c] + 1))
    got = {r.doc_id: r for r in lm.score(frame, (F.col("doc_id") % 3 != 0) & (F.col("doc_id") < 900)).collect()}
    assert len(set(p for _, p in facts.values())) > 20 or known < 100
    for i, text in docs:
        before, score = end, 0.0
        for w in [*words(text), None]:
            n, c = (len(train), end) if w is None else facts.get(key(w), (0, None))
            p = sum(row(before)[x] * emit(0, x) for x in range(k)) if c is None else row(before)[c] * emit(n, c)
            score += math.log10(lm.MIX * p + (1 - lm.MIX) * (n + 1) / (n_all + v + 1))
            before = c
        assert got[i].score == pytest.approx(score) and got[i].n_known == sum(w in counts for w in words(text)) + 1
    h = np.array(list(facts), np.int64)
    part, c = np.append([facts[x][1] for x in h], end), np.append([facts[x][0] for x in h], len(train))
    for prior in (0, end, model.unseen):
        assert 0.9 < model.full(np.full(len(c), prior), part, c).sum() < 1  # the rest is for words not seen


def test_language_model_awkward(spark):
    docs = awkward(spark)
    got = lm.score(docs, F.coalesce(F.col("doc_id"), F.lit(0)) < 8).collect()
    assert len(got) == len(AWKWARD) and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in got)
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0
    assert {r.base_score for r in lm.score(docs, F.lit(False)).collect()} == {0.0}


# ---- 6 -----------------------------------------------------------------------------------------------------------


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((8, 16))
    vectors = [(b + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.3])).tolist() for b in base for _ in range(12)]
    rows = [(i, v, int(rng.integers(0, 2))) for i, v in enumerate(vectors)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] + [1.0] * 15, 0), (203, vectors[0], None), (204, [None] + [1.0] * 15, 1), (205, [float("inf")] * 16, 1), (206, [], 0), (207, (np.array(vectors[0]) * 1e300).tolist(), rows[0][2])]
    got = {r.vec_id: r for r in embed.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))).collect()}
    good = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = collections.defaultdict(set)
    for i, x, l in good:
        for j, y, m in good:
            if i != j and l == m and (x / abs(x).max()) @ (y / abs(y).max()) / np.linalg.norm(x / abs(x).max()) / np.linalg.norm(y / abs(y).max()) >= 0.93:
                links[i].add(j)
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), i == min(seen))
    assert sum(map(len, links.values())) > 100


def test_estimates_are_unbiased_and_within_their_confidence():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 70))
    x[20:] = x[:20] + rng.standard_normal((20, 70)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true, total, off = x @ x.T, np.zeros((40, 40)), []
    near = (true > 0.9) & (true < 0.9999)
    for seed in range(300):
        codes = embed.encode(x, seed)
        guess = embed.estimate(codes, codes)
        total += guess
        off.append(((guess - true) / embed.deviation(codes, codes, 0.9))[near])
        assert embed.candidates(codes, codes, 0.93)[true >= 0.93].all()
        assert embed.candidates(codes, codes, 0.93).sum() < 0.2 * 40 * 40
    assert abs(total / 300 - true).max() < 0.06
    assert np.abs(off).max() < embed.CONFIDENCE and np.std(off) < 1.1


def test_embeddings_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(8) + rng.standard_normal(8) * 0.2).tolist(), 1) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, embed.link_embeddings(frame).collect()))
    monkeypatch.setattr(embed, "BLOCK", 40)
    assert sorted(map(tuple, embed.link_embeddings(frame).collect())) == whole
    assert embed.link_embeddings(frame.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1), (2, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(repr, map(tuple, embed.link_embeddings(odd).collect()))) == ["(1, 1, 1, True)"] * 2 + ["(2, 0, 2, True)", "(None, 0, None, None)"]


# ---- 7 -----------------------------------------------------------------------------------------------------------


def pieces_of(text):
    """(start of each piece in the text, its words, whether a sentence begins) by walking over words and windows of eight."""
    import pyarrow as pa

    tokens = [(m.start(), m.group()) for m in WORD.finditer(text or "")]
    order = textkit.mix(textkit.Words(textkit.as_text(pa.array([text])), 0, 1).hash, 15).tolist()
    begins = [k == 0 or tokens[k - 1][1][-1] in ".!?" or "\n" in text[tokens[k - 1][0] : start] for k, (start, _) in enumerate(tokens)]
    cuts = {k for k, b in enumerate(begins) if b}
    for k in range(len(tokens) - spans.WINDOW + 1):
        window = range(k, k + spans.WINDOW)
        if not any(begins[i] for i in window[1:]):
            cuts.add(max(window, key=lambda i: (-order[i], i)))
    cuts = [*sorted(cuts), len(tokens)]
    return [(tokens[a][0], [w.translate(LOWER) for _, w in tokens[a:b]], begins[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def brute_runs(words, run, least):
    """(first, last + 1) of the shortest runs from each unit on, and up to each unit; of all, if there is too little for one."""
    n, out = len(words), set()
    enough = lambda i, j: j - i >= run and sum(words[i:j]) >= least
    for i in range(n):
        out |= {(i, j) for j in [next((j for j in range(i, n + 1) if enough(i, j)), None)] if j}
        out |= {(j, i + 1) for j in [next((j for j in range(i, -1, -1) if enough(j, i + 1)), None)] if j is not None}
    return out, {(0, n)} if n and not enough(0, n) else set()


def brute_spans(rows):
    """(doc_id, kept text, pieces, those removed) by comparing the words of spans as they stand."""
    cut = [(i, text, pieces_of(text)) for i, text in rows]

    def spans_of(parts):
        bounds = [k for k, p in enumerate(parts) if p[2]] + [len(parts)]
        whole, short = brute_runs([sum(len(p[1]) for p in parts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], spans.RUN, spans.LEAST_WORDS)
        found = {(bounds[a], bounds[b]) for a, b in whole | short}
        if len(bounds) <= len(parts):
            starts, _ = brute_runs([len(p[1]) for p in parts], spans.RUN, spans.LEAST_PIECES)
            shortest = {a: min(y for x, y in starts if x == a) for a, _ in starts}
            latest = {b: max(x for x, y in starts if y == b) for _, b in starts}
            found |= {(a, b) for a, b in starts if shortest[a] == b or (b in bounds and latest[b] == a)}
        return {(a, b, tuple(tuple(p[1]) for p in parts[a:b])) for a, b in found}

    first = {}
    for i, _, parts in cut:
        for a, b, key in spans_of(parts):
            place = (i is None, i or 0, a, b - a)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, text, parts in cut:
        gone = set()
        for a, b, key in spans_of(parts):
            if first[key] != (i is None, i or 0, a, b - a):
                gone |= set(range(a, b))
        ends = [p[0] for p in parts[1:]] + [len(text or "")]
        kept = text[: parts[0][0]] + "".join(text[p[0] : e] for k, (p, e) in enumerate(zip(parts, ends, strict=True)) if k not in gone) if gone else text
        out.append((i, kept, len(parts), len(gone)))
    return sorted(out, key=repr)


def test_spans_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["the", "a", "Sea", "é", "of.", "to!", "end?", "long", "words", "here"]
    passages = [" ".join(rng.choices(vocabulary, k=60)) + "." for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) + rng.choice([".", "\n", ""]) for _ in range(rng.randint(0, 5))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(100, None), (101, ""), (102, rows[0][1]), (None, rows[3][1])]
    got = spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit(1)).repartition(7))
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_sentences", "n_removed").collect()), key=repr) == brute_spans(rows)


def test_long_repeated_passages_go_and_clean_documents_stay(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = " ".join(word() for _ in range(70)) + "."
    rows = [(i, " ".join(word() for _ in range(80)) + ". " + passage + " " + " ".join(word() for _ in range(80)) + ".") for i in range(5)] + [(9, " ".join(word() for _ in range(200)))]
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in got[0].text and not any(passage in got[i].text for i in range(1, 5)) and got[9].n_removed == got[0].n_removed == 0
    assert all(len(got[i].text.split()) >= 160 for i in range(5))


def left_of_repeats(rows, size=51):
    """Words within a run of ``size`` words that stood before, in a row above or further up in the same."""
    seen, left = set(), 0
    for _, text in rows:
        w, marks = words(text), set()
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            marks |= set(range(p, p + size)) if key in seen else set()
            seen.add(key)
        left += len(marks)
    return left


def test_passages_of_short_sentences_go(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    short = lambda n: " ".join(" ".join(word() for _ in range(rng.randint(1, 2))) + rng.choice(".!?") for _ in range(n))
    passage, copy = short(50), short(80)
    rows = [(i, f"{short(20)} {passage} {short(20)}") for i in range(4)] + [(10, copy), (11, copy), (12, "Two. Words."), (13, "two. words."), (14, "Two. Others.")]
    assert left_of_repeats(rows) > 250
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left_of_repeats(sorted((i, r.text) for i, r in got.items())) == 0
    assert got[0].text == rows[0][1] and all(got[i].text == rows[i][1].replace(passage + " ", "") for i in range(1, 4))
    assert [got[i].text for i in (10, 11, 12, 13, 14)] == [copy, "", "Two. Words.", "", "Two. Others."]


def test_passages_in_mid_sentence_go(spark):
    rng = random.Random(10)
    several = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    passages, rows = [several(rng.choice([51, 60, 90])) for _ in range(40)], []
    for i, p in enumerate(passages):
        rows += [(3 * i + k, f"{several(rng.randint(0, 40))} {p} {several(rng.randint(0, 40))}.") for k in range(3)]
    rows += [(200, "so " * 100), (201, "a word before " + "so " * 100), (202, several(300))]
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    most = 2 * spans.WINDOW - 2
    for i, p in enumerate(passages):
        assert got[3 * i].text == rows[3 * i][1]
        middle = " ".join(p.split()[most : -most - 1])
        for k in (1, 2):
            assert middle not in got[3 * i + k].text and got[3 * i + k].n_removed
            # What stands around the passage stays.
            before, after = rows[3 * i + k][1].split(p)
            assert got[3 * i + k].text.startswith(before) and got[3 * i + k].text.endswith(after)
    assert got[202].n_removed == 0 and len(got[201].text.split()) < 20
    assert left_of_repeats(sorted((i, r.text) for i, r in got.items() if i not in (200, 201))) == 0


def test_no_piece_is_longer_than_a_window():
    import pyarrow as pa

    rng = random.Random(11)
    texts = [" ".join(rng.choices(["the", "a", "Sea", "é", "of.", "to"], k=rng.randint(0, 200))) for _ in range(50)]
    s = spans.Sentences(textkit.as_text(pa.array(texts)), 0, len(texts))
    assert s.words.max() <= spans.WINDOW and s.words.sum() == sum(len(words(t)) for t in texts)


def test_spans_awkward(spark):
    got = spans.dedup_spans(awkward(spark))
    assert got.count() == len(AWKWARD) and got.columns[:4] == ["doc_id", "text", "lang", "source"]
    assert spans.dedup_spans(awkward(spark).limit(0)).count() == 0


# ---- 8 -----------------------------------------------------------------------------------------------------------

PII = "Mail a.b+c@d-e.co.uk or x@y.z, ip 10.0.0.255 and 1.2.3.256, card 4111 1111 1111 1111 or 4111-1111-1111-1112; call +44 (20) 7946-0958. IBAN GB82 WEST 1234 5698 7654 32, ssn 078-05-1120"


def test_pii(spark):
    found = pii.find(PII)
    text = {(k, t) for k, _, _, _, t in found}
    assert text == {("email", "a.b+c@d-e.co.uk"), ("email", "x@y.z"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+44 (20) 7946-0958"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "078-05-1120")}
    assert not any(k == "ssn" for k, *_ in pii.find("part 078-05-1120 of it"))  # no context, no checksum
    assert pii.redact(PII, [f[:3] for f in found]).startswith("Mail [email] or [email], ip [ip] and 1.2.3.256, card [card]")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83WEST12345698765432")


def test_pii_query_against_plain_patterns(spark):
    rows = [(r.doc_id, r.text) for r in corpus(spark).collect()]
    got = {r.doc_id: r for r in queries.op8_pii(spark, DATA).collect()}
    for i, text in rows:
        spans_ = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        spans_ += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[ -]", "", m.group())
            if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
                spans_.append(("card", m.start(), m.end()))
        spans_ += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.findall("[0-9]", m.group())) <= 15]
        n = collections.Counter(s[0] for s in spans_)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans_).encode()).hexdigest()


def test_pii_takes_linear_time_and_finds_what_the_patterns_find():
    for text in ("1" * 2_000_000, "a" * 2_000_000, "a@" * 1_000_000, "1." * 1_000_000, "+1(" * 600_000, "a.b-" * 500_000 + "@", "AB12 " * 400_000):
        began = time.time()
        pii.find(text)
        assert time.time() - began < 15
    rng = random.Random(3)
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"}
    for _ in range(4000):
        text = "".join(rng.choices("ab_@@..-12 ", k=rng.randint(0, 40)))
        assert list(pii.emails(text)) == [m.span() for m in re.finditer(plain["email"], text)]
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in re.finditer(plain["ip"], text)]


def test_pii_awkward(spark):
    got = pii.detect_pii(awkward(spark).withColumn("pii_spans", F.lit(1)))
    assert got.count() == len(AWKWARD) and all(r.pii_spans == [] for r in got.collect())
    assert pii.detect_pii(awkward(spark).limit(0)).count() == 0
    assert [k for k, *_ in pii.find("1" * 9000 + ".1.1.1")] == [] and [k for k, *_ in pii.find("0" * 9000 + "1.1.1.1")] == ["ip"]


def test_pii_address_parts_of_any_length(spark):
    """Python refuses to read numbers of more than 4300 digits; parts of any length are told by their digits."""
    sizes = [1, 3, 100, 4296, *range(4299, 4302), 4500, 4996, *range(4999, 5002)]
    rows = [(i, f"a {head}.1.1.1 b") for i, head in enumerate(["1" * n for n in sizes] + ["0" * n + tail for n in sizes for tail in ("255", "25", "256", "")])]
    rows += [(-1, None), (-2, ""), (-3, ".".join(["0" * 4300] * 4))]
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.pii_spans] for r in pii.detect_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        head = (text or "").strip("ab ").split(".")[0]
        fits = bool(head) and len(head.lstrip("0")) <= 3 and int(head.lstrip("0") or 0) <= 255
        assert got[i] == ([("ip", text.index(head), text.index(head) + len(text.strip("ab ")))] if fits else [])


# ---- 9 -----------------------------------------------------------------------------------------------------------


def test_lines(spark):
    rows = [(1, "a repeated line\nown text one\nshort\n"), (2, "short\n\tA REPEATED line \nown text two"), (3, None), (4, ""), (None, "a repeated line"), (5, "own text five\nown text five"), (2, "a repeated line")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x")).withColumn("h", F.lit(1)))
    assert sorted(map(repr, map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()))) == sorted(map(repr, [
        (1, rows[0][1], 4, 0), (2, "short\nown text two", 3, 1), (3, None, 1, 0), (4, "", 1, 0), (None, "", 1, 1), (5, rows[5][1], 2, 0), (2, "", 1, 1),
    ]))
    three = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=4)
    assert three.agg(F.sum("n_dropped")).first()[0] == 0
    assert lines.dedup_lines(awkward(spark).limit(0)).count() == 0 and lines.dedup_lines(awkward(spark)).count() == len(AWKWARD)


# ---- 10 ----------------------------------------------------------------------------------------------------------


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in queries.op10_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.97
    assert np.mean([r.accepted for r in got]) > 0.97


def test_languages_awkward(spark):
    model = langid.fit(corpus(spark))
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(awkward(spark).withColumn("score", F.lit("x")), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (9, "und")} <= got and (8, "und") not in got
    assert langid.identify(awkward(spark).limit(0), model).count() == 0
    assert langid.fit(awkward(spark).limit(0)).dictionaries == {}
    assert {r.lang_pred for r in langid.identify(awkward(spark), langid.LanguageModel({})).collect()} == {"und"}
    assert langid.fit(corpus(spark)) == model


# ---- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p

    docs = corpus(spark)
    table = lambda d: {r.doc_id: r.text for r in d.collect()}
    kept = p.identify_language(spark, docs, DATA)
    before, after = table(docs), table(kept)
    model = langid.fit(docs)
    classify = langid.Classifier(model)
    assert after == {i: t for i, t in before.items() if classify(t)[2]} and len(after) > 0.95 * len(before)

    stored = common.stored(kept, "kept")
    cleaned = common.stored(p.drop_repeated_lines(spark, stored, DATA), "cleaned")
    held = collections.defaultdict(set)
    for i, t in after.items():
        for line in t.split("\n"):
            held[lines.line_key(line)].add(i)
    want = {i: "\n".join(x for x in t.split("\n") if len(k := lines.line_key(x)) < 10 or min(held[k]) == i) for i, t in after.items()}
    assert table(cleaned) == {i: t for i, t in want.items() if t == after[i] or words(t)}

    unique = common.stored(p.keep_one_of_near_copies(spark, cleaned, DATA), "unique")
    parts = {i: c for i, _, c in joined(list(table(cleaned).items()))}
    assert set(table(unique)) == {i for i, c in parts.items() if c == i}

    clean = common.stored(p.drop_leaks(spark, unique, DATA), "clean")
    leaks = {r.doc_id for r in decontam.find_leaks(unique, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert set(table(clean)) == set(table(unique)) - leaks
    assert [f.name for f in clean.schema] == [f.name for f in docs.schema]

    mixed = p.mix_sources(spark, clean, DATA)
    assert sorted(map(repr, p.run(spark, DATA).collect())) == sorted(map(repr, mixed.collect()))


def test_pipeline_rows_without_an_id(spark):
    import corpus_pipeline as p

    rng = random.Random(12)
    item = max((r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r.text), key=len)
    clean = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(80))
    docs = spark.createDataFrame([(None, item), (None, clean), (None, clean), (1, item), (2, clean), (3, item), (3, clean), (4, None)], "doc_id long, text string")
    assert sorted(map(tuple, p.drop_leaks(spark, docs, DATA).collect()), key=repr) == sorted([(None, clean), (None, clean), (2, clean), (3, clean), (4, None)], key=repr)
    near = spark.createDataFrame([(None, clean), (None, clean), (1, clean), (2, clean)], "doc_id long, text string")
    assert sorted(map(tuple, p.keep_one_of_near_copies(spark, near, DATA).collect()), key=repr) == sorted([(None, clean), (None, clean), (1, clean)], key=repr)
