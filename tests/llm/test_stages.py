"""Language decisions against plain compression, and the pipeline's stages on columns and tables of all kinds."""

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline as p
from pixloom.llm import langid, queries

DATA = "/root/testdata/sf0.001"


def letters(text):
    out = []
    for c in (text or "").lower():
        out.append(c if c.isalpha() else " ")
    return " ".join("".join(out).split()).encode()


def test_every_decision_against_plain_compression(spark):
    """Each text's pieces packed anew with each language's dictionary, for every row of the query."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs.where(queries._remainder("doc_id", 5) != 0))
    assert len(model.dictionaries) > 1
    packed = {}
    for lang, content in model.dictionaries.items():
        packed[lang] = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
    got = {r.doc_id: r for r in queries.op10_language_id(spark, DATA).collect()}
    rows = docs.select("doc_id", "text", queries._remainder("doc_id", 5).alias("rest")).collect()
    assert len(got) == len(rows)
    for doc_id, text, rest in rows:
        raw, r = letters(text), got[doc_id]
        assert r.held_out == (rest == 0)
        if not raw:
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        sizes = {k: sum(len(c.compress(raw[at : at + model.piece])) for at in range(0, len(raw), model.piece)) for k, c in packed.items()}
        first, second = sorted(sizes.items(), key=lambda x: (x[1], x[0]))[:2]
        gain = (second[1] - first[1]) / len(raw)
        assert r.lang_pred == first[0] and r.score == pytest.approx(min(1.0, gain / model.sure)) and r.accepted == (gain >= model.margin)


def odd(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    return docs.withColumns({"score": F.col("doc_id") * 2, "Accepted": F.lit("own"), "lang_pred": F.lit(7), "n_lines": F.col("doc_id") + 0.5, "n_dropped": F.lit("x"), "_score": F.lit(1), "_row": F.lit(2)})


@pytest.mark.parametrize("name,stage", p.STAGES[:-1])
def test_own_columns_stay_whatever_they_are_called(spark, name, stage):
    docs = odd(spark)
    plain = {r.doc_id: r for r in stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), DATA).collect()}
    got = stage(spark, docs, DATA)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in docs.schema]
    rows = got.collect()
    assert {r.doc_id for r in rows} == plain.keys() and len(rows) == len(plain)
    for r in rows:
        assert (r.score, r.Accepted, r.lang_pred, r.n_lines, r.n_dropped, r["_score"], r["_row"]) == (r.doc_id * 2, "own", 7, r.doc_id + 0.5, "x", 1, 2)
        assert (r.text, r.n_chars) == (plain[r.doc_id].text, plain[r.doc_id].n_chars)


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_empty_tables(spark, name, stage):
    assert stage(spark, odd(spark).limit(0), DATA).collect() == []


def test_a_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "benchmark"):
        table = spark.read.parquet(f"{DATA}/{t}.parquet")
        (table.limit(0) if t == "documents" else table).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_and_ids(spark):
    """Judged row by row, or as one document, as each stage says."""
    text = "The quick brown line that is there twice.\nand words of its own here"
    other = "the quick brown line that is there twice.\nother words"
    docs = spark.createDataFrame([(1, text, 9), (1, text, 9), (2, other, 9), (None, other, 9)], "doc_id long, text string, n_chars long")
    kept = sorted(map(tuple, p.drop_repeated_lines(spark, docs, DATA).collect()), key=repr)
    assert kept == sorted([(1, text, 9), (1, text, 9), (2, "other words", 11)], key=repr)  # the last row has no line of its own
    learnt = langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    judged = langid.identify(docs, learnt).collect()
    assert len(judged) == 4 and judged[0].lang_pred == judged[1].lang_pred
