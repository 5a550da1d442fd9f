"""Long texts go to Python in small batches in every stage of the pipeline."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from pixloom.llm import common

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,stage", p.STAGES[:-1])
def test_a_stage_gives_long_texts_out_in_small_batches(spark, name, stage):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

    spark.conf.unset(common._BATCH)
    try:
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" is a text\n")), 300).alias("text"))
        stage(spark, spark.read.parquet(f"{DATA}/documents.parquet").limit(20), DATA)
        got = docs.coalesce(1).mapInArrow(sizes, "size long").agg(F.max("size")).first()[0]
        assert got < 2 * common.BATCH_BYTES
    finally:
        spark.conf.unset(common._BATCH)


def test_a_size_of_the_sessions_own_stays(spark):
    spark.conf.set(common._BATCH, "1234567")
    try:
        common.small_batches(spark)
        assert spark.conf.get(common._BATCH).rstrip("b") == "1234567"
    finally:
        spark.conf.unset(common._BATCH)
