import pytest

import corpus_pipeline
from rankloom.llm import common, queries

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_send_small_batches(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars int")
    before = spark.conf.get(NAME)
    try:
        spark.conf.set(NAME, "10000")
        corpus_pipeline.drop_near_copies(spark, docs, "")
        assert int(spark.conf.get(NAME)) == common.BATCH_ROWS
        spark.conf.set(NAME, "100")
        common.small_batches(spark)
        assert spark.conf.get(NAME) == "100"
    finally:
        spark.conf.set(NAME, before)


@pytest.mark.parametrize("name", ["op1_best_fit_packing", "op10_minhash_near_dedup"])
def test_queries_send_small_batches(spark, name):
    folder = common.new_folder(spark, "batches")
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    docs.write.parquet(f"{folder}/documents.parquet")
    before = spark.conf.get(NAME)
    try:
        spark.conf.set(NAME, "10000")
        assert queries.QUERIES[name](spark, folder).count() == 2
        assert int(spark.conf.get(NAME)) == common.BATCH_ROWS
    finally:
        spark.conf.set(NAME, before)
