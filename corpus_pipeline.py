"""From raw documents to packed training sequences.

Five stages; each reads all rows the one before kept, from Parquet. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import exact_dedup, minhash, packing, pii, queries, toxicity
from rankloom.llm.common import small_batches, stored

#: Scores from here on reject a document. The report's threshold of 0.3 finds a few more toxic texts
#: and rejects several times as many clean ones.
REJECT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under REJECT. The judge learns from labelled documents of the input."""
    small_batches(spark)
    return toxicity.keep_ordinary(docs, queries.toxic_judge(spark, sf_dir, docs), REJECT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.unique_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8) the row with the smallest doc_id."""
    small_batches(spark)
    return minhash.one_of_each(docs, words=5, percent=80)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the text."""
    small_batches(spark)
    return pii.pseudonymise(docs, queries.PII_KEY).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its sequence and place."""
    small_batches(spark)
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", replace_private),
    ("packing", pack),
]

#: Trained models, sketches and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
