"""A training corpus from ``documents``: five stages, each on all rows its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents. Rows with null or
empty texts: the quality stage scores them like any row; the join keeps one row of each id;
the other stages keep them. Very long texts pass every stage whole. Repeated rows of one id
leave one row in the join. An empty table passes all stages.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.llm import decontaminate, jaccard_join, pieces, pii, quality
from tidalframe.llm.common import discard, shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on labelled rows outside the held-out fold, accepts."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of documents with five-word shingles similar to 0.8 or more."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item within its edit budget."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, entities replaced by surrogates."""
    return pii.replace_in_place(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the round-trip test."""
    rows = docs.select("doc_id", "lang", "source", "n_chars", pieces.encode_column(docs, "text").alias("__e"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.col("__e.n_tokens"), F.col("__e.token_ids"), F.col("__e.round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("sentencepiece_ids", sentencepiece_ids),
]

#: Not expressible in SQL: trained scores, an exact join with components, edit matching, keyed
#: surrogates and tokenizer ids. tests/llm holds run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; a stage's folder goes once the next one is written, the last one stays for the caller."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            discard(spark, f"{folder}/{k - 1}")
    return docs
