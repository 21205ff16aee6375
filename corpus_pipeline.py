"""The corpus pipeline: toxic documents go, near copies go, secrets are masked, sources are mixed, and the rest is packed.

Every stage takes (spark, docs, sf_dir), with docs in the columns of `documents`, and works on all rows that its
predecessor kept. All but the last return the columns of `documents`; what a stage decides takes effect at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtrust.llm import mixing, ngram_join, packing, scratch, secrets, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of labelled, not held out documents rejects go."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by sets of five-word shingles with a Jaccard similarity of 0.8 or more, the least doc_id stays."""
    return ngram_join.distinct(docs, n=5, num=80, den=100)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, and n_chars is counted again."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources, with weights 1, 2, 3 in turn, takes it."""
    return mixing.mixed(docs, weights=(1, 2, 3), share=1.0, most=3)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs, size=1024)


STAGES = [("toxicity", toxic), ("ngram_join", near_copies), ("secrets", masked), ("mixing", mixture), ("packing", packed)]

#: Model fitting and tokens are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
