"""The registered queries of this subpackage: thin uses of the operators on whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabtrust.llm import htmltext, media, mixing, neardup_vectors, ngram_join, packing, secrets, substring, toxicity, urls


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), weights=(1, 2, 3), share=1.0, most=3)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), size=1024)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(read(spark, sf_dir, "documents"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(read(spark, sf_dir, "documents"), length=50)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), urls.rule_table(spark, urls.RULES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op6_url_filter": op6_url_filter,
    "op3_html_text": op3_html_text,
    "op4_near_vectors": op4_near_vectors,
    "op5_toxicity": op5_toxicity,
    "op7_media": op7_media,
    "op8_substring": op8_substring,
    "op9_ngram_join": op9_ngram_join,
    "op10_secrets": op10_secrets,
}
SQL: dict[str, str] = {"op1_mixing": mixing.SQL, "op6_url_filter": urls.SQL, "op8_substring": substring.SQL, "op9_ngram_join": ngram_join.SQL}
