"""Each stage of the pipeline against a plain version, on what its predecessor kept."""

import os

import pytest

import brute
import corpus_pipeline
from tabtrust.llm import mixing, scratch, secrets, toxicity
from test_packing import check

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    kept = scratch.table(corpus_pipeline.toxic(spark, docs, DATA), "s1")
    score = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet")))
    assert kept.columns == names and rows_of(kept) == rows_of(docs.join(score.where("score < 0.5"), "doc_id", "left_semi").select(names))

    distinct = scratch.table(corpus_pipeline.near_copies(spark, kept, DATA), "s2")
    want = {d for d, _, c in brute.ngram_join([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80, 100) if d == c}
    assert distinct.columns == names and rows_of(distinct) == sorted((tuple(r) for r in kept.collect() if r["doc_id"] in want), key=str)

    masked = scratch.table(corpus_pipeline.masked(spark, distinct, DATA), "s3")
    assert masked.columns == names
    for a, b in zip(sorted(distinct.collect()), sorted(masked.collect()), strict=True):
        text = None if a["text"] is None else secrets.redacted(a["text"])
        assert b["text"] == text and b["n_chars"] == (None if text is None else len(text))

    mixed = scratch.table(corpus_pipeline.mixture(spark, masked, DATA), "s4")
    taken = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 0 for r in mixing.mix(masked).collect()}
    assert mixed.columns == names and {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in taken.items() if v}

    once = mixed.dropDuplicates(["doc_id"])
    check([(r["doc_id"], r["text"]) for r in once.collect()], corpus_pipeline.packed(spark, once, DATA).collect())
    assert corpus_pipeline.packed(spark, mixed, DATA).where("start = 0").count() == mixed.count()


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "secrets", "mixing", "packing"]
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_stages_with_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns and an empty table go through every stage."""
    long = "word and more words. " * 30_000
    rows = [(None, "text without id", "en", None, None), (1, None, None, "a", 3), (2, "", "en", "a", 0), (3, long, None, None, None), (4, "same words here", "en", "b", 15), (4, "same words here", "en", "b", 15), (2**53 + 1, "api_key = abcdef123456", "en", "b", 22)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, Score long")
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = scratch.table(stage(spark, table, DATA), name)
            assert kept.columns == docs.columns
            assert kept.count() <= table.count() or name == "mixing"
            table = kept
        pieces = corpus_pipeline.packed(spark, table, DATA).collect()
        assert len([p for p in pieces if p["start"] == 0]) == table.count()
    masked = corpus_pipeline.masked(spark, docs, DATA).collect()
    assert len(masked) == len(rows) and [r["text"] for r in masked if r["doc_id"] == 2**53 + 1] == ["[assign]"]
    near = corpus_pipeline.near_copies(spark, docs, DATA)
    assert {r["doc_id"] for r in near.collect()} == {r[0] for r in rows}
