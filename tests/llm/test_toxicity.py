"""Noisy-or, held-out accuracy, and odd tables."""

import math
import os

import pytest

from tabtrust.llm import toxicity

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    right = sum(r["toxic"] == r["predicted"] for r in rows)
    assert len(rows) > 20 and right >= 0.9 * len(rows)
    assert out.where("score < 0 or score > 1 or score is null").count() == 0 and out.count() == docs.count()


def test_noisy_or():
    model = toxicity.Model(-2.0, {toxicity.word_features("bad")[0]: 4.0})
    memo = toxicity._Words(model)
    logits = toxicity.sentence_logits("A bad day. A good day! Bad, bad.", model, memo)
    assert logits == [2.0, -2.0, 2.0]
    clean = math.prod(1 - 1 / (1 + math.exp(-x)) for x in logits)
    assert -math.expm1(-sum(math.log1p(math.exp(x)) for x in logits)) == pytest.approx(1 - clean)


def test_odd_rows(spark):
    rows = [(i, "you are a vile wretch." if i % 3 == 0 else "the rain fell on the hill.") for i in range(60)] + [(None, "vile"), (61, None), (62, ""), (63, "x" * 100000), (64, "a. " * 50000)]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, toxic long, Key string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in out if r["doc_id"] is not None and r["doc_id"] < 60)
    assert toxicity.clean(docs, model).columns == docs.columns
    spans = docs.where("doc_id = 3").select(toxicity.locate(model)("text").alias("s")).first()["s"]
    assert [(s["start"], s["end"]) for s in spans] == [(0, 22)]
    assert toxicity.score(docs.where("false"), model).collect() == []
    unlabelled = toxicity.fit(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.score(docs, unlabelled).collect()} == {0.0}


def test_sample_is_bounded(spark):
    """Rows that repeat an id count once, and texts beyond the sample's characters are left out."""
    rows = [(i, "you are a vile wretch." if i % 3 == 0 else "the rain fell on the hill.") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    once = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    often = toxicity.fit(spark.createDataFrame(rows * 30, "doc_id long, text string"), labels)
    assert once.weights == often.weights and once.bias == often.bias
    long = toxicity.fit(spark.createDataFrame([(d, t if d else "x" * 10_000) for d, t in rows], "doc_id long, text string"), labels, sample_chars=5000)
    assert long.constant is None
    assert toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample_chars=30).constant is not None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_scores_by_definition(spark):
    """One minus the chance that no sentence is toxic, each from its own words."""
    small = DATA.replace("sf0.01", "sf0.001")
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        clean = 1.0
        for sentence in toxicity.SENTENCE.findall(texts[r["doc_id"]].lower()) or [""]:
            logit = model.bias + sum(model.weights.get(f, 0.0) for w in set(toxicity.WORD.findall(sentence)) for f in toxicity.word_features(w))
            clean *= 1 - 1 / (1 + math.exp(-logit))
        assert r["score"] == pytest.approx(1 - clean, abs=1e-9) and r["predicted"] == int(r["score"] >= 0.5)
