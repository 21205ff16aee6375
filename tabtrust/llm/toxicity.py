"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A document is a bag of sentences; a sentence's logit is the bias plus the weights of the words it has (each word once:
the word itself and its first four and five letters, hashed). A document is toxic if any sentence is:
P = 1 - prod(1 - p_sentence). The weights are fitted by gradient descent with an L1 penalty on a bounded sample of
labelled documents; scoring covers every document and its whole text in Arrow batches, and `locate` gives the
sentences that make a document toxic.

Defined results: a null or empty text is one sentence without words. A document without an id is never learned from
and counts as held out; labels that are null are ignored, and a document that is labelled twice is toxic if one
label says so. Without any label, or labels of one kind only, every score is the share of toxic labels (0 for none).
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtrust.llm.scratch import light, quoted, trimmed

#: Labelled documents that a model is fitted on, at most: those with the least hashes of their id, as far as their
#: texts have so many characters in all (a text that doesn't fit is left out of the sample).
SAMPLE_DOCS = 6000
SAMPLE_CHARS = 32_000_000
#: Tasks that take the sample's features.
FIT_TASKS = 8
BITS = 20
#: Least chi-square of a feature that the model can use (one degree of freedom, 1 in 2000 by chance).
CHI_SQUARE = 12.0
SENTENCE = re.compile(r"[^.!?\n]*[^.!?\s][^.!?\n]*[.!?]*")
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, int, int]:
    mask = (1 << BITS) - 1
    return zlib.crc32(word.encode()) & mask, zlib.crc32(word[:4].encode(), 1) & mask, zlib.crc32(word[:5].encode(), 2) & mask


def sentence_words(text: str) -> list[set[str]]:
    return [set(WORD.findall(s)) for s in SENTENCE.findall(text.lower())] or [set()]


@dataclasses.dataclass
class Model:
    """weights: hashed feature -> weight, at most 2**BITS of them; bias: a sentence's logit without words."""

    bias: float
    weights: dict[int, float]
    constant: float | None = None


class _Words(dict):
    """Memo of words' weights."""

    def __init__(self, model: Model):
        super().__init__()
        self.get_weight = model.weights.get

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = sum(self.get_weight(f, 0.0) for f in word_features(word))
        return value


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: CRC-32 of the id's text is a multiple of 5; so do those without id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


BAG = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("features", T.BinaryType()), T.StructField("sizes", T.BinaryType())])


@trimmed
def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
            own = [[f for w in sorted(words) for f in word_features(w)] for words in sentence_words(text or "")]
            rows.append((toxic, np.array([f for s in own for f in s], "<i4").tobytes(), np.array([len(s) for s in own], "<i4").tobytes()))
        yield pd.DataFrame(rows, columns=BAG.names)


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.15, l1: float = 2e-4, least_docs: int = 4) -> Model:
    """bags: (label, features, numbers of features by sentence) of each document."""
    labels = np.array([b[0] for b in bags], float)
    if not len(bags) or labels.min() == labels.max():
        return Model(0.0, {}, float(labels.mean()) if len(bags) else 0.0)
    # features that go with the label or against it, by the chi-square of their documents
    have = np.zeros((2, 1 << BITS), np.int32)
    for label, own, _ in bags:
        have[label, np.unique(own)] += 1
    total, toxic, n = have.sum(0, dtype=np.int32), labels.sum(), len(bags)
    chance = total * (toxic / n)
    common = (total >= least_docs) & ((have[1] - chance) ** 2 * n > CHI_SQUARE * chance * np.maximum(1e-9, n - total) * (1 - toxic / n))
    del have, total, chance
    kept, sent, doc_of, sentences = [], [], [], 0
    for i, (_, own, size) in enumerate(bags):
        use = common[own]
        kept.append(own[use])
        sent.append(np.repeat(np.arange(sentences, sentences + len(size), dtype=np.int32), size)[use])
        doc_of.append(np.full(len(size), i, np.int32))
        sentences += len(size)
    names, feats = np.unique(np.concatenate(kept), return_inverse=True)
    sent_of, doc_of = np.concatenate(sent), np.concatenate(doc_of)
    w, bias = np.zeros(len(names)), -5.0
    m, v, t = np.zeros(len(names) + 1), np.zeros(len(names) + 1), 0
    for _ in range(rounds):
        logit = bias + np.bincount(sent_of, w[feats], sentences)
        soft = np.logaddexp(0, logit)
        whole = np.maximum(np.bincount(doc_of, soft, n), 1e-12)
        slope = np.where(labels == 1, -1 / np.expm1(np.minimum(whole, 700)), 1.0)
        grad = slope[doc_of] / (1 + np.exp(-logit)) / n
        g = np.append(np.bincount(feats, grad[sent_of], len(names)), grad.sum())
        t += 1
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, bias = w - step[:-1], bias - step[-1]
        # the penalty counts for each weight in the scale of its step
        shrink = rate * l1 / (np.sqrt(v[:-1] / (1 - 0.99**t)) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
    used = np.abs(w) > 1e-3
    return Model(float(bias), dict(zip(names[used].tolist(), w[used].tolist(), strict=True)))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled documents that are not held out, at most sample_docs of them with sample_chars characters.

    The sample's ids (a fixed number) are broadcast; what reaches the driver are its hashed features. Of rows that repeat
    an id, the text with the least hash counts.
    """
    known = labels.where(quoted(label_col).isNotNull() & ~held_out(quoted(id_col))).groupBy(quoted(id_col).alias("key")).agg(F.max(quoted(label_col)).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("key"), "key").limit(sample_docs)
    rows = light(docs).select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("key"))
    rows = rows.groupBy("key").agg(F.min_by(F.struct("toxic", "text"), F.xxhash64("text")).alias("x")).select("key", "x.*")
    sizes = Window.orderBy(F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, 0)  # of sample_docs rows at most
    size = F.coalesce(F.length("text"), F.lit(0))
    rows = rows.where(size <= sample_chars).withColumn("sum", F.sum(size).over(sizes)).where(F.col("sum") <= sample_chars).select("toxic", "text")
    bags = rows.repartition(FIT_TASKS).mapInPandas(_bags, BAG).toArrow()
    return train(sorted(((y.as_py(), np.frombuffer(f.as_py(), "<i4"), np.frombuffer(s.as_py(), "<i4")) for y, f, s in zip(*bags.columns, strict=True)), key=lambda b: (b[0], len(b[1]), b[1].tobytes())))


def sentence_logits(text: str, model: Model, memo: _Words) -> list[float]:
    return [model.bias + sum(map(memo.__getitem__, words)) for words in sentence_words(text)]


def _scores(model: Model):
    @trimmed
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _Words(model)
        for texts in batches:
            if model.constant is not None:
                yield pd.Series([model.constant] * len(texts), dtype=float)
                continue
            soft = [float(np.logaddexp(0, sentence_logits(t or "", model, memo)).sum()) for t in texts]
            yield pd.Series(-np.expm1(-np.array(soft, float)))

    return F.pandas_udf(run, T.DoubleType())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    value = _scores(model)(quoted(text_col))
    out = light(docs).select(quoted(id_col).alias("doc_id"), held_out(quoted(id_col)).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def locate(model: Model, threshold: float = 0.5):
    """A function of a text column: the sentences (code points) whose own score reaches the threshold."""

    @trimmed
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _Words(model)
        for texts in batches:
            out = []
            for text in texts:
                own = []
                for s in SENTENCE.finditer(text or ""):
                    logit = model.bias + sum(map(memo.__getitem__, set(WORD.findall(s.group().lower()))))
                    p = 1 / (1 + float(np.exp(-max(-500.0, min(500.0, logit)))))
                    if model.constant is None and p >= threshold:
                        own.append({"start": s.start(), "end": s.end(), "score": p})
                out.append(own)
            yield pd.Series(out)

    return F.pandas_udf(run, SPANS)


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that the model doesn't reject, with their own columns."""
    return light(docs).where(_scores(model)(quoted(text_col)) < threshold)
