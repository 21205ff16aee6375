"""Substring dedup gives the rows of a comparison of all windows."""

import random

import brute
from tabtrust.llm import substring

DOCS = "doc_id long, text string"


def ours(docs, length, **how):
    out = substring.digest(docs, length, **how)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def test_documents(tables):
    rows = [tuple(r) for r in tables("documents").select("doc_id", "text").collect()]
    assert ours(tables("documents"), 50) == brute.substring(rows, 50)


def test_random_passages(spark):
    rng = random.Random(5)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(4, 40))] for _ in range(12)]
    rows = [(i, " ".join(w for p in rng.choices(passages, k=rng.randint(0, 6)) for w in p[rng.randrange(3) :])) for i in range(120)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS)
    for length, how in ((6, {}), (10, {}), (6, {"shard_words": 40}), (6, {"shard_words": 40, "most": 0}), (10, {"shard_words": 300, "most": 0})):
        assert ours(docs, length, **how) == brute.substring(rows, length)


def test_odd_rows(spark):
    w = " ".join(f"w{i}" for i in range(60))
    rows = [(None, w), (9, w), (9, w), (4, w + "\tmore"), (7, None), (8, ""), (5, " ".join(w.split()[:49])), (6, "la " * 5000), (3, "la\n" * 70), (2, w.upper())]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], DOCS + ", key long, N_words string")
    assert ours(docs, 50) == brute.substring(rows, 50)
    assert ours(docs.where("false"), 50) == []


def test_removed_spans(spark):
    w = " ".join(f"w{i}" for i in range(60))
    out = {r["doc_id"]: r for r in substring.removed(spark.createDataFrame([(1, w), (2, "a b " + w + " c")], DOCS)).collect()}
    assert out[2]["kept"] == "a b c" and [tuple(s) for s in out[2]["spans"]] == [(2, 62)] and out[1]["n_removed"] == 0


def test_same_rows_as_sql(tables, duck):
    out = substring.digest(tables("documents"))
    cursor = duck.execute(substring.SQL)
    assert out.columns == [c[0] for c in cursor.description]
    assert sorted(map(tuple, out.collect())) == sorted(cursor.fetchall())
