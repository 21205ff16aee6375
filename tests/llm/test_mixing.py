"""Mixing against DuckDB's rows, the budgets, and odd tables."""

import pytest
from pyspark.sql import functions as F

from tabtrust.llm import mixing, queries

DOCS = "doc_id long, text string, source string"


def plain(rows):
    return sorted(tuple("null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_same_rows_as_sql(spark, tables, duck):
    out = queries.op1_mixing(spark, "/root/testdata/sf0.001")
    cursor = duck.execute(mixing.SQL)
    names = [c[0] for c in cursor.description]
    assert names == out.columns
    assert plain(out.collect()) == plain(cursor.fetchall())


def test_budgets(spark):
    rows = [(i, "w " * (1 + i % 13), ["a", "b", "c", None][min(3, i % 7)]) for i in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    by = {}
    for r in out:
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    assert sum(t for _, t in by) == pytest.approx(sum(s for s, _ in by))
    for (size, target), own in by.items():
        assert sum(r["size"] for r in own) == size and target <= 3 * size
        assert abs(sum(r["taken"] for r in own) - target) <= 13
        assert all(r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"] for r in own)
    assert out and sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(spark.createDataFrame(rows[::-1], DOCS)).collect()))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "x " * 100000, "b"), (3, "z", "b"), (4, " \t", "empty")]
    docs = spark.createDataFrame([(*r, 5, "q") for r in rows], DOCS + ", h long, __size string")
    out = mixing.mix(docs).collect()
    assert sorted(r["size"] for r in out) == [0, 0, 0, 1, 2, 100000]
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in out)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(docs.where("false")).collect() == [] and mixing.mixed(docs.where("false")).collect() == []


def test_mixed_rows_are_what_mix_takes(spark):
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect()}
    copies = {r[0]: r[1] for r in mixing.mixed(docs).groupBy("doc_id").count().collect()}
    assert copies == {k: v for k, v in taken.items() if v}


def test_words_are_counted_without_a_list_of_them(spark):
    """Numbers of words of odd texts, and a plan that holds no array of words."""
    import re

    space = " \t\n\x0b\x0c\r"
    texts = ["", " ", space * 3, "a", " a", "a ", f"{space}a{space}b c{space}", "\x1c\xa0\u2003\u3000", "é\U0001f600 \x00 x", "$1 \\ $", "w" * 200_000, " " * 200_000, "x" + " " * 200_000 + "y", "a\n" * 100_000, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.words(F.col("t")).alias("n"))
    assert "extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r["i"]: r["n"] for r in df.collect()}
    assert got == {i: len(re.findall(mixing.WORD, t or "")) for i, t in enumerate(texts)}
