"""The n-gram Jaccard join gives the rows of a comparison of all pairs."""

import random

import numpy as np
import pytest

import brute
from tabtrust.llm import ngram_join

DOCS = "doc_id long, text string"


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            own = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
            texts.append(" ".join(own) or "x")
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 11, 12, 30, 60]))))
    return [(i * 7 % (n * 7 + 1), t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("most", [4, 4000])
def test_all_pairs(spark, n, num, most):
    rows = near_copies(n, 150)
    out = ngram_join.join(spark.createDataFrame(rows, DOCS), n, num, 100, most=most, tile=2 * most)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect()), key=str) == brute.ngram_join(rows, n, num, 100)


def test_smallest_sets(spark):
    """Nine shingles of ten link at 0.9, four of five at 0.8."""
    long = [f"a{i}" for i in range(12)]
    rows = [(2, " ".join(long[:11])), (5, " ".join(long))]
    assert brute.ngram_join(rows, 3, 90, 100)[1][2] == 2
    assert sorted(map(tuple, ngram_join.join(spark.createDataFrame(rows, DOCS)).collect())) == brute.ngram_join(rows, 3, 90, 100)
    rows = [(2, " ".join(long[:8])), (5, " ".join(long[:9]))]
    assert sorted(map(tuple, ngram_join.join(spark.createDataFrame(rows, DOCS), 5, 80).collect())) == brute.ngram_join(rows, 5, 80, 100)


def test_documents(spark, tables):
    rows = [tuple(r) for r in tables("documents").select("doc_id", "text").collect()]
    out = ngram_join.join(tables("documents"))
    assert sorted(map(tuple, out.collect()), key=str) == brute.ngram_join(rows, 3, 90, 100)


def test_odd_rows(spark):
    copy = " ".join(f"v{i}" for i in range(40))
    other = " ".join(f"u{i}" for i in range(40))
    rows = [(None, copy), (3, copy + " Tail"), (3, other), (4, other.upper()), (5, None), (6, ""), (7, " \t\n"), (8, copy), (8, copy), (9, "one"), (10, "ONE"), (11, "one two " * 30000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", size long, Component_ID string")
    out = ngram_join.join(docs)
    assert sorted(map(tuple, out.collect()), key=str) == brute.ngram_join(rows, 3, 90, 100)
    assert ngram_join.join(docs.where("false")).collect() == []
    assert ngram_join.distinct(docs).columns == docs.columns


def test_star_of_window_sets(spark):
    """Sets that link with one core set, and neither with the pivot nor with each other, are all linked."""
    pivot = list(range(100))
    core = [1000 + i if i < 10 else x for i, x in enumerate(pivot)]
    sets = [pivot, core, *([10_000 + 100 * s + i if i // 10 == s else x for i, x in enumerate(core)] for s in range(1, 10))]
    grams = spark.createDataFrame([(i, bytearray(np.array(sorted(x), "<u8").tobytes())) for i, x in enumerate(sets)], "cid long, grams binary")
    regions = spark.createDataFrame([(1, i) for i in range(len(sets))], "region long, cid long")
    links = {tuple(r) for found in ngram_join._links(regions, grams, 80, 100, 4) for r in found.collect()}
    assert all(100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]}) for a, b in links)
    assert set(brute.roots(len(sets), links)) == {0}


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
def test_linked_sets_meet_in_a_cell(num, den):
    """Of two linked sets at least one is at home in a cell that the other goes to."""
    rng = np.random.default_rng(num)
    base = rng.choice(10**9, 40, replace=False).astype(np.uint64)
    sets = []
    for _ in range(60):
        own = base.copy()
        own[rng.choice(40, rng.integers(0, 8), replace=False)] = rng.choice(10**9, 1)[0]
        sets.append(np.unique(own))
    pivots = [sets[i] for i in rng.choice(60, 7, replace=False)]
    places = [ngram_join.voronoi(x, pivots, num, den) for x in sets]
    linked = 0
    for i in range(60):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if shared * den >= num * (len(sets[i]) + len(sets[j]) - shared):
                linked += 1
                assert places[i][0] in places[j][1] and places[j][0] in places[i][1]
    assert linked > 50 and all(home in at for home, at, _ in places)


def test_class_counts_never_part_linked_sets():
    """The bound lets every linked pair through, whatever the sizes and numbers of classes."""
    rng = np.random.default_rng(5)
    sets = []
    for size in (8, 60, 390, 395, 410, 1590, 1610, 5000, 70_000):
        own = rng.integers(0, 2**64, size, np.uint64)
        for gone in (0, 1, size // 20, size // 12):
            sets.append(np.unique(np.r_[own[gone:], rng.integers(0, 2**64, gone // 2, np.uint64)]))
    size, counts = np.array(list(map(len, sets))), ngram_join.Signatures([ngram_join.by_class(x).tobytes() for x in sets])
    a, b = np.triu_indices(len(sets), 1)
    near, links = counts.near(a, b, size, 90, 100), 0
    for i, j, ok in zip(a.tolist(), b.tolist(), near.tolist(), strict=True):
        shared = len(np.intersect1d(sets[i], sets[j]))
        linked = shared * 100 >= 90 * (size[i] + size[j] - shared)
        links += linked
        assert ok or not linked
    assert links >= 20 and near.sum() < 60


def test_same_rows_as_sql(tables, duck):
    out = ngram_join.join(tables("documents"))
    cursor = duck.execute(ngram_join.SQL)
    assert out.columns == [c[0] for c in cursor.description]
    assert sorted(map(tuple, out.collect())) == sorted(cursor.fetchall())
