"""Links between vectors against a comparison of all pairs in double precision."""

import numpy as np

import brute
from tabtrust.llm import neardup_vectors

ROWS = "vec_id long, embedding array<float>"


def all_pairs(rows, threshold):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.array([np.array(rows[i][1], np.float32).astype(float) for i in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = np.triu(unit @ unit.T >= threshold, 1)
    return [(good[i], good[j]) for i, j in zip(*np.nonzero(near), strict=True)]


def expected(rows, links):
    root, n = brute.roots(len(rows), links), [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(d, least.get(r, d))
    return {d: (k, least[r]) for (d, _), k, r in zip(rows, n, root, strict=True)}


def test_recall_and_no_false_link(tables):
    rows = [(r[0], r[1]) for r in tables("embeddings").select("vec_id", "embedding").collect()]
    want = expected(rows, all_pairs(rows, 0.95))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup_vectors.near_duplicates(tables("embeddings")).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] <= want[k][0] and got[k][1] >= want[k][1] and got[k][2] == (got[k][1] == k) for k in want)
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(w[0] for w in want.values())


def test_groups(spark):
    """Large groups of like vectors, over several tiles."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 24))
    rows = [(i, [float(x) for x in (base[i % 6] + 0.02 * rng.standard_normal(24)).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, [2 * x for x in rows[0][1]]) for i in range(20)]
    want = expected(rows, all_pairs(rows, 0.95))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, ROWS), tile=32).collect()}
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(w[0] for w in want.values())
    assert all(got[k][0] <= want[k][0] for k in want) and sum(got[k][1] == want[k][1] for k in want) >= 0.99 * len(want)


def test_odd_rows(spark):
    v, nan = [1.0, 2.0, 3.0], float("nan")
    rows = [(1, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, [1.0, 2.0]), (9, [-0.0, 0.0, 5.0]), (10, [0.0, -0.0, 5.0]), (10, [0.0, 0.0, 5.0]), (None, v), (11, [float("inf"), 1.0, 1.0])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS + ", cid long, N_links string")
    out = sorted(((r[0], r[1], r[2], r[3]) for r in neardup_vectors.near_duplicates(docs).collect()), key=str)
    assert out == sorted([(1, 2, 1, True), (2, 2, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 11)], (9, 2, 9, True), (10, 2, 9, False), (10, 2, 9, False), (None, 2, 1, True)], key=str)
    assert neardup_vectors.near_duplicates(docs.where("false")).collect() == []


def test_lengths_and_magnitudes(spark):
    """Vectors of every length are hashed, and components may be as large or small as doubles are."""
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1e200, 1e200, 1e200]), (4, [2e200, 2e200, 2.1e200]), (5, [5e-324, 5e-324, 5e-324]), (6, [1e-300, -1e-300, 1e-300]), *((10 + i, [float(i == j) for j in range(4)]) for i in range(4)), (20, [3.0]), (21, [4.0]), (22, [-3.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6), **{10 + i: (0, 10 + i) for i in range(4)}, 20: (1, 20), 21: (1, 20), 22: (0, 22)}
