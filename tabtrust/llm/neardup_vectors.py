"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Equal vectors are first taken together as one class with a count. Vectors of each length are a space of their own.
Of each normalised class vector, k projections on Gaussian directions, shifted and quantised by width w, are the key in
each of L tables. k and L follow from the
number of vectors and the recall wanted at the threshold. Vectors that share a bucket are compared exactly, in double
precision: a pair is judged in the first table in which it meets, so links are counted once. Buckets of equal members
in several tables are compared in the first of them only. A bucket is compared in tiles of at most `tile` by `tile`
vectors, which other tasks can hold; what leaves a tile is one row a vector (its number of links and the least
vector that it reaches), not pairs. A bucket of n different vectors takes n * n / 2 comparisons.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are
components of their own; vectors of different lengths don't link. Components of any size have their cosine, as they
are scaled by the largest before they are squared. Rows that repeat a vec_id are separate vectors; a null vec_id is kept, and counts as no id of a component. Extra columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtrust.llm.components import components, least_ids
from tabtrust.llm.scratch import light, quoted, table, trimmed

WIDTH = 2.4
TILE = 1024
#: Rows that a task compares at once, about: of many small buckets, or one tile.
TASK_ROWS = 20_000


def meet(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection of two vectors at this distance is the same."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, threshold: float, recall: float = 0.99, strangers: float = 0.05) -> tuple[int, int]:
    """(projections a table, tables): a vector meets `strangers` orthogonal ones a table, and links at the threshold with `recall`."""
    near, far = meet(math.sqrt(2 - 2 * threshold)), meet(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 2) / strangers) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@functools.lru_cache(2)
def projections(dim: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts and the factors of a bucket's key."""
    rng = np.random.default_rng((seed, dim))
    return rng.standard_normal((dim, tables * k)), rng.uniform(0, WIDTH, tables * k), rng.integers(1, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)


def _keys(k: int, tables: int, seed: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch["vector"]).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                lines, shift, mix = projections(dim, k, tables, seed)
                rows = batch.filter(pa.array(dims == dim))
                x = unit(rows["vector"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))
                cell = np.floor((x @ lines + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(-1, tables, k)
                key = (cell * mix).sum(2, dtype=np.uint64)
                key ^= key >> np.uint64(29)
                key *= np.uint64(0xBF58476D1CE4E5B9)
                sign = (key >> np.uint64(32)).astype("<i4")
                yield pa.RecordBatch.from_arrays([rows["cid"], pa.array(np.full(len(x), dim, np.int32)), rows["n"], pa.array([v.tobytes() for v in x], pa.binary()), pa.array([s.tobytes() for s in sign], pa.binary()), pa.array(list(sign), pa.list_(pa.int32()))], names=["cid", "dim", "n", "unit", "sign", "keys"])

    return run


def _compare(threshold: float):
    @trimmed
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "key", "ta", "tb", "cid"], kind="stable")
        x = np.frombuffer(b"".join(pdf["unit"]), float).reshape(len(pdf), -1)
        sign = np.frombuffer(b"".join(pdf["sign"]), "<i4").reshape(len(pdf), -1)
        cid, n, own = pdf["cid"].to_numpy(), pdf["n"].to_numpy(), pdf["own"].to_numpy()
        head = pdf[["t", "key", "ta", "tb"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]).any(1)])
        links, root = np.zeros(len(pdf), np.int64), cid.copy()
        for s, e in zip(starts, np.r_[starts[1:], len(pdf)], strict=True):
            t, _, ta, tb = head[s]
            if e - s == 2:  # most buckets
                if (x[s] * x[s + 1]).sum() >= threshold and not (sign[s, :t] == sign[s + 1, :t]).any() and (ta == tb or own[s] != own[s + 1]):
                    links[s], links[s + 1], root[s + 1] = n[s + 1], n[s], root[s]
                continue
            m = e - s
            near = np.empty((m, m), bool)
            for a in range(0, m, 256):
                b = min(m, a + 256)
                near[a:b] = x[s + a : s + b] @ x[s:e].T >= threshold
                for u in range(t):
                    near[a:b] &= sign[s + a : s + b, u][:, None] != sign[s:e, u][None]
                if ta != tb:
                    near[a:b] &= own[s + a : s + b][:, None] != own[s:e][None]
            np.fill_diagonal(near, False)
            links[s:e] = near @ n[s:e]
            label = cid[s:e].copy()
            rows, cols = np.nonzero(near)
            edges = np.flatnonzero(np.diff(rows, prepend=-1))
            while len(rows):
                new = label.copy()
                new[rows[edges]] = np.minimum(label[rows[edges]], np.minimum.reduceat(label[cols], edges))
                if (new == label).all():
                    break
                label = new
            root[s:e] = label
        found = links > 0
        return pd.DataFrame({"cid": cid[found], "links": links[found], "root": root[found]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    plain = light(vectors).select(quoted(id_col).alias("vec_id"), quoted(vector_col).cast("array<double>").alias("vector"))
    good = F.coalesce((F.size("vector") > 0) & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vector", lambda v: v != 0), F.lit(False))
    # -0.0 and 0.0 are one value in a group's key
    flagged = plain.select("vec_id", F.when(good, F.transform("vector", lambda v: v + F.lit(0.0))).alias("vector"))
    classes = flagged.where("vector is not null").groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    alone = flagged.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    count = classes.count()
    if not count:
        return _result(alone, id_col)
    k, tables = parameters(count, threshold, recall)
    # Spark hands out at most 10,000 rows a batch, of a bounded number of components
    hashed = table(classes.select("cid", "n", "vector").mapInArrow(_keys(k, tables, seed), "cid long, dim int, n long, unit binary, sign binary, keys array<int>"), "hashed")
    places = hashed.select("cid", "dim", F.posexplode("keys").alias("t", "key"))
    # of buckets with the same members only the first counts: their pairs met there
    buckets = places.groupBy("dim", "t", "key").agg(F.count("*").alias("size"), F.min("cid").alias("first"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("sum")).where("size > 1")
    buckets = table(buckets.groupBy("dim", "size", "first", "sum").agg(F.min(F.struct("t", "key")).alias("b")).select("dim", "b.t", "b.key", "size"), "buckets")
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / tile)).cast("int")
    used = places.join(buckets, ["dim", "t", "key"]).withColumn("own", F.pmod(F.xxhash64("cid"), parts).cast("int"))
    used = used.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    used = used.select("cid", "dim", "t", "key", "own", F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"))
    used = table(used, "places")
    groups = max(1, -(-used.count() // TASK_ROWS))
    found = used.join(hashed.select("cid", "n", "unit", "sign"), "cid").withColumn("part", F.pmod(F.xxhash64("t", "key", "ta", "tb"), F.lit(groups)))
    found = table(found.groupBy("dim", "part").applyInPandas(_compare(threshold), "cid long, links long, root long"), "links")
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    # ids of components are the least vec_id, whatever the class ids
    member = classes.select("cid", "least").join(member, F.col("cid") == F.col("node")).select("cid", "component", "least")
    member = least_ids(member)
    known = classes.join(linked, "cid", "left").join(member, "cid", "left").select(F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = flagged.join(known, F.col("vector") == F.col("v"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return _result(out, id_col)


def _result(out: DataFrame, id_col: str) -> DataFrame:
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
