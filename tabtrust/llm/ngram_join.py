"""N-gram Jaccard join in the metric space of the Jaccard distance, exact.

A document's set are its distinct word n-grams. Two documents link if |A & B| * den >= num * |A | B|.

1. Documents with equal sets become one class, by partial aggregation.
2. Pivots of the whole table. Unrelated texts are at distance 1 from each other and from any pivot, so pivots drawn
   at random would have every set on all their bisectors. In one order of all n-grams (frequent ones last, by a count
   sketch of fixed size over all documents), linked sets share one of their first |A| - ceil(t |A|) + 1 n-grams. Of all
   sets with such an n-gram one is the pivot (the least by a hash, the same order for all n-grams, so that a group of
   near copies has few pivots), and the cell of a pivot are all sets that it was drawn for. Two linked sets meet in a cell.
3. Counts of a set's n-grams in 64 to 1024 hash classes are a map into an L1 space that never lengthens a symmetric difference.
   Within a cell, sets that this bound doesn't tell apart are connected to one region; a set whose cells hold no such
   partner leaves. Cells of more than TILE sets are tested in tiles.
4. Regions join by the Jaccard distance. One with more than `most` sets, or too many n-grams, is divided: PIVOTS of its
   sets are drawn, each set finds its exact distance to all of them, goes to the Voronoi cell of the nearest, and is
   replicated to the cell of each pivot that is not further than that by twice the radius (the triangle inequality lets
   no linked set lie beyond). Cells are divided again while they halve; where they don't, or the windows hold nearly all
   (sets are as far from each other as from the pivots, as copies of one text are), the region is joined in blocks. Sets
   within the radius of a pivot are connected by it, and not compared with each other: the largest such part of a region
   meets only the sets outside it. Smaller regions are joined in a task, where distances to the first pivots exclude pairs.
5. Links span the components, which `components` closes.

Defined results: null and empty texts have no n-gram and link with nothing; with fewer words than n, the whole
sequence is the one n-gram. Rows that repeat a doc_id are separate documents with one id. A null doc_id is kept and
counts as no id of a component. Extra columns may have any names (`distinct` keeps them). An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtrust.llm import wordhash
from tabtrust.llm.components import components, least_ids
from tabtrust.llm.scratch import light, quoted, small, table, trimmed

SKETCH_BITS = 22
SLICES = 64
#: Hash classes in which a set's n-grams are counted: so many for sets of at least so many n-grams.
CLASSES = ((0, 64), (400, 256), (1600, 1024))
#: Sets of a cell that one task tests at once.
TILE = 2048
#: Rows of cells, and n-grams of regions, that a task has, about.
TASK_ROWS = 20_000
TASK_GRAMS = 1_500_000
#: The most sets, and n-grams, of a region that one task joins.
LEAF_SETS = 1000
LEAF_GRAMS = 2_000_000
#: Pivots of a region that is divided; with up to so many bytes they are broadcast, else dealt by region and salt.
PIVOTS = 16
PIVOT_BYTES = 32 << 20
SALTS = 16
#: Cells that hold a set more often than this, on the average, don't part their region.
WINDOWS = 3


def sets(texts: list[bytes], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text, sorted distinct n-gram hashes) of every text."""
    for first, count, h, of in wordhash.blocks([t.translate(wordhash.LOWER) for t in texts]):
        number = np.bincount(of, minlength=count)
        grams, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(h) >= n:
            whole = of[: len(h) - n + 1] == of[n - 1 :]
            grams, owner = wordhash.sequences(h, n)[whole], of[: len(h) - n + 1][whole]
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        fresh = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])] if len(grams) else np.empty(0, bool)
        grams, owner = grams[fresh], owner[fresh]
        cut = np.searchsorted(owner, np.arange(count + 1))
        begin = np.cumsum(np.r_[0, number])
        for i in range(count):
            own = grams[cut[i] : cut[i + 1]]
            if not len(own) and number[i]:
                own = wordhash.sequences(h[begin[i] : begin[i + 1]], int(number[i]))
            yield first + i, own


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()]


def _sketch(n: int):
    """Counts by cell of a task's n-grams, up to 255 each, in SLICES rows."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, size = np.zeros(1 << SKETCH_BITS, np.uint8), [], 0

        def add() -> None:
            if waiting:
                cells, many = np.unique(np.concatenate(waiting), return_counts=True)
                counts[cells] = np.minimum(counts[cells] + many, 255)
                waiting.clear()

        for batch in batches:
            for _, own in sets(_texts(batch), n):
                waiting.append((own & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.uint32))
                size += len(own)
                if size > 1 << 20:
                    add()
                    size = 0
        add()
        used = [(i, x) for i, x in enumerate(np.split(counts, SLICES)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in used], pa.int32()), pa.array([x.tobytes() for _, x in used], pa.binary())], names=["slice", "counts"])

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint32)
    for x in pdf["counts"]:
        total += np.frombuffer(x, np.uint8)
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [total.astype("<u4").tobytes()]})


def frequency_class(docs: DataFrame, n: int) -> np.ndarray:
    """For each cell of the sketch (4 MB in all): 0, or by how many half doublings its count is above what chance gives the median cell."""
    parts = docs.mapInArrow(_sketch(n), "slice int, counts binary")
    rows = parts.groupBy("slice").applyInPandas(_add, "slice int, counts binary").collect()  # SLICES rows
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.float32)
    for r in rows:
        counts[r["slice"]] = np.frombuffer(r["counts"], "<u4")
    middle = float(np.median(counts))
    above = (counts.ravel() - middle) / (4 * middle**0.5 + 1)
    return np.clip(np.floor(2 * np.log2(np.maximum(0.5, above))) + 1, 0, 60).astype(np.uint8)


def _prefix_size(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


def _describe(n: int, num: int, den: int, classes: np.ndarray):
    """(key, doc_id, size, two hashes of the set, counts by class, first n-grams) of every document."""
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    least = next(s for s in range(1, 10**6) if s * den >= num * (s + 1))  # smaller sets link with equal ones only

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, counts, firsts = [], [], [], [], []
            for _, own in sets(_texts(batch), n):
                size.append(len(own))
                mixed = wordhash.mix(own + np.uint64(0x1234567))
                one.append(int(own.sum(dtype=np.uint64).astype(np.int64)) if len(own) else 0)
                two.append(int(np.bitwise_xor.reduce(mixed).astype(np.int64)) if len(own) else 0)
                counts.append(by_class(own).tobytes())
                if len(own) < least:
                    firsts.append(np.empty(0, np.int64))
                    continue
                order = np.lexsort((own, classes[own & mask]))
                firsts.append(own[order[: _prefix_size(len(own), num, den)]].astype(np.int64))
            offsets = np.r_[0, np.cumsum([len(x) for x in firsts])].astype(np.int32)
            flat = np.concatenate([*firsts, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["doc_id"], pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(counts, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["key", "doc_id", "size", "one", "two", "counts", "firsts"],
            )

    return run


def _whole(n: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x.astype("<u8").tobytes() for _, x in sets(_texts(batch), n)]
            yield pa.RecordBatch.from_arrays([batch["cid"], pa.array(own, pa.binary())], names=["cid", "grams"])

    return run


def by_class(own: np.ndarray) -> np.ndarray:
    """Number of n-grams, up to 255, in classes by the first bits of their hash."""
    classes = max(k for least, k in CLASSES if len(own) >= least)
    return np.minimum(np.bincount((own >> np.uint64(65 - classes.bit_length())).astype(np.int64), minlength=classes), 255).astype(np.uint8)


class Signatures:
    """Class counts of sets: rows in tables by number of classes; sets of different numbers are compared in the classes of the smaller."""

    def __init__(self, counts: list[bytes]):
        width, self.row, self.folded = np.array([len(x) for x in counts]), np.zeros(len(counts), np.int64), {}
        for k in np.unique(width).tolist():
            at = np.flatnonzero(width == k)
            self.row[at] = np.arange(len(at))
            self.folded[k, k] = np.frombuffer(b"".join(counts[i] for i in at.tolist()), np.uint8).reshape(len(at), k).astype(np.int16)
        self.width = width

    def _table(self, width: int, k: int) -> np.ndarray:
        if (width, k) not in self.folded:
            whole = self.folded[width, width]
            self.folded[width, k] = whole.reshape(len(whole), k, -1).sum(2, dtype=np.int16)
        return self.folded[width, k]

    def near(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether sets a can link with sets b: their difference is at most the sum of sizes * (den - num) / (den + num)."""
        difference, one, two = np.zeros(len(a), np.int64), self.width[a], self.width[b]
        for pair in np.unique(one * 65536 + two).tolist():
            v, w = divmod(pair, 65536)
            k, some = min(v, w), np.flatnonzero((one == v) & (two == w))
            for at in np.split(some, range(1 << 16, len(some), 1 << 16)):
                x, y = self._table(v, k)[self.row[a[at]]], self._table(w, k)[self.row[b[at]]]
                if v != w:  # classes that were cut at 255 are cut again when added up
                    x, y = np.minimum(x, 255), np.minimum(y, 255)
                difference[at] = np.abs(x - y).sum(1, dtype=np.int64)
        return difference * (den + num) <= (size[a] + size[b]) * (den - num)


def alike(size: np.ndarray, own: Signatures, first: int, side: np.ndarray, num: int, den: int) -> np.ndarray:
    """Component of each set of a tile (from `first` on, sorted by size) in the graph of pairs that can link. Sides other than 0 are tested with the other side."""
    n = len(side)
    label, mine = np.arange(n), size[first : first + n]
    if n <= 24:
        a, b = np.triu_indices(n, 1)
        ok = (mine[a] * den >= mine[b] * num) & ((side[a] == 0) | (side[a] != side[b]))
        a, b = a[ok], b[ok]
        ok = own.near(a + first, b + first, size, num, den)
        for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
        return label
    high = np.searchsorted(mine * num, mine * den, side="right")
    for i in range(n - 1):
        at = np.arange(i + 1, high[i])
        at = at[(label[at] != label[i]) & ((side[i] == 0) | (side[at] != side[i]))]
        if len(at):
            hit = at[own.near(np.full(len(at), i + first), at + first, size, num, den)]
            if len(hit):
                label[np.isin(label, label[hit])] = label[i]
    return label


def _test_cells(num: int, den: int):
    """(a, b): forests that span the sets of a cell that can link."""

    @trimmed
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pivot", "ta", "tb", "size", "cid"], kind="stable")
        own = Signatures(pdf["counts"].tolist())
        size, cid, head = pdf["size"].to_numpy(), pdf["cid"].to_numpy(), pdf[["pivot", "ta", "tb"]].to_numpy()
        side = np.where(head[:, 1] == head[:, 2], 0, pdf["own"].to_numpy() + 1)
        starts = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]).any(1)])
        out = [np.empty((0, 2), np.int64)]
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True):
            label = alike(size, own, s, side[s:e], num, den)
            at = np.flatnonzero(label != np.arange(e - s))
            if len(at):
                out.append(np.stack([cid[s + at], cid[s + label[at]]], 1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    return run


def connect(ids: np.ndarray, own: list[np.ndarray], label: np.ndarray, home: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that span the components of a region, each of sets with different labels, at least one of them at home, and of sides that meet."""
    n, sizes = len(ids), np.array([len(x) for x in own])
    offsets, counts = np.r_[0, np.cumsum(sizes)], Signatures([by_class(x).tobytes() for x in own])
    values, codes = np.unique(np.concatenate(own), return_inverse=True)
    label, out, member = label.copy(), [], np.zeros(len(values), bool)
    radius = 1 - num / den + 1e-9
    pivots: list[np.ndarray] = []  # distances of all sets to the first few pivots
    for p in range(n - 1):
        rest = slice(p + 1, n)
        open_ = (label[rest] != label[p]) & (home[rest] | home[p]) & ((side[p] == 0) | (side[rest] != side[p]))
        open_ &= (np.minimum(sizes[rest], sizes[p]) * den >= np.maximum(sizes[rest], sizes[p]) * num)
        for d in pivots:
            open_ &= np.abs(d[rest] - d[p]) <= radius
        at = np.flatnonzero(open_) + p + 1
        if not len(at):
            continue
        first = n > 50 and len(pivots) < 6
        if first:
            at, part, cut = np.arange(n), codes, offsets[:-1]
        else:
            at = at[counts.near(np.full(len(at), p), at, sizes, num, den)]
            if not len(at):
                continue
            part, cut = np.concatenate([codes[offsets[i] : offsets[i + 1]] for i in at]), np.r_[0, np.cumsum(sizes[at])[:-1]]
        mine = codes[offsets[p] : offsets[p + 1]]
        member[mine] = True
        shared = np.add.reduceat(member[part], cut, dtype=np.int64)
        member[mine] = False
        union = sizes[at] + sizes[p] - shared
        if first:
            pivots.append(1 - shared / union)
        for i in at[(shared * den >= num * union) & (label[at] != label[p])].tolist():
            if label[i] != label[p]:
                out.append((int(ids[p]), int(ids[i])))
                label[label == label[i]] = label[p]
    return out


def _join(num: int, den: int):
    @trimmed
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, region in pdf.groupby("region", sort=True):
            region = region.sort_values("cid", kind="stable")
            own = [np.frombuffer(x, "<u8") for x in region["grams"]]
            out += connect(region["cid"].to_numpy(), own, region["label"].to_numpy(), region["home"].to_numpy(), region["side"].to_numpy(), num, den)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def voronoi(own: np.ndarray, pivots: list[np.ndarray], num: int, den: int) -> tuple[int, list[int], list[bool]]:
    """(nearest pivot, pivots whose cells a set goes to, whether it links with each of these)."""
    shared = np.array([len(np.intersect1d(own, p, assume_unique=True)) for p in pivots])
    union = np.array([len(p) for p in pivots]) + len(own) - shared
    distance = 1 - shared / union
    at = np.flatnonzero(distance <= distance.min() + 2 * (1 - num / den) + 1e-9)
    return int(distance.argmin()), at.tolist(), (shared[at] * den >= num * union[at]).tolist()


CELLS = T.ArrayType(T.StructType([T.StructField("pivot", T.LongType()), T.StructField("home", T.BooleanType()), T.StructField("linked", T.BooleanType())]))


def _divide(num: int, den: int):
    def run(grams: pd.Series, cids: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for own, names, pivots in zip(grams, cids, bodies, strict=True):
            nearest, at, linked = voronoi(np.frombuffer(own, "<u8"), [np.frombuffer(p, "<u8") for p in pivots], num, den)
            out.append([{"pivot": int(names[i]), "home": i == nearest, "linked": k} for i, k in zip(at, linked, strict=True)])
        return pd.Series(out)

    return F.pandas_udf(run, CELLS)


def _leaves(regions: DataFrame, grams: DataFrame, num: int, den: int) -> DataFrame:
    work = regions.join(grams, "cid")
    tasks = max(1, -(-(work.agg(F.sum(F.length("grams"))).first()[0] or 0) // (8 * TASK_GRAMS)))
    work = work.withColumn("part", F.pmod(F.xxhash64("region"), F.lit(int(tasks))))
    return table(work.groupBy("part").applyInPandas(_join(num, den), "a long, b long"), "links")


def _links(regions: DataFrame, grams: DataFrame, num: int, den: int, most: int, most_grams: int = LEAF_GRAMS) -> list[DataFrame]:
    """regions (region, cid): links that span each region's components."""
    fresh = {"label": F.col("cid"), "home": F.lit(True), "side": F.lit(0), "before": F.lit(2**62)}
    found, regions, level = [], table(regions.select("region", "cid").withColumns(fresh), "regions"), 0
    while True:
        sizes = regions.join(grams.select("cid", (F.length("grams") / 8).cast("long").alias("n")), "cid").groupBy("region")
        sizes = sizes.agg(F.count("*").alias("members"), F.sum("n").alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.bool_or("home").alias("home"), F.min("before").alias("before"))
        large = table(sizes.where((F.col("before") > 0) & ((F.col("members") > most) | (F.col("n") > most_grams)) & (F.col("members") > 2)), "large")
        number = large.count()
        rest = regions.join(small(large.select("region"), number), "region", "left_anti") if number else regions
        found.append(_leaves(rest, grams, num, den))
        if not number:
            return found
        large = large.where((F.col("l0") != F.col("l1")) & F.col("home")).withColumn("halved", F.col("members") * 2 <= F.col("before"))
        rows = regions.select("region", "cid", "label", "home").join(small(large.select("region", "members", "n", "halved"), number), "region")
        far = _distances(rows.where("halved").drop("halved"), grams, num, den, level)
        found.append(far.select("cid", F.explode("cells").alias("x")).where("x.linked and cid != x.pivot").select(F.col("x.pivot").alias("a"), F.col("cid").alias("b")))
        # cells are used where they hold each set WINDOWS times at most, on the average; else the pivots have only connected sets
        worth = table(far.groupBy("region").agg((F.sum(F.size("cells")) <= WINDOWS * F.count("*")).alias("worth")), "worth")
        far = far.join(small(worth, number), "region")
        cells = far.where("worth").select("region", "cid", "label", "members", F.explode("cells").alias("x")).select("region", "cid", "label", "members", "x.*")
        cells = cells.select(F.xxhash64("region", "pivot").alias("region"), "cid", F.when(F.col("linked"), F.col("pivot")).otherwise(F.col("label")).alias("label"), "home", F.lit(0).alias("side"), F.col("members").alias("before"))
        left = far.where("not worth").select("region", "cid", "linked", "home", "members", "n").withColumnRenamed("linked", "label")
        left = left.unionByName(rows.where("not halved").drop("halved"))
        regions, level = table(cells.unionByName(_blocks(left, most, most_grams, number)), "regions"), level + 1


def _distances(rows: DataFrame, grams: DataFrame, num: int, den: int, level: int) -> DataFrame:
    """rows with the cells that a set goes to, and `linked`: the pivot it is connected by, of several the one that connects most, else its label."""
    # each region's pivots: about four times as many are drawn by hash, and the first of them taken
    h = F.xxhash64("cid", F.lit(level))
    drawn = rows.where(F.pmod(h, F.col("members")) < 4 * PIVOTS).groupBy("region").agg(F.slice(F.array_sort(F.collect_list(F.struct(h.alias("h"), "cid"))), 1, PIVOTS).alias("p"))
    drawn = drawn.select("region", F.explode("p.cid").alias("cid")).join(grams, "cid")
    pivots = table(drawn.groupBy("region").agg(F.collect_list(F.struct("cid", "grams")).alias("p")).select("region", F.col("p.cid").alias("cids"), F.col("p.grams").alias("bodies")), "pivots")
    size, number = pivots.agg(F.sum(F.aggregate("bodies", F.lit(0).cast("long"), lambda s, x: s + F.length(x))), F.count("*")).first()
    far = rows.join(grams, "cid")
    if (size or 0) <= PIVOT_BYTES:
        far = far.join(F.broadcast(pivots), "region")
    else:
        salted = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        far = far.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).join(salted, ["region", "salt"])
    far = table(far.select("region", "cid", "label", "home", "members", "n", _divide(num, den)("grams", "cids", "bodies").alias("cells")), "distances")
    by_pivot = far.select("region", F.explode("cells").alias("x")).where("x.linked").groupBy("region", "x.pivot").agg(F.count("*").alias("c"))
    degree = by_pivot.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("pivot", "c"))).alias("degree"))  # PIVOTS entries a region
    linked = F.filter("cells", lambda x: x["linked"])
    best = F.array_max(F.transform(linked, lambda x: F.struct(F.element_at("degree", x["pivot"]).alias("c"), x["pivot"].alias("pivot"))))
    return far.join(small(degree, number), "region", "left").withColumn("linked", F.coalesce(best["pivot"], F.col("label"))).drop("degree")


def _blocks(rows: DataFrame, most: int, most_grams: int, number: int) -> DataFrame:
    """Regions that a task joins, of blocks of sets: those of a region's most frequent label, which are connected, meet the others only."""
    labels = rows.groupBy("region", "label").agg(F.count("*").alias("c"))
    labels = labels.groupBy("region").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("core"), F.sum("c").alias("all"))
    rows = rows.join(small(table(labels, "labels"), number), "region")
    room = F.greatest(F.lit(1), F.least(F.lit(most / 2), F.lit(most_grams / 2) * F.col("members") / F.col("n")).cast("long"))
    others, cores = F.ceil((F.col("all") - F.col("core")) / room).cast("int"), F.ceil(F.col("core") / room).cast("int")
    is_core = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("cid"), F.greatest(F.lit(1), F.when(is_core, cores).otherwise(others))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # blocks of others are 0, 1, ...; those of the core are -1, -2, ...
    met = F.when(is_core, upto(others)).otherwise(F.concat(upto(others), F.transform(upto(cores), lambda j: -1 - j)))
    rows = rows.withColumn("own", F.when(is_core, -1 - own).otherwise(own)).withColumn("other", F.explode(met))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return rows.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "cid", "label", "home", side.alias("side"), F.lit(0).cast("long").alias("before"))


def _gram_table(docs: DataFrame, cids: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """(cid, grams) of classes, built again from the text of one document of each."""
    needed = table(cids.distinct().join(groups.select("cid", F.col("member.key").alias("at"), F.col("member.doc_id").alias("of")), "cid"), "needed")
    texts = docs.join(small(needed, needed.count()), (F.col("key") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("cid", "text")
    return table(texts.mapInArrow(_whole(n), "cid long, grams binary").groupBy("cid").agg(F.first("grams").alias("grams")), "grams")


def _cells(groups: DataFrame, tile: int) -> DataFrame:
    """(pivot, cid, ta, tb, own): the sets of each pivot's cell, large ones in tiles of blocks."""
    order = F.struct(F.xxhash64("cid").alias("h"), "cid")
    tokens = groups.select("cid", F.explode("firsts").alias("token"))
    regions = tokens.groupBy("token").agg(F.count("*").alias("members"), F.min(order).alias("least")).where("members > 1")
    regions = table(regions.select("token", F.col("least.cid").alias("pivot")), "tokens")
    cells = table(tokens.join(regions, "token").select("pivot", "cid").distinct(), "cells")
    size = cells.groupBy("pivot").agg(F.count("*").alias("members"))
    large = table(size.where(F.col("members") > tile), "large")
    cells = cells.join(small(large, large.count()), "pivot", "left")
    blocks = F.coalesce(F.ceil(F.col("members") * 2 / tile), F.lit(1)).cast("int")
    cells = cells.withColumns({"own": F.pmod(F.xxhash64("cid"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    return cells.select("pivot", "cid", F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"), (F.col("own") > F.col("other")).cast("int").alias("own"))


def join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", most: int = LEAF_SETS, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row."""
    plain = light(docs).select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    classes = frequency_class(plain.select("text"), n)
    rows = table(plain.mapInArrow(_describe(n, num, den, classes), "key long, doc_id long, size long, one long, two long, counts binary, firsts array<long>"), "sets")
    # sets with equal sizes and two equal 64-bit hashes are equal sets; texts without words stay alone
    groups = rows.where("size > 0").groupBy("size", "one", "two").agg(F.min("doc_id").alias("least"), F.first(F.struct("key", "doc_id")).alias("member"), F.first("counts").alias("counts"), F.first("firsts").alias("firsts"))
    groups = table(groups.withColumn("cid", F.monotonically_increasing_id()), "classes")
    cells = _cells(groups, tile)
    tasks = max(1, -(-cells.count() // TASK_ROWS))
    cells = cells.join(groups.select("cid", "size", "counts"), "cid").withColumn("part", F.pmod(F.xxhash64("pivot", "ta", "tb"), F.lit(tasks)))
    regions = components(cells.groupBy("part").applyInPandas(_test_cells(num, den), "a long, b long")).select(F.col("component").alias("region"), F.col("node").alias("cid"))
    regions = table(regions, "regions")
    grams = _gram_table(plain, regions.select("cid"), groups, n)
    edges = None
    for found in _links(regions, grams, num, den, most):
        edges = found if edges is None else edges.unionByName(found)
    member = components(edges)
    member = groups.select("cid", "least").join(member, F.col("cid") == F.col("node")).select("cid", "component", "least")
    member = least_ids(member)
    known = groups.select("cid", "size", "one", "two", "least").join(member, "cid", "left").select("size", "one", "two", F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("doc_id", "size", "one", "two").join(known, ["size", "one", "two"], "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less those that are in a component with a smaller id. Rows with the same id stay or go together; those without an id stay."""
    gone = join(docs, n, num, den, id_col, text_col).where(quoted(id_col) != F.col("component_id")).select(quoted(id_col).alias("__gone")).distinct()
    gone = table(gone, "gone")
    return docs.join(small(gone, gone.count()), quoted(id_col) == F.col("__gone"), "left_anti")


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM grams a JOIN grams b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * both_have >= 90 * (len(x.s) + len(y.s) - both_have)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, root) AS (SELECT doc_id, doc_id FROM sets UNION SELECT b, root FROM reached JOIN edges ON doc_id = a WHERE root < b)
SELECT doc_id, CAST(len(any_value(s)) AS BIGINT) AS n_shingles, min(root) AS component_id FROM reached JOIN sets USING (doc_id) GROUP BY doc_id
"""
