"""Substring dedup by suffix automata of reference shards and matching statistics.

A window is `length` consecutive words; a word goes if a window over it also starts in a document with a smaller id.

1. Documents with equal words become one class; only the one with the least id is looked at, the others go as a whole.
2. Filter: of every window the half-window with the least hash (its minimizer) is noted, so equal windows note the
   same one. Where a minimizer occurs in several documents, all half-windows around it are counted over the
   documents. Runs of repeated half-windows are the passages that can repeat.
3. The windows of a passage with one minimizer are a context. Equal contexts are taken together by partial aggregation,
   with their least id; so a passage in a third of all documents is one row. These are the reference. Its shards hold
   about SHARD_WORDS words: contexts of one minimizer are in one shard, unless they alone are more than a shard.
4. A suffix automaton is built of each shard, each state with the least id in which it ends. Automata of at most
   BROADCAST_BYTES in all are broadcast, and contexts stream through that of their minimizer's shard, or shards; beyond
   that size, each is built in the task to which its shard's contexts are dealt, as the reference grows with the
   documents. The matching statistic is cut at `length`: the state
   that then holds is the one of the window, and its id says which documents lose it.

Words are compared by 64-bit hashes. Defined results: null and empty texts have no words. A null doc_id is never
smaller nor larger than any other, so such rows keep everything and take nothing. Rows that repeat a doc_id don't
remove each other's words. Texts may be of any length. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtrust.llm import wordhash
from tabtrust.llm.scratch import light, quoted, small, table, trimmed

#: Words of a shard of the reference, about.
SHARD_WORDS = 50_000
#: Automata are broadcast up to so many bytes in all; WORD_BYTES is what one word takes, about.
BROADCAST_BYTES = 48 << 20
WORD_BYTES = 60
#: Broadcast automata that a task holds at once, ready to use.
HELD = 4
NEVER = 2**63 - 1


def slide(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Least (or largest) of each `width` consecutive values, by doubling."""
    pick, out, have = (np.minimum if least else np.maximum), values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def minimizers(grams: np.ndarray, windows: int) -> np.ndarray:
    """Positions of the half-windows that are least in one of the windows; `windows` half-windows start in each."""
    if len(grams) < windows:
        return np.empty(0, np.int64)
    least = slide(grams, windows)
    padded = np.concatenate((np.zeros(windows - 1, np.uint64), least, np.zeros(windows - 1, np.uint64)))
    return np.flatnonzero(slide(padded, windows, least=False) == grams)


class Automaton:
    """Suffix automaton of several sequences; low: the least owner among the places where a state's words end."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.low = [-1], [0], [NEVER]

    def _state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.low.append(NEVER)
        return len(self.next) - 1

    def _split(self, at: int, word: int, child: int) -> int:
        """The part of child that is one word longer than at, as a state of its own."""
        part = self._state(self.size[at] + 1, self.link[child], dict(self.next[child]))
        while at >= 0 and self.next[at].get(word) == child:
            self.next[at][word] = part
            at = self.link[at]
        self.link[child] = part
        return part

    def _extend(self, last: int, word: int) -> int:
        child = self.next[last].get(word)
        if child is not None:
            return child if self.size[child] == self.size[last] + 1 else self._split(last, word, child)
        state, at = self._state(self.size[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            child = self.next[at][word]
            self.link[state] = child if self.size[child] == self.size[at] + 1 else self._split(at, word, child)
        return state

    def add(self, words: list[int], owner: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            self.low[last] = min(self.low[last], owner)

    def close(self) -> None:
        """Owners to all suffixes, longest states first."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[state]
            self.low[up] = min(self.low[up], self.low[state])

    def dump(self) -> bytes:
        return pickle.dumps((self.next, self.link, self.size, self.low), pickle.HIGHEST_PROTOCOL)

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        out = cls()
        out.next, out.link, out.size, out.low = pickle.loads(data)
        return out

    def owners(self, words: list[int], length: int) -> list[int]:
        """Least owner of each window, NEVER where it doesn't occur: matching statistics cut at `length`."""
        out, state, have = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                have = self.size[state]
            if word in self.next[state]:
                state, have = self.next[state][word], have + 1
            if have >= length:
                have = length
                while self.size[self.link[state]] >= length:
                    state = self.link[state]
            if i + 1 >= length:
                out.append(self.low[state] if have >= length else NEVER)
        return out


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def split(text: bytes) -> list[bytes]:
    """Words between white space of the bytes 09 to 0D and 20, which is what bytes.split takes."""
    return text.split()


def _describe(length: int):
    """(doc_id, n_words, two hashes of the words, digest of all words, minimizers) of every document."""
    half = length // 2

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch["text"])
            n, one, two, firsts = [], [], [], []
            sha = [hashlib.sha256(b" ".join(split(t))).hexdigest() for t in texts]
            for _, count, h, of in wordhash.blocks(texts):
                cut = np.searchsorted(of, np.arange(count + 1))
                for i in range(count):
                    own = h[cut[i] : cut[i + 1]]
                    n.append(len(own))
                    weights = wordhash.powers(len(own))
                    one.append(int(_signed(np.array([(own * weights).sum(dtype=np.uint64)]))[0]))
                    two.append(int(_signed(np.array([(wordhash.mix(own) * weights).sum(dtype=np.uint64)]))[0]))
                    grams = wordhash.sequences(own, half)
                    firsts.append(np.unique(_signed(grams[minimizers(grams, length - half + 1)])))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in firsts]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["doc_id"], pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*firsts, np.empty(0, np.int64)])))],
                names=["key", "doc_id", "n_words", "one", "two", "sha", "firsts"],
            )

    return run


def _regions(length: int):
    """Words around the shared minimizers of each document: starts and sizes of the regions, their hashes one after another."""
    half = length // 2
    after = length - half

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, sizes, words = [], [], []
            for text, shared in zip(_texts(batch["text"]), batch["shared"].to_pylist(), strict=True):
                h, _, _ = wordhash.words(text)
                at = np.flatnonzero(np.isin(_signed(wordhash.sequences(h, half)), np.array(shared, np.int64)))
                step = np.zeros(len(h) + 1, np.int64)
                np.add.at(step, np.maximum(at - after, 0), 1)
                np.add.at(step, np.minimum(at + length, len(h)), -1)
                inside = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
                starts.append(edge[0::2].tolist())
                sizes.append((edge[1::2] - edge[0::2]).tolist())
                words.append(h[inside].tobytes())
            yield pa.RecordBatch.from_arrays([batch["key"], batch["doc_id"], pa.array(starts, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64())), pa.array(words, pa.binary())], names=["key", "doc_id", "starts", "sizes", "words"])

    return run


def _pieces(words: bytes, sizes: list[int]) -> list[np.ndarray]:
    return np.split(np.frombuffer(words, "<u8"), np.cumsum(sizes)[:-1])


def _grams(half: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, sizes, words in zip(batch["key"].to_pylist(), batch["doc_id"].to_pylist(), batch["sizes"].to_pylist(), batch["words"].to_pylist(), strict=True):
                g = np.concatenate([_signed(wordhash.sequences(p, half)) for p in _pieces(words, sizes)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), key, np.int64)), pa.array(np.full(len(g), doc, np.int64)), pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g)], names=["key", "doc_id", "i", "g"])

    return run


def _contexts(length: int):
    """(doc, place of the first window, minimizer, hash of the context, its words) of the runs of repeated half-windows."""
    half = length // 2
    windows = length - half + 1

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for row, doc, starts, sizes, words, hits in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "starts", "sizes", "words", "hits")), strict=True):
                hits, base = np.unique(np.array(hits, np.int64)), 0
                for start, own in zip(starts, _pieces(words, sizes), strict=True):
                    g = wordhash.sequences(own, half)
                    mine = hits[np.searchsorted(hits, base) : np.searchsorted(hits, base + len(g))] - base
                    base += len(g)
                    for part in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1):
                        if len(part) < windows:
                            continue
                        a, b = int(part[0]), int(part[-1]) + 1
                        least = slide(g[a:b], windows)
                        heads = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                        for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(least)], strict=True):
                            body = own[a + s : a + e - 1 + length]
                            key = (int(_signed(least[s : s + 1])[0]), int(_signed(wordhash.mix(np.array([(body * wordhash.powers(len(body))).sum(dtype=np.uint64) + np.uint64(len(body))])))[0]))
                            fresh = key not in seen
                            if fresh:
                                if len(seen) > 200_000:
                                    seen.clear()
                                seen.add(key)
                            for col, value in zip(out, (row, doc, start + a + s, *key, body.tobytes() if fresh else None), strict=True):
                                col.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.binary())], names=["key", "doc_id", "at", "minimizer", "context", "words"])

    return run


def _automaton(words: pd.Series, lows: pd.Series) -> Automaton:
    automaton = Automaton()
    for body, low in zip(words, lows.tolist(), strict=True):
        automaton.add(np.frombuffer(body, "<u8").tolist(), low)
    automaton.close()
    return automaton


@trimmed
def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The automaton of a shard."""
    pdf = pdf.sort_values(["minimizer", "context"], kind="stable")
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "automaton": [_automaton(pdf["words"], pdf["low"]).dump()]})


def _stream(shared, length: int):
    """Contexts through broadcast automata, those of a shard one after the other where batches hold several."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Automaton] = {}
        for batch in batches:
            batch, lows = batch.take(pa.array(np.argsort(batch["shard"].to_numpy(), kind="stable"))), []
            for shard, body in zip(batch["shard"].to_pylist(), batch["words"], strict=True):
                if shard not in held:
                    if len(held) >= HELD:
                        held.clear()
                    held[shard] = Automaton.load(shared.value[shard])
                lows.append(held[shard].owners(np.frombuffer(body.as_py(), "<u8").tolist(), length))
            yield pa.RecordBatch.from_arrays([batch["minimizer"], batch["context"], pa.array(lows, pa.list_(pa.int64()))], names=["minimizer", "context", "lows"])

    return run


def _meet(length: int):
    """Contexts through the automaton of a shard that is built beside them."""

    @trimmed
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["minimizer", "context"], kind="stable")
        own, visit = pdf[pdf["builds"]], pdf[pdf["streams"]]
        automaton = _automaton(own["words"], own["low"])
        return pd.DataFrame({"minimizer": visit["minimizer"], "context": visit["context"], "lows": [automaton.owners(np.frombuffer(w, "<u8").tolist(), length) for w in visit["words"]]})

    return run


def _places(reference: DataFrame, words: float, shard_words: int) -> DataFrame:
    """reference with shard, chunk, builds, streams and parts. A minimizer with more words than a shard has several parts, each a
    shard, and as many chunks: every chunk of its contexts streams through every part."""
    shards = max(1, math.ceil(words / shard_words))
    size = reference.groupBy("minimizer").agg(F.sum(F.length("words") / 8).alias("w")).where(F.col("w") > shard_words)
    size = table(size.select("minimizer", F.ceil(F.col("w") / shard_words).cast("int").alias("parts")), "split")
    rows = reference.join(small(size, size.count()), "minimizer", "left").withColumn("own", F.pmod(F.xxhash64("context"), F.col("parts")).cast("int"))
    place = lambda part, chunk, builds, streams: F.struct(part.alias("part"), chunk.alias("chunk"), builds.alias("builds"), streams.alias("streams"))
    own, yes, no = F.col("own"), F.lit(True), F.lit(False)
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    built = F.transform(every, lambda k: place(own, k, yes, k == own))
    visited = F.transform(F.filter(every, lambda k: k != own), lambda k: place(k, own, no, yes))
    alone = F.array(place(F.lit(0), F.lit(0), yes, yes))
    rows = rows.withColumn("x", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(F.concat(built, visited)))).select("*", "x.*")
    shard = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("minimizer"), F.lit(shards))).otherwise(F.xxhash64("minimizer", "part"))
    return rows.select("minimizer", "context", "low", "words", "parts", shard.alias("shard"), "chunk", "builds", "streams")


def judged(reference: DataFrame, length: int, shard_words: int = SHARD_WORDS, most: int = BROADCAST_BYTES) -> DataFrame:
    """reference (minimizer, context, low, words): (minimizer, context, lows), the least id that has each window of a context."""
    words = float(reference.agg(F.sum(F.length("words") / 8)).first()[0] or 0)
    places, result, size = _places(reference, words, shard_words), "minimizer long, context long, lows array<long>", most + 1
    if WORD_BYTES * words <= most:
        automata = table(places.where("builds and chunk = 0").groupBy("shard").applyInPandas(_build, "shard long, automaton binary"), "automata")
        size = automata.agg(F.sum(F.length("automaton"))).first()[0] or 0
    if size <= most:
        shared = reference.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["automaton"]) for r in automata.collect()})  # `most` bytes
        found = places.where("streams").select("minimizer", "context", "words", "shard").mapInArrow(_stream(shared, length), result)
    else:
        found = places.groupBy("shard", "chunk").applyInPandas(_meet(length), result)
    split = places.where("parts is not null").select(F.col("minimizer").alias("m")).distinct()
    split = table(split, "several")
    found = table(found.join(small(split, split.count()), F.col("minimizer") == F.col("m"), "left"), "streamed")
    several = found.where("m is not null").groupBy("minimizer", "context").agg(F.collect_list("lows").alias("all"))  # one for each part
    least = F.aggregate(F.slice("all", 2, 1 << 30), F.col("all")[0], lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y)))
    return found.where("m is null").drop("m").unionByName(several.select("minimizer", "context", least.alias("lows")))


def passages(docs: DataFrame, rows: DataFrame, length: int, shard_words: int, most: int) -> DataFrame:
    """Of the documents `rows` (key, doc_id, firsts): (key, windows), the places of windows that start in a smaller document too."""
    half = length // 2
    noted = rows.select("key", "doc_id", F.explode("firsts").alias("g"))
    shared = table(noted.groupBy("g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("g"), "shared")
    shared = table(noted.join(shared, "g", "left_semi").groupBy("key").agg(F.collect_list("g").alias("shared")), "documents")
    texts = docs.join(small(shared.select("key"), shared.count()), "key", "left_semi").join(shared, "key")
    regions = table(texts.mapInArrow(_regions(length), "key long, doc_id long, starts array<long>, sizes array<long>, words binary").where(F.length("words") >= 8 * length), "regions")
    grams = table(regions.mapInArrow(_grams(half), "key long, doc_id long, i int, g long"), "grams")
    repeated = table(grams.groupBy("g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("g"), "repeated")
    hits = grams.join(repeated, "g", "left_semi").groupBy("key").agg(F.collect_list("i").alias("hits"))
    contexts = table(regions.join(hits, "key").mapInArrow(_contexts(length), "key long, doc_id long, at long, minimizer long, context long, words binary"), "contexts")
    distinct = table(contexts.groupBy("minimizer", "context").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("hi"), F.max("words").alias("words")), "distinct")
    # a context that all its documents share with no other one, and no other context has its minimizer, removes nothing
    several = distinct.groupBy("minimizer").agg(F.count("*").alias("c"), F.max(F.col("low") < F.col("hi")).alias("shared")).where("c > 1 or shared").select("minimizer")
    reference = table(distinct.join(several, "minimizer", "left_semi").select("minimizer", "context", "low", "words"), "reference")
    answers = judged(reference, length, shard_words, most)
    found = contexts.select("key", "doc_id", "at", "minimizer", "context").join(answers, ["minimizer", "context"])
    windows = F.filter(F.transform("lows", lambda low, j: F.when(low < F.col("doc_id"), F.col("at") + j)), lambda x: x.isNotNull())
    return found.select("key", windows.alias("w")).where(F.size("w") > 0).groupBy("key").agg(F.flatten(F.collect_list("w")).alias("windows"))


def keep(text: bytes, windows: list[int], length: int) -> tuple[int, int, bytes, list[tuple[int, int]]]:
    """(words, removed words, kept words, maximal removed spans in words)."""
    own = split(text)
    step, at = np.zeros(len(own) + 1, np.int64), np.array(windows, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    gone = np.cumsum(step[:-1]) > 0
    edge = np.flatnonzero(np.diff(gone.view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
    kept = b" ".join(w for w, g in zip(own, gone.tolist(), strict=True) if not g)
    return len(own), int(gone.sum()), kept, list(zip(edge[0::2], edge[1::2], strict=True))


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:long,end:long>>"


def _result(length: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            done = [keep(t, w, length) for t, w in zip(_texts(batch["text"]), batch["windows"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in done], pa.string()), pa.array([x[2].decode() for x in done], pa.string()), pa.array([[{"start": s, "end": e} for s, e in x[3]] for x in done], span)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"],
            )

    return run


def _judged(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The description of all documents, the keys of those whose words all go as copies, and the others with their minimizers."""
    rows = table(docs.mapInArrow(_describe(length), "key long, doc_id long, n_words long, one long, two long, sha string, firsts array<long>"), "described")
    words = ["n_words", "one", "two"]
    long = rows.where((F.col("n_words") >= length) & F.col("doc_id").isNotNull())
    several = table(long.groupBy(*words).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(*words, "least"), "copies")
    whole = table(long.select("key", "doc_id", *words).join(small(several, several.count()), words).where("doc_id > least").select("key").distinct(), "whole")
    left = long.join(small(whole, whole.count()), "key", "left_anti").groupBy("key", "doc_id").agg(F.first("firsts").alias("firsts"))
    return rows, whole, left


def removed(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, most: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the kept words) and spans (removed, in words) of every row;
    the last two are null for rows that lose nothing."""
    plain = light(docs).select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    plain = plain.withColumn("key", F.xxhash64("doc_id", "text"))
    rows, whole, left = _judged(plain, length)
    windows = table(passages(plain, left, length, shard_words, most), "windows")
    hit = table(windows.select("key"), "hit")
    some = small(hit, hit.count())
    out = rows.join(some, "key", "left_anti").select("key", "doc_id", "n_words", "sha").join(small(whole.withColumn("all", F.lit(True)), whole.count()), "key", "left")
    gone = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = out.select("doc_id", "n_words", F.when(F.col("all"), F.col("n_words")).otherwise(0).alias("n_removed"), F.when(F.col("all"), empty).otherwise(F.col("sha")).alias("kept_sha256"), F.when(F.col("all"), F.lit("")).alias("kept"), F.when(F.col("all"), gone).alias("spans"))
    texts = plain.join(some, "key", "left_semi").join(windows, "key").select("doc_id", "text", "windows")
    return out.unionByName(texts.mapInArrow(_result(length), RESULT))


def digest(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, most: int = BROADCAST_BYTES) -> DataFrame:
    return removed(docs, length, id_col, text_col, shard_words, most).select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
firsts AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (g) WHERE least < doc_id),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS text, count(*) AS n FROM places p ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept k USING (doc_id)
"""
