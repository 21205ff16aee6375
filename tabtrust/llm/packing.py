"""Packing by first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Documents are tokenised in Arrow batches. Whole sequences are cut from a document as pieces of their own; what is left
of it (under one sequence) is packed. Groups are drawn by a hash of the document and of its place in the task, and the
draw is written with the pieces, so that each holds about `group_docs` documents whatever their order or source, also
where one row is repeated often. They are packed independently: memory and time of a task depend on the group's size
alone, a hot source is spread over all groups, and a lost executor repeats its groups with the same result.

Ids are those of the `tokenizers` file. They are computed with `tiktoken` from the same vocabulary, which gives the
same ids several times faster (the tests compare both); texts with a special token's string go through `tokenizers`.

Defined results: a null text is empty; every document, also an empty one, ends with id 0 and so has at least one
piece. A null doc_id is kept; rows that repeat a document are packed one by one. Extra columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import array
import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtrust.llm.scratch import light, quoted, table, trimmed

SIZE = 1024
GROUP_DOCS = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (at most size). The tree's leaves are the bins' free room, each inner node the
    larger of its children: the first bin with room is found by walking down, left child first."""
    n = len(lengths)
    width = 1 << max(0, n - 1).bit_length()
    tree = [size] * (2 * width)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, at = int(lengths[i]), 1
        while at < width:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[i], offsets[i] = at - width, size - tree[at]
        tree[at] -= need
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return bins, offsets


@functools.lru_cache(1)
def _encoders():
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    pattern = public_tokenizers.PATTERN
    whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    # without runs of white space the look-ahead changes nothing, and its regular expression engine is slower
    plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    specials = [t.content for t in slow.get_added_tokens_decoder().values()]
    return plain, whole, slow, re.compile("|".join(map(re.escape, specials)) if specials else r"(?!)")


RUN = re.compile(r"\s\s")


def token_ids(text: str) -> list[int]:
    plain, whole, slow, special = _encoders()
    if special.search(text):
        return slow.encode(text, add_special_tokens=False).ids
    return (whole if RUN.search(text) else plain).encode_ordinary(text)


def _pieces(size: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, places = TaskContext.get().partitionId() << 40, itertools.count()
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, salt, text in zip(batch["doc_id"].to_pylist(), batch["salt"].to_pylist(), batch["text"], strict=True):
                ids = array.array("I", token_ids(text.as_py() or ""))
                ids.append(0)
                n, raw, salt = len(ids), memoryview(np.asarray(ids, "<u4")).cast("B"), salt ^ (task + next(places))
                for start in range(0, n, size):
                    stop = min(n, start + size)
                    for col, value in zip(cols, (doc_id, salt, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), n), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "salt", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _pack(size: int):
    @trimmed
    def run(group: pa.Table) -> pa.Table:
        # ties are broken by content, so that a repeated task gives the same sequences
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "salt", "start", "ids_crc32")])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), size)
        out = {"sequence_id": pa.array((group["grp"].to_numpy() << 32) + bins), "offset": pa.array(offsets)}
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.table([out.get(c, group[c] if c in group.column_names else None) for c in names], names=names)

    return run


def pack(docs: DataFrame, size: int = SIZE, group_docs: int = GROUP_DOCS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pieces of one document are in one group. Sequences are up to `size` tokens; shorter ones are padded by the reader.
    """
    rows = light(docs).select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(F.lit(seed), quoted(id_col), F.length(quoted(text_col)), F.substring(quoted(text_col), 1, 64)).alias("salt"), quoted(text_col).cast("string").alias("text"))
    pieces = table(rows.mapInArrow(_pieces(size), "doc_id long, salt long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    groups = max(1, -(-pieces.where("start = 0").count() // group_docs))
    full = pieces.where(F.col("length") == size)
    rest = pieces.where(F.col("length") < size).withColumn("grp", F.pmod(F.xxhash64("salt"), F.lit(groups)))
    packed = rest.groupBy("grp").applyInArrow(_pack(size), PIECES)
    # a whole sequence needs no packing; negative numbers tell those sequences from packed ones
    alone = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
