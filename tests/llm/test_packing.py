"""Pieces cover each document's ids once, sequences are gapless, and ids are those of `tokenizers`."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tabtrust.llm import packing

SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return [*SLOW.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, out, size=1024):
    """rows (id, text) with distinct ids."""
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == {d for d, _ in rows}
    for d, text in rows:
        own, at = ids(text), 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            part = np.array(own[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(part.tobytes())) and r["length"] > 0
            at += r["length"]
        assert at == len(own)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(sequences)


def test_documents(tables):
    docs = tables("documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    out = packing.pack(docs).collect()
    n = check(rows, out)
    assert sum(r["length"] for r in out) >= 0.95 * 1024 * n


def test_same_ids():
    rng = random.Random(2)
    texts = ["", "\n\n  x\n", "a  b   c", "\ud7ff é 漢字 \U0001f600", "<|endoftext|> x", "x" * 3000, " \t\r\n" * 50, "don't I'LL 12345"]
    texts += ["".join(rng.choices("ab Z9.\n\t'é漢<|>", k=rng.randrange(80))) for _ in range(300)]
    assert [[*packing.token_ids(t), 0] for t in texts] == [ids(t) for t in texts]


def test_first_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(100)
        want[i] = (at, 100 - room[at])
        room[at] -= lengths[i]
    assert [want[i] for i in range(300)] == list(zip(bins.tolist(), offsets.tolist(), strict=True))


def test_odd_rows(spark):
    rows = [(None, "null id"), (1, None), (2, ""), (3, "word " * 20000), (4, "same"), (5, "same")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, salt long, Start string")
    check(rows, packing.pack(docs).collect())
    assert len(packing.pack(docs.unionByName(docs)).collect()) == 2 * len(packing.pack(docs).collect())
    assert packing.pack(docs.where("false")).collect() == []


def test_large_ids_beside_null(spark):
    rows = [(None, "a"), (2**53 + 1, "b"), (2**53 + 3, "c d"), (-(2**63), "e")]
    check(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_repeated_rows_are_spread(spark):
    """A row that is repeated often is not one group."""
    docs = spark.range(5000).selectExpr("cast(7 as long) as doc_id", "'same words here' as text")
    out = packing.pack(docs, group_docs=500).collect()
    groups = {}
    for r in out:
        groups[r["sequence_id"] >> 32] = groups.get(r["sequence_id"] >> 32, 0) + 1
    assert len(out) == 5000 and len(groups) == 10 and max(groups.values()) < 1000
