"""Exact round trips of payloads, transforms of hand-made streams, and odd tables."""

import hashlib
import random
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabtrust.llm import media, webp


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=80), st.integers(1, 300)), max_size=8))
def test_round_trip(parts):
    data = media.payload(b"".join(p * n for p, n in parts))
    assert len(data) % 64 == 0 and data and webp.samples(webp.encode(data)) == data


def test_large():
    rng = random.Random(1)
    for n in (64, 1 << 18, (1 << 20) + 64, 3 << 20):
        data = rng.randbytes(n // 2) + b"\0" * (n - n // 2)
        assert webp.samples(webp.encode(data)) == data


def one(w, symbol):
    """A simple prefix code of one symbol, which takes no bits."""
    w.put(1, 1)
    w.put(0, 1)
    w.put(1, 1)
    w.put(symbol, 8)


def stream(width, height, transforms, pixel):
    """VP8L bytes: every pixel (green, red, blue, alpha) is the same before the transforms are undone."""
    w = webp._Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    for put in transforms:
        w.put(1, 1)
        put(w)
    w.put(0, 1)
    w.put(0, 2)  # no cache, no meta image
    for s in (*pixel, 0):
        one(w, s)
    body = w.value.to_bytes((w.n + 7) // 8 + 8, "little")
    body += b"\0" * (len(body) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(body), b"WEBP", b"VP8L", len(body)) + body


def image(w, green, red=0, blue=0, alpha=0):
    w.put(0, 1)
    for s in (green, red, blue, alpha, 0):
        one(w, s)


def channels(data):
    ((width, height, p),) = webp.decode(data)
    p = np.asarray(p, np.int64).reshape(height, width)
    return p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24 & 255


def test_subtract_green():
    green, red, blue, alpha = channels(stream(5, 3, [lambda w: w.put(2, 2)], (7, 250, 3, 255)))
    assert set(green.ravel()) == {7} and set(red.ravel()) == {(250 + 7) % 256} and set(blue.ravel()) == {10} and set(alpha.ravel()) == {255}


def test_predictor_left():
    def put(w):
        w.put(0, 2)
        w.put(0, 3)
        image(w, 1)

    green, red, _, alpha = channels(stream(9, 6, [put], (1, 2, 0, 0)))
    y, x = np.mgrid[:6, :9]
    assert (green == x + y + 1).all() and (red == 2 * (x + y + 1)).all() and (alpha == 255).all()


def test_cross_colour():
    def put(w):
        w.put(1, 2)
        w.put(0, 3)
        image(w, 0, 0, 32)  # green to red: 32 / 32

    green, red, blue, _ = channels(stream(4, 4, [put], (9, 5, 1, 255)))
    assert set(green.ravel()) == {9} and set(red.ravel()) == {14} and set(blue.ravel()) == {1}


def test_palette():
    def put(w):
        w.put(3, 2)
        w.put(3, 8)  # four colours, deltas of 10
        image(w, 10, 1, 2, 50)

    green, red, _, alpha = channels(stream(8, 2, [put], (0b11100100, 0, 0, 0)))
    assert green.tolist() == [[10, 20, 30, 40] * 2] * 2 and red.tolist() == [[1, 2, 3, 4] * 2] * 2 and alpha[0, 3] == 200


def test_digest(spark):
    rows = [(None, "null id"), (1, None), (2, ""), (3, "é" * 50000), (4, "same"), (5, "same"), (6, "x" * 64)]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, x long, Feature string")
    out = {r["doc_id"]: r for r in media.digest(docs).collect()}
    for d, text in rows:
        data, r = media.payload((text or "").encode()), out[d]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((text or "").encode()), len(data))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-64:])
    assert out[4][1:] == out[5][1:] and media.digest(docs.where("false")).collect() == []
    back = docs.select("doc_id", media.decode(media.encode(docs.text.cast("binary"))).alias("b")).collect()
    assert {r["doc_id"]: bytes(r["b"]) for r in back} == {d: media.payload((t or "").encode()) for d, t in rows}
