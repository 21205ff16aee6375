"""Media columns: payloads stored as lossless WebP, read back as pixel arrays, and features of those.

Defined results: a null or empty text is stored as 64 zero bytes; payloads above 1 MiB become several images.
Texts are stored whole. Equal texts give equal bytes. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtrust.llm import webp
from tabtrust.llm.scratch import light, quoted, trimmed

UNIT = 64


def payload(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def features(pixels: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbours across and down."""
    a = np.frombuffer(pixels, np.uint8)
    share = np.bincount(a, minlength=256) / len(a)
    levels = np.arange(256)
    mean = float(share @ levels)
    dev = float(share @ (levels - mean) ** 2) ** 0.5
    used = share[share > 0]
    rows = a.reshape(-1, UNIT).astype(np.int16)
    across, down = np.abs(np.diff(rows, axis=1)).mean(), np.abs(np.diff(rows, axis=0)).mean() if len(rows) > 1 else 0.0
    return f"mean={mean:.4f};dev={dev:.4f};entropy={abs(float(-(used @ np.log2(used)))):.4f};across={across:.4f};down={down:.4f};rows={len(rows)}"


@F.pandas_udf(T.BinaryType())
def encode(column: pd.Series) -> pd.Series:
    """Binary payloads to WebP; they are padded first, as `payload` says."""
    return column.map(lambda x: webp.encode(payload(bytes(x or b""))))


@F.pandas_udf(T.BinaryType())
def decode(column: pd.Series) -> pd.Series:
    """WebP as `encode` wrote it to the padded payload; null stays null."""
    return column.map(lambda x: None if x is None else webp.samples(bytes(x)))


IMAGE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("argb", T.ArrayType(T.LongType()))])


@F.pandas_udf(T.ArrayType(IMAGE))
def pixels(column: pd.Series) -> pd.Series:
    """Any lossless WebP file to pixel arrays; null stays null, what is not such a file gives an empty list."""

    def read(data):
        if data is None:
            return None
        try:
            return [{"width": w, "height": h, "argb": p.tolist()} for w, h, p in webp.decode(bytes(data))]
        except (ValueError, IndexError, LookupError, struct.error):
            return []

    return column.map(read)


DIGEST = T.StructType(
    [T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]
)


@F.pandas_udf(DIGEST)
@trimmed
def _digest(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        data = (text or "").encode()
        stored = webp.encode(payload(data))
        back = webp.samples(stored)
        rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back)))
    return pd.DataFrame(rows, columns=DIGEST.names)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back, and describe both."""
    return light(docs).select(quoted(id_col).alias("doc_id"), _digest(quoted(text_col)).alias("x")).select("doc_id", "x.*")
