"""Lossless WebP (VP8L): a decoder of the whole format, and an encoder for byte payloads.

The decoder reads prefix codes (simple and coded lengths, meta prefix images), literals, back-references with the
format's distance map, the colour cache, and inverts predictor, cross-colour, subtract-green and palette transforms.
The encoder writes a payload as the green channel of an image 64 pixels wide, runs of equal bytes as
back-references, with prefix codes from a small family of fixed ones or, for large images, fitted to the bytes.
Decoding one symbol at a time is slow in Python, so images whose red, blue and alpha codes have one symbol are read
through a table that yields several literals for each 16-bit window.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections.abc import Sequence

import numpy as np

WIDTH = 64
#: The format's limit on a side is 16384; larger payloads become a sequence of images.
ROWS = 16384
IMAGE_BYTES = WIDTH * ROWS

#: Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES, DISTANCE_CODES = 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: The distance map: (x, y) of the 120 nearest pixels, given as a nibble pair (y, 8 - x) for each code.
DISTANCE_MAP = bytes.fromhex(
    "18 07 17 19 28 06 27 29 16 1a 26 2a 38 05 37 39 15 1b 36 3a 25 2b 48 04 47 49 14 1c 35 3b 46 4a 24 2c 58 45 4b 34 3c 03 57 59 13 1d 56 5a 23 2d 44 4c 55 5b 33 3d 68 02 67 69 12 1e 66 6a 22 2e 54 5c 43 4d 65 6b 32 3e 78 01 77 79 53 5d 11 1f 64 6c 42 4e 76 7a 21 2f 75 7b 31 3f 63 6d 52 5e 00 74 7c 41 4f 10 20 62 6e 30 73 7d 51 5f 40 72 7e 61 6f 50 71 7f 60 70"
)


# ---------------------------------------------------------------- prefix codes


def canonical(lengths: Sequence[int]) -> np.ndarray:
    """Codes of the given lengths, bits reversed as the stream has them (first bit lowest)."""
    lengths = np.asarray(lengths)
    codes, code = np.zeros(len(lengths), np.int64), 0
    for bits in range(1, 16):
        for s in np.flatnonzero(lengths == bits):
            codes[s] = int(format(code, f"0{bits}b")[::-1], 2)
            code += 1
        code <<= 1
    return codes


def limited_lengths(counts: Sequence[int], most: int) -> list[int]:
    """Huffman code lengths of at most `most` bits; counts are flattened until they fit."""
    used = [i for i, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) <= 1:
        for i in used:
            out[i] = 1
        return out
    floor = 1
    while True:
        heap = [(max(counts[i], floor), i, (i,)) for i in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in (*a[2], *b[2]):
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max(depth.values()) <= most:
            for i, d in depth.items():
                out[i] = d
            return out
        floor *= 2


@functools.lru_cache(256)
def _table(lengths: tuple[int, ...]) -> tuple[int, list[int], list[int]]:
    """(bits of the window, symbol of each window, length of each window). One used symbol takes no bits."""
    used = [i for i, n in enumerate(lengths) if n]
    if not used:
        return 0, [0], [0]
    if len(used) == 1:
        return 0, [used[0]], [0]
    if sum(2.0**-lengths[i] for i in used) != 1.0:
        raise ValueError("prefix code is not complete")
    bits = max(lengths)
    symbols, size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    codes = canonical(lengths)
    for s in used:
        at = slice(int(codes[s]), None, 1 << lengths[s])
        symbols[at], size[at] = s, lengths[s]
    return bits, symbols.tolist(), size.tolist()


@functools.lru_cache(16)
def _many(lengths: tuple[int, ...]) -> tuple[list[bytes], list[int]]:
    """For each 16-bit window: its leading literals and their bits, none if it begins with another symbol."""
    bits, symbols, size = _table(lengths)
    w = np.arange(1 << 16)
    symbols, size = np.array(symbols), np.array(size)
    mask = (1 << bits) - 1
    at, open_ = np.zeros(1 << 16, np.int64), np.ones(1 << 16, bool)
    got, number = np.zeros((1 << 16, 16), np.uint8), np.zeros(1 << 16, np.int64)
    while open_.any():
        i = np.flatnonzero(open_)
        key = (w[i] >> at[i]) & mask
        s, n = symbols[key], size[key]
        literal = (at[i] + n <= 16) & (s < 256)
        open_[i[~literal]] = False
        j = i[literal]
        got[j, number[j]] = s[literal]
        number[j] += 1
        at[j] += n[literal]
        open_[j[number[j] == 16]] = False
    raw = got.tobytes()
    return [raw[16 * i : 16 * i + k] for i, k in enumerate(number.tolist())], at.tolist()


# ---------------------------------------------------------------- decoder


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 16, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        p = self.at
        return (int.from_bytes(self.data[p >> 3 : (p >> 3) + 8], "little") >> (p & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("stream ends early")
        return v

    def symbol(self, table: tuple[int, list[int], list[int]]) -> int:
        bits, symbols, size = table
        if not bits:
            return symbols[0]
        w = self.peek(bits)
        self.at += size[w]
        if self.at > self.end:
            raise ValueError("stream ends early")
        return symbols[w]


def _read_lengths(b: _Bits, alphabet: int) -> tuple[int, ...]:
    out = [0] * alphabet
    if b.read(1):
        two = b.read(1)
        first = b.read(8 if b.read(1) else 1)
        for s in (first, b.read(8)) if two else (first,):
            out[s] = 1
        return tuple(out)
    code = [0] * 19
    for i in range(4 + b.read(4)):
        code[CODE_ORDER[i]] = b.read(3)
    table = _table(tuple(code))
    left = alphabet
    if b.read(1):
        left = 2 + b.read(2 + 2 * b.read(3))
    at, last = 0, 8
    while at < alphabet and left > 0:
        left -= 1
        s = b.symbol(table)
        if s < 16:
            out[at] = s
            at += 1
            last = s or last
        else:
            value, n = (last, 3 + b.read(2)) if s == 16 else (0, 3 + b.read(3)) if s == 17 else (0, 11 + b.read(7))
            if at + n > alphabet:
                raise ValueError("code lengths run over")
            out[at : at + n] = [value] * n
            at += n
    return tuple(out)


_HEADS: dict[tuple, list[tuple[int, int, list[tuple[int, ...]]]]] = {}


def _read_group(b: _Bits, sizes: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The lengths of five prefix codes. What these bits meant before they mean again, so they are parsed once."""
    start, key = b.at, (sizes, b.peek(48))
    known = _HEADS.setdefault(key, [])
    ahead = int.from_bytes(b.data[start >> 3 : (start >> 3) + 400], "little") >> (start & 7)
    for n, bits, codes in known:
        if ahead & ((1 << n) - 1) == bits and start + n <= b.end:
            b.at += n
            return codes
    codes = [_read_lengths(b, n) for n in sizes]
    n = b.at - start
    if n <= 3000 and len(_HEADS) < 64 and len(known) < 4:
        known.append((n, ahead & ((1 << n) - 1), codes))
    return codes


def _number(b: _Bits, symbol: int) -> int:
    """The length or distance that a prefix symbol and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + b.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    packed = DISTANCE_MAP[code - 1]
    return max(1, (packed >> 4) * width + 8 - (packed & 15))


def _image(b: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as ARGB numbers."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    meta, shift, groups = None, 0, 1
    if main and b.read(1):
        shift = 2 + b.read(3)
        mw = (width + (1 << shift) - 1) >> shift
        meta = ((_image(b, mw, (height + (1 << shift) - 1) >> shift, False) >> 8) & 0xFFFF).reshape(-1, mw)
        groups = int(meta.max()) + 1
    sizes = (256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = [_read_group(b, sizes) for _ in range(groups)]
    if main and groups == 1 and not cache_bits and all(sum(map(bool, codes[0][k])) <= 1 for k in (1, 2, 3)) and sum(map(bool, codes[0][0])) > 1:
        return _green(b, width, width * height, codes[0])
    tables = [[_table(c) for c in g] for g in codes]
    out, total, cache = [0] * (width * height), width * height, [0] * (1 << cache_bits)
    at, cached = 0, 0
    while at < total:
        g = tables[int(meta[(at // width) >> shift, (at % width) >> shift]) if meta is not None else 0]
        s = b.symbol(g[0])
        if s < 256:
            red = b.symbol(g[1])
            blue = b.symbol(g[2])
            out[at] = b.symbol(g[3]) << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 256 + LENGTH_CODES:
            n = _number(b, s - 256)
            back = _distance(_number(b, b.symbol(g[4])), width)
            if back > at or at + n > total:
                raise ValueError("back-reference out of the image")
            for _ in range(n):
                out[at] = out[at - back]
                at += 1
        else:
            while cached < at:  # pixels enter the cache when it is next read
                cache[(0x1E35A7BD * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out[at] = cache[s - 256 - LENGTH_CODES]
            at += 1
    return np.array(out, np.int64)


def _green(b: _Bits, width: int, total: int, codes: Sequence[tuple[int, ...]]) -> np.ndarray:
    """Pixels that differ in green only, of an image with nothing after it."""
    red, blue, alpha = (next((i for i, n in enumerate(codes[k]) if n), 0) for k in (1, 2, 3))
    single, distances = _table(codes[0]), _table(codes[4])
    texts, used = _many(codes[0])
    raw = np.frombuffer(b.data, np.uint8).astype(np.int64)
    words = (raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16).tolist()
    out, windows, safe = bytearray(), [], b.end - 16
    while len(out) < total:
        at = b.at
        while at < safe:  # the windows are only noted here; their literals are joined below
            w = words[at >> 3] >> (at & 7) & 0xFFFF
            if not (k := used[w]):
                break
            at += k
            windows.append(w)
        b.at = at
        out += b"".join(map(texts.__getitem__, windows))
        windows.clear()
        if len(out) >= total:
            break
        s = b.symbol(single)
        if s < 256:
            out.append(s)
        else:
            length = _number(b, s - 256)
            back = _distance(_number(b, b.symbol(distances)), width)
            if back > len(out) or len(out) + length > total:
                raise ValueError("back-reference out of the image")
            part = bytes(out[-back:])
            out += (part * (length // back + 1))[:length]
    return (alpha << 24 | red << 16 | blue) + (np.frombuffer(bytes(out[:total]), np.uint8).astype(np.int64) << 8)


def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.stack([pixels >> 24 & 255, pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255], -1)


def _joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.int64) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left, up, up_left, up_right):
    """The format's predictions from the neighbours, each a tuple of channels."""
    average = lambda p, q: tuple((x + y) >> 1 for x, y in zip(p, q, strict=True))
    clamp = lambda v: min(255, max(0, v))
    match mode:
        case 1: return left
        case 2: return up
        case 3: return up_right
        case 4: return up_left
        case 5: return average(average(left, up_right), up)
        case 6: return average(left, up_left)
        case 7: return average(left, up)
        case 8: return average(up_left, up)
        case 9: return average(up, up_right)
        case 10: return average(average(left, up_left), average(up, up_right))
        case 11:
            to_left = sum(abs(u - c) for u, c in zip(up, up_left, strict=True))
            to_up = sum(abs(v - c) for v, c in zip(left, up_left, strict=True))
            return left if to_left < to_up else up
        case 12: return tuple(clamp(v + u - c) for v, u, c in zip(left, up, up_left, strict=True))
        case 13:
            half = average(left, up)
            return tuple(clamp(h + int((h - c) / 2)) for h, c in zip(half, up_left, strict=True))
    return (255, 0, 0, 0)  # 0, and 14 and 15, which are not in use


def _undo_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, shift: int) -> np.ndarray:
    rest = [tuple(p) for p in _channels(pixels).tolist()]
    out: list[tuple] = []
    for i, p in enumerate(rest):
        y, x = divmod(i, width)
        if i == 0:
            guess = (255, 0, 0, 0)
        elif y == 0:
            guess = out[i - 1]
        elif x == 0:
            guess = out[i - width]
        else:  # beyond the right edge stands the row's own first pixel
            guess = _predict(int(modes[y >> shift, x >> shift]), out[i - 1], out[i - width], out[i - width - 1], out[i - width + 1])
        out.append(tuple((a + g) & 255 for a, g in zip(p, guess, strict=True)))
    return _joined(np.array(out).reshape(-1, 4))


def _undo_cross_colour(pixels: np.ndarray, width: int, height: int, blocks: np.ndarray, shift: int) -> np.ndarray:
    signed = lambda v: (v ^ 128) - 128
    c = _channels(pixels.reshape(height, width))
    by = _channels(blocks)[np.arange(height)[:, None] >> shift, np.arange(width)[None] >> shift]
    red_to_blue, green_to_blue, green_to_red = signed(by[..., 1]), signed(by[..., 2]), signed(by[..., 3])
    green = signed(c[..., 2])
    red = (c[..., 1] + ((green_to_red * green) >> 5)) & 255
    blue = (c[..., 3] + ((green_to_blue * green) >> 5) + ((red_to_blue * signed(red)) >> 5)) & 255
    return _joined(np.stack([c[..., 0], red, c[..., 2], blue], -1)).ravel()


def _undo_palette(pixels: np.ndarray, width: int, height: int, palette: np.ndarray, pack: int) -> np.ndarray:
    index = (pixels >> 8 & 255).reshape(height, -1)
    if pack:
        bits = 8 >> pack
        index = ((index[..., None] >> (np.arange(1 << pack) * bits)) & ((1 << bits) - 1)).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.int64)
    table[: len(palette)] = palette
    return table[index].ravel()


def decode_vp8l(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB numbers row by row) of a VP8L stream."""
    b = _Bits(data)
    if b.read(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("unknown version")
    undo, seen, wide = [], set(), width
    while b.read(1):
        kind = b.read(2)
        if kind in seen:
            raise ValueError("transform given twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = 2 + b.read(3)
            mw, mh = (wide + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
            undo.append((kind, wide, _image(b, mw, mh, False).reshape(mh, mw), shift))
        elif kind == PALETTE:
            n = b.read(8) + 1
            deltas = _channels(_image(b, n, 1, False))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, wide, _joined(np.cumsum(deltas, 0)), pack))
            wide = (wide + (1 << pack) - 1) >> pack
        else:
            undo.append((kind, wide, None, 0))
    pixels = _image(b, wide, height, True)
    for kind, w, extra, k in reversed(undo):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, w, (extra >> 8) & 15, k)
        elif kind == CROSS_COLOUR:
            pixels = _undo_cross_colour(pixels, w, height, extra, k)
        elif kind == PALETTE:
            pixels = _undo_palette(pixels, w, height, extra, k)
        else:
            c = _channels(pixels)
            pixels = _joined(np.stack([c[:, 0], c[:, 1] + c[:, 2], c[:, 2], c[:, 3] + c[:, 2]], -1))
    return width, height, pixels


def decode(data: bytes) -> list[tuple[int, int, np.ndarray]]:
    """All images of a sequence of RIFF files that hold one VP8L chunk each."""
    out, at = [], 0
    while at < len(data):
        head, size, form, chunk, n = struct.unpack_from("<4sI4s4sI", data, at)
        if (head, form, chunk) != (b"RIFF", b"WEBP", b"VP8L"):
            raise ValueError("not a lossless WebP file")
        out.append(decode_vp8l(data[at + 20 : at + 20 + n]))
        at += 8 + size
    return out


# ---------------------------------------------------------------- encoder


class _Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits


def _write_lengths(w: _Writer, lengths: Sequence[int]) -> None:
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(i < 256 for i in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for i in used:
            w.put(i, 8)
        return
    runs: list[tuple[int, int, int]] = []  # symbol, extra, extra bits
    at = 0
    while at < len(lengths):
        n = 1
        while at + n < len(lengths) and lengths[at + n] == lengths[at] and n < 138:
            n += 1
        if lengths[at] == 0 and n >= 11:
            runs.append((18, n - 11, 7))
        elif lengths[at] == 0 and n >= 3:
            n = min(n, 10)
            runs.append((17, n - 3, 3))
        else:
            n = 1
            runs.append((lengths[at], 0, 0))
        at += n
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    code = limited_lengths(counts, 7)
    number = max(4, 1 + max(i for i, s in enumerate(CODE_ORDER) if code[s]))
    w.put(0, 1)
    w.put(number - 4, 4)
    for s in CODE_ORDER[:number]:
        w.put(code[s], 3)
    w.put(0, 1)
    bits = canonical(code)
    single = sum(map(bool, code)) == 1
    for s, extra, n in runs:
        if not single:
            w.put(int(bits[s]), code[s])
        w.put(extra, n)


#: The alphabet of green: bytes and the lengths of back-references.
ALPHABET = 256 + LENGTH_CODES


@functools.lru_cache(1)
def _family() -> list[tuple[int, ...]]:
    """Code lengths for kinds of bytes, by rule: Latin text, text with many marks, text in two-byte letters, any bytes."""

    def lengths(weight) -> tuple[int, ...]:
        return tuple(limited_lengths([*[max(1, round(weight(i) * 1000)) for i in range(256)], *[8] * LENGTH_CODES], 13))

    frequent = {c: 2.0 ** (-i / 3.2) for i, c in enumerate(" etaonirshdlucmgpbfvwyqkxjz,.")}  # commonest letters of Latin scripts first
    small = lambda i: 60 * frequent.get(chr(i), 0.0)
    marks = lambda i: 2.0 if 32 < i < 127 and not chr(i).isalnum() else 0.0
    rest = lambda i: 0.3 if 48 <= i < 91 or i == 10 else 0.02 if i < 128 else 0.05
    return [
        lengths(lambda i: small(i) + rest(i)),
        lengths(lambda i: small(i) + rest(i) + (4 if i in (0xC3, 0xC2) else 0.3 if 0x9F <= i < 0xC0 else 0)),
        lengths(lambda i: small(i) + rest(i) + 2 * marks(i)),
        lengths(lambda i: 1.0),
    ]


@functools.lru_cache(8)
def _family_tables() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[tuple[int, int]]]:
    return np.array([f for f in _family()]), [(canonical(f), np.array(f)) for f in _family()], [_head(f) for f in _family()]


def _head(lengths: Sequence[int]) -> tuple[int, int]:
    """Bits that follow the image's size: no transform, no cache, no meta image, five prefix codes."""
    w = _Writer()
    w.put(0, 3)
    _write_lengths(w, lengths)
    for only in (0, 0, 255):
        one = [0] * 256
        one[only] = 1
        _write_lengths(w, one)
    # distance codes 1 and 2, the pixels above and to the left
    _write_lengths(w, [1, 1, *[0] * (DISTANCE_CODES - 2)])
    return w.value, w.n


FIT_BYTES = 1 << 18
RUN = 8


def _runs(raw: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of stretches where each byte equals the one before it, at least RUN long."""
    edges = np.flatnonzero(raw[1:] != raw[:-1]) + 1
    edges = np.concatenate(([0], edges, [len(raw)]))
    n = np.diff(edges) - 1
    long = np.flatnonzero(n >= RUN)
    return list(zip((edges[long] + 1).tolist(), n[long].tolist(), strict=True))


def _prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, number of them) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def encode_image(raw: np.ndarray) -> bytes:
    """A RIFF file with one image, 64 wide, whose green channel is raw (a positive multiple of 64, at most IMAGE_BYTES)."""
    symbols, extra, sizes = raw.astype(np.int64), None, None
    if runs := _runs(raw):
        keep = np.ones(len(raw), bool)
        tokens = []
        for start, n in runs:
            keep[start : start + n] = False
            for at in range(start, start + n, 4096):
                tokens.append((at, min(4096, start + n - at)))
        place = np.flatnonzero(keep)
        marks = [(at, *_prefix(n)) for at, n in tokens]
        order = np.argsort(np.r_[place, [m[0] for m in marks]], kind="stable")
        symbols = np.r_[symbols[place], [256 + m[1] for m in marks]][order]
        # after the length: its extra bits, then distance code 2 (one bit), the pixel to the left
        extra = np.r_[np.zeros(len(place), np.int64), [m[2] | 1 << m[3] for m in marks]][order]
        sizes = np.r_[np.zeros(len(place), np.int64), [m[3] + 1 for m in marks]][order]
    counts = np.bincount(symbols, minlength=ALPHABET)
    family, tables, heads = _family_tables()
    best = int(np.argmin(family @ counts))
    (codes, lengths), (head, head_bits) = tables[best], heads[best]
    if len(raw) >= FIT_BYTES:
        fitted = limited_lengths(counts.tolist(), 15)
        if sum(map(bool, fitted)) > 1:
            codes, lengths = canonical(fitted), np.array(fitted)
            head, head_bits = _head(fitted)
    code, size = codes[symbols], lengths[symbols]
    if extra is not None:
        code, size = code | extra << size, size + sizes
    start = struct.pack("<I", (WIDTH - 1) | (len(raw) // WIDTH - 1) << 14)
    first = 0x2F | int.from_bytes(start, "little") << 8 | head << 40
    body = _packed(code, size, first, 40 + head_bits)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(body) + (len(body) & 1), b"WEBP", b"VP8L", len(body)) + body + b"\0" * (len(body) & 1)


def _packed(code: np.ndarray, size: np.ndarray, first: int, first_bits: int) -> bytes:
    """The bits of first, then of all codes, lowest bit first."""
    whole, left = divmod(first_bits, 32)
    ends = np.cumsum(size) + left
    starts = ends - size
    word, shift = starts >> 5, (starts & 31).astype(np.uint64)
    value = code.astype(np.uint64) << shift
    total = int(ends[-1])
    out = np.zeros((total >> 5) + 2, np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.bitwise_or.reduceat(value, heads)
    out[word[heads]] = sums & np.uint64(0xFFFFFFFF)
    # at most the last code of a word reaches into the next one
    out[word[heads] + 1] |= sums >> np.uint64(32)
    data = (first & ((1 << (32 * whole)) - 1)).to_bytes(4 * whole, "little")
    out[0] |= np.uint64(first >> (32 * whole))
    return data + out.astype("<u4").tobytes()[: (total + 7) // 8]


def encode(payload: bytes) -> bytes:
    """A sequence of RIFF files; payload is a positive multiple of 64 bytes."""
    raw = np.frombuffer(payload, np.uint8)
    return b"".join(encode_image(raw[i : i + IMAGE_BYTES]) for i in range(0, len(raw), IMAGE_BYTES))


def samples(data: bytes) -> bytes:
    """The green samples of all images of a sequence, which is what `encode` stored."""
    return b"".join((pixels >> 8 & 255).astype(np.uint8).tobytes() for _, _, pixels in decode(data))
