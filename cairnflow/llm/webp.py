"""Lossless WebP columns: an encoder for sample arrays and a decoder for any lossless stream.

The decoder reads prefix codes at every bit of a piece of the stream at once: each bit
place gets the length of the token that would start there, and the real tokens are found
by following these lengths from the first. Runs on numpy alone.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_bytes

ROW = 576
MOST_ROWS = 16383
PREDICT, CROSS, SUBTRACT, PALETTE = range(4)
LENGTH_SYMBOLS, DISTANCE_SYMBOLS = 24, 40
#: Stream bytes whose bit places are looked up at once.
_PIECE = 1 << 15
# Fixed values of the format: the order in which lengths of code lengths are sent.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: (columns to the left, rows up) of the short distance codes from 1 on.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_U = np.uint64


# ---- prefix codes


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths of the symbols that occur, none over ``limit``; rare ones are raised until they fit."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights, floor = counts[used].tolist(), 1
    while True:
        heap = [(max(w, floor), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        at = len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = at
            heapq.heappush(heap, (a[0] + b[0], at))
            at += 1
        depth = [0] * at
        for i in range(at - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= limit:
            lengths[used] = depth[: len(used)]
            return lengths
        floor = floor * 2 if floor > 1 else max(2, sum(weights) >> limit)


def _reversals(width: int) -> np.ndarray:
    """The numbers of ``width`` bits with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


_REVERSED = [_reversals(width) for width in range(16)]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of a canonical code, first bit lowest, as the stream has them."""
    codes = np.zeros(len(lengths), np.int64)
    code = 0
    for n, count in enumerate(np.bincount(lengths, minlength=16).tolist()):
        code <<= 1
        if n and count:
            codes[lengths == n] = _REVERSED[n][code : code + count]
            code += count
    return codes


class Code:
    """Lookup table of a prefix code: symbol << 8 | bits for each value of the next ``width`` bits."""

    def __init__(self, lengths: np.ndarray | None, single: int = 0):
        """``lengths`` None: the code of one symbol, ``single``."""
        used = np.flatnonzero(lengths) if lengths is not None else [single]
        self.single = int(used[0]) if len(used) == 1 else -1 if len(used) else 0
        if self.single >= 0:
            self.width, self.table = 0, np.array([self.single << 8])
            return
        sizes = lengths[used]
        self.width = int(sizes.max())
        order = np.argsort(sizes, kind="stable")
        table = np.repeat(used[order] << 8 | sizes[order], 1 << (self.width - sizes[order]))
        if len(table) != 1 << self.width:
            raise ValueError("a prefix code is not complete")
        self.table = table[_REVERSED[self.width]]


# ---- writing


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits

    def put_all(self, values: np.ndarray, bits: np.ndarray) -> bytes:
        """The stream so far and these values after it; the writer is then done."""
        start = self.n
        ends = start + np.cumsum(bits)
        total = int(ends[-1]) if len(ends) else start
        out = np.zeros(total // 64 + 2, _U)
        for low in range(0, len(values), 1 << 18):
            v, n = values[low : low + (1 << 18)].astype(_U), bits[low : low + (1 << 18)]
            at = ends[low : low + (1 << 18)] - n
            word, shift = at >> 6, (at & 63).astype(_U)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            out[word[first]] |= np.bitwise_or.reduceat(v << shift, first)
            over = np.flatnonzero((at & 63) + n > 64)
            out[word[over] + 1] |= v[over] >> (_U(64) - shift[over])
        head = self.value.to_bytes(start // 8 + 1, "little")
        body = bytearray(out.astype("<u8").tobytes()[: (total + 7) // 8])
        for i, b in enumerate(head[: len(body)]):
            body[i] |= b
        return bytes(body)


def _put_code(out: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 1 and (not used or used[0] < 256):
        s = used[0] if used else 0
        out.put(1, 1)
        out.put(0, 1)
        out.put(int(s > 1), 1)
        out.put(s, 8 if s > 1 else 1)
        return
    if len(used) == 2 and used[1] < 256:
        out.put(1, 1)
        out.put(1, 1)
        out.put(int(used[0] > 1), 1)
        out.put(used[0], 8 if used[0] > 1 else 1)
        out.put(used[1], 8)
        return
    tokens: list[tuple[int, int, int]] = []
    cuts = np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1]))
    for v, run in zip(lengths[cuts].tolist(), np.diff(np.append(cuts, len(lengths))).tolist(), strict=True):
        if v:
            tokens.append((v, 0, 0))
            run -= 1
        while run:
            if not v and run >= 3:
                n = min(run, 138)
                tokens.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
            elif v and run >= 3:
                n = min(run, 6)
                tokens.append((16, n - 3, 2))
            else:
                n = 1
                tokens.append((v, 0, 0))
            run -= n
    counts = np.bincount([t for t, *_ in tokens], minlength=19)
    own = code_lengths(counts, 7)
    codes, own = canonical(own).tolist(), own.tolist()
    single = own.count(0) == 18
    sent = max(4, max(i for i, s in enumerate(LENGTH_ORDER) if own[s]) + 1)
    out.put(0, 1)
    out.put(sent - 4, 4)
    for s in LENGTH_ORDER[:sent]:
        out.put(own[s], 3)
    out.put(0, 1)
    for t, extra, bits in tokens:
        if not single:
            out.put(codes[t], own[t])
        out.put(extra, bits)


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra value and extra bits of lengths and distance codes from 1 on."""
    v = np.asarray(value, np.int64) - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    second = v >> np.maximum(top - 1, 0) & 1
    bits = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + second)
    return symbol, v & ((1 << bits) - 1), bits


def _runs(pixels: np.ndarray, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths (4096 at most) of copies of the pixel before."""
    same = np.append(False, pixels[1:] == pixels[:-1])
    step = np.diff(same.astype(np.int8), prepend=0, append=0)
    starts, sizes = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - np.flatnonzero(step == 1)
    keep = sizes >= least
    starts, sizes = starts[keep], sizes[keep]
    parts = -(-sizes // 4096)
    own = np.repeat(np.arange(len(starts)), parts)
    k = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
    return starts[own] + 4096 * k, np.minimum(4096, sizes[own] - 4096 * k)


def _put_image(out: BitWriter, argb: np.ndarray, width: int, *, main: bool, cache_bits: int = 0, copies: list[tuple[int, int, int]] | None = None) -> bytes | None:
    """An image's data after its transforms; the bytes of the whole stream for the main image.

    ``copies`` are (start, length, distance code) in order; left out, runs of one pixel are
    copied from their left neighbour.
    """
    n = len(argb)
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    if copies is None:
        starts, sizes = _runs(argb)
        codes = np.full(len(starts), 2)
    else:
        starts, sizes, codes = np.array(copies, np.int64).reshape(-1, 3).T
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + sizes, -1)
    free = np.cumsum(inside[:-1]) == 0
    free[starts] = True
    at = np.flatnonzero(free)
    copy = np.zeros(n, bool)
    copy[starts] = True
    copy = copy[at]
    pixel = argb[at]
    rest = pixel & np.uint32(0xFFFF00FF)
    grey = (rest == rest[0]).all()  # one value each of red, blue and alpha
    red, blue, alpha = ((rest[:1] if grey else rest) >> s & 255 for s in (16, 0, 24))
    symbol = (pixel >> 8 & 255).astype(np.int64)
    literal = ~copy
    if cache_bits:
        held, hashes = {}, (argb.astype(np.uint32) * np.uint32(0x1E35A7BD) >> np.uint32(32 - cache_bits)).tolist()
        plain, is_free = argb.tolist(), set(at[~copy].tolist())
        hit = np.zeros(n, np.int64) - 1
        for i, (p, h) in enumerate(zip(plain, hashes, strict=True)):
            if i in is_free and held.get(h, 0) == p:
                hit[i] = h
            held[h] = p
        hit = hit[at]
        literal &= hit < 0
        symbol = np.where(hit >= 0, 256 + LENGTH_SYMBOLS + hit, symbol)
    size_symbol, size_extra, size_bits = _prefixed(sizes)
    far_symbol, far_extra, far_bits = _prefixed(codes)
    symbol[copy] = 256 + size_symbol
    streams = [(symbol, 256 + LENGTH_SYMBOLS + ((1 << cache_bits) if cache_bits else 0)), *((c[: int(literal.any())] if grey else c[literal], 256) for c in (red, blue, alpha)), (far_symbol, DISTANCE_SYMBOLS)]
    coded = []
    for values, alphabet in streams:
        lengths = code_lengths(np.bincount(values.astype(np.int64), minlength=alphabet))
        _put_code(out, lengths)
        none = np.count_nonzero(lengths) < 2
        coded.append((np.zeros_like(lengths), np.zeros_like(lengths)) if none else (canonical(lengths), lengths))
    value, bits = coded[0][0][symbol].astype(_U), coded[0][1][symbol]

    def add(where: np.ndarray, more: np.ndarray, n_bits: np.ndarray) -> None:
        value[where] |= more.astype(_U) << bits[where].astype(_U)
        bits[where] += n_bits

    for (codes_of, lengths), (values, _) in zip(coded[1:4], streams[1:4], strict=True):
        if lengths.any():
            add(literal, codes_of[values], lengths[values])
    if len(starts):
        add(copy, size_extra, size_bits)
        if coded[4][1].any():
            add(copy, coded[4][0][far_symbol], coded[4][1][far_symbol])
        add(copy, far_extra, far_bits)
    if main:
        return out.put_all(value, bits)
    for v, b in zip(value.tolist(), bits.tolist(), strict=True):
        out.put(v, b)
    return None


def _channels(argb: np.ndarray) -> list[np.ndarray]:
    return [argb >> s & 255 for s in (24, 16, 8, 0)]


def _joined(a, r, g, b) -> np.ndarray:
    return (np.asarray(a, np.uint32) & 255) << 24 | (np.asarray(r, np.uint32) & 255) << 16 | (np.asarray(g, np.uint32) & 255) << 8 | np.asarray(b, np.uint32) & 255


def _added(x: np.ndarray, y: np.ndarray, sign: int = 1) -> np.ndarray:
    return _joined(*(p.astype(np.int64) + sign * q.astype(np.int64) for p, q in zip(_channels(x), _channels(y), strict=True)))


def _average(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _joined(*((p + q) // 2 for p, q in zip(_channels(x), _channels(y), strict=True)))


def _predicted(mode: int, left, top, right_top, left_top) -> np.ndarray:
    """Prediction of a mode of the format from the neighbours."""
    if mode in (0, 14, 15):
        return np.full_like(left, 0xFF000000)
    if mode in (1, 2, 3, 4):
        return (left, top, right_top, left_top)[mode - 1]
    if mode == 5:
        return _average(_average(left, right_top), top)
    if mode in (6, 7):
        return _average(left, left_top if mode == 6 else top)
    if mode in (8, 9):
        return _average(left_top, top) if mode == 8 else _average(top, right_top)
    if mode == 10:
        return _average(_average(left, left_top), _average(top, right_top))
    lefts, tops, corners = ([c.astype(np.int64) for c in _channels(x)] for x in (left, top, left_top))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(tops, corners, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(lefts, corners, strict=True))
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return _joined(*(np.clip(x + t - c, 0, 255) for x, t, c in zip(lefts, tops, corners, strict=True)))
    middle = [(x + t) // 2 for x, t in zip(lefts, tops, strict=True)]
    return _joined(*(np.clip(m + np.fix((m - c) / 2).astype(np.int64), 0, 255) for m, c in zip(middle, corners, strict=True)))


def _signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) ^ 128) - 128


def _cross(argb: np.ndarray, element: np.ndarray, sign: int) -> np.ndarray:
    """Add (1) or take away (-1) what red and blue share with green, and blue with red."""
    a, r, g, b = _channels(argb)
    to_red, to_blue, red_to_blue = (_signed(element & 255), _signed(element >> 8 & 255), _signed(element >> 16 & 255))
    part = lambda m, c: m * _signed(c) >> 5
    new_red = r.astype(np.int64) + sign * part(to_red, g)
    base_red = new_red & 255 if sign > 0 else r
    new_blue = b.astype(np.int64) + sign * (part(to_blue, g) + part(red_to_blue, base_red))
    return _joined(a, new_red, g, new_blue)


def _neighbours(argb: np.ndarray) -> tuple[np.ndarray, ...]:
    """Left, top, top-right and top-left of the pixels from the second row and column on; the last column's top-right is its row's first."""
    line = argb.ravel()
    h, w = argb.shape
    at = np.arange(w, h * w).reshape(h - 1, w)[:, 1:]
    return line[at - 1], line[at - w], line[at - w + 1], line[at - w - 1]


def encode(argb: np.ndarray, *, transforms: list[tuple] = (), cache_bits: int = 0, copies: list[tuple[int, int, int]] | None = None) -> bytes:
    """A lossless WebP file of an array (rows x columns) of ARGB values.

    ``transforms`` in the order of writing: (PREDICT, bits, modes), (CROSS, bits, elements),
    (SUBTRACT,) and (PALETTE,).
    """
    h, w = argb.shape
    argb = argb.astype(np.uint32)
    out = BitWriter()
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(int(bool((argb >> np.uint32(24) != 255).any())), 1)
    out.put(0, 3)
    for kind, *more in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == SUBTRACT:
            a, r, g, b = (c.astype(np.int64) for c in _channels(argb))
            argb = _joined(a, r - g, g, b - g)
        elif kind == PALETTE:
            colors = np.unique(argb)
            out.put(len(colors) - 1, 8)
            _put_image(out, _added(colors, np.append(np.zeros(1, np.uint32), colors[:-1]), -1), len(colors), main=False)
            index = np.searchsorted(colors, argb)
            bits = 3 if len(colors) <= 2 else 2 if len(colors) <= 4 else 1 if len(colors) <= 16 else 0
            per = 1 << bits
            width = -(-argb.shape[1] // per)
            padded = np.zeros((h, width * per), np.int64)
            padded[:, : argb.shape[1]] = index
            green = (padded.reshape(h, width, per) << (np.arange(per) * (8 >> bits))).sum(axis=2)
            argb = _joined(255, 0, green, 0)
        else:
            size, plane = more
            out.put(size - 2, 3)
            rows, columns = np.arange(h) >> size, np.arange(argb.shape[1]) >> size
            if kind == PREDICT:
                _put_image(out, _joined(255, 0, plane, 0).ravel(), plane.shape[1], main=False)
                mode = plane[rows][:, columns]
                guess = np.zeros_like(argb)
                guess[0, 0] = 0xFF000000
                guess[0, 1:], guess[1:, 0] = argb[0, :-1], argb[:-1, 0]
                if h > 1 and argb.shape[1] > 1:
                    near = _neighbours(argb)
                    for m in np.unique(mode):
                        own = mode[1:, 1:] == m
                        guess[1:, 1:][own] = _predicted(int(m), *(x[own] for x in near))
                argb = _added(argb, guess, -1)
            else:
                _put_image(out, plane.astype(np.uint32).ravel(), plane.shape[1], main=False)
                argb = _cross(argb, plane[rows][:, columns].astype(np.uint32), -1)
    out.put(0, 1)
    data = b"\x2f" + _put_image(out, argb.ravel(), argb.shape[1], main=True, cache_bits=cache_bits, copies=copies)
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


# ---- reading


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.bytes = np.frombuffer(data + b"\0" * 16, np.uint8)

    def get(self, bits: int) -> int:
        low = self.at >> 3
        found = int.from_bytes(self.data[low : low + (bits + 14) // 8], "little") >> (self.at & 7) & ((1 << bits) - 1)
        self.at += bits
        if self.at > 8 * len(self.data) + 64:
            raise ValueError("the stream ends early")
        return found

    def symbol(self, code: Code) -> int:
        if code.width == 0:
            return code.single
        at = self.at
        found = int(code.table[self.get(code.width)])
        self.at = at + (found & 255)
        return found >> 8


def _read_code(reader: BitReader, alphabet: int) -> Code:
    if reader.get(1):
        n = reader.get(1) + 1
        first = reader.get(8 if reader.get(1) else 1)
        if n == 1:
            return Code(None, first)
        lengths = np.zeros(max(alphabet, 256), np.int64)
        lengths[[first, reader.get(8)]] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    for s in LENGTH_ORDER[: reader.get(4) + 4]:
        own[s] = reader.get(3)
    code, left = Code(own), alphabet
    if reader.get(1):
        left = reader.get(2 + 2 * reader.get(3)) + 2
    at, last, found = 0, 8, [0] * alphabet
    start = reader.at
    ahead, place = int.from_bytes(reader.data[start >> 3 : (start >> 3) + 3 * alphabet + 8], "little") >> (start & 7), 0
    table, mask = code.table.tolist(), (1 << code.width) - 1
    while at < alphabet and left:
        left -= 1
        entry = table[ahead >> place & mask]
        place += entry & 255
        s = entry >> 8
        if s < 16:
            found[at] = s
            at, last = at + 1, s or last
        else:
            bits, base = ((2, 3), (3, 3), (7, 11))[s - 16]
            n = base + (ahead >> place & ((1 << bits) - 1))
            place += bits
            if at + n > alphabet:
                raise ValueError("too many code lengths")
            if s == 16:
                found[at : at + n] = [last] * n
            at += n
    reader.at = start + place
    return Code(np.array(found, np.int64))


_SYMBOLS = np.arange(DISTANCE_SYMBOLS)
#: Extra bits and base of length and distance symbols.
_EXTRA = np.where(_SYMBOLS < 4, 0, (_SYMBOLS - 2) >> 1)
_FROM = np.where(_SYMBOLS < 4, _SYMBOLS, (2 + (_SYMBOLS & 1)) << _EXTRA) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    across, up = NEAR[code - 1]
    return max(1, across + up * width)


def _tokens(reader: BitReader, codes: list[Code], pixels: int) -> tuple[np.ndarray, ...] | None:
    """Symbol, red, blue, alpha, length and distance code of the tokens of one group of codes; None if they may need over 49 bits."""
    green, red, blue, alpha, far = codes
    if max(green.width + red.width + blue.width + alpha.width, green.width + 10 + far.width + 18 if far.width else 0) > 49:
        return None
    colors = [code for code in (red, blue, alpha) if code.width]
    first_copy, first_cached = 256 << 8, (256 + LENGTH_SYMBOLS) << 8
    parts, done, at = [], 0, reader.at
    # bits of a token without colours, 128 more for a copy: small numbers, as every bit place gets one
    bits_of = ((green.table & 255) + np.where((green.table >= first_copy) & (green.table < first_cached), 128, 0)).astype(np.uint8)

    def at_places(words: np.ndarray, where: np.ndarray) -> np.ndarray:
        """49 bits or more of the stream from each of these bit places on."""
        return words[where >> 3] >> (where & 7)

    def sized(words: np.ndarray) -> np.ndarray:
        """Bits of the token that starts at each bit place."""
        size = bits_of[((words & 0xFFFFFF)[:, None] >> np.arange(8) & ((1 << green.width) - 1)).ravel()]
        own = np.flatnonzero(size >= 128)
        if len(own):
            w = at_places(words, own)
            entry = green.table[w & ((1 << green.width) - 1)]
            used = (entry & 255) + _EXTRA[(entry >> 8) - 256]
            found = far.table[w >> used & ((1 << far.width) - 1)]
            copied = used + (found & 255) + _EXTRA[found >> 8]
        if colors:
            lit = np.arange(len(size))
            w = at_places(words, lit)
            entry = green.table[w & ((1 << green.width) - 1)]
            lit = np.flatnonzero(entry < first_copy)
            w, used = w[lit], size[lit].astype(np.int64)
            for code in colors:
                used = used + (code.table[w >> used & ((1 << code.width) - 1)] & 255)
            size[lit] = used
        if len(own):
            size[own] = copied
        return size

    while done < pixels:
        low = at >> 3
        if low > len(reader.data):
            raise ValueError("the stream ends early")
        piece = reader.bytes[low : low + _PIECE + 8].astype(np.int64)
        n = len(piece) - 8
        words = piece[:n].copy()
        for k in range(1, 7):
            words |= piece[k : k + n] << (8 * k)
        size = sized(words)
        limit, p = 8 * n, at - 8 * low
        if not size[p]:  # a token without bits: all others are the same
            if size.any():
                return None
            chain, after = np.full(pixels - done, p), p
        else:
            one = np.arange(limit + 1, dtype=np.int32)
            one[:limit] += size
            np.minimum(one[-256:], limit, out=one[-256:])
            two = one[one]
            jump, walk = memoryview(two[two]), []
            while p < limit:
                walk.append(p)
                p = jump[p]
                if p == walk[-1]:
                    return None
            walk = np.array(walk)
            chain = np.stack([walk, one[walk], two[walk], one[two[walk]]], axis=1).ravel()
            chain = chain[chain < limit]
            after = int(chain[-1]) + int(size[chain[-1]])
        w = at_places(words, chain)
        entry = green.table[w & ((1 << green.width) - 1)]
        symbol, used = entry >> 8, entry & 255
        values = []
        for code in (red, blue, alpha):
            if code.width:
                found = code.table[w >> used & ((1 << code.width) - 1)]
                values.append(found >> 8)
                used = used + (found & 255)
            else:
                values.append(np.full(len(w), code.single, np.uint8))
        length, distance = np.ones(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
        copy = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTH_SYMBOLS))
        if len(copy):
            w, used, kind = w[copy], entry[copy] & 255, symbol[copy] - 256
            length[copy] = _FROM[kind] + (w >> used & ((1 << _EXTRA[kind]) - 1))
            used = used + _EXTRA[kind]
            found = far.table[w >> used & ((1 << far.width) - 1)]
            used, kind = used + (found & 255), found >> 8
            distance[copy] = _FROM[kind] + (w >> used & ((1 << _EXTRA[kind]) - 1))
        ends = done + np.cumsum(length)
        stop = int(np.searchsorted(ends, pixels)) + 1
        if stop <= len(ends):
            after = int(chain[stop]) if stop < len(ends) else after
            parts.append([x[:stop] for x in (symbol, *values, length, distance)])
            at = 8 * low + after
            break
        parts.append([symbol, *values, length, distance])
        done, at = int(ends[-1]), 8 * low + after
    reader.at = at
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else None


def _read_image(reader: BitReader, width: int, height: int, *, main: bool) -> np.ndarray:
    """ARGB values of an image without its transforms."""
    cache_bits = reader.get(4) if reader.get(1) else 0
    groups, plane, shift = 1, None, 0
    if main and reader.get(1):
        shift = reader.get(3) + 2
        columns, rows = -(-width // (1 << shift)), -(-height // (1 << shift))
        plane = (_read_image(reader, columns, rows, main=False) >> np.uint32(8) & np.uint32(0xFFFF)).reshape(rows, columns)
        groups = int(plane.max()) + 1
    alphabets = [256 + LENGTH_SYMBOLS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCE_SYMBOLS]
    codes = [[_read_code(reader, a) for a in alphabets] for _ in range(groups)]
    pixels = width * height
    start = reader.at
    found = _tokens(reader, codes[0], pixels) if groups == 1 else None
    if found is None:
        reader.at = start
        return _read_slowly(reader, codes, plane, shift, width, pixels, cache_bits)
    symbol, red, blue, alpha, length, distance = found
    value = _joined(alpha, red, np.minimum(symbol, 255), blue)
    if not (symbol >= 256).any():
        return value
    out = np.zeros(pixels, np.uint32)
    at = np.cumsum(length) - length
    literal = symbol < 256
    out[at[literal]] = value[literal]
    if not cache_bits:
        for p, n, code in zip(*(x[~literal].tolist() for x in (at, length, distance)), strict=True):
            _copy(out, p, min(n, pixels - p), _distance(code, width))
        return out
    cache, mark = [0] * (1 << cache_bits), 32 - cache_bits
    for s, p, n, code in zip(symbol.tolist(), at.tolist(), length.tolist(), distance.tolist(), strict=True):
        if s >= 256 + LENGTH_SYMBOLS:
            out[p] = cache[s - 256 - LENGTH_SYMBOLS]
        elif s >= 256:
            n = min(n, pixels - p)
            _copy(out, p, n, _distance(code, width))
        for v in out[p : p + n].tolist():
            cache[(v * 0x1E35A7BD & 0xFFFFFFFF) >> mark] = v
    return out


def _copy(out: np.ndarray, at: int, n: int, distance: int) -> None:
    if distance > at:
        raise ValueError("a copy from before the image")
    if distance == 1:
        out[at : at + n] = out[at - 1]
    elif distance >= n:
        out[at : at + n] = out[at - distance : at - distance + n]
    else:
        out[at : at + n] = np.tile(out[at - distance : at], -(-n // distance))[:n]


def _read_slowly(reader, codes, plane, shift, width, pixels, cache_bits) -> np.ndarray:
    """Token by token, for images with several groups of codes and codes of unusual length."""
    out, at = np.zeros(pixels, np.uint32), 0
    cache = [0] * (1 << cache_bits) if cache_bits else []

    def keep(values) -> None:
        if cache_bits:
            for v in values:
                cache[(v * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = v

    while at < pixels:
        green, red, blue, alpha, far = codes[int(plane[at // width >> shift, at % width >> shift]) if plane is not None else 0]
        s = reader.symbol(green)
        if s < 256:
            r, b, a = reader.symbol(red), reader.symbol(blue), reader.symbol(alpha)
            out[at] = a << 24 | r << 16 | s << 8 | b
            keep([int(out[at])])
            at += 1
        elif s < 256 + LENGTH_SYMBOLS:
            n = min(int(_FROM[s - 256]) + reader.get(int(_EXTRA[s - 256])), pixels - at)
            kind = reader.symbol(far)
            _copy(out, at, n, _distance(int(_FROM[kind]) + reader.get(int(_EXTRA[kind])), width))
            keep(out[at : at + n].tolist())
            at += n
        else:
            out[at] = cache[s - 256 - LENGTH_SYMBOLS]
            keep([int(out[at])])
            at += 1
    return out


def _unpredict(argb: np.ndarray, plane: np.ndarray, size: int) -> np.ndarray:
    h, w = argb.shape
    out = argb.copy()
    out[0, :1] = _added(argb[0, :1], np.full(1, 0xFF000000, np.uint32))
    sums = lambda x: _joined(*(np.cumsum(c) for c in _channels(x)))
    out[0] = sums(out[0])
    modes = plane >> np.uint32(8) & np.uint32(15)
    for y in range(1, h):
        out[y, 0] = _added(argb[y, :1], out[y - 1, :1])[0]
        low = 1
        while low < w:
            mode = int(modes[y >> size, low >> size])
            high = min(w, ((low >> size) + 1) << size)
            part = slice(low, high)
            top, corner = out[y - 1, part], out[y - 1, low - 1 : high - 1]
            right = out[y - 1, low + 1 : high + 1] if high < w else np.append(out[y - 1, low + 1 : w], out[y, :1])
            if mode == 1:
                out[y, part] = sums(np.append(out[y, low - 1 : low], argb[y, part]))[1:]
            elif mode in (0, 2, 3, 4, 8, 9, 14, 15):
                out[y, part] = _added(argb[y, part], _predicted(mode, top, top, right, corner))
            else:
                for x in range(low, high):
                    k = slice(x - low, x - low + 1)
                    out[y, x] = _added(argb[y, x : x + 1], _predicted(mode, out[y, x - 1 : x], top[k], right[k], corner[k]))[0]
            low = high
    return out


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """ARGB values (rows x columns) of the lossless WebP file at the start of ``data``, and the file's bytes."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    end, at = 8 + int.from_bytes(data[4:8], "little"), 12
    while data[at : at + 4] != b"VP8L":
        at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1) // 2 * 2
        if at >= end:
            raise ValueError("no lossless image")
    stream = data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")]
    if stream[:1] != b"\x2f":
        raise ValueError("no lossless stream")
    reader = BitReader(stream[1:])
    width, height = reader.get(14) + 1, reader.get(14) + 1
    has_alpha = reader.get(1)
    if reader.get(3):
        raise ValueError("an unknown version")
    w, undo = width, []
    while reader.get(1):
        kind = reader.get(2)
        if kind in (PREDICT, CROSS):
            size = reader.get(3) + 2
            columns, rows = -(-w // (1 << size)), -(-height // (1 << size))
            undo.append((kind, w, size, _read_image(reader, columns, rows, main=False).reshape(rows, columns)))
        elif kind == PALETTE:
            n = reader.get(8) + 1
            deltas = _read_image(reader, n, 1, main=False)
            colors = _joined(*(np.cumsum(c) for c in _channels(deltas)))
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, w, bits, np.append(colors, np.zeros(256 - n, np.uint32))))
            w = -(-w // (1 << bits))
        else:
            undo.append((kind, w, 0, None))
    argb = _read_image(reader, w, height, main=True).reshape(height, w)
    for kind, wide, size, plane in reversed(undo):
        if kind == SUBTRACT:
            a, r, g, b = _channels(argb)
            argb = _joined(a, r + g, g, b + g)
        elif kind == PALETTE:
            per = 1 << size
            index = (argb >> np.uint32(8) & np.uint32(255))[:, :, None] >> (np.arange(per, dtype=np.uint32) * np.uint32(8 >> size)) & np.uint32((1 << (8 >> size)) - 1)
            argb = plane[index.reshape(height, -1)[:, :wide]]
        elif kind == CROSS:
            rows, columns = np.arange(height) >> size, np.arange(wide) >> size
            argb = _cross(argb, plane[rows][:, columns], 1)
        else:
            argb = _unpredict(argb, plane, size)
    return (argb if has_alpha else argb | np.uint32(0xFF000000)), end + (end & 1)


# ---- columns


#: Bytes of the grams by which copies are found, the share of places (one in so many, a power of two) that are looked at, and the least gain in bits a sample that a transform must bring.
COPY_GRAM, COPY_STEP = 24, 8
LEAST_GAIN = 0.05
#: Pixels of a copy at most, and how far back one may reach.
MOST_COPY, MOST_BACK = 4096, (1 << 20) - 121


def found_copies(values: np.ndarray, gram: int = COPY_GRAM) -> list[tuple[int, int, int]]:
    """(start, length, distance code) of what repeats earlier values: by the last earlier place of grams, or the value before.

    The grams looked at are those whose hash ends in zeros, so the same ones in all copies.
    """
    n = len(values)
    starts, sizes = _runs(values)
    distance = np.ones(len(starts), np.int64)
    if n > 2 * gram:
        part = np.frombuffer(values.tobytes() + b"\0" * 8, np.uint8)
        word = np.lib.stride_tricks.as_strided(part, (n, 8), (1, 1)).copy().view(_U).ravel()  # the 8 bytes from each place on
        mixed = sum((word[k : n - gram + 1 + k] * _U(2 * k + 0x9E3779B97F4A7C15) for k in range(0, gram, 8)), np.zeros(n - gram + 1, _U))
        mixed ^= mixed >> _U(29)
        place = np.flatnonzero((mixed * _U(0xBF58476D1CE4E5B9) >> _U(40)) & _U(COPY_STEP - 1) == 0)
        key = mixed[place]
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        here, there = place[order[same + 1]], place[order[same]]
        good = (here - there <= MOST_BACK) & (here - there > 1)
        for k in range(0, gram, 8):  # equal hashes are no proof
            good &= word[here + k] == word[there + k]
        here, back = here[good], (here - there)[good]
        order = np.argsort(here, kind="stable")
        here, back = here[order], back[order]
        joined = np.append(False, (back[1:] == back[:-1]) & (here[1:] - here[:-1] <= gram))[: len(here)]
        first = np.flatnonzero(~joined)
        last = np.append(first[1:], len(here))[: len(first)] - 1
        starts, sizes, distance = (np.concatenate(x) for x in ((starts, here[first]), (sizes, here[last] + gram - here[first]), (distance, back[first])))
        order = np.lexsort((-sizes, starts))
        starts, sizes, distance = starts[order], sizes[order], distance[order]
    out, end = [], 0
    for at, size, far in zip(starts.tolist(), sizes.tolist(), distance.tolist(), strict=True):
        low, high = max(at, end), at + size
        while high - low >= 4:
            out.append((low, min(MOST_COPY, high - low), 2 if far == 1 else far + len(NEAR)))
            low += out[-1][1]
            end = low
    return out


def _bits(values: np.ndarray) -> float:
    """Entropy of bytes."""
    p = np.bincount(values.ravel(), minlength=256) / max(1, values.size)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def chosen(grey: np.ndarray) -> list[tuple]:
    """Transforms for grey samples: a palette that packs several into a pixel, else the neighbour that predicts best if it gains."""
    if np.count_nonzero(np.bincount(grey.ravel(), minlength=256)) <= 16:
        return [(PALETTE,)]
    plain = _bits(grey)
    left, top = grey[:, 1:] - grey[:, :-1], grey[1:] - grey[:-1]
    gains = {1: plain - _bits(left), 2: plain - _bits(top) if len(grey) > 1 else 0.0}
    best = max(gains, key=gains.get)
    if gains[best] < LEAST_GAIN:
        return []
    return [(PREDICT, 9, np.full((-(-grey.shape[0] // 512), -(-grey.shape[1] // 512)), best))]


def store(samples: bytes) -> bytes:
    """Bytes, a multiple of ROW, as grey samples of WebP files, one after the other if one can't hold them.

    Each file takes the transforms that its samples gain from (:func:`chosen`) and copies what
    repeats. Colour transforms and a colour cache can't gain where only green varies.
    """
    out, most = [], ROW * MOST_ROWS
    for low in range(0, len(samples), most):
        grey = np.frombuffer(samples[low : low + most], np.uint8).reshape(-1, ROW)
        use = chosen(grey)
        copies = found_copies(grey.ravel()) if not use else None
        out.append(encode(np.uint32(0xFF000000) | grey.astype(np.uint32) << np.uint32(8), transforms=use, copies=copies))
    return b"".join(out)


def restore(media: bytes) -> np.ndarray:
    """The samples of :func:`store`, rows of ROW."""
    out, at = [], 0
    while at < len(media):
        argb, size = decode(media[at:] if at else media)
        out.append((argb >> np.uint32(8) & np.uint32(255)).astype(np.uint8))
        at += size
    return np.concatenate(out)


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (ROW * max(1, -(-len(data) // ROW)) - len(data))


def features(samples: np.ndarray) -> str:
    """Size, mean and spread of the samples, their entropy in bits, and the share of each eighth of their range."""
    bins = np.bincount(samples.ravel(), minlength=256)
    n, v = samples.size, np.arange(256)
    mean = float((bins * v).sum() / n)
    spread = float(np.sqrt(max(0.0, (bins * (v - mean) ** 2).sum() / n)))
    p = bins[bins > 0] / n
    shares = ",".join(f"{x / n:.4f}" for x in bins.reshape(8, 32).sum(axis=1).tolist())
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} spread={spread:.4f} bits={float(-(p * np.log2(p)).sum()):.4f} eighths={shares}"


def with_media(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as lossless WebP. Null is an empty text, which is a row of padding. Ids are taken as long integers; repeated rows are rows each, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [x.as_py() for x in part.column(1)]
                columns = [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([store(padded(t)) for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text_col)).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_facts(media: DataFrame) -> DataFrame:
    """What the stored bytes of (doc_id, n_bytes, media) hold: sizes, digests and features of the samples read back."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                stored = stored.as_py()
                samples = restore(stored)
                data = samples.tobytes()
                rows.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_facts(cut(with_media(table(spark, sf_dir, "documents")), "webp-media"))
