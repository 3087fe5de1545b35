"""Exact substring removal: maximal repeats from the interval tree of enhanced suffix arrays.

A repeat of ``length`` bytes holds ``length - GRAM + 1`` byte grams, and the least hash
among them marks the same gram in each of its occurrences. So occurrences of one repeat
meet in the group of that gram, at the same place relative to it. Each group is a small
suffix array: the bytes around every marked gram that occurs more than once. Groups are
independent, which makes the work a few shuffles whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_bytes

LENGTH = 200
GRAM = 100
#: Occurrences of a context in a batch that travel with it; those of more frequent ones meet it in a join.
INLINE = 4
#: Different contexts of one gram that a task holds; the windows of larger groups are counted by a shuffle.
GROUP_CAP = 20000
#: Occurrences of a context that a task holds; more of them wait in rows of their own and meet the context's runs in a join.
HELD = 1 << 16
#: Bytes of contexts that are sorted at once.
BLOCK_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.frombuffer(hashlib.shake_128(b"cairnflow suffix grams").digest(2048), "<u8") | np.uint64(1)
_STEP = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out, done = np.ones(n, np.uint64), 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


_UP, _DOWN = _powers(_BASE, _STEP), _powers(_INVERSE, _STEP)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` bytes of at most ``_STEP`` bytes."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _UP[:n], out=sums[1:])
    return _mixed((sums[width:] - sums[:-width]) * _DOWN[: n - width + 1])


def _slide(x: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """``best`` over each ``width`` neighbours."""
    n = len(x)
    blocks = np.append(x, np.full(-n % width, fill, np.uint64)).reshape(-1, width)
    before = best.accumulate(blocks, axis=1).ravel()
    after = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[: n - width + 1], before[width - 1 : n])


def marked_grams(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the grams whose hash is least in some run of ``length`` bytes."""
    at, hashes, width = [], [], length - gram + 1
    for low in range(0, max(1, len(data) - length + 1), _STEP - length + 1):
        h = window_hashes(data[low : low + _STEP], gram)
        if len(h) < width:
            continue
        least = _slide(h, width, np.minimum, (1 << 64) - 1)
        rim = np.zeros(width - 1, np.uint64)
        own = np.flatnonzero(_slide(np.concatenate([rim, least, rim]), width, np.maximum, 0) == h)
        at.append(own + low)
        hashes.append(h[own])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, first = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(hashes)[first].view(np.int64)


def _key_columns(data: Column) -> list[Column]:
    """A text's identity: 64 and 30 bits of two hashes."""
    return [F.xxhash64(data).alias("k1"), F.xxhash64(F.lit(1), data).bitwiseAND(F.lit((1 << 30) - 1)).alias("k2")]


def _table(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _first_of_each(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return np.unique(np.rec.fromarrays([k1, k2]), return_index=True)[1]


def _mark(length: int, gram: int):
    """(k1, k2, data) to (h, k1, place); place: k2, the gram's start and a flag.

    Flag 0: once in its batch, 1: the first of several, 2: the others, which need no
    further proof that the gram repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in range(2))
            pick = _first_of_each(k1, k2)
            texts = [batch.column(2)[int(i)].as_py() for i in pick]
            ends = np.cumsum([len(t) for t in texts])
            at, h = marked_grams(np.frombuffer(b"".join(texts), np.uint8), length, gram)
            own = np.searchsorted(ends, at, side="right")
            inside = at + gram <= ends[own] if len(at) else np.zeros(0, bool)
            at, h, own = at[inside], h[inside], own[inside]
            starts = np.append(0, ends[:-1])
            _, back, n = np.unique(h, return_inverse=True, return_counts=True)
            flag = np.where(n[back] > 1, 2, 0)
            flag[np.unique(back, return_index=True)[1]] //= 2
            place = (k2[pick][own] << 33) | ((at - starts[own]) << 2) | flag
            yield _table(["h", "k1", "place"], h, k1[pick][own], place)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the rows of grams that occur at two places or more; rows come in the order of h."""

    def judge(h, k1, place):
        cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        if not len(cuts):
            return h, k1, place
        spot = _mixed(k1.view(np.uint64) ^ _mixed((place >> 2).view(np.uint64)))
        good = (np.minimum.reduceat(spot, cuts) != np.maximum.reduceat(spot, cuts)) | (np.maximum.reduceat(place & 3, cuts) > 0)
        keep = np.repeat(good, np.diff(np.append(cuts, len(h))))
        return h[keep], k1[keep], place[keep]

    def out(h, k1, place):
        return _table(["h", "k1", "k2", "pos"], h, k1, place >> 33, place >> 2 & (1 << 31) - 1)

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(3)]
        sure = rows[2] & 3 == 2
        yield out(*(x[sure] for x in rows))
        rows = [np.concatenate([a, b[~sure]]) for a, b in zip(held, rows, strict=True)]
        last = len(rows[0]) and int(np.searchsorted(rows[0], rows[0][-1]))
        yield out(*judge(*(x[:last] for x in rows)))
        held = [x[last:] for x in rows]
    yield out(*judge(*held))


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list]]:
    """Rows of each (k1, k2), which come together, as tuples of the other columns."""
    key, rows = None, []
    for batch in batches:
        k1, k2, *rest = (c.to_pylist() for c in batch.columns)
        for a, b, *row in zip(k1, k2, *rest, strict=True):
            if (a, b) != key:
                if rows:
                    yield key, rows
                key, rows = (a, b), []
            rows.append(row)
    if rows:
        yield key, rows


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text beside its repeated grams, texts without any left out; a text's row comes before its grams."""
    names, held, size = ["k1", "k2", "z", "pos", "h"], [], 0
    for (k1, k2), rows in _by_key(batches):
        z = next(r[2] for r in rows)
        grams = sorted({(r[0], r[1]) for r in rows if r[0] >= 0})
        if grams and z is not None:
            held.append((k1, k2, z, [g[0] for g in grams], [g[1] for g in grams]))
            size += len(z) + 16 * len(grams)
        if size > 8 << 20:
            yield _table(names, *map(pa.array, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield _table(names, *map(pa.array, zip(*held, strict=True)))


def _contexts(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple]:
    """(h, id, lead, bytes, k1, k2, pos) around each gram of (k1, k2, z, pos, h)."""
    unzip, reach = zstandard.ZstdDecompressor(), length - gram
    for k1, k2, z, places, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        data = unzip.decompress(z)
        for p, h in zip(places, hashes, strict=True):
            low = max(0, p - reach)
            piece = data[low : p + length]
            lead = p - low
            yield h, xxhash.xxh3_64_intdigest(piece, lead) - (1 << 63), lead, piece, k1, k2, p


def _emit_contexts(length: int, gram: int, inline: int):
    """Rows (h, id, lead, n, piece, k1s, places): each different context of a batch with its occurrences.

    Contexts with more than ``inline`` of them come without; those follow in rows without a piece.
    """
    names = ["h", "id", "lead", "n", "piece", "k1s", "places"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, tuple] = {}
            for h, i, lead, piece, k1, k2, p in _contexts(batch, length, gram):
                if len(piece) < length:
                    continue
                if (found := seen.get((h, i))) is None:
                    found = seen[h, i] = (lead, piece, [], [])
                found[2].append(k1)
                found[3].append(k2 << 32 | p)
            rows = []
            for (h, i), (lead, piece, k1s, places) in seen.items():
                few = len(k1s) <= inline
                rows.append((h, i, lead, len(k1s), piece, k1s if few else [], places if few else []))
                if not few:
                    rows.append((h, i, lead, len(k1s), None, k1s, places))
            del seen
            for low in range(0, len(rows), 20000):
                yield _table(names, *(pa.array(c, t) for c, t in zip(zip(*rows[low : low + 20000], strict=True), kinds, strict=True)))

    return run


def maximal_repeats(pieces: list[bytes], leads: list[int], groups: list[int], length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats (bytes, piece of each occurrence, its start there) within each group.

    Pieces of one group hold the same gram at their lead, and a repeat holds the gram, so
    its occurrences start equally far from it. Suffixes that share ``length`` bytes with
    none, or whose sharers all have the same byte before, start no maximal repeat. The
    others are sorted, and a scan with a stack over their common prefixes walks the
    interval tree from the leaves up. An interval whose suffixes follow different bytes,
    or the rim of a piece, is a maximal repeat, with all its suffixes as occurrences.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    offsets = np.cumsum(sizes) - sizes
    lead = np.array(leads)
    n = np.minimum(lead, sizes - length) + 1
    own = np.repeat(np.arange(len(pieces)), n)
    rel = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    at = offsets[own] + rel
    hashes = np.concatenate([window_hashes(data[low : low + _STEP], length) for low in range(0, max(1, len(data) - length + 1), _STEP - length + 1)])[at]
    salt = _mixed(np.array(groups, np.int64).view(np.uint64))
    key = _mixed(hashes ^ _mixed(salt[own] + (rel - lead[own]).view(np.uint64)))
    order = np.argsort(key)
    cuts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    before = np.where(rel == 0, -1, data[at - 1].astype(np.int16))
    low, high = (f.reduceat(before[order], cuts) for f in (np.minimum, np.maximum))
    runs = np.diff(np.append(cuts, len(order)))
    live = np.repeat((runs > 1) & ((low != high) | (low < 0)), runs)
    order, group = order[live], np.repeat(np.arange(len(cuts)), runs)[live]
    if not len(order):
        return
    raw, ends = data.tobytes(), (offsets + sizes)[own[order]]
    starts = at[order]
    suffixes = [g.to_bytes(4, "big") + raw[a:b] for g, a, b in zip(group.tolist(), starts.tolist(), ends.tolist(), strict=True)]
    rank = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    del suffixes
    order, group, starts, ends = order[rank], group[rank], starts[rank], ends[rank]
    common = np.zeros(len(order) + 1, np.int64)
    room = np.minimum(ends[1:] - starts[1:], ends[:-1] - starts[:-1])
    widest = np.arange(int((ends - starts).max()))
    padded = np.append(data, np.zeros(len(widest), np.uint8))
    for low in range(0, len(room), 4096):
        part = slice(low, low + 4096)
        x, y = (padded[s[part][:, None] + widest] for s in (starts[1:], starts[:-1]))
        differ = (x != y) | (widest >= room[part][:, None])
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), len(widest))
        common[low + 1 : low + 1 + len(first)] = np.where(group[1:][part] == group[:-1][part], first, 0)
    left = before[order].tolist()
    piece, start = own[order], rel[order]
    several = -2
    stack: list[list[int]] = []  # depth, first suffix, byte before all of them or ``several``
    for i, depth in enumerate(common.tolist()):
        begin, mark = i - 1, (left[i - 1] if i and left[i - 1] >= 0 else several)
        while stack and stack[-1][0] > depth:
            d, begin, m = stack.pop()
            mark = m if m == mark else several
            if mark == several:
                yield d, piece[begin:i], start[begin:i]
        if stack and stack[-1][0] == depth:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == mark else several
        elif depth >= length:
            stack.append([depth, begin, mark])


def _cover(pieces: list[bytes], leads: list[int], counts: list[int], groups: list[int], length: int) -> list[tuple[int, list[int], list[int]]]:
    """(piece, starts, ends) of covered runs, from the gram, for pieces that have any."""
    sizes = np.array([len(p) for p in pieces])
    offsets = np.cumsum(sizes + 1) - sizes - 1
    change = np.zeros(int(offsets[-1] + sizes[-1]) + 2, np.int32)
    whole = np.flatnonzero(np.array(counts) > 1)  # equal pieces: an interval of their own
    np.add.at(change, offsets[whole], 1)
    np.add.at(change, offsets[whole] + sizes[whole], -1)
    for size, piece, start in maximal_repeats(pieces, leads, groups, length):
        low = offsets[piece] + start
        np.add.at(change, low, 1)
        np.add.at(change, low + size, -1)
    step = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0)
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    own = np.searchsorted(offsets, first, side="right") - 1
    base = offsets[own] + np.array(leads)[own]
    out: dict[int, tuple] = {}
    for i, a, b in zip(own.tolist(), (first - base).tolist(), (last - base).tolist(), strict=True):
        row = out.setdefault(i, (i, [], []))
        row[1].append(a)
        row[2].append(b)
    return list(out.values())


def _sort_groups(length: int, cap: int, held: int):
    """(h, id, lead, n, piece, k1s, places) in the order of (h, id), to covered runs.

    Pieces of groups over the cap pass as they are, and so do occurrences over ``held`` of
    one piece, in rows with neither runs nor a piece.
    """
    names = ["h", "id", "starts", "ends", "k1s", "places", "lead", "n", "piece"]
    many = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), many, many, pa.int64(), pa.int64(), pa.binary()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return _table(names, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[list] = []
        group: list[list] = []
        waiting: list[tuple] = []
        size, over = 0, False

        def solve() -> pa.RecordBatch:
            rows = []
            if ready:
                h, ids, leads, counts, pieces, k1s, places = zip(*ready, strict=True)
                rows = [(h[i], ids[i], a, b, k1s[i], places[i], None, None, None) for i, a, b in _cover(pieces, leads, counts, h, length)]
            return pack(rows)

        def hot(rows: list[list]) -> pa.RecordBatch:
            return pack([(h, i, None, None, k1s, places, lead, n, piece) for h, i, lead, n, piece, k1s, places in rows])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = list(row)
                if group and group[-1][:2] == row[:2]:
                    group[-1][3] += row[3]
                    if len(group[-1][5]) < held:
                        group[-1][5] += row[5]
                        group[-1][6] += row[6]
                    elif row[5]:
                        waiting.append((*row[:2], None, None, row[5], row[6], None, None, None))
                        if len(waiting) >= 2000:
                            yield pack(waiting)
                            waiting = []
                    continue
                if group and group[0][0] != row[0]:
                    if over:
                        yield hot(group)
                    elif len(group) > 1 or group[0][3] > 1:
                        ready += group
                        size += sum(len(r[4]) for r in group)
                        if size > BLOCK_BYTES:
                            yield solve()
                            ready, size = [], 0
                    group, over = [], False
                group.append(row)
                if len(group) > cap:
                    over = True
                    yield hot(group[:-1])
                    group = group[-1:]
        if over:
            yield hot(group)
        elif group:
            ready += group
        yield pack(waiting)
        yield solve()

    return run


def _windows(length: int):
    """(h, id, lead, n, piece) to its windows (h, id, n, from, hash): from the gram, of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, i, lead, n, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = min(lead, len(piece) - length) + 1
                digests = [xxhash.xxh3_128_digest(piece[s : s + length]) for s in range(m)]
                yield _table(["h", "id", "n", "at", "w"], [h] * m, [i] * m, [n] * m, list(range(-lead, m - lead)), digests)

    return run


def _hot_cover(hot: DataFrame, length: int) -> DataFrame:
    """Covered runs of pieces in groups over the cap: windows that occur again, counted by a shuffle."""
    windows = hot.select("h", "id", "lead", "n", "piece").mapInArrow(_windows(length), "h long, id long, n long, at long, w binary")
    again = windows.groupBy("h", "at", "w").agg(F.sum("n").alias("total")).filter("total > 1").drop("total")
    return windows.join(again, ["h", "at", "w"]).groupBy("h", "id").agg(F.sort_array(F.collect_list(F.col("at").cast("int"))).alias("starts")).withColumn("ends", F.transform("starts", lambda s: s + F.lit(length)))


def _runs(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their covered runs to removed runs and a digest of what is left."""
    unzip = zstandard.ZstdDecompressor()
    names = ["k1", "k2", "starts", "ends", "n_removed", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.string()]
    held: list[tuple] = []
    pack = lambda: _table(names, *(pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)))
    for (k1, k2), rows in _by_key(batches):
        runs = _runs([p + a for p, s, _, _ in rows if s for a in s], [p + b for p, _, e, _ in rows if e for b in e])
        z = next((z for *_, z in rows if z is not None), None)
        if not runs or z is None:
            continue
        data, kept, end = unzip.decompress(z), hashlib.sha256(), 0
        for a, b in runs:
            kept.update(data[end:a])
            end = b
        kept.update(data[end:])
        held.append((k1, k2, [a for a, _ in runs], [b for _, b in runs], sum(b - a for a, b in runs), kept.hexdigest()))
        if len(held) >= 2000:
            yield pack()
            held = []
    if held:
        yield pack()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One compressed row for each different text of a batch."""
    zipper = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        k1, k2 = (batch.column(i).to_numpy() for i in range(2))
        pick = _first_of_each(k1, k2)
        yield _table(["k1", "k2", "z"], k1[pick], k2[pick], pa.array([zipper.compress(batch.column(2)[int(i)].as_py()) for i in pick], pa.binary()))


def repeated_runs(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, cap: int = GROUP_CAP, inline: int = INLINE, held: int = HELD) -> DataFrame:
    """(k1, k2, starts, ends, n_removed, kept_sha256) of each text with bytes in a repeat of ``length`` bytes.

    Positions are UTF-8 bytes, runs are maximal. Copies of a text are one here: that a
    text itself occurs twice is seen by :func:`without_repeats`.
    """
    data = text_bytes(text_col)
    long = docs.select(data).filter(F.octet_length("data") >= length).select(*_key_columns(F.col("data")), "data")
    marks = long.mapInArrow(_mark(length, gram), "h long, k1 long, place long")
    direct = F.col("place").bitwiseAND(F.lit(3)) == 2
    dealt = marks.repartition(F.when(direct, F.xxhash64("k1", "place")).otherwise(F.col("h"))).sortWithinPartitions("h")
    grams = dealt.mapInArrow(_repeated, "h long, k1 long, k2 long, pos long")
    texts = long.mapInArrow(_texts, "k1 long, k2 long, z binary")
    both = texts.select("k1", "k2", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("h"), "z").unionByName(grams.select("k1", "k2", "pos", "h", F.lit(None).cast("binary").alias("z")))
    met = both.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "pos").mapInArrow(_meet, "k1 long, k2 long, z binary, pos array<long>, h array<long>")
    met = cut(met, "suffix-texts")
    many = "array<long>"
    pieces = met.mapInArrow(_emit_contexts(length, gram, inline), f"h long, id long, lead long, n long, piece binary, k1s {many}, places {many}")
    dealt = pieces.filter("piece IS NOT NULL").repartition("h").sortWithinPartitions("h", "id")
    found = dealt.mapInArrow(_sort_groups(length, cap, held), f"h long, id long, starts array<int>, ends array<int>, k1s {many}, places {many}, lead long, n long, piece binary")
    found = cut(found, "suffix-runs")
    covered = found.filter("piece IS NULL AND starts IS NOT NULL").select("h", "id", "starts", "ends", "k1s", "places")
    hot = found.filter("piece IS NOT NULL")
    if hot.take(1):
        covered = covered.unionByName(_hot_cover(hot, length).join(hot.select("h", "id", "k1s", "places"), ["h", "id"]))
    waiting = found.filter("piece IS NULL AND starts IS NULL").select("h", "id", "k1s", "places")
    often = pieces.filter("piece IS NULL").select("h", "id", "k1s", "places").unionByName(waiting).join(covered.select("h", "id", "starts", "ends"), ["h", "id"])
    each = covered.unionByName(often).select(F.explode(F.arrays_zip("k1s", "places")).alias("x"), "starts", "ends")
    place = F.col("x.places")
    runs = each.select(F.col("x.k1s").alias("k1"), F.shiftright(place, 32).alias("k2"), place.bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), "starts", "ends", F.lit(None).cast("binary").alias("z"))
    empty = F.lit(None).cast("array<int>")
    own = met.select("k1", "k2", F.lit(-1).cast("long").alias("pos"), empty.alias("starts"), empty.alias("ends"), "z")
    return own.unionByName(runs).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "pos").mapInArrow(_remove, "k1 long, k2 long, starts array<int>, ends array<int>, n_removed long, kept_sha256 string")


def repeat_facts(docs: DataFrame, **options) -> DataFrame:
    """:func:`repeated_runs` with ``copied`` for texts that occur twice or more."""
    data = text_bytes(options.get("text_col", "text"))
    long = docs.select(data).filter(F.octet_length("data") >= options.get("length", LENGTH))
    copies = long.select(*_key_columns(F.col("data"))).groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2", F.lit(True).alias("copied"))
    return repeated_runs(docs, **options).join(copies, ["k1", "k2"], "full")


def without_repeats(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, cap: int = GROUP_CAP, inline: int = INLINE, held: int = HELD) -> DataFrame:
    """``docs`` with n_bytes, starts, ends, n_removed, n_spans, kept_sha256 in place of the text.

    A byte is removed if a run of ``length`` bytes over it also starts anywhere else, in
    the same text or another. Null counts as an empty text; texts under ``length`` bytes
    stay whole; a repeated row or text of that size goes whole. Columns other than the
    text pass through; of those added, they give way.
    """
    added = ["n_bytes", "starts", "ends", "n_removed", "n_spans", "kept_sha256"]
    rest = [c for c in docs.columns if c not in (text_col, *added)]
    names = [f"_{i}" for i in range(len(rest))]
    data = text_bytes(text_col)
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)), data)
    keyed = own.select(*names, *_key_columns(F.col("data")), F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("own_sha256"))
    facts = repeat_facts(docs.select(text_col), text_col=text_col, length=length, gram=gram, cap=cap, inline=inline, held=held)
    joined = keyed.join(facts, ["k1", "k2"], "left")
    whole = F.coalesce("copied", F.lit(False))
    none = F.array().cast("array<int>")
    return joined.select(
        *names,
        "n_bytes",
        F.when(whole, F.array(F.lit(0))).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(whole, F.array(F.col("n_bytes").cast("int"))).otherwise(F.coalesce("ends", none)).alias("ends"),
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce(F.size("starts"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"),
    ).toDF(*rest, *added)


def _inward(data: bytes, low: int, high: int) -> tuple[int, int]:
    """The run without the parts of characters at its ends, which stay."""
    while low < high and data[low] & 0xC0 == 0x80:
        low += 1
    while high > low and high < len(data) and data[high] & 0xC0 == 0x80:
        high -= 1
    return low, high


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the repeated runs; a character that a run ends inside of stays whole.

    ``n_chars`` is kept true where the table has it.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    text, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    keyed = docs.toDF(*names).withColumn("_data", F.coalesce(F.col(names[text]).cast("binary"), F.lit(b"")))
    keyed = keyed.select(*names, *_key_columns(F.col("_data")))
    joined = keyed.join(repeat_facts(docs).select("k1", "k2", "starts", "ends", "copied"), ["k1", "k2"], "left").select(*names, "starts", "ends", "copied")
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, copied = (batch.column(len(names) + k).to_pylist() for k in range(3))
            texts = []
            for body, a, b, whole in zip(batch.column(text).to_pylist(), starts, ends, copied, strict=True):
                if body is None or not (a or whole):
                    texts.append(body)
                    continue
                data, kept, end = body.encode(), [], 0
                for low, high in [(0, len(data))] if whole else zip(a, b, strict=True):
                    low, high = _inward(data, low, high)
                    kept.append(data[end:low])
                    end = high
                texts.append(b"".join([*kept, data[end:]]).decode())
            columns = list(batch.columns[: len(names)])
            columns[text] = pa.array(texts, pa.string())
            if chars >= 0:
                columns[chars] = pa.array([0 if t is None else len(t) for t in texts], pa.int64()).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, schema).toDF(*docs.columns)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
