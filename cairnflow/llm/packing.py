"""Packing documents into token sequences beside their lexical neighbours.

Documents are tokenized once. Document frequencies and the mean length are those of all
documents. A tree of principal directions, fitted on a bounded sample, gives each document
a place among lexically similar ones; runs in that order are shards. Each shard's BM25 index
is asked for the unused neighbours of every seed, by all of the seed's terms.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_bytes

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Token ids of one index shard, and what a document counts for besides its own: the bound of a task's memory.
SHARD_TOKENS = 3 << 20
DOCUMENT_COST = 32
#: Shards of one task.
SHARDS_A_TASK = 2
#: Documents that the routing tree is fitted on (about), its depth, and dimensions of its vectors.
SAMPLE = 4096
DEPTH = 9
DIMENSIONS = 32
SEED = 17
#: Words whose ids a Python worker remembers, those it encodes at once, and text bytes that are split into words at once.
WORD_CACHE = 2_000_000
NEW_WORDS = 500
ENCODE_BYTES = 4 << 20
_TAIL = b".,;:!?"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _bytes_in(chars: bytes) -> np.ndarray:
    own = np.zeros(256, bool)
    own[list(chars)] = True
    return own


_STOP, _SPACE, _ALNUM = _bytes_in(_TAIL), _bytes_in(b" \t\n\x0b\x0c\r"), _bytes_in(bytes(b for b in range(128) if chr(b).isalnum()))


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and the ends of its values, from 0 on."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends[1:].astype(np.int64) - ends[0]


def _binary(data: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _words_apart(column: pa.Array) -> pa.Array:
    """Texts in lower case, with a space before stops that end a word.

    A stop after a letter or digit and before white space is a piece of its own for the
    vocabulary, so the ids stay. Its normalizer lower-cases, so capitals of ASCII may go
    first, but in texts with marks that compose with them or with special tokens.
    """
    data, ends = _spans(column)
    if not len(data):
        return _binary(data, ends, pa.string())
    raw = data.tobytes()
    out = np.frombuffer(bytearray(raw.lower()), np.uint8)
    if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw:
        special = np.flatnonzero((data == 0xCC) | (data == 0xCD) | (data == 60) & (np.append(data[1:], 32) == 124))
        for d in np.unique(np.searchsorted(ends, special, side="right")).tolist():
            low = ends[d - 1] if d else 0
            out[low : ends[d]] = data[low : ends[d]]
    stops = np.flatnonzero(_STOP[data])
    stops = stops[(stops > 0) & (stops + 1 < len(data))]
    stops = stops[_ALNUM[data[stops - 1]] & _SPACE[data[stops + 1]]]
    return _binary(np.insert(out, stops, 32), ends + np.searchsorted(stops, ends), pa.string())


class WordTokenizer:
    """Ids of whole texts, word by word.

    The vocabulary's pre-tokenizer drops white space and no token crosses it, so the ids of
    a text are those of its words in a row. Each different word is encoded once and kept in
    arrays, about 30 bytes each, found by a hash of 64 bits.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)  # for words of letters that normalizing leaves as they are
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        top = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if top <= 1 << 16 else "<u4")
        self.closes = np.zeros(top, bool)  # tokens that end a piece of a word
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end = end_id
        self._forget()

    def _forget(self) -> None:
        """No words: sorted hashes, where a word's ids begin and how many there are."""
        self.hash, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text of a binary column as bytes of ``kind``, with the end id."""
        _, ends = _spans(texts)
        parts, low = [], 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + ENCODE_BYTES, side="right")))
            parts.append(self._encode(texts.slice(low, high - low)))
            low = high
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def _encode(self, texts: pa.Array) -> pa.Array:
        words = pc.ascii_split_whitespace(_words_apart(texts))
        coded = words.flatten().dictionary_encode()
        data, ends = _spans(coded.dictionary)
        data, ends = data.tobytes(), ends.tolist()
        names = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        at, known = self._find(names)
        if not known.all():
            if len(self.hash) + np.count_nonzero(~known) > WORD_CACHE:
                self._forget()
                known[:] = False
            self._learn([w for w, k in zip(names, known.tolist(), strict=True) if not k])
            at, _ = self._find(names)
        at = at[coded.indices.to_numpy()]
        first, sizes = self.first[at], self.size[at]
        done = np.append(0, np.cumsum(sizes, dtype=np.int64))
        ids = self.ids[np.arange(done[-1]) + np.repeat(first - done[:-1], sizes)]
        ends = done[np.cumsum(pc.list_value_length(words).to_numpy())]
        ids = np.insert(ids, ends, self.kind.type(self.end))
        return _binary(ids.view(np.uint8), (ends + np.arange(1, len(ends) + 1)) * self.kind.itemsize, pa.binary())

    def _find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word, by a hash of 64 bits, and whether it is known."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.hash, hashes), max(0, len(self.hash) - 1))
        return at, (self.hash[at] == hashes) if len(self.hash) else np.zeros(len(words), bool)

    def _keep(self, words: list[bytes], ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        """Different new words with their ids, in a row, and how many each has."""
        if not words:
            return
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.argsort(hashes)
        place = np.searchsorted(self.hash, hashes[order])
        first = self.used + np.cumsum(sizes) - sizes
        self.hash, self.first, self.size = (np.insert(old, place, new[order]) for old, new in ((self.hash, hashes), (self.first, first), (self.size, sizes.astype(np.int32))))
        self.used += len(ids)

    def _learn(self, new: list[bytes]) -> None:
        """Encode different words; a stop at the end of one is a piece of its own, so what is before it is encoded alone."""
        parted, plain, other = [], dict.fromkeys(w for w in new if w.isalpha()), {}
        for word in (w for w in new if not w.isalpha()):
            core = word.rstrip(_TAIL)
            if len(core) < len(word) and core and _apart(core):
                parted.append((word, core, word[len(core) :]))
            else:
                (plain if word.decode().isalpha() else other)[word] = None
        parts = list(dict.fromkeys(x for _, *both in parted for x in both))
        for part, known in zip(parts, self._find(parts)[1].tolist(), strict=True):
            if not known:
                (plain if part.decode().isalpha() else other)[part] = None
        learnt = [self._learn_some(words[low : low + NEW_WORDS], fast) for words, fast in ((list(plain), True), (list(other), False)) for low in range(0, len(words), NEW_WORDS)]
        self._keep([*plain, *other], [ids for ids, _ in learnt], [sizes for _, sizes in learnt])
        if parted:
            at = self._find([x for _, *both in parted for x in both])[0]
            sizes = self.size[at].astype(np.int64)
            ids = self.ids[np.arange(sizes.sum()) + np.repeat(self.first[at] - (np.cumsum(sizes) - sizes), sizes)]
            self._keep([word for word, *_ in parted], [ids], [sizes.reshape(-1, 2).sum(axis=1)])

    def _learn_some(self, words: list[bytes], fast: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, in a row, and how many each has. They are encoded in one go, a space apart; those of letters alone are one piece each, others are told by where their ids begin."""
        joined = b" ".join(words).decode()
        if fast:
            own = self.bare if joined.isascii() and joined.islower() or joined.lower() == joined and unicodedata.is_normalized("NFC", joined) else self.tokenizer
            ids = np.array(own.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(self.closes[ids]) + 1
        if not fast or len(cuts) != len(words) or cuts[-1] != len(ids):
            found = self.tokenizer.encode(joined, add_special_tokens=False)
            begin = np.fromiter(chain.from_iterable(found.offsets), np.int64)[::2]
            ids = np.array(found.ids, self.kind)
            cuts = np.searchsorted(begin, np.cumsum([len(w.decode()) + 1 for w in words]), side="left")
        return ids, np.diff(cuts, prepend=0)


def _apart(core: bytes) -> bool:
    """Whether a stop after ``core`` is a piece of its own: after a letter or digit that normalizing leaves as it is."""
    if core[-1] < 128:
        return core[-1:].isalnum()
    last = core.decode()[-1]
    return last.isalpha() and last.lower() == last and unicodedata.is_normalized("NFC", last)


@cache
def shared_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a Python worker, so that words are learned once there."""
    return WordTokenizer(path)


@cache
def vocabulary(path: str) -> tuple[int, np.dtype]:
    """Number and kind of a tokenizer's ids; the driver needs no more of it and keeps no more."""
    words = WordTokenizer(path)
    return len(words.closes), words.kind


# ---- places of documents among similar ones


@cache
def _directions(terms: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((terms, DIMENSIONS), np.float32)


def counted(docs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and their counts of each document."""
    return [np.unique(x, return_counts=True) for x in docs]


def vectors(own: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """A random projection of each document's weighted terms (:func:`counted`), of length 1 (0 without any weight)."""
    docs = own
    out, low = np.zeros((len(docs), DIMENSIONS), np.float32), 0
    sizes = np.cumsum([len(t) for t, _ in own])
    while low < len(docs):
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + (1 << 17), side="right")))
        term = np.concatenate([t for t, _ in own[low:high]]).astype(np.int64)
        weight = idf[term] * (1 + np.log(np.concatenate([c for _, c in own[low:high]]).astype(np.float32)))
        starts = np.cumsum([0] + [len(t) for t, _ in own[low : high - 1]])
        out[low:high] = np.add.reduceat(_directions(len(idf))[term] * weight[:, None].astype(np.float32), starts, axis=0)
        low = high
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass
class Tree:
    """Nodes in arrays: a direction, where it is cut, the children, and the number of a leaf (its children are itself)."""

    direction: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaf: np.ndarray
    depth: int

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row and its place along the leaf's direction."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = np.where(np.einsum("ij,ij->i", x, self.direction[node]) <= self.cut[node], self.low[node], self.high[node])
        return self.leaf[node], np.einsum("ij,ij->i", x, self.direction[node]).astype(np.float64)


def fit_tree(x: np.ndarray, depth: int = DEPTH, least: int = 8) -> Tree:
    """Halve the rows at the median along their main direction, again and again; leaves are numbered from left to right."""
    nodes: list[list] = []
    leaves = 0

    def grow(rows: np.ndarray, level: int, above: np.ndarray) -> int:
        nonlocal leaves
        at = len(nodes)
        own = x[rows] - x[rows].mean(axis=0) if len(rows) else x[rows]
        way = np.linalg.eigh(own.T @ own)[1][:, -1].astype(np.float32) if len(rows) > 1 else above
        way = way * (1 if way[np.abs(way).argmax()] > 0 else -1)
        nodes.append([way, np.inf, at, at, 0])
        if level < depth and len(rows) >= 2 * least:
            along = x[rows] @ way
            middle = float(np.median(along))
            side = along <= middle
            if 0 < side.sum() < len(rows):
                nodes[at][1] = middle
                nodes[at][2] = grow(rows[side], level + 1, way)
                nodes[at][3] = grow(rows[~side], level + 1, way)
                return at
        nodes[at][4] = leaves
        leaves += 1
        return at

    grow(np.arange(len(x)), 0, np.zeros(x.shape[1], np.float32))
    way, at, low, high, leaf = zip(*nodes, strict=True)
    return Tree(np.array(way, np.float32), np.array(at), np.array(low), np.array(high), np.array(leaf), depth)


# ---- index and packing of a shard


def idf_of(df: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p((documents - df + 0.5) / (df + 0.5)).astype(np.float32)


class Index:
    """A BM25 inverted index over a shard's documents; ``idf`` by term and ``mean`` length are those of the whole corpus."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        own = [np.unique(x, return_counts=True) for x in items]
        self.ends = np.cumsum([0] + [len(t) for t, _ in own])
        term = np.concatenate([t for t, _ in own])
        tf = np.concatenate([c.astype(np.float32) for _, c in own])
        del own
        item = np.repeat(np.arange(len(items), dtype=np.int32), np.diff(self.ends))
        sizes = np.array([len(x) for x in items], np.float32)
        norm = (k1 * (1 - b + b * sizes / max(mean, 1.0))).astype(np.float32)
        weight = idf[term] * tf * np.float32(k1 + 1) / (tf + norm[item])
        order = np.argsort(term, kind="stable")
        names, first, df = np.unique(term[order], return_index=True, return_counts=True)
        self.first, self.after = first, first + df
        self.slot = np.searchsorted(names, term).astype(np.int32)
        common = np.flatnonzero(4 * df > len(items))  # a row of weights for all documents is faster there
        self.row = np.full(len(names), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(items)), np.float32)
        for r, t in enumerate(common.tolist()):
            own = order[first[t] : first[t] + df[t]]
            self.dense[r, item[own]] = weight[own]
        self.item, self.weight, self.n = item[order].astype(np.int64), weight[order].astype(np.float64), len(items)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents by BM25 score of the seed's terms, all of them, best first; those that share none are left out."""
        terms = self.slot[self.ends[seed] : self.ends[seed + 1]]
        rows = self.row[terms]
        score = self.dense[rows[rows >= 0]].sum(axis=0, dtype=np.float64)
        terms = terms[rows < 0]
        parts = [slice(a, b) for a, b in zip(self.first[terms].tolist(), self.after[terms].tolist(), strict=True)]
        if parts:
            score += np.bincount(np.concatenate([self.item[p] for p in parts]), np.concatenate([self.weight[p] for p in parts]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]

    def forget_used(self, unused: np.ndarray) -> None:
        """Drop the postings of used documents."""
        keep = unused[self.item]
        at = np.append(0, np.cumsum(keep))
        self.first, self.after, self.item, self.weight = at[self.first], at[self.after], self.item[keep], self.weight[keep]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length): every id once, all sequences full but those of powers of two.

    What a document has over whole windows is cut off first. Each seed's window is then
    filled by unused neighbours that fit; the best that is left is cut to fill the rest, and
    what remains of it is the next seed. The last window is cut into powers of two.
    """
    out: list[list[tuple[int, int, int]]] = []
    start, left = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for d, ids in enumerate(docs):
        whole = len(ids) // window
        out += [[(d, k * window, window)] for k in range(whole)]
        start[d], left[d] = whole * window, len(ids) - whole * window
    index = Index([ids[s:] if len(ids) > s else ids[-1:] for ids, s in zip(docs, start, strict=True)], idf, mean)
    unused = left > 0
    queue, at, seed, live = np.argsort(-left, kind="stable"), 0, -1, len(docs)
    while True:
        if np.count_nonzero(unused) < 0.75 * live:
            index.forget_used(unused)
            live = np.count_nonzero(unused)
        if seed < 0:
            while at < len(queue) and not unused[queue[at]]:
                at += 1
            if at == len(queue):
                break
            seed = int(queue[at])
        row = [(seed, int(start[seed]), int(left[seed]))]
        room = window - int(left[seed])
        unused[seed] = False
        near = index.neighbours(seed, unused) if room else np.zeros(0, np.int64)
        seed, k = -1, 0
        while room and k < len(near):
            fits = np.flatnonzero(left[near[k:]] <= room)
            if not len(fits):
                break
            k += int(fits[0])
            d = int(near[k])
            row.append((d, int(start[d]), int(left[d])))
            room -= int(left[d])
            unused[d] = False
            k += 1
        spare = iter(near[unused[near]].tolist()) if room else iter(())
        while room:
            d = next(spare, -1)
            if d < 0:
                while at < len(queue) and not unused[queue[at]]:
                    at += 1
                if at == len(queue):
                    break
                d = int(queue[at])
            take = min(room, int(left[d]))
            row.append((d, int(start[d]), take))
            room -= take
            start[d] += take
            left[d] -= take
            if left[d]:
                seed = d
            else:
                unused[d] = False
        if room:
            out += _powers_of_two(row)
        else:
            out.append(row)
    return out


def _powers_of_two(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    total = sum(n for *_, n in row)
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    out, rest = [], list(row)
    for size in sizes:
        part = []
        while size:
            d, s, n = rest.pop(0)
            take = min(n, size)
            part.append((d, s, take))
            size -= take
            if take < n:
                rest.insert(0, (d, s + take, n - take))
        out.append(part)
    return out


# ---- the corpus


def _arrays(column: pa.Array, kind: np.dtype) -> list[np.ndarray]:
    """Ids of each value of a binary column."""
    data, ends = _spans(column)
    return [data[a:b].view(kind) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Frequencies:
    """Documents that have each term, documents and ids, added up over documents or over the bytes of other such counts."""

    def __init__(self, terms: int):
        self.counts = np.zeros(terms + 2, np.int64)

    def add(self, own: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for term, n in own:
            self.counts[term] += 1
            self.counts[-1] += int(n.sum())
        self.counts[-2] += len(own)

    def row(self) -> bytes:
        return self.counts.astype("<i8").tobytes()


def _summed(rows: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Document frequencies, documents and ids of all rows of (df); one row for each term of the vocabulary reaches the driver."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 2, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(terms + 2)), pa.array(total)], names=["term", "n"])

    found = rows.filter("df IS NOT NULL").select("df").mapInArrow(spread, "term long, n long").filter("n > 0").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(terms + 2, np.int64)
    total[found["term"].to_numpy()] = found["n"].to_numpy()
    return total[:-2], int(total[-2]), int(total[-1])


def routing_tree(docs: DataFrame, path: str, *, sample: int = SAMPLE) -> tuple[Tree, np.ndarray]:
    """The tree and the term weights that its vectors take, fitted on about ``sample`` documents picked by hash."""
    terms, kind = vocabulary(path)
    rate = max(1, -(-docs.count() // sample))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, df = shared_tokenizer(path), Frequencies(terms)
        for batch in batches:
            tokens = words.encode(batch.column(0))
            df.add(counted(_arrays(tokens, kind)))
            yield pa.RecordBatch.from_arrays([tokens, pa.nulls(len(tokens), pa.binary())], names=["tokens", "df"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([df.row()], pa.binary())], names=["tokens", "df"])

    picked = docs.select(text_bytes(), "doc_id").filter(F.pmod(F.xxhash64("doc_id", "data"), F.lit(rate)) == 0).select("data")
    tokens = cut(picked.mapInArrow(code, "tokens binary, df binary"), "packing-sample")
    df, n, _ = _summed(tokens, terms)
    weights = idf_of(df, n)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(counted(_arrays(batch.column(0), kind)), weights)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float32()))], names=["v"])

    rows = tokens.filter("tokens IS NOT NULL").select("tokens").mapInArrow(project, "v array<float>").toArrow()["v"].to_pylist()
    x = np.array(rows, np.float32).reshape(-1, DIMENSIONS)
    return fit_tree(x[np.lexsort(x.T)]), weights


def pack(docs: DataFrame, *, window: int = WINDOW, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS, sample: int = SAMPLE, ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Shards are runs of similar documents cut at ``shard_tokens``, so any number of equal rows
    is split. A null or empty text is the end id alone; null and repeated ids are documents
    of their own. Ids are taken as long integers. Other columns are ignored.
    """
    path = tokenizer or tokenizer_path()
    terms, kind = vocabulary(path)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tree, weights = routing_tree(docs, path, sample=sample)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents, and at the end one with the task's counts."""
        words, df, names = shared_tokenizer(path), Frequencies(terms), ["doc_id", "tokens", "leaf", "place", "df"]
        for batch in batches:
            coded = words.encode(batch.column(1))
            own = counted(_arrays(coded, kind))
            df.add(own)
            leaf, place = tree.places(vectors(own, weights))
            yield pa.RecordBatch.from_arrays([batch.column(0), coded, pa.array(leaf.astype(np.int32)), pa.array(place), pa.nulls(len(own), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.float64())), pa.array([df.row()], pa.binary())], names=names)

    routed = docs.select("doc_id", text_bytes()).mapInArrow(code, "doc_id long, tokens binary, leaf int, place double, df binary")
    tokens = cut(routed, "packing-tokens")
    df, documents, total = _summed(tokens, terms)
    tokens = tokens.filter("tokens IS NOT NULL").drop("df")
    idf, mean = idf_of(df, documents), total / max(1, documents)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 8 if ids else 7]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]

    def solve(first: int, own: list[int | None], coded: list[bytes]) -> tuple[int, Iterator[pa.RecordBatch]]:
        arrays = [np.frombuffer(c, kind) for c in coded]
        sequences = pack_shard(arrays, idf, mean, window)

        def batches() -> Iterator[pa.RecordBatch]:
            out: list[list] = [[] for _ in names]
            for k, pieces in enumerate(sequences):
                offset = 0
                for d, s, n in pieces:
                    part = arrays[d][s : s + n]
                    row = (own[d], s, n, zlib.crc32(part.astype("<u4")), len(arrays[d]), first + k, offset, part.astype(np.int32) if ids else None)
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                    offset += n
                if len(out[0]) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=False)], names=names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=False)], names=names)

        return first + len(sequences), batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, coded, size, first = [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                cost = len(data) // kind.itemsize + DOCUMENT_COST
                if own and size + cost > shard_tokens:
                    first, made = solve(first, own, coded)
                    yield from made
                    own, coded, size = [], [], 0
                own.append(doc_id)
                coded.append(data)
                size += cost
        if own:
            yield from solve(first, own, coded)[1]

    tasks = max(1, -(-(total + DOCUMENT_COST * documents) // (SHARDS_A_TASK * shard_tokens)))
    order = ["leaf", "place", "h", "doc_id"]
    dealt = tokens.withColumn("h", F.xxhash64("doc_id", "tokens")).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    schema = ", ".join(f"{n} long" for n in names[:7]) + (", ids array<int>" if ids else "")
    return dealt.select("doc_id", "tokens").mapInArrow(run, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids; nulls, empty texts and repeated rows as in :func:`pack`."""
    return pack(docs, ids=True)
