"""SimHash near-duplicates: pigeonhole blocks, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, release, small_batches, table, text_bytes

SEED = 42
MAX_BITS = 3
#: Distinct fingerprints of one bucket that a task compares; larger buckets go to finer blocks.
BUCKET_CAP = 16384
#: Near copies of the pipeline: words of a shingle, and the least Jaccard similarity of two texts' shingles as a fraction.
NEAR_WIDTH = 5
NEAR = (4, 5)
#: Smallest hashes of a text's shingles, each in another order, by which large groups of near copies meet early.
LEAST = 6
#: Bits of a map of a text's shingles: each flips one, so texts differ in as many shingles at least as their maps in bits.
MAP_BITS = 2048
#: Of the shared keys a turn of stars takes one in so many, and such turns come first.
STAR_KEYS, STAR_TURNS = 4, 2
#: Texts from which common shingles are told, and how many of these are known. Both only set an order that saves time.
SAMPLE = 16_000
COMMON = 600_000


def shingle_hashes(data: bytes, width: int = 3) -> np.ndarray:
    """Hashes of the word shingles of the ASCII-lowered text, repeats and all; that of no words without any."""
    words = data.lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest, total = xxhash.xxh64_intdigest, len(words) - width + 1
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts[:total], starts[width:], strict=True)), np.uint64, total)


def simhash(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[low : low + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(data: bytes, width: int = 3) -> int:
    """64-bit SimHash over word shingles of the ASCII-lowered text; zero without words."""
    return simhash(shingle_hashes(data, width)) if data.split() else 0


def with_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp) of every row: fp as a signed long, h a hash that tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "h", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), text_bytes(text_col))
    return own.mapInArrow(run, "doc_id long, h long, fp long")


def block_masks(blocks: int, kept: int) -> list[int]:
    """Masks of every choice of ``kept`` among ``blocks`` even slices of 64 bits.

    Fingerprints that differ in ``blocks - kept`` bits at most agree on one mask at least.
    """
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    slices = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(pick) for pick in combinations(slices, kept)]


def first_blocks(n: int) -> int:
    """Blocks for n distinct fingerprints, so that keys have more bits than n needs (25, 32 or 36)."""
    return 5 if n < 1 << 21 else 6 if n < 1 << 29 else 7


def bucket_links(prints: np.ndarray, max_bits: int) -> np.ndarray:
    """For sorted distinct fingerprints, the position of the smallest member of each one's component."""
    n = len(prints)
    root, left, block = np.full(n, -1, np.int64), np.arange(n), 256
    while len(left):
        first, left = left[0], left[1:]
        root[first] = first
        frontier = np.array([first])
        while len(frontier) and len(left):
            near, rest = frontier[:block], frontier[block:]
            hit = (np.bitwise_count(prints[near][:, None] ^ prints[left][None, :]) <= max_bits).any(axis=0)
            root[left[hit]] = first
            frontier = np.concatenate([rest, left[hit]])
            left = left[~hit]
    return root


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _linked(prints: DataFrame, masks: list[int], max_bits: int, cap: int) -> DataFrame:
    """Rows (a, b, hot): links to the smallest of each bucket's component, or hot members of buckets over the cap."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)]))
    keyed = prints.select("fp", keys.alias("x")).select("x.m", "x.k", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held, over = [none] * 3, False  # the last bucket so far, or its key alone once it is over the cap

        def out(a: list[np.ndarray], b: list[np.ndarray], hot: np.ndarray) -> pa.RecordBatch:
            a, b = (np.concatenate(x) if x else none for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(np.append(a, hot)), pa.array(np.append(b, hot)), pa.array(np.arange(len(a) + len(hot)) >= len(a))], names=["a", "b", "hot"])

        def judge(rows: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            """Links of whole buckets; the last one is kept for the rows that follow."""
            nonlocal held, over
            m, k, fp = rows
            edges = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (k[1:] != k[:-1]))) if len(m) else none
            ends = np.append(edges[1:], len(m))
            a, b, hot = [], [], []
            if over and len(edges):  # the first bucket goes on from one over the cap, whose key is its first row
                hot.append(fp[1 : ends[0]])
                over = len(edges) == 1 and not last
                edges, ends = (edges[:0], ends[:0]) if len(edges) == 1 else (edges[1:], ends[1:])
                if over:
                    held = [x[:1] for x in rows]
                    yield out(a, b, np.concatenate(hot))
                    return
            held = [none] * 3
            if len(edges) and not last:
                held = [x[edges[-1] :] for x in rows]
                edges, ends = edges[:-1], ends[:-1]
                if len(held[0]) > cap:
                    hot.append(held[2])
                    held, over = [x[:1] for x in held], True
            for lo, hi in zip(edges[ends - edges > 1].tolist(), ends[ends - edges > 1].tolist(), strict=True):
                if hi - lo > cap:
                    hot.append(fp[lo:hi])
                    continue
                u = np.sort(fp[lo:hi].view(np.uint64))
                root = bucket_links(u, max_bits)
                own = root != np.arange(len(u))
                a.append(u[own].view(np.int64))
                b.append(u[root[own]].view(np.int64))
            yield out(a, b, np.concatenate(hot) if hot else none)

        for batch in batches:
            yield from judge([np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held)], False)
        yield from judge(held, True)

    return keyed.repartition("m", "k").sortWithinPartitions("m", "k").mapInArrow(run, "a long, b long, hot boolean")


def links(prints: DataFrame, *, max_bits: int = MAX_BITS, cap: int = BUCKET_CAP, blocks: int | None = None) -> DataFrame:
    """Links (a, b), a distinct fingerprint and a smaller one (unsigned), that connect all within ``max_bits``.

    A bucket over ``cap`` is left to finer blocks, at the end to blocks that leave so few
    bits free that no bucket can hold more than 4,096 distinct fingerprints: no pair is lost.
    """
    blocks = blocks or first_blocks(prints.count()) - MAX_BITS + max_bits
    left, out = prints, None
    for b in (blocks, 8 - MAX_BITS + max_bits, 16 - MAX_BITS + max_bits):
        last = b > 8 - MAX_BITS + max_bits
        found = cut(_linked(left, block_masks(b, b - max_bits), max_bits, 1 << 62 if last else cap), "simhash-links")
        own = found.filter("NOT hot").select("a", "b").distinct()
        out = own if out is None else out.unionByName(own)
        left = found.filter("hot").select(F.col("a").alias("fp")).distinct()
        if last or not left.take(1):
            break
    return out.distinct()


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that links lead to, by alternating large and small stars."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    before, old = None, None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(joined.select("a", F.col("low").alias("b"))).filter("a > b").distinct()
        seen = Observation()
        edges = cut(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "simhash-stars")
        if old is not None:
            drop(old)
        old = edges
        release(edges.sparkSession)  # joins of rounds leave their broadcasts
        now = seen.get
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, cap: int = BUCKET_CAP) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Fingerprints within ``max_bits`` bits are linked; component_id is the smallest id that
    links lead to. Null and wordless texts have fingerprint zero and are linked by it as
    any other. Rows with one id or text keep one result row each; a null id takes its
    component's smallest id, null if it has none. Ids are taken as long integers; other
    columns are ignored.
    """
    prints, rooted = _rooted(docs, id_col, text_col, max_bits, cap)
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rooted(docs: DataFrame, id_col: str, text_col: str, max_bits: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp) of every row, and (fp, first_id, root) of every fingerprint."""
    prints = cut(with_fingerprints(docs, id_col=id_col, text_col=text_col), "simhash-prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comp = components(links(nodes.select("fp"), max_bits=max_bits, cap=cap))
    return prints, nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def _common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several texts of a sample share, and their counts."""
    rate = max(1, -(-docs.count() // SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(x.as_py(), NEAR_WIDTH)).view(np.int64))], names=["k"])

    some = docs.filter(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(rate)) == 0).select(text_bytes())
    seen = some.mapInArrow(run, "k long").groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    rows = seen.orderBy(F.col("n").desc(), "k").limit(COMMON).toArrow()
    keys, counts = rows["k"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _near_keys(docs: DataFrame) -> DataFrame:
    """(h, fp, n, keys, bits, least) of every row: the shingles, n in all, the first of them in one order of all shingles, their map and LEAST smallest hashes.

    Texts of Jaccard t share t of the larger one's shingles, so they meet in one of its first
    (1 - t) n + 1, in whatever order: common ones come last, so that few others meet there.
    """
    known, often = _common_shingles(docs)
    orders = np.random.default_rng(SEED).integers(1 << 62, size=(LEAST, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, keys, maps, least = [], [], [], [], []
            for x in batch.column(1):
                hashes = shingle_hashes(x.as_py(), NEAR_WIDTH)
                prints.append(simhash(hashes))
                own = np.unique(hashes)
                rank = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, often[at], 0)
                first = len(own) - -(-NEAR[0] * len(own) // NEAR[1]) + 1
                sizes.append(len(own))
                keys.append(own[np.lexsort((own, rank))[:first]].view(np.int64))
                flips = np.bincount((own >> np.uint64(20)).astype(np.int64) % MAP_BITS, minlength=MAP_BITS) & 1
                maps.append(np.packbits(flips.astype(bool)).view(np.int64))
                least.append(((own ^ own >> np.uint64(29)) * orders).min(axis=1).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            bits, low = (pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x, width in ((maps, MAP_BITS // 64), (least, LEAST)))
            columns = [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists, bits, low]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "fp", "n", "keys", "bits", "least"])

    return docs.select(F.xxhash64("text").alias("h"), text_bytes()).mapInArrow(run, "h long, fp long, n long, keys array<long>, bits array<long>, least array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the rows whose k, the first column, another row has; rows come in its order."""
    held, before = None, None  # the last row, which the next one judges, and the k before it
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        k = rows.column(0).to_numpy()
        same = k[1:] == k[:-1]
        keep = np.append(before is not None and before == k[0], same) | np.append(same, False)
        yield rows.slice(0, len(k) - 1).filter(pa.array(keep[:-1]))
        held = rows.slice(len(k) - 1)
        before = k[-2] if len(k) > 1 else before
    if held is not None:
        yield held.filter(pa.array([before is not None and before == held.column(0)[0].as_py()]))


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of hashes whose texts are near copies, by their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # pairs come in the order of a, and few texts are in most of them

        def shingles(h: int, text: pa.Scalar) -> np.ndarray:
            if h not in known:
                if len(known) >= 64:
                    del known[next(iter(known))]
                known[h] = np.unique(shingle_hashes(text.as_py(), NEAR_WIDTH))
            return known[h]

        for batch in batches:
            good = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = shingles(a, x), shingles(b, y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(NEAR[1] * both >= NEAR[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, two = (texts.select(F.col("h").alias(c), F.col("data").alias(f"of_{c}")) for c in ("a", "b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "of_a", "of_b").sortWithinPartitions("a").mapInArrow(run, "a long, b long")


def near_links(docs: DataFrame, *, bits: int = MAX_BITS, cap: int = BUCKET_CAP) -> DataFrame:
    """(node, root): hashes of texts that are near copies, by links, and the smallest of their component.

    The first candidates are fingerprints within ``bits`` bits, and texts with the first of
    those that have the same smallest shingle in one of LEAST orders, which large groups do.
    All others meet in a shared key; a key's two ends are candidates with all its texts as
    long as that halves what is open, then the pairs whose texts are not yet of one
    component. Pairs are left out whose sizes, places or maps tell that they can't be alike
    enough; the others are verified on their texts.
    """
    with small_batches(docs.sparkSession, 1000):
        rows = cut(_near_keys(docs).dropDuplicates(["h"]), "simhash-keys")
    release(docs.sparkSession)
    per_print = rows.groupBy("fp").agg(F.min("h").alias("low"))
    found = links(per_print.select("fp"), max_bits=bits, cap=cap).join(per_print.toDF("a", "x"), "a").join(per_print.toDF("b", "y"), "b").select("x", "y")
    pairs = found.unionByName(rows.join(per_print, "fp").filter("h <> low").select(F.col("h").alias("x"), F.col("low").alias("y")))
    lows = rows.select("h", F.posexplode("least").alias("o", "v"))
    first = lows.groupBy("o", "v").agg(F.min("h").alias("y"), F.count("*").alias("m")).filter("m > 1")
    pairs = pairs.unionByName(lows.join(first, ["o", "v"]).filter("h <> y").select(F.col("h").alias("x"), "y"))
    keyed = rows.select("h", F.posexplode("keys").alias("p", "k")).select("k", "h", "p")
    members = cut(keyed.repartition("k").sortWithinPartitions("k").mapInArrow(_shared, "k long, h long, p int"), "simhash-members")
    # keys come in one order, so texts that first meet at places px and py share nothing before; at least 4/9 of both sizes must be left
    t, u = NEAR
    fits = f"{u} * least(nx, ny) >= {t} * greatest(nx, ny) AND {t + u} * least(nx - px, ny - py) >= {t} * (nx + ny)"
    apart = " + ".join(f"bit_count(bitsx[{i}] ^ bitsy[{i}])" for i in range(MAP_BITS // 64))
    fits += f" AND {t + u} * ({apart}) <= {u - t} * (nx + ny)"
    comp, tested, last, before = None, None, False, None
    for turn in range(8):
        if turn:
            where = members.join(comp.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("c", F.coalesce("root", "h")).drop("root")
            per = where.groupBy("k", "c").agg(F.count("*").alias("m")).groupBy("k").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("s"), F.count("*").alias("cs"))
            open_keys = cut(per.filter("cs > 1"), "simhash-open")
            left = cut(members.join(open_keys.select("k"), "k", "left_semi"), "simhash-members")  # a key that is closed once stays so
            total, size = open_keys.agg(F.coalesce(F.sum(F.col("m") * F.col("m") - F.col("s")), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
            if not total:
                break
            drop(members)
            members = left
            where = members.join(comp.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("c", F.coalesce("root", "h")).drop("root")
            last = turn == 7 or total <= 20 * size or turn > STAR_TURNS and 2 * total > before
            before = total
            keys = open_keys if last else open_keys.filter(F.pmod(F.xxhash64("k", F.lit(turn)), F.lit(STAR_KEYS)) == 0)
            where = (where if last else where.join(keys.select("k"), "k")).join(rows.select("h", "n", "bits"), "h")
            named = lambda x: where.select("k", *(F.col(c).alias(f"{c}{x}" if c != "h" else x) for c in ("h", "n", "p", "c", "bits")))  # noqa: E731, B023
            if last:
                pairs = named("x").join(named("y"), "k").filter(f"x > y AND cx <> cy AND {fits}")
            else:
                salted = F.struct(F.xxhash64("h", F.lit(turn)), "h", "n", "p", "c", "bits")
                ends = where.groupBy("k").agg(F.array(F.min(salted), F.max(salted)).alias("e")).select("k", F.explode("e").alias("e"))
                ends = ends.select("k", F.col("e.h").alias("y"), *(F.col(f"e.{c}").alias(f"{c}y") for c in ("n", "p", "c", "bits")))
                pairs = named("x").join(ends, "k").filter(f"cx <> cy AND {fits}")
            pairs = pairs.select("x", "y")
        pairs = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "simhash-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
        texts = docs.select(F.xxhash64("text").alias("h"), text_bytes()).join(wanted, "h", "left_semi").dropDuplicates(["h"])
        texts = cut(texts, "simhash-texts")
        with small_batches(docs.sparkSession, 250):  # a row holds two texts
            new = cut(_near(pairs, texts), "simhash-near")
        drop(texts)
        comp = components(new if comp is None else new.unionByName(comp.toDF("a", "b")))
        if last:
            break
    return comp


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, whole: that of the smallest id; null ids come last, then the smallest hash of the text counts.

    Null, empty and blank texts are copies of each other; texts under five words are one shingle.
    Of repeated rows one stays. Ids are taken as long integers; other columns pass through.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    per_text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).groupBy("h").agg(first)  # before the join, so that copies are one row in it
    roots = near_links(docs).select(F.col("node").alias("h"), "root")
    kept = per_text.join(roots, "h", "left").groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("first").alias("first"))
    own = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    kept = kept.select(own(F.col("first.doc_id")).alias("_id"), F.col("first.h").alias("_h")).distinct()
    names = [f"_{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    plain = docs.toDF(*names).withColumn("_id", own(F.col(names[docs.columns.index("doc_id")]).cast("long"))).withColumn("_h", F.xxhash64(text))
    same = Window.partitionBy("_id", "_h").orderBy(F.to_json(F.struct(*(n for n in names if n != text))))  # orders columns of any type
    return plain.join(kept, ["_id", "_h"]).withColumn("_n", F.row_number().over(same)).filter("_n = 1").select(*names).toDF(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
