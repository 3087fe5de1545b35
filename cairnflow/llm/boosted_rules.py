"""Quality rules by gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, release, table
from .doc_stats import FEATURES, block_rows, in_blocks, labelled_rows, summed, with_statistics

#: Gradients are summed in whole numbers of this part of one.
UNIT = 1 << 30
#: Sums after which the driver lets go of what they left.
SUMS = 30
#: More of these never raises a score.
FALLING = ("symbol_share", "shout_share", "bar_share", "top_share", "repeat_share", "dup_line_share")
#: Share of good labelled documents that the cut-off keeps, at least.
KEEP_GOOD = 0.999


@dataclass
class Trees:
    """Nodes of all trees in flat arrays; a leaf's children are itself."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``: all trees of a row walk down a level at once."""
        out = np.full(len(x), self.base)
        for start in range(0, len(x), 8192):
            rows = x[start : start + 8192]
            node = np.tile(self.roots, (len(rows), 1))
            index = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                node = np.where(rows[index, self.feature[node]] <= self.cut[node], self.low[node], self.high[node])
            out[start : start + 8192] += self.value[node].sum(axis=1)
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, *, bins: int = 64, **options) -> Trees:
    """:func:`boosted` over rows at hand."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0) for c in x.T]
    binned = in_bins(x, cuts)
    return boosted(lambda measure: measure(binned, y), cuts, len(y), int(y.sum()), **options)


def in_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The number of cuts below each value; there are at most 255."""
    return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1).astype(np.uint8)


def _walk(columns: np.ndarray, nodes: list[list[float]], at: int, value):
    """``value(leaf)`` of the leaf that each row reaches from the node ``at``."""
    feature, k, low, high, _ = nodes[at]
    if low == at:
        return value(at)
    return np.where(columns[feature] <= k, _walk(columns, nodes, low, value), _walk(columns, nodes, high, value))


def _raw(columns: np.ndarray, nodes: list[list[float]], roots: list[int], base: float) -> np.ndarray:
    raw = np.full(columns.shape[1], base)
    for root in roots:
        raw += _walk(columns, nodes, root, lambda at: nodes[at][4])
    return raw


def _histograms(x: np.ndarray, y: np.ndarray, nodes: list, roots: list[int], base: float, root: int, leaves: list[int], width: int) -> np.ndarray:
    """(leaf, feature, bin, 3): rows, gradients and curvatures in whole units of 1 / UNIT, so that sums don't depend on their order."""
    columns = np.ascontiguousarray(x.T)
    p = 1 / (1 + np.exp(-_raw(columns, nodes, roots, base)))
    slots = {leaf: i for i, leaf in enumerate(leaves)}
    slot = np.broadcast_to(_walk(columns, nodes, root, lambda at: slots.get(at, len(leaves))), p.shape).astype(np.int64) * width
    size = (len(leaves) + 1) * width
    weights = [None, np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)]
    out = np.empty((len(columns), size, 3), np.int64)
    for f, c in enumerate(columns):
        for i, w in enumerate(weights):
            out[f, :, i] = np.bincount(slot + c, w, size)
    return out.reshape(len(columns), -1, width, 3)[:, :-1].swapaxes(0, 1)


def boosted(over, cuts: list[np.ndarray], rows: int, good: int, *, falling: tuple[str, ...] = FALLING, trees: int = 60, depth: int = 3, rate: float = 0.15, least: int = 10, penalty: float = 1.0) -> Trees:
    """Boost regression trees on the logistic loss, by histograms, with monotone constraints.

    ``over(measure)`` sums ``measure(bins, labels)`` over all rows; a tree takes one sum a level.
    For a falling feature the lower side of a split must not get less than the higher
    one, and the middle between both bounds what is below either side.
    """
    nodes: list[list[float]] = []  # feature, bin, low, high, value
    roots: list[int] = []
    rate_good = float(np.clip(good / rows if rows else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(rate_good / (1 - rate_good)))
    sign = [name in falling for name in FEATURES]
    width = max(map(len, cuts)) + 1

    def leaf() -> int:
        nodes.append([0, 0, len(nodes), len(nodes), 0.0])
        return len(nodes) - 1

    def split(found: np.ndarray, floor: float, roof: float):
        """(own weight, None or (feature, bin, the sides' rows and weights)) of a leaf."""
        weight = lambda a, b: np.clip(-a / (b + penalty), floor, roof)
        gain = lambda a, b, w: -(a * w + 0.5 * (b + penalty) * w * w)
        many = int(found[0, :, 0].sum())
        total_g, total_h = found[0, :, 1].sum() / UNIT, found[0, :, 2].sum() / UNIT
        own = float(weight(total_g, total_h))
        best = (1e-6, None)
        for f, c in enumerate(cuts if many >= 2 * least else []):
            if not len(c):
                continue
            n, a1, b1 = found[f, : len(c)].cumsum(axis=0).T
            a1, b1 = a1 / UNIT, b1 / UNIT
            w1, w2 = weight(a1, b1), weight(total_g - a1, total_h - b1)
            got = gain(a1, b1, w1) + gain(total_g - a1, total_h - b1, w2) - gain(total_g, total_h, own)
            bad = (n < least) | (n > many - least) | ((w1 < w2) if sign[f] else False)
            got = np.where(bad, -np.inf, got)
            k = int(got.argmax())
            if got[k] > best[0]:
                best = (float(got[k]), (f, k, (int(n[k]), float(w1[k])), (many - int(n[k]), float(w2[k]))))
        return own, best[1]

    for _ in range(trees if 0 < good < rows else 0):
        root = leaf()
        open_leaves = [(root, -4.0, 4.0)]
        for level in range(depth):
            own_leaves = [at for at, _, _ in open_leaves]
            found = over(partial(_histograms, nodes=nodes, roots=roots, base=base, root=root, leaves=own_leaves, width=width))
            grown = []
            for own, (at, floor, roof) in zip(found, open_leaves, strict=True):
                weight, best = split(own, floor, roof)
                nodes[at][4] = rate * weight
                if best is None:
                    continue
                f, k, (n1, w1), (n2, w2) = best
                middle = (w1 + w2) / 2
                sides = ((n1, w1, middle, roof), (n2, w2, floor, middle)) if sign[f] else ((n1, w1, floor, roof), (n2, w2, floor, roof))
                both = []
                for n, w, low, high in sides:
                    both.append(leaf())
                    nodes[both[-1]][4] = rate * float(np.clip(w, low, high))
                    if n >= 2 * least:
                        grown.append((both[-1], low, high))
                nodes[at] = [f, k, *both, 0.0]
            open_leaves = grown
            if level + 1 == depth or not grown:
                break
        roots.append(root)
        if nodes[root][2] == root and abs(nodes[root][4]) < 1e-9:
            break
    flat = np.array([[f, cuts[f][k] if low != at else np.inf, low, high, value] for at, (f, k, low, high, value) in enumerate(nodes)], float).reshape(-1, 5)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots, np.int64), base, depth)


def quantile_cuts(rows: DataFrame, bins: int = 64) -> list[np.ndarray]:
    """Each feature's values that cut all rows into ``bins`` of like counts.

    Values are counted to 12 bits behind the leading one, which bounds the counts of a
    feature whatever the number of rows; a cut is the upper end of a counted value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, c in enumerate(batch.columns):
                keys, n = np.unique((np.maximum(c.to_numpy(), 0.0) + 0.0).astype(np.float32).view(np.int32) >> 11, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), f, np.int32)), pa.array(keys), pa.array(n.astype(np.int64))], names=["f", "k", "n"])

    counts = rows.select(*FEATURES).mapInArrow(run, "f int, k int, n long").groupBy("f", "k").agg(F.sum("n").alias("n"))
    by_value = Window.partitionBy("f").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("to", F.sum("n").over(by_value)).withColumn("all", F.sum("n").over(Window.partitionBy("f")))
    marks = upto.filter(F.expr(f"(to - n) * {bins} DIV all < least(to * {bins} DIV all, {bins - 1})")).select("f", "k").collect()
    return [((np.array(sorted(r.k for r in marks if r.f == f), np.int32) + 1) << 11).astype(np.int32).view(np.float32).astype(float) for f in range(len(FEATURES))]


def _cells(x: np.ndarray, y: np.ndarray, nodes: list, roots: list[int], base: float, start: int, step: int, size: int) -> np.ndarray:
    """Counts of good rows in ``size`` cells of log-odds, each 1 / step wide, from start / step on."""
    raw = _raw(np.ascontiguousarray(x.T), nodes, roots, base)[y == 1]
    at = np.floor(raw * step).astype(np.int64) - start
    return np.bincount(at[(at >= 0) & (at < size)], minlength=size)


def reached(over, model: Trees, cuts: list[np.ndarray], good: int, share: float) -> float:
    """The log-odds, to 2 ** -20, that ``share`` of all good rows reach: counted in cells of 1 / 1024, then inside of the one that holds it."""
    nodes = [[f, int(np.searchsorted(cuts[f], c)), low, high, v] for f, c, low, high, v in zip(model.feature.tolist(), model.cut.tolist(), model.low.tolist(), model.high.tolist(), model.value.tolist(), strict=True)]
    most = 1 + int(abs(model.base) + 4 * len(model.roots))
    below, start, step, size = int((1 - share) * good), -most << 10, 1 << 10, most << 11
    for _ in range(2):
        upto = over(partial(_cells, nodes=nodes, roots=model.roots.tolist(), base=model.base, start=start, step=step, size=size)).cumsum()
        at = int(np.searchsorted(upto, below, side="right"))
        below -= int(upto[at - 1]) if at else 0
        start, found, step, size = (start + at) << 10, (start + at) / step, 1 << 20, 1 << 10
    return found


def fit_rules(docs: DataFrame, labels: DataFrame, *, keep_good: float = KEEP_GOOD) -> tuple[Trees, float]:
    """Trees on all labelled documents, and the cut-off: the log-odds that ``keep_good`` of the good ones reach, 0 at most.

    Statistics are written once, as values and as bins; tasks sum the histograms of a level
    over all rows. Without labels of both kinds there are no trees and everything is kept.
    """
    rows = cut(labelled_rows(docs, labels).drop("label_id"), "rules-rows")
    many, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < good < many:
        return boosted(None, [np.zeros(0)] * len(FEATURES), many, good), -np.inf
    cuts = quantile_cuts(rows)
    blocks = block_rows(in_blocks(rows, "rules-bins", partial(in_bins, cuts=cuts), np.uint8), 1 + many // 20000)
    sums = count(1)

    def over(measure) -> np.ndarray:
        if next(sums) % SUMS == 0:
            release(docs.sparkSession)
        return summed(blocks, measure, kind=np.uint8)

    model = boosted(over, cuts, many, good)
    return model, min(0.0, reached(over, model, cuts, good, keep_good))


def with_verdicts(docs: DataFrame, model: Trees, cut_off: float, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, the counts, ``base_failed``, ``score`` (0 to 1) and ``kept`` of every row.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows; null
    and empty texts fail. kept: the base passed and the trees reach the cut-off. Each row is
    judged alone, so repeated rows agree.
    """

    def score(counts: np.ndarray, shares: np.ndarray) -> list[np.ndarray]:
        raw = model.raw(shares)
        failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
        return [failed, 1 / (1 + np.exp(-raw)), ~failed & (raw >= cut_off)]

    return with_statistics(docs, score, keep=keep, text_col=text_col, extra="base_failed boolean, score double, kept boolean")


def op7_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, cut_off = fit_rules(docs, table(spark, sf_dir, "labels"))
    return with_verdicts(docs, model, cut_off, keep=["doc_id"])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep, whole, with all their columns.

    Null and empty texts fail the base rules and go; repeated rows are judged alike.
    """
    model, cut_off = fit_rules(docs, table(spark, sf_dir, "labels"))
    names = [f"_{i}" for i in range(len(docs.columns))]
    return with_verdicts(docs.toDF(*names), model, cut_off, keep=names, text_col=names[docs.columns.index("text")]).filter("kept").select(*names).toDF(*docs.columns)
