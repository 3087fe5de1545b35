"""Language identification: a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of
labelled texts. Every byte of a text is labelled; a document's probabilities are the mean
of its bytes'. A text is cut into segments, which all run side by side as columns, so
that the time loop is over the bytes of a segment and never over those of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_bytes

#: Bytes of a segment, hidden units of each direction, and segments that run at once.
STEPS, HIDDEN, COLUMNS = 64, 6, 1024
#: Labelled documents of each language that the network is trained on, at most, and windows of each of them.
SAMPLE_DOCS, WINDOWS = 1500, 4
#: Batches of the training, windows of each, and the seed of their order.
BATCHES, BATCH, SEED = 300, 256, 7
#: The symbol after the end of a text shorter than a segment.
PAD = 256
UNKNOWN = "und"


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-a))


@dataclass
class Network:
    """Both directions at index 0 and 1 of ``inputs`` (gates by symbol), ``hidden`` (gates by unit) and ``shift``; gates are update, reset, candidate."""

    languages: list[str]
    inputs: np.ndarray  # (2, 3h, 257)
    hidden: np.ndarray  # (2, 3h, h)
    shift: np.ndarray  # (2, h, 1), of the candidate's hidden part
    weights: np.ndarray  # (2, languages, h)
    bias: np.ndarray  # (languages, 1)
    _fast: tuple = field(default=(), repr=False, compare=False)

    @classmethod
    def fresh(cls, languages: list[str], units: int = HIDDEN, seed: int = SEED) -> Network:
        rng, n = np.random.default_rng(seed), len(languages)
        some = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(languages, some(0.5, 2, 3 * units, PAD + 1), some(units**-0.5, 2, 3 * units, units), np.zeros((2, units, 1), np.float32), some(0.5, 2, n, units), np.zeros((n, 1), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.hidden, self.shift, self.weights, self.bias]

    def logits(self, symbols: np.ndarray) -> np.ndarray:
        """(steps, languages, columns) for symbols (steps, columns): what each byte says of the language."""
        steps, columns = symbols.shape
        h = self.hidden.shape[2]
        if not self._fast:  # signs and factors go into the weights, so that gates are 1 / (1 + exp(a))
            factor = np.repeat(np.array([-1, -1, -2], np.float32), h)[None, :, None]
            self._fast = (np.ascontiguousarray(self.inputs * factor), np.ascontiguousarray(self.hidden * factor), self.shift * np.float32(-2))
        inputs, hidden, shift = self._fast
        state = np.zeros((2, h, columns), np.float32)
        x, a = np.empty((2, 3 * h, columns), np.float32), np.empty((2, 3 * h, columns), np.float32)
        out = np.empty((steps, len(self.languages), columns), np.float32)
        out[:] = self.bias
        for s in range(steps):  # an exp that overflows is a closed gate
            for way, at in ((0, s), (1, steps - 1 - s)):
                np.take(inputs[way], symbols[at], axis=1, out=x[way], mode="clip")
            np.matmul(hidden, state, out=a)
            gates, candidate = a[:, : 2 * h], a[:, 2 * h :]
            gates += x[:, : 2 * h]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            candidate += shift
            candidate *= gates[:, h:]
            candidate += x[:, 2 * h :]
            np.exp(candidate, out=candidate)
            candidate += 1
            np.divide(2, candidate, out=candidate)
            candidate -= 1
            state -= candidate
            state *= gates[:, :h]
            state += candidate
            for way, at in ((0, s), (1, steps - 1 - s)):
                out[at] += self.weights[way] @ state[way]
        return out

    def gradients(self, symbols: np.ndarray, target: np.ndarray, counted: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the counted positions, and its gradients, by backpropagation through time.

        symbols and counted are (steps, columns); target holds each column's language.
        """
        steps, columns = symbols.shape
        h = self.hidden.shape[2]
        ways = np.stack([symbols, symbols[::-1]], axis=1)  # the second direction reads from the end
        kept, state = [], np.zeros((2, h, columns), np.float32)
        states = np.empty((steps, 2, h, columns), np.float32)
        for s in range(steps):
            x = np.stack([self.inputs[way][:, ways[s, way]] for way in (0, 1)])
            a = self.hidden @ state
            z, r = _sigmoid(x[:, :h] + a[:, :h]), _sigmoid(x[:, h : 2 * h] + a[:, h : 2 * h])
            q = a[:, 2 * h :] + self.shift
            n = np.tanh(x[:, 2 * h :] + r * q)
            kept.append((state, z, r, q, n))
            state = n + z * (state - n)
            states[s] = state
        forth, back = states[:, 0], states[::-1, 1]
        scores = self.weights[0] @ forth + self.weights[1] @ back + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=1, keepdims=True)
        total = max(1, int(counted.sum()))
        own = np.take_along_axis(p, np.broadcast_to(target[None, None, :], (steps, 1, columns)), axis=1)[:, 0]
        loss = float(-(np.log(np.maximum(own, 1e-12)) * counted).sum() / total)
        d = p
        d[:, target, np.arange(columns)] -= 1
        d *= (counted / np.float32(total))[:, None, :]
        d_weights = np.stack([np.einsum("slc,shc->lh", d, x, optimize=True) for x in (forth, back)])
        d_bias = d.sum(axis=(0, 2))[:, None]
        from_out = np.stack([self.weights[0].T @ d, (self.weights[1].T @ d)[::-1]], axis=1)
        d_state = np.zeros((2, h, columns), np.float32)
        d_hidden, d_shift = np.zeros_like(self.hidden), np.zeros_like(self.shift)
        at_input = np.empty((steps, 2, 3 * h, columns), np.float32)
        for s in reversed(range(steps)):
            before, z, r, q, n = kept[s]
            d_state = d_state + from_out[s]
            d_n = d_state * (1 - z) * (1 - n * n)
            d_z = d_state * (before - n) * z * (1 - z)
            d_q = d_n * r
            d_r = d_n * q * r * (1 - r)
            at_input[s] = np.concatenate([d_z, d_r, d_n], axis=1)
            gates = np.concatenate([d_z, d_r, d_q], axis=1)
            d_hidden += gates @ before.transpose(0, 2, 1)
            d_shift += d_q.sum(axis=2, keepdims=True)
            d_state = d_state * z + self.hidden.transpose(0, 2, 1) @ gates
        d_inputs = np.zeros_like(self.inputs)
        for way in (0, 1):
            flat = ways[:, way].ravel()
            order = np.argsort(flat, kind="stable")
            found, first = np.unique(flat[order], return_index=True)
            d_inputs[way][:, found] = np.add.reduceat(at_input[:, way].transpose(1, 0, 2).reshape(3 * h, -1)[:, order], first, axis=1)
        return loss, [d_inputs, d_hidden, d_shift, d_weights, d_bias]

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the mean over all bytes; zeros for an empty text."""
        sums = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum(sizes) - sizes
        per = -(-sizes // STEPS)
        owner = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        # the last segment of a text ends with it and counts only what those before it have not
        start = np.minimum(nth * STEPS, np.maximum(0, sizes[owner] - STEPS))
        skip, end = nth * STEPS - start, np.minimum(STEPS, sizes[owner])
        step = np.arange(STEPS)[:, None]
        for low in range(0, len(owner), COLUMNS):
            part = slice(low, low + COLUMNS)
            at = (begins[owner[part]] + start[part])[None, :] + step
            symbols = data[np.minimum(at, len(data) - 1)].astype(np.intp)
            symbols[step >= end[part]] = PAD
            with np.errstate(over="ignore"):
                p = self.logits(symbols)
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(axis=1, keepdims=True)
            if (uneven := np.flatnonzero((skip[part] > 0) | (end[part] < STEPS))).size:
                p[:, :, uneven] *= ((step >= skip[part][uneven]) & (step < end[part][uneven]))[:, None, :]
            np.add.at(sums, owner[part], p.sum(axis=0, dtype=np.float64).T)
        return sums / np.maximum(1, sizes)[:, None]


def train(windows: list[bytes], target: np.ndarray, languages: list[str], *, batches: int = BATCHES, batch: int = BATCH, units: int = HIDDEN, seed: int = SEED, rate: float = 0.02) -> Network:
    """A network fitted by Adam; a batch has as many windows of each language, and some of them are cut short so that short texts are learned too."""
    net = Network.fresh(languages, units, seed)
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    symbols = np.full((len(windows), STEPS), PAD, np.intp)
    sizes = np.array([min(len(w), STEPS) for w in windows])
    for i, w in enumerate(windows):
        symbols[i, : sizes[i]] = np.frombuffer(w[:STEPS], np.uint8)
    of = [np.flatnonzero(target == k) for k in range(len(languages))]
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    each = max(1, batch // len(languages))
    for t in range(1, batches + 1):
        pick = np.concatenate([rng.choice(x, each) for x in of])
        size = np.where(rng.random(len(pick)) < 0.4, rng.integers(1, STEPS + 1, len(pick)), STEPS)
        size = np.minimum(size, sizes[pick])
        inside = np.arange(STEPS)[:, None] < size
        _, grads = net.gradients(np.where(inside, symbols[pick].T, PAD), target[pick], inside.astype(np.float32))
        scale = min(1.0, 1.0 / max(1e-9, float(np.sqrt(sum((g.astype(float) ** 2).sum() for g in grads)))))
        step = rate * (1 - 0.9 * t / batches)
        for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            g = g * np.float32(scale)
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            p -= np.float32(step) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.99**t)) + np.float32(1e-6))
    return net


def _fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def sample_windows(docs: DataFrame, *, rows: int = SAMPLE_DOCS) -> tuple[list[bytes], list[str]]:
    """Windows and languages of at most ``rows`` documents of each language, by the hash of their id; held-out ones are no part of it.

    What the driver holds is WINDOWS * STEPS bytes for each of them.
    """
    known = docs.select(F.col("doc_id").alias("_id"), F.col("lang").cast("string").alias("_lang"), F.col("text").alias("_text")).filter("_lang IS NOT NULL AND _text <> ''").filter(_fold(F.col("_id")) != 1)
    place = F.pmod(F.xxhash64(F.lit(1), F.col("_id").cast("string")), F.lit(1 << 20))
    counts = known.groupBy("_lang").agg(F.count("*").alias("_n"))
    near = known.join(F.broadcast(counts), "_lang").filter(place * F.col("_n") < F.lit(2 * rows << 20))  # twice the share, then exactly the first
    first = Window.partitionBy("_lang").orderBy(place, F.col("_id").cast("string"), F.xxhash64("_text"))
    picked = near.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= rows).select("_lang", "_k", text_bytes("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = max(0, len(text) - STEPS)
                out += [(lang, k, i, text[last * i // max(1, WINDOWS - 1) :][:STEPS]) for i in range(min(WINDOWS, 1 + last // 8))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["lang", "k", "i", "data"])

    found = sorted(tuple(r) for r in picked.mapInArrow(run, "lang string, k int, i int, data binary").collect())
    return [bytes(r[3]) for r in found], [r[0] for r in found]


def fitted(docs: DataFrame, *, rows: int = SAMPLE_DOCS, batches: int = BATCHES) -> Network:
    windows, names = sample_windows(docs, rows=rows)
    languages = sorted(set(names))
    return train(windows, np.array([languages.index(x) for x in names], np.int64), languages, batches=batches)


def with_language(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``: the language of the highest mean probability, and that.

    A text that is null or has no letter is ``und`` with score 0, as is every text where
    nothing was learned; with one language learned it is that one's with score 1. Only ``text``
    is read, save for the training, which also reads ``lang`` and leaves out held-out rows
    and null ids; a null id's held_out is null. Repeated rows get equal results; the
    languages are few enough for the driver. Other columns are ignored.
    """
    network = network or fitted(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column(1).to_numpy(zero_copy_only=False)
            texts = [x.as_py() if ok else b"" for x, ok in zip(batch.column(2), told, strict=True)]
            if network.languages:
                p = network.document_probabilities(texts)
                names = [network.languages[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), told, strict=True)]
                scores = np.clip(np.where(told, p.max(axis=1), 0), 0, 1)
            else:
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("told")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", letters, text_bytes()).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", (_fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_language(table(spark, sf_dir, "documents"))
