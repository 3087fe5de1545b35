"""Vector expressions over array columns, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; a missing element counts as zero."""
    product = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """Cosine similarity, 0 where a norm is zero. Norms can be given when they are stored beside the vectors."""
    size = (norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def hash_embedding(text: Column, dimensions: int = 1536) -> Column:
    """A deterministic stand-in for an embedding: big-endian 32-bit words of SHA-256 over "text:block", scaled to [-1, 1]."""
    blocks = -(-dimensions // 8)
    digests = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.sha2(F.concat_ws(":", F.coalesce(text, F.lit("")), b.cast("string")), 256))
    words = F.flatten(F.transform(digests, lambda d: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(d, i * 8 + 1, F.lit(8)), 16, 10).cast("double"))))
    return F.slice(F.transform(words, lambda w: w / 4294967295.0 * 2.0 - 1.0), 1, dimensions)


def embedding_udf(setup: Callable[[], Callable[[list[str]], list]], *, batch: int = 64) -> Callable[[Column], Column]:
    """A function of a text column that embeds it by a model: ``setup`` runs once in each worker and gives what embeds a list of at most ``batch`` texts.

    A null text has no embedding; a batch of nulls alone does not reach the model.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = setup()
        for part in parts:
            out: list = [None] * len(part)
            live = [i for i, t in enumerate(part) if t is not None]
            for low in range(0, len(live), batch):
                own = live[low : low + batch]
                for i, v in zip(own, embed([part.iloc[i] for i in own]), strict=True):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}  # which tell Spark the kind of function
    return F.pandas_udf(run, "array<double>")
