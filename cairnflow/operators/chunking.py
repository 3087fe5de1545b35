"""Chunkers: a text to ordered chunks, a small Python rule a row under Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the header of a section.
SECTION = r"^(?:Section|Article|Chapter|\d+\.)\s"
SCHEMA = "doc_id long, chunk_index int, chunk_type string, parent_index int, content string"
#: Characters of chunks that a task holds before it sends them on.
HELD = 1 << 20
#: (content, type, index of the parent)
Chunk = tuple[str, str, int | None]


def fixed_chunks(text: str, *, size: int = 512, overlap: int = 50, least_overlap: int = 0) -> Iterator[Chunk]:
    """Whole words up to ``size`` characters, one word at least; the next chunk steps back overlap // 5 words."""
    words = text.split()
    back = max(1, overlap // 5) if overlap > 0 else least_overlap
    first = 0
    while first < len(words):
        last, length = first + 1, len(words[first])
        while last < len(words) and length + 1 + len(words[last]) <= size:
            length += 1 + len(words[last])
            last += 1
        yield " ".join(words[first:last]), "standalone", None
        if last == len(words):
            return
        first += max(1, last - first - back)


def _pieces(text: str, pattern: str) -> list[str]:
    return [p.strip() for p in re.split(pattern, text) if p.strip()]


def semantic_chunks(text: str, embed: Callable[[list[str]], list], *, threshold: float = 0.5, least: int = 100, most: int = 2000) -> Iterator[Chunk]:
    """Sentences together while neighbours are alike; short groups join the one before when both fit."""
    import numpy as np

    own = _pieces(text, r"(?<=[.!?])\s+")
    if not own:
        return
    vectors = np.asarray(embed(own), float) if len(own) > 1 else np.zeros((1, 1))
    size = np.linalg.norm(vectors, axis=1)
    near = (vectors[1:] * vectors[:-1]).sum(axis=1) / np.where(size[1:] * size[:-1] > 0, size[1:] * size[:-1], np.inf)
    groups = [own[0]]
    for sentence, alike in zip(own[1:], near, strict=True):
        if alike < threshold or len(groups[-1]) + 1 + len(sentence) > most:
            groups.append(sentence)
        else:
            groups[-1] += " " + sentence
    merged: list[str] = []
    for group in groups:
        if merged and len(group) < least and len(merged[-1]) + 1 + len(group) <= most:
            merged[-1] += " " + group
        else:
            merged.append(group)
    yield from ((m, "standalone", None) for m in merged)


def sections(text: str, pattern: str = SECTION, *, keep_preamble: bool = False) -> list[tuple[str, str]]:
    """(header line, body) from each header on; a text without headers is one section. What comes before the first is dropped unless kept."""
    heads = [m.start() for m in re.finditer(pattern, text, re.MULTILINE)]
    if not heads:
        return [("", text)]
    out = [("", text[: heads[0]].strip())] if keep_preamble and text[: heads[0]].strip() else []
    for low, high in zip(heads, [*heads[1:], len(text)], strict=True):
        header, _, body = text[low:high].partition("\n")
        out.append((header.strip(), body.strip()))
    return out


def _paragraphs(text: str) -> list[str]:
    return _pieces(text, r"\n\s*\n" if re.search(r"\n\s*\n", text) else "\n")


def _grown(paragraphs: list[str], least: int) -> list[str]:
    """Paragraphs of ``least`` characters or more: short ones go to the one before, a short first or last one to its neighbour."""
    out: list[str] = []
    for p in paragraphs:
        if out and (len(p) < least or len(out[-1]) < least and len(out) == 1):
            out[-1] += "\n" + p
        else:
            out.append(p)
    return out


def _parts(text: str, header: str, most: int) -> list[tuple[str, str]]:
    """(text, header) of a section, in numbered parts when it is over ``most``."""
    if len(text) <= most:
        return [(text, header)]
    groups: list[list[str]] = [[]]
    size = 0
    for p in _paragraphs(text):
        if groups[-1] and size + len(p) + 1 > most:
            groups.append([])
            size = 0
        size += len(p) + 1
        groups[-1].append(p)
    many = len(groups) > 1
    return [("\n".join(g), f"{header} (part {i})" if header and many else header) for i, g in enumerate(groups, 1)]


def parent_child_chunks(text: str, *, pattern: str = SECTION, least: int = 50, most: int = 5000, keep_preamble: bool = False) -> Iterator[Chunk]:
    """Each section as a parent, followed by its paragraphs as children."""
    n = 0
    for header, body in sections(text, pattern, keep_preamble=keep_preamble):
        for parent, head in _parts(f"{header}\n{body}".strip(), header, most):
            yield parent, "parent", None
            at, inner = n, parent[len(head) :].strip() if head and parent.startswith(head) else parent
            n += 1
            for child in _grown(_paragraphs(inner), least):
                yield child, "child", at
                n += 1


STRATEGIES: dict[str, Callable[..., Iterator[Chunk]]] = {"fixed_size": fixed_chunks, "semantic": semantic_chunks, "parent_child": parent_child_chunks}


def chunked(docs: DataFrame, strategy: str = "fixed_size", *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """(doc_id, chunk_index, chunk_type, parent_index, content) of every text, and the columns ``keep`` of its row; null and blank texts have no chunks.

    What is kept travels with the text, so a chunk has its own row's facts whatever the partitioning and however often ids repeat.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is not one of {sorted(STRATEGIES)}")
    rule = STRATEGIES[strategy]
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def sent(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, *columns = zip(*rows, strict=True)
        at = pa.array(at, pa.int64())
        parts = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), *parts, *(c.take(at) for c in batch.columns[2:])], names=["doc_id", "chunk_index", "chunk_type", "parent_index", "content", *keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for n, t in enumerate(batch.column(1)):
                text = t.as_py()
                for i, (body, kind, parent) in enumerate(rule(text, **options) if text and text.strip() else ()):
                    rows.append((n, i, kind, parent, body))
                    size += len(body)
                    if size >= HELD or len(rows) >= HELD // 64:
                        yield sent(batch, rows)
                        rows, size = [], 0
            if rows:
                yield sent(batch, rows)

    return docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).alias("_t"), *keep).mapInArrow(run, ", ".join([SCHEMA, *kept]))


def parent_clearance(chunks: DataFrame) -> DataFrame:
    """Parents take the highest clearance of their children."""
    highest = chunks.filter("chunk_type = 'child'").groupBy("doc_id", F.col("parent_index").alias("chunk_index")).agg(F.max("clearance_level").alias("_c"))
    return chunks.join(highest, ["doc_id", "chunk_index"], "left").withColumn("clearance_level", F.coalesce("_c", "clearance_level")).drop("_c")


def ingested(docs: DataFrame, *, strategy: str = "fixed_size", embed: Callable | None = None, id_col: str = "document_id", **options) -> DataFrame:
    """Rows of the search index for documents (document_id, text, department_id, clearance_level, source_file).

    Texts are chunked; each chunk has its number, its text, the document's security fields, a
    dense vector if ``embed`` (a column to a column) is given, and its terms with their
    counts. An empty text has no chunks.
    """
    from ..functions.text import tokens

    named = docs.select(F.lit(0).alias("_none"), "text", F.col(id_col).alias("_id"), F.col("department_id").alias("_department"), F.col("clearance_level").alias("_clearance"), F.col("source_file").alias("_source"))
    rows = chunked(named, strategy, id_col="_none", keep=("_id", "_department", "_clearance", "_source"), **options)
    rows = rows.drop("doc_id").withColumnsRenamed({"_id": id_col, "_department": "department_id", "_clearance": "clearance_level", "_source": "source_file"})
    words = tokens(F.col("content"))
    terms = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(words)), lambda t: F.struct(t, F.size(F.filter(words, lambda w: w == t)))))
    dense = [] if embed is None else [embed(F.col("content")).alias("dense")]
    return rows.select(F.concat_ws(":", id_col, "chunk_index").alias("id"), "content", id_col, "department_id", "clearance_level", "source_file", "chunk_index", *dense, terms.alias("sparse"))
