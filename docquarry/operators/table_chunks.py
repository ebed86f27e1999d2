"""Chunking of plain text that keeps tables whole.

Built-in functions give no match offsets, so tables are found in Python, by Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The three table patterns, how far paragraph borders are sought, and the kinds.
MARKDOWN = re.compile(r"\|[^\n]+\|[\n\r]+\|[-\s|]+\|[\n\r]+(?:\|[^\n]+\|[\n\r]+)+")
LINES = re.compile(r"(?:^.{10,}[\n\r]+){3,}", re.MULTILINE)
MARKED = re.compile(r"\[Table with \d+ rows x \d+ columns\].*?(?=\n\n|\Z)", re.DOTALL)
LOOK = 200


def looks_aligned(text: str) -> bool:
    """Whether the first five lines share the starts of at least two runs of blanks."""
    lines = text.split("\n")
    if len(lines) < 3:
        return False
    shared = set.intersection(*({m.start() for m in re.finditer(r"\s{2,}", line)} for line in lines[:5]))
    return len(shared) >= 2


def table_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the tables in a text, merged where they overlap or touch."""
    found = [(m.start(), m.end(), "markdown") for m in MARKDOWN.finditer(text)]
    found += [(m.start(), m.end(), "ascii") for m in LINES.finditer(text) if looks_aligned(m[0])]
    found += [(m.start(), m.end(), "extracted") for m in MARKED.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(found, key=lambda x: x[0]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2])
        else:
            out.append((start, end, kind))
    return out


def pack(text: str, offset: int, size: int, overlap: int) -> list[tuple[int, str]]:
    """Paragraphs of a segment packed into chunks: (offset of the first paragraph, text).

    A chunk closes when the next paragraph would pass `size`; its longest suffix of paragraphs with
    `overlap` characters at most opens the next.
    """
    parts, at = [], 0
    for piece in re.split(r"(\n\s*\n)", text):
        if piece.strip():
            parts.append((offset + at + len(piece) - len(piece.lstrip()), piece.strip()))
        at += len(piece)
    out, held = [], []
    for part in parts:
        if held and sum(len(p) for _, p in held) + len(part[1]) > size:
            out.append(held)
            kept = []
            while held and sum(len(p) for _, p in kept) + len(held[-1][1]) <= overlap:
                kept.insert(0, held[-1])
                held = held[:-1]
            held = kept
        held = [*held, part]
    if held:
        out.append(held)
    return [(h[0][0], "\n\n".join(p for _, p in h)) for h in out]


def align(text: str, at: int, forward: bool) -> int:
    """The end of the next paragraph (forward) or the start of the one around `at`, within LOOK characters."""
    if forward:
        border = text.find("\n\n", at, at + LOOK)
        return at if border < 0 else border + 2
    border = text.rfind("\n\n", max(0, at - LOOK), at)
    return at if border < 0 else border + 2


def chunk(text: str, size: int = 1000, overlap: int = 200) -> list[tuple[int, str, str | None]]:
    """(offset, text, kind of table or None) of all chunks, in order; no table is ever split.

    A table under `size` gets context: whole paragraphs of `overlap` characters at most before, and
    half the room left after it. A larger one is a chunk of its own.
    """
    spans, out, at = table_spans(text), [], 0
    for i, (start, end, kind) in enumerate(spans):
        out += [(o, t, None) for o, t in pack(text[at:start], at, size, overlap)]
        if end - start >= size:
            out.append((start, text[start:end].strip("\n"), kind))
            at = end
            continue
        before = align(text, max(at, start - overlap), True)
        before = before if before <= start else start
        limit = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        after = align(text, min(limit, end + (size - (end - start)) // 2), False)
        after = min(max(after, end), limit)
        out.append((before, text[before:after].strip("\n"), kind))
        at = after
    return out + [(o, t, None) for o, t in pack(text[at:], at, size, overlap)]


def chunk_texts(docs: DataFrame, size: int = 1000, overlap: int = 200, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_col, chunk_index, start, chunk_text, has_table, table_type. Null texts give no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(key, i, *c) for i, c in enumerate(chunk(text or "", size, overlap))]
            kinds = (batch.schema.field("key").type, pa.int32(), pa.int32(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["key", "chunk_index", "start", "chunk_text", "table_type"])

    rows = docs.select(F.col(doc_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, chunk_index int, start int, chunk_text string, table_type string")
    return out.select(F.col("key").alias(doc_col), "chunk_index", "start", "chunk_text", F.col("table_type").isNotNull().alias("has_table"), "table_type")
