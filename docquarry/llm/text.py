"""Vectorised text primitives over Arrow batches: words, their hashes, and tokenizer pieces.

All functions work on whole texts. A block is the UTF-8 bytes of many documents laid end to end
with the offsets of each document.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StructType

U64 = np.uint64
#: Bytes of text that one block gathers at most (a single longer document is a block of its own).
BLOCK_BYTES = 8 << 20


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `most` bytes of text each."""
    _, offsets = raw(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Regroup a partition's batches into blocks of about `most` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, text, most):
            n = part.column(text).nbytes
            if held and size + n > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the words: start and end byte of each, and the index of each document's first word.

    A word is a run of bytes outside [\\x20\\x09-\\x0D], or of bytes with keep[byte] where that is
    given; it never crosses documents.
    """
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:n]) if keep is None else np.take(keep, data, out=inside[:n])
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside[:n]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first = inside & ~before
    first[cuts] = inside[cuts]
    last = before & ~inside
    last[cuts] |= before[cuts]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64), elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_POWERS = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 1024), 0x9E3779B97F4A7C15, U64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


#: Bytes of words that are hashed together, which fit a processor's cache.
_HASHED = 1 << 18


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span (spans in order, not overlapping, none empty)."""
    if not len(starts):
        return np.zeros(0, U64)
    table = _table(seed)
    if lower:
        table = table[_LOWER]
    lengths = ends - starts
    after = np.cumsum(lengths)
    powers = _powers(int(lengths.max()) + 1)
    out = np.empty(len(starts), U64)
    a = 0
    while a < len(starts):
        done = int(after[a] - lengths[a])
        b = max(a + 1, int(np.searchsorted(after, done + _HASHED, side="right")))
        size = lengths[a:b]
        first = after[a:b] - size - done
        inner = np.arange(int(after[b - 1]) - done, dtype=np.int64)
        inner -= np.repeat(first, size)
        values = table[data[inner + np.repeat(starts[a:b], size)]]
        values *= powers[inner]
        np.add.reduceat(values, first, out=out[a:b])
        a = b
    return mix(out + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


def grams(hashes: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hashes of every run of k consecutive items; ignores document borders (callers mask those)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, seed, U64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * U64(0xFF51AFD7ED558CCD)
        out ^= out >> U64(32)
    return mix(out)


# --- pieces of the byte-level BPE pattern -------------------------------------------------------

_CLASSES: np.ndarray | None = None
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values of the public pattern


def _classes() -> np.ndarray:
    """By code point: 0 other, 1 letter, 2 number, 3 white space (as in public_tokenizers.PATTERN)."""
    global _CLASSES
    if _CLASSES is None:
        import regex

        table = np.zeros(sys.maxunicode + 1, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
        points = np.frombuffer(every.encode("utf-32-le"), np.uint32)
        for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[points[m.start() : m.end()]] = value
        _CLASSES = table
    return _CLASSES


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split every document by public_tokenizers.PATTERN.

    Returns the byte offsets of all pieces (with the end) and, for each document, the index of
    its first piece (with the end). Pieces cover the texts without gaps.
    """
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    lead = (data & 0xC0) != 0x80
    if lead.all():
        points, at = data, None
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.append(np.flatnonzero(lead), len(data))
    kind = _classes()[points]
    n = len(points)
    docs = offsets if at is None else np.searchsorted(at, offsets)
    edge = np.zeros(n + 1, bool)
    edge[docs] = True
    edge[n] = True
    cut = edge.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    # A white-space run gives its last character away if a non-space of the same text follows.
    space = kind == 3
    gives = np.zeros(n, bool)
    gives[:-1] = space[:-1] & ~space[1:]
    gives &= ~edge[1:]
    g = np.flatnonzero(gives)
    cut[g] = True
    joins = g[points[g] == 32]
    cut[joins + 1] = False
    # A lone apostrophe that starts a match takes 's, 't, 're, 've, 'm, 'll or 'd along.
    a = np.flatnonzero((points == 39) & cut[:n])
    if len(a):
        for tail in _CONTRACTIONS:
            fits = a[a + len(tail) < n]
            ok = np.ones(len(fits), bool)
            for i, c in enumerate(tail, 1):
                ok &= (points[fits + i] == ord(c)) & ~edge[fits + i]
            fits = fits[ok]
            cut[fits + 1] = False
            cut[fits + 1 + len(tail)] = True
    bounds = np.flatnonzero(cut)
    first = np.searchsorted(bounds, docs)
    return (bounds if at is None else at[bounds]).astype(np.int64), first


def binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The byte strings between consecutive bounds as an Arrow array, without copying."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def wider(schema: StructType, **fields: str) -> StructType:
    """A copy of a schema with more fields (a DataFrame's own schema object must not change)."""
    out = StructType(list(schema.fields))
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out
