"""Byte-level BPE encoding and decoding (operator 4).

Texts are cut into pieces by the tokenizer's pattern, block by block, and each block keeps its
distinct pieces once. Spark's higher-order functions then fold the ranked merges over the byte arrays
of those distinct pieces (each byte as the id of its token): `aggregate` carries the parts of a piece
with the merge rank of every neighbouring pair, merges the lowest rank, and looks up only the two new
pairs. The rank map is a literal: sparse rows of right ids by left id, laid over each other in one
array, so a lookup is two array reads. Decoding concatenates the binary pieces of the ids.

No row leaves its partition: there is no shuffle, and memory is bounded by a block (a longer document
is a block of its own), whose pieces travel in rows of ROW_WORDS. Pieces longer than FOLD_BYTES, for
which a fold would be quadratic, are merged by a heap instead, with the same result.

Edge cases: null text counts as empty; empty text has no tokens; repeated rows are encoded each by
itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Longest piece, in bytes, that is folded by higher-order functions.
FOLD_BYTES = 160
#: Distinct pieces in a row of the fold.
ROW_WORDS = 8192
_EMPTY = 1 << 36


@functools.cache
def read_ranks(path: str) -> tuple[bytes, ...]:
    """Tokens of a .tiktoken file by rank."""
    with open(path, "rb") as f:
        found = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return tuple(found[i] for i in range(len(found)))


@functools.cache
def pair_table(tokens: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The rank map by rows: slots[(base[left] + right) mod size] is left * 65536 + merged id.

    Every split of a token into two tokens is a pair. The sparse rows of all left ids are laid
    over each other in one array, each at a shift where its entries find free slots; a slot of
    another row shows by its left id.
    """
    ranks = {t: i for i, t in enumerate(tokens)}
    if len(tokens) > 65536:
        raise ValueError("the slots hold ids of 16 bits")
    rows: dict[int, dict[int, int]] = {}
    for t, i in ranks.items():
        for cut in range(1, len(t)):
            a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
            if a is not None and b is not None:
                rows.setdefault(a, {})[b] = i
    size = 1 << max(12, (4 * sum(map(len, rows.values()))).bit_length())
    slots = np.full(size, _EMPTY, np.int64)
    base = np.zeros(len(tokens), np.int64)
    shifts = np.random.default_rng(0)
    for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        rights = np.fromiter(row, np.int64)
        tries = 4
        while True:
            at = shifts.integers(0, size, tries)
            fits = (slots[(at[:, None] + rights) & (size - 1)] == _EMPTY).all(axis=1)
            if fits.any():
                break
            tries = min(2 * tries, 512)
        base[a] = at[int(fits.argmax())]
        slots[(base[a] + rights) & (size - 1)] = a * 65536 + np.fromiter(row.values(), np.int64)
    return base, slots


def _literal(values, kind: str) -> str:
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


@functools.cache
def merge_expression(words: str, tokens: tuple[bytes, ...]) -> str:
    """SQL that turns `words`, arrays of the ids of single bytes, into arrays of merged ids.

    While it folds, a part of a word is one number: the rank of the pair that it begins, its
    place, and its token id (at bits 24, 16 and 0), so that the least number is the next merge.
    Words have 256 bytes at most.
    """
    base, slots = pair_table(tokens)
    none = f"{1 << 61}L"

    def rank(a: str, b: str) -> str:
        """The rank of a pair of ids, at its bits; a slot of another row gives a rank that is too high."""
        return f"shiftleft(slots[(base[{a}] + {b}) & {len(slots) - 1}] ^ shiftleft(cast({a} as bigint), 16), 24)"

    new, right, left = "cast(shiftright(m, 24) as int)", "cast(a[p + 1] & 65535L as int)", "cast(a[p - 2] & 65535L as int)"
    joined = f"(if(p + 1 < size(a), {rank(new, right)}, {none}) | (m & 16711680L) | shiftright(m, 24))"
    before = f"({rank(left, new)} | (a[p - 2] & 16777215L))"
    rebuilt = f"transform(slice(a, 1, greatest(size(a) - 1, 0)), (x, i) -> if(i >= p, a[i + 1], if(i < p - 2, x, if(i = p - 1, {joined}, {before}))))"
    step = f"transform(array(coalesce(array_min(a), {none})), m -> if(m >= {65536 << 24}L, a, transform(array(1 + size(filter(a, x -> (x & 16711680L) < (m & 16711680L)))), p -> {rebuilt})[0]))[0]"
    start = f"transform(w, (b, i) -> if(i + 1 < size(w), {rank('b', 'w[i + 1]')}, {none}) | shiftleft(cast(i as bigint), 16) | cast(b as bigint))"
    fold = f"aggregate(sequence(1, greatest(size(w) - 1, 1)), {start}, (a, k) -> {step}, a -> transform(a, x -> cast(x & 65535L as int)))"
    # The literals are bound once, as lambda variables, so that the plan holds one copy of each.
    return f"transform(array({_literal(base, 'int')}), base -> transform(array({_literal(slots, 'bigint')}), slots -> transform({words}, w -> {fold}))[0])[0]"


def merge_long(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ranked merges of one long piece by a heap over a linked list: O(n log n)."""
    part: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    right = list(range(1, len(part) + 1))
    left = list(range(-1, len(part) - 1))
    heap: list[tuple[int, int, bytes, bytes]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < len(part) and len(part[i]) + len(part[j]) <= longest:
            r = ranks.get(part[i] + part[j])
            if r is not None:
                heapq.heappush(heap, (r, i, part[i], part[j]))

    for i in range(len(part) - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if part[i] != a or j >= len(part) or part[j] != b:
            continue
        part[i], part[j] = a + b, None
        right[i] = right[j]
        if right[j] < len(part):
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [ranks[p] for p in part if p is not None]


def _blocks(id_col: str, text_col: str, tokens: tuple[bytes, ...], block_bytes: int):
    ranks = {t: i for i, t in enumerate(tokens)}
    longest = max(map(len, tokens))
    one = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def flush(held) -> Iterator[pa.RecordBatch]:
        words = pa.chunked_array([w for _, _, w in held]).unify_dictionaries()
        distinct = words.chunk(0).dictionary
        _, at, flat = distinct.buffers() if len(distinct) else (None, bytes(8), b"")
        at = np.frombuffer(at, np.int64)[: len(distinct) + 1]
        flat = np.frombuffer(flat, np.uint8)
        sizes = np.diff(at)
        for i in range(0, len(distinct), ROW_WORDS):
            own = np.arange(i, min(i + ROW_WORDS, len(distinct)))
            short = sizes[own] <= FOLD_BYTES
            n = np.where(short, sizes[own], 0)
            values = one[flat[T.ragged(at[own], n)]]
            folded = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), values)
            long = [merge_long(flat[at[j] : at[j + 1]].tobytes(), ranks, longest) for j in own[~short]]
            yield row(None, None, None, folded, long, i == 0)
        for (keys, first, _), codes in zip(held, words.chunks, strict=True):
            yield row(keys, first, codes.indices.to_numpy(), None, None, False)

    def row(keys, first, codes, words, long, begins) -> pa.RecordBatch:
        wrap = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(1, pa.list_(pa.int64())) if keys is None else wrap(keys),
                pa.array([None if keys is None else first.tobytes()], pa.binary()),
                pa.array([None if keys is None else codes.astype(np.int32).tobytes()], pa.binary()),
                pa.nulls(1, pa.list_(pa.list_(pa.int32()))) if words is None else wrap(words),
                pa.array([long], pa.list_(pa.list_(pa.int32()))),
                pa.array([begins], pa.bool_()),
            ],
            ["ids_of_docs", "first", "codes", "words", "long", "begins"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in T.slices(batch, text_col, 1 << 20):
                data, offsets = T.raw(part.column(text_col))
                bounds, first = T.pieces(data, offsets)
                held.append((part.column(id_col).cast(pa.int64()), first.astype(np.int64), T.binary(data, bounds).dictionary_encode()))
                size += len(data)
                if size >= block_bytes:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _documents(id_col: str, tokens: tuple[bytes, ...], with_ids: bool):
    lengths = np.array([len(t) for t in tokens], np.int64)
    starts = np.cumsum(lengths) - lengths
    vocabulary = np.frombuffer(b"".join(tokens), np.uint8)

    def merged(column: pa.Array, long: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of a row's words; the empty ones are the long ones, in order."""
        inner = column.flatten()
        sizes = inner.value_lengths().to_numpy().astype(np.int64)
        flat = inner.flatten().to_numpy().astype(np.int32)
        empty = np.flatnonzero(sizes == 0)
        if len(empty):
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for i, ids in zip(empty, long.flatten().to_pylist(), strict=True):
                parts[i] = np.array(ids, np.int32)
            sizes, flat = np.array([len(x) for x in parts], np.int64), np.concatenate(parts)
        return flat, sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        block = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column("tokens")[0].is_valid:
                    if row.column("begins")[0].as_py():
                        parts, block = [], None
                    parts.append(merged(row.column("tokens"), row.column("long")))
                    continue
                if block is None:
                    token = np.concatenate([np.zeros(0, np.int32), *(p[0] for p in parts)])
                    sizes = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
                    block = (token, sizes, np.cumsum(sizes) - sizes)
                token, sizes, starts_of = block
                first = np.frombuffer(row.column("first")[0].as_py(), np.int64)
                codes = np.frombuffer(row.column("codes")[0].as_py(), np.int32)
                count, id_hash, text_hash, lists = [], [], [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    own = codes[a:b]
                    own = token[T.ragged(starts_of[own], sizes[own])]
                    size = lengths[own]
                    decoded = vocabulary[T.ragged(starts[own], size)].tobytes()
                    count.append(len(own))
                    id_hash.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    text_hash.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        lists.append(own)
                columns = [row.column("ids_of_docs").flatten(), pa.array(count, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, block_bytes: int = 16 << 20) -> DataFrame:
    """Encode every whole text, and decode the ids again.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 (lowercase hex, of the ids as
    little-endian unsigned 32-bit integers and of the decoded bytes) and, with with_ids, ids.
    """
    tokens = read_ranks(rank_file)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    held = rows.mapInArrow(
        _blocks(id_col, text_col, tokens, block_bytes),
        "ids_of_docs array<bigint>, first binary, codes binary, words array<array<int>>, long array<array<int>>, begins boolean",
    )
    folded = F.when(F.col("words").isNotNull(), F.expr(merge_expression("words", tokens)))
    merged = held.select("ids_of_docs", "first", "codes", "long", "begins", folded.alias("tokens"))
    return merged.mapInArrow(_documents(id_col, tokens, with_ids), f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(tokens_of_rows: DataFrame, rank_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes of an array of ids: the binary pieces, concatenated. Null ids give null."""
    pieces = _literal([t.hex() for t in read_ranks(rank_file)], "string")
    joined = f"unhex(array_join(element_at(transform(array({pieces}), v -> transform({ids_col}, i -> v[i])), 1), ''))"
    return tokens_of_rows.withColumn(out_col, F.expr(joined))
