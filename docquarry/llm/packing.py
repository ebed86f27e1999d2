"""Best-fit packing of tokenised documents into sequences of bounded length (operator 1).

Tokenising is a map over blocks: each distinct piece of a block is merged once and its ids are
gathered for all its places. Only the extents of the pieces (id, start, length, checksum) are
shuffled, by a hash of the id, so no source or copy group makes a hot task. Each partition then
runs a bounded-space online best-fit: windows of rows arrive by falling length, a fixed number of
bins is open, a bitset keyed by free space finds the tightest bin that fits, and when all bins are
open the fullest closes first. Memory is one window, bounded in rows and bytes, plus the open bins.

Ids are those of the `tokenizers` library for the file as it is loaded, without special tokens added
around a text; a text that spells an added token gets its id.

Edge cases: null text counts as empty and gives the end token alone; repeated rows and repeated ids
are packed each by itself; ties go to the smaller id and piece; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Bins that a partition keeps open.
OPEN_BINS = 65_536
#: Rows, and bytes of them, that arrive together, by falling length.
WINDOW, WINDOW_BYTES = 131_072, 32 << 20
#: Merged pieces that a Python worker remembers between blocks.
REMEMBERED = 300_000


def _alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def merger(tokenizer_file: str):
    """A function from a piece's bytes to its ids, by the vocabulary of a `tokenizers` file."""
    import tiktoken
    from tokenizers import Tokenizer

    of = _alphabet()
    vocabulary = Tokenizer.from_file(tokenizer_file).get_vocab(with_added_tokens=False)
    special = {t.content for t in Tokenizer.from_file(tokenizer_file).get_added_tokens_decoder().values()}
    ranks = {bytes(of[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    whole = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return lambda piece: whole.encode_ordinary(piece.decode())


@functools.cache
def added_tokens(tokenizer_file: str) -> tuple[tuple[bytes, ...], dict[bytes, int]]:
    """The file's added tokens, longest first, and their ids."""
    with open(tokenizer_file, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens", [])
    odd = [t["content"] for t in found if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
    if odd:
        raise ValueError(f"added tokens that take their surroundings along: {odd}")
    ids = {t["content"].encode(): t["id"] for t in found}
    return tuple(sorted(ids, key=len, reverse=True)), ids


def _added(data: np.ndarray, offsets: np.ndarray, tokens: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of added tokens in the documents, the leftmost and then the longest first."""
    held = data.tobytes()
    spans: list[tuple[int, int]] = []
    if any(t in held for t in tokens):
        pattern = re.compile(b"|".join(map(re.escape, tokens)))
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            spans += [m.span() for m in pattern.finditer(held, a, b)]
    out = np.array(spans, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _pieces(data: np.ndarray, offsets: np.ndarray, tokens: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """T.pieces() of the texts between added tokens; each added token is a piece of its own."""
    starts, ends = _added(data, offsets, tokens)
    if not len(starts):
        return T.pieces(data, offsets)
    bounds, _ = T.pieces(data, np.sort(np.concatenate([offsets, starts, ends])))
    at = np.searchsorted(starts, bounds, side="right") - 1
    bounds = bounds[(at < 0) | (bounds == starts[at]) | (bounds >= ends[at])]
    return bounds, np.searchsorted(bounds, offsets)


@functools.cache
def _memory(tokenizer_file: str) -> dict[bytes, list[int]]:
    return {}


def block_ids(block: pa.Table, text_col: str, tokenizer_file: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all documents of a block, and where each document's ids begin (with the end).

    The file's added tokens are matched in the texts, as the tokenizer does when loaded.
    """
    data, offsets = T.raw(block.column(text_col))
    tokens, special = added_tokens(tokenizer_file)
    bounds, first = _pieces(data, offsets, tokens)
    words = T.binary(data, bounds).dictionary_encode()
    codes, distinct = words.indices.to_numpy(), words.dictionary.to_pylist()
    merge, memory = merger(tokenizer_file), _memory(tokenizer_file)
    found = []
    for w in distinct:
        # The pattern never cuts a piece like an added token, so such a piece is one.
        ids = [special[w]] if w in special else memory.get(w)
        if ids is None:
            ids = merge(w)
            if len(w) <= 64:
                memory[w] = ids
        found.append(ids)
    if len(memory) > REMEMBERED:
        memory.clear()
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
    n = sizes[codes]
    ids = flat[T.ragged((np.cumsum(sizes) - sizes)[codes], n)]
    return ids, np.append(0, np.cumsum(n))[first]


def _cut(id_col: str, text_col: str, tokenizer_file: str, end_id: int, capacity: int, with_ids: bool, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, text_col, block_bytes):
            ids, at = block_ids(block, text_col, tokenizer_file)
            rows = []
            parts = []
            for key, a, b in zip(block.column(id_col).to_pylist(), at[:-1], at[1:], strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                n = len(own)
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for piece, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows.append((key, piece, x, y - x, zlib.crc32(own[x:y].tobytes())))
                    if with_ids:
                        parts.append(own[x:y].astype(np.int32))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def cut_tokens(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, block_bytes: int = T.BLOCK_BYTES) -> DataFrame:
    """Tokenise whole texts, add end_id, and cut what is longer than capacity.

    Pieces are full but the first, which has the remainder. Columns: id_col, piece, start, length,
    ids_crc32 and, with with_ids, ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(
        _cut(id_col, text_col, tokenizer_file, end_id, capacity, with_ids, block_bytes),
        f"{id_col} bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids,
    )


class BestFit:
    """Bounded-space online best-fit over bins of one capacity."""

    def __init__(self, capacity: int, open_bins: int, first_id: int = 0):
        self.capacity, self.open_bins, self.next_id = capacity, open_bins, first_id
        self.mask = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin of an item, and its offset there."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            free, bin_id = self.capacity, self.next_id
            self.next_id += 1
        left = free - length
        if left:
            self.bins[left].append(bin_id)
            self.mask |= 1 << left
            self.n_open += 1
        return bin_id, self.capacity - free

    def _take(self, free: int) -> int:
        same = self.bins[free]
        bin_id = same.pop()
        if not same:
            self.mask &= ~(1 << free)
        self.n_open -= 1
        return bin_id


def _pack(id_col: str, capacity: int, open_bins: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fit = BestFit(capacity, open_bins, (context.partitionId() if context else 0) << 40)

        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = rows.sort_by([("length", "descending"), (id_col, "ascending"), ("piece", "ascending")])
            places = [fit.place(n) for n in rows.column("length").to_pylist()]
            rows = rows.append_column("sequence_id", pa.array([p[0] for p in places], pa.int64()))
            return rows.append_column("offset", pa.array([p[1] for p in places], pa.int64())).combine_chunks()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            # A slice of a batch, since one batch may be many times the window's bytes.
            rows = max(1, batch.num_rows * WINDOW_BYTES // max(batch.nbytes, WINDOW_BYTES))
            for at in range(0, batch.num_rows, rows):
                held.append(batch.slice(at, rows))
                if sum(b.num_rows for b in held) >= window or sum(b.nbytes for b in held) >= WINDOW_BYTES:
                    yield from packed(held).to_batches()
                    held = []
        if held and sum(b.num_rows for b in held):
            yield from packed(held).to_batches()

    return run


def best_fit(pieces: DataFrame, capacity: int = 2048, open_bins: int = OPEN_BINS, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces (id_col, piece, length, ...) of capacity at most.

    Partitions pack alone, so their number costs at most some part-filled sequences each; adaptive
    execution joins small ones.
    """
    schema = T.wider(pieces.schema, sequence_id="long", offset="long")
    dealt = pieces.repartition(F.xxhash64(id_col, "piece")).sortWithinPartitions(id_col, "piece")
    return dealt.mapInArrow(_pack(id_col, capacity, open_bins, window), schema)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, **options) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and offset."""
    return best_fit(cut_tokens(docs, tokenizer_file, capacity, **options), capacity, id_col=options.get("id_col", "doc_id"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, n_pieces, ids."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence is bounded by its capacity
    return packed.groupBy("sequence_id").agg(inside.alias("held")).select("sequence_id", F.size("held").alias("n_pieces"), F.flatten("held.ids").alias("ids"))
