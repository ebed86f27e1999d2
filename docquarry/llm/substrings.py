"""Substring deduplication on a compacted de Bruijn graph (operator 10).

The edges of the graph are the token k-mers: all windows of 13 consecutive words. An edge repeats if
its words also start in a document with a smaller id; every word that a repeated edge covers goes.
Shuffling each edge alone would move several times the corpus, so paths are compacted first:

1. Compact. Each window has an anchor, the least-hashed 5-word gram in it. Consecutive windows with
   the same anchor are a nonbranching path piece and travel as one row: hash of the anchor, hash of
   the whole piece, document and place. Equal windows have equal anchors, so an edge never leaves its
   anchor's group. Pieces that a smaller document of the same block has are decided at once, before
   the shuffle, so a group of copies sends no more than one piece a block.
2. Join by anchor. Rows are dealt by anchor and streamed in order (anchor, piece, document): all but
   the smallest document of a piece are repeats as a whole. If an anchor has two or more distinct
   pieces, the graph branches there, and the pieces' first documents go on to step 3. A block that has
   many pieces of one anchor knows that it branches: it sends them to step 3 by their own places, and
   one mark to the anchor's group. So a hot anchor is spread, and a group gets a bounded number of rows a block.
3. Branches. The windows of those pieces are hashed at their source coordinates and joined exactly;
   windows that a smaller document of the same block has are decided before the shuffle.
4. Verify and cut. Decisions return to the source text by document and place, and the words go.

Edges are compared by two 64-bit hashes. Groups are streamed with bounded state; nothing is collected.

Edge cases: null text has no words; texts under 13 words lose none; rows with a null id keep all words
and make no other row lose any; rows with equal id never repeat each other, whether or not their texts
agree; extra columns are ignored (cut) or kept (cut_text); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import text as T

WINDOW = 13
ANCHOR = 5
#: Rows of one anchor that the stream holds back at most.
HELD = 200_000
#: Pieces of one anchor that a block sends to the anchor's group at most; with more, the anchor is hot.
SPREAD = 64

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROWS = "anchor bigint, piece bigint, doc bigint, place bigint, n bigint"
_PLACE_BITS = 40
#: What is added to n of pieces that are known to branch.
_BRANCHES = 1 << 40


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _print_of(text: bytes) -> int:
    """23 bits that tell rows with one id but different texts apart."""
    return zlib.crc32(text) >> 9


def _compact(hashes: np.ndarray, first: np.ndarray, window: int, anchor: int):
    """Path pieces of all documents of a block: anchor hash, piece hash, document index, start, n."""
    grams = T.grams(hashes, anchor)
    span = window - anchor + 1
    n = len(hashes) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    best, at = grams[:n].copy(), np.arange(n)
    for i in range(1, span):
        less = grams[i : i + n] < best
        np.copyto(best, grams[i : i + n], where=less)
        np.copyto(at, np.arange(i, i + n), where=less)
    counts = np.maximum(np.diff(first) - window + 1, 0)  # windows of each document
    starts = T.ragged(first[:-1], counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    at, best = at[starts], best[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(starts)))
    begin = starts[head]
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, len(hashes)), out=prefix[1:])
    whole = (prefix[begin + size + window - 1] - prefix[begin]) * _powers(_INVERSE, len(hashes))[begin]
    piece = T.mix(whole + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return best[head], piece, doc[head], begin - first[doc[head]], size


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _own_key(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A key of its own for a row that needs no others."""
    return T.mix(doc.astype(np.uint64) * np.uint64(_BASE) + place.astype(np.uint64))


def _runs(doc: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decided windows, in order of document and place; adjoining ones become one row."""
    order = np.lexsort((place, doc))
    doc, place, n = doc[order], place[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + n[:-1])
    head = np.flatnonzero(new)
    return doc[head], place[head], np.add.reduceat(n, head) if len(head) else n


def _pieces(id_col: str, text_col: str, window: int, anchor: int, spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, text_col):
            ids = block.column(id_col).combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            data, offsets = T.raw(block.column(text_col))
            starts, ends, first = T.words(data, offsets)
            a, p, at, begin, n = _compact(T.span_hashes(data, starts, ends), first, window, anchor)
            prints = np.array([_print_of(data[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
            use = known[at]
            a, p, at, begin, n = (x[use] for x in (a, p, at, begin, n))
            doc, place = ids[at], prints[at] << _PLACE_BITS | begin
            order = np.lexsort((place, doc, p, a))
            a, p, doc, place, n = (x[order] for x in (a, p, doc, place, n))
            least = _least(a, p, doc)
            repeat = doc > least
            d, x, k = _runs(doc[repeat], place[repeat], n[repeat])
            a, p, doc, place, n = (c[~repeat] for c in (a, p, doc, place, n))
            head = np.append(True, a[1:] != a[:-1])[: len(a)]
            group = np.cumsum(head) - 1
            hot = (np.bincount(group, head | np.append(True, p[1:] != p[:-1])[: len(a)]) > spread)[group] if len(a) else head
            marks = a[head & hot]
            none = np.zeros(len(marks), np.int64)
            cool = ~hot
            own, away = _own_key(d, x), _own_key(doc[hot], place[hot])
            columns = [
                np.concatenate(c)
                for c in ((a[cool], own, away, marks), (p[cool], own, away, T.mix(marks)), (doc[cool], d, doc[hot], none), (place[cool], x, place[hot], none), (n[cool], -k, n[hot] + _BRANCHES, none))
            ]
            table = pa.RecordBatch.from_arrays([_signed(c) for c in columns], ["anchor", "piece", "doc", "place", "n"])
            for i in range(0, table.num_rows, 65536):
                yield table.slice(i, 65536)

    return run


def _least(*columns: np.ndarray) -> np.ndarray:
    """For rows sorted by all columns, the first value of the last column among rows equal in the others."""
    *keys, last = columns
    new = np.ones(len(last), bool)
    if len(last) > 1:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return last[np.flatnonzero(new)][np.cumsum(new) - 1] if len(last) else last


def _join_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order (anchor, piece, doc, place): repeats (kind 0) and branching pieces (kind 1)."""
    names = ("anchor", "piece", "doc", "place", "n")
    carry = [np.zeros(0, np.int64) for _ in names]
    branched = None  # the held anchor, if it is known to branch

    def out(rows, kind: int) -> pa.RecordBatch:
        n = len(rows[2])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows[2:]] + [pa.array(rows[0]), pa.array(np.full(n, kind, np.int32))], ["doc", "place", "n", "anchor", "kind"])

    def work(rows, last: bool):
        nonlocal carry, branched
        decided = rows[4] < 0
        if decided.any():
            yield out([c[decided] for c in rows[:4]] + [-rows[4][decided]], 0)
            rows = [c[~decided] for c in rows]
        direct = rows[4] >= _BRANCHES
        if direct.any():
            yield out([c[direct] for c in rows[:4]] + [rows[4][direct] - _BRANCHES], 1)
            rows = [c[~direct] for c in rows]
        anchor, piece, doc = rows[:3]
        if len(doc):
            repeat = doc > _least(anchor, piece, doc)
            if repeat.any():
                yield out([c[repeat] for c in rows], 0)
            rows = [c[~repeat] for c in rows]
            anchor, piece = rows[:2]
            group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1])) - 1
            kinds = np.append(True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]))
            multi = ((np.bincount(group, kinds) > 1) | (np.bincount(group, rows[4] == 0) > 0))[group]  # n of a mark is 0
            if branched is not None:
                multi |= anchor == branched
            done = np.ones(len(anchor), bool) if last else anchor != anchor[-1]
            real = rows[4] > 0
            if (multi & done & real).any():
                yield out([c[multi & done & real] for c in rows], 1)
            tail_branches = bool(multi[-1])
            tail = anchor[-1]
            carry = [c[~done] for c in rows]
            branched = tail if not last and branched == tail else None
            if len(carry[0]) > HELD and tail_branches:
                real = carry[4] > 0
                yield out([c[real] for c in carry], 1)
                carry = [c[-1:].copy() for c in carry]
                carry[4][:] = 0  # a mark: already given out
                branched = tail
        else:
            carry = rows

    for batch in batches:
        new = [batch.column(n).to_numpy() for n in names]
        yield from work([np.concatenate(x) for x in zip(carry, new, strict=True)], False)
    yield from work(carry, True)


def _windows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, "__text"):
            data, offsets = T.raw(block.column("__text"))
            starts, ends, first = T.words(data, offsets)
            hashes = T.span_hashes(data, starts, ends)
            edges, check = T.grams(hashes, window), T.grams(hashes, window, 11)
            parts = []
            for i in range(block.num_rows):
                own = _print_of(data[offsets[i] : offsets[i + 1]].tobytes())
                marks = block.column("__marks")[i].values
                place, n = (marks.field(k).to_numpy() for k in ("place", "n"))
                mine = place >> _PLACE_BITS == own
                at = np.unique(T.ragged(place[mine] & (1 << _PLACE_BITS) - 1, n[mine]))
                parts.append((first[i] + at, np.full(len(at), block.column("__doc")[i].as_py(), np.int64), own << _PLACE_BITS | at))
            at, doc, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            a, p = edges[at], check[at]
            order = np.lexsort((place, doc, p, a))
            a, p, doc, place = (c[order] for c in (a, p, doc, place))
            repeat = doc > _least(a, p, doc)
            d, x, k = _runs(doc[repeat], place[repeat], np.ones(int(repeat.sum()), np.int64))
            own, stay = _own_key(d, x), ~repeat
            columns = [np.concatenate(c) for c in ((a[stay], own), (p[stay], own), (doc[stay], d), (place[stay], x), (np.ones(int(stay.sum()), np.int64), -k))]
            table = pa.RecordBatch.from_arrays([_signed(c) for c in columns], ["anchor", "piece", "doc", "place", "n"])
            for i in range(0, table.num_rows, 65536):
                yield table.slice(i, 65536)

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows in order (edge, check, doc): those that a smaller document has too, and those decided (n under 0)."""
    edge = check = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, p, doc, place, n = (batch.column(k).to_numpy() for k in ("anchor", "piece", "doc", "place", "n"))
        least = _least(a, p, doc).copy()
        if edge is not None:
            least[(a == edge) & (p == check)] = first
        edge, check, first = a[-1], p[-1], least[-1]
        gone = (doc > least) | (n < 0)
        yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(place[gone]), pa.array(np.abs(n[gone]))], ["doc", "place", "n"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """Documents (__doc, __text), and the repeated edges of each: doc, place, n consecutive windows."""
    rows = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).cast("string").alias("__text"))
    sent = rows.mapInArrow(_pieces("__doc", "__text", window, anchor, SPREAD), _ROWS)
    dealt = sent.repartition("anchor").sortWithinPartitions("anchor", "piece", "doc", "place")
    found = materialize(dealt.mapInArrow(_join_anchors, "doc bigint, place bigint, n bigint, anchor bigint, kind int"), "anchors")
    marks = found.where("kind = 1").groupBy("doc").agg(F.collect_list(F.struct("place", "n")).alias("__marks"))
    branches = rows.join(marks, F.col("__doc") == F.col("doc")).select("__doc", "__text", "__marks")
    edges = branches.mapInArrow(_windows(window, anchor), _ROWS)
    tied = edges.repartition("anchor", "piece").sortWithinPartitions("anchor", "piece", "doc", "place")
    return rows, found.where("kind = 0").select("doc", "place", "n").unionByName(tied.mapInArrow(_repeats, "doc bigint, place bigint, n bigint"))


def _lost(marks, own: int, n: int, window: int) -> np.ndarray:
    """Which of a text's n words are covered, from its decisions."""
    if not marks.is_valid:
        return np.zeros(n, bool)
    place, count = (marks.values.field(k).to_numpy() for k in ("place", "n"))
    mine = place >> _PLACE_BITS == own
    at, count = place[mine] & (1 << _PLACE_BITS) - 1, count[mine]
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + count + window - 1, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _texts(text_col: str, window: int):
    """Replace the texts that lose words by their kept words; other columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, text_col):
                data, offsets = T.raw(part.column(text_col))
                starts, ends, first = T.words(data, offsets)
                out = []
                for i in range(part.num_rows):
                    a, b = first[i], first[i + 1]
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    lost = _lost(part.column("__marks")[i], _print_of(text), b - a, window)
                    if lost.any():
                        stay = np.flatnonzero(~lost) + a
                        out.append(b" ".join(data[x:y].tobytes() for x, y in zip(starts[stay], ends[stay], strict=True)))
                    else:
                        out.append(text if part.column(text_col)[i].is_valid else None)
                names = [c for c in part.schema.names if c != "__marks"]
                columns = [pa.array(out, pa.binary()).cast(pa.string()) if c == text_col else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def cut_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """docs with repeated passages cut from their texts; count_col, where present, follows the text."""
    _, found = repeats(docs, id_col, text_col, window)
    marks = found.groupBy("doc").agg(F.collect_list(F.struct("place", "n")).alias("__marks")).withColumnRenamed("doc", "__doc")
    held = docs.join(marks, F.col(id_col).cast("long") == F.col("__doc"), "left").drop("__doc")
    out = held.mapInArrow(_texts(text_col, window), docs.schema)
    return out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType)) if count_col in docs.columns else out


def _cut_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, "__text"):
            data, offsets = T.raw(block.column("__text"))
            starts, ends, first = T.words(data, offsets)
            count, gone, kept = [], [], []
            for i in range(block.num_rows):
                a, b = first[i], first[i + 1]
                lost = _lost(block.column("__marks")[i], _print_of(data[offsets[i] : offsets[i + 1]].tobytes()), b - a, window)
                stay = np.flatnonzero(~lost) + a
                sizes = ends[stay] - starts[stay] + 1
                text = data[np.minimum(T.ragged(starts[stay], sizes), len(data) - 1)] if len(stay) else np.zeros(0, np.uint8)
                text[np.cumsum(sizes) - 1] = 32
                count.append(b - a)
                gone.append(int(lost.sum()))
                kept.append(text[:-1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("__doc").combine_chunks(),
                    pa.array(count, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, kept_sha256 and, with with_text, kept."""
    rows, found = repeats(docs, id_col, text_col, window)
    marks = found.groupBy("doc").agg(F.collect_list(F.struct("place", "n")).alias("__marks"))
    held = rows.join(marks, F.col("__doc") == F.col("doc"), "left").select("__doc", "__text", "__marks")
    out = held.mapInArrow(_cut_words(window), "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return out.select(F.col("doc").alias(id_col), "n_words", "n_removed", "kept_sha256", *["kept"] * with_text)
