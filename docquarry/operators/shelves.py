"""Terms of documents dealt to shards, past which questions stream: the best documents and phrases, exactly.

An entry (doc, tid, x, y) is one term of one document: for sums x is the term's count and y the
document's length norm, for phrases x is the term's place and y the document's length. Entries travel
packed, many in a row of arrays that names each document and each term once; a shard is held whole,
questions pass it one by one and bring only their best documents (or matches) back. So what is shuffled
grows with the texts, not with documents times questions, and memory is bounded by SHARD_ENTRIES. Terms
go by numbers or by 64-bit hashes of themselves; rows of small numbers are smaller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Entries of a shard on average, and entries packed at once by a task.
SHARD_ENTRIES, PACK_ENTRIES = 2_000_000, 1_000_000
K1, B = 1.2, 0.75
#: Stands for a null id inside a shard.
NO_ID = -(1 << 63)
#: Kinds of a shard's rows, in the order in which they come.
VALID, ENTRY, ASK = 0, 1, 2
#: Documents (ids, ys), terms (tids) with their numbers of entries (ns), and of each entry its document's place in ids (at)
#: and x; how many terms and entries. Binary columns are unsigned integers as wide as the row's largest.
_ROW = "shard bigint, ids array<bigint>, ys array<double>, terms int, entries int, tids binary, ns binary, at binary, xs binary"
_NAMES = ["shard", "ids", "ys", "terms", "entries", "tids", "ns", "at", "xs"]


def shards_of(entries: int | None) -> int:
    return max(1, -(-int(entries or 0) // SHARD_ENTRIES))


def known(id_: Column | str) -> Column:
    return F.coalesce(F.col(id_) if isinstance(id_, str) else id_, F.lit(NO_ID)).cast("long")


def norm(length: Column, mean: Column) -> Column:
    return K1 * (1 - B + B * length / mean)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _narrow(whole: np.ndarray) -> bytes:
    whole = whole.view(np.uint64)
    return whole.astype(np.min_scalar_type(whole.max())).tobytes()


def _wide(own: bytes, n: int) -> np.ndarray:
    return np.frombuffer(own, f"u{len(own) // n}").astype(np.int64)


def _pack(shards: int, add: bool, block: int = 1):
    """Entries to rows of arrays, one a shard and PACK_ENTRIES entries; with add, counts of a document's term are summed.

    Each block of ids goes to one shard. A table in the order of its ids then has few shards among PACK_ENTRIES
    entries, so rows stay long and rarely repeat a term, however many shards there are.
    """

    def cut(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, tids, xs, ys = (np.concatenate(c) for c in zip(*parts, strict=True))
        shard = ((ids.view(np.uint64) // np.uint64(block) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((ids, tids, shard))
        shard, ids, tids, xs, ys = (c[order] for c in (shard, ids, tids, xs, ys))
        if add:
            new = starts(ids, tids)
            shard, ids, tids, xs, ys = shard[new], ids[new], tids[new], np.add.reduceat(xs, new), ys[new]
        rows, terms = starts(shard), starts(shard, tids)
        by = np.lexsort((ys, ids, shard))
        docs = starts(shard[by], ids[by], ys[by])
        at = np.empty(len(by), np.int64)
        at[by] = np.repeat(np.arange(len(docs)), np.diff(np.append(docs, len(by))))
        docs = by[docs]
        first, own = np.searchsorted(shard[docs], shard[rows]), np.searchsorted(terms, rows)
        at -= np.repeat(first, np.diff(np.append(rows, len(shard))))
        ends = pa.array([*first, len(docs)], pa.int32())
        held = [pa.array(shard[rows]), *(pa.ListArray.from_arrays(ends, pa.array(c[docs])) for c in (ids, ys)), *(pa.array(np.diff(c), pa.int32()) for c in ([*own, len(terms)], [*rows, len(shard)]))]
        ns = np.diff(np.append(terms, len(shard)))
        narrow = [pa.array([_narrow(c) for c in np.split(column, cuts[1:])], pa.binary()) for column, cuts in ((tids[terms], own), (ns, own), (at, rows), (xs, rows))]
        return pa.RecordBatch.from_arrays([*held, *narrow], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                # Copies, so that no batch is kept.
                parts.append(tuple(np.array(batch.column(i), t) for i, t in enumerate((np.int64, np.int64, np.int64, np.float64))))
                held += batch.num_rows
            if held >= PACK_ENTRIES:
                yield cut(parts)
                parts, held = [], 0
        if held:
            yield cut(parts)

    return run


def pack(entries: DataFrame, shards: int, add: bool = False, kind: int = ENTRY, block: int = 1) -> DataFrame:
    """A shelf of entries (doc, tid, x, y); x is a whole number, 0 or more. With add, entries of a document's term add up.

    Shelves that are read together have the same number of shards and the same block of ids.

    A shelf may also hold rows of the kind VALID, with a document's version as x and its length or norm as
    y: entries then have the version as y, those of other versions are passed over, and y comes from here.
    """
    e = entries.select(known("doc").alias("doc"), "tid", F.col("x").cast("long").alias("x"), F.col("y").cast("double").alias("y"))
    return e.mapInArrow(_pack(shards, add, block), _ROW).withColumn("kind", F.lit(kind))


def joined(shelf: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """A written shelf, and in how many shards, with neighbouring shards joined up to SHARD_ENTRIES.

    Shards are dealt before it is known how few entries the questions' terms have and how many add up.
    """
    held = shelf.agg(F.sum("entries").alias("n")).first().n  # one row
    each = min(shards, max(1, SHARD_ENTRIES * shards // max(1, held or 0)))
    return shelf.withColumn("shard", F.floor(F.col("shard") / each)), -(-shards // each)


def _valid(valid: list[tuple[np.ndarray, ...]], ids: np.ndarray, tids: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, ...]:
    docs, _, version, y = (np.concatenate(c) for c in zip(*valid, strict=True))
    order = np.argsort(docs, kind="stable")
    docs, version, y = docs[order], version[order], y[order]
    at = np.minimum(np.searchsorted(docs, ids), len(docs) - 1)
    keep = (docs[at] == ids) & (version[at] == ys)
    return ids[keep], tids[keep], xs[keep], y[at[keep]]


class Sums:
    """A shard for sums: what a term adds to a document's score, by term."""

    def __init__(self, ids: np.ndarray, tids: np.ndarray, xs: np.ndarray, ys: np.ndarray):
        self.docs, at = np.unique(ids, return_inverse=True)
        order = np.lexsort((at, tids))
        at, tids, xs, ys = at[order], tids[order], xs[order], ys[order]
        new = starts(tids, at)
        tf = np.add.reduceat(xs, new) if len(new) else xs
        self.at, self.gain, tids = at[new], tf * (K1 + 1) / (tf + ys[new]), tids[new]
        self.first = np.append(starts(tids), len(tids))
        self.terms = tids[self.first[:-1]]

    def best(self, k: int) -> Callable[[int, np.ndarray, np.ndarray], Iterator[tuple]]:
        def find(qid: int, tids: np.ndarray, weights: np.ndarray) -> Iterator[tuple]:
            scores = np.zeros(len(self.docs))
            for i, w, t in zip(np.searchsorted(self.terms, tids), weights, tids, strict=True):
                if i < len(self.terms) and self.terms[i] == t:
                    own = slice(self.first[i], self.first[i + 1])
                    scores[self.at[own]] += self.gain[own] * w  # a document is once in a term's list
            found = np.flatnonzero(scores > 0)
            rounded = np.round(scores[found], 6)
            if len(found) > k:
                keep = rounded >= -np.partition(-rounded, k - 1)[k - 1]
                found, rounded = found[keep], rounded[keep]
            for i in np.argsort(-rounded, kind="stable")[:k]:
                yield qid, int(self.docs[found[i]]), float(rounded[i])

        return find


class Places:
    """A shard for phrases: places of terms in documents, by term and document."""

    def __init__(self, ids: np.ndarray, tids: np.ndarray, xs: np.ndarray, ys: np.ndarray):
        self.docs, first, at = np.unique(ids, return_index=True, return_inverse=True)
        self.length = ys[first]
        order = np.lexsort((xs, at, tids))
        tids, self.at, self.place = tids[order], at[order], xs[order].astype(np.int64)
        self.first = np.append(starts(tids), len(tids))
        self.terms = tids[self.first[:-1]]

    def counts(self) -> Iterator[tuple]:
        """How many documents hold each term, as rows without a question."""
        for t, a, b in zip(self.terms, self.first[:-1], self.first[1:], strict=True):
            yield None, int(t), len(starts(self.at[a:b])), 0

    def matches(self, slop: int) -> Callable[[int, np.ndarray, np.ndarray], Iterator[tuple]]:
        first = list(self.counts())

        def find(qid: int, tids: np.ndarray, qpos: np.ndarray) -> Iterator[tuple]:
            """Windows of slop + 1 shifts (place minus place in the question) with all places of the question."""
            yield from first
            first.clear()
            i = np.searchsorted(self.terms, tids)
            if (i >= len(self.terms)).any() or (self.terms[i] != tids).any():
                return
            lists = {int(j): slice(self.first[j], self.first[j + 1]) for j in np.unique(i)}
            docs = None
            for own in sorted(lists.values(), key=lambda s: s.stop - s.start):
                has = self.at[own] if docs is None else self.at[own][np.isin(self.at[own], docs)]
                docs = np.unique(has)
                if not len(docs):
                    return
            held = {j: (lambda keep, own=own: (self.at[own][keep], self.place[own][keep]))(np.isin(self.at[own], docs)) for j, own in lists.items()}
            low = -int(qpos.max()) - slop
            span = max(int(p.max()) for _, p in held.values()) - low + 1
            keys = []
            for j, q in zip(i, qpos.astype(np.int64), strict=True):
                at, place = held[int(j)]
                windows = (place - q)[:, None] - np.arange(slop + 1) - low
                keys.append(np.unique(at[:, None] * span + windows))
            key, got = np.unique(np.concatenate(keys), return_counts=True)
            at, n = np.unique(key[got == len(qpos)] // span, return_counts=True)
            for d, c in zip(at, n, strict=True):
                yield qid, int(self.docs[d]), -(-int(c) // (slop + 1)), int(self.length[d])

        return find


_HITS = {"qid": pa.int64(), "doc": pa.int64(), "score": pa.float64()}
_MATCHES = {"qid": pa.int64(), "doc": pa.int64(), "tf": pa.int64(), "dl": pa.int64()}
_COUNTS = {"tid": pa.int64(), "df": pa.int64()}


def _values(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy()


def _entries(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, ...]:
    """(ids, tids, xs, ys) of a packed row, as copies, so that no batch is kept."""
    ids, ys = _values(batch, "ids", row), _values(batch, "ys", row)
    terms, entries, *narrow = (batch.column(c)[row].as_py() for c in _NAMES[3:])
    tids, ns, at, xs = (_wide(own, n) for own, n in zip(narrow, (terms, terms, entries, entries), strict=True))
    return ids[at], np.repeat(tids, ns), xs.astype(np.float64), ys[at]


def _stream(build: Callable, find: Callable, kinds: dict[str, pa.DataType]):
    """Shards come sorted, entries before questions; one shard is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, own = None, {}, None
        for batch in batches:
            key, kind, out = batch.column("shard").to_numpy(), batch.column("kind").to_numpy(), []
            for r in range(len(key)):
                if key[r] != shard:
                    shard, parts, own = key[r], {VALID: [], ENTRY: []}, None
                if kind[r] != ASK:
                    parts[kind[r]].append(_entries(batch, r))
                    continue
                if own is None:
                    if not parts[ENTRY]:
                        continue
                    whole = [np.concatenate(c) for c in zip(*parts[ENTRY], strict=True)]
                    if parts[VALID]:
                        whole = _valid(parts[VALID], *whole)
                    parts, own = {VALID: [], ENTRY: []}, find(build(*whole))
                    del whole
                ids = _values(batch, "ids", r)
                out.extend(own(int(ids[0]), ids[1:], _values(batch, "ys", r)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    return run


def _pass(shelf: DataFrame, asks: DataFrame, shards: int, build: Callable, find: Callable, kinds: dict[str, pa.DataType]) -> DataFrame:
    """Questions (qid, tid, x) past every shard of a shelf."""
    own = asks.groupBy(known("qid").alias("qid")).agg(F.collect_list(F.struct("tid", F.col("x").cast("double").alias("x"))).alias("a"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    none = [F.lit(0).alias("terms"), F.lit(0).alias("entries"), *[F.lit(b"").alias(c) for c in _NAMES[5:]]]
    ask = own.select(each, F.lit(ASK).alias("kind"), F.concat(F.array("qid"), "a.tid").alias("ids"), F.col("a.x").alias("ys"), *none)
    both = shelf.select(ask.columns).unionByName(ask)
    ddl = ", ".join(f"{c} {'double' if t == pa.float64() else 'bigint'}" for c, t in kinds.items())
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(_stream(build, find, kinds), ddl)


def frequencies(shelf: DataFrame, shards: int) -> DataFrame:
    """(tid, df): how many documents hold a term."""

    def counts(own):
        def find(qid, tids, xs):
            return zip((int(t) for t in own.terms), (int(n) for n in np.diff(own.first)), strict=True)

        return find

    one = shelf.limit(1).select(F.lit(0).cast("long").alias("qid"), F.lit(0).cast("long").alias("tid"), F.lit(0.0).alias("x"))
    return _pass(shelf, one, shards, Sums, counts, _COUNTS).groupBy("tid").agg(F.sum("df").alias("df"))


def best(shelf: DataFrame, asks: DataFrame, shards: int, k: int) -> DataFrame:
    """(qid, doc, score): of each question (qid, tid, x: weight) the k best documents of each shard.

    Scores are rounded to 6 digits before the cut, ties go to the smaller id.
    """
    found = _pass(shelf, asks, shards, Sums, lambda own: own.best(k), _HITS)
    return found.select(*[F.nullif(F.col(c), F.lit(NO_ID)).alias(c) for c in ("qid", "doc")], "score")


def matches(shelf: DataFrame, asks: DataFrame, shards: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """(qid, doc, tf, dl): documents with all terms of a question (qid, tid, x: place) within slop of their order.

    And (tid, df), how many documents hold a term: both come from one pass, which is run once.
    """
    found = materialize(_pass(shelf, asks, shards, Places, lambda own: own.matches(slop), _MATCHES), "matches")
    df = found.where("qid is null").groupBy(F.col("doc").alias("tid")).agg(F.sum("tf").alias("df"))
    hits = found.where("qid is not null")
    return hits.select(*[F.nullif(F.col(c), F.lit(NO_ID)).alias(c) for c in ("qid", "doc")], "tf", "dl"), df
