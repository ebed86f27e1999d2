"""Importance resampling toward a target: hashed n-gram features by an external sort-count.

Features are runs of 1 to 3 words, lower-cased in A-Z; a feature's bucket is the crc32 of its bytes
modulo 10000. One pass writes each document's buckets as a packed uint16 stream; the streams lie end to
end in a file's column with the documents' offsets. Counts come from sorted streams by run lengths, and
each document's weight from the gains of its stream by np.add.reduceat.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running
from ..session import discard, materialize
from .text import _LOWER, BLOCK_BYTES, blocks, raw, words

BUCKETS = 10_000
#: Longest run of words, words that a document needs to be drawn, hundredths drawn, seed.
RUN, LEAST_WORDS, PERCENT, SEED = 3, 20, 5, 42
_KEEP = np.zeros(256, bool)
_KEEP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SPACE_CRC = np.uint32(zlib.crc32(b" "))


# --- crc32 of runs of words ------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _step() -> np.ndarray:
    """What a byte does to the register, by the polynomial of the public standard."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _tables(columns: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits as four tables by byte."""
    out = np.zeros((4, 256), np.uint32)
    for bit, value in enumerate(columns):
        j, i = divmod(bit, 8)
        out[j, 1 << i : 2 << i] = out[j, : 1 << i] ^ value
    return out


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


@lru_cache(maxsize=4096)
def _shift(length: int) -> np.ndarray:
    """The map of a crc when `length` more bytes follow: crc(a + b) = map(crc(a)) ^ crc(b)."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if length == 1:
        return _tables(_step()[bits & 255] ^ bits >> 8)
    half = _shift(length // 2)
    columns = _apply(half, _apply(half, bits))
    return _tables(_apply(_shift(1), columns) if length % 2 else columns)


#: Words up to this length are summed byte by byte together; longer ones each by itself.
_SHORT = 64


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each span of bytes."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    first, size = starts[order], -lengths[order]
    state, step = np.full(len(starts), 0xFFFFFFFF, np.uint32), _step()
    for k in range(min(_SHORT, int(lengths.max(initial=0)))):
        m = int(np.searchsorted(size, -k))  # the spans longer than k
        c = state[:m]
        state[:m] = step[(c ^ data[first[:m] + k]) & 255] ^ c >> 8
    out = np.empty_like(state)
    out[order] = ~state
    for i in np.flatnonzero(lengths > _SHORT):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def run_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray, skip: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (uint16) of the runs that end at each word, word by word, and how many end there.

    place: each word's index in its document; runs never cross documents. Words with place < skip
    are only context: no run ends there.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    crc = word_crcs(data, starts, ends)
    sizes, which = np.unique(ends - starts, return_inverse=True)
    tables = np.concatenate([_shift(int(s)).ravel() for s in sizes])
    base = which.astype(np.int64) * 1024

    def followed(c: np.ndarray) -> np.ndarray:
        """The crcs of runs that go on from the runs before with a space and this word."""
        c = _apply(_shift(1), c) ^ _SPACE_CRC
        c = np.concatenate([np.zeros(1, np.uint32), c[:-1]])
        return tables[base + (c & 255)] ^ tables[base + 256 + (c >> 8 & 255)] ^ tables[base + 512 + (c >> 16 & 255)] ^ tables[base + 768 + (c >> 24)] ^ crc

    runs, every = crc, [crc]
    for _ in range(RUN - 1):
        runs = followed(runs)
        every.append(runs)
    held = (place[:, None] >= np.arange(RUN)) & (place >= skip)[:, None]
    return (np.stack(every, axis=1)[held] % BUCKETS).astype(np.uint16), held.sum(axis=1)


def _places(first: np.ndarray, n: int) -> np.ndarray:
    """Each word's index in its document, from the index of every document's first word (with the end)."""
    return np.arange(n) - np.repeat(first[:-1], np.diff(first))


def _long(data: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """A long document's (buckets, words) slice by slice; two words go along as context."""
    at, context, tail = 0, 0, np.zeros(0, np.uint8)
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and _KEEP[data[end]]:
            gaps = np.flatnonzero(~_KEEP[data[end : end + most]])
            end = end + int(gaps[0]) if len(gaps) else min(end + most, len(data))
        part = np.concatenate([tail, data[at:end]])
        starts, ends, _ = words(part, np.array([0, len(part)]), _KEEP)
        yield run_buckets(part, starts, ends, np.arange(len(starts)), context)[0], len(starts) - context
        last = range(max(0, len(starts) - RUN + 1), len(starts))
        tail = np.concatenate([np.zeros(0, np.uint8), *[np.append(part[starts[i] : ends[i]], np.uint8(32)) for i in last]])
        at, context = end, len(last)


_STREAM = "id bigint, words bigint, cut bigint, stream binary"


def _binary(stream: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 2).astype(np.int32)), pa.py_buffer(stream.astype("<u2"))])


def _write_streams(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "words", "cut", "stream"]
        cut = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for block in blocks(batches, "text", most):
            data, offsets = raw(block.column("text"))
            ids = block.column("id").combine_chunks().cast(pa.int64())
            data = _LOWER[data]
            if len(ids) == 1 and len(data) > most:
                cut += 1
                for stream, n in _long(data, most):
                    yield pa.RecordBatch.from_arrays([ids, pa.array([n], pa.int64()), pa.array([cut], pa.int64()), _binary(stream, np.array([0, len(stream)]))], names)
                continue
            starts, ends, first = words(data, offsets, _KEEP)
            stream, held = run_buckets(data, starts, ends, _places(first, len(starts)))
            upto = np.append(0, np.cumsum(held))[first]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first)), pa.nulls(len(ids), pa.int64()), _binary(stream, upto)], names)

    return run


def streams(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """(id, words, cut, stream) in the shared folder: packed uint16 buckets of each document.

    Documents of more than `most` bytes come in several rows with a `cut` of their own; others have none.
    Without id_col, as where only counts are wanted, ids are null.
    """
    rows = docs.select((F.col(id_col) if id_col else F.lit(None)).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(_write_streams(most), _STREAM), "streams")


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch end to end, and the offsets of its rows."""
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 2
    flat = np.frombuffer(data, "<u2") if data is not None else np.zeros(0, np.uint16)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        flat = np.sort(_packed(batch.column("stream"))[0])
        if len(flat):
            at = np.append(0, np.flatnonzero(flat[1:] != flat[:-1]) + 1)
            total[flat[at]] += np.diff(np.append(at, len(flat)))
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["bucket", "n"])


def counts(written: DataFrame) -> DataFrame:
    """(bucket, n) over all streams: each task sorts its streams batch by batch and sums the run lengths."""
    return written.select("stream").mapInArrow(_count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the smoothed log ratio of both sides' rates."""
    s_all, t_all = sum(source.values()), sum(target.values())
    ratio = lambda b: (target.get(b, 0) + 1) * (s_all + BUCKETS) / ((source.get(b, 0) + 1) * (t_all + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(BUCKETS)], np.int64)


def _gather(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _packed(batch.column("stream"))
            weight, full = np.zeros(batch.num_rows, np.int64), np.flatnonzero(np.diff(offsets))
            if len(full):
                weight[full] = np.add.reduceat(gain[flat], offsets[full])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("words"), batch.column("cut"), pa.array(np.diff(offsets)), pa.array(weight)], ["id", "words", "cut", "n_features", "weight"])

    return run


def weights(written: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, words, n_features, weight) of each document, in the shared folder; slices of a long one add up."""
    parts = materialize(written.mapInArrow(_gather(gain), "id bigint, words bigint, cut bigint, n_features bigint, weight bigint"), "weights")
    long = parts.where("cut is not null").groupBy("cut", "id").agg(*[F.sum(c).alias(c) for c in ("words", "n_features", "weight")])
    return parts.where("cut is null").drop("cut").unionByName(long.drop("cut"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the drawn ones have a rank.

    A document's score is its weight plus Gumbel noise from a hash of its id, so the highest scores
    are a sample without replacement by importance. Of the N documents with `least_words` words, N *
    percent / 100 are drawn (rounded down), ties to the smaller id.

    Edge cases: a null or empty text, or one without words, has no features, weight 0 and no rank; a null
    id has the noise of an empty one and comes last among ties; rows that repeat an id are each
    a document, with the same noise; an empty target or table gives gains by the smoothing alone;
    other columns are not looked at. Texts over `most` bytes pass in slices. To the driver go the
    counts of the 10,000 buckets of both sides and the number of documents.
    """
    mine, aim = streams(docs, id_col, text_col, most), streams(target, None, text_col, most)
    gain = gains(*[{r.bucket: r.n for r in counts(side).collect()} for side in (mine, aim)])
    noise = (F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("long") + 0.5) / 4294967296
    scored = weights(mine, gain).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(noise))))
    able = F.col("words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id")]
    ranked = running(scored.where(able), [], order, F.lit(1), "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    discard(mine, aim)
    return ranked.unionByName(rest).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
