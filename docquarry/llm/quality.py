"""Quality classifier: naive Bayes support vectors (operator 9).

Features are indicators of n-grams of a whole text: byte n-grams, n-grams over the sequence of
character shapes, and n-grams over what a text repeats (words said again, word pairs and lines seen
before). Each indicator is scaled by the log-count ratio of the classes; a linear hinge-loss model is
then fitted by dual coordinate descent, and a sigmoid on rows that it didn't see maps margins to scores.

The model learns from SAMPLE labelled rows at most, the first by a hash of the id; their ids are the
only thing broadcast. Scoring is a map over all rows with a fixed-size weight vector: no shuffle.

Edge cases: null text counts as empty and is scored too; rows with a null or unclear label don't
teach; repeated rows each get their score; with fewer than two classes the score is the (smoothed)
share of label 1; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from . import text as T

#: Most labelled rows that the model learns from.
SAMPLE = 4000
#: Hashed feature space.
BITS = 18
THRESHOLD = 0.7

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_SHAPE[128:] = ord("a")


def _hash(ids: np.ndarray, kind: int) -> np.ndarray:
    return (T.mix(ids.astype(np.uint64) + np.uint64(kind << 56)) >> np.uint64(64 - BITS)).astype(np.int64)


def _runs(flags: np.ndarray) -> np.ndarray:
    """Lengths of the runs of True, as powers of two."""
    if not flags.any():
        return np.zeros(0, np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return np.unique(np.frexp((edges[1::2] - edges[::2]).astype(float))[1])


def _again(items: np.ndarray) -> np.ndarray:
    """Whether an item occurred before in the sequence."""
    if not len(items):
        return np.zeros(0, bool)
    _, first = np.unique(items, return_index=True)
    out = np.ones(len(items), bool)
    out[first] = False
    return out


def features(data: np.ndarray, words: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Distinct feature ids of one text: its bytes, the hashes of its words and of its lines."""
    b = data.astype(np.int64)
    found = [_hash(np.unique(b), 1)]
    if len(b) > 1:
        found.append(_hash(np.unique(b[:-1] << 8 | b[1:]), 2))
    if len(b) > 2:
        found.append(_hash(np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]), 3))
    shape = _SHAPE[data]
    if len(shape):
        shape = shape[np.append(True, shape[1:] != shape[:-1])].astype(np.int64)
        for n in (3, 5):
            if len(shape) >= n:
                gram = np.zeros(len(shape) - n + 1, np.int64)
                for i in range(n):
                    gram = gram << 8 | shape[i : len(shape) - n + 1 + i]
                found.append(_hash(np.unique(gram), 3 + n))
    if len(words) > 1:
        found.append(_hash(_runs(words[1:] == words[:-1]), 20))
        found.append(_hash(_runs(_again(T.grams(words, 3))), 21))
        found.append(_hash(np.array([int(8 * _again(words).mean()), int(8 * _again(T.grams(words, 2)).mean()) + 16]), 22))
    if len(lines) > 1:
        found.append(_hash(np.array([int(8 * _again(lines).mean())]), 23))
    found.append(_hash(np.array([len(words).bit_length()]), 24))
    return np.unique(np.concatenate(found))


def _block_features(block: pa.Table, text_col: str) -> Iterator[np.ndarray]:
    data, offsets = T.raw(block.column(text_col))
    starts, ends, first = T.words(data, offsets)
    words = T.span_hashes(data, starts, ends)
    keep = np.ones(256, bool)
    keep[10] = False
    line_starts, line_ends, line_first = T.words(data, offsets, keep)
    lines = T.span_hashes(data, line_starts, line_ends)
    for i in range(block.num_rows):
        yield features(data[offsets[i] : offsets[i + 1]], words[first[i] : first[i + 1]], lines[line_first[i] : line_first[i + 1]])


def _teach_rows(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, text_col):
            found = [x.astype(np.int32).tobytes() for x in _block_features(block, text_col)]
            yield pa.RecordBatch.from_arrays([block.column("__label").combine_chunks().cast(pa.int32()), block.column(id_col).combine_chunks().cast(pa.int64()), pa.array(found, pa.binary())], ["label", "id", "found"])

    return run


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text, mod 4, is 2."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """Fit the model on at most `sample` labelled rows that aren't held out."""
    clear = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).where(~held_out(id_col))
    clear = clear.groupBy(F.col(id_col).cast("long").alias(id_col)).agg(F.min(label_col).alias("__label"), F.max(label_col).alias("__most")).where("__label = __most")
    chosen = clear.select(id_col, "__label").orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).join(F.broadcast(chosen), id_col)
    found = rows.mapInArrow(_teach_rows(id_col, text_col), "label int, id bigint, found binary")
    # A repeated id could bring more rows than were chosen.
    got = sorted(((r.id, r.label, bytes(r.found)) for r in found.orderBy(F.xxhash64("id"), "id").limit(sample).collect()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    y = np.array([r[1] for r in got])
    size = 1 << BITS
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return {"w": np.zeros(size, np.float32), "a": 0.0, "b": float(np.log(share / (1 - share)))}
    ids = [np.frombuffer(r[2], np.int32) for r in got]
    fit = np.arange(len(y)) % 5 != 0  # the rest sets the sigmoid
    if len(set(y[fit].tolist())) < 2 or len(set(y[~fit].tolist())) < 2:
        fit = np.ones(len(y), bool)
    counts = {}
    for c in (0, 1):
        total = np.ones(size)
        for i in np.flatnonzero(fit & (y == c)):
            total[ids[i]] += 1
        counts[c] = total / total.sum()
    ratio = np.log(counts[1] / counts[0])
    rows = [(x, ratio[x] / np.sqrt(max(1, len(x)))) for x in ids]
    sign = np.where(y == 1, 1.0, -1.0)
    where = np.flatnonzero(fit)
    share = np.where(sign[fit] > 0, (sign[fit] < 0).mean(), (sign[fit] > 0).mean())
    w, bias = linear.hinge_dual([rows[i] for i in where], sign[fit], size, 2.0 * share)
    set_by = np.flatnonzero(~fit) if (~fit).any() else where
    margins = np.array([w[rows[i][0]] @ rows[i][1] + bias for i in set_by])
    a, b = linear.sigmoid_fit(margins, y[set_by])
    return {"w": (w * ratio).astype(np.float32), "a": a, "b": float(a * bias + b)}


def _score_rows(text_col: str, model: dict, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, text_col):
            margins = np.array([float(model["w"][x].sum(dtype=np.float64)) / np.sqrt(max(1, len(x))) for x in _block_features(block, text_col)])
            score = 1 / (1 + np.exp(-np.clip(model["a"] * margins + model["b"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(block.column(c).combine_chunks() for c in block.column_names), pa.array(score, pa.float64())], [*block.column_names, out])

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id_col, held_out, score (0 to 1) and predicted (1 from threshold on)."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    found = rows.mapInArrow(_score_rows(text_col, model, "score"), T.wider(rows.schema, score="double"))
    return found.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model accepts, with all their columns."""
    found = docs.mapInArrow(_score_rows(text_col, model, "__score"), T.wider(docs.schema, __score="double"))
    return found.where(F.col("__score") >= threshold).drop("__score")
