"""Language identification by error-correcting output codes (operator 8).

Every language has a codeword; a binary n-gram classifier (linear, hinge loss, dual coordinate
descent) predicts each bit. Decoding weighs each bit's loss by how well its classifier did on rows
that it didn't see, and takes the codeword of least loss. The score is that codeword's share of the
softmax over losses; a small lead over the second codeword flags ambiguity.

Classifiers learn from SAMPLE rows at most, dealt evenly over the languages by a hash of the id.
Prediction is a map over whole texts with fixed-size weights: no shuffle.

Edge cases: null text, or one without any letter, is `und` with score 0; rows with null lang or text
don't teach; with one known language it is the answer; with none all rows are `und`; repeated rows
each get their row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from . import text as T
from .quality import held_out

#: Most rows that the classifiers learn from.
SAMPLE = 4000
BITS = 16
#: Lead of the best codeword, in score, under which a text counts as ambiguous.
LEAD = 0.2


def codewords(k: int, seed: int = 0) -> np.ndarray:
    """k rows of +1 and -1: all splits for up to 7 classes, else a random code of large distance."""
    if k <= 7:
        columns = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T.reshape(k, -1)
    draw, best, least = np.random.default_rng(seed), None, -1
    n = int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        code = draw.choice([-1.0, 1.0], (k, n))
        apart = ((n - code @ code.T) / 2 + n * np.eye(k)).min()
        if apart > least and (np.abs(code.sum(axis=0)) < k).all():
            best, least = code, apart
    return best


_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 3-grams of the folded texts (each with a blank around), and where texts begin."""
    n = len(offsets) - 1
    sizes = np.diff(offsets) + 2
    at = np.append(0, np.cumsum(sizes))
    padded = np.full(int(at[-1]) + 2, 32, np.int64)
    padded[T.ragged(at[:-1] + 1, sizes - 2)] = _FOLD[data]
    x = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    return ((x * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS))[: int(at[n])], at


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = np.zeros(256, bool)
    plain[[*range(65, 91), *range(97, 123)]] = True
    total = np.append(0, np.cumsum(plain[data]))
    found = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        points = np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        found[i] = (T._classes()[points] == 1).any()
    return found


def _teach_rows(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, text_col):
            data, offsets = T.raw(block.column(text_col))
            grams, at = _grams(data, offsets)
            rows = [np.unique(grams[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("__lang").combine_chunks(),
                    block.column("__key").combine_chunks(),
                    pa.array([i.astype(np.int32).tobytes() for i, _ in rows], pa.binary()),
                    pa.array([n.astype(np.int32).tobytes() for _, n in rows], pa.binary()),
                ],
                ["lang", "key", "ids", "counts"],
            )

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict:
    """Fit one classifier per bit on at most `sample` rows that aren't held out."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(~held_out(id_col), F.lit(False)))
    dealt = known.select(F.col(id_col).cast("long").alias(id_col), F.col(lang_col).cast("string").alias("__lang"), F.xxhash64(id_col).alias("__key"))
    # A uniform hash times the language's count stands for the rank in it: no language meets in one task.
    place = F.pmod("__key", F.lit(1 << 30)) / float(1 << 30) * F.col("__n")
    counts = dealt.groupBy("__lang").agg(F.count("*").alias("__n"))
    chosen = dealt.join(counts, "__lang").withColumn("__rank", place).orderBy("__rank", "__key", id_col).limit(sample)
    chosen = chosen.select(id_col, "__key").distinct()
    rows = known.select(F.col(id_col).cast("long").alias(id_col), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias(text_col)).join(F.broadcast(chosen), id_col)
    found = rows.mapInArrow(_teach_rows(text_col), "lang string, key bigint, ids binary, counts binary")
    got = sorted((r.key, r.lang, bytes(r.ids), bytes(r.counts)) for r in found.orderBy("key").limit(sample).collect())
    names = sorted({r[1] for r in got})
    size = 1 << BITS
    if len(names) < 2:
        return {"names": names, "code": np.zeros((len(names), 1)), "w": np.zeros((size, 1), np.float32), "bias": np.zeros(1), "weight": np.ones(1)}
    code = codewords(len(names))
    counts = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int32)) for r in got]
    rows = [(i, 10.0 * n / n.sum()) for i, n in counts]
    y = np.array([names.index(r[1]) for r in got])
    fit = np.arange(len(y)) % 5 != 0
    w, bias, weight = np.zeros((size, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1])
    for j in range(code.shape[1]):
        sign = code[y, j]
        own, first = linear.hinge_dual([rows[i] for i in np.flatnonzero(fit)], sign[fit], size, np.full(fit.sum(), 10.0), 10)
        wrong = np.mean([sign[i] * (own[rows[i][0]] @ rows[i][1] + first) <= 0 for i in np.flatnonzero(~fit)]) if (~fit).any() else 0.0
        w[:, j], bias[j] = 10.0 * own, first
        weight[j] = np.log((1 - wrong + 0.01) / (wrong + 0.01)) if wrong < 0.5 else 0.0
    return {"names": names, "code": code, "w": w, "bias": bias, "weight": weight / max(weight.sum(), 1e-9)}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best codeword, its score, and whether it is ambiguous, for rows of bit margins."""
    loss = np.log1p(np.exp(-np.clip(3.0 * margins[:, None, :] * model["code"][None], -30, 30))) @ model["weight"]
    share = np.exp(-4.0 * (loss - loss.min(axis=1, keepdims=True)))
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    score = share[np.arange(len(best)), best]
    second = np.partition(share, -2, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(best))
    return best, score, score - second < LEAD


def _predict_rows(id_col: str, text_col: str, model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model["names"]
        for block in T.blocks(batches, text_col, 1 << 20):
            data, offsets = T.raw(block.column(text_col))
            known = has_letter(data, offsets) if names else np.zeros(block.num_rows, bool)
            if known.any():
                grams, at = _grams(data, offsets)
                margins = np.add.reduceat(model["w"][grams], at[:-1], axis=0).astype(np.float64) / np.diff(at)[:, None] + model["bias"]
                best, score, unsure = decode(margins, model)
            else:
                best, score, unsure = (np.zeros(block.num_rows, t) for t in (int, float, bool))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(id_col).combine_chunks(),
                    pa.array([names[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()),
                    pa.array(np.where(known, score, 0.0), pa.float64()),
                    pa.array(np.where(known, unsure, True), pa.bool_()),
                ],
                [id_col, "lang_pred", "score", "ambiguous"],
            )

    return run


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, held_out, lang_pred, score (0 to 1) and ambiguous."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    found = rows.mapInArrow(_predict_rows(id_col, text_col, model), f"{id_col} bigint, lang_pred string, score double, ambiguous boolean")
    return found.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
