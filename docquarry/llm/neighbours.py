"""Approximate nearest neighbours by stable projections and a kd-tree (operator 3).

Largest inner product becomes least distance by one more coordinate that gives every vector the
greatest norm. Vectors are dealt once, into shards of bounded size by a hash of the id, so equal
vectors spread. Each shard keeps its vectors' projections by a Gaussian (2-stable) matrix of few
dimensions in a kd-tree that is built once. Queries are sent to the shards and stream through: a query
visits the tree's leaves by projected distance and verifies their vectors by the exact measure, until
a chi-square test holds: were a vector nearer than the k-th best so far, its projected distance would
be, but for a chance of 1 - CONFIDENCE, less than that of the next leaf. Every shard returns k rows a
query, and a window merges them.

Shards grow with the table up to MOST_ROWS, so that the queries' copies stay in proportion to the
vectors: memory is one shard, whatever the number of queries.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part; vectors
of another length than the query's are no candidates; with fewer than k candidates all are returned;
rows that repeat a query's id are its own; ties go to the smaller id; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 8
CONFIDENCE = 0.95
#: Rows of a shard: these at least, and a 64th of the table up to the second number.
SHARD_ROWS, MOST_ROWS = 8192, 131_072
LEAF = 64


def chi_square(x: float, m: int) -> float:
    """Distribution function of chi-square with an even number m of degrees of freedom."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


class Tree:
    """A kd-tree over projected points: leaves as runs of `order`, each with its box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        runs, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                runs.append((a, b))
                continue
            own = points[self.order[a:b]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        runs.sort()
        self.runs = np.array(runs).reshape(-1, 2)
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in runs])
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in runs])

    def leaves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by squared distance of their box from q."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0.0)
        d = (gap * gap).sum(axis=1)
        order = np.argsort(d, kind="stable")
        return order, d[order]


class Shard:
    """A shard's vectors of one length, by the leaves of the tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, matrix: np.ndarray):
        fill = np.sqrt(np.maximum(longest - (vectors * vectors).sum(axis=1), 0.0))
        self.tree = Tree(vectors @ matrix[:, :-1].T + fill[:, None] * matrix[:, -1])
        self.vectors, self.ids = vectors[self.tree.order], ids[self.tree.order]
        self.longest, self.matrix = longest, matrix

    def search(self, qid: int, q: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best found, until the next leaf is beyond the limit."""
        norm = float((q * q).sum())
        leaves, far = self.tree.leaves(self.matrix[:, :-1] @ q)
        best, who = np.zeros(0), np.zeros(0, np.int64)
        at, step = 0, 2
        while at < len(leaves):
            if len(best) >= k and far[at] > limit * max(norm + self.longest - 2 * best[k - 1], 0.0) + 1e-12:
                break
            run = np.concatenate([np.arange(a, b) for a, b in self.tree.runs[leaves[at : at + step]]])
            run = run[self.ids[run] != qid]
            score = (self.vectors[run] * q).sum(axis=1)
            if len(best) >= k:
                keep = score >= best[k - 1]
                run, score = run[keep], score[keep]
            best, who = np.concatenate([best, score]), np.concatenate([who, self.ids[run]])
            order = np.lexsort((who, -best))[:k]
            best, who = best[order], who[order]
            at, step = at + step, min(2 * step, 64)
        return who, best


def _matrix(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng(17).standard_normal((m, dim + 1))


def _search(k: int, m: int, confidence: float, longest: float):
    """Rows in order (shard, dim, ask): a shard's vectors of one length, then its queries, which stream."""
    limit = quantile(confidence, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "dim", "ask")]) if batch.num_rows else np.zeros((3, 0), np.int64)
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                ids = part.column("id").to_numpy()
                vectors = part.column("v").flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
                if key != (own := tuple(names[:2, a].tolist())):
                    key, shard, held = own, None, []
                if not names[2, a]:
                    held.append((ids, vectors))
                    continue
                if shard is None and held:
                    shard = Shard(*map(np.concatenate, zip(*held, strict=True)), longest, _matrix(key[1], m))
                    held = []
                if shard is not None:
                    found = [shard.search(i, q, k, limit) for i, q in zip(ids, vectors, strict=True)]
                    columns = (np.repeat(ids, [len(x) for x, _ in found]), *map(np.concatenate, zip(*found, strict=True)))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(x.cast("double").between(F.lit(-1.7976931348623157e308), F.lit(1.7976931348623157e308)), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest found."""
    base, ask = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).dropDuplicates(["id"])
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, longest = base.agg(F.count("*"), F.max(norm)).first()
    shards = max(1, -(-n // max(shard_rows, min(n // 64, MOST_ROWS))))
    shelf = base.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("ask"))
    asked = ask.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("ask"))
    met = shelf.unionByName(asked).withColumn("dim", F.size("v"))
    dealt = met.repartition(shards, "shard").sortWithinPartitions("shard", "dim", "ask")
    found = dealt.mapInArrow(_search(k, dimensions, confidence, float(longest or 0.0)), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
