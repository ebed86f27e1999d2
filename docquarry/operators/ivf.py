"""Approximate neighbours by inverted lists over a coarse quantiser, with the filter inside the search.

Vectors are stored by the cell of their nearest centre. A query reads its nearest cells, in order, until
they hold candidates enough that pass the filter; those are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import wider
from . import search

#: Fixed value: candidates of a query. Most cells, vectors that train the centres, queries that measure
#: how many cells to read, and the share of neighbours that those cells shall hold.
CANDIDATES, CELLS, SAMPLE, ASKED, RECALL = 60, 4096, 20_000, 256, 0.97


class Quantiser(NamedTuple):
    """Centres as rows of a matrix, and the number of cells that a query reads."""

    centres: np.ndarray
    probes: int


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def train(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 10, seed: int = 7, recall: float = RECALL) -> Quantiser:
    """Centres of unit vectors (id, v) by k-means on a bounded sample that a hash picks.

    The cells that a query reads are measured on the sample: so many that they hold the share `recall` of
    the neighbours of ASKED of its vectors. Vectors without structure need many, clustered ones few.

    `cells` is the square root of the number of vectors unless given, CELLS at most. Of equal vectors one
    teaches: a hot vector can't take all centres.
    """
    cells = min(cells or int(vectors.count() ** 0.5) or 1, CELLS)
    rows = vectors.where("v is not null").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("v").toArrow()
    if not rows.num_rows:
        return Quantiser(np.zeros((1, 1)), 1)
    x = np.unique(_unit(search._matrix(rows.column("v").combine_chunks())), axis=0)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = np.bincount(near, minlength=len(centres)) > 0
        centres[full] = _unit(sums[full])
    ask = x[rng.permutation(len(x))[:ASKED]]
    near = (x @ centres.T).argmax(axis=1)
    found = np.argsort(-(ask @ x.T), axis=1)[:, 1 : search.KNN_SIZE + 1]
    place = np.argsort(np.argsort(-(ask @ centres.T), axis=1), axis=1)
    places = np.take_along_axis(place, near[found], axis=1)
    return Quantiser(centres, int(np.quantile(places, recall, method="higher")) + 1 if places.size else 1)


def build(vectors: DataFrame, quantiser: Quantiser, path: str) -> None:
    """Write vectors (id, v and columns to filter by) under their cell, one folder a cell."""
    centres = quantiser.centres

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (search._matrix(batch.column("v")) @ centres.T).argmax(axis=1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], [*batch.schema.names, "cell"])

    held = vectors.where("v is not null")
    placed = held.mapInArrow(place, wider(held.schema, cell="int"))
    # A cell's rows go to several writers, so a hot cell isn't one task's.
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(path)


def find(spark: SparkSession, path: str, quantiser: Quantiser, queries: DataFrame, k: int = search.KNN_SIZE, wanted: dict | None = None, candidates: int = CANDIDATES, probes: int | None = None, same: bool = False) -> DataFrame:
    """(qid, doc, score, rank) for queries (id, v): the k nearest of the cells that each query reads.

    It reads `probes` cells (the quantiser's number unless given) and then more until `candidates` vectors pass the filter, so a narrow filter
    widens the search by itself; with no more than `candidates` rows behind a filter the result is exact.
    Only cells that some query reads are scanned.
    """
    held, centres, probes = search.filters(spark.read.parquet(path), wanted), quantiser.centres, probes or quantiser.probes
    sizes = np.zeros(len(centres), np.int64)
    for r in held.groupBy("cell").count().collect():  # a row a cell
        sizes[r.cell] = r["count"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(search._matrix(batch.column("v")) @ centres.T), axis=1, kind="stable")
            near = [row[sizes[row] > 0] for row in near]
            before = [np.cumsum(sizes[row]) - sizes[row] for row in near]
            cells = [row[(b < candidates) | (np.arange(len(row)) < probes)].tolist() for row, b in zip(near, before, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cells, pa.list_(pa.int32()))], ["id", "v", "cells"])

    ask = queries.where("v is not null").select(F.col("id").cast("long").alias("id"), "v")
    ask = ask.mapInArrow(probe, wider(ask.schema, cells="array<int>")).select("id", "v", F.explode("cells").alias("cell"))
    read = [r.cell for r in ask.select("cell").distinct().collect()]  # a row a cell
    # Large cells are split into shards of bounded size, which their queries all visit.
    parts = F.get(F.array(*[F.lit(int(max(1, -(-n // search.SHARD_ROWS)))) for n in sizes]), F.col("cell"))
    shard = lambda part: (F.col("cell").cast("long") * (1 << 32) + part).alias("shard")
    shelf = held.where(F.col("cell").isin(read)).select(F.col("id").cast("long").alias("id"), "v", shard(F.pmod(F.xxhash64("id"), parts)))
    asked = ask.select("id", "v", "cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select("id", "v", shard(F.col("part")))
    return search.top(search.scan(shelf, asked, k, same=same).drop("dim"), k)
