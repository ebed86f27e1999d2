"""Connected components of an edge table: forests inside partitions, large-star and small-star steps between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, short_plans

#: Nodes of so large a share of all edges (one of HUBS) are hubs: there are 2 * HUBS of them at most.
HUBS = 5_000
#: Edges of a forest that a task holds, about.
FOREST = 1_000_000


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as stars: (node, smallest node of its component among these edges), other nodes than the smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        # A root goes under the smallest root that an edge joins it to; then paths are shortened.
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != up[up]).any():
            up = up[up]
    child = up != np.arange(len(nodes))
    return nodes[child], nodes[up[child]]


def _contract(most: int):
    """Edges (u, v) to forests of stars with the same components; a task that never holds more than `most` gives one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda f: pa.RecordBatch.from_arrays([pa.array(f[0]), pa.array(f[1])], ["u", "v"])
        held, waiting, rows = (np.zeros(0, np.int64),) * 2, [], 0
        for batch in batches:
            waiting.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            rows += batch.num_rows
            if rows >= most:
                held = _forest(*(np.concatenate(c) for c in zip(held, *waiting, strict=True)))
                waiting, rows = [], 0
                if len(held[0]) > most:
                    yield give(held)
                    held = (np.zeros(0, np.int64),) * 2
        held = _forest(*(np.concatenate(c) for c in zip(held, *waiting, strict=True)))
        yield give(held)

    return run


def _written(edges: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """edges as forests, written; whether one task saw them all, so that nothing is left to do.

    Forests of many tasks that hold `most` edges at most together meet in one task, whatever the number of
    partitions: its work is bounded by `most`. Larger ones are left to the rounds.
    """
    contract, schema = _contract(most), "u bigint, v bigint"
    held = materialize(edges.distinct().mapInArrow(contract, schema), "edges")
    files, rows = len(held.inputFiles()), held.count()
    if files > 1 and rows <= most:
        parts, files = held, 1
        held = materialize(parts.coalesce(1).mapInArrow(contract, schema), "edges")
        discard(parts)
    # A task that gave a forest away before its end wrote more rows than a forest holds.
    return held, files <= 1 and rows <= most


def _with_least(edges: DataFrame, hub: int | None) -> DataFrame:
    """edges (u, v) with m, the least v of each u; hub: the number of edges that makes a hub, if there is one.

    A hub's edges don't meet in one task: minima are partial sums, and those of the hubs, which are
    2 * HUBS at most whatever the graph, are broadcast; the other nodes' minima join by shuffle.
    """
    if hub is None:
        return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = least.where(F.col("n") >= hub).select("u", F.col("m").alias("hub_m"))
    told = edges.join(F.broadcast(hubs), "u", "left")
    rest = told.where("hub_m is null").select("u", "v").join(least.select("u", "m"), "u")
    return rest.unionByName(told.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")))


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    """Ends of edges, the largest degree, and a sum over the edges that changes with them: one job."""
    sign = F.xxhash64(F.greatest("u", "v"), F.least("u", "v")).cast("decimal(38,0)")
    nodes = _both(edges).groupBy("u").agg(F.count("*").alias("n"), F.sum(sign).alias("s"))
    ends, most, total = nodes.agg(F.sum("n"), F.max("n"), F.sum("s")).first()
    return ends or 0, most or 0, total


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = FOREST) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each task turns its edges into a forest of stars, held with about `most` edges at most. Each round
    then groups by node with partial sums (minima), joins them back, makes forests again, and is written
    to the shared folder; rounds go on to the fixed point, where all edges are stars around the smallest
    nodes. It is reached at once where the forests hold `most` edges at most: one task joins them.

    Edge cases: edges with a null end or from a node to itself are no edges; repeated edges count
    once; extra columns are ignored; without edges the result is empty.
    """
    plain = edges.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    with short_plans(edges.sparkSession):
        held, done = _written(plain, most)
        now = None if done else _state(held)
        while not done:
            hub = max(1000, now[0] // (2 * HUBS))
            hub = hub if now[1] >= hub else None
            both = _both(held)
            # Large star: larger neighbours of u, and u itself, move to the least of u and its neighbours.
            large = _with_least(both, hub).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            large = large.union(held.groupBy("u").agg(F.min("v").alias("v"))).where("u <> v").distinct()
            # Small star: smaller neighbours of u, and u itself, move to the least of them.
            small = _with_least(large, hub)
            moved = small.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            new, done = _written(moved.union(large.groupBy("u").agg(F.min("v").alias("v"))), most)
            discard(held)
            held, before = new, now
            if not done:
                now = _state(held)
                done = now == before
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
