"""Sharding of documents into byte-balanced shards by Karmarkar-Karp differencing (operator 7).

Equal texts are an indivisible group. Sizes are summed by group (with partial sums, so a group of
copies costs a row a task), and each partition of groups runs the differencing alone, by slabs as
they come: partial partitions wait by spread, and the two of largest spread are combined, oppositely
ordered. Each Spark partition leaves one partial partition of as many subsets as there are shards; the driver combines
these few (shards x partitions numbers, whatever the data) in the same way. Rows then join their
group's subset. Slots count on through buckets of a hash, so no shard is one task.

The law is `bytes`: sizes are as near equal as indivisible groups allow.

Edge cases: null text has size 1 and forms a group of its own with other null texts; empty texts are
another group; repeated rows belong to their text's group; extra columns are ignored; an empty table
gives an empty result; fewer groups than shards leave shards empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Groups that are differenced together, about; it bounds a task's memory.
SLAB = 50_000


def differencing(items: list[list[int]], shards: int) -> list[list[int]]:
    """Combine partial partitions until one is left.

    items[i] are the subset sums of partial partition i, `shards` of them. Returns for each item the
    final subset of each of its subsets.
    """
    # A subset is a node of a forest: leaves are (item, position), inner nodes two children.
    children: list[tuple[int, int]] = []
    base = len(items) * shards
    heap = []
    for i, sums in enumerate(items):
        parts = sorted(((s, i * shards + j if s else -1) for j, s in enumerate(sums)), key=lambda x: (-x[0], x[1]))
        heap.append((parts[-1][0] - parts[0][0], i, parts))
    heapq.heapify(heap)
    n = len(items)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = []
        for (x, p), (y, q) in zip(a, reversed(b), strict=True):
            if p < 0 or q < 0:
                joined.append((x + y, max(p, q)))
            else:
                children.append((p, q))
                joined.append((x + y, base + len(children) - 1))
        joined.sort(key=lambda x: (-x[0], x[1]))
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], n, joined))
        n += 1
    out = [[0] * shards for _ in items]
    if heap:
        for final, (_, root) in enumerate(heap[0][2]):
            stack = [root] if root >= 0 else []  # -1: an empty subset
            while stack:
                x = stack.pop()
                if x >= base:
                    stack += children[x - base]
                else:
                    out[x // shards][x % shards] = final
    return out


class Dealer:
    """Slabs of sizes, one after another, onto shards that keep their sums.

    Each slab is differenced alone; its partial partition is then combined with that of all slabs
    before, oppositely ordered, so a slab's subsets are known as soon as it has come.
    """

    def __init__(self, shards: int):
        self.sums = [0] * shards

    def deal(self, sizes: list[int]) -> list[int]:
        shards = len(self.sums)
        own = [row[0] for row in differencing([[n, *[0] * (shards - 1)] for n in sizes], shards)]
        total = [0] * shards
        for n, x in zip(sizes, own, strict=True):
            total[x] += n
        rising = sorted(range(shards), key=lambda x: (total[x], x))
        falling = sorted(range(shards), key=lambda x: (-self.sums[x], x))
        final = dict(zip(rising, falling, strict=True))
        for x in range(shards):
            self.sums[final[x]] += total[x]
        return [final[x] for x in own]


def subsets(sizes: list[int], shards: int, slab: int = SLAB) -> list[int]:
    """The subset of each size, by slabs that come one after another."""
    dealer = Dealer(shards)
    return [x for i in range(0, len(sizes), slab) for x in dealer.deal(sizes[i : i + slab])]


def _label(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        dealer, held = Dealer(shards), []

        def labelled() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).sort_by([("bytes", "descending"), ("k1", "ascending"), ("k2", "ascending")])
            found = dealer.deal(table.column("bytes").to_pylist())
            table = table.append_column("subset", pa.array(found, pa.int32()))
            table = table.append_column("part", pa.array([part] * len(found), pa.int32()))
            yield from table.combine_chunks().to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, SLAB):
                held.append(batch.slice(at, SLAB))
                if sum(b.num_rows for b in held) >= SLAB:
                    yield from labelled()
                    held = []
        if held:
            yield from labelled()

    return run


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, size, text_crc32, law, shard, slot and grown_shard (null)."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias(id_col),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text.isNull(), text).alias("k1"),
        F.xxhash64(text, F.lit("group"), text.isNull()).alias("k2"),
    )
    groups = rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"))
    labels = materialize(groups.mapInArrow(_label(shards), "k1 bigint, k2 bigint, bytes bigint, subset int, part int"), "labels")
    sums: dict[int, list[int]] = {}
    for r in labels.groupBy("part", "subset").agg(F.sum("bytes").alias("bytes")).collect():  # partitions x shards rows
        sums.setdefault(r.part, [0] * shards)[r.subset] = r.bytes
    parts = sorted(sums)
    final = differencing([sums[p] for p in parts], shards)
    table = [(p, j, s) for p, row in zip(parts, final, strict=True) for j, s in enumerate(row)]
    where = spark.createDataFrame(table, "part int, subset int, shard int")
    group_shard = labels.join(F.broadcast(where), ["part", "subset"]).select("k1", "k2", "shard")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.join(group_shard, ["k1", "k2"]).withColumn("bucket", F.pmod(F.xxhash64(id_col, "k1"), F.lit(buckets)))
    placed = materialize(placed.select(id_col, "size", "text_crc32", "shard", "bucket", "k1"), "placed")
    counts = placed.groupBy("shard", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")
    counts = counts.select("shard", "bucket", before.alias("before"))  # shards x buckets rows
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(id_col, "k1")) - 1
    out = placed.join(F.broadcast(counts), ["shard", "bucket"])
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + place).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
