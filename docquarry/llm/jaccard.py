"""N-gram Jaccard join by partition of the universe (operator 6).

1. Sign. A document's set is its distinct 4-word shingles. By size it falls into a band; only equal
   and neighbouring bands can link. For a pair of bands, H bounds the tokens in which linked sets can
   differ. A hash deals the universe into m segments, and what a set has in a segment is one
   signature. Two allocations are weighed by cost for each band (allocate()):
   * exact: m = H + 1 + e segments, so linked sets agree in at least 1 + e of them; a document leaves
     out its e dearest segments, those with the fewest tokens (ties by content, so both sides leave
     out the same shared ones, and one shared segment always remains);
   * one-deletion: m = H // 2 + 1 segments, so linked sets differ by at most one token in some
     segment; signatures are of the segment and of it less each one token.
   Each block of texts combines its rows first: of equal sets, and of sets that share a signature,
   only the smallest document is sent on, and the others are tied to it. A hot class or signature
   sends one row a block.
2. Join. Signatures are dealt by value and streamed in order: the smallest document of a bucket is
   tied to each other one, never all pairs.
3. Part. The clusters so formed hold every link. Clusters too large for one block are signed again
   with other deals of the universe, which parts what a passage of many documents had chained.
4. Verify. A cluster's sets are dealt into blocks of bounded size; inside a block, and between
   blocks, intersections are counted exactly by an inverted list. Clusters of several blocks compare
   each block with itself and the first one; then only documents outside the cluster's largest
   component meet the rest.

Edge cases: null or wordless texts have an empty set and link with nothing; fewer than four words make
one shingle; rows that share an id are one node; rows with a null id get a null component; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from . import text as T
from .graph import components

SHINGLE = 4
#: Least similarity in hundredths.
PERCENT = 85
#: Shingles that a verification block holds, about.
BLOCK_ITEMS = 400_000
#: Cost of a signature that separates badly (of one token at most), in rows.
DEAR = 100.0
#: Deals of the universe that part the clusters of several blocks before they are verified.
ROUNDS = 3


@functools.cache
def bands(percent: int, largest: int) -> tuple[int, ...]:
    """Lower ends of the size bands; sets that link lie in equal or neighbouring bands."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return (*out, max(out[-1] + 1, -(-out[-1] * 100 // percent)))


def _few(n: int, m: int, most: int) -> float:
    """Chance that a segment of m gets at most `most` of n tokens."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + (n - i) * math.log1p(-1 / m) - i * math.log(m)) for i in range(min(n, most) + 1)) if m > 1 else float(n <= most)


#: Segments that the exact allocation may leave out, as shares of the bound.
SLACK = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)


@functools.cache
def allocate(low: int, high: int, percent: int = PERCENT) -> tuple[int, int, int] | None:
    """(m, e, deletions) for pairs whose smaller set has low to high - 1 tokens; None if only equal sets link.

    Either costs the rows that a set sends, and DEAR for each signature sent of a segment with one
    token or none. The exact allocation sends bound + 1 rows whatever e, so more segments, of which
    the poorest stay out, cost nothing; one-deletion sends a row for each token.
    """
    a = high - 1
    b = a * 100 // percent
    bound = (100 - percent) * (a + b) // (100 + percent)
    if bound == 0:
        return None
    size, best = max(1, (low + high) // 2), None
    for e in sorted({math.ceil(bound * x) for x in SLACK}):
        m = bound + 1 + e
        # Segments of two tokens are dearer than fuller ones, by far less.
        cost = bound + 1 + DEAR * max(0.0, m * _few(size, m, 1) - e) + max(0.0, m * _few(size, m, 2) - e)
        if best is None or cost < best[0]:
            best = (cost, (m, e, 0))
    m = bound // 2 + 1
    cost = size + m + DEAR * m * _few(size, m, 2) + m * _few(size, m, 3)
    return (m, 0, 1) if cost < best[0] else best[1]


def shingle_sets(block: pa.Table, text_col: str, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = T.raw(block.column(text_col))
    starts, ends, first = T.words(data, offsets)
    hashes = T.span_hashes(data, starts, ends, lower=True)
    grams = T.grams(hashes, k)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(T.grams(hashes[a:b], int(b - a), 100 + int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(tokens: np.ndarray, percent: int = PERCENT, seed: int = 0) -> np.ndarray:
    """All signatures of a set, for its own band and for the band below; the seed deals the universe."""
    n = len(tokens)
    ends = bands(percent, 1 << max(4, n.bit_length()))
    own = int(np.searchsorted(ends, n, side="right")) - 1
    place = T.mix(tokens + np.uint64(seed)) >> np.uint64(32)
    value = T.mix(tokens + np.uint64(0x9E3779B97F4A7C15))
    out = []
    for band in range(max(0, own - 1), own + 1):
        plan = allocate(ends[band], ends[band + 1], percent)
        if plan is None:
            continue
        m, e, deletions = plan
        segment = (place * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        counts = np.bincount(segment, minlength=m)
        total = np.append(np.uint64(0), np.cumsum(value[order]))
        stop = np.cumsum(counts)
        salt = np.arange(m, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(band << 32 | deletions)
        sums = total[stop] - total[stop - counts]
        whole = T.mix(T.mix(sums) + salt)
        if deletions:
            out += [whole, T.mix(T.mix(sums[segment] - value) + salt[segment])]
        else:
            out.append(whole[np.lexsort((whole, counts))[e:]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_SIGNS = "sign bigint, sign2 bigint, doc bigint, n int, rep bigint"
_TIES = "a bigint, b bigint, n bigint, key bigint, kind int"
#: Kinds of rows. A class is an equal set: its smallest document in a block speaks for the others.
_CLASS, _MEMBER, _TIE = 0, 1, 2
_MARK = 1 << 29  # n of a row is its set's size, plus the kind times this; a signature's n is -1


def _sent(ids: np.ndarray, sets: list[np.ndarray], percent: int, seed: int, salt: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Signature rows of a block's documents, combined inside the block.

    Equal sets, and sets that share a signature, are tied to the block's smallest document here;
    only that one is sent for it. So a hot class or signature sends one row a block, and the
    ties travel by a key of their own. With salt, signatures of another salt never meet, and
    classes aren't told.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    # A class is known by two hashes; an empty set is alone in its class.
    keys = np.array([(x.sum(dtype=np.uint64), T.mix(x).sum(dtype=np.uint64)) if len(x) else (np.uint64(i), np.uint64(j)) for j, (i, x) in enumerate(zip(ids.view(np.uint64), sets, strict=True))], np.uint64).reshape(-1, 2)
    one, two = T.mix(keys[:, 0] + np.uint64(5)), T.mix(keys[:, 1] + sizes.astype(np.uint64))
    if salt is not None:
        one = T.mix(one + salt)
    order = np.lexsort((ids, two, one))
    new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])) if len(ids) else np.zeros(0, bool)
    rep = np.empty(len(ids), np.int64)
    rep[order] = order[new][np.cumsum(new) - 1]
    first = rep == np.arange(len(ids))
    found = [(i, np.unique(signatures(sets[i], percent, seed))) for i in np.flatnonzero(first & (sizes > 0))]
    sign = np.concatenate([np.zeros(0, np.uint64), *(x for _, x in found)])
    owner = np.repeat(np.array([i for i, _ in found], np.int64), [len(x) for _, x in found]) if found else np.zeros(0, np.int64)
    if salt is not None:
        sign = T.mix(sign + salt[owner])
    order = np.lexsort((ids[owner], sign))
    sign, doc = sign[order], ids[owner][order]
    new = np.append(True, sign[1:] != sign[:-1]) if len(sign) else np.zeros(0, bool)
    pivot = doc[new][np.cumsum(new) - 1] if len(sign) else doc
    ties = np.unique(np.stack([pivot, doc], axis=1)[~new & (pivot != doc)], axis=0)
    spread = lambda a, b: T.mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64))
    zero = lambda x: np.zeros(len(x), np.int64)
    parts = [(sign[new], zero(doc[new]), doc[new], zero(doc[new]) - 1, zero(doc[new])), (spread(ties[:, 0], ties[:, 1]), ties[:, 0], ties[:, 1], zero(ties) + _TIE * _MARK, zero(ties))]
    if salt is None:
        parts.append((one[first], two[first].view(np.int64), ids[first], sizes[first], ids[first]))
    own = rep[~first]
    parts.append((spread(ids[own], ids[~first]), one[~first].view(np.int64), ids[~first], sizes[~first] + _MEMBER * _MARK, ids[own]))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    table = pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3].astype(np.int32)), pa.array(columns[4])], ["sign", "sign2", "doc", "n", "rep"])
    for i in range(0, table.num_rows, 65536):
        yield table.slice(i, 65536)


def _sign(id_col: str, text_col: str, shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, text_col):
            yield from _sent(block.column(id_col).to_numpy(), shingle_sets(block, text_col, shingle), percent, 0, None)

    return run


def _sign_again(percent: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
                salt = T.mix(batch.column("cluster").to_numpy().astype(np.uint64))
                yield from _sent(batch.column("doc").to_numpy(), sets, percent, seed, salt)

    return run


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From signatures in order (sign, sign2, doc): each document tied to the first of its bucket."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two, doc, rep = (batch.column(c).to_numpy() for c in ("sign", "sign2", "doc", "rep"))
        n = batch.column("n").to_numpy().astype(np.int64)
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        if held is not None and (one[0], two[0]) == held[:2]:
            new[0] = False
        group = np.cumsum(new)
        pivots = np.append(held[2] if held is not None else 0, doc[new])
        pivot = pivots[group]
        held = (one[-1], two[-1], pivot[-1])
        kind = n // _MARK
        whole, member, told = kind == _CLASS, kind == _MEMBER, kind == _TIE
        use = (n < 0) & (pivot != doc)
        ties = np.concatenate([np.stack([pivot[use], doc[use]], axis=1), np.stack([two[told], doc[told]], axis=1)])
        ties = np.unique(ties, axis=0)
        parts = [
            (pivot[whole], doc[whole], n[whole], one[whole], kind[whole]),
            (rep[member], doc[member], n[member] - _MEMBER * _MARK, two[member], kind[member]),
            (ties[:, 0], ties[:, 1], np.full(len(ties), -1), np.zeros(len(ties), np.int64), np.full(len(ties), _TIE)),
        ]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:4]), pa.array(columns[4].astype(np.int32))], ["a", "b", "n", "key", "kind"])


class _Sets:
    """Union of nodes under the smallest."""

    def __init__(self, nodes: np.ndarray):
        self.up = {int(x): int(x) for x in nodes}

    def find(self, x: int) -> int:
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _verify(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links between side 0 and side 1 rows (each in side 1 too, if alone), as a spanning forest."""
        docs = table.column("doc").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        side = table.column("side").to_numpy()
        probes, shelf = np.flatnonzero(side < 2), np.flatnonzero(side > 0)
        sizes = np.array([len(sets[i]) for i in shelf], np.int64)
        every = np.concatenate([sets[i] for i in shelf]) if len(shelf) else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.arange(len(shelf), dtype=np.int32), sizes)[order]
        values, first = np.unique(every[order], return_index=True)
        first = np.append(first, len(every))
        union = _Sets(docs)
        for i in probes:
            own = sets[i]
            at = np.searchsorted(values, own)
            at[at == len(values)] = 0
            at = at[values[at] == own] if len(values) else at[:0]
            common = np.bincount(owner[T.ragged(first[at], first[at + 1] - first[at])], minlength=len(shelf))
            hits = np.flatnonzero((common > 0) & (100 * common >= percent * (len(own) + sizes - common)))
            for j in hits:
                union.join(int(docs[i]), int(docs[shelf[j]]))
        found = [(x, union.find(x)) for x in union.up]
        found = [(x, r) for x, r in found if x != r]
        return pa.table({"a": pa.array([r for _, r in found], pa.int64()), "b": pa.array([x for x, _ in found], pa.int64())})

    return run


def _set_rows(text_col: str, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, text_col):
            found = [x.tobytes() for x in shingle_sets(block, text_col, shingle)]
            yield pa.RecordBatch.from_arrays([block.column("doc").combine_chunks(), block.column("cluster").combine_chunks(), pa.array(found, pa.binary())], ["doc", "cluster", "tokens"])

    return run


def _links(parts: list[DataFrame], percent: int) -> DataFrame:
    """Verified links of clusters whose sets (doc, cluster, blocks, tokens) are given."""
    check = _verify(percent)
    sets = functools.reduce(DataFrame.unionByName, parts)
    schema = "a bigint, b bigint"
    small = sets.where("blocks = 1").select("doc", "cluster", "tokens", F.lit(1).alias("side"))
    found = small.groupBy("cluster").applyInArrow(check, schema)
    large = sets.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks"))
    if large.isEmpty():
        return found
    inner = large.select("doc", "cluster", "block", F.lit(0).cast("bigint").alias("other"), "tokens", F.lit(1).alias("side"), F.lit(0).alias("kind"))
    probes = large.where("block > 0").select("doc", "cluster", "block", F.lit(0).cast("bigint").alias("other"), "tokens", F.lit(0).alias("side"), F.lit(1).alias("kind"))
    shelves = large.where("block = 0").select("doc", "cluster", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.lit(0).cast("bigint").alias("other"), "tokens", F.lit(2).alias("side"), F.lit(1).alias("kind"))
    keys = ("cluster", "block", "other", "kind")
    one = materialize(inner.unionByName(probes).unionByName(shelves).groupBy(*keys).applyInArrow(check, schema), "links")
    # Documents outside the cluster's largest component meet all other blocks.
    group = components(one)
    named = large.join(group, F.col("doc") == F.col("node"), "left").withColumn("group", F.coalesce("component", "doc")).drop("node", "component")
    counts = named.groupBy("cluster", "group").count()
    largest = counts.groupBy("cluster").agg(F.max(F.struct("count", "group")).alias("top")).select("cluster", F.col("top.group").alias("top"))
    rest = named.join(largest, "cluster").where("group <> top").drop("top")
    sizes = rest.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length("tokens")) / (8 * BLOCK_ITEMS))).cast("bigint").alias("parts"))
    rest = rest.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("doc", F.lit(1)), "parts"))
    probes = rest.select("doc", "cluster", "tokens", F.lit(0).alias("side"), "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    shelves = large.join(sizes, "cluster").select("doc", "cluster", "tokens", F.lit(2).alias("side"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "block")
    two = probes.unionByName(shelves).groupBy("cluster", "part", "block").applyInArrow(check, schema)
    return found.unionByName(one).unionByName(two)


def _ties(signs: DataFrame) -> DataFrame:
    return materialize(signs.repartition("sign").sortWithinPartitions("sign", "sign2", "doc").mapInArrow(_tie, _TIES), "ties")


def _blocked(sets: DataFrame, block_items: int) -> DataFrame:
    """(doc, cluster, blocks, tokens): into how many blocks of bounded size a cluster is dealt."""
    blocks = sets.groupBy("cluster").agg(F.ceil(F.sum(F.length("tokens")) / (8 * block_items)).cast("bigint").alias("blocks"))
    return sets.join(blocks, "cluster").select("doc", "cluster", "blocks", "tokens")


def _refined(sets: DataFrame, percent: int, block_items: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Clusters of one block, and of several blocks after up to ROUNDS more deals of the universe.

    Linked sets share a signature whatever the seed, so a link never leaves its cluster; sets that
    a passage of many documents chained together part, each time but for a small share. Where a deal
    parts hardly any, the clusters are true ones and go on to be verified.
    """
    parts, made = [sets.where("blocks = 1")], [sets]
    large = sets.where("blocks > 1")
    left, before = large.count(), None
    for seed in range(1, ROUNDS + 1):
        if not left or (before is not None and left > 0.9 * before):
            break
        ties = _ties(large.mapInArrow(_sign_again(percent, seed), _SIGNS))
        groups = components(ties)
        named = large.select("doc", "tokens").join(groups, F.col("doc") == F.col("node")).select("doc", F.col("component").alias("cluster"), "tokens")
        new = materialize(_blocked(named, block_items), "sets")
        discard(ties)
        made.append(new)
        parts.append(new.where("blocks = 1"))
        large = new.where("blocks > 1")
        left, before = large.count(), left
    return [*parts, large], made


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document: id_col, n_shingles and component_id (the smallest id reachable by links)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    known = rows.where("doc is not null")
    ties = _ties(known.mapInArrow(_sign("doc", "text", shingle, percent), _SIGNS))
    # Classes: a block's members follow its first document to the class's smallest one.
    heads = ties.where(f"kind = {_CLASS}").select("a", "b", "n", "key")
    members = ties.where(f"kind = {_MEMBER}").select(F.col("a").alias("rep"), F.col("b").alias("doc"), "n", "key")
    named = heads.select("a", F.col("b").alias("rep"), "key").distinct()
    equal = heads.select("a", "b", "n").unionByName(members.join(named, ["rep", "key"]).select("a", F.col("doc").alias("b"), "n"))
    equal = materialize(equal, "equal")
    classes = equal.groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("z"))
    # Ties between classes, the classes named by their smallest document.
    near = ties.where(f"kind = {_TIE}").select("a", "b").distinct()
    name = classes.select(F.col("b").alias("doc"), F.col("a").alias("rep"))
    near = near.join(name.withColumnRenamed("rep", "ra"), F.col("a") == F.col("doc")).drop("doc")
    near = near.join(name.withColumnRenamed("rep", "rb"), F.col("b") == F.col("doc")).select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct()
    clusters = components(near)
    wanted = clusters.select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    # The same way at every size: a broadcast of clustered ids would be bounded by nothing.
    held = known.join(wanted.hint("merge"), "doc").mapInArrow(_set_rows("text", shingle), "doc bigint, cluster bigint, tokens binary")
    sets = materialize(_blocked(materialize(held, "shingles"), block_items), "sets")
    discard(ties, clusters)
    # A repeated id with several sets ties their classes.
    several = classes.where("a <> z").select("b").join(equal, "b").select("a", "b")
    parts, made = _refined(sets, percent, block_items)
    groups = components(_links(parts, percent).unionByName(several))
    discard(*made)
    out = equal.join(groups, F.col("a") == F.col("node"), "left")
    out = out.select(F.col("b").alias(id_col), F.col("n").alias("n_shingles"), F.least(F.coalesce("component", "a"), "b").alias("component_id"))
    count = rows.where("doc is null").mapInArrow(_count("text", shingle), "n bigint")
    return out.unionByName(count.select(F.lit(None).cast("bigint").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id")))


def _count(text_col: str, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, text_col):
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in shingle_sets(block, text_col, shingle)], pa.int64())], ["n"])

    return run


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are the smallest of their group, with all their columns; null ids stay."""
    found = join(docs, id_col, text_col, **options)
    gone = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
