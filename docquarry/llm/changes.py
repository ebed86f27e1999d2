"""A sequenced change applier: numbered changes of many keys, late, repeated and missing ones among them.

A stateful Structured Streaming query is keyed by hash buckets of clients. Each start feeds one batch
and one tick for every bucket, so buckets without rows move on too. A bucket takes all its clients
together: rows and state become numpy arrays, sorted by (client, n); runs of consecutive numbers and
repeated numbers show by differences between neighbours, and attributes follow by segmented scans.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.ranks import running
from ..session import discard, materialize, scratch, session_with

BATCHES, FIRST_DAY, DAYS, WAIT = 8, 19_723, 160, 5
#: Clients' rows that a bucket gets on average over all batches, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 64
_FED = "bucket int, tick boolean, client bigint, n bigint, day bigint, change bigint, op string, city string, balance double"
_OUT = "change_id bigint, client_id bigint, status string, batch int, missed bigint, city string, cents bigint, current boolean, n bigint"
_HELD = ("day", "change", "op", "city", "balance")
_LAST = ("change", "n", "op", "batch", "missed", "city", "balance")


def numbered(changes: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(batch, client_id, n, day, change_id, op, city, balance) of distinct rows, in the shared folder.

    n is the dense rank of seq in its client, taken before rows vanish: those without valid_at or
    change_id, and those whose id's crc32 is a multiple of 11. Null clients are one client, null
    seqs come first. Ranks are sums over ranges, so a client of any size spreads over many tasks.
    """
    rows = materialize(changes.distinct().select("change_id", "client_id", "seq", "op", "valid_at", "city", "balance"), "changes")
    pairs = running(rows.select("client_id", "seq").distinct(), ["client_id"], [F.col("seq").asc()], F.lit(1), "n")
    pairs = pairs.select(F.col("client_id").alias("__c"), F.col("seq").alias("__s"), "n")
    ranked = rows.join(pairs, F.col("client_id").eqNullSafe(F.col("__c")) & F.col("seq").eqNullSafe(F.col("__s"))).drop("__c", "__s")
    h = F.crc32(F.col("change_id").cast("string").cast("binary"))
    day = F.unix_date(F.col("valid_at").cast("date")) + 2 * (h % 4)
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("day") - FIRST_DAY) * batches / DAYS))).cast("int")
    known = ranked.where(F.col("valid_at").isNotNull() & (h % 11 != 0)).withColumn("day", day.cast("long")).withColumn("batch", batch)
    sure = F.when(F.abs("balance") < float("inf"), F.col("balance"))
    return materialize(known.select("batch", "client_id", "n", "day", "change_id", "op", "city", sure.alias("balance")), "numbered")


# --- one bucket, one batch ------------------------------------------------------------------------


def _first(*keys: np.ndarray) -> np.ndarray:
    """Which rows of sorted keys differ from the row before."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    return np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))


def _since(first: np.ndarray) -> np.ndarray:
    """For each row the index of its segment's first row."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0)) if len(first) else np.zeros(0, np.int64)


def _stack(*frames: pd.DataFrame) -> pd.DataFrame:
    """The rows of frames with the same columns; empty frames have no say about types."""
    full = [f for f in frames if len(f)]
    return pd.concat(full, ignore_index=True) if full else frames[0].reset_index(drop=True)


def _carried(sets: np.ndarray, values: np.ndarray, start: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The value of the last row that sets one, in each segment; before it, the segment's own."""
    last = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), -1)) if len(sets) else np.zeros(0, np.int64)
    return np.where(last >= start, values[np.maximum(last, 0)], before)


def advance(new: pd.DataFrame, held: pd.DataFrame, state: pd.DataFrame, largest: int | None, last: bool) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """One batch of many clients: (applied, rejected, still held, state).

    new and held: client, n, day, change, op, city, balance. state: client, next, city, balance, one
    row a client that occurs. largest: the largest day of earlier batches, or None. last: everything held is applied.
    """
    at = pd.Index(state.client)
    following = state.next.to_numpy(np.int64).copy()
    held = held.assign(c=at.get_indexer(held.client)).sort_values(["c", "n"], kind="stable", ignore_index=True)
    c, n = held.c.to_numpy(), held.n.to_numpy(np.int64)
    # Jumps: of each client all runs up to the last one with a row that is due.
    opens = _first(c)
    before = np.where(opens, following[c] if len(c) else 0, np.append(0, n[:-1] + 1) if len(n) else 0)
    run = np.cumsum(opens | (n != before)) if len(n) else np.zeros(0, np.int64)
    due = np.ones(len(n), bool) if last else (held.day.to_numpy(np.int64) + WAIT <= largest) if largest is not None else np.zeros(len(n), bool)
    goes = np.zeros(len(n), bool)
    if len(n):
        ends = np.maximum.reduceat(np.where(due, run, -1), np.flatnonzero(opens))
        goes = run <= ends[np.cumsum(opens) - 1]
    jumped = held[goes].assign(missed=(n - before)[goes])
    np.maximum.at(following, c[goes], n[goes] + 1)
    # The batch's rows: the first of each (client, n) is held, unless it is held already or too low.
    new = new.assign(c=at.get_indexer(new.client), fresh=True)
    if new.duplicated(["c", "n", "day", "change"]).any():
        new = new.sort_values(["op", "city", "balance"], kind="stable", na_position="first")
    both = _stack(held[~goes].assign(fresh=False), new)
    order = np.lexsort([both[k].to_numpy() for k in ("change", "day", "fresh", "n", "c")])
    both = both.iloc[order].reset_index(drop=True)
    c, n = both.c.to_numpy(), both.n.to_numpy(np.int64)
    kept = _first(c, n) & (n >= following[c]) if len(n) else np.zeros(0, bool)
    rejected, both = both[~kept], both[kept].reset_index(drop=True)
    c, n = c[kept], n[kept]
    runs = n == following[c] + np.arange(len(n)) - _since(_first(c))
    np.maximum.at(following, c[runs], n[runs] + 1)
    applied = _stack(jumped, both[runs].assign(missed=0)).sort_values(["c", "n"], kind="stable", ignore_index=True)
    # Attributes after each applied row.
    c, op = applied.c.to_numpy(), applied.op.to_numpy(object)
    start = _since(_first(c))
    whole, gone = np.isin(op, ["I", "D"]), op == "D"
    after = {"next": following}
    for name in ("city", "balance"):
        values, former = applied[name].to_numpy(object), state[name].to_numpy(object).copy()
        some = ~pd.isna(applied[name]).to_numpy()
        values = np.where(gone | ~some, None, values)
        now = _carried(whole | ((op == "U") & some), values, start, former[c] if len(c) else np.zeros(0, object))
        applied[name] = pd.Series(now, dtype=object, index=applied.index)
        former[c] = now  # of repeated clients the last stays
        after[name] = former
    return applied, rejected, both[~runs], state.assign(**after)


def _cents(balance: pd.Series) -> pd.Series:
    return pd.Series(np.floor(100 * balance.astype(float) + 0.5), index=balance.index).astype("Int64")


class Applier(StatefulProcessor):
    """State: held rows by (client, n), and by client the next number, attributes and last applied row.

    A client's last applied row is given out when another follows or at the end, as only then it is
    known whether it is the current one.
    """

    def init(self, handle) -> None:
        self.held = handle.getMapState("held", "client bigint, n bigint", "day bigint, change bigint, op string, city string, balance double")
        self.clients = handle.getMapState("clients", "client bigint", "next bigint, city string, balance double, change bigint, n bigint, op string, batch int, missed bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fed = pd.concat(list(rows), ignore_index=True)
        ticks, new = fed[fed.tick], fed[~fed.tick]
        batch, largest, last = int(ticks.n.iloc[0]), int(ticks.day.iloc[0]), ticks.op.iloc[0] == "last"
        names = ["client", "n", *_HELD]
        stored = [(*k, *v) for k, v in self.held.iterator()]
        known = {k[0]: tuple(v) for k, v in self.clients.iterator()}
        held = pd.DataFrame(stored, columns=names)
        touched = pd.unique(np.concatenate([new.client.to_numpy(np.int64), held.client.to_numpy(np.int64), np.array(list(known) if last else [], np.int64)]))
        blank = (1, None, None, None, None, None, None, None)
        state = pd.DataFrame([(int(c), *known.get(int(c), blank)) for c in touched], columns=["client", "next", "city", "balance", "l_change", "l_n", "l_op", "l_batch", "l_missed"])
        applied, rejected, rest, after = advance(new[names], held, state, largest if largest > -(1 << 40) else None, last)
        nobody = key[0] < 0
        # Last rows of earlier batches, then this batch's: each client's last one stays.
        former = state[state.l_n.notna()]
        former = pd.DataFrame({"client": former.client, "change": former.l_change, "n": former.l_n, "op": former.l_op, "batch": former.l_batch, "missed": former.l_missed, "city": former.city, "balance": former.balance})
        line = _stack(former, applied.assign(batch=batch)[[*former.columns]]).sort_values(["client", "n"], kind="stable", ignore_index=True)
        final = line.client.ne(line.client.shift(-1)).to_numpy(bool) if len(line) else np.zeros(0, bool)
        gives = line[~final] if not last else line
        out = pd.DataFrame({"change_id": gives.change, "client_id": gives.client, "status": "applied", "batch": gives.batch, "missed": gives.missed, "city": gives.city, "cents": _cents(gives.balance), "current": (final & (line.op != "D").to_numpy(bool))[gives.index] if last else False, "n": gives.n})
        no = pd.DataFrame({"change_id": rejected.change, "client_id": rejected.client, "status": "rejected", "batch": batch, "missed": 0, "city": None, "cents": pd.array([None] * len(rejected), "Int64"), "current": False, "n": rejected.n})
        for part in (out, no):
            if len(part):
                part = part.astype({"change_id": "int64", "batch": "int32", "missed": "int64", "n": "int64", "current": bool})
                yield part.assign(client_id=pd.array([None if nobody else int(c) for c in part.client_id], "Int64"))
        before, now = set(zip(held.client, held.n, strict=True)), set(zip(rest.client, rest.n, strict=True))
        for client, n in before - now:
            self.held.removeKey((int(client), int(n)))
        for row in rest[rest.fresh.astype(bool)].itertuples():
            self.held.updateValue((int(row.client), int(row.n)), (int(row.day), int(row.change), *[None if pd.isna(x) else x for x in (row.op, row.city, row.balance)]))
        ends = dict(zip(line.client[final], line[final].itertuples(), strict=True))
        following = dict(zip(after.client, after.next, strict=True))
        for client in pd.unique(applied.client):
            x = ends[client]
            self.clients.updateValue((int(client),), (int(following[client]), *[None if pd.isna(v) else v for v in (x.city, x.balance)], int(x.change), int(x.n), None if pd.isna(x.op) else x.op, int(x.batch), int(x.missed)))


# --- the query ------------------------------------------------------------------------------------


def apply(changes: DataFrame, batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """change_id, client_id, status, batch, missed, city, cents, current, n: what became of each change.

    changes: change_id, client_id, seq, op, valid_at, city, balance and others; see numbered() for
    which rows count. The batches lie in the shared folder and go one by one into a query that is
    started anew for each on one checkpoint; a last start applies what is still held.

    Edge cases: an empty table gives no rows; rows that are equal in all columns are one; null clients are one
    client; rows of one client with the same n, day and change_id are told apart by op, city and balance,
    nulls first; an op that is null or unknown is applied and changes nothing; a balance that is no finite number is null; days
    before the first batch belong to it. Bounded by one client: a client's rows of one batch and what it
    holds meet in its bucket, as narrow columns, since its numbers are one chain.
    """
    spark = changes.sparkSession
    rows = numbered(changes, batches)
    seen = {r.batch: (r.day, r.n) for r in rows.groupBy("batch").agg(F.max("day").alias("day"), F.count("*").alias("n")).collect()}  # a row a batch
    total = sum(n for _, n in seen.values())
    buckets = buckets or max(LEAST_BUCKETS, -(-total // BUCKET_ROWS))
    bucket = F.when(F.col("client_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("client_id"), F.lit(buckets))).cast("int")
    fed = rows.select("batch", bucket.alias("bucket"), F.lit(False).alias("tick"), F.coalesce("client_id", F.lit(0)).alias("client"), "n", "day", F.col("change_id").alias("change"), "op", "city", "balance")
    none = -(1 << 41)
    every = [(b, max([seen[x][0] for x in seen if x < b], default=none), "last" if b > batches else None) for b in range(1, batches + 2)]
    ticks = spark.range(-1, buckets).crossJoin(F.broadcast(spark.createDataFrame(every, "batch int, day bigint, op string")))  # a row a batch
    ticks = ticks.select("batch", F.col("id").cast("int").alias("bucket"), F.lit(True).alias("tick"), F.lit(0).cast("long").alias("client"), F.col("batch").cast("long").alias("n"), "day", F.lit(0).cast("long").alias("change"), "op", F.lit(None).cast("string").alias("city"), F.lit(None).cast("double").alias("balance"))
    base = f"{scratch(spark)}/docquarry-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    files = max(8, total // 5_000_000)
    fed.unionByName(ticks).repartition("batch", F.pmod(F.xxhash64("change", "bucket"), F.lit(files))).write.partitionBy("batch").parquet(f"{base}/staged")
    discard(rows)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{base}/in"))
    with session_with(spark):
        for b in range(1, batches + 2):
            if not fs.rename(path(f"{base}/staged/batch={b}"), path(f"{base}/in/b{b}")):
                raise OSError(f"batch {b} could not be moved to {base}/in")
            read = spark.readStream.schema(_FED).option("recursiveFileLookup", "true").parquet(f"{base}/in")
            done = read.groupBy("bucket").transformWithStateInPandas(Applier(), _OUT, "Append", "None")
            query = done.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(_OUT).parquet(f"{base}/out")
