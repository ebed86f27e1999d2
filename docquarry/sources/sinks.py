"""Sinks: chunk datasets with upsert, manifests, training files."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Folders that a dataset's rows are dealt to by key, their column, and the mark of a next state that is whole.
BUCKETS, PART, READY = 16, "key_bucket", "_READY"


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _places(spark: SparkSession, path: str):
    """The file system, a dataset's folder, and those of its next and its former state."""
    fs, place = _fs(spark, path)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return fs, place, make(f"{path.rstrip('/')}.next"), make(f"{path.rstrip('/')}.former")


def _move(fs, source, target) -> None:
    try:
        done = fs.rename(source, target)
    except Py4JJavaError as e:
        raise OSError(f"{source} could not be moved to {target}") from e
    if not done:
        raise OSError(f"{source} could not be moved to {target}")


def _parts(fs, place) -> dict[int, object]:
    """The bucket folders of a dataset, by number."""
    found = [x.getPath() for x in fs.listStatus(place)] if fs.exists(place) else []
    return {int(x.getName().split("=", 1)[1]): x for x in found if x.getName().startswith(f"{PART}=")}


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a swap that was cut off. Writers call it; readers only where the dataset is missing."""
    fs, place, after, before = _places(spark, path)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(place):
        if fs.exists(make(after, "_SUCCESS")):
            _move(fs, after, place)
        elif fs.exists(before):
            _move(fs, before, place)
    elif fs.exists(make(after, READY)):
        _swap_parts(spark, path)
    for left in (after, before):
        if fs.exists(left):
            fs.delete(left, True)


def _swap_parts(spark: SparkSession, path: str) -> None:
    """Move each bucket of the next state in, and its former one out; may be done over."""
    fs, place, after, before = _places(spark, path)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(before)
    for part in _parts(fs, after).values():
        old = make(place, part.getName())
        if fs.exists(old):
            _move(fs, old, make(before, part.getName()))
        _move(fs, part, old)


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        recover(spark, path)
    return fs.exists(place)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a dataset: those before a running upsert, or after one whose new buckets are all written.

    It changes nothing while the dataset is there, so a reader never meddles with a writer. A read that was
    planned before a swap and runs after it may miss files and has to be planned anew.
    """
    fs, place, after, _ = _places(spark, path)
    if not fs.exists(place):
        recover(spark, path)
    parts = _parts(fs, place)
    if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(after, READY)):
        parts |= _parts(fs, after)
    if not parts:
        return spark.read.parquet(path)
    schema = spark.read.parquet(path).drop(PART).schema
    return spark.read.schema(schema).parquet(*[x.toString() for x in parts.values()])


def create(spark: SparkSession, path: str, schema: str) -> bool:
    """Make an empty dataset; False, and nothing done, if there is one."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    """The last row of each key by `order`; aggregates, so a hot key needs no sort."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("__key")).agg(best.alias("__row")).select("__row.*")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't new, and the new rows (whole rows win; columns may be missing)."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str = "chunk_id", prune_by: str | None = None, order: str | None = None, buckets: int = BUCKETS, drop: DataFrame | None = None) -> None:
    """Full-row upsert by key into a Parquet dataset, which lies in folders by a hash of the key.

    Only buckets that new rows or pruned ones fall into are read and written; the others keep their
    files. Of rows that repeat a key in `new` one stays: the last by `order`, else any. With prune_by (a
    file or document column), old rows of the groups that `new` has are dropped first, so a file that
    shrank leaves no stale chunks; drop (of that column) names more groups to drop. New buckets are written beside the dataset and moved in when all are
    there: a failed write leaves the old rows, and a swap that was cut off is finished by the next writer,
    while readers see the new state. One writer at a time. New columns rewrite all buckets.
    """
    new = latest(new, key, order) if order else new.dropDuplicates([key])
    place_of = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    recover(spark, path)
    fs, place, after, before = _places(spark, path)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = lambda df, to: df.withColumn(PART, place_of).write.partitionBy(PART).parquet(to)
    if not fs.exists(place):
        store(new, path)
        return
    old = current(spark, path)
    groups = new.select(prune_by) if prune_by else None
    groups = groups.unionByName(drop.select(prune_by)).distinct() if drop is not None and prune_by else groups
    kept = lambda df: df.join(groups, prune_by, "left_anti") if prune_by else df
    wide = set(new.columns) - set(old.columns)
    if not _parts(fs, place) or wide:
        store(merged(kept(old), new, key), after.toString())
        _move(fs, place, before)
        _move(fs, after, place)
    else:
        hit = new.select(place_of.alias("b"))
        if prune_by:
            hit = hit.unionByName(old.join(groups, prune_by, "left_semi").select(place_of.alias("b")))
        touched = [r.b for r in hit.distinct().collect()]  # a row a bucket
        parts = _parts(fs, place)
        lying = [parts[b].toString() for b in touched if b in parts]
        held = spark.read.schema(old.schema).parquet(*lying) if lying else spark.createDataFrame([], old.schema)
        store(merged(kept(held), new, key), after.toString())
        for b in touched:  # a bucket that lost all rows becomes an empty folder
            fs.mkdirs(make(after, f"{PART}={b}"))
        fs.mkdirs(make(after, READY))
        _swap_parts(spark, path)
        fs.delete(after, True)
    fs.delete(before, True)


def reset(spark: SparkSession, path: str) -> None:
    """Remove one dataset, and only that."""
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def manifest(chunks: DataFrame, failed: DataFrame | None, folder: str, seconds: float, config: dict[str, str]) -> DataFrame:
    """One row: folder, date, seconds, counts, failed files (path, error) and settings."""
    spark = chunks.sparkSession
    stats = chunks.agg(F.count("*").cast("int").alias("total_chunks"), F.count_if("has_table").cast("double").alias("t"), F.avg("confidence").alias("c") if "confidence" in chunks.columns else F.lit(None).cast("double").alias("c"))
    bad = failed if failed is not None else spark.createDataFrame([], "path string, error string")
    quarantine = bad.agg(F.collect_list(F.struct(F.col("path").alias("file"), "error")).alias("failed_pdfs"))  # bounded by failures
    settings = F.map_from_arrays(F.array(*map(F.lit, config)), F.array(*[F.lit(str(v)) for v in config.values()])) if config else F.create_map().cast("map<string,string>")
    return stats.crossJoin(quarantine).select(  # one row each
        F.lit(folder).alias("folder_path"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("extraction_date"),
        F.lit(float(seconds)).alias("processing_time_seconds"),
        "total_chunks",
        F.create_map(F.lit("tables"), F.col("t"), F.lit("avg_confidence"), F.coalesce("c", F.lit(0.0))).alias("stats"),
        "failed_pdfs",
        settings.alias("config"),
    )


def write_json(rows: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON lines, one file a partition."""
    (rows.select(*columns) if columns else rows).write.mode(mode).json(path)


def write_embedded(chunks: DataFrame, path: str, model: str, dims: int) -> None:
    """A copy of embedded chunks that says which model made the vectors."""
    chunks.withColumn("embedding_model", F.lit(model)).withColumn("embedding_dims", F.lit(dims)).write.parquet(path)


def write_pairs(rows: DataFrame, path: str, metadata: bool = False) -> None:
    """Training pairs; without metadata only anchor, positive and label."""
    write_json(rows, path, None if metadata else ["anchor", "positive", "label"])


def write_splits(rows: DataFrame, path: str) -> None:
    """train and test as JSON lines, from a column `split`."""
    rows.write.partitionBy("split").json(path)


def last_rows(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")
