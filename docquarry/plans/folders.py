"""A folder of files kept up to date as a chunk dataset: only new, changed and failed files are converted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..session import materialize
from ..sources import readers, sinks


def changed(spark: SparkSession, folder: str, ledger: str) -> tuple[DataFrame, DataFrame]:
    """(files to convert with content and digest, paths that are gone), against the ledger of the last run.

    Paths, lengths and times are compared first, without reading a file. Of those that differ, are new or
    failed before the content is read; one whose digest is the ledger's was only touched.
    """
    now = readers.pdf_files(spark, folder, times=True)
    if not sinks.exists(spark, ledger):
        known = spark.createDataFrame([], "path string, length bigint, modified timestamp, digest string, error string")
    else:
        known = sinks.current(spark, ledger)
    before = known.select("path", F.col("length").alias("__length"), F.col("modified").alias("__modified"), F.col("digest").alias("__digest"), F.col("error").alias("__error"))
    met = now.join(before, "path", "left")
    same = (F.col("length") == F.col("__length")) & (F.col("modified") == F.col("__modified")) & F.col("__error").isNull()
    suspects = met.where(~F.coalesce(same, F.lit(False))).select("path", "__digest", "__error")
    read = readers.pdf_files(spark, folder, content=True, times=True).join(suspects, "path").withColumn("digest", F.sha2("content", 256))
    return read, known.join(now.select("path"), "path", "left_anti").select("path")


def update(spark: SparkSession, folder: str, dataset: str, ledger: str, make: Callable[[], Callable[[bytes], list[dict]]], size: int = 1000, overlap: int = 200) -> DataFrame:
    """One run over a folder: chunks of new and changed files are upserted, those of files that are gone go.

    A file that fails is kept in the ledger with its error and tried again in the next run; its old
    chunks stay. The chunks come before the ledger, so a run that is cut off is done over. Returns what
    this run looked into: path and outcome (converted, failed, touched or gone).
    """
    found, gone = changed(spark, folder, ledger)
    found = materialize(found, "files")
    touched = F.coalesce((F.col("digest") == F.col("__digest")) & F.col("__error").isNull(), F.lit(False))
    items, failed = readers.convert(found.where(~touched), make, readers.PARSED)
    blocks = readers.parsed_blocks(items.withColumn("doc_id", F.col("path")))
    chunks = chunking.chunk_documents(blocks, size, overlap)
    gone = materialize(gone, "gone")
    if sinks.exists(spark, dataset) or not chunks.isEmpty():
        sinks.upsert(spark, dataset, chunks, "chunk_id", prune_by="doc_id", drop=gone.select(F.col("path").alias("doc_id")))
    errors = failed.select("path", F.col("error").alias("__now"))
    rows = found.drop("content").join(errors, "path", "left").select("path", "length", "modified", "digest", F.col("__now").alias("error"), F.when(touched, "touched").when(F.col("__now").isNotNull(), "failed").otherwise("converted").alias("outcome"))
    rows = materialize(rows, "outcomes")
    sinks.upsert(spark, ledger, rows.drop("outcome"), "path", drop=gone, prune_by="path")
    return rows.select("path", "outcome").unionByName(gone.select("path", F.lit("gone").alias("outcome")))
