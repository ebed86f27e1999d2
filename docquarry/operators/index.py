"""A stored search index: postings with places by term bucket, in segments that are only ever added.

Layout under a folder, all Parquet:
  postings/segment=<n>/bucket=<b>   term, docs, tfs, places (of all docs in turn), sorted by term
  documents/segment=<n>             doc, dl, size
A search reads only the buckets of its terms. A document that is added again, or removed, counts by its
newest segment; older postings of it are passed over. A row is a term in BLOCK_DOCS documents at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, path_exists
from . import search, shelves

BUCKETS, BLOCK_DOCS = 64, 2_500
_DOCUMENTS = "segment int, doc bigint, dl bigint, gone boolean"
_BLOCK = "term string, docs array<bigint>, tfs array<int>, places array<int>"
_POSTINGS = f"segment int, bucket int, {_BLOCK}"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of documents (doc, ts) to blocks: a term's documents and places of BLOCK_DOCS documents in one row."""
    for whole in batches:
        for i in range(0, whole.num_rows, BLOCK_DOCS):
            batch = whole.slice(i, BLOCK_DOCS)
            ts = batch.column("ts")
            words = pc.list_flatten(ts).dictionary_encode()
            if not len(words):
                continue
            at, code = pc.list_parent_indices(ts).to_numpy(), words.indices.to_numpy()
            place = np.arange(len(at)) - np.searchsorted(at, at)
            order = np.argsort(code, kind="stable")  # by term, then document, then place
            at, code, place = at[order], code[order], place[order]
            own = np.append(shelves.starts(code, at), len(at))
            term = shelves.starts(code[own[:-1]])
            rows, tokens = pa.array([*term, len(own) - 1], pa.int32()), pa.array([*own[term], len(at)], pa.int32())
            lists = [pa.ListArray.from_arrays(rows, c) for c in (pa.array(batch.column("doc").to_numpy()[at[own[:-1]]]), pa.array(np.diff(own), pa.int32()))]
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[own[term]])), *lists, pa.ListArray.from_arrays(tokens, pa.array(place, pa.int32()))], ["term", "docs", "tfs", "places"])


def _opened(places: bool):
    """Blocks to a row a document, with its places or, without, by their number alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                docs, tf = part.column("docs"), pc.list_flatten(part.column("tfs"))
                row = pc.list_parent_indices(docs)
                out = [part.column("segment").take(row), part.column("term").take(row), pc.list_flatten(docs), pc.cast(tf, pa.int64())]
                names = ["segment", "term", "doc", "tf"]
                if places:
                    out.append(pa.ListArray.from_arrays(pa.array([0, *np.cumsum(tf.to_numpy())], pa.int32()), pc.list_flatten(part.column("places"))))
                    names.append("places")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_DOCUMENTS).parquet(f"{path}/documents")


def _next(spark: SparkSession, path: str) -> int:
    if not path_exists(spark, f"{path}/documents"):
        return 0
    last = spark.read.schema("segment int").parquet(f"{path}/documents").agg(F.max("segment").alias("n")).first().n
    return 0 if last is None else last + 1


def add(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", fold: bool = False, stem: bool = False, buckets: int = BUCKETS) -> int:
    """Add documents as a new segment, replacing those of the same id; returns its number.

    Texts are tokenised once; postings take one shuffle, by bucket and a part of the term's documents, so a
    frequent term isn't one task's. The segment counts once its documents are written, which comes
    last: a segment cut off before is written over. One writer at a time. A null id is left out; of rows
    that repeat an id the one with the largest text in order stays.
    """
    spark = docs.sparkSession
    n = _next(spark, path)
    rows = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max(text_col).alias("text"))
    held = search.tokenised(rows, "doc", "text", fold, stem)
    # Blocks are made where the documents are, before the one shuffle of postings.
    each = held.where("dl > 0").select("doc", "ts").mapInArrow(_blocks, _BLOCK)
    dealt = each.withColumn("bucket", bucket(F.col("term"), buckets)).repartition("bucket", F.pmod(F.xxhash64(F.get("docs", F.lit(0))), F.lit(4)))
    dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/segment={n}")
    held.select("doc", "dl", F.lit(False).alias("gone")).write.mode("overwrite").parquet(f"{path}/documents/segment={n}")
    return n


def remove(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "doc_id") -> None:
    """Take documents out, as a segment without postings."""
    n = _next(spark, path)
    gone = ids.select(F.col(id_col).cast("long").alias("doc")).where("doc is not null").distinct()
    gone.select("doc", F.lit(0).cast("long").alias("dl"), F.lit(True).alias("gone")).write.mode("overwrite").parquet(f"{path}/documents/segment={n}")


def newest(spark: SparkSession, path: str) -> DataFrame:
    """(doc, segment, dl) of the documents that the index holds."""
    last = _documents(spark, path).groupBy("doc").agg(F.max(F.struct("segment", "dl", "gone")).alias("x"))
    return last.where("not x.gone").select("doc", "x.segment", "x.dl")


def collection(spark: SparkSession, path: str) -> DataFrame:
    """One row: n documents and their mean length, without any text."""
    return newest(spark, path).agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))


def postings(spark: SparkSession, path: str, terms: DataFrame, buckets: int = BUCKETS, places: bool = True) -> DataFrame:
    """(segment, term, doc, tf, places) of the query terms (term): their buckets alone are read.

    Segments none of whose documents count any more are not read. Of the others all postings come; those of older
    versions of a document are passed over in the shards, which learn the newest segments from valid().
    """
    asked = terms.select("term").distinct()
    read = [r.bucket for r in asked.select(bucket(F.col("term"), buckets).alias("bucket")).distinct().collect()]  # a row a bucket
    held = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").where(F.col("bucket").isin(read))
    live = [r.segment for r in newest(spark, path).select("segment").distinct().collect()]  # a row a segment
    held = held.where(F.col("segment").isin(live)).join(asked, "term", "left_semi")
    columns = ["segment", "term", "docs", "tfs", *(["places"] if places else [])]
    return held.select(columns).mapInArrow(_opened(places), "segment int, term string, doc bigint, tf bigint" + (", places array<int>" if places else ""))


def valid(spark: SparkSession, path: str, length, shards: int) -> DataFrame:
    """Shelf rows with the newest segment of each document, and length (a column over dl and avgdl)."""
    rows = newest(spark, path).crossJoin(F.broadcast(collection(spark, path)))  # one row
    return shelves.pack(rows.select("doc", F.lit(0).cast("long").alias("tid"), F.col("segment").alias("x"), length.alias("y")), shards, kind=shelves.VALID)


def _shards(spark: SparkSession, path: str) -> int:
    row = collection(spark, path).first()  # one row
    return shelves.shards_of(row.n * (row.avgdl or 0.0))


def bm25(spark: SparkSession, path: str, questions: DataFrame, id_col: str, text_col: str, boost: float = 1.0, fold: bool = False, stem: bool = False) -> DataFrame:
    """(qid, doc, score) from the stored postings: all scored pairs. best() brings the best alone."""
    terms = search.query_terms(questions, id_col, text_col, fold, stem)
    held = postings(spark, path, terms, places=False).join(newest(spark, path), ["doc", "segment"])
    return search.bm25_scores(held, collection(spark, path), terms, boost)


def best(spark: SparkSession, path: str, questions: DataFrame, id_col: str, text_col: str, k: int, boost: float = 1.0, fold: bool = False, stem: bool = False) -> DataFrame:
    """(qid, doc, score, rank): the k best documents by bm25(), from shards that questions pass."""
    terms, n, tid = search.query_terms(questions, id_col, text_col, fold, stem), _shards(spark, path), F.xxhash64("term").alias("tid")
    entries = postings(spark, path, terms, places=False).select("doc", tid, F.col("tf").alias("x"), F.col("segment").alias("y"))
    shelf = shelves.pack(entries, n).unionByName(valid(spark, path, shelves.norm(F.col("dl"), F.col("avgdl")), n))
    shelf = materialize(shelf, "shelf")
    asks = terms.select("qid", tid).join(shelves.frequencies(shelf, n), "tid").crossJoin(F.broadcast(collection(spark, path)))  # one row
    return search.top(shelves.best(shelf, asks.select("qid", "tid", (boost * search.idf()).alias("x")), n, k), k)


def phrase(spark: SparkSession, path: str, questions: DataFrame, id_col: str, text_col: str, slop: int = search.SLOP, boost: float = search.BOOST_PHRASE, fold: bool = False, stem: bool = False) -> DataFrame:
    """(qid, doc, score) of documents with a question's terms within `slop` of their order, from stored places."""
    asked, n = search.asked_places(questions, id_col, text_col, fold, stem), _shards(spark, path)
    entries = postings(spark, path, asked).select("doc", F.xxhash64("term").alias("tid"), F.explode("places").alias("x"), F.col("segment").alias("y"))
    shelf = shelves.pack(entries, n).unionByName(valid(spark, path, F.col("dl"), n))
    return search.phrases_of(shelf, n, asked, collection(spark, path), slop, boost).select("qid", "doc", "score")
