"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

1. quality: documents that the classifier rejects go.
2. near_duplicates: of each group of linked documents the one with the smallest id stays.
3. substrings: words of repeated 13-word windows go; texts that lose none stay as they are.
4. secrets: spans that the scan finds are replaced by a mark.
5. packing: the texts are tokenised and packed into sequences; one row per piece, with its ids.

All stages but the last return the columns of documents, with n_chars brought up to date.

Edge cases, in every stage: an empty table gives an empty result; extra columns pass (all stages but the
last), whatever their names; repeated rows are judged each by itself, and as one document where
documents are compared. A null or empty text is scored as empty, links with nothing, loses nothing and
becomes the end token alone. Rows with a null id are scored, never linked, lose no words, and are packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import jaccard, packing, quality, secrets, substrings
from docquarry.session import materialize, ship

#: Words of a shingle and least similarity in hundredths of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """docs with another text, and the columns that follow from it."""
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the model accepts; it learns from this stage's labelled documents that aren't held out.

    Labels that are null, unclear or of unknown ids don't teach. With fewer than two classes every score is
    the share of label 1, so all documents stay or go together.
    """
    model = quality.train(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links are of five-word shingles and a similarity of 0.8; the values of operator 6 are its own.

    Of a group of linked documents the smallest id stays, with all its rows; null ids stay.
    """
    ship(spark)
    return jaccard.keep_first(docs, shingle=SHINGLE, percent=PERCENT)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 13 that starts in a document with a smaller id too go; ties stay with the smaller."""
    ship(spark)
    return substrings.cut_text(docs).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become a mark, overlapping ones together; a null text stays null."""
    ship(spark)
    found = secrets.redact(docs, hex_runs=True)
    return _with_text(found, F.col("text")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its place in its document and in a sequence, and its ids.

    packing.sequences() puts the pieces of a sequence together for training.
    """
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("substrings", repeated_substrings),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The classifier, the byte-level merges and the packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written and read again."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
