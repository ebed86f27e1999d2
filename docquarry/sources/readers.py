"""Sources: files, parser and recogniser output, manifests, datasets, evaluation files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_key, strip
from ..operators.blocks import parser_block_type, parser_header
from ..operators.tables import parsed_cells, render_grid
from ..session import materialize

ITEM = "struct<text:string,confidence:double,bbox:array<int>>"
PARSED = "item_type string, page_no int, text string, cells array<struct<row:int,col:int,text:string>>"


def pdf_files(spark: SparkSession, path: str, content: bool = False, times: bool = False) -> DataFrame:
    """All PDF files under a path, whatever the case of their ending; an empty result is no error.

    Without content no file is opened. times adds when each was modified.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    return files.select("path", file_key("path").alias("file_name"), folder.alias("source_folder"), "length", *["content"] * content, *[F.col("modificationTime").alias("modified")] * times)


def convert(files: DataFrame, make: Callable[[], Callable[[bytes], list[dict]]], schema: str) -> tuple[DataFrame, DataFrame]:
    """Run an external converter over files with content; one bad file never stops the job.

    make() builds the converter once per task; it turns a file's bytes into rows of `schema`. The
    result is (items, failed): rows with path, file_name and idx, and a quarantine of path and error.
    """
    names = [part.strip().split(" ")[0] for part in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = make()
        for frame in batches:
            for row in frame.itertuples(index=False):
                try:
                    items, error = worker(bytes(row.content)), None
                except Exception as e:  # noqa: BLE001  kept as data
                    items, error = [], f"{type(e).__name__}: {e}"
                out = [{"path": row.path, "file_name": row.file_name, "idx": i, "error": None} | {k: x.get(k) for k in names} for i, x in enumerate(items)]
                yield pd.DataFrame(out or [{"path": row.path, "file_name": row.file_name, "idx": None, "error": error or ""} | dict.fromkeys(names)])

    # Stored once: both results are read from it, and a file is converted once.
    done = materialize(files.mapInPandas(run, f"path string, file_name string, idx int, error string, {schema}"), "converted")
    return done.where("idx is not null").drop("error"), done.where("idx is null and error <> ''").select("path", F.col("error"))


def recognised_items(pages: DataFrame, texts: str = "texts", scores: str = "scores", polys: str = "polys") -> DataFrame:
    """Explode parallel arrays of a text recogniser into items: text, confidence, bbox, idx.

    Blank texts go, a missing score is 0.5, a polygon becomes its least and greatest coordinates
    (truncated), and one without four points or with a missing number becomes null.
    """
    out = pages.select("*", F.posexplode(F.arrays_zip(F.col(texts).alias("t"), F.col(scores).alias("s"), F.col(polys).alias("p"))).alias("idx", "__x"))
    side = lambda k: F.transform("__x.p", lambda q: F.get(q, F.lit(k)).cast("double"))
    whole = F.col("__x.p").isNotNull() & (F.size("__x.p") >= 2) & F.forall("__x.p", lambda q: (F.size(q) >= 2) & F.get(q, F.lit(0)).isNotNull() & F.get(q, F.lit(1)).isNotNull())
    box = F.transform(F.array(F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(0)), F.array_max(side(1))), lambda v: v.cast("int"))
    out = out.select("*", F.col("__x.t").alias("text"), F.coalesce(F.col("__x.s").cast("double"), F.lit(0.5)).alias("confidence"), F.when(whole, box).alias("bbox"))
    return out.where(strip("text") != "").drop("__x", texts, scores, polys)


def parsed_blocks(items: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Blocks from a structured parser's items: doc, page_number, block_idx, text, block_type, ...

    A page is the parser's number plus one, 1 where it has none; a table is its markdown and cells;
    empty texts go.
    """
    table = parsed_cells(F.col("cells"))
    shown = render_grid(table["table_data"], table["rows"], table["cols"])
    text = F.when(F.col("item_type") == "table", shown).otherwise(strip("text"))
    header = parser_header(F.col("text"))
    out = items.select(
        doc_col,
        F.coalesce(F.col("page_no") + 1, F.lit(1)).alias("page_number"),
        F.col("idx").alias("block_idx"),
        text.alias("text"),
        parser_block_type(F.col("text"), F.col("item_type")).alias("block_type"),
        F.when(F.col("item_type") != "table", header["number"]).alias("section_number"),
        F.coalesce(F.when(F.col("item_type") != "table", header["level"]), F.lit(0)).alias("level"),
        F.when(F.col("item_type") == "table", table).alias("table_data"),
    )
    return out.where(F.coalesce("text", F.lit("")) != "")


def chunk_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The chunks of manifest files ({..., "chunks": [...]}); a file without chunks gives none."""
    reader = spark.read.option("multiLine", True)
    data = (reader.schema(schema) if schema else reader).json(path)
    return data.select(F.explode("chunks").alias("c")).select("c.*") if "chunks" in data.columns else data.limit(0)


def dataset(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """A JSON dataset: one array a file, or one object a line."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def score_files(spark: SparkSession, paths: dict[int, str], column: str = "cosine-NDCG@10") -> DataFrame:
    """(dim, steps, score) from one CSV per dimension; missing files are left out, a missing column is 0."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = spark.createDataFrame([], "dim int, steps bigint, score double")
    for dim, path in paths.items():
        place = jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(conf).exists(place):
            continue
        rows = spark.read.csv(path, header=True)
        value = F.coalesce(F.col(f"`{column}`").try_cast("double"), F.lit(0.0)) if column in rows.columns else F.lit(0.0)
        steps = F.col("steps").try_cast("bigint") if "steps" in rows.columns else F.lit(0).cast("bigint")
        out = out.unionByName(rows.select(F.lit(dim).alias("dim"), steps.alias("steps"), value.alias("score")))
    return out


def loss_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("step int, epoch double, loss double").option("multiLine", True).json(path)


def html_text(html: Column) -> Column:
    """The visible text of a page: scripts, styles and comments go, blocks end lines, entities decode."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/title)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\x0B\f\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def questions(spark: SparkSession, rows: list[str]) -> DataFrame:
    """A batch of requests as a DataFrame: qid and question."""
    return spark.createDataFrame(list(enumerate(rows)), "qid bigint, question string")
