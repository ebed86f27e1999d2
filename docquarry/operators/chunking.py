"""Chunking: folds of a document's ordered blocks into overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, word_count
from .blocks import parent_section, parent_sections, with_sections

#: Block types that are chunks of their own.
OWN = ("table", "section_header", "subsection_header", "title")
#: The largest number of paragraphs of a chunk, as one number holds it.
MOST = (1 << 31) - 1
_SECTION = "struct<number:string,title:string,hierarchy:array<string>>"
_CHUNK = f"array<struct<text:string,type:string,page:int,confidence:double,section:{_SECTION}>>"


def _fold(blocks: Column, size: int, overlap: int, least: int, own: tuple[str, ...], compat: bool = False) -> Column:
    """Chunks of an array of (text, type, page, confidence, section), in order.

    A body chunk has the section of its last block; with compat, one that a block of another kind ends
    has that block's section.
    """
    chunk = lambda text, kind, page, sure, section: F.array(F.struct(text.alias("text"), kind.alias("type"), page.alias("page"), sure.alias("confidence"), section.alias("section")))
    none, body, zero = F.lit(None).cast(_CHUNK), F.lit("body"), F.lit(0.0)

    def flush(acc: Column, section: Column) -> Column:
        return F.when(F.length(strip(acc["buf"])) > least, chunk(strip(acc["buf"]), body, acc["page"], zero, section)).otherwise(none)

    def step(acc: Column, b: Column) -> Column:
        text = strip(b["text"])
        joined = F.concat_ws("\n", acc["buf"], text)
        full = F.length(joined) >= size
        rest = F.when(F.length(joined) > overlap, F.right(joined, F.lit(overlap)))
        state = lambda buf, page, section, out: F.struct(buf.alias("buf"), page.alias("page"), section.alias("section"), out.alias("out"))
        add = lambda *xs: F.concat(acc["out"], *[F.coalesce(x, F.array().cast(_CHUNK)) for x in xs])
        alone = state(F.lit(None).cast("string"), acc["page"], acc["section"], add(flush(acc, b["section"] if compat else acc["section"]), chunk(text, b["type"], b["page"], b["confidence"], b["section"])))
        emitted = state(rest, b["page"], b["section"], add(chunk(strip(joined), body, b["page"], b["confidence"], b["section"])))
        return F.when(F.coalesce(text, F.lit("")) == "", acc).when(b["type"].isin(*own), alone).when(full, emitted).otherwise(state(joined, b["page"], b["section"], acc["out"]))

    start = F.struct(F.lit(None).cast("string").alias("buf"), F.lit(1).alias("page"), F.lit(None).cast(_SECTION).alias("section"), F.array().cast(_CHUNK).alias("out"))
    return F.aggregate(blocks, start, step, lambda acc: F.concat(acc["out"], F.coalesce(flush(acc, acc["section"]), F.array().cast(_CHUNK))))


def _finished(folded: DataFrame, doc_col: str, sections: bool = False) -> DataFrame:
    """Chunk columns from rows (doc, place, c); chunk_index counts from 0 in each document."""
    section = F.col("c.section")
    named = [section["number"].alias("section_number"), section["title"].alias("section_title"), section["hierarchy"].alias("section_hierarchy"), parent_section(section["number"]).alias("parent_section"), F.when(section.isNotNull(), F.concat_ws(" ", section["number"], section["title"])).alias("section_header")]
    index = (F.row_number().over(Window.partitionBy(doc_col).orderBy("place")) - 1).cast("int")
    return folded.withColumn("chunk_index", index).select(
        doc_col,
        F.concat(F.col(doc_col).cast("string"), F.lit("__c"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "chunk_index",
        F.col("c.page").alias("page_number"),
        F.col("c.text").alias("chunk_text"),
        word_count("c.text").alias("word_count"),
        F.col("c.type").alias("content_type"),
        (F.col("c.type") == "table").alias("has_table"),
        parent_sections(F.col("c.text")).alias("parent_sections"),
        F.col("c.confidence").alias("confidence"),
        *(named if sections else []),
    )


def _blocks_of(blocks: DataFrame, doc_col: str, keys: list[str]) -> DataFrame:
    sure = F.col("confidence").cast("double") if "confidence" in blocks.columns else F.lit(None).cast("double")
    section = F.col("section") if "section" in blocks.columns else F.lit(None).cast(_SECTION)
    held = F.struct("page_number", "block_idx", F.col("text"), F.col("block_type").alias("type"), F.col("page_number").cast("int").alias("page"), sure.alias("confidence"), section.alias("section"))
    return blocks.groupBy(doc_col, *keys).agg(F.sort_array(F.collect_list(held)).alias("blocks"))


def chunk_documents(blocks: DataFrame, size: int = 1000, overlap: int = 200, doc_col: str = "doc_id") -> DataFrame:
    """Chunks across a document's pages: a residue of 20 characters or fewer is dropped.

    blocks: doc_col, page_number, block_idx, text, block_type and, optionally, confidence. A
    document's blocks are one array in one row, so its size is bounded by the document.
    """
    held = _blocks_of(blocks, doc_col, [])
    return _finished(held.select(doc_col, F.posexplode(_fold(F.col("blocks"), size, overlap, 20, OWN)).alias("place", "c")), doc_col)


def chunk_pages(blocks: DataFrame, size: int = 1000, overlap: int = 200, doc_col: str = "doc_id", compat: bool = False) -> DataFrame:
    """Chunks page by page: every residue becomes a chunk at the page's end.

    Classified blocks (with level and section_number) give each chunk its section: section_number,
    section_title, section_hierarchy, parent_section and section_header, the field that searches
    look at. With compat a body chunk before a header has the header's section.
    """
    sections = {"level", "section_number"} <= set(blocks.columns)
    held = _blocks_of(with_sections(blocks, doc_col) if sections else blocks, doc_col, ["page_number"])
    folded = held.select(doc_col, "page_number", F.posexplode(_fold(F.col("blocks"), size, overlap, 0, OWN, compat)).alias("at", "c"))
    return _finished(folded.withColumn("place", F.struct("page_number", "at")), doc_col, sections)


def chunk_lines(docs: DataFrame, size: int = 1000, overlap: int = 200, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk_documents for plain texts: each line is a body block of page 1. No shuffle but the index."""
    one = lambda x: F.struct(x.alias("text"), F.lit("body").alias("type"), F.lit(1).alias("page"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast(_SECTION).alias("section"))
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), one)
    return _finished(docs.select(doc_col, F.posexplode(_fold(lines, size, overlap, 20, OWN)).alias("place", "c")), doc_col)


def pack_paragraphs(paragraphs: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Arrays of paragraphs, one per chunk: a chunk closes when the next paragraph would pass `size`
    (separators don't count), and its longest suffix of `overlap` characters at most opens the next.

    The fold carries the lengths of one chunk's paragraphs and, as one number each, the places of cuts,
    since what it carries is copied at every step. Texts are taken from `paragraphs` at the end, one
    by one: it should be a column of the rows, not an expression.
    """
    none = F.array().cast("array<int>")
    cut = lambda a: F.array(F.shiftleft(a["first"].cast("bigint"), 31) + F.size(a["lens"]))
    state = lambda a, first, lens, total, out: F.struct(first.alias("first"), lens.alias("lens"), total.alias("total"), out.alias("out"))

    def suffix(lens: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("total"), F.lit(True).alias("open"))

        def add(a: Column, x: Column) -> Column:
            fits = a["open"] & (a["total"] + x <= overlap)
            return F.struct(F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(fits, a["total"] + x).otherwise(a["total"]).alias("total"), fits.alias("open"))

        return F.aggregate(F.reverse(lens), zero, add)

    def step(a: Column, p: Column) -> Column:
        n = F.length(p)

        over = (a["total"] + n > size) & (F.size(a["lens"]) > 0)
        kept = suffix(a["lens"])
        lens = F.concat(F.slice(a["lens"], F.size(a["lens"]) - kept["n"] + 1, kept["n"]), F.array(n))
        after = state(a, a["first"] + F.size(a["lens"]) - kept["n"], lens, kept["total"] + n, F.concat(a["out"], cut(a)))
        return F.when(over, after).otherwise(state(a, a["first"], F.concat(a["lens"], F.array(n)), a["total"] + n, a["out"]))

    start = F.struct(F.lit(0).alias("first"), none.alias("lens"), F.lit(0).alias("total"), F.array().cast("array<bigint>").alias("out"))
    cuts = F.aggregate(paragraphs, start, step, lambda a: F.when(F.size(a["lens"]) > 0, F.concat(a["out"], cut(a))).otherwise(a["out"]))
    first = lambda c: F.shiftright(c, 31).cast("int")
    return F.transform(cuts, lambda c: F.transform(F.sequence(first(c), first(c) + c.bitwiseAND(F.lit(MOST)).cast("int") - 1), lambda i: F.get(paragraphs, i)))


def chunk_paragraphs(docs: DataFrame, size: int = 1000, overlap: int = 200, doc_col: str = "doc_id", text_col: str = "text", separator: str = r"\n\s*\n") -> DataFrame:
    """doc_col, chunk_index, n_paragraphs, chunk_text of the paragraph packer."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), separator), strip), lambda p: p != "")
    # An array of one element makes the paragraphs a column, which is not split again for each of them.
    held = docs.select(doc_col, F.explode(F.array(parts)).alias("__ps"))
    packed = held.select(doc_col, F.posexplode(pack_paragraphs(F.col("__ps"), size, overlap)).alias("chunk_index", "ps"))
    return packed.select(doc_col, "chunk_index", F.size("ps").cast("long").alias("n_paragraphs"), F.array_join("ps", "\n\n").alias("chunk_text"))


def embedding_text(chunks: DataFrame) -> Column:
    """Text to embed: sections, a mark for tables or the kind in title case, then the text."""
    kind = F.when(F.col("has_table"), "[Table]").when(F.coalesce(F.col("content_type"), F.lit("body")) != "body", F.concat(F.lit("["), F.initcap(F.replace(F.col("content_type"), F.lit("_"), F.lit(" "))), F.lit("]")))
    sections = F.col("parent_sections") if "parent_sections" in chunks.columns else F.array().cast("array<string>")
    named = F.when(F.size(sections) > 0, F.concat(F.lit("[Sections: "), F.array_join(sections, ", "), F.lit("]")))
    return F.concat_ws(" ", named, kind, F.col("chunk_text"))


def merge_intervals(intervals: DataFrame, key: str, start: str, end: str, kind: str | None = None) -> DataFrame:
    """Merge overlapping and touching intervals of a key; the first interval's kind stays."""
    order = Window.partitionBy(key).orderBy(start, end, *[kind] * bool(kind))
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.coalesce(F.col(start) > reach, F.lit(True)), 1).otherwise(0)
    island = intervals.withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = [F.min_by(kind, F.struct(start, end)).alias(kind)] if kind else []
    return island.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged"), *first).drop("__island")


def inside(position: Column, intervals: Column) -> Column:
    """Whether a position lies in one of an array of half-open (start, end) structs."""
    return F.exists(intervals, lambda x: (x["start"] <= position) & (position < x["end"]))


def next_interval(position: Column, intervals: Column) -> Column:
    """The first interval that starts after a position, or null."""
    return F.try_element_at(F.array_sort(F.filter(intervals, lambda x: x["start"] > position)), F.lit(1))
