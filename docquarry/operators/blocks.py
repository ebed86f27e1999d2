"""Block classification, section headers and section hierarchy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Header patterns in order, with their kind; all ignore case.
HEADERS = (
    (r"^(\d{1,2})\s+([A-Z][a-zA-Z\s]{2,50})$", "major"),
    (r"^(\d{1,2}\.\d{1,2})\s+([A-Z][a-zA-Z\s]{2,60})$", "sub"),
    (r"^(\d{1,2}\.\d{1,2}\.\d{1,2})\s+([A-Z][a-zA-Z\s]{2,60})$", "subsub"),
    (r"^(Appendix\s+[A-Z])\s*[-:]?\s*(.{0,60})$", "appendix"),
    (r"^(Annex\s+[A-Z0-9])\s*[-:]?\s*(.{0,60})$", "appendix"),
    (r"^(Chapter\s+\d{1,2})\s*[-:]?\s*(.{2,60})$", "major"),
    (r"^(Section\s+\d{1,2})\s*[-:]?\s*(.{2,60})$", "major"),
)
#: The four patterns of the structured parser, with their level.
PARSER_HEADERS = (
    (r"^(\d{1,2})\s+([A-Z][a-zA-Z\s]{2,50})$", 1),
    (r"^(\d{1,2}\.\d{1,2})\s+([A-Z][a-zA-Z\s]{2,60})$", 2),
    (r"^(\d{1,2}\.\d{1,2}\.\d{1,2})\s+(.{2,60})$", 3),
    (r"^(Appendix\s+[A-Z])\s*[-:]?\s*(.{0,60})$", 1),
)
#: Units after a leading number that are no headers; then the other exclusions.
UNITS = ("Hz|kHz|MHz|GHz", "V|kV|mV", "A|mA|kA", "W|kW|MW", "mm|cm|m|km", "°|degrees?|C|F")
OTHER_EXCLUSIONS = (
    r"^\d+\.\d+\.\d+\s+\w",
    r"^\d+\s+(of|de|from|to|and|or|the|a|an)\s",
    r"^\d+\.\d+\s+(of|de|from|to|and|or|the|a|an|is|are|was|were|shall|should|must|may)\s",
)
LEVELS = {"major": 1, "appendix": 1, "sub": 2, "subsub": 3}
#: Captions of tables, and what page headers and footers say.
CAPTION = r"(?i)^((table|tabela)\s+\d+|tab\.\s*\d+)"
FOOTER_WORDS = ("confidential", "internal", "uncontrolled", "copyright", "©", "página", "all rights reserved", "proprietary", "draft", "transmission", "electricity networks")


def exclusions(compat: bool = False) -> tuple[str, ...]:
    """Patterns that rule a header out. compat keeps units without a word border and the rule that
    hides three-level numbers; the default needs the unit to end there and keeps such numbers."""
    if compat:
        return tuple(rf"^\d+\s*({u})" for u in UNITS) + OTHER_EXCLUSIONS
    return tuple(rf"^\d+\s*({u})(?![\p{{L}}])" for u in UNITS) + OTHER_EXCLUSIONS[1:]


def _any(x: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [x.rlike(p) for p in patterns])


def _first(x: Column, patterns, value) -> Column:
    out = F
    for p, kind in patterns:
        out = out.when(x.rlike("(?i)" + p), value(p, kind))
    return out


def section_header(x: Column, compat: bool = False) -> Column:
    """struct(kind, number, title, level) if x is a section header, else null."""
    text = strip(x)
    found = _first(text, HEADERS, lambda p, kind: F.struct(F.lit(kind).alias("kind"), strip(F.regexp_extract(text, "(?i)" + p, 1)).alias("number"), strip(F.regexp_extract(text, "(?i)" + p, 2)).alias("title"), F.lit(LEVELS[kind]).alias("level")))
    ok = F.length(text).between(3, 80) & ~text.rlike(r"^\p{Ll}") & ~_any(text, ["(?i)" + p for p in exclusions(compat)])
    return F.when(ok, found)


def parser_header(x: Column) -> Column:
    """struct(number, title, level) by the structured parser's rules, else null."""
    text = strip(x)
    found = _first(text, PARSER_HEADERS, lambda p, level: F.struct(strip(F.regexp_extract(text, "(?i)" + p, 1)).alias("number"), strip(F.regexp_extract(text, "(?i)" + p, 2)).alias("title"), F.lit(level).alias("level")))
    return F.when(F.length(text).between(3, 80), found)


def is_caption(x: Column) -> Column:
    return strip(x).rlike(CAPTION)


def is_page_element(x: Column) -> Column:
    """Page numbers, and lines of ten words at most with a footer's word."""
    low = F.lower(strip(x))
    words = F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    says = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in FOOTER_WORDS])
    return low.rlike(r"^page\s*\d+") | low.rlike(r"^\d+\s*(of|de)\s*\d+$") | low.rlike(r"^\d{1,4}$") | ((words <= 10) & says)


def _block_type(text: Column, header: Column, page: Column, first_page: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    title = first_page & (words <= 8) & (F.length(text) > 3) & text.rlike(r"^\p{Lu}") & ~page
    return (
        F.when(is_caption(text), "table_header")
        .when(header["level"] == 1, "section_header")
        .when(header.isNotNull(), "subsection_header")
        .when(title, "title")
        .when(page, "page_element")
        .otherwise("body")
    )


def block_type(x: Column, first_page: Column, compat: bool = False) -> Column:
    """table_header, section_header, subsection_header, title, page_element or body, in this order."""
    return _block_type(strip(x), section_header(x, compat), is_page_element(strip(x)), first_page)


def parser_block_type(x: Column, item_type: Column) -> Column:
    """Types of the structured parser: tables, headers by level, titles, else body."""
    header = parser_header(x)
    return (
        F.when(item_type == "table", "table")
        .when(header["level"] == 1, "section_header")
        .when(header.isNotNull(), "subsection_header")
        .when(F.lower(item_type).rlike("heading|title|header"), "title")
        .otherwise("body")
    )


def classify(blocks: DataFrame, text_col: str = "text", page_col: str = "page_number", compat: bool = False) -> DataFrame:
    """Add block_type, section_number and level; drop blank blocks and page elements."""
    # Each pattern is matched once a row: flags are elements of one array, which nothing looks through.
    once = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))
    out = once(blocks, "__text", strip(text_col)).where("__text <> ''")
    text = F.col("__text")
    out = once(out, "__found", F.struct(section_header(text, compat).alias("header"), is_page_element(text).alias("page")))
    header, page = F.col("__found.header"), F.col("__found.page")
    out = once(out, "block_type", _block_type(text, header, page, F.col(page_col) == 1)).where("block_type <> 'page_element'")
    is_header = F.col("block_type").isin("section_header", "subsection_header")
    out = out.withColumn("section_number", F.when(is_header, header["number"])).withColumn("level", F.when(is_header, header["level"]).otherwise(0))
    return out.drop("__text", "__found")


def hierarchy(blocks: DataFrame, doc_col: str = "doc_id", order_col: str = "block_idx") -> DataFrame:
    """Per header, the stack of headers above it: cut to level - 1 entries, then pushed.

    The fold runs over a document's headers alone, which are few; blocks themselves stay rows.
    """
    heads = blocks.where("level > 0").groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct(order_col, "level", "section_number", "text"))).alias("heads"))
    entry = lambda h: F.concat_ws(" ", h["section_number"], strip(F.regexp_replace(strip(h["text"]), r"(?i)^[\d.A-Z]+\s*", "")))
    empty = F.array().cast("array<array<string>>")

    def push(acc: Column, h: Column) -> Column:
        top = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.array().cast("array<string>"))
        kept = F.slice(top, F.lit(1), F.least(h["level"] - 1, F.size(top)))
        return F.concat(acc, F.array(F.concat(kept, F.array(entry(h)))))

    stacks = heads.withColumn("stacks", F.aggregate("heads", empty, push))
    return stacks.select(doc_col, F.explode(F.arrays_zip("heads", "stacks")).alias("x")).select(doc_col, F.col(f"x.heads.{order_col}").alias(order_col), F.col("x.heads.section_number").alias("section_number"), F.col("x.stacks").alias("section_hierarchy"))


def with_sections(blocks: DataFrame, doc_col: str = "doc_id", compat: bool = False) -> DataFrame:
    """Add `section` to classified blocks: struct(number, title, hierarchy) of the last header at or before each.

    An as-of lookup in reading order (page_number, block_idx): headers get their stack from
    hierarchy(), other blocks carry it on; blocks before the first header have none. One document's
    rows meet in one window, so memory is bounded by a document's blocks.
    """
    placed = blocks.withColumn("__at", F.struct("page_number", "block_idx"))
    stacks = hierarchy(placed, doc_col, "__at").select(doc_col, "__at", "section_hierarchy")
    title = strip(section_header(F.col("text"), compat)["title"])
    own = F.struct(F.col("section_number").alias("number"), title.alias("title"), F.col("section_hierarchy").alias("hierarchy"))
    met = placed.join(stacks, [doc_col, "__at"], "left").withColumn("__own", F.when(F.col("section_hierarchy").isNotNull(), own))
    before = Window.partitionBy(doc_col).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("section", F.last("__own", ignorenulls=True).over(before)).drop("__at", "__own", "section_hierarchy")


def parent_sections(x: Column) -> Column:
    """First components of all dotted numbers in x, distinct, by number."""
    found = F.array_distinct(F.regexp_extract_all(x, F.lit(r"\b(\d+)\.\d+(?:\.\d+)*\b"), F.lit(1)))
    return F.transform(F.array_sort(F.transform(found, lambda s: F.struct(F.length(F.regexp_replace(s, "^0+", "")).alias("n"), F.regexp_replace(s, "^0+", "").alias("v"), s.alias("s")))), lambda t: t["s"])


def parent_section(x: Column) -> Column:
    """'1.2.3' gives '1.2'; no dot gives null."""
    return F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.[^.]*$", ""))


def nth_table(blocks: DataFrame, tables: DataFrame, doc_col: str = "doc_id", page_col: str = "page_number", order_col: str = "block_idx") -> DataFrame:
    """The i-th table_header of a page with the i-th table of that page, or an empty table."""
    nth = F.row_number().over(Window.partitionBy(doc_col, page_col).orderBy(order_col))
    heads = blocks.where("block_type = 'table_header'").withColumn("nth", nth)
    return heads.join(tables, [doc_col, page_col, "nth"], "left")


def confidence(blocks: DataFrame, *by: str) -> DataFrame:
    """Mean confidence without tables, 0 where there is none, and counts of blocks and kinds."""
    text = F.col("block_type") != "table"
    kinds = {"n_tables": ["table", "table_header"], "n_sections": ["section_header", "subsection_header"]}
    return blocks.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(text, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"),
        F.count("*").alias("n_blocks"),
        *[F.count_if(F.col("block_type").isin(v)).alias(k) for k, v in kinds.items()],
    )
