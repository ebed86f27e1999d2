"""Table grids: region, rows, columns and cells from boxes; rendering as markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Tolerances and limits in pixels, characters and blocks.
ROW_TOLERANCE, COLUMN_TOLERANCE, GAP, PARAGRAPH, CELL, MOST = 15, 30, 100, 100, 200, 51


def region(blocks: Column, caption_top: Column) -> Column:
    """The blocks after a caption that belong to its table: array of (text, bbox), in order.

    The region ends at a gap over 100 px before a long, lower-case or empty text, at a text over 200
    characters, or after 51 blocks; blocks without a box are passed over.
    """
    cells = F.filter(blocks, lambda b: b["bbox"].isNotNull())
    zero = F.struct(F.lit(True).alias("open"), caption_top.cast("int").alias("top"), F.lit(0).alias("n"))

    def step(a: Column, b: Column) -> Column:
        text, top = F.coalesce(b["text"], F.lit("")), F.get(b["bbox"], F.lit(1))
        ends = ((top - a["top"] > GAP) & ((F.length(text) > PARAGRAPH) | text.rlike(r"^\p{Ll}") | (text == ""))) | (F.length(text) > CELL)
        take = a["open"] & ~ends & (a["n"] < MOST)
        return F.struct(take.alias("open"), F.when(take, top).otherwise(a["top"]).alias("top"), (a["n"] + take.cast("int")).alias("n"))

    return F.slice(cells, F.lit(1), F.aggregate(cells, zero, step, lambda a: a["n"]))


def _anchors(values: Column, tolerance: int) -> Column:
    """Anchors of sorted values: a new one where a value is over `tolerance` from the last anchor."""
    empty = F.array().cast("array<int>")

    def step(a: Column, v: Column) -> Column:
        return F.when((F.size(a) == 0) | (v - F.try_element_at(a, F.lit(-1)) > tolerance), F.concat(a, F.array(v))).otherwise(a)

    return F.aggregate(F.array_sort(values), empty, step)


def grid(tables: DataFrame, cells_col: str = "cells", row_tolerance: int = ROW_TOLERANCE, column_tolerance: int = COLUMN_TOLERANCE) -> DataFrame:
    """Add table_data (map "col,row" to text), rows and cols from an array of (text, bbox).

    A cell's row is the anchor of its top edge; its column is the first whose left edge plus the
    tolerance is right of the cell's middle, else the last. Texts of one cell join with a blank.
    """
    cells = F.filter(cells_col, lambda b: b["bbox"].isNotNull())
    tops = F.transform(cells, lambda b: F.get(b["bbox"], F.lit(1)).cast("int"))
    lefts = F.transform(cells, lambda b: F.get(b["bbox"], F.lit(0)).cast("int"))
    out = tables.withColumn("__rows", _anchors(tops, row_tolerance)).withColumn("__cols", _anchors(lefts, column_tolerance))

    def placed(b: Column, i: Column) -> Column:
        x0, y0, x1 = (F.get(b["bbox"], F.lit(k)).cast("int") for k in (0, 1, 2))
        row = F.size(F.filter("__rows", lambda a: a <= y0)) - 1
        middle = (x0 + x1) / 2
        col = F.least(F.size(F.filter("__cols", lambda a: a + column_tolerance <= middle)), F.size("__cols") - 1)
        return F.struct(row.alias("row"), x0.alias("x"), i.alias("i"), col.alias("col"), strip(b["text"]).alias("text"))

    # Cells come by row and, within a row, from left to right.
    out = out.withColumn("__cells", F.array_sort(F.transform(cells, placed)))
    key = lambda c: F.concat_ws(",", c["col"].cast("string"), c["row"].cast("string"))
    keys = F.array_distinct(F.transform("__cells", key))
    values = lambda k: F.array_join(F.transform(F.filter("__cells", lambda c: key(c) == k), lambda c: c["text"]), " ")
    data = F.map_from_arrays(keys, F.transform(keys, values))
    return out.withColumn("table_data", data).withColumn("rows", F.size("__rows")).withColumn("cols", F.size("__cols")).drop("__rows", "__cols", "__cells")


def parsed_cells(cells: Column) -> Column:
    """struct(table_data, rows, cols) from the parser's array of (row, col, text)."""
    keys = F.transform(cells, lambda c: F.concat_ws(",", c["col"].cast("string"), c["row"].cast("string")))
    last = F.array_distinct(keys)
    # A repeated place keeps its last text.
    pick = F.transform(last, lambda k: F.try_element_at(F.transform(F.filter(cells, lambda c: F.concat_ws(",", c["col"].cast("string"), c["row"].cast("string")) == k), lambda c: F.coalesce(c["text"], F.lit(""))), F.lit(-1)))
    most = lambda f: F.coalesce(F.array_max(F.transform(cells, lambda c: c[f])), F.lit(-1)) + 1
    return F.struct(F.map_from_arrays(last, pick).alias("table_data"), most("row").alias("rows"), most("col").alias("cols"))


def table_text(header: Column, data: Column) -> Column:
    """A table as plain text: header, then rows by number, cells by column joined with ' | '."""
    cells = F.array_sort(F.transform(F.map_entries(data), lambda e: F.struct(F.split(e["key"], ",")[1].cast("int").alias("row"), F.split(e["key"], ",")[0].cast("int").alias("col"), e["value"].alias("text"))))
    rows = F.array_distinct(F.transform(cells, lambda c: c["row"]))
    lines = F.transform(rows, lambda r: F.array_join(F.transform(F.filter(cells, lambda c: c["row"] == r), lambda c: c["text"]), " | "))
    return F.array_join(F.concat(F.array(header), lines), "\n")


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _rule(n: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), n), "|"), F.lit("|"))


def render_grid(data: Column, rows: Column, cols: Column) -> Column:
    """A coordinate map as a markdown table; missing cells are empty, row 0 is the header."""
    cell = lambda r, c: F.coalesce(F.try_element_at(data, F.concat_ws(",", c.cast("string"), r.cast("string"))), F.lit(""))
    line = lambda r: _line(F.transform(F.sequence(F.lit(0), cols - 1), lambda c: cell(r, c)))
    body = F.when(rows > 1, F.transform(F.sequence(F.lit(1), F.greatest(rows - 1, F.lit(1))), line)).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat(F.array(line(F.lit(0)), _rule(cols)), body), "\n")
    empty = data.isNull() | (F.size(data) <= 0) | (F.coalesce(rows, F.lit(0)) <= 0) | (F.coalesce(cols, F.lit(0)) <= 0)
    return F.when(empty, "[Empty table]").otherwise(whole)


def render_list(rows: Column, headers: Column) -> Column:
    """An array of maps as a markdown table; the column `source` is left out."""
    names = F.filter(headers, lambda h: h != "source")
    values = lambda r: _line(F.transform(names, lambda h: F.coalesce(F.try_element_at(r, h), F.lit(""))))
    plain = F.array_join(F.transform(rows, lambda r: F.to_json(r)), "\n")
    whole = F.array_join(F.concat(F.array(_line(names), _rule(F.size(names))), F.transform(rows, values)), "\n")
    return F.when(rows.isNull() | (F.size(rows) <= 0), "[Empty table]").when(F.size(names) == 0, plain).otherwise(whole)
