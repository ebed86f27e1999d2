"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each document gets a rate, the copies that the mix takes of it on average. Of all rates that give every
source its target of words, those nearest to one copy each (in relative entropy, none above the cap)
have the form min(cap, exp(tilt * size)), with one tilt a source: the dual variable of the source's
constraint. Newton's iterations find the tilts, each a distributed sum over (source, size) cells; then
rates become whole copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running
from ..session import discard, materialize

#: Weights of the sources in order, repeating; the most copies of a document.
WEIGHTS, CAP = (5, 2, 1), 3
#: Iterations at most, and the relative distance to a target that ends them.
ROUNDS, CLOSE = 60, 1e-7
#: Parts of a copy in which rates are counted, starts of the rounding that are tried, single copies mended.
UNIT, STARTS, MENDS = 1_000_000, 48, 3
_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size): the one pass over the texts, in the shared folder."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(_WORD)).cast("long")
    return materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), "sized")


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n, target) from (source, size): shares by weight, none above cap * source_size.

    The level (words a unit of weight) rises as sources reach their caps; each round one row of sums
    goes to the driver. Sources are ranked by code point, null last.
    """
    held = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    placed = running(held, [], [F.asc_nulls_last("source")], F.lit(1), "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = materialize(placed.withColumn("weight", weight), "sources")
    top = cap * F.col("source_size")
    level, full = 0.0, -1
    while True:
        below = top > level * F.col("weight")
        x = placed.agg(F.sum("source_size").alias("all"), F.sum(F.when(below, 0.0).otherwise(top)).alias("at_cap"), F.sum(F.when(below, F.col("weight"))).alias("w"), F.count_if(~below).alias("full")).first()
        if not x.w or x.full == full:
            break
        level, full = (x["all"] - x.at_cap) / x.w, x.full
    return placed.select("source", "source_size", "n", F.least(level * F.col("weight"), top.cast("double")).alias("target"))


def _with_source(rows: DataFrame, state: DataFrame, how: str = "left") -> DataFrame:
    """rows with the columns of their source; Spark broadcasts the sources as far as their size allows."""
    return rows.join(state.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def _rate(tilt: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.exp(F.least(tilt * size / mean, F.lit(math.log(cap))))


def tilts(rows: DataFrame, goals: DataFrame, cap: float = CAP, rounds: int = ROUNDS) -> DataFrame:
    """goals with `tilt` (in units of the source's mean size) and `mean`, by Newton's iterations on the dual.

    Newton goes on the logarithm of a source's words, which rise with its tilt, inside a bracket
    that every step narrows. Sums are of decimals, so they don't depend on the order of tasks. A source
    whose target is its cap has no finite tilt: its rates are the cap (tilt null, as for empty sources).
    """
    cells = materialize(rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("k")), "cells")
    free = (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - CLOSE))
    zero = F.when(free, F.lit(0.0))
    state = materialize(goals.withColumns({"mean": F.col("source_size") / F.greatest("n", F.lit(1)), "tilt": zero, "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "off": F.when(free, 1.0)}), "tilts")
    whole = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    for _ in range(rounds):
        if state.where(F.col("off") > CLOSE).isEmpty():
            break
        met = _with_source(cells, state.where(F.col("off") > CLOSE).select("source", "tilt", "mean"), "inner")
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)
        mass = F.col("k") * F.col("size") * rate
        slope = F.when(F.col("tilt") * F.col("size") / F.col("mean") < math.log(cap), mass * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = met.groupBy("source").agg(whole(mass).alias("m"), whole(slope).alias("d"))
        at = _with_source(state, sums)
        lo = F.when(F.col("m") < F.col("target"), F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(F.col("m") >= F.col("target"), F.col("tilt")).otherwise(F.col("hi"))
        step = F.when(F.col("d") > 0, F.col("tilt") - F.col("m") / F.col("d") * F.log(F.col("m") / F.col("target")))
        middle = F.coalesce((lo + hi) / 2, F.when(lo.isNull(), hi - 4 * (1 + F.abs(hi))).otherwise(lo + 4 * (1 + F.abs(lo))))
        inside = step.isNotNull() & (F.coalesce(step > lo, F.lit(True))) & (F.coalesce(step < hi, F.lit(True)))
        off = F.abs(F.col("m") / F.col("target") - 1)
        done = F.col("m").isNull() | (off <= CLOSE)
        after = at.withColumns({"off": F.when(F.col("m").isNotNull(), off).otherwise(F.col("off")), "lo": F.when(done, F.col("lo")).otherwise(lo), "hi": F.when(done, F.col("hi")).otherwise(hi), "tilt": F.when(done, F.col("tilt")).when(inside, step).otherwise(middle)})
        former, state = state, materialize(after.select(state.columns), "tilts")
        discard(former)
    discard(cells)
    return state.drop("lo", "hi", "off")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken: how often the mix takes each document.

    Rounding: in each source, sorted by size, running sums of rates are cut at whole numbers, so
    copies differ from rates by less than one, wherever the cuts start; of STARTS starts the one whose
    words come nearest to the target is taken, then up to MENDS times one copy of the document that
    mends most is added or taken away. All sums are of whole numbers, so reruns agree.

    Edge cases: a null or wordless text has size 0 and nothing taken; null sources are one source, the last; a null
    id is an id; repeated rows are each a document; an empty table gives none; sources without
    words have target 0; other columns aren't looked at.
    """
    rows = sized(docs, id_col, source_col, text_col)
    state = tilts(rows, targets(rows, weights, cap), cap)
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), F.lit(float(cap))).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean"), cap))
    rated = _with_source(rows, state).withColumn("parts", F.when(F.col("size") > 0, F.round(rate * UNIT)).otherwise(0).cast("long"))
    order = [F.col("size"), F.xxhash64("doc_id"), F.col("doc_id")]
    summed = running(rated.select("doc_id", "source", "size", "parts"), ["source"], order, F.col("parts"), "upto")
    start = lambda i: F.lit(i * (UNIT // STARTS))
    cut = lambda s: F.expr(f"(upto + {s}) div {UNIT} - (upto - parts + {s}) div {UNIT}")
    tried = summed.groupBy("source").agg(*[F.sum(F.col("size") * cut(i * (UNIT // STARTS))).alias(f"t{i}") for i in range(STARTS)])
    tried = _with_source(tried, state.select("source", "target"))
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{i}") - F.col("target")).alias("off"), F.lit(i).alias("i"), F.col(f"t{i}").alias("got")) for i in range(STARTS)]))
    chosen = materialize(tried.select("source", "target", best["i"].alias("i"), best["got"].cast("long").alias("got")), "starts")
    place = F.col("i") * (UNIT // STARTS)
    copies = (F.floor((F.col("upto") + place) / UNIT) - F.floor((F.col("upto") - F.col("parts") + place) / UNIT)).cast("long")
    whole = materialize(_with_source(summed, chosen.select("source", "i")).withColumn("copies", copies).drop("i"), "copies")
    left = chosen.select("source", (F.col("target") - F.col("got")).alias("left"))
    for _ in range(MENDS):
        near = _with_source(whole.where("parts > 0"), left)
        sign = F.when(F.col("left") > 0, 1).otherwise(-1)
        after = F.abs(F.col("left") - sign * F.col("size"))
        able = F.when(sign > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0) & (after < F.abs("left"))
        pick = near.where(able).groupBy("source").agg(F.min(F.struct(after.alias("off"), F.col("upto"), F.col("size"), sign.cast("long").alias("sign"))).alias("p"))
        pick = materialize(pick.select("source", "p.upto", "p.sign", "p.size"), "mends")
        # upto rises with every document that has a rate, so it names one of its source.
        mend = _with_source(whole, pick.select("source", F.col("upto").alias("__upto"), F.col("sign").alias("__sign")))
        more = F.when((F.col("parts") > 0) & (F.col("upto") == F.col("__upto")), F.col("__sign")).otherwise(0)
        former, whole = whole, materialize(mend.withColumn("copies", F.col("copies") + F.coalesce(more, F.lit(0))).drop("__upto", "__sign"), "copies")
        left = materialize(_with_source(left, pick.select("source", (F.col("sign") * F.col("size")).alias("__d"))).select("source", (F.col("left") - F.coalesce("__d", F.lit(0))).alias("left")), "left")
        discard(former)
    out = _with_source(whole, state.select("source", "source_size", "target"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("parts") / UNIT).alias("rate"), "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
