"""Training pairs and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import letters, specials, strip, word_count
from .ranks import running, running_sums

#: Thresholds and depths of the mining rules, and starts of lines that are no questions.
VALID, RELATED, HARD_LOW, HARD_HIGH, POOL, DEPTH, EASY_TAIL = 0.65, 0.5, 0.35, 0.55, 5, 15, 10
PREAMBLES = ("here", "sure", "of course", "certainly")
MIN_CHUNKS = 50


def quality(docs: DataFrame, text_col: str = "text", min_words: int = 30) -> Column:
    """Words enough, half letters at least, a fifth other signs at most."""
    n = F.greatest(F.length(text_col), F.lit(1))
    return (word_count(text_col) >= min_words) & (letters(text_col) / n >= 0.5) & (specials(text_col) / n <= 0.2)


def questions_of(reply: Column, n: int) -> Column:
    """The first n usable questions of a generator's reply: numbering, bullets and quotes come off."""
    bare = lambda line: F.regexp_replace(F.regexp_replace(strip(line), r"^[\d.\-*)\]]+\s*", ""), "^[\"']+|[\"']+$", "")
    starts = "^(" + "|".join(PREAMBLES) + ")"
    good = lambda q: (F.length(q) >= 15) & (F.length(q) <= 200) & F.contains(q, F.lit("?")) & ~F.lower(q).rlike(starts)
    return F.slice(F.filter(F.transform(F.split(strip(reply), "\n"), bare), good), 1, n)


def positive_label(sim: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.8 + (sim - VALID) * 0.5), 2)


def related_label(sim: Column) -> Column:
    return F.round(0.5 + 0.3 * sim, 2)


def _pick(rows: DataFrame, by: str, seed: int) -> DataFrame:
    """One row per group, by a hash: the same in every run."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.pmod(F.col("doc") * 7919 + F.col(by) * 104729 + seed, F.lit(1009)), "doc"))
    return rows.withColumn("__p", rank).where("__p = 1").drop("__p")


def related(near: DataFrame, threshold: float = RELATED) -> DataFrame:
    """The best same-document neighbour over the threshold. near: qid, doc, score, rank, same."""
    best = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return near.where(F.col("same") & (F.col("score") > threshold)).withColumn("__b", best).where("__b = 1").drop("__b").withColumn("label", related_label(F.col("score")))


def hard_negatives(near: DataFrame, low: float = HARD_LOW, high: float = HARD_HIGH, pool: int = POOL, seed: int = 42) -> DataFrame:
    """One of the first `pool` other-document neighbours in [low, high]; label 0."""
    first = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    held = near.where(~F.col("same") & F.col("score").between(low, high)).withColumn("__f", first).where(F.col("__f") <= pool).drop("__f")
    return _pick(held, "qid", seed).withColumn("label", F.lit(0.0))


def easy_negatives(near: DataFrame, below: float = HARD_LOW, depth: int = DEPTH, tail: int = EASY_TAIL, seed: int = 43, queries: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """One of the last `tail` of the top `depth` neighbours under the threshold; label 0.

    With all queries (qid, source) and chunks (doc), queries without one get a random chunk from
    fallback_negatives(); made_up tells them apart.
    """
    held = near.where((F.col("rank") <= depth) & (F.col("rank") > depth - tail) & (F.col("score") < below))
    found = _pick(held, "qid", seed).withColumn("label", F.lit(0.0))
    if queries is None or chunks is None:
        return found
    found = found.select("qid", "doc", "score", "label", F.lit(False).alias("made_up"))
    alone = queries.select("qid", "source").distinct().join(found.select("qid"), "qid", "left_anti")
    return found.unionByName(fallback_negatives(alone, chunks))


def fallback_negatives(queries: DataFrame, chunks: DataFrame, seed: int = 44) -> DataFrame:
    """For each query (qid, source) a chunk (doc) other than its source, flagged as made up (sim 0.1).

    The chunk's place in the order of ids follows from arithmetic on the query's id. Without another
    chunk a query gets none.
    """
    placed = sequential_ids(chunks.select("doc").distinct(), "doc").select("doc", F.col("id").alias("place"))
    own = queries.join(placed.select(F.col("doc").alias("source"), F.col("place").alias("own")), "source", "left")
    others = F.lit(placed.count()) - F.when(F.col("own").isNull(), 0).otherwise(1)
    drawn = own.where(others > 0).withColumn("place", F.pmod(F.col("qid") * 31 + seed, F.greatest(others, F.lit(1))))
    drawn = drawn.withColumn("place", F.col("place") + F.when(F.col("place") >= F.col("own"), 1).otherwise(0))
    return drawn.join(placed, "place").select("qid", "doc", F.lit(0.1).alias("score"), F.lit(0.0).alias("label"), F.lit(True).alias("made_up"))


def pairs(near: DataFrame, positives: DataFrame | None = None, queries: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """All pair types of a neighbour list: qid, doc, pair_type, label, semantic_similarity.

    queries (qid, source) and chunks (doc) give every query an easy negative, see easy_negatives().
    """
    named = lambda df, kind: df.select("qid", "doc", F.lit(kind).alias("pair_type"), "label", F.col("score").alias("semantic_similarity"))
    out = named(related(near), "related").unionByName(named(hard_negatives(near), "hard_negative")).unionByName(named(easy_negatives(near, queries=queries, chunks=chunks), "easy_negative"))
    if positives is not None:
        good = positives.where(F.col("score") >= VALID).withColumn("label", positive_label(F.col("score")))
        out = named(good, "positive").unionByName(out)
    return out


def within_budget(rows: DataFrame, source: str, most: int, seed: int = 45) -> DataFrame:
    """The pairs of sources in a hashed order, up to and with the source that brings them to `most`.

    So the number passes `most` by what that source has over, as when pairs are made source by source
    until there are enough. Sums run over ranges of sources, in no single task.
    """
    place = F.pmod(F.col(source) * 7919 + seed, F.lit(1009))
    own = rows.groupBy(source).agg(F.count("*").alias("__n"))
    summed = running(own.withColumn("__place", place), [], [F.col("__place"), F.col(source)], F.col("__n"), "__upto")
    return rows.join(summed.where(F.col("__upto") - F.col("__n") < most).select(source), source, "left_semi")


def enough(chunks: DataFrame, least: int = MIN_CHUNKS) -> bool:
    """Whether there are chunks enough to mine; reads no more than that many."""
    return chunks.limit(least).count() >= least


def examples(rows: DataFrame) -> DataFrame:
    """Training examples: no empty side, label 1 where none is given."""
    return rows.where((F.coalesce("anchor", F.lit("")) != "") & (F.coalesce("positive", F.lit("")) != "")).withColumn("label", F.coalesce(F.col("label").cast("float"), F.lit(1.0).cast("float")))


def statistics(rows: DataFrame) -> DataFrame:
    """Per pair type: count, percent, mean similarity."""
    every = Window.partitionBy()
    out = rows.groupBy("pair_type").agg(F.count("*").alias("n"), F.round(F.avg("semantic_similarity"), 6).alias("mean_similarity"))
    return out.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(every), 4))


def label_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").count().orderBy(F.desc("label"))


def first_examples(rows: DataFrame, order: str, cut: int = 100) -> DataFrame:
    """The first pair of each type by `order`, texts cut to 100 characters."""
    first = lambda c: F.substring(F.min_by(c, order), 1, cut).alias(c)
    return rows.groupBy("pair_type").agg(first("anchor"), first("positive"))


def sequential_ids(rows: DataFrame, *order: str) -> DataFrame:
    """Gapless ids from 0 by a stable key."""
    return running(rows, [], [F.col(c) for c in order], F.lit(1), "id").withColumn("id", F.col("id") - 1)


def split(rows: DataFrame, key: str, test_tenths: int = 1) -> DataFrame:
    """Add `split` by arithmetic on the key: stable, and about test_tenths of ten in test."""
    return rows.withColumn("split", F.when(F.pmod(F.col(key) * 7919 + 13, F.lit(10)) < test_tenths, "test").otherwise("train"))


def scores(found: DataFrame, wanted: DataFrame, k: int = 10, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Per query: ndcg, reciprocal rank, precision, recall, average precision and accuracy at k.

    found: by, rank of relevant hits alone; wanted: by, rel (how many rows are relevant, 1 or more).
    Queries without hits count as 0.
    """
    gain = lambda r: 1 / F.log2(r + 1.0)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("rank"))
    held = found.where(F.col("rank") <= k).withColumn("__nth", nth)
    got = held.groupBy(*by).agg(F.sum(gain(F.col("rank"))).alias("dcg"), F.min("rank").alias("first"), F.count("*").alias("n"), F.sum(F.col("__nth") / F.col("rank")).alias("ap"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + gain(r))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return wanted.join(got, list(by), "left").select(*by, zero(F.col("dcg") / ideal).alias("ndcg"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("n") / k).alias("precision"), zero(F.col("n") / F.col("rel")).alias("recall"), zero(F.col("ap") / F.least(F.col("rel"), F.lit(k))).alias("map"), F.when(F.col("n") > 0, 1.0).otherwise(0.0).alias("accuracy"))


def mean_scores(per_query: DataFrame, *by: str) -> DataFrame:
    """Means of scores() over all queries, with 6 digits."""
    return per_query.groupBy(*by).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "mrr", "precision", "recall", "map", "accuracy")])


def ndcg(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """scores() of hits (qid, doc, rank) by relevant (qid, doc, distinct and, optionally, a label over 0)."""
    if "label" in relevant.columns:
        relevant = relevant.where("label > 0").drop("label")
    return scores(hits.join(relevant, ["qid", "doc"]), relevant.groupBy("qid").agg(F.count("*").alias("rel")), k)


def _placed(rows: DataFrame, key: str, order: str, **sums: Column) -> DataFrame:
    """rows with __n (rows of the key), __at (place from 1) and running sums: by ranges, so few keys don't mean few tasks."""
    placed = running_sums(rows, [key], [F.col(order)], {"__at": F.lit(1), **sums})
    sizes = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))  # Spark broadcasts it where it is small
    return placed.join(sizes, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def moving_average(rows: DataFrame, key: str, order: str, value: str, floor: int = 5, share: int = 20) -> DataFrame:
    """Means over a window of max(5, n // 20), for keys of over 20 rows, from the first full window."""
    # The window's width differs by key, so running sums are subtracted.
    run = _placed(rows.select(key, order, value), key, order, __sum=F.col(value).cast("decimal(30,8)")).where("__n > 20")
    run = run.withColumn("window", F.greatest(F.lit(floor), F.floor(F.col("__n") / share)))
    behind = run.select(F.col(key).alias("__key"), (F.col("__at") + F.col("window")).alias("__at"), F.col("__sum").alias("__old"))
    late = run.where(F.col("__at") >= F.col("window")).withColumnRenamed("__at", "__here")
    joined = late.join(behind, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__here") == F.col("__at")), "left")
    mean = (F.col("__sum") - F.coalesce("__old", F.lit(0))).cast("double") / F.col("window")
    return joined.select(key, order, F.col("window").cast("long").alias("window"), F.round(mean, 6).alias("mean"))


def trend(rows: DataFrame, key: str, order: str, value: str, change: float = 0.005) -> DataFrame:
    """First, last, least, reduction, and the last quarter's mean against the quarter before (20 rows or more)."""
    x = _placed(rows.select(key, order, value), key, order).withColumn("__q", F.floor(F.col("__n") / 4))
    late = F.avg(F.when(F.col("__at") > F.col("__n") - F.col("__q"), F.col(value)))
    early = F.avg(F.when((F.col("__at") > F.col("__n") - 2 * F.col("__q")) & (F.col("__at") <= F.col("__n") - F.col("__q")), F.col(value)))
    out = x.groupBy(key).agg(F.first("__n").alias("n"), F.min_by(value, "__at").alias("first_value"), F.max_by(value, "__at").alias("last_value"), F.min(value).alias("min_value"), F.round(late - early, 6).alias("change"))
    kind = F.when(F.col("n") < 20, F.lit(None)).when(F.col("change") < -change, "decreasing").when(F.col("change") > change, "increasing").otherwise("plateaued")
    cut = F.col("first_value") - F.col("last_value")
    return out.withColumn("reduction_percent", F.round(F.when(F.col("first_value") > 0, 100 * cut / F.col("first_value")).otherwise(0.0), 4)).withColumn("trend", kind)


def score_change(rows: DataFrame, key: str, step: str, score: str, least: float = 0.001) -> DataFrame:
    """Last score less first of each key: improved over +0.001, unchanged within, else decreased."""
    out = rows.groupBy(key).agg(F.min_by(score, step).alias("first_score"), F.max_by(score, step).alias("last_score"))
    diff = F.col("last_score") - F.col("first_score")
    return out.withColumn("verdict", F.when(diff > least, "improved").when(F.abs(diff) < least, "unchanged").otherwise("decreased"))
