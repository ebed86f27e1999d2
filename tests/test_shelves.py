"""Questions past shards of documents: the same as all scored pairs, with bounded rows brought back."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry import queries, stand_ins
from docquarry.operators import search, shelves
from docquarry.plans import retrieval

WORDS = [f"w{i}" for i in range(30)] + ["the"] * 15


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(20)] + [(2000, None), (2001, ""), (3, "w1 the w1"), (None, "w2 w3 the")]
    ask = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 6)))) for i in range(12)] + [(50, "zz unknown"), (51, "the the"), (52, None)]
    made = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ask, "qid long, question string")
    return made


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect() if None not in r)


@pytest.mark.parametrize("entries", [150, 10**6])
def test_best_equals_the_top_of_all_pairs(monkeypatch, tables, entries):
    monkeypatch.setattr(shelves, "SHARD_ENTRIES", entries)
    monkeypatch.setattr(shelves, "PACK_ENTRIES", 70)
    docs, ask = tables
    held, terms = search.tokenised(docs), search.query_terms(ask, "qid", "question")
    every = search.bm25_scores(search.postings(held), search.collection(held), terms, 2.0)
    got = search.bm25_best(held, terms, 5, 2.0)
    assert got.where("doc is null").count() == search.top(every, 5).where("doc is null").count()
    assert rows(got.select("qid", "doc", "score", "rank")) == rows(search.top(every, 5).select("qid", "doc", "score", "rank"))
    asks, tabled = ask.where("qid % 2 = 0").select("qid"), docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("doc"))
    want = search.top(search.should(every, search.table_clause(every, asks, tabled)), 5)
    got = search.bm25_best(held, terms, 5, 2.0, [search.tables_clause(asks, tabled)])
    assert rows(got.select("qid", "doc", "score", "rank")) == rows(want.select("qid", "doc", "score", "rank"))


def test_a_shard_brings_back_only_its_best(tables):
    docs, ask = tables
    held, terms = search.tokenised(docs), search.query_terms(ask, "qid", "question")
    entries = search.counted(held, terms).select("doc", F.xxhash64("term").alias("tid"), F.col("tf").alias("x"), F.lit(1.0).alias("y"))
    shelf = shelves.pack(entries, 3, add=True)
    assert shelf.count() <= 3 * held.rdd.getNumPartitions()  # entries travel packed
    asks = terms.select("qid", F.xxhash64("term").alias("tid"), F.lit(1.0).alias("x"))
    found = shelves.best(shelf, asks, 3, 2).groupBy("qid").count().agg(F.max("count")).first()[0]
    assert found <= 3 * 2


@pytest.mark.parametrize("entries", [150, 10**6])
def test_phrases_equal_windows_by_hand(monkeypatch, tables, entries):
    monkeypatch.setattr(shelves, "SHARD_ENTRIES", entries)
    docs, ask = tables
    docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = set()
    for q in ask.where("question is not null").collect():
        terms = q.question.split()
        for d in docs.where("text is not null").collect():
            words, n = d.text.split(), 0
            shifts = [{p - i for p, w in enumerate(words) if w == t} for i, t in enumerate(terms)]
            for w in range(-len(terms) - 3, len(words) + 1):
                n += all(any(w <= s <= w + 2 for s in own) for own in shifts)
            if n:
                want.add((q.qid, d.doc_id, -(-n // 3)))
    held = search.tokenised(docs)
    got = search.phrase_scores(held, search.collection(held), ask, "qid", "question").select("qid", "doc", "tf").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_neighbour_blocks_stay_small_and_pairs_search_once(spark):
    assert search.SHARD_ROWS * search.QUERY_ROWS * 8 <= 16 << 20  # bytes of a block of scores
    plan = queries.QUERIES["pair_statistics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_answers_pack_their_contexts_once(spark):
    ask = spark.createDataFrame([(1, "[[0]] what is it?")], "qid long, question string")
    hits = spark.createDataFrame([(1, 1, "It is.", "f", 1, False)], "qid long, rank int, chunk_text string, file_name string, page_number int, has_table boolean")
    done = retrieval.answer(ask, hits, stand_ins.replies)
    assert "Window" not in done._jdf.queryExecution().executedPlan().toString()
    assert [r.answer for r in done.collect()] == ["The term is known."]


def test_a_packed_entry_stays_small_however_many_shards(tables):
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    docs, terms = np.divmod(np.arange(60_000), 100)  # 600 documents of 100 terms
    y = rnd.random(600)[docs]
    batch = pa.RecordBatch.from_arrays([pa.array(docs), pa.array(terms * 7919), pa.array(rnd.integers(1, 9, 60_000)), pa.array(y)], ["doc", "tid", "x", "y"])
    for shards in (1, 8, 40):
        (made,) = shelves._pack(shards, False)(iter([batch]))
        assert made.num_rows == shards
        assert made.nbytes <= 5 * 60_000  # 32 bytes an entry before
        got = np.concatenate([np.stack(shelves._entries(made, r)) for r in range(shards)], axis=1)
        want = np.stack([docs, terms * 7919, batch.column("x").to_numpy(), y])
        assert (got[:, np.lexsort(got[:2])] == want[:, np.lexsort(want[:2])]).all()


def test_an_entry_keeps_its_number_however_wide(spark):
    rows = [(1, 5, 0, 0.5), (1, 5, 255, 0.5), (1, 6, 256, 2.5), (2, 5, 70_000, None), (None, 9, 1 << 33, float("nan"))]
    shelf = shelves.pack(spark.createDataFrame(rows, "doc long, tid long, x long, y double").coalesce(1), 1).drop("kind").toArrow().combine_chunks()
    ids, tids, xs, ys = shelves._entries(shelf.to_batches()[0], 0)
    got = sorted(zip(ids, tids, xs, map(str, ys), strict=True))
    assert got == [(shelves.NO_ID, 9, 1 << 33, "nan"), (1, 5, 0, "0.5"), (1, 5, 255, "0.5"), (1, 6, 256, "2.5"), (2, 5, 70_000, "nan")]


def test_shards_follow_entries_that_questions_need(monkeypatch, spark):
    monkeypatch.setattr(shelves, "SHARD_ENTRIES", 100)
    docs = spark.createDataFrame([(i, "w1 w1 w2 " + "other " * 50) for i in range(60)], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "w1"), (2, "w2 w1")], "qid long, question string")
    used, best = [], shelves.best
    monkeypatch.setattr(shelves, "best", lambda shelf, asks, shards, k: used.append(shards) or best(shelf, asks, shards, k))
    held, terms = search.tokenised(docs), search.query_terms(ask, "qid", "question")
    got = search.bm25_best(held, terms, 70)
    assert used[0] <= 4  # 120 entries; by tokens, as before, 32
    assert rows(got) == rows(search.top(search.bm25_scores(search.postings(held), search.collection(held), terms), 70).select("qid", "doc", "score", "rank"))


def test_terms_have_small_numbers_of_their_own(spark):
    terms = spark.createDataFrame([(q, f"w{i}") for i in range(500) for q in (1, 2)], "qid long, term string")
    got = [r.number for r in search.numbered(terms).select("number").collect()]
    assert len(got) == 500 == len(set(got)) and min(got) >= 1 and max(got) < 1 << 16  # two bytes of a packed row, a hash takes eight


@pytest.mark.parametrize("name", ["table_hints", "context_pack_topk"])
def test_tokens_of_the_texts_are_not_written(monkeypatch, spark, name):
    written, real = [], search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, step="step": written.append((step, real(df, step))) or written[-1][1])
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert "ts" not in {c for _, df in written for c in df.columns}  # more bytes than the texts
    assert sorted(step for step, _ in written) == ["best", "shelf", "terms"]


def test_texts_read_anew_give_the_same_best(tables):
    docs, ask = tables
    terms = search.query_terms(ask, "qid", "question")
    got, want = (rows(search.bm25_best(of(docs), terms, 5).select("qid", "doc", "score", "rank")) for of in (search.analysed, search.tokenised))
    assert got and got == want
    assert not search.bm25_best(search.analysed(docs.where("doc_id < 0")), terms, 5).count()  # no row: the mean length is null


def test_packed_rows_stay_long_however_many_shards(monkeypatch, spark):
    docs = spark.range(0, 600, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("w1 w2 w1 w"), F.col("id") % 9).alias("text"))
    ask = spark.createDataFrame([(1, "w1 w3"), (2, "w2 w8 w1")], "qid long, question string")
    terms, joined, made, best = search.query_terms(ask, "qid", "question"), shelves.joined, [], []
    monkeypatch.setattr(shelves, "joined", lambda shelf, n: made.append((n, shelf.count())) or joined(shelf, n))
    for entries in (10**6, 60):
        monkeypatch.setattr(shelves, "SHARD_ENTRIES", entries)
        best.append(rows(search.bm25_best(search.analysed(docs), terms, 7).select("qid", "doc", "score", "rank")))
    assert [n for n, _ in made] == [1, 40]
    assert made[1][1] <= 2 * 2  # 600 documents lie in three blocks; 40 rows before
    assert best[0] and best[0] == best[1]
