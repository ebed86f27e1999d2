"""Datasets, indexes, inverted lists, sections and jobs: what single queries don't show."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry import queries
from docquarry.operators import answering, blocks, chunking, history, index, ivf, mining, search
from docquarry.plans import folders, retrieval
from docquarry.session import session_with, ship
from docquarry.sources import sinks
from docquarry.streaming import live


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_leaves_untouched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "set")
    frame = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "chunk_id long, v string")
    sinks.upsert(spark, path, frame(range(200), "old"))
    before = files(path)
    sinks.upsert(spark, path, frame([5], "new"))
    after = files(path)
    assert 0 < len(set(after) - set(before)) < len(before) / 4 and len(set(before) & set(after)) > len(before) / 2
    rows = {r.chunk_id: r.v for r in sinks.current(spark, path).collect()}
    assert rows == {i: "new" if i == 5 else "old" for i in range(200)}
    assert sinks.current(spark, path).columns == ["chunk_id", "v"]
    sinks.upsert(spark, path, frame([7], "wide").withColumn("more", F.lit(1)))
    assert sinks.current(spark, path).where("more = 1").count() == 1 and sinks.current(spark, path).count() == 200


def test_readers_leave_a_running_upsert_alone(spark, tmp_path):
    path = str(tmp_path / "set")
    frame = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "chunk_id long, v string")
    sinks.upsert(spark, path, frame(range(40), "old"))
    bucket = next(x for x in os.listdir(path) if x.startswith(sinks.PART))
    held = spark.read.parquet(f"{path}/{bucket}")
    held.withColumn("v", F.lit("new")).write.parquet(f"{path}.next/{bucket}")
    n = held.count()
    # Still being written: readers see the old rows and leave the folder.
    assert sinks.exists(spark, path) and sinks.current(spark, path).where("v = 'new'").count() == 0
    assert os.path.isdir(f"{path}.next/{bucket}")
    # All written, the swap cut off: readers see the new rows, the next writer finishes.
    os.makedirs(f"{path}.next/{sinks.READY}")
    assert sinks.current(spark, path).where("v = 'new'").count() == n and sinks.current(spark, path).count() == 40
    sinks.upsert(spark, path, frame([1000], "more"))
    assert sinks.current(spark, path).where("v = 'new'").count() == n and sinks.current(spark, path).count() == 41
    assert not os.path.exists(f"{path}.next") and not os.path.exists(f"{path}.former")


def test_a_failed_move_is_an_error(spark, tmp_path):
    fs, place = sinks._fs(spark, str(tmp_path / "none"))
    with pytest.raises(OSError, match="could not be moved"):
        sinks._move(fs, place, place.suffix("2"))


def test_nearest_cuts_by_the_rounded_score(spark):
    unit = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(0, [1.0, 0.0]), (1, unit(0.9000001)), (2, unit(0.9000002)), (3, unit(0.5))]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = search.nearest(v, v.where("id = 0"), 1).collect()
    assert [(r.doc, r.score, r["rank"]) for r in got] == [(1, 0.9, 1)]


def test_ndcg_asks_every_vector(spark, tmp_path):
    """Vectors whose id isn't divisible by 50 have other neighbours than those whose id is."""
    rows = [(i, [1.0, 0.0] if i % 50 == 0 else [0.0, 1.0], 0 if i % 50 == 0 else i % 2) for i in range(120)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.dim: r.ndcg_at_10 for r in queries.ndcg_at_10_by_dim(spark, str(tmp_path)).collect()}
    gain = [1 / np.log2(r + 2) for r in range(10)]
    scores = []
    for q, v, label in rows:
        order = sorted((-float(np.dot(v, w)), i, own) for i, w, own in rows if i != q)[:10]
        wanted = sum(own == label for _, _, own in rows) - 1
        scores.append(sum(g for g, (_, _, own) in zip(gain, order, strict=True) if own == label) / sum(gain[: min(wanted, 10)]))
    assert got == pytest.approx({d: np.mean(scores) for d in queries.DIMS}, abs=1e-6)


def test_nearest_to_all_equals_the_search_by_shards(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8)]) for i in range(150)] + [(i, [1.0] * 8) for i in range(150, 190)] + [(190, [0.0] * 8), (191, None)]  # ties, copies
    frame = spark.createDataFrame(rows, "id bigint, v array<float>").repartition(3)
    want = sorted(map(tuple, search.nearest_by_dims(frame, frame, 5, (8, 3)).select("dim", "qid", "rank", "doc", "score").collect()))
    for name, value in {"GROUP_ROWS": 40, "LEAST_ROWS": 30, "TILE": 16, "CHUNK": 20}.items():
        monkeypatch.setattr(search, name, value)
    assert sorted(map(tuple, search.nearest_to_all(frame, 5, (8, 3)).select("dim", "qid", "rank", "doc", "score").collect())) == want
    assert search.nearest_to_all(frame.limit(3), 5).count() == 6 and search.nearest_to_all(frame.limit(0), 5).count() == 0


def test_nearest_by_dims_equals_each_alone(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 30)
    monkeypatch.setattr(search, "QUERY_ROWS", 7)
    x = np.random.default_rng(2).standard_normal((90, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(500, None)], "id long, v array<double>")
    got = search.nearest_by_dims(v, v.where("id % 3 = 0"), 5, (8, 3, 5))
    for n in (3, 5, 8):
        own = sorted(map(tuple, got.where(F.col("dim") == n).drop("dim").collect()))
        assert own == sorted(map(tuple, search.nearest(v, v.where("id % 3 = 0"), 5, dims=n).collect())) and len(own) == 150


def test_inverted_lists_recall_filter_and_hot_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 100)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    x = centres[rng.integers(0, 30, 1200)] + 0.3 * rng.standard_normal((1200, 16))
    x[:400] = x[0]  # a third of the rows are one vector
    v = spark.createDataFrame([(i, r.tolist(), i % 40 == 0) for i, r in enumerate(x)] + [(9999, None, True)], "id long, v array<double>, has_table boolean")
    lists, path = ivf.train(v, 24), str(tmp_path / "cells")
    ivf.build(v, lists, path)
    ask = v.where("id % 10 = 3")
    for wanted in (None, {"has_table": True}):
        got = ivf.find(spark, path, lists, ask, 10, wanted).select("qid", "doc", "score")
        want = search.nearest(search.filters(v, wanted), ask, 10).select("qid", "score")
        # Equal vectors are exchangeable, so scores are compared.
        a, b = ([sorted(r.s) for r in df.groupBy("qid").agg(F.collect_list("score").alias("s")).orderBy("qid").collect()] for df in (got, want))
        assert sum(len(set(p) & set(q)) for p, q in zip(a, b, strict=True)) >= 0.9 * sum(len(set(q)) for q in b)
    assert lists.probes < 24
    read = ivf.find(spark, path, lists, ask.limit(1), 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in read and "cell#" in read


def test_index_reads_no_documents_and_only_buckets_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "green green"), (3, None), (None, "red"), (4, "old words"), (4, "older words")], "doc_id long, text string")
    path = str(tmp_path / "index")
    index.add(docs, path)
    index.add(spark.createDataFrame([(2, "blue sky")], docs.schema), path)
    index.remove(spark, path, spark.createDataFrame([(1,)], "doc_id long"))
    index.add(spark.createDataFrame([(5, "green red sky")], docs.schema), path)
    ask = spark.createDataFrame([(0, "green sky"), (1, "blue"), (2, "nowhere")], "qid long, question string")
    found = index.bm25(spark, path, ask, "qid", "question")
    now = spark.createDataFrame([(2, "blue sky"), (3, None), (4, "older words"), (5, "green red sky")], docs.schema)
    want = search.bm25_scores(search.postings(now), search.collection(now), search.query_terms(ask, "qid", "question"))
    rows = lambda df: sorted((r.qid, r.doc, round(r.score, 9)) for r in df.collect())
    assert rows(found) == rows(want) and {q for q, *_ in rows(found)} == {0, 1}
    assert rows(index.phrase(spark, path, ask, "qid", "question")) == rows(search.phrase_scores(now, search.collection(now), ask, "qid", "question"))
    plan = found._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan and "bucket#" in plan


def test_index_written_over_after_a_cut_off_segment(spark, tmp_path):
    docs, path = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string"), str(tmp_path / "index")
    index.add(docs, path)
    os.makedirs(f"{path}/postings/segment=1/bucket=0")  # postings without documents don't count
    assert index.collection(spark, path).first().n == 2
    assert index.add(spark.createDataFrame([(3, "c")], docs.schema), path) == 1
    assert index.collection(spark, path).first().n == 3


def test_sections_reach_chunks_and_the_header_clause(spark):
    lines = ["before", "1 Wire Types", "copper here", "1.2 Thin Wires", "gold here", "Appendix A - Notes", "end"]
    made = spark.createDataFrame([(7, 1 + i // 4, i, t) for i, t in enumerate(lines)], "doc_id long, page_number int, block_idx int, text string")
    typed = blocks.classify(made)
    got = {r.chunk_text: r for r in chunking.chunk_pages(typed).collect()}
    assert got["before"].section_header is None
    assert (got["copper here"].section_number, got["copper here"].section_title) == ("1", "Wire Types")
    assert got["gold here"].section_hierarchy == ["1 Wire Types", "1.2 Thin Wires"] and got["gold here"].parent_section == "1"
    assert got["end"].section_number == "Appendix A"
    old = {r.chunk_text: r.section_number for r in chunking.chunk_pages(typed, compat=True).collect()}
    assert old["copper here"] == "1.2" and old["before"] == "1"
    named = chunking.chunk_pages(typed).withColumn("id", F.monotonically_increasing_id())
    held = search.tokenised(named, "id", "section_header")
    ask = spark.createDataFrame([(1, "thin wires")], "qid long, question string")
    hits = search.bm25_scores(search.postings(held), search.collection(held), search.query_terms(ask, "qid", "question"), search.BOOST_HEADER)
    assert hits.join(named.where("chunk_text = 'gold here'"), hits.doc == named.id).count() == 1


def test_paragraph_packer_takes_time_in_proportion(spark):
    def took(n):
        text = "\n\n".join(f"paragraph {i} " + "x" * (i % 90) for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        chunking.chunk_paragraphs(docs).agg(F.sum(F.length("chunk_text"))).collect()
        return time.time() - began

    took(500)
    assert took(20_000) < 8 * took(5_000) + 2


def test_scores_of_labels_over_zero(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "qid long, doc long, rank int")
    relevant = spark.createDataFrame([(1, 11, 1.0), (1, 10, 0.0), (2, 5, 1.0)], "qid long, doc long, label double")
    got = {r.qid: r for r in mining.ndcg(hits, relevant).collect()}
    assert got[1].mrr == 0.5 and got[1].map == 0.5 and got[1].recall == 1.0 and got[2].accuracy == 0.0


def test_conversation_stream_agrees_with_batch_and_reaches_answers(spark, tmp_path):
    ship(spark)
    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").withColumn("entities", F.slice(F.split("text", " "), 1, 4)).withColumn("clear", F.lit(None).cast("boolean"))
    halves = [talk.where("turn < 3"), talk.where("turn >= 3")]
    told = str(tmp_path / "told")
    with session_with(spark):
        for n, half in enumerate(halves):  # two starts on one checkpoint
            half.write.parquet(str(tmp_path / "in" / str(n)))
            stream = spark.readStream.schema(talk.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            write = lambda batch, _: sinks.upsert(batch.sparkSession, told, batch, "conv_id")
            live.conversation(stream).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        got = {r.conv_id: r for r in sinks.current(spark, told).collect()}
        want = {r.conv_id: r.context for r in history.recent_context(talk, 3).collect()}
        assert {k: r.context for k, r in got.items()} == want
        for k, r in got.items():
            seen = []
            for row in talk.where(f"conv_id = {k}").orderBy("turn").limit(20).collect() if k % 40 == 0 else []:
                for x in row.entities:
                    seen = seen if x in seen else [*seen, x][-20:]
            assert k % 40 or r.entities == seen
        spark.createDataFrame([(0, 99, None, None, None, True), (1, None, "user", "no turn", None, None), (0, 100, "user", "anew", ["x"], None)], "conv_id long, turn long, role string, text string, entities array<string>, clear boolean").select(*talk.columns).write.parquet(str(tmp_path / "in" / "2"))
        stream = spark.readStream.schema(talk.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        live.conversation(stream).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    now = {r.conv_id: r for r in sinks.current(spark, told).collect()}
    assert (now[0].n, now[0].context, now[0].entities) == (1, "User: anew", ["x"]) and now[1].context == got[1].context
    hits = spark.createDataFrame([(0, 1, "gold here", "f", 1, False)], "qid long, rank int, chunk_text string, file_name string, page_number int, has_table boolean")
    asked = spark.createDataFrame([(0, "and its price")], "qid long, question string")

    def echo():
        return lambda texts: ["it was said" if "User: anew" in texts[0] else "nothing known"]

    said = sinks.current(spark, told).select(F.col("conv_id").alias("qid"), F.col("context").alias("talk"))
    assert retrieval.answer(asked, hits, echo, structured=False, talk=said).first().answer.startswith("it was said")
    assert retrieval.answer(asked, hits, echo, structured=False).first().answer.startswith("nothing known")


def test_a_mending_generator_asks_only_for_what_is_wrong(spark, tmp_path):
    log = str(tmp_path / "asked")
    os.makedirs(log)

    def make():
        import json
        import uuid

        def reply(texts):
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(texts[0][:1])
            if texts[0].startswith("x"):
                raise TimeoutError("late")
            sure = "HIGH" if "was wrong" in texts[0] or texts[0].startswith("a") else "?"
            return [json.dumps({"term": "t", "definition": "d", "source": "s", "extraction_confidence": sure})]

        return reply

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x"), (4, None)], "id int, p string").coalesce(1)
    check = lambda block: answering.facts_error(block, "DEFINITION")
    got = {r.id: r for r in answering.generate_checked(rows.where("p is not null"), "p", "facts", make, check, 3).collect()}
    assert [got[i].facts_asked for i in (1, 2, 3)] == [1, 2, 3] and got[3].facts is None and "late" in got[3].facts_error
    count = lambda c: sum(open(f"{log}/{f}").read() == c for f in os.listdir(log))
    assert [count(c) for c in "abx"] == [1, 2, 3]


def test_page_tables_leave_other_items_and_empty_pages(spark):
    rows = [(1, 1, 0, "plain", [0, 0, 5, 5]), (1, 1, 1, "Table 1 A", None), (1, 1, 2, "x", [0, 20, 5, 25]), (1, 1, 3, "no box", None), (1, 1, 4, "y", [50, 21, 55, 26]), (1, 2, 0, None, None)]
    items = spark.createDataFrame(rows, "doc_id long, page_number int, block_idx long, text string, bbox array<int>")
    got = sorted((r.page_number, r.block_idx, r.text, r.block_type, r.rows, r.cols) for r in retrieval.page_tables(items).where("text is not null").collect())
    assert got == [(1, 0, "plain", None, None, None), (1, 1, "Table 1 A\nx | y", "table", 1, 2), (1, 3, "no box", None, None, None)]
    assert retrieval.page_tables(items.limit(0)).count() == 0


def test_a_second_run_over_a_folder_converts_nothing(spark, tmp_path):
    folder, log = tmp_path / "in", tmp_path / "log"
    (folder / "sub").mkdir(parents=True)
    log.mkdir()
    put = lambda name, text: (folder / name).write_bytes(text.encode())
    put("a.pdf", "first file with words enough")
    put("sub/b.PDF", "second file with words enough")
    put("c.pdf", "bad")

    def make():
        import uuid

        def read(data):
            (log / uuid.uuid4().hex).write_bytes(data)
            if data == b"bad":
                raise ValueError("broken")
            return [{"item_type": "text", "page_no": 0, "text": data.decode(), "cells": None}]

        return read

    def run():
        rows = folders.update(spark, str(folder), str(tmp_path / "set"), str(tmp_path / "ledger"), make).collect()
        read = sorted(f.read_bytes().decode()[:5] for f in log.iterdir())
        for f in log.iterdir():
            f.unlink()
        texts = sorted(r.chunk_text for r in sinks.current(spark, str(tmp_path / "set")).collect())
        return {os.path.basename(r.path): r.outcome for r in rows}, read, texts

    outcome, read, texts = run()
    assert outcome == {"a.pdf": "converted", "b.PDF": "converted", "c.pdf": "failed"} and read == ["bad", "first", "secon"] and len(texts) == 2
    outcome, read, texts = run()  # what failed is tried again, nothing else
    assert outcome == {"c.pdf": "failed"} and read == ["bad"] and len(texts) == 2
    put("c.pdf", "third file, mended by now")
    os.utime(folder / "a.pdf", (1, 1))  # touched, not changed
    (folder / "sub" / "b.PDF").unlink()
    outcome, read, texts = run()
    assert outcome == {"c.pdf": "converted", "a.pdf": "touched", "b.PDF": "gone"} and read == ["third"]
    assert texts == ["first file with words enough", "third file, mended by now"]
    assert run()[:2] == ({}, [])


def test_moving_average_and_trend_of_a_hot_key(spark):
    rows = [("hot", i, (i * 37 % 101) / 10) for i in range(500)] + [("few", i, 1.0) for i in range(9)] + [(None, i, float(i)) for i in range(30)]
    frame = spark.createDataFrame(rows, "k string, step int, v double").repartition(6)
    got = {(r.k, r.step): r["mean"] for r in mining.moving_average(frame, "k", "step", "v").collect()}
    by = {k: [v for x, _, v in rows if x == k] for k in ("hot", None)}
    want = {(k, i): round(sum(v[i - w + 1 : i + 1]) / w, 6) for k, v in by.items() for w in [max(5, len(v) // 20)] for i in range(w - 1, len(v))}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    assert {r.k: r.n for r in mining.trend(frame, "k", "step", "v").collect()} == {"hot": 500, "few": 9, None: 30}


def test_questions_are_asked_once_and_failures_again(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "replies")
    log.mkdir()
    texts = ["copper wires carry current", "gold does not rust", "bad passage here", "silver spoons shine bright"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    chunks = retrieval.embed(frame, "text", retrieval.hash_embedder(32), "v")

    def client(fails):
        def make():
            import uuid

            def reply(prompts):
                passage = prompts[0].split("Passage: ")[1]
                (log / uuid.uuid4().hex).write_text(passage)
                if fails and passage.startswith("bad"):
                    raise TimeoutError("late")
                return [f"1. what is {passage} about?\nSure, here you go?\n2) zzz qqq unrelated words?"]

            return reply

        return make

    def run(fails):
        got = retrieval.ask_questions(spark, chunks, path, client(fails), retrieval.hash_embedder(32), parts=2, valid=0.5).collect()
        asked = sorted(f.read_text()[:4] for f in log.iterdir())
        for f in log.iterdir():
            f.unlink()
        return sorted(r.source for r in got), asked

    assert run(True) == ([0, 1, 3], ["bad ", "copp", "gold", "silv"])
    assert run(False) == ([0, 1, 2, 3], ["bad "])
    assert run(False) == ([0, 1, 2, 3], [])


def test_a_document_without_chunks_now_leaves_none_behind(spark, tmp_path):
    path, calls = str(tmp_path / "index"), tmp_path / "calls"
    calls.mkdir()

    def counting():
        import uuid

        def embed(texts):
            (calls / uuid.uuid4().hex).write_text(str(len(texts)))
            return retrieval.hash_embedder(8)()(texts)

        return embed

    rows = lambda *texts: spark.createDataFrame([(n, 1, 0, t, "body") for n, t in enumerate(texts)], "doc_id long, page_number int, block_idx int, text string, block_type string")
    long = "words enough for a chunk of its own"
    retrieval.index_documents(spark, rows(long, long), path, counting)
    found = retrieval.index_documents(spark, rows("short", long + " anew"), path, counting)
    assert [(r.doc_id, r.chunk_text) for r in found.collect()] == [(1, long + " anew")]
    assert sum(int(f.read_text()) for f in calls.iterdir()) == 3  # every chunk met the model once


def test_null_prompts_are_not_sent(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "qid long, p string")
    got = {r.qid: (r.said, r.said_error) for r in answering.generate(rows, "p", "said", lambda: lambda texts: [texts[0] + "!"]).collect()}
    assert got == {1: ("a!", None), 2: (None, None), 3: ("!", None)}


def test_index_keeps_a_frequent_term_in_few_rows_and_cuts_blocks(spark, tmp_path, monkeypatch):
    docs = spark.range(120).selectExpr("id as doc_id", "concat('the w', id % 7, ' the') as text").unionByName(spark.createDataFrame([(200, None), (201, "")], "doc_id long, text string"))
    path, ask = str(tmp_path / "index"), spark.createDataFrame([(0, "the w3"), (1, "w5 the")], "qid long, question string")
    index.add(docs, path)
    assert spark.read.parquet(f"{path}/postings").where("term = 'the'").count() < 30  # not a row a document
    index.add(docs.where("doc_id % 3 = 0").selectExpr("doc_id", "concat(text, ' w3') as text"), path)
    now = docs.selectExpr("doc_id", "case when doc_id % 3 = 0 then concat(text, ' w3') else text end as text")
    held, terms = search.tokenised(now), search.query_terms(ask, "qid", "question")
    rows = lambda df: sorted((r.qid, r.doc, round(r.score, 6)) for r in df.collect())
    assert rows(index.best(spark, path, ask, "qid", "question", 9)) == rows(search.bm25_best(held, terms, 9))
    got = rows(index.phrase(spark, path, ask, "qid", "question"))
    assert got and got == rows(search.phrase_scores(held, search.collection(held), ask, "qid", "question"))


def test_blocks_of_few_documents_open_to_the_same_postings(monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 2)
    ts = pa.array([["a", "b", "a"], None, ["b"], [], ["a", "c"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), ts], ["doc", "ts"])
    blocks = [b.append_column("segment", pa.array([0] * b.num_rows, pa.int32())) for b in index._blocks(iter([batch]))]
    found = [r for b in index._opened(True)(iter(blocks)) for r in b.to_pylist()]
    assert sorted((r["doc"], r["term"], r["tf"], r["places"]) for r in found) == [(1, "a", 2, [0, 2]), (1, "b", 1, [1]), (3, "b", 1, [0]), (5, "a", 1, [0]), (5, "c", 1, [1])]
