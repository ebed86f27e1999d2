"""Operators on small fixtures, folds against plain Python models, sinks, jobs and streams."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import answering, blocks, chunking, history, mining, search, tables
from docquarry.plans import retrieval
from docquarry.sources import readers, sinks
from docquarry.streaming import live


def column(spark, values, make, kind="string"):
    """make(column) for each value, in order."""
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


# --- functions


def test_text_functions(spark):
    assert column(spark, [" \n a b\t", None, ""], tx.strip) == ["a b", None, ""]
    assert column(spark, ["a  b\nc", "", " "], tx.word_count) == [3, 0, 0]
    assert column(spark, ["Über-Maß 2.5, x"], tx.tokens) == [["über", "maß", "2", "5", "x"]]
    assert column(spark, ["Über-Maß café"], lambda x: tx.tokens(x, fold=True)) == [["uber", "mass", "cafe"]]
    assert column(spark, ["/a/b/My Doc (v2).PDF", "x.tar.gz"], tx.file_key) == ["my_doc__v2_", "x_tar"]
    assert column(spark, ["My Index-1", "_x"], tx.dataset_name) == ["my_index_1", "idx__x"]
    assert column(spark, ["abc"], tx.preview) == ["abc..."]


def test_stemmer(spark):
    from docquarry.functions.stemmer import stem

    pairs = "caresses:caress ties:tie cries:cri gas:gas agreed:agre hopping:hop hoping:hope consolation:consol generously:generous proceeding:proceed relational:relat happiness:happi adoption:adopt sky:sky cry:cri by:by bed:bed"
    assert all(stem(a) == b for a, b in (x.split(":") for x in pairs.split()))
    assert column(spark, ["Running RATINGS é"], lambda x: tx.tokens(x, stem=True)) == [["run", "rate", "é"]]
    docs = spark.createDataFrame([(1, "voltage ratings"), (2, "other words")], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "rating")], "qid long, q string")
    got = search.bm25_scores(search.postings(docs, stem=True), search.collection(docs), search.query_terms(ask, "qid", "q", stem=True))
    assert [r.doc for r in got.collect()] == [1]


# --- blocks


def test_section_headers(spark):
    lines = ["1 Introduction", "1.2 Overview", "1.2.3 Details", "Appendix A - Foo", "Annex B", "Chapter 3: Start", "230 V supply", "2 Voltage Levels", "3 of 10 pages", "lower 1", "x" * 81, "ab", "Section 4 Power"]
    kinds = column(spark, lines, lambda x: blocks.section_header(x)["kind"])
    assert kinds == ["major", "sub", "subsub", "appendix", "appendix", "major", None, "major", None, None, None, None, "major"]
    strict = column(spark, lines, lambda x: blocks.section_header(x, compat=True)["kind"])
    assert strict[2] is None and strict[7] is None  # the older rules
    assert column(spark, lines[:4], lambda x: blocks.section_header(x)["number"]) == ["1", "1.2", "1.2.3", "Appendix A"]
    assert column(spark, lines[:3], lambda x: blocks.parser_header(x)["level"]) == [1, 2, 3]


def test_block_types_and_page_elements(spark):
    lines = ["Table 3 Ratings", "Tab. 4", "1 Scope", "1.1 Scope", "A Short Title", "Page 3", "3 of 10", "1234", "Strictly Confidential", "some body text that goes on and on for a while"]
    got = column(spark, lines, lambda x: blocks.block_type(x, F.lit(True)))
    assert got == ["table_header", "table_header", "section_header", "subsection_header", "title", "page_element", "page_element", "page_element", "page_element", "body"]
    frame = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate([*lines, "  "])], "doc_id string, page_number int, block_idx int, text string")
    assert blocks.classify(frame).count() == 6


def test_hierarchy_and_parents(spark):
    rows = [("d", i, t, level, n) for i, (t, level, n) in enumerate([("1.1.1 Deep", 3, "1.1.1"), ("1.1 Mid", 2, "1.1"), ("2 Top", 1, "2"), ("2.1 Sub", 2, "2.1"), ("body", 0, None)])]
    frame = spark.createDataFrame(rows, "doc_id string, block_idx int, text string, level int, section_number string")
    got = {r.block_idx: r.section_hierarchy for r in blocks.hierarchy(frame).collect()}
    # Cut by place in the stack: a deep header in an empty stack lands on top.
    assert got == {0: ["1.1.1 Deep"], 1: ["1.1.1 Deep", "1.1 Mid"], 2: ["2 Top"], 3: ["2 Top", "2.1 Sub"]}
    assert column(spark, ["see 10.2 and 2.5.1, 2.7", "none"], blocks.parent_sections) == [["2", "10"], []]
    assert column(spark, ["1.2.3", "4", None], blocks.parent_section) == ["1.2", None, None]


def test_confidence_and_tables_of_a_page(spark):
    frame = spark.createDataFrame([("d", 1, 0, "table_header", 0.9), ("d", 1, 1, "table", 0.1), ("d", 1, 2, "table_header", 0.7)], "doc_id string, page_number int, block_idx int, block_type string, confidence double")
    assert blocks.confidence(frame, "doc_id").first().avg_confidence == pytest.approx(0.8)
    found = spark.createDataFrame([("d", 1, 1, "first")], "doc_id string, page_number int, nth int, grid string")
    assert [r.grid for r in blocks.nth_table(frame, found).orderBy("block_idx").collect()] == ["first", None]


# --- chunks


def model_fold(lines, size, overlap, least):
    out, buf = [], None
    for kind, text in lines:
        text = text.strip()
        if not text:
            continue
        if kind != "body":
            out += [(buf or "").strip()] * (len((buf or "").strip()) > least) + [text]
            buf = None
            continue
        buf = text if buf is None else buf + "\n" + text
        if len(buf) >= size:
            out.append(buf.strip())
            buf = buf[-overlap:] if len(buf) > overlap else None
    return out + [(buf or "").strip()] * (len((buf or "").strip()) > least)


def test_chunk_folds_against_model(spark):
    rng, rows, want = random.Random(1), [], {}
    for d in range(12):
        lines = [(rng.choice(["body"] * 5 + ["table", "title", "section_header"]), "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90)))) for _ in range(rng.randint(0, 40))]
        want[d] = lines
        rows += [(d, 1 + i // 10, i, t, k) for i, (k, t) in enumerate(lines)]
    frame = spark.createDataFrame(rows, "doc_id int, page_number int, block_idx int, text string, block_type string")
    got = {}
    for r in chunking.chunk_documents(frame, 150, 30).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.chunk_text)
        assert r.chunk_id == f"{r.doc_id}__c{r.chunk_index}" and r.chunk_index == len(got[r.doc_id]) - 1
    assert got == {d: c for d, x in want.items() if (c := model_fold(x, 150, 30, 20))}
    pages = {}
    for r in chunking.chunk_pages(frame, 150, 30).orderBy("doc_id", "chunk_index").collect():
        pages.setdefault(r.doc_id, []).append(r.chunk_text)
    model = {d: [c for i in range(0, len(x), 10) for c in model_fold(x[i : i + 10], 150, 30, 0)] for d, x in want.items()}
    assert pages == {d: c for d, c in model.items() if c}


def test_paragraph_packer(spark):
    rng = random.Random(2)
    for _ in range(6):
        ps = ["x" * rng.randint(1, 120) for _ in range(rng.randint(1, 20))]
        out, buf = [], []
        for p in ps:
            if buf and sum(map(len, buf)) + len(p) > 200:
                out.append(buf)
                kept = []
                for q in reversed(buf):
                    if sum(map(len, kept)) + len(q) > 80:
                        break
                    kept.insert(0, q)
                buf = kept
            buf = [*buf, p]
        assert column(spark, [ps], lambda x: chunking.pack_paragraphs(x, 200, 80), "array<string>") == [[*out, buf]]


def test_embedding_text_and_intervals(spark):
    frame = spark.createDataFrame([(True, "table", ["1"], "t"), (False, "section_header", [], "s"), (False, "body", ["2", "3"], "b")], "has_table boolean, content_type string, parent_sections array<string>, chunk_text string")
    assert [r[0] for r in frame.select(chunking.embedding_text(frame)).collect()] == ["[Sections: 1] [Table] t", "[Section Header] s", "[Sections: 2, 3] b"]
    spans = spark.createDataFrame([("k", 0, 5, "a"), ("k", 5, 7, "b"), ("k", 9, 12, "c"), ("k", 10, 11, "d")], "k string, start int, end int, kind string")
    got = sorted((r.start, r.end, r.kind, r.n_merged) for r in chunking.merge_intervals(spans, "k", "start", "end", "kind").collect())
    assert got == [(0, 7, "a", 2), (9, 12, "c", 2)]
    held = spans.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("xs"))
    assert held.select(chunking.inside(F.lit(4), F.col("xs")), chunking.inside(F.lit(7), F.col("xs")), chunking.next_interval(F.lit(5), F.col("xs"))["start"]).first()[:] == (True, False, 9)


# --- tables


def test_table_region_grid_and_rendering(spark):
    cell = lambda t, x, y, w=20: {"text": t, "bbox": [x, y, x + w, y + 10]}
    kind = "array<struct<text:string,bbox:array<int>>>"
    page = [cell("a", 0, 50), {"text": "no box", "bbox": None}, cell("b", 100, 58), cell("c", 5, 90), cell("lower far away", 0, 400), cell("never", 0, 410)]
    assert [[c.text for c in x] for x in column(spark, [page], lambda x: tables.region(x, F.lit(40)), kind)] == [["a", "b", "c"]]
    long = [cell("a", 0, 50), cell("y" * 201, 0, 60), cell("z", 0, 70)]
    assert [len(x) for x in column(spark, [long, [cell("q", 0, 50)] * 60], lambda x: tables.region(x, F.lit(40)), kind)] == [1, 51]
    frame = spark.createDataFrame([([cell("h2", 103, 4), cell("h1", 0, 0), cell("v1", 12, 40), cell("more", 14, 44), cell("v2", 99, 52)],)], f"cells {kind}")
    r = tables.grid(frame).first()
    assert (r.rows, r.cols, r.table_data) == (2, 2, {"0,0": "h1", "1,0": "h2", "0,1": "v1 more", "1,1": "v2"})
    shown = tables.grid(frame).select(tables.render_grid(F.col("table_data"), F.col("rows"), F.col("cols")), tables.table_text(F.lit("Table 1"), F.col("table_data"))).first()
    assert shown[0] == "| h1 | h2 |\n|---|---|\n| v1 more | v2 |" and shown[1] == "Table 1\nh1 | h2\nv1 more | v2"
    wide = spark.createDataFrame([({f"{c},{r}": f"{c}.{r}" for c in range(12) for r in range(2)}, 2, 12), ({}, 0, 0), (None, 1, 1)], "d map<string,string>, r int, c int")
    got = [x[0] for x in wide.select(tables.render_grid(F.col("d"), F.col("r"), F.col("c"))).collect()]
    assert got[0].split("\n")[0].startswith("| 0.0 | 1.0 | 2.0") and got[0].split("\n")[2].endswith("| 10.1 | 11.1 |") and got[1:] == ["[Empty table]"] * 2
    parsed = column(spark, [[{"row": 0, "col": 1, "text": "x"}, {"row": 2, "col": 0, "text": None}]], tables.parsed_cells, "array<struct<row:int,col:int,text:string>>")[0]
    assert (parsed.table_data, parsed.rows, parsed.cols) == ({"1,0": "x", "0,2": ""}, 3, 2)
    listed = spark.createDataFrame([([{"a": "1", "source": "s"}, {"b": "2"}], ["a", "b", "source"]), ([], [])], "r array<map<string,string>>, h array<string>")
    assert [x[0] for x in listed.select(tables.render_list(F.col("r"), F.col("h"))).collect()] == ["| a | b |\n|---|---|\n| 1 |  |\n|  | 2 |", "[Empty table]"]


def test_tables_in_plain_text_stay_whole(spark):
    from docquarry.operators import table_chunks as tc

    markdown = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n"
    ascii_table = "name      val       unit\n" + "foos      101       V\nbars      202       A\n" * 3
    marked = "[Table with 2 rows x 3 columns]\nx y z\n1 2 3"
    text = "Intro paragraph.\n\n" + markdown + "\nMiddle.\n\n" + ascii_table + "\nso:\n" + marked + "\n\nThe end."
    assert [k for _, _, k in tc.table_spans(text)] == ["markdown", "ascii", "extracted"]
    assert not tc.looks_aligned("plain text here\nmore of the text\nand still more of it")
    rng = random.Random(3)
    for _ in range(60):
        body = "".join(rng.choice([markdown * rng.randint(1, 6), "word " * rng.randint(1, 60) + "\n\n", ascii_table + "\n", marked + "\n\n", "\n"]) for _ in range(rng.randint(0, 9)))
        chunks = tc.chunk(body, 300, 60)
        for a, b, _ in tc.table_spans(body):  # every table lies whole in one chunk
            assert any(body[a:b].strip("\n") in t for _, t, k in chunks if k)
        assert set("".join(body.split())) <= set("".join(t for _, t, _ in chunks)) | set("\n")
        starts = [o for o, _, _ in chunks]
        assert starts == sorted(starts)
    got = tc.chunk_texts(spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string"), 120, 40).collect()
    assert {r.doc_id for r in got} == {"d"} and sum(r.has_table for r in got) == 3 and [r.chunk_index for r in got] == list(range(len(got)))


# --- search


def test_fusion_and_rerank_orders(spark):
    bm = spark.createDataFrame([(1, d, 9.0 - d, d) for d in range(1, 35)], "qid long, doc long, score double, rank int")
    kn = spark.createDataFrame([(1, 40, 0.9, 1), (1, 2, 0.8, 2)], "qid long, doc long, score double, rank int")
    fused = search.fuse(bm, kn)
    by = {r.doc: r for r in fused.collect()}
    assert by[40].ord == 51 and by[2].rrf_score == pytest.approx(2 / 62) and by[2].score == 7.0
    assert max(r.rrf_score for r in by.values()) <= 2 / 61
    same = lambda c: c.select("qid", "doc", F.lit(0.5).alias("rerank_score"))
    first = {r.doc: r for r in search.rerank(fused, same).collect()}
    assert first[40].rerank_score == 0 and first[40].final_score == by[40].rrf_score  # not among the first 30
    assert first[30].final_score == pytest.approx(0.3 / 90 + 0.35)
    best = {r.doc: r for r in search.rerank(fused, same, order="rrf").collect()}
    assert best[40].rerank_score == 0.5
    top = search.final(search.rerank(fused, None)).orderBy("rank").collect()
    assert [r.doc for r in top[:3]] == [2, 1, 40] and len(top) == 10


def test_nearest_matches_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 40)
    monkeypatch.setattr(search, "QUERY_ROWS", 10)
    v = np.random.default_rng(1).standard_normal((130, 8))
    v[50:60] = v[50]
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    got = {}
    for r in search.nearest(frame, frame.where("id % 5 = 0"), 7, dims=6).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.doc)
    u = v[:, :6] / np.linalg.norm(v[:, :6], axis=1, keepdims=True)
    for q, docs in got.items():
        want = sorted((-round(float(s), 6), i) for i, s in enumerate(u @ u[q]) if i != q)[:7]
        assert docs == [i for _, i in want]
    assert search.neighbours(frame, frame.where("id = 0"), 5, most=50).count() <= 5


def test_filters_and_cues(spark):
    frame = spark.createDataFrame([("a", "table", True), ("b", "body", False)], "file_name string, content_type string, has_table boolean")
    assert search.filters(frame, {"content_type": ["table", "x"], "has_table": True, "junk": 3}).count() == 1
    assert search.filters(frame, None).count() == 2
    assert column(spark, ["Show the stable VALUES", "nothing"], search.wants_table) == [True, False]


# --- answering


def test_query_types(spark):
    asked = ["How many types?", "Quais são?", "show the rating table", "What is X?", "o que é isso", "shall it", "tell me more"]
    assert column(spark, asked, answering.heuristic_type) == ["ENUMERATION", "ENUMERATION", "TABLE_DATA", "DEFINITION", "DEFINITION", "REQUIREMENT", "GENERIC"]
    frame = spark.createDataFrame([("It is a procedure", "x"), ("dunno", "list it")], "r string, q string")
    assert [x[0] for x in frame.select(answering.replied_type(F.col("r"), F.col("q"))).collect()] == ["PROCEDURE", "ENUMERATION"]


def test_json_blocks_and_schemas(spark):
    good = {"items": [{"id": "A", "description": "d", "source": "s"}], "total_count": 1, "extraction_confidence": "HIGH"}
    replies = ["```json\n" + json.dumps(good) + "\n```", "text " + json.dumps(good) + " end", "{bad", "{} and {}", "none"]
    found = column(spark, replies, answering.json_block)
    assert json.loads(found[0]) == good == json.loads(found[1]) and found[2:] == [None] * 3
    cases = [good, {**good, "total_count": -1}, {**good, "extraction_confidence": "SURE"}, {k: v for k, v in good.items() if k != "items"}, {**good, "items": [{"id": "A"}]}]
    errors = column(spark, [json.dumps(c) for c in cases], lambda x: answering.facts_error(x, "ENUMERATION"))
    assert errors[0] is None and all(errors[1:])
    assert column(spark, ['{"term":"t","definition":"d","source":"s","extraction_confidence":"LOW"}', "{}"], lambda x: answering.facts_error(x, "DEFINITION"))[0] is None
    assert column(spark, ["{}", None], lambda x: answering.facts_error(x, "GENERIC")) == [None, "no JSON object"]


def test_validation_and_fallback_text(spark):
    facts = json.dumps({"items": [{"id": "Type 1", "description": "d", "source": "s"}, {"id": "B", "description": None, "source": None}], "total_count": 2, "extraction_confidence": "HIGH"})
    table = json.dumps({"table_data": [{"a": "1"}, {"b": "2"}], "headers": ["a", "b"], "row_count": 2, "extraction_confidence": "HIGH"})
    rows = [("how many?", "none here", facts, "ENUMERATION"), ("how many?", "type 1 only", facts, "ENUMERATION"), ("which?", "type 1", facts, "ENUMERATION"), ("t", "| a |", table, "TABLE_DATA"), ("t", "|", table, "TABLE_DATA"), ("g", "Sorry, no information", "{}", "GENERIC"), ("g", "fine", "{}", "GENERIC")]
    frame = spark.createDataFrame(rows, "q string, a string, f string, t string")
    got = [r[0] for r in frame.select(answering.validation_error(F.col("q"), F.col("a"), F.col("f"), F.col("t"))).collect()]
    assert got[0].startswith(answering.UNSAID + "Type 1, B") and got[1] == answering.MISCOUNT + "1, the facts 2" and got[2] is None
    assert got[3] is None and got[4].startswith("the answer has 1 table rows") and got[5].startswith(answering.HEDGED) and got[6] is None
    text = [r[0] for r in frame.select(answering.facts_as_text(F.col("f"), F.col("t"))).collect()]
    assert "1. Type 1: d\n   [Source: s]\n2. B: N/A\n   [Source: Unknown]" in text[0]
    assert text[3] == "As a table:\n\n| a | b |\n|---|---|\n| 1 | N/A |\n| N/A | 2 |"


def test_context_budget_and_sources(spark):
    hits = spark.createDataFrame([(1, r, f"f{r}", 1, "x" * 50, 0.12345, "body", None) for r in (1, 2, 3)], "qid long, rank int, file_name string, page_number int, chunk_text string, final_score double, content_type string, has_table boolean")
    size = len("[Source 1: f1 - Page 1]\n") + 50
    r = answering.pack_context(hits, 2 * size).first()
    assert r.n_sources == 2 and r.context.count(answering.RULE) == 1
    assert answering.sources(hits).first()[:] == (1, 1, "f1", 1, 0.123, "body", False, "x" * 50 + "...")


# --- history, mining


def test_history(spark):
    frame = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", "x" * (400 if t == 12 else 3)) for t in range(1, 13)], "conv_id long, turn long, role string, text string")
    assert sorted(r.turn for r in history.last_messages(frame).collect()) == list(range(3, 13))
    lines = history.recent_context(frame, 2).first().context.split("\n")
    assert lines[0] == "User: xxx" and lines[1] == "Assistant: " + "x" * 300 + "..."
    assert column(spark, [["a", "b"], [str(i) for i in range(25)]], lambda x: history.add_entities(x, F.array(F.lit("b"), F.lit("z"))), "array<string>")[0] == ["a", "b", "z"]
    assert history.clear(frame, frame.limit(1)).count() == 0


def test_question_lines_and_labels(spark):
    reply = '1. "What is the rated voltage?"\n- short?\nSure, here are some questions?\n2) How is it measured in the field?\nNo question mark in this line\n3. Third question that is long enough?'
    assert column(spark, [reply], lambda x: mining.questions_of(x, 2)) == [["What is the rated voltage?", "How is it measured in the field?"]]
    assert column(spark, [0.65, 1.0], mining.positive_label, "double") == [0.8, 0.98]
    assert column(spark, [0.5], mining.related_label, "double") == [0.65]


def test_metrics_and_trends(spark):
    hits = spark.createDataFrame([(1, 5, 1), (2, 6, 10), (3, 7, 11)], "qid long, doc long, rank int")
    rel = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "qid long, doc long")
    got = {r.qid: r for r in mining.ndcg(hits, rel).collect()}
    assert got[1].ndcg == 1 and got[2].ndcg == pytest.approx(1 / np.log2(11)) and got[3].ndcg == 0 and got[2].mrr == 0.1
    loss = spark.createDataFrame([("a", i, 1 - i / 100) for i in range(40)] + [("b", i, 0.5) for i in range(20)] + [("c", i, 1.0) for i in range(19)], "k string, step int, loss double")
    trend = {r.k: r.trend for r in mining.trend(loss, "k", "step", "loss").collect()}
    assert trend == {"a": "decreasing", "b": "plateaued", "c": None}
    mean = mining.moving_average(loss, "k", "step", "loss").orderBy("step").collect()
    assert {r.k for r in mean} == {"a"} and len(mean) == 36 and mean[0].mean == pytest.approx(0.98)
    change = spark.createDataFrame([("u", 1, 0.5), ("u", 2, 0.6), ("s", 1, 0.5), ("s", 2, 0.5), ("d", 1, 0.5), ("d", 2, 0.4)], "k string, s int, v double")
    assert {r.k: r.verdict for r in mining.score_change(change, "k", "s", "v").collect()} == {"u": "improved", "s": "unchanged", "d": "decreased"}


def test_sequential_ids_and_first_examples(spark):
    ids = mining.sequential_ids(spark.range(1000).withColumnRenamed("id", "k").repartition(7), "k").orderBy("k").collect()
    assert [r.id for r in ids] == list(range(1000))
    pairs = spark.createDataFrame([("t", 2, "b", "y"), ("t", 1, "a" * 200, "x")], "pair_type string, n int, anchor string, positive string")
    assert mining.first_examples(pairs, "n").first()[:] == ("t", "a" * 100, "x")


# --- sources and sinks


def test_pdf_discovery_and_quarantine(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PDF").write_bytes(b"good")
    (tmp_path / "sub" / "b c.pdf").write_bytes(b"bad")
    (tmp_path / "x.txt").write_bytes(b"no")
    files = readers.pdf_files(spark, str(tmp_path), content=True)
    assert sorted(r.file_name for r in files.collect()) == ["a", "b_c"]

    def make():
        def read(data):
            if data == b"bad":
                raise ValueError("broken")
            return [{"item_type": "text", "page_no": None, "text": "hello", "cells": None}]

        return read

    items, failed = readers.convert(files, make, readers.PARSED)
    assert items.count() == 1 and failed.first().error == "ValueError: broken"


def test_items_become_blocks(spark):
    pages = spark.createDataFrame([("d", ["a", " ", "b"], [0.9, 0.8, None], [[[0.9, 1.2], [10.7, 5.0]], None, None])], "doc_id string, texts array<string>, scores array<double>, polys array<array<array<double>>>")
    got = readers.recognised_items(pages).orderBy("idx").collect()
    assert [(r.text, r.confidence, r.bbox) for r in got] == [("a", 0.9, [0, 1, 10, 5]), ("b", 0.5, None)]
    items = spark.createDataFrame([("d", 0, "text", None, "1 Scope", None), ("d", 1, "table", 2, "", [(0, 0, "h"), (1, 0, "v")]), ("d", 2, "text", 0, " ", None), ("d", 3, "title", 0, "some words", None)], "doc_id string, idx int, item_type string, page_no int, text string, cells array<struct<row:int,col:int,text:string>>")
    rows = readers.parsed_blocks(items).orderBy("block_idx").collect()
    assert [(r.page_number, r.block_type) for r in rows] == [(1, "section_header"), (3, "table"), (1, "title")]
    assert rows[1].text == "| h |\n|---|\n| v |"


def test_upsert_manifest_and_score_files(spark, tmp_path):
    path = str(tmp_path / "set")
    assert sinks.create(spark, path, "chunk_id string, doc string, v int") and not sinks.create(spark, path, "x int")
    rows = lambda *x: spark.createDataFrame(list(x), "chunk_id string, doc string, v int")
    sinks.upsert(spark, path, rows(("a0", "a", 1), ("a1", "a", 1), ("b0", "b", 1)))
    sinks.upsert(spark, path, rows(("a0", "a", 2)))
    assert {(r.chunk_id, r.v) for r in spark.read.parquet(path).collect()} == {("a0", 2), ("a1", 1), ("b0", 1)}
    sinks.upsert(spark, path, rows(("a0", "a", 3)), prune_by="doc")  # the file shrank
    assert {(r.chunk_id, r.v) for r in spark.read.parquet(path).collect()} == {("a0", 3), ("b0", 1)}
    sinks.reset(spark, path)
    assert not sinks.exists(spark, path)
    chunks = spark.createDataFrame([("x", True), ("y", False)], "chunk_id string, has_table boolean")
    r = sinks.manifest(chunks, None, "in", 1.5, {"size": "1000"}).first()
    assert r.total_chunks == 2 and r.stats["tables"] == 1.0 and r.failed_pdfs == [] and r.config == {"size": "1000"}
    (tmp_path / "m.json").write_text(json.dumps({"folder": "f", "chunks": [{"id": 1}, {"id": 2}]}))
    assert readers.chunk_manifest(spark, str(tmp_path / "m.json")).count() == 2
    (tmp_path / "d64.csv").write_text("steps,cosine-NDCG@10\n1,0.5\n2,bad\n")
    (tmp_path / "d32.csv").write_text("steps\n1\n")
    got = readers.score_files(spark, {64: str(tmp_path / "d64.csv"), 32: str(tmp_path / "d32.csv"), 16: str(tmp_path / "none.csv")})
    assert sorted((r.dim, r.steps, r.score) for r in got.collect()) == [(32, 1, 0.0), (64, 1, 0.5), (64, 2, 0.0)]


def test_html_text(spark):
    page = "<html><head><title>t</title></head><body><script>x()</script><p>A &amp; B</p><!-- c --><div>C&nbsp;D</div></body></html>"
    assert column(spark, [page], readers.html_text) == ["A & B\nC D"]


# --- jobs and streams


def test_documents_to_answers(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(d, 1, i, f"{words[d]} unit number {i} has a rated value of {i * 10} volts and more words", "body") for d in range(5) for i in range(8)]
    parsed = spark.createDataFrame(rows, "doc_id long, page_number int, block_idx int, text string, block_type string")
    make = retrieval.hash_embedder(32)
    stored = retrieval.index_documents(spark, parsed, str(tmp_path / "index"), make, 200, 40).count()
    again = retrieval.index_documents(spark, parsed, str(tmp_path / "index"), make, 200, 40)
    assert again.count() == stored > 5
    chunks = again.withColumn("chunk_key", F.col("doc_id") * 1000 + F.col("chunk_index")).withColumn("file_name", F.col("doc_id").cast("string"))
    asked = readers.questions(spark, ["what is the gamma unit", "list the delta values", "zzz"])
    scorer = search.lexical_scorer(asked.withColumnRenamed("qid", "item_id"), chunks, "item_id", "question", "chunk_key", "chunk_text")
    hits = retrieval.hybrid_search(asked, chunks, make, scorer).join(chunks.select(F.col("chunk_key").alias("doc"), "chunk_text", "file_name", "page_number"), "doc")
    best = {r.qid: r.file_name for r in hits.where("rank = 1").collect()}
    assert best[0] == "2" and best[1] == "3"

    def fake():
        def reply(texts):
            if "Name the kind" in texts[0]:
                return ["ENUMERATION" if "list" in texts[0] else "odd"]
            if "JSON" in texts[0]:
                if "gamma" in texts[0].split("Sources")[0]:
                    raise TimeoutError("late")
                return ['```json\n{"items": [{"id": "delta", "description": "x", "source": "s"}], "total_count": 1, "extraction_confidence": "HIGH"}\n```']
            return ["the answer names delta and more to fill the line"]

        return reply

    answers = {r.qid: r for r in retrieval.answer(asked, hits.where("qid < 2"), fake).collect()}
    assert answers[0].query_type == "FALLBACK" and answers[0].confidence == "MEDIUM" and answers[0].is_valid
    assert answers[1].query_type == "ENUMERATION" and answers[1].confidence == "HIGH" and answers[1].is_valid
    assert answers[2].query_type == "NONE"


def test_captions_take_their_tables(spark):
    parsed = spark.createDataFrame([("d", 1, 0, "Table 1 Volts", "table_header"), ("d", 1, 1, "Table 2 Amps", "table_header"), ("d", 1, 2, "body text", "body")], "doc_id string, page_number int, block_idx int, text string, block_type string")
    found = spark.createDataFrame([("d", 1, 1, {"0,0": "a", "1,0": "b"})], "doc_id string, page_number int, nth int, table_data map<string,string>")
    got = retrieval.with_tables(parsed, found).orderBy("block_idx").collect()
    assert [(r.text, r.block_type) for r in got] == [("Table 1 Volts\na | b", "table"), ("Table 2 Amps", "table"), ("body text", "body")]


def test_mining_job(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    base[::2] += 2
    v = base / np.linalg.norm(base, axis=1, keepdims=True)
    chunks = spark.createDataFrame([(i, i % 4, [float(x) for x in r]) for i, r in enumerate(v)], "id long, doc long, v array<double>")
    asked = chunks.where("id < 20").select(F.col("id").alias("qid"), F.col("id").alias("source"), F.when(F.col("id") < 15, 0.9).otherwise(0.1).alias("sim"), "v")
    got = retrieval.mine_pairs(chunks, asked).toPandas()
    assert {"positive", "hard_negative"} <= set(got.pair_type) and got[got.pair_type == "positive"].qid.max() == 14
    assert (got[got.pair_type == "hard_negative"].semantic_similarity.between(0.35, 0.55)).all()
    with pytest.raises(ValueError):
        retrieval.mine_pairs(chunks.limit(5), asked)


def test_queries_in_a_hot_group_get_an_easy_negative(spark, tmp_path):
    """All neighbours of the first 60 vectors are copies: no score is under the threshold."""
    from docquarry import queries

    rng = np.random.default_rng(2)
    v = rng.standard_normal((120, 16))
    v[:60] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(7 * i, [float(x) for x in r], i % 3) for i, r in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    ids = {r[0] for r in rows}
    asked = {i for i in ids if i % 50 == 0}
    hot = {i for i in asked if i < 7 * 60}
    got = {r.qid: r for r in queries.easy_negatives(spark, str(tmp_path)).collect()}
    assert hot and set(got) == asked
    assert all(got[q].score == 0.1 and got[q].label == 0.0 and got[q].doc in ids - {q} for q in hot)
    counted = {r.pair_type: r.n for r in queries.pair_statistics(spark, str(tmp_path)).collect()}
    assert counted["easy_negative"] == len(asked)
    chunks = spark.createDataFrame([(7 * i, i % 3, [float(x) for x in r]) for i, r in enumerate(v)], "id long, doc long, v array<double>")
    questions = chunks.where("id < 70").select(F.col("id").alias("qid"), F.col("id").alias("source"), F.lit(0.9).alias("sim"), "v")
    easy = retrieval.mine_pairs(chunks, questions).where("pair_type = 'easy_negative'").collect()
    assert {r.qid for r in easy} == {7 * i for i in range(10)} and all(r.doc != r.qid and r.doc in ids for r in easy)


def test_made_up_negatives_are_never_the_source(spark):
    chunks = spark.createDataFrame([(i,) for i in (3, 9, 27, 27)], "doc long")
    asked = spark.createDataFrame([(i, s) for i, s in enumerate([3, 9, 27, 5] * 6)], "qid long, source long")
    got = {r.qid: r.doc for r in mining.fallback_negatives(asked, chunks).collect()}
    assert len(got) == 24 and all(got[r.qid] != r.source for r in asked.collect())
    assert mining.fallback_negatives(asked.where("source = 3"), chunks.where("doc = 3")).count() == 0


def test_streams(spark, tmp_path):
    rows = [(c, t, "user", f"m{t}") for c in (1, 2) for t in range(1, 15)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = live.bounded_history(stream).writeStream.format("memory").queryName("kept").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    got = {r.conv_id: r.turns for r in spark.table("kept").orderBy("last_turn").collect()}
    assert got == {1: list(range(5, 15)), 2: list(range(5, 15))}
    keyed = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    live.ingest(spark, keyed.withColumn("chunk_id", F.concat_ws("-", "conv_id", "turn")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 28


def test_upsert_keeps_the_last_of_repeated_keys_and_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "chunks")
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id long, at long, text string")
    sinks.upsert(spark, path, frame([(1, 0, "a"), (2, 0, "b")]))
    sinks.upsert(spark, path, frame([(2, 5, "new"), (2, 9, "newest"), (2, 7, "newer"), (3, 1, "c")]), order="at")
    want = [(1, "a"), (2, "newest"), (3, "c")]
    rows = lambda: sorted((r.chunk_id, r.text) for r in sinks.current(spark, path).collect())
    assert rows() == want
    # A crash between the two steps of the swap: the next rows are whole, or were cut off.
    os.rename(path, path + ".former")
    frame([(9, 0, "next")]).write.parquet(path + ".next")
    assert rows() == [(9, "next")] and not os.path.exists(path + ".former")
    os.rename(path, path + ".former")
    os.makedirs(path + ".next")
    assert rows() == [(9, "next")] and not os.path.exists(path + ".next")


def test_ingest_takes_the_last_row_of_a_key(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, i, f"v{i}") for i in (3, 9, 4)] + [(2, 1, "x")]
    spark.createDataFrame(rows, "chunk_id long, at long, text string").repartition(2).write.parquet(source)
    stream = spark.readStream.schema("chunk_id long, at long, text string").parquet(source)
    live.ingest(spark, stream, path, str(tmp_path / "check"), order="at").awaitTermination()
    assert sorted((r.chunk_id, r.text) for r in sinks.current(spark, path).collect()) == [(1, "v9"), (2, "x")]
