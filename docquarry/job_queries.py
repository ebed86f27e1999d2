"""Registered queries of jobs, sources, sinks and answers, each over its whole tables, with DuckDB SQL.

Where the tables hold no such rows (blocks with boxes, replies of a model), they are made from other
tables by arithmetic, the same way in the query and in its SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import text as tx
from .operators import answering, blocks, chunking, index, ivf, mining, search, tables
from .plans import retrieval
from .queries import _FOLD, _LINES, _NEAR, BM25, SQL, STRIP, TOP, _hits, _kind, _knn_sql, _lines, _TYPE, _vectors, easy_sql, query, read
from .session import scratch
from .sources import readers, sinks


def _folder(spark, name: str) -> str:
    return f"{scratch(spark)}/docquarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# --- analyzer, neighbours, block types --------------------------------------------------------------

_FOLDED = f"replace(translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}'), 'ß', 'ss')"


@query(f"select doc_id, len(ts)::int as n, md5(array_to_string(ts, ' ')) as hash from (select doc_id, list_filter(regexp_split_to_array({_FOLDED}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as ts from documents)")
def folded_tokens(spark, d):
    ts = tx.tokens("text", fold=True)
    return read(spark, d, "documents").select("doc_id", F.size(ts).alias("n"), F.md5(F.array_join(ts, " ").cast("binary")).alias("hash"))


@query(_knn_sql(20))
def neighbour_lists(spark, d):
    v = _vectors(spark, d)
    return search.neighbours(v, v.where("id % 50 = 0"))


@query(_LINES + f"s as (select doc_id, {STRIP.format('t')} as s from ln) select doc_id, kind as block_type, count(*) as n from (select doc_id, {_kind(True)} as kind from s where s <> '') where kind <> 'page_element' group by all")
def section_classify_compat(spark, d):
    return blocks.classify(_lines(spark, d), compat=True).groupBy("doc_id", "block_type").agg(F.count("*").alias("n"))


_P = [f"regexp_matches(s, '(?i){p}')" for p, _ in blocks.PARSER_HEADERS]


@query(_LINES + f"""s as (select doc_id, ['text', 'heading', 'table'][(i % 3 + 1)::int] as ty, {STRIP.format('t')} as s from ln)
select doc_id, case when ty = 'table' then 'table' when length(s) between 3 and 80 and {_P[0]} then 'section_header' when length(s) between 3 and 80 and ({_P[1]} or {_P[2]}) then 'subsection_header'
when length(s) between 3 and 80 and {_P[3]} then 'section_header' when ty = 'heading' then 'title' else 'body' end as block_type, count(*) as n from s group by all""")
def parser_classify(spark, d):
    kind = F.get(F.array(*map(F.lit, ("text", "heading", "table"))), F.pmod("block_idx", F.lit(3)))
    typed = _lines(spark, d).withColumn("block_type", blocks.parser_block_type(F.col("text"), kind))
    return typed.groupBy("doc_id", "block_type").agg(F.count("*").alias("n"))


@query(f"""with recursive h as (select conv_id, turn, (turn * 7 + conv_id) % 4 as level, (turn + 1) || ' part' as entry, row_number() over (partition by conv_id order by turn) as i from conversations where (turn * 7 + conv_id) % 4 > 0),
r(conv_id, i, turn, st) as (select conv_id, i, turn, [entry] from h where i = 1
 union all select h.conv_id, h.i, h.turn, list_concat(list_slice(r.st, 1, least(h.level - 1, len(r.st))), [h.entry]) from r join h on h.conv_id = r.conv_id and h.i = r.i + 1)
select conv_id as doc_id, turn as block_idx, array_to_string(st, ' > ') as path from r""")
def section_hierarchy(spark, d):
    heads = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_idx"), F.pmod(F.col("turn") * 7 + F.col("conv_id"), F.lit(4)).cast("int").alias("level"), (F.col("turn") + 1).cast("string").alias("section_number"), F.lit("Heading part").alias("text"))
    return blocks.hierarchy(heads).select("doc_id", "block_idx", F.array_join("section_hierarchy", " > ").alias("path"))


@query("""select l_orderkey || '.' || l_linenumber || case when l_linenumber % 2 = 0 then '.1' else '' end as number, case when l_linenumber % 2 = 0 then l_orderkey || '.' || l_linenumber else l_orderkey::varchar end as parent, count(*) as n from lineitem group by all""")
def parent_section(spark, d):
    number = F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".1").otherwise(""))
    return read(spark, d, "lineitem").select(number.alias("number"), blocks.parent_section(number).alias("parent")).groupBy("number", "parent").agg(F.count("*").alias("n"))


@query("""with b as (select conv_id, ['table', 'body', 'section_header', 'table_header'][(turn % 4 + 1)::int] as ty, turn / 10.0 as c from conversations)
select conv_id, round(coalesce(avg(c) filter (ty <> 'table'), 0), 6)::double as avg_confidence, count(*) as n_blocks, count(*) filter (ty in ('table', 'table_header')) as n_tables, count(*) filter (ty = 'section_header') as n_sections from b group by conv_id""")
def block_confidence(spark, d):
    kind = F.get(F.array(*map(F.lit, ("table", "body", "section_header", "table_header"))), F.pmod("turn", F.lit(4)).cast("int"))
    held = read(spark, d, "conversations").select("conv_id", kind.alias("block_type"), (F.col("turn") / 10).alias("confidence"))
    return blocks.confidence(held, "conv_id").withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("""with p as (select conv_id, turn, role || ' ' || turn as t, turn % 2 = 0 as cap from conversations),
c as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as nth from p where cap)
select p.conv_id as doc_id, p.turn as block_idx, case when cap then 'table' else 'body' end as block_type, case when cap and f.conv_id is not null then t || chr(10) || 'a' || p.conv_id || ' | b' else t end as text
from p left join c on c.conv_id = p.conv_id and c.turn = p.turn left join conversations f on f.conv_id = p.conv_id and f.turn = c.nth - 1 and f.turn < 2""")
def caption_tables(spark, d):
    """Every second message is a caption; the first two of a conversation have tables."""
    talk = read(spark, d, "conversations")
    parsed = talk.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_number"), F.col("turn").alias("block_idx"), F.concat_ws(" ", "role", "turn").alias("text"), F.when(F.col("turn") % 2 == 0, "table_header").otherwise("body").alias("block_type"))
    data = F.create_map(F.lit("0,0"), F.concat(F.lit("a"), F.col("conv_id").cast("string")), F.lit("1,0"), F.lit("b"))
    found = talk.where("turn < 2").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("turn") + 1).cast("int").alias("nth"), data.alias("table_data"))
    return retrieval.with_tables(parsed, found).select("doc_id", "block_idx", "block_type", "text")


_PAGED = "with recursive ln as" + _FOLD.split("with recursive ln as", 1)[1].split(",\nl as", 1)[0] + ",\nln0 as (select doc_id * 100000 + (i - 1) // 4 as doc_id, t, i from ln),\nl as" + _FOLD.split(",\nl as", 1)[1].replace("from ln where", "from ln0 where").replace("> 20)", "> 0)")


@query(_PAGED.replace("row_number() over (partition by doc_id order by i) - 1 as k from ch)", "row_number() over (partition by doc_id // 100000 order by doc_id, i) - 1 as k from ch)") + " select doc_id // 100000 as doc_id, k::int as chunk_index, (doc_id % 100000 + 1)::int as page_number, c as chunk_text from nu")
def chunk_pages(spark, d):
    """Four lines stand in for a page."""
    paged = _lines(spark, d).select("doc_id", (F.floor(F.col("block_idx") / 4) + 1).cast("int").alias("page_number"), "block_idx", "text", F.lit("body").alias("block_type"))
    return chunking.chunk_pages(paged).select("doc_id", "chunk_index", "page_number", "chunk_text")


@query("""with m as (select conv_id, (turn * 40)::int as s, (turn * 40 + 10 + conv_id % 40)::int as e from conversations),
p as (select conv_id, turn, (turn * 33 + conv_id % 17)::int as x from conversations)
select conv_id, turn, exists (select 1 from m where m.conv_id = p.conv_id and s <= x and x < e) as inside, (select min(s) from m where m.conv_id = p.conv_id and s > x)::int as next_start from p""")
def interval_lookup(spark, d):
    talk = read(spark, d, "conversations")
    made = F.struct((F.col("turn") * 40).cast("int").alias("start"), (F.col("turn") * 40 + 10 + F.col("conv_id") % 40).cast("int").alias("end"))
    held = talk.groupBy("conv_id").agg(F.collect_list(made).alias("spans"))
    at = (F.col("turn") * 33 + F.col("conv_id") % 17).cast("int")
    return talk.join(held, "conv_id").select("conv_id", "turn", chunking.inside(at, F.col("spans")).alias("inside"), chunking.next_interval(at, F.col("spans"))["start"].alias("next_start"))


# --- stored index, inverted lists ------------------------------------------------------------------


def _indexed(spark, d) -> str:
    """The documents in two segments, after texts that are added again and documents that are removed."""
    docs, path = read(spark, d, "documents").select("doc_id", "text"), _folder(spark, "index")
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index.add(even.withColumn("text", F.reverse("text")).unionByName(docs.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text").where("doc_id % 2 = 0")), path)
    index.add(odd.unionByName(even), path)
    index.remove(spark, path, docs.select((F.col("doc_id") + 10_000_000).alias("doc_id")))
    return path


@query(SQL["bm25_topk"])
def indexed_bm25(spark, d):
    return index.best(spark, _indexed(spark, d), read(spark, d, "benchmark"), "item_id", "text", 10)


@query(SQL["phrase_slop"])
def indexed_phrase(spark, d):
    return search.top(index.phrase(spark, _indexed(spark, d), read(spark, d, "benchmark"), "item_id", "text"), search.BM25_SIZE)


@query("select b as filtered, count(*) filter (vec_id % 50 = 0)::bigint as queries, true as recalled, true as passes from embeddings, (select unnest([false, true]) as b) group by b")
def knn_inverted_lists(spark, d):
    """Whether nine tenths of the exact 30 neighbours are found, without and with a filter, and all hits pass it."""
    v = _vectors(spark, d).withColumn("has_table", F.col("label").isin(1, 3, 5))
    path, ask = _folder(spark, "cells"), v.where("id % 50 = 0")
    lists = ivf.train(v)
    ivf.build(v, lists, path)
    out = None
    for wanted in (None, {"has_table": True}):
        held = search.filters(v, wanted)
        found = ivf.find(spark, path, lists, ask, 30, wanted).select("qid", "doc", F.lit(True).alias("found"))
        exact = search.nearest(held, ask, 30).select("qid", "doc")
        shares = exact.join(found, ["qid", "doc"], "left").agg((F.count("found") >= 0.9 * F.count("*")).alias("recalled"))
        passes = found.join(held.select(F.col("id").alias("doc")), "doc", "left_anti").agg((F.count("*") == 0).alias("passes"))
        row = ask.agg(F.count("*").alias("queries")).crossJoin(shares).crossJoin(passes).withColumn("filtered", F.lit(wanted is not None))  # one row each
        out = row if out is None else out.unionByName(row)
    return out.select("filtered", "queries", "recalled", "passes")


# --- tables ----------------------------------------------------------------------------------------


@query("""with b as (select conv_id, turn, case when turn % 4 = 3 then text || text || text else text end as t, turn * 80 + (turn * conv_id) % 3 * 40 as y from conversations),
g as (select *, y - coalesce(lag(y) over (partition by conv_id order by turn), 0) as gap, row_number() over (partition by conv_id order by turn) as i from b),
e as (select *, (gap > 100 and (length(t) > 100 or regexp_matches(t, '^\\p{Ll}') or t = '')) or length(t) > 200 as ends from g)
select conv_id, coalesce(min(i) filter (ends) - 1, count(*))::int as n_blocks from e group by conv_id""")
def table_region(spark, d):
    """Whole messages as cells, every fourth one three times over, so that long cells are among them."""
    said = F.when(F.col("turn") % 4 == 3, F.concat("text", "text", "text")).otherwise(F.col("text"))
    top = (F.col("turn") * 80 + F.pmod(F.col("turn") * F.col("conv_id"), F.lit(3)) * 40).cast("int")
    cell = F.struct("turn", said.alias("text"), F.array(F.lit(0), top, F.lit(10), top + 10).alias("bbox"))
    held = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return held.select("conv_id", F.size(tables.region(F.col("cells"), F.lit(0))).alias("n_blocks"))


@query("""select n_regionkey, '| name | key |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) order by n_nationkey) as shown from nation group by n_regionkey""")
def list_rendering(spark, d):
    row = F.struct("n_nationkey", F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string"), F.lit("source"), F.lit("s")).alias("m"))
    # Maps have no order: the rows are sorted by key, then the maps are taken.
    held = read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(row), lambda a, b: (a["n_nationkey"] - b["n_nationkey"]).cast("int")).alias("rs"))
    return held.select("n_regionkey", tables.render_list(F.transform("rs", lambda r: r["m"]), F.array(*map(F.lit, ("name", "key", "source")))).alias("shown"))


@query("""with n as (select n_regionkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as r from nation)
select n_regionkey, count(*)::int as "rows", 2 as cols, string_agg('| ' || r || ' | ' || n_name || ' |' || case when r = 0 then chr(10) || '|---|---|' else '' end, chr(10) order by r) as shown from n group by n_regionkey""")
def parsed_table(spark, d):
    place = F.row_number().over(mining.Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    cell = lambda col, text: F.struct(F.col("r").alias("row"), F.lit(col).alias("col"), text.alias("text"))
    held = read(spark, d, "nation").withColumn("r", place).groupBy("n_regionkey").agg(F.flatten(F.collect_list(F.array(cell(0, F.col("r").cast("string")), cell(1, F.col("n_name"))))).alias("cells"))
    found = held.withColumn("t", tables.parsed_cells(F.col("cells")))
    return found.select("n_regionkey", "t.rows", "t.cols", tables.render_grid(F.col("t.table_data"), F.col("t.rows"), F.col("t.cols")).alias("shown"))


# --- answers ---------------------------------------------------------------------------------------


@query(f"""with l as (select conv_id, turn, list_transform(string_split({STRIP.format("replace(text, '. ', '?' || chr(10)) || '?'")}, chr(10)), lambda x: regexp_replace(regexp_replace({STRIP.format('x')}, '^[\\d.\\-*)\\]]+\\s*', ''), '^["'']+|["'']+$', '', 'g')) as ls from conversations)
select conv_id, turn, array_to_string(list_slice(list_filter(ls, lambda q: length(q) between 15 and 200 and contains(q, '?') and not regexp_matches(lower(q), '^(here|sure|of course|certainly)')), 1, 3), chr(10)) as questions from l""")
def question_lines(spark, d):
    """Sentences stand in for the lines of a generator's reply."""
    reply = F.concat(F.replace(F.col("text"), F.lit(". "), F.lit("?\n")), F.lit("?"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(mining.questions_of(reply, 3), "\n").alias("questions"))


_SAID = "['It is a definition', 'Table_Data, I think', 'no idea', 'COMPARISON or PROCEDURE'][(turn % 4 + 1)::int]"


@query(f"select conv_id, turn, coalesce({', '.join(f'''case when contains(upper({_SAID}), '{t}') then '{t}' end''' for t in answering.TYPES)}, {_TYPE}) as query_type from conversations")
def reply_types(spark, d):
    said = F.get(F.array(*map(F.lit, ("It is a definition", "Table_Data, I think", "no idea", "COMPARISON or PROCEDURE"))), F.pmod("turn", F.lit(4)).cast("int"))
    return read(spark, d, "conversations").select("conv_id", "turn", answering.replied_type(said, F.col("text")).alias("query_type"))


@query("""with r as (select conv_id, turn, case turn % 3 when 0 then ' None. ' when 1 then left(text, 15) else ' ' || text || ' ' end as t from conversations)
select conv_id, turn, case when length(trim(t)) >= 20 and lower(trim(t)) not in ('none', 'none.', 'n/a', 'nothing', 'no additional information') then trim(t) end as added from r""")
def answer_complement(spark, d):
    third = F.pmod("turn", F.lit(3))
    reply = F.when(third == 0, F.lit(" None. ")).when(third == 1, F.left("text", F.lit(15))).otherwise(F.concat(F.lit(" "), "text", F.lit(" ")))
    return read(spark, d, "conversations").select("conv_id", "turn", answering.complement(reply).alias("added"))


@query(f"""select n_regionkey, '{answering.LISTED}' || chr(10) || chr(10) || string_agg(r || '. ' || n_name || ': nation ' || n_nationkey || chr(10) || '   [Source: s' || n_nationkey || ']', chr(10) order by r) as shown
from (select *, row_number() over (partition by n_regionkey order by n_nationkey) as r from nation) group by n_regionkey""")
def facts_text(spark, d):
    item = F.struct(F.col("n_nationkey"), F.col("n_name").alias("id"), F.concat_ws(" ", F.lit("nation"), "n_nationkey").alias("description"), F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("source"))
    held = read(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    block = F.to_json(F.struct("items", F.size("items").alias("total_count")))
    return held.select("n_regionkey", answering.facts_as_text(block, F.lit("ENUMERATION")).alias("shown"))


_REPLY = """case turn % 5 when 0 then '{"term": "a", "definition": "b", "source": "c", "extraction_confidence": "HIGH"}' when 1 then '{"definition": "b", "source": "c", "extraction_confidence": "HIGH"}'
when 2 then '{"term": "a", "definition": "b", "source": null, "extraction_confidence": "LOW"}' when 3 then '{"term": "a", "definition": "b", "source": "c", "extraction_confidence": "SURE"}' else 'no object' end"""


@query(f"""with r as (select conv_id, turn, {_REPLY} as t from conversations), j as (select *, case when json_valid(t) then t::json end as o from r)
select conv_id, turn, case when o is null then 'no JSON object' when coalesce(json_type(o, '$.term'), 'NULL') = 'NULL' then '$.term is missing or no string' when coalesce(json_type(o, '$.definition'), 'NULL') = 'NULL' then '$.definition is missing or no string'
when coalesce(json_type(o, '$.source'), 'NULL') = 'NULL' then '$.source is missing or no string' when o->>'$.extraction_confidence' not in ('HIGH', 'MEDIUM', 'LOW') then 'extraction_confidence is none of the three' end as error from j""")
def facts_check(spark, d):
    rows = read(spark, d, "conversations").withColumn("t", F.expr(_REPLY))
    return rows.select("conv_id", "turn", answering.facts_error(answering.json_block(F.col("t")), "DEFINITION").alias("error"))


_PIPED = "replace(text, chr(10), ' |' || chr(10) || '---| ')"


@query(f"""with a as (select conv_id, turn, length({_PIPED}) - length(replace({_PIPED}, '|', '')) - (length({_PIPED}) - length(replace({_PIPED}, '---', ''))) // 3 as n, turn * 2 as want from conversations)
select conv_id, turn, case when n < want then '{answering.SHORT_TABLE}'.replace('(n)', n::varchar).replace('(want)', want::varchar) end as error from a""")
def table_answer_validation(spark, d):
    answer = F.replace(F.col("text"), F.lit("\n"), F.lit(" |\n---| "))
    facts = F.to_json(F.struct((F.col("turn") * 2).alias("row_count")))
    return read(spark, d, "conversations").select("conv_id", "turn", answering.validation_error(F.lit("q"), answer, facts, F.lit("TABLE_DATA")).alias("error"))


_HITS = "with " + BM25.replace("{boost}", "1.0") + f", h as (select t.qid, t.rank, t.score, source, text from ({TOP.format('bm', 10)}) t join documents on doc_id = doc)"


@query(_HITS + " select qid, bool_or(contains(text, '|')) as has_tables, array_to_string(coalesce(list(source order by rank) filter (contains(text, '|')), []), ',') as heads from h group by qid")
def table_hints(spark, d):
    has = F.contains("chunk_text", F.lit("|"))
    hits = _hits(spark, d).withColumn("has_table", has).withColumn("table_header", F.when(has, F.col("file_name")).otherwise(""))
    return answering.table_hint(hits).select("qid", "has_tables", F.array_join("table_headers", ",").alias("heads"))


@query(_HITS + """ select qid, rank::int as rank, source as file, 1 as page, round(score, 3) as score, 'body' as content_type, contains(text, '|') as has_table, left(text, 150) || '...' as preview from h""")
def answer_sources(spark, d):
    hits = _hits(spark, d).withColumn("final_score", F.col("score")).withColumn("content_type", F.lit("body")).withColumn("has_table", F.contains("chunk_text", F.lit("|")))
    return answering.sources(hits)


# --- sources and sinks ------------------------------------------------------------------------------


@query("""select conv_id, turn::int as idx, text, case when turn % 2 = 0 then 0.5 else turn / 10.0 end::double as confidence, case when turn % 3 = 0 then null else (turn || ',0,' || (turn + 9) || ',5') end as box from conversations where regexp_matches(text, '\\S')""")
def recognised_items(spark, d):
    """A conversation as the recogniser's parallel arrays; turns without a score or with a broken polygon among them."""
    pt = lambda x, y: F.array(x.cast("double"), F.lit(y).cast("double"))
    t = F.col("turn")
    poly = F.when(t % 3 == 0, F.array(pt(t, 0.0))).otherwise(F.array(pt(t + 0.4, 0.2), pt(t + 9.9, 0.0), pt(t + 9.5, 5.9), pt(t + 0.4, 5.0)))
    whole = F.struct(t, F.col("text"), F.when(t % 2 == 1, t / 10).alias("score"), poly.alias("poly"))
    pages = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(whole)).alias("x"))
    pages = pages.select("conv_id", F.col("x.text").alias("texts"), F.col("x.score").alias("scores"), F.col("x.poly").alias("polys"))
    return readers.recognised_items(pages).select("conv_id", "idx", "text", "confidence", F.array_join(F.transform("bbox", lambda v: v.cast("string")), ",").alias("box"))


@query(_FOLD + " select count(*)::int as total_chunks, 0.0::double as n_tables, 'x' as folder_path, 0 as n_failed from nu")
def index_manifest(spark, d):
    made = sinks.manifest(chunking.chunk_lines(read(spark, d, "documents")), None, "x", 1.0, {"size": "1000"})
    return made.select("total_chunks", F.col("stats")["tables"].alias("n_tables"), "folder_path", F.size("failed_pdfs").alias("n_failed"))


@query("select case when (doc_id * 7919 + 13) % 10 < 1 then 'test' else 'train' end as split, count(*) as n, sum(length(text))::bigint as n_chars, round(sum(doc_id % 10 / 10.0), 4)::double as labels from documents where text <> '' and lang <> '' group by 1")
def training_files(spark, d):
    """Examples written by split as JSON lines, and read again."""
    docs = mining.split(read(spark, d, "documents"), "doc_id")
    path = _folder(spark, "training")
    rows = docs.select("doc_id", "split", F.col("text").alias("anchor"), F.col("lang").alias("positive"), (F.col("doc_id") % 10 / 10).alias("label"))
    sinks.write_splits(mining.examples(rows), path)
    read_again = readers.dataset(spark, path, "anchor string, positive string, label double, split string", multi_line=False)
    return read_again.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("anchor")).alias("n_chars"), F.round(F.sum("label"), 4).alias("labels"))


@query("""with n as (select doc_id, upper(lang) as lang, 'new' as origin from documents where lang <> 'en' union all select doc_id + 10000000, lang, 'new' from documents where lang = 'en')
select doc_id, lang, 'old' as origin from documents where doc_id not in (select doc_id from n) union all select * from n""")
def dataset_upsert(spark, d):
    """A dataset made empty, filled, and upserted with rows that repeat their keys; then read."""
    docs, path = read(spark, d, "documents"), _folder(spark, "dataset")
    sinks.create(spark, path, "doc_id bigint, lang string, origin string")
    sinks.upsert(spark, path, docs.select("doc_id", "lang", F.lit("old").alias("origin")), "doc_id")
    new = docs.where("lang <> 'en'").select("doc_id", F.upper("lang").alias("lang"), F.lit("new").alias("origin"))
    more = docs.where("lang = 'en'").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "lang", F.lit("new").alias("origin"))
    sinks.upsert(spark, path, new.unionByName(more).unionByName(new), "doc_id")
    return sinks.current(spark, path)


@query("select (label % 4)::int as dim, vec_id as steps, round(vec_id % 7 / 7.0, 6) as score from embeddings")
def evaluation_files(spark, d):
    """Scores written as one CSV folder per dimension, and read again."""
    rows = read(spark, d, "embeddings").select(F.pmod("label", F.lit(4)).cast("int").alias("dim"), F.col("vec_id").alias("steps"), F.round(F.col("vec_id") % 7 / 7, 6).alias("cosine-NDCG@10"))
    paths = {n: _folder(spark, f"scores{n}") for n in range(4)}
    for n, path in paths.items():
        rows.where(F.col("dim") == n).drop("dim").write.csv(path, header=True)
    return readers.score_files(spark, paths)


_RELATED = "select qid, doc, 'related' as pair_type, round(0.5 + 0.3 * score, 2) as label, score as semantic_similarity from near where same and score > 0.5 qualify row_number() over (partition by qid order by rank) = 1"
_HARDER = "select qid, doc, 'hard_negative', 0.0::double, score from (select *, row_number() over (partition by qid order by rank) as f from near where not same and score between 0.35 and 0.55 qualify f <= 5) qualify row_number() over (partition by qid order by ((doc * 7919 + qid * 104729 + 42) % 1009), doc) = 1"
_EASIER = easy_sql(0.35, "qid, doc, 'easy_negative', label, score")


@query(_NEAR + f" select vec_id as qid, vec_id as doc, 'positive' as pair_type, round(0.8 + (0.9 - 0.65) * 0.5, 2)::double as label, 0.9::double as semantic_similarity from embeddings where vec_id % 50 = 0 union all ({_RELATED}) union all ({_HARDER}) union all ({_EASIER})")
def mined_pairs(spark, d):
    """The mining job: vectors as chunks, labels as files, vectors of the searches' query set as questions."""
    chunks = _vectors(spark, d).select("id", F.col("label").alias("doc"), "v")
    questions = chunks.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("id").alias("source"), F.lit(0.9).alias("sim"), "v")
    return retrieval.mine_pairs(chunks, questions)
