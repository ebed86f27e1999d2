"""Queries on rows with headers, captions, cues and hedges, which the tables lack.

The rows are made from messages by one expression that Spark and DuckDB both read, so that each rule
has rows that meet it and rows that don't.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import stand_ins
from .job_queries import _HITS
from .operators import answering, blocks, chunking, history, mining, search
from .plans import retrieval
from .queries import _KIND, _PAGE, STRIP, TOP, _bm25_ctes, _hits, _kind, query, read

#: A message, or a line of a report in its place.
MADE = """case (turn * 5 + conv_id) % 13 when 0 then (turn + 1) || ' Main Heading' when 1 then (turn + 1) || '.2 Lower Heading' when 2 then (turn + 1) || '.2.3 Lowest Heading'
when 3 then 'Appendix B - Notes' when 4 then 'Table ' || turn || ' Ratings' when 5 then 'Page ' || turn when 6 then '2 Voltage Levels' when 7 then '3 of the parts' when 8 then 'Chapter 4: Wires' when 9 then '12 kHz'
when 10 then (turn + 1) || '.1 of the parts' else text end"""


def _made(spark, d, per_page: int = 4):
    """Conversations as documents of four lines a page."""
    page = (F.floor(F.col("turn") / per_page) + 1).cast("int")
    return read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_idx"), page.alias("page_number"), F.expr(MADE).alias("text"))


def _first_of(patterns, value) -> str:
    return "case " + " ".join(f"when regexp_matches(s, '(?i){p}') then {value(p, k)}" for p, k in patterns) + " end"


def _typed(compat: bool) -> str:
    """typed(doc_id, i, page, s, kind, number, level) of the made lines."""
    kind = _kind(True) if compat else _KIND
    head = "kind in ('section_header', 'subsection_header')"
    number = _first_of(blocks.HEADERS, lambda p, _: f"regexp_extract(s, '(?i){p}', 1)")
    level = _first_of(blocks.HEADERS, lambda _, k: str(blocks.LEVELS[k]))
    # Titles stand on the first page alone.
    kind = kind.replace(f"and not {_PAGE} then 'title'", f"and not {_PAGE} and page = 1 then 'title'")
    # A three-level number is a header of a lower level; so are all but major ones and appendices.
    return f"""made as (select conv_id as doc_id, turn as i, (turn // 4 + 1)::int as page, {STRIP.format("(" + MADE + ")")} as s from conversations),
typed as (select doc_id, i, page, s, kind, case when {head} then {number} end as number, case when {head} then {level} else 0 end as level from (select *, {kind} as kind from made where s <> '') where kind <> 'page_element')"""


def _typed_rows(spark, d, compat: bool):
    return blocks.classify(_made(spark, d), compat=compat)


@query("with " + _typed(False) + " select doc_id, i as block_idx, page as page_number, kind as block_type, number as section_number, level::int as level from typed")
def made_headers(spark, d):
    return _typed_rows(spark, d, False).select("doc_id", "block_idx", "page_number", "block_type", "section_number", F.col("level").cast("int").alias("level"))


@query("with " + _typed(True) + " select doc_id, i as block_idx, kind as block_type, number as section_number from typed")
def made_headers_compat(spark, d):
    return _typed_rows(spark, d, True).select("doc_id", "block_idx", "block_type", "section_number")


_PARSED = _first_of(blocks.PARSER_HEADERS, lambda _, level: "'section_header'" if level == 1 else "'subsection_header'")


@query(f"""with made as (select conv_id as doc_id, turn as i, ['text', 'heading', 'table'][(turn % 3 + 1)::int] as ty, {STRIP.format("(" + MADE + ")")} as s from conversations)
select doc_id, i as block_idx, coalesce(case when ty = 'table' then 'table' end, case when length(s) between 3 and 80 then {_PARSED} end, case when ty = 'heading' then 'title' else 'body' end) as block_type from made""")
def made_parser_headers(spark, d):
    kind = F.get(F.array(*map(F.lit, ("text", "heading", "table"))), F.pmod("block_idx", F.lit(3)).cast("int"))
    return _made(spark, d).select("doc_id", "block_idx", blocks.parser_block_type(F.col("text"), kind).alias("block_type"))


# --- sections on chunks -----------------------------------------------------------------------------

_TITLE = _first_of(blocks.HEADERS, lambda p, _: STRIP.format(f"regexp_extract(s, '(?i){p}', 2)"))
_ENTRY = f"number || case when {STRIP.format(chr(39).join(['regexp_replace(s, ', '(?i)^[\\d.A-Z]+\\s*', ', ', '', ')']))} = '' then ' ' else ' ' || {STRIP.format(chr(39).join(['regexp_replace(s, ', '(?i)^[\\d.A-Z]+\\s*', ', ', '', ')']))} end"
_SIZE, _OVERLAP = 150, 30
_OWN = ", ".join(f"'{k}'" for k in chunking.OWN)


def _sectioned(compat: bool) -> str:
    flushed = "sec" if compat else "r.bsec"
    return _typed(False).replace("made as", "recursive made as", 1) + f""",
hd as (select doc_id, i, level, {_ENTRY} as entry, number, {_TITLE} as title, row_number() over (partition by doc_id order by i) as h from typed where level > 0),
st(doc_id, h, i, stack) as (select doc_id, h, i, [entry] from hd where h = 1
 union all select hd.doc_id, hd.h, hd.i, list_concat(list_slice(st.stack, 1, least(hd.level - 1, len(st.stack))), [hd.entry]) from st join hd on hd.doc_id = st.doc_id and hd.h = st.h + 1),
sx as (select hd.doc_id, hd.i, {{'n': number, 't': title, 'p': array_to_string(stack, ' > ')}} as sec from hd join st using (doc_id, h)),
bl as (select t.doc_id, t.page, t.i, t.s, t.kind, (select max_by(sec, sx.i) from sx where sx.doc_id = t.doc_id and sx.i <= t.i) as sec, row_number() over (partition by t.doc_id, t.page order by t.i) as k from typed t),
r(doc_id, page, k, buf, bsec, outs) as (select distinct doc_id, page, 0::bigint, null::varchar, null::struct(n varchar, t varchar, p varchar), []::struct(c varchar, ty varchar, sec struct(n varchar, t varchar, p varchar))[] from bl
 union all select r.doc_id, r.page, bl.k, case when own then null when length(nb) >= {_SIZE} then case when length(nb) > {_OVERLAP} then right(nb, {_OVERLAP}) end else nb end, case when own then r.bsec else sec end,
 case when own then list_concat(case when coalesce({STRIP.format('r.buf')}, '') <> '' then [{{'c': {STRIP.format('r.buf')}, 'ty': 'body', 'sec': {flushed}}}] else [] end, [{{'c': s, 'ty': kind, 'sec': sec}}]) when length(nb) >= {_SIZE} then [{{'c': {STRIP.format('nb')}, 'ty': 'body', 'sec': sec}}] else [] end
 from r join bl on bl.doc_id = r.doc_id and bl.page = r.page and bl.k = r.k + 1, lateral (select coalesce(r.buf || chr(10), '') || bl.s as nb, bl.kind in ({_OWN}) as own) x),
ends as (select doc_id, page, max(k) as k from r group by all),
ch as (select doc_id, page, k, unnest(outs) as o, generate_subscripts(outs, 1) as j from r union all
 select r.doc_id, r.page, r.k + 1, {{'c': {STRIP.format('r.buf')}, 'ty': 'body', 'sec': r.bsec}}, 1 from r join ends using (doc_id, page, k) where coalesce({STRIP.format('r.buf')}, '') <> '')
select doc_id, (row_number() over (partition by doc_id order by page, k, j) - 1)::int as chunk_index, page as page_number, o.ty as content_type, o.c as chunk_text, o.sec.n as section_number, o.sec.t as section_title, o.sec.p as path,
case when contains(o.sec.n, '.') then regexp_replace(o.sec.n, '\\.[^.]*$', '') end as parent_section from ch"""


def _chunk_sections(spark, d, compat: bool):
    made = chunking.chunk_pages(_typed_rows(spark, d, False), _SIZE, _OVERLAP, compat=compat)
    return made.select("doc_id", "chunk_index", "page_number", "content_type", "chunk_text", "section_number", "section_title", F.array_join("section_hierarchy", " > ").alias("path"), "parent_section")


@query("with " + _sectioned(False))
def chunk_sections(spark, d):
    return _chunk_sections(spark, d, False)


@query("with " + _sectioned(True))
def chunk_sections_compat(spark, d):
    """Body before a header in that header's section."""
    return _chunk_sections(spark, d, True)


# --- cues, table hints, hedges, counts, long histories ------------------------------------------------

_ASKED = "(select item_id, text || case when item_id % 2 = 0 then ' and its values' else '' end as text from benchmark)"


@query("with " + _bm25_ctes().replace("from benchmark)", f"from {_ASKED})").replace("{boost}", "2.0") + f""",
tb as (select q.item_id as qid, doc_id as doc, 3.0 as score from {_ASKED} q, documents where regexp_matches(lower(q.text), 'table|levels|values|ratings|specifications') and doc_id % 7 = 0),
sh as (select qid, doc, sum(score) as score from (select * from bm union all select * from tb) group by all) """ + TOP.format("sh", 50))
def table_cue_questions(spark, d):
    """Every second question asks for values; every seventh document counts as a table."""
    docs = read(spark, d, "documents")
    ask = read(spark, d, "benchmark").withColumn("text", F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(" and its values"))).otherwise(F.col("text")))
    held = search.analysed(docs)
    asks = ask.where(search.wants_table(F.col("text"))).select(F.col("item_id").alias("qid"))
    tabled = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("doc"))
    return search.bm25_best(held, search.query_terms(ask, "item_id", "text"), search.BM25_SIZE, search.BOOST_TEXT, [search.tables_clause(asks, tabled)])


@query(_HITS + " select qid, bool_or(doc % 5 = 0) as has_tables, array_to_string(coalesce(list(source order by rank) filter (doc % 5 = 0), []), ',') as heads from (select h.*, t.doc from h join (" + TOP.format("bm", 10) + ") t using (qid, rank)) group by qid")
def table_hints_made(spark, d):
    """Every fifth document counts as a table."""
    has = F.col("doc") % 5 == 0
    hits = _hits(spark, d).withColumn("has_table", has).withColumn("table_header", F.when(has, F.col("file_name")).otherwise(""))
    return answering.table_hint(hits).select("qid", "has_tables", F.array_join("table_headers", ",").alias("heads"))


_ANSWER = "case turn % 4 when 0 then 'However, I found ' || text when 1 then text || ' I was unable to find more.' when 2 then text || ' 3 parts of 7' else text end"


@query(f"""with a as (select conv_id, turn, lower({_ANSWER}) as s from conversations)
select conv_id, turn, case {' '.join(f"when contains(s, '{h.replace(chr(39), chr(39) * 2)}') then '{answering.HEDGED}{h.replace(chr(39), chr(39) * 2)}'" for h in answering.HEDGES)} end as error from a""")
def hedged_answers(spark, d):
    rows = read(spark, d, "conversations").withColumn("answer", F.expr(_ANSWER))
    return rows.select("conv_id", "turn", answering.validation_error(F.lit("q"), F.col("answer"), F.lit("{}"), F.lit("DEFINITION")).alias("error"))


@query("""with k as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id desc) as r, count(*) over (partition by user_id) as n from events)
select user_id, event_id, event_type, n > 10 as capped from k where r <= 10""")
def history_cap(spark, d):
    """Events as messages: users with over ten of them keep ten."""
    events = read(spark, d, "events").select("user_id", "event_id", "event_type")
    n = events.groupBy("user_id").agg((F.count("*") > 10).alias("capped"))
    return history.last_messages(events, key="user_id", order="event_id").join(n, "user_id")


# --- tables of pages, mended facts, a budget ----------------------------------------------------------

_LONG = "'and a paragraph that follows the table: ' || repeat('with words enough, ', 12) || text"


@query(f"""with c as (select *, conv_id % 2 + 2 as nr, conv_id % 3 + 1 as nc from conversations where turn < 2),
g as (select conv_id, turn, string_agg(line, chr(10) order by r) as body from (select conv_id, turn, r, string_agg('r' || r || 'c' || k, ' | ' order by k) as line from (select conv_id, turn, unnest(range(nr)) as r, nc from c), lateral (select unnest(range(nc)) as k) group by all) group by all),
b as (select conv_id, turn, 0 as k, 'body' as ty, 'about ' || role as t from c union all select conv_id, turn, 1, 'table', 'Table ' || (turn + 1) || ' Ratings' || chr(10) || body from g join c using (conv_id, turn)
 union all select conv_id, turn, 2, 'body', {STRIP.format(_LONG)} from c union all select conv_id, turn, 3, 'table', 'Table 9 without cells' from c)
select conv_id as doc_id, (row_number() over (partition by conv_id order by turn, k) - 1)::int as chunk_index, (turn + 1)::int as page_number, ty as content_type, t as chunk_text from b""")
def recognised_tables(spark, d):
    """The first two messages of a conversation as pages of recognised items: grids of 2 or 3 rows by 1 to 3
    columns, jittered within the tolerances and with gaps, then a long paragraph and a caption alone."""
    talk = read(spark, d, "conversations").where("turn < 2")
    box = lambda x, y: F.array(x, y, x + 40, y + 10)
    item = lambda i, text, bbox: F.struct(i.cast("long").alias("block_idx"), text.alias("text"), bbox.cast("array<int>").alias("bbox"))
    rows, cols = F.col("conv_id") % 2 + 2, F.col("conv_id") % 3 + 1
    one = lambda r, c: item(10 + r * 10 + c, F.concat(F.lit("r"), r.cast("string"), F.lit("c"), c.cast("string")), box(c * 100 + (r * 7) % 11, 60 + r * 60 + (c * 5) % 9))
    cells = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), rows - 1), lambda r: F.transform(F.sequence(F.lit(0).cast("long"), cols - 1), lambda c: one(r, c))))
    lit = lambda n: F.lit(n)
    head = F.array(item(lit(0), F.concat(F.lit("about "), "role"), box(lit(0), lit(0))), item(lit(1), F.concat(F.lit("Table "), (F.col("turn") + 1).cast("string"), F.lit(" Ratings")), box(lit(0), lit(30))))
    tail = F.array(item(lit(90), F.expr(_LONG), box(lit(0), lit(260))), item(lit(91), F.lit("Table 9 without cells"), box(lit(0), lit(300))))
    pages = talk.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.explode(F.concat(head, cells, tail)).alias("x"))
    made = retrieval.recognised_chunks(pages.select("doc_id", "page_number", "x.*"), 5000, 0)
    return made.select("doc_id", "chunk_index", "page_number", "content_type", "chunk_text")


@query("""select conv_id, turn, case when turn % 3 = 1 then null else 'HIGH' end as confidence, case when turn % 3 = 1 then 'extraction_confidence is none of the three' end as error, case when turn % 3 = 2 then 1 else 2 end as asked from conversations""")
def facts_mended(spark, d):
    """Messages as prompts to a generator that mends some replies when told what is wrong."""
    mark = F.get(F.array(*map(F.lit, "abc")), F.pmod("turn", F.lit(3)).cast("int"))
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", mark, "text").alias("p"))
    found = answering.generate_checked(rows, "p", "facts", stand_ins.mending, lambda block: answering.facts_error(block, "DEFINITION"))
    return found.select("conv_id", "turn", F.get_json_object("facts", "$.extraction_confidence").alias("confidence"), F.col("facts_error").alias("error"), F.col("facts_asked").alias("asked"))


@query("""with n as (select conv_id, count(*) as n from conversations group by 1), s as (select *, sum(n) over (order by (conv_id * 7919 + 45) % 1009, conv_id rows unbounded preceding) as upto from n)
select conv_id, turn from conversations where conv_id in (select conv_id from s where upto - n < 200)""")
def pair_budget(spark, d):
    """Messages as the pairs of conversations, up to the conversation that brings them to 200."""
    return mining.within_budget(read(spark, d, "conversations"), "conv_id", 200).select("conv_id", "turn")
