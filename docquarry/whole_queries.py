"""Whole jobs as registered queries: search, answers, stored chunks, questions, streams and sources.

Models are stand-ins that follow from the text alone, so that each job's result has an SQL. What
the tables lack (captions, replies, parser items) is made from them, the same way in query and SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stand_ins
from .job_queries import _HITS, _folder
from .made_queries import _ASKED, _PARSED, MADE
from .operators import answering, mining, search, table_chunks
from .plans import retrieval
from .queries import _FOLD, SQL, STRIP, TOKENS, TOP, _bm25_ctes, _hits, _lines, query, read
from .session import session_with, ship
from .sources import readers, sinks
from .streaming import live


def _vector(text: str) -> str:
    return f"[length({text}) % 97 + 1.0::double, (length({text}) - length(replace({text}, ' ', ''))) % 89 + 1.0::double, 7.0::double]"


# --- search ---------------------------------------------------------------------------------------

_CHUNKS = """(select doc_id, text, case when doc_id % 3 = 0 then string_split(text, ' ')[1] || ' of ' || lang else '' end as section_header,
case when doc_id % 7 = 0 then 'Ratings of ' || string_split(text, ' ')[2] else '' end as table_caption, doc_id % 7 = 0 as has_table from documents where doc_id % 11 <> 0)"""


def _clause(field: str, boost: float) -> str:
    source = f"(select doc_id, {field} as text from {_CHUNKS})"
    return "(with " + _bm25_ctes(source).replace("from benchmark)", f"from {_ASKED})").replace("{boost}", str(boost)) + " select qid, doc, score from bm)"


_PHRASE = "(" + SQL["phrase_slop"].replace(TOP.format("sc", 50), "select qid, doc, score from sc").replace("from benchmark", f"from {_ASKED}").replace("from documents", f"from {_CHUNKS}") + ")"
_SHARE = f"round(len(list_intersect(list_distinct({TOKENS.format('b.text')}), {TOKENS.format('o.text')})) / greatest(len(list_distinct({TOKENS.format('b.text')})), 1), 6)"


@query(f"""with sh as (select qid, doc, sum(score) as score from (select * from {_clause('text', 2.0)} union all select * from {_PHRASE} union all select * from {_clause('section_header', 2.5)} union all select * from {_clause('table_caption', 2.0)}
 union all select q.item_id, doc_id, 3.0 from {_ASKED} q, {_CHUNKS} where regexp_matches(lower(q.text), 'table|levels|values|ratings|specifications') and has_table) group by all),
tb as ({TOP.format('sh', 50)}),
nn as (select q.item_id as qid, c.doc_id as doc, round(list_cosine_similarity({_vector('q.text')}, {_vector('c.text')}), 6) as score from {_ASKED} q, {_CHUNKS} c),
kn as (select qid, doc, row_number() over (partition by qid order by score desc, doc) as vector_rank from nn qualify vector_rank <= 30),
fu as (select coalesce(tb.qid, kn.qid) as qid, coalesce(tb.doc, kn.doc) as doc, tb.rank as bm25_rank, vector_rank, coalesce(1.0::double / (60 + tb.rank), 0) + coalesce(1.0::double / (60 + vector_rank), 0) as rrf, coalesce(tb.rank, 50 + vector_rank) as ord
 from tb full outer join kn on tb.qid = kn.qid and tb.doc = kn.doc),
pl as (select *, row_number() over (partition by qid order by ord) as place from fu),
sc as (select pl.*, case when place <= 30 then {_SHARE} end as rs from pl join {_ASKED} b on b.item_id = qid join documents o on o.doc_id = doc),
fi as (select *, case when rs is not null then 0.3 * rrf + 0.7 * rs else rrf end as fs from sc)
select qid, doc, coalesce(bm25_rank, 0)::int as bm25_rank, coalesce(vector_rank, 0)::int as vector_rank, round(fs, 6) as final_score, row_number() over (partition by qid order by round(fs, 9) desc, ord)::int as rank from fi qualify rank <= 10""")
def hybrid_search(spark, d):
    """All clauses: texts, phrases, headers, captions, tables; neighbours; fusion; rerank."""
    word = lambda n: F.get(F.split("text", " "), F.lit(n))
    docs = read(spark, d, "documents").where("doc_id % 11 <> 0")
    chunks = docs.select(
        F.col("doc_id").alias("chunk_key"),
        F.col("text").alias("chunk_text"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(word(0), F.lit(" of "), "lang")).otherwise("").alias("section_header"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Ratings of "), word(1))).otherwise("").alias("table_caption"),
        (F.col("doc_id") % 7 == 0).alias("has_table"),
    )
    chunks = retrieval.embed(chunks, "chunk_text", stand_ins.embedder)
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(" and its values"))).otherwise(F.col("text")).alias("question"))
    scorer = search.lexical_scorer(asked, chunks, "qid", "question", "chunk_key", "chunk_text")
    hits = retrieval.hybrid_search(asked, chunks, stand_ins.embedder, scorer)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return hits.select("qid", "doc", zero("bm25_rank"), zero("vector_rank"), F.round("final_score", 6).alias("final_score"), "rank")


# --- stored chunks, tables in plain text ------------------------------------------------------------


@query("with recursive e as (" + SQL["embedding_text"] + "), " + _FOLD.removeprefix("with recursive ") + " select nu.doc_id, nu.doc_id || '__c' || k as chunk_id, k::int as chunk_index, c as chunk_text, (length(embed_text) % 97 + 1)::double as first_dim from nu join e on e.doc_id = nu.doc_id and chunk_index = k")
def stored_chunks(spark, d):
    """The indexing job twice: first with other texts for every third document, whose chunks the second run replaces."""
    lines, path = _lines(spark, d).withColumn("block_type", F.lit("body")), _folder(spark, "chunks")
    old = lines.where("doc_id % 3 = 0").withColumn("text", F.concat(F.reverse("text"), F.lit(" and more text than before "), F.reverse("text")))
    retrieval.index_documents(spark, old, path, stand_ins.embedder)
    out = retrieval.index_documents(spark, lines, path, stand_ins.embedder)
    return out.select("doc_id", "chunk_id", "chunk_index", "chunk_text", F.get("embedding", F.lit(0)).cast("double").alias("first_dim"))


@query("select doc_id, 1::bigint as n_whole, 'markdown' as table_type from documents")
def tables_in_text(spark, d):
    """A table of one to five rows after each document's text lies whole in one chunk, whatever is before it."""
    table = F.concat(F.lit("| a | b |\n|---|---|\n"), F.repeat(F.concat(F.lit("| "), (F.col("doc_id") % 10).cast("string"), F.lit(" | 2 |\n")), (F.col("doc_id") % 5 + 1).cast("int")))
    docs = read(spark, d, "documents").select("doc_id", table.alias("t"), F.concat("text", F.lit("\n\n"), table, F.lit("\nThe end.")).alias("text"))
    chunks = table_chunks.chunk_texts(docs.select("doc_id", "text"))
    held = chunks.join(docs.select("doc_id", "t"), "doc_id").where(F.contains("chunk_text", F.rtrim("t", F.lit("\n"))))
    return held.groupBy("doc_id").agg(F.count("*").alias("n_whole"), F.max("table_type").alias("table_type"))


# --- answers ----------------------------------------------------------------------------------------

_NOTE = "Note: this answer may be incomplete."


@query(_HITS + f""", q as (select item_id as qid, '[[' || item_id % 6 || ']] ' || b.text as question, case when item_id % 6 = 5 or h.qid is null or length('[Source 1: ' || h.source || ' - Page 1]' || chr(10) || h.text) > {answering.CONTEXT_CHARS} then 5 else item_id % 6 end as c
from benchmark b left join h on h.qid = item_id and h.rank = 1)
select qid, question, case c when 0 then 'The term is known.' when 1 then 'Directly said.' when 2 then '{stand_ins.GOOD}' when 3 then 'However, I found nothing.' || chr(10) || chr(10) || '{_NOTE}'
 when 4 then 'Two parts are meant.' || chr(10) || chr(10) || '{stand_ins.MORE}' || chr(10) || chr(10) || '{_NOTE}' else 'No relevant information was found.' end as answer,
case c when 1 then 'FALLBACK' when 4 then 'ENUMERATION' when 5 then 'NONE' else 'DEFINITION' end as query_type, case c when 1 then 'MEDIUM' when 4 then 'LOW' when 5 then 'UNKNOWN' else 'HIGH' end as confidence,
c not in (3, 4) as is_valid, case c when 3 then '{answering.HEDGED}however, i found' when 4 then '{answering.UNSAID}zz1' end as validation_error from q""")
def answered_questions(spark, d):
    """Questions to answers over their hits; every sixth has none, the others meet one way through the job each."""
    mark = F.concat(F.lit("[["), (F.col("item_id") % 6).cast("string"), F.lit("]] "))
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat(mark, "text").alias("question"))
    hits = _hits(spark, d).where("qid % 6 <> 5").withColumn("has_table", F.lit(False))
    return retrieval.answer(asked, hits, stand_ins.replies)


# --- questions and training pairs -------------------------------------------------------------------


_WHAT = "'what is ' || replace(left(text, 30), chr(10), ' ') || ' about?'"


@query(f"""with q as (select doc_id as source, text, {_WHAT} as question from documents), s as (select *, round(list_cosine_similarity({_vector('question')}, {_vector('text')}), 6) as sim from q)
select source * 2 + 0 as qid, source, question, sim from s where sim >= {mining.VALID}""")
def asked_questions(spark, d):
    """A question for every document, kept where it is near enough."""
    chunks = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = retrieval.ask_questions(spark, retrieval.embed(chunks, "text", stand_ins.embedder, "v"), _folder(spark, "asked"), stand_ins.questioner, stand_ins.embedder)
    return found.select("qid", "source", "question", "sim")


def _pairs_of(spark, d) -> DataFrame:
    talk = read(spark, d, "conversations")
    return talk.select(F.concat_ws("_", "role", (F.col("conv_id") % 3).cast("string")).alias("pair_type"), F.col("text").alias("anchor"), F.concat_ws(" ", "role", "turn").alias("positive"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), (F.col("turn") / 10).alias("label"))


@query("select role || '_' || conv_id % 3 as pair_type, left(min_by(text, conv_id * 1000 + turn), 100) as anchor, left(min_by(role || ' ' || turn, conv_id * 1000 + turn), 100) as positive from conversations group by 1")
def first_pairs(spark, d):
    return mining.first_examples(_pairs_of(spark, d), "at")


@query("select (turn / 10.0)::double as label, count(*) as n from conversations group by 1")
def label_counts(spark, d):
    return mining.label_histogram(_pairs_of(spark, d)).withColumnRenamed("count", "n")


# --- conversations as streams -------------------------------------------------------------------------


@query("""with m as (select * from conversations where not (conv_id % 3 = 0 and turn <= 2 and conv_id in (select conv_id from conversations where turn = 2))), l as (select *, row_number() over (partition by conv_id order by turn desc) as r from m),
c as (select conv_id, least(count(*), 10)::int as n, max(turn)::bigint as last_turn, string_agg(upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || case when length(text) > 300 then left(text, 300) || '...' else text end, chr(10) order by turn) filter (r <= 3) as context from l group by 1),
e as (select conv_id, v, min(turn * 10 + k) as place from (select conv_id, turn, unnest(list_slice(string_split(text, ' '), 1, 2)) as v, unnest([1, 2]) as k from m) where v is not null group by all),
j as (select conv_id, string_agg(v, ' ' order by place) as entities from e group by 1)
select conv_id, coalesce(n, 0)::int as n, last_turn, coalesce(context, '') as context, coalesce(entities, '') as entities from (select distinct conv_id from conversations) left join c using (conv_id) left join j using (conv_id)""")
def conversation_stream(spark, d):
    """Messages in two starts of one stream; every third conversation is emptied at its third message."""
    talk = read(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.slice(F.split("text", " "), 1, 2).alias("entities"), ((F.col("conv_id") % 3 == 0) & (F.col("turn") == 2)).alias("clear"))
    base = _folder(spark, "talk")

    def keep(batch: DataFrame, _: int) -> None:
        sinks.upsert(batch.sparkSession, f"{base}/state", batch, "conv_id")

    with session_with(ship(spark)):
        for n, part in enumerate(("turn < 3", "turn >= 3")):
            talk.where(part).write.parquet(f"{base}/in/{n}")
            stream = spark.readStream.schema(talk.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
            live.conversation(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return sinks.current(spark, f"{base}/state").select("conv_id", "n", "last_turn", "context", F.array_join("entities", " ").alias("entities"))


@query("""with l as (select *, row_number() over (partition by user_id order by event_id desc) as r from events)
select user_id, least(count(*), 10)::int as n, max(event_id)::bigint as last_turn, string_agg(event_type, ',' order by event_id) filter (r <= 10) as texts from l group by 1""")
def history_stream(spark, d):
    """Events as messages of their users, in two starts of one stream; the last row of a user counts."""
    said = read(spark, d, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.lit("user").alias("role"), F.col("event_type").alias("text"))
    base = _folder(spark, "events")

    def keep(batch: DataFrame, _: int) -> None:
        sinks.upsert(batch.sparkSession, f"{base}/state", batch, "user_id")

    for n in range(2):
        said.where(F.col("event_id") % 2 == n).write.parquet(f"{base}/in/{n}")
        stream = spark.readStream.schema(said.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        held = live.bounded_history(stream, "user_id", "event_id")
        held.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return sinks.current(spark, f"{base}/state").select("user_id", "n", "last_turn", F.array_join("texts", ",").alias("texts"))


# --- sources ----------------------------------------------------------------------------------------


@query("""select doc_id, case when strlen(text) % 5 = 0 then 0 else len(string_split(text, chr(10))) end::bigint as n_lines, case when strlen(text) % 5 = 0 then 'ValueError: unreadable' end as error
from documents where strlen(text) % 5 <> 1""")
def converted_files(spark, d):
    """Documents as files: a fifth can't be converted and is named with its error, a fifth holds nothing."""
    docs = read(spark, d, "documents")
    files = docs.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").cast("string").alias("file_name"), F.col("text").cast("binary").alias("content"))
    items, failed = readers.convert(files, stand_ins.converter, "text string, place int")
    key = F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("doc_id")
    done = items.where("place = idx").groupBy(key).agg(F.count("text").alias("n_lines")).withColumn("error", F.lit(None).cast("string"))
    return done.unionByName(failed.select(key, F.lit(0).cast("long").alias("n_lines"), "error"))


@query(f"""with made as (select conv_id as doc_id, turn as i, ['text', 'heading', 'table'][(turn % 3 + 1)::int] as ty, case when turn % 4 = 3 then 1 else turn // 2 + 1 end as page, {STRIP.format("(" + MADE + ")")} as s, 'c' || conv_id as c from conversations)
select doc_id, i as block_idx, page::int as page_number, case when ty = 'table' then '| ' || c || ' | b |' || chr(10) || '|---|---|' || chr(10) || '|  | last |' else s end as text,
coalesce(case when ty = 'table' then 'table' end, case when length(s) between 3 and 80 then {_PARSED} end, case when ty = 'heading' then 'title' else 'body' end) as block_type from made""")
def parser_items(spark, d):
    """Messages as a parser's items; tables come as cells, one place filled twice, and some pages are unknown."""
    cell = lambda r, c, t: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), t.alias("text"))
    own = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    cells = F.array(cell(0, 0, own), cell(0, 1, F.lit("b")), cell(1, 1, F.lit("first")), cell(1, 1, F.lit("last")))
    kind = F.get(F.array(*map(F.lit, ("text", "heading", "table"))), F.pmod("turn", F.lit(3)).cast("int"))
    page = F.when(F.col("turn") % 4 != 3, F.floor(F.col("turn") / 2).cast("int"))
    items = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), kind.alias("item_type"), page.alias("page_no"), F.expr(MADE).alias("text"), F.when(kind == "table", cells).alias("cells"))
    return readers.parsed_blocks(items).select("doc_id", "block_idx", F.col("page_number").cast("int").alias("page_number"), "text", "block_type")


def _one_array_a_file(rows: DataFrame, bucket, record, path: str) -> None:
    """Records of bounded buckets as files that hold one JSON array each."""
    rows.groupBy(bucket.alias("b")).agg(F.to_json(F.collect_list(record)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)


@query("select conv_id, turn::int as turn, text from conversations where conv_id % 4 <> 3")
def manifest_chunks(spark, d):
    """Conversations as manifests with their messages as chunks; every fourth manifest has none."""
    path = _folder(spark, "manifests")
    talk = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("conv_id", "turn", "text")).alias("chunks"))
    record = F.struct("conv_id", F.when(F.col("conv_id") % 4 != 3, F.col("chunks")).alias("chunks"))
    _one_array_a_file(talk, F.floor(F.col("conv_id") / 64), record, path)
    return readers.chunk_manifest(spark, path, "conv_id bigint, chunks array<struct<conv_id: bigint, turn: int, text: string>>")


@query("select vec_id::int as step, vec_id / 8.0::double as epoch, round(vec_id % 7 / 7.0, 6)::double as loss from embeddings")
def loss_points(spark, d):
    path, at = _folder(spark, "losses"), F.col("vec_id")
    record = F.struct(at.alias("step"), (at / 8).alias("epoch"), F.round(at % 7 / 7, 6).alias("loss"))
    _one_array_a_file(read(spark, d, "embeddings"), F.floor(at / 1000), record, path)
    return readers.loss_history(spark, path)
