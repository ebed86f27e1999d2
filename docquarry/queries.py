"""Registered queries of the retrieval engine, each over its whole tables, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import answering, blocks, chunking, history, mining, search, tables
from .session import materialize, ship
from .sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# --- shared SQL ---------------------------------------------------------------------------------

TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''))"
DOT = "list_inner_product(a.embedding::double[], b.embedding::double[])"


def _bm25_ctes(docs: str = "documents") -> str:
    return f"""
post as (select doc_id as doc, unnest({TOKENS.format("text")}) as term from {docs}),
lens as (select doc_id as doc, len({TOKENS.format("text")}) as dl from {docs}),
idx as (select doc, term, count(*) as tf from post group by all),
st as (select count(*)::double as n, avg(dl) as avgdl from lens),
qt as (select distinct item_id as qid, unnest({TOKENS.format("text")}) as term from benchmark),
df as (select term, count(*) as df from idx group by term),
bm as (select qid, idx.doc, sum({{boost}} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
       from qt join idx using (term) join df using (term) join lens using (doc), st group by qid, idx.doc)"""


BM25 = _bm25_ctes()
TOP = "select qid, doc, round(score, 6) as score, row_number() over (partition by qid order by round(score, 6) desc, doc) as rank from {0} qualify rank <= {1}"


def _questions(spark, d) -> DataFrame:
    return read(spark, d, "benchmark")


def _bm25(spark, d, k: int, docs: DataFrame | None = None) -> DataFrame:
    docs = search.analysed(read(spark, d, "documents") if docs is None else docs)
    return search.bm25_best(docs, search.query_terms(_questions(spark, d), "item_id", "text"), k)


# --- text, filters ------------------------------------------------------------------------------


@query(f"select lang, count(*) as n_docs, sum(len({TOKENS.format('text')}))::bigint as n_tokens, round(avg(len({TOKENS.format('text')})), 6) as avg_tokens from documents group by lang")
def tokenize_stats(spark, d):
    n = F.size(tx.tokens("text"))
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.round(F.avg(n), 6).alias("avg_tokens"))


@query(f"""select doc_id, {WORDS.format("text")}::bigint as n_words from documents where {WORDS.format("text")} >= 30
and length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / greatest(length(text), 1) >= 0.5
and length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / greatest(length(text), 1) <= 0.2""")
def quality_filter(spark, d):
    docs = read(spark, d, "documents")
    return docs.where(mining.quality(docs)).select("doc_id", tx.word_count("text").alias("n_words"))


@query(f"select doc_id, regexp_replace(lower(source), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') || '__' || doc_id as chunk_key, left(text, 150) || '...' as preview from documents")
def source_preview(spark, d):
    return read(spark, d, "documents").select("doc_id", F.concat(tx.file_key("source"), F.lit("__"), F.col("doc_id").cast("string")).alias("chunk_key"), tx.preview("text").alias("preview"))


# --- BM25 ---------------------------------------------------------------------------------------


@query("with " + BM25.replace("{boost}", "1.0") + " " + TOP.format("bm", 10))
def bm25_topk(spark, d):
    return _bm25(spark, d, 10)


@query("with " + BM25.replace("{boost}", "2.0") + """,
tab as (select item_id as qid, doc_id as doc, 3.0 as score from benchmark, documents where regexp_matches(lower(benchmark.text), 'table|levels|values|ratings|specifications') and documents.text like '% | %'),
sh as (select qid, doc, sum(score) as score from (select * from bm union all select * from tab) group by all) """ + TOP.format("sh", 50))
def bm25_boosted_bool(spark, d):
    docs, ask = read(spark, d, "documents"), _questions(spark, d)
    asks = ask.where(search.wants_table(F.col("text"))).select(F.col("item_id").alias("qid"))
    tabled = docs.where(F.contains("text", F.lit(" | "))).select(F.col("doc_id").alias("doc"))
    terms = search.query_terms(ask, "item_id", "text")
    return search.bm25_best(search.analysed(docs), terms, search.BM25_SIZE, search.BOOST_TEXT, [search.tables_clause(asks, tabled)])


PHRASES = "(select item_id as qid, {0} as ts from benchmark)".format(TOKENS.format("text"))


@query(f"""with pos as (select doc_id as doc, unnest({TOKENS.format("text")}) as term, generate_subscripts({TOKENS.format("text")}, 1) - 1 as pos from documents),
lens as (select doc_id as doc, len({TOKENS.format("text")}) as dl from documents),
st as (select count(*)::double as n, avg(dl) as avgdl from lens),
ask as (select qid, unnest(ts) as term, generate_subscripts(ts, 1) - 1 as qpos from {PHRASES}),
sz as (select qid, count(*) as size from ask group by qid),
hit as (select qid, doc, qpos, pos - qpos as shift from pos join ask using (term)),
win as (select qid, doc, qpos, unnest(generate_series(shift - 2, shift)) as w from hit),
got as (select qid, doc, w, count(distinct qpos) as got from win group by all),
tf as (select qid, doc, ceil(count(*) / 3.0) as tf from got join sz using (qid) where got = size group by all),
df as (select term, count(distinct doc) as df from pos where term in (select term from ask) group by term),
rare as (select qid, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) as idf from ask join df using (term), st group by qid),
sc as (select qid, doc, 3.0 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as score from tf join rare using (qid) join lens using (doc), st) {TOP.format("sc", 50)}""")
def phrase_slop(spark, d):
    """Phrases are whole questions."""
    docs = search.tokenised(read(spark, d, "documents"))
    return search.top(search.phrase_scores(docs, search.collection(docs), _questions(spark, d), "item_id", "text").select("qid", "doc", "score"), search.BM25_SIZE)


@query("with fd as (select * from documents where lang = 'en' and source in ('src0', 'src1', 'src2')), " + _bm25_ctes("fd").replace("{boost}", "1.0") + " " + TOP.format("bm", 10))
def filtered_search(spark, d):
    docs = read(spark, d, "documents").withColumnsRenamed({"lang": "file_name", "source": "content_type"})
    return _bm25(spark, d, 10, search.filters(docs, {"file_name": "en", "content_type": ["src0", "src1", "src2"], "other": 1}))


# --- vectors ------------------------------------------------------------------------------------


def _vectors(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _knn_sql(k: int, where: str = "true") -> str:
    return f"""select a.vec_id as qid, b.vec_id as doc, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score,
row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) desc, b.vec_id) as rank
from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and {where} qualify rank <= {k}"""


@query(_knn_sql(30))
def knn_exact(spark, d):
    v = _vectors(spark, d)
    return search.nearest(v, v.where("id % 50 = 0"), 30)


@query(_knn_sql(30, "b.label in (1, 3, 5)"))
def knn_filtered(spark, d):
    v = _vectors(spark, d)
    return search.nearest(v.where("label in (1, 3, 5)"), v.where("id % 50 = 0"), 30)


DIMS = (64, 32, 16, 8)
_TRUNC = "list_cosine_similarity(list_slice(a.embedding::double[], 1, dim), list_slice(b.embedding::double[], 1, dim))"


@query(f"""select dim, a.vec_id as qid, b.vec_id as doc, round({_TRUNC}, 6) as score, row_number() over (partition by dim, a.vec_id order by round({_TRUNC}, 6) desc, b.vec_id) as rank
from (select unnest([64, 32, 16, 8])::int as dim), embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id qualify rank <= 10""")
def knn_truncated_dims(spark, d):
    v = _vectors(spark, d)
    return search.nearest_by_dims(v, v.where("id % 50 = 0"), 10, DIMS)


@query(f"select a.vec_id as id_a, b.vec_id as id_b, round({DOT}, 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def pair_similarity(spark, d):
    v = _vectors(spark, d)
    other = v.select((F.col("id") - 1).alias("id"), F.col("id").alias("id_b"), F.col("v").alias("w"))
    return v.join(other, "id").select(F.col("id").alias("id_a"), "id_b", F.round(search.dot(F.col("v"), F.col("w")), 6).alias("similarity"))


# --- fusion (vec_id is paired with doc_id and item_id: a synthetic pairing) ------------------------

_KNN_ITEMS = """kn as (select a.vec_id as qid, b.vec_id as doc, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score,
row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) desc, b.vec_id) as vector_rank
from embeddings a join benchmark on item_id = a.vec_id, embeddings b where a.vec_id <> b.vec_id and b.vec_id in (select doc_id from documents) qualify vector_rank <= 30)"""
_FUSED = "with " + BM25.replace("{boost}", "1.0") + ", tb as (" + TOP.format("bm", 50) + "), " + _KNN_ITEMS + """,
fu as (select coalesce(tb.qid, kn.qid) as qid, coalesce(tb.doc, kn.doc) as doc, tb.rank as bm25_rank, vector_rank, coalesce(1.0::double / (60 + tb.rank), 0) as rrf_bm25, coalesce(1.0::double / (60 + vector_rank), 0) as rrf_vector,
coalesce(1.0::double / (60 + tb.rank), 0) + coalesce(1.0::double / (60 + vector_rank), 0) as rrf_score, coalesce(tb.rank, 50 + vector_rank) as ord from tb full outer join kn on tb.qid = kn.qid and tb.doc = kn.doc)"""


def _fused(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    ask = v.join(_questions(spark, d).select(F.col("item_id").alias("id")), "id")
    held = v.join(read(spark, d, "documents").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    words = _bm25(spark, d, search.BM25_SIZE)
    return search.fuse(words, search.nearest(held, ask, search.KNN_SIZE))


@query(_FUSED + " select qid, doc, coalesce(bm25_rank, 0)::int as bm25_rank, coalesce(vector_rank, 0)::int as vector_rank, round(rrf_bm25, 9) as rrf_bm25, round(rrf_vector, 9) as rrf_vector, round(rrf_score, 9) as rrf_score from fu")
def rrf_fusion(spark, d):
    r = lambda c: F.round(c, 9).alias(c)
    rank = lambda c: F.coalesce(c, F.lit(0)).alias(c)  # noqa: E731  0: not in that list
    return _fused(spark, d).select("qid", "doc", rank("bm25_rank"), rank("vector_rank"), r("rrf_bm25"), r("rrf_vector"), r("rrf_score"))


@query(_FUSED + " select qid, doc, round(rrf_score, 9) as final_score, row_number() over (partition by qid order by round(rrf_score, 9) desc, ord)::int as rank from fu qualify rank <= 10")
def rrf_no_rerank(spark, d):
    return search.final(search.rerank(_fused(spark, d), None)).select("qid", "doc", F.round("final_score", 9).alias("final_score"), "rank")


@query(_FUSED + f""", pl as (select *, row_number() over (partition by qid order by ord) as place from fu),
sc as (select pl.*, case when place <= 30 then round(len(list_intersect(list_distinct({TOKENS.format('b.text')}), {TOKENS.format('o.text')})) / greatest(len(list_distinct({TOKENS.format('b.text')})), 1), 6) end as rs
from pl join benchmark b on b.item_id = qid join documents o on o.doc_id = doc),
fi as (select qid, doc, ord, coalesce(rs, 0) as rerank_score, case when rs is not null then 0.3 * rrf_score + 0.7 * rs else rrf_score end as fs from sc)
select qid, doc, rerank_score::double as rerank_score, round(fs, 9) as final_score, row_number() over (partition by qid order by round(fs, 9) desc, ord)::int as rank from fi qualify rank <= 10""")
def rrf_rerank_topk(spark, d):
    scorer = search.lexical_scorer(_questions(spark, d), read(spark, d, "documents"), "item_id", "text")
    return search.final(search.rerank(_fused(spark, d), scorer)).select("qid", "doc", "rerank_score", F.round("final_score", 9).alias("final_score"), "rank")


# --- chunks -------------------------------------------------------------------------------------

_FOLD = f"""with recursive ln as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
l as (select doc_id, {STRIP.format("t")} as t, row_number() over (partition by doc_id order by i) as i from ln where {STRIP.format("t")} <> ''),
r(doc_id, i, buf, out) as (select distinct doc_id, 0::bigint, null::varchar, null::varchar from l
 union all select r.doc_id, l.i, case when length(x.nb) < 1000 then x.nb when length(x.nb) > 200 then right(x.nb, 200) end, case when length(x.nb) >= 1000 then x.nb end
 from r join l on l.doc_id = r.doc_id and l.i = r.i + 1, lateral (select coalesce(r.buf || chr(10), '') || l.t as nb) x),
la as (select doc_id, max(i) as i from r group by doc_id),
ch as (select doc_id, i, {STRIP.format("out")} as c from r where out is not null
 union all select r.doc_id, r.i + 1, {STRIP.format("buf")} from r join la using (doc_id, i) where length({STRIP.format("buf")}) > 20),
nu as (select doc_id, c, row_number() over (partition by doc_id order by i) - 1 as k from ch)"""


@query(_FOLD + f" select doc_id, doc_id || '__c' || k as chunk_id, k::int as chunk_index, c as chunk_text, {WORDS.format('c')}::bigint as word_count from nu")
def chunk_fold(spark, d):
    return chunking.chunk_lines(read(spark, d, "documents")).select("doc_id", "chunk_id", "chunk_index", "chunk_text", "word_count")


@query(_FOLD + " select count(*) as n_chunks, count(distinct doc_id) as n_docs, max(length(c))::int as max_chars, round(avg(length(c)), 6) as avg_chars from nu")
def chunk_overlap_stats(spark, d):
    c = chunking.chunk_lines(read(spark, d, "documents"))
    return c.agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.max(F.length("chunk_text")).alias("max_chars"), F.round(F.avg(F.length("chunk_text")), 6).alias("avg_chars"))


@query(_FOLD + """ select doc_id, k::int as chunk_index, case when len(p) > 0 then '[Sections: ' || array_to_string(p, ', ') || '] ' else '' end || c as embed_text
from (select *, list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(c, '\\b(\\d+)\\.\\d+(?:\\.\\d+)*\\b', 1)), lambda s: {'n': length(regexp_replace(s, '^0+', '')), 'v': regexp_replace(s, '^0+', ''), 's': s})), lambda t: t.s) as p from nu)""")
def embedding_text(spark, d):
    c = chunking.chunk_lines(read(spark, d, "documents"))
    return c.select("doc_id", "chunk_index", chunking.embedding_text(c).alias("embed_text"))


@query(f"""with recursive ln as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
l as (select doc_id, {STRIP.format("t")} as t, row_number() over (partition by doc_id order by i) as i from ln where {STRIP.format("t")} <> ''),
r(doc_id, i, buf, out) as (select distinct doc_id, 0::bigint, []::varchar[], null::varchar[] from l
 union all select r.doc_id, l.i, case when x.over then list_concat(list_slice(r.buf, greatest(1, len(r.buf) - s.keep + 1), len(r.buf)), [l.t]) else list_concat(r.buf, [l.t]) end, case when x.over then r.buf end
 from r join l on l.doc_id = r.doc_id and l.i = r.i + 1,
 lateral (select coalesce(list_sum(list_transform(r.buf, lambda z: length(z))), 0) + length(l.t) > 1000 and len(r.buf) > 0 as over) x,
 lateral (select count(*) as keep from (select unnest(generate_series(1, len(r.buf))) as n) where coalesce(list_sum(list_transform(list_slice(r.buf, len(r.buf) - n + 1, len(r.buf)), lambda z: length(z))), 0) <= 200) s),
la as (select doc_id, max(i) as i from r group by doc_id),
ch as (select doc_id, i, out as c from r where out is not null union all select r.doc_id, r.i + 1, buf from r join la using (doc_id, i) where len(buf) > 0)
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as chunk_index, len(c)::bigint as n_paragraphs, array_to_string(c, chr(10) || chr(10)) as chunk_text from ch""")
def chunk_paragraph_pack(spark, d):
    """Lines stand in for paragraphs: the texts have no blank lines."""
    return chunking.chunk_paragraphs(read(spark, d, "documents"), separator=r"\n")


@query("""select doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(text, '\\b(\\d+)\\.\\d+(?:\\.\\d+)*\\b', 1)), lambda s: {'n': length(regexp_replace(s, '^0+', '')), 'v': regexp_replace(s, '^0+', ''), 's': s})), lambda t: t.s), ',') as parents from documents""")
def parent_sections(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(blocks.parent_sections(F.col("text")), ",").alias("parents"))


def _lines(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "text")).withColumn("page_number", F.lit(1))


_LINES = "with ln as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents), "
_HEAD = " or ".join(f"regexp_matches(s, '(?i){p}')" for p, _ in blocks.HEADERS)
_EXCL = " or ".join(f"regexp_matches(s, '(?i){p}')" for p in ([rf"^\d+\s*({u})([^\p{{L}}]|$)" for u in blocks.UNITS] + list(blocks.OTHER_EXCLUSIONS[1:])))
_FOOT = " or ".join(f"contains(lower(s), '{w}')" for w in blocks.FOOTER_WORDS)
_PAGE = f"(regexp_matches(lower(s), '^page\\s*\\d+') or regexp_matches(lower(s), '^\\d+\\s*(of|de)\\s*\\d+$') or regexp_matches(lower(s), '^\\d{{1,4}}$') or ({WORDS.format('s')} <= 10 and ({_FOOT})))"
def _kind(compat: bool) -> str:
    out = " or ".join(f"regexp_matches(s, '(?i){p}')" for p in blocks.exclusions(True)) if compat else _EXCL
    return _KIND.replace(_EXCL, out)


_KIND = f"""case when regexp_matches(s, '{blocks.CAPTION}') then 'table_header'
when length(s) between 3 and 80 and not regexp_matches(s, '^\\p{{Ll}}') and not ({_EXCL}) and ({_HEAD}) then case when regexp_matches(s, '^\\d{{1,2}}\\.\\d') then 'subsection_header' else 'section_header' end
when {WORDS.format('s')} <= 8 and length(s) > 3 and regexp_matches(s, '^\\p{{Lu}}') and not {_PAGE} then 'title' when {_PAGE} then 'page_element' else 'body' end"""


@query(_LINES + f"s as (select doc_id, {STRIP.format('t')} as s from ln) select doc_id, kind as block_type, count(*) as n from (select doc_id, {_KIND} as kind from s where s <> '') where kind <> 'page_element' group by all")
def section_classify(spark, d):
    return blocks.classify(_lines(spark, d)).groupBy("doc_id", "block_type").agg(F.count("*").alias("n"))


@query(_LINES + f"s as (select doc_id, i, {STRIP.format('t')} as s from ln) select doc_id, i::int as block_idx, s as line from s where {_PAGE}")
def page_elements(spark, d):
    return _lines(spark, d).where(blocks.is_page_element(tx.strip("text"))).select("doc_id", "block_idx", tx.strip("text").alias("line"))


@query("""with iv as (select user_id, floor(epoch(ts))::bigint as s, floor(epoch(ts))::bigint + round(value * 600)::bigint as e from events),
f as (select *, case when s <= max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from iv),
g as (select *, sum(n) over (partition by user_id order by s, e rows unbounded preceding) as k from f)
select user_id, min(s) as start_s, max(e) as end_s, count(*) as n_merged from g group by user_id, k""")
def interval_merge(spark, d):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    iv = read(spark, d, "events").select("user_id", seconds.alias("start_s"), (seconds + F.round(F.col("value") * 600).cast("bigint")).alias("end_s"))
    return chunking.merge_intervals(iv, "user_id", "start_s", "end_s")


@query("""select c_custkey, 2 as "rows", 2 as cols, '| key | nation |' || chr(10) || '|---|---|' || chr(10) || '| ' || c_custkey || ' | ' || c_nationkey || ' |' as shown from customer""")
def table_cells_grid(spark, d):
    """Customers as boxes on a grid, jittered within the tolerances, found as a table and shown again."""
    box = lambda x, y: F.array(*[F.lit(v).cast("int") for v in (x, y, x + 20, y + 10)])
    cell = lambda text, x, y: F.struct(text.cast("string").alias("text"), box(x, y).alias("bbox"))
    held = F.array(cell(F.col("c_nationkey"), 210, 64), cell(F.lit("key"), 0, 0), cell(F.col("c_custkey"), 6, 60), cell(F.lit("nation"), 200, 9))
    found = tables.grid(read(spark, d, "customer").select("c_custkey", held.alias("cells")))
    return found.select("c_custkey", "rows", "cols", tables.render_grid(F.col("table_data"), F.col("rows"), F.col("cols")).alias("shown"))


# --- answering ----------------------------------------------------------------------------------

_PART = "'[Source ' || rank || ': ' || source || ' - Page 1]' || chr(10) || text"
_CONTEXT = f""", h as (select t.qid, t.rank, source, text from ({TOP.format("bm", 10)}) t join documents on doc_id = doc),
p as (select qid, rank, {_PART} as part, sum(length({_PART})) over (partition by qid order by rank rows unbounded preceding) as run from h),
k as (select * from p where run <= 24000)"""


@query("with " + BM25.replace("{boost}", "1.0") + _CONTEXT + " select qid, count(*) as n_sources, sum(length(part))::bigint as n_chars, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context from k group by qid")
def context_pack(spark, d):
    return answering.pack_context(_hits(spark, d))


@query("with " + BM25.replace("{boost}", "1.0") + _CONTEXT + " select qid, rank::int as rank, length(part)::int as part_chars from k")
def context_pack_topk(spark, d):
    hits = _hits(spark, d)
    run = F.sum(F.length("part")).over(mining.Window.partitionBy("qid").orderBy("rank").rowsBetween(mining.Window.unboundedPreceding, 0))
    return hits.withColumn("part", answering.source_block(hits)).withColumn("run", run).where(F.col("run") <= answering.CONTEXT_CHARS).select("qid", "rank", F.length("part").alias("part_chars"))


def _hits(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("file_name"), F.col("text").alias("chunk_text"), F.lit(1).alias("page_number"))
    return _bm25(spark, d, 10).join(docs, "doc")


def _says(words) -> str:
    return " or ".join(f"contains(lower(text), '{w}')" for w in words)


_TYPE = f"case when {' or '.join(f'''regexp_matches(lower(text), '{p}')''' for p in answering.ENUMERATION_CUES)} then 'ENUMERATION' when {_says(answering.TABLE_CUES)} then 'TABLE_DATA' when {_says(answering.DEFINITION_CUES)} then 'DEFINITION' when {_says(answering.REQUIREMENT_CUES)} then 'REQUIREMENT' else 'GENERIC' end"


@query(f"select conv_id, turn, {_TYPE} as query_type from conversations")
def query_type_heuristic(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", answering.heuristic_type(F.col("text")).alias("query_type"))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def json_extract(spark, d):
    """Props wrapped as a model's fenced reply, then found and read again."""
    reply = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))
    return read(spark, d, "events").select("event_id", F.get_json_object(answering.json_block(reply), "$.k").cast("bigint").alias("k"))


_HEDGE = " ".join(f"when contains(lower(text), '{h.replace(chr(39), chr(39) * 2)}') then '{answering.HEDGED}{h.replace(chr(39), chr(39) * 2)}'" for h in answering.HEDGES)


@query(f"""select conv_id, turn, case when turn % 2 = 0 then case when not contains(lower(text), 'user') and not contains(lower(text), 'the ') then '{answering.UNSAID}user, the ' when regexp_extract(text, '\\b(\\d+)\\b', 1) not in ('', '2') then '{answering.MISCOUNT}' || regexp_extract(text, '\\b(\\d+)\\b', 1) || ', the facts 2' end
else case {_HEDGE} end end as error from conversations""")
def validate_answers(spark, d):
    facts = F.lit('{"items": [{"id": "user", "description": "a", "source": "b"}, {"id": "the ", "description": "c", "source": "d"}], "total_count": 2, "extraction_confidence": "HIGH"}')
    kind = F.when(F.col("turn") % 2 == 0, "ENUMERATION").otherwise("GENERIC")
    return read(spark, d, "conversations").select("conv_id", "turn", answering.validation_error(F.lit("How many are there?"), F.col("text"), facts, kind).alias("error"))


@query("select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3")
def history_last_n(spark, d):
    return history.last_messages(read(spark, d, "conversations"), 3).select("conv_id", "turn", "role", "text")


@query("""select conv_id, string_agg(upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || case when length(text) > 300 then left(text, 300) || '...' else text end, chr(10) order by turn) as context
from (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3) group by conv_id""")
def history_recent_context(spark, d):
    return history.recent_context(read(spark, d, "conversations"), 3)


@query(f"""with w as (select conv_id, turn, unnest({TOKENS.format("text")}) as word from conversations), f as (select conv_id, word, min(turn) as t from w group by all),
k as (select *, row_number() over (partition by conv_id order by t desc, word desc) as r from f qualify r <= 20)
select conv_id, word, row_number() over (partition by conv_id order by r desc)::int as place from k""")
def distinct_entities_tail(spark, d):
    words = read(spark, d, "conversations").select("conv_id", "turn", F.explode(tx.tokens("text")).alias("word"))
    return history.entities(words, "conv_id", "turn", "word")


# --- mining (labels stand in for documents; thresholds fit the vectors: 0.2 and 0.1 to 0.3) ---------

_NEAR = """with nb as (select a.vec_id as qid, b.vec_id as doc, a.label = b.label as same, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
near as (select *, row_number() over (partition by qid order by score desc, doc) as rank from nb qualify rank <= 15)"""
_HASHED = "((doc * 7919 + qid * 104729 + {0}) % 1009)"
_REL = "select qid, doc, score, round(0.5 + 0.3 * score, 2) as label from near where same and score > 0.2 qualify row_number() over (partition by qid order by rank) = 1"
_HARD = f"select qid, doc, score, 0.0::double as label from (select *, row_number() over (partition by qid order by rank) as f from near where not same and score between 0.1 and 0.3 qualify f <= 5) qualify row_number() over (partition by qid order by {_HASHED.format(42)}, doc) = 1"


def easy_sql(below: float, columns: str = "qid, doc, score, label") -> str:
    """Easy negatives under a threshold; queries without one get a vector by arithmetic on their id."""
    return f"""with eh as (select qid, doc, score, 0.0::double as label from near where rank > 5 and score < {below} qualify row_number() over (partition by qid order by {_HASHED.format(43)}, doc) = 1),
pl as (select vec_id, row_number() over (order by vec_id) - 1 as place, count(*) over () - 1 as others from embeddings),
al as (select vec_id as qid, place as own, (vec_id * 31 + 44) % others as x from pl where vec_id % 50 = 0 and others > 0 and vec_id not in (select qid from eh))
select {columns} from (select qid, doc, score, label from eh union all select qid, vec_id, 0.1::double, 0.0::double from al join pl on place = x + case when x >= own then 1 else 0 end)"""


_EASY = easy_sql(0.35)


def _near(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    near = search.nearest(v, v.where("id % 50 = 0"), mining.DEPTH)
    near = near.join(v.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid").join(v.select(F.col("id").alias("doc"), "label"), "doc")
    # Three kinds of pairs read it; the search runs once.
    return materialize(near.withColumn("same", F.col("ql") == F.col("label")).drop("ql", "label"), "near")


def _easy(spark, d, near: DataFrame, below: float = mining.HARD_LOW) -> DataFrame:
    """Easy negatives, of queries without one a random vector."""
    v = _vectors(spark, d)
    asked = v.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("id").alias("source"))
    return mining.easy_negatives(near, below, queries=asked, chunks=v.select(F.col("id").alias("doc")))


@query(_NEAR + " " + _REL)
def related_pairs(spark, d):
    return mining.related(_near(spark, d), 0.2).select("qid", "doc", "score", "label")


@query(_NEAR + " " + _HARD)
def hard_negatives(spark, d):
    return mining.hard_negatives(_near(spark, d), 0.1, 0.3).select("qid", "doc", "score", "label")


@query(_NEAR + " select * from (" + _EASY + ")")
def easy_negatives(spark, d):
    return _easy(spark, d, _near(spark, d)).select("qid", "doc", "score", "label")


@query(_NEAR + " select * from (" + easy_sql(0.2) + ")")
def easy_negatives_made_up(spark, d):
    """A threshold that most neighbours are over, so that queries without an easy negative are among them."""
    return _easy(spark, d, _near(spark, d), 0.2).select("qid", "doc", "score", "label")


@query(f"select a.vec_id as id_a, round(least(1.0, 0.8 + (round({DOT}, 6) - 0.65) * 0.5), 2) as positive_label, round(0.5 + 0.3 * round({DOT}, 6), 2) as related_label from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def pair_labels(spark, d):
    return pair_similarity(spark, d).select("id_a", mining.positive_label(F.col("similarity")).alias("positive_label"), mining.related_label(F.col("similarity")).alias("related_label"))


@query(_NEAR + f", p as (select 'related' as pair_type, score from ({_REL}) union all select 'hard_negative', score from ({_HARD}) union all select 'easy_negative', score from ({_EASY})) select pair_type, count(*) as n, round(avg(score), 6) as mean_similarity, round(100.0 * count(*) / sum(count(*)) over (), 4)::double as percent from p group by pair_type")
def pair_statistics(spark, d):
    near = _near(spark, d)
    parts = ((mining.related(near, 0.2), "related"), (mining.hard_negatives(near, 0.1, 0.3), "hard_negative"), (_easy(spark, d, near), "easy_negative"))
    rows = [p.select(F.lit(kind).alias("pair_type"), F.col("score").alias("semantic_similarity")) for p, kind in parts]
    return mining.statistics(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@query("select doc_id, case when (doc_id * 7919 + 13) % 10 < 1 then 'test' else 'train' end as split from documents")
def hash_split(spark, d):
    return mining.split(read(spark, d, "documents"), "doc_id").select("doc_id", "split")


# --- metrics ------------------------------------------------------------------------------------

_EVAL = f"""with hit as (select dim, a.vec_id as qid, b.vec_id as doc, a.label = b.label as rel, row_number() over (partition by dim, a.vec_id order by round({_TRUNC}, 6) desc, b.vec_id) as rank
from (select unnest([64, 32, 16, 8])::int as dim), embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id qualify rank <= 10),
want as (select a.vec_id as qid, count(*) as rel from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 50 = 0 group by 1),
per as (select dim, w.qid, coalesce(sum(case when h.rel then 1 / log2(rank + 1.0) end), 0) / (select sum(1 / log2(r + 1.0)) from range(1, least(w.rel, 10) + 1) t(r)) as ndcg, coalesce(1.0 / min(case when h.rel then rank end), 0) as mrr, w.rel as want_rel, count(case when h.rel then 1 end) as n
from want w join hit h on h.qid = w.qid group by dim, w.qid, w.rel)"""


#: The same with every vector as a query.
_EVAL_ALL = _EVAL.replace("a.vec_id % 50 = 0 and ", "").replace("where a.vec_id % 50 = 0 ", "")


def _evaluated(spark, d, every: bool = False) -> DataFrame:
    """every: each vector is a query, else those of the searches' query set."""
    v = _vectors(spark, d)
    ask = v if every else v.where("id % 50 = 0")
    hits = (search.nearest_to_all(v, 10, DIMS) if every else search.nearest_by_dims(v, ask, 10, DIMS)).join(ask.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid")
    hits = hits.join(v.select(F.col("id").alias("doc"), "label"), "doc").where("ql = label")
    # The number of relevant rows comes from counts, not from pairs.
    sizes = v.groupBy("label").agg((F.count("*") - 1).alias("rel"))
    wanted = ask.join(sizes, "label").where("rel > 0").select(F.col("id").alias("qid"), "rel").crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in DIMS], "dim int")))  # four rows
    return mining.mean_scores(mining.scores(hits, wanted, 10, ("dim", "qid")), "dim")


@query(_EVAL_ALL + " select dim, round(avg(ndcg), 6) as ndcg_at_10 from per group by dim")
def ndcg_at_10_by_dim(spark, d):
    return _evaluated(spark, d, every=True).select("dim", F.col("ndcg").alias("ndcg_at_10"))


@query(_EVAL + " select dim, round(avg(mrr), 6) as mrr_at_10, round(avg(n / 10.0), 6) as precision_at_10, round(avg(n / want_rel), 6) as recall_at_10 from per group by dim")
def mrr(spark, d):
    return _evaluated(spark, d).select("dim", *[F.col(c).alias(f"{c}_at_10") for c in ("mrr", "precision", "recall")])


@query(_EVAL + """, nth as (select dim, qid, rank, row_number() over (partition by dim, qid order by rank) as k from hit where rel),
ap as (select dim, qid, sum(k / rank) as s from nth group by all)
select p.dim, round(avg(coalesce(s, 0) / least(want_rel, 10)), 6) as map_at_10, round(avg(case when n > 0 then 1.0 else 0.0 end), 6)::double as accuracy_at_10 from per p left join ap using (dim, qid) group by p.dim""")
def map_accuracy(spark, d):
    return _evaluated(spark, d).select("dim", *[F.col(c).alias(f"{c}_at_10") for c in ("map", "accuracy")])


@query("""with e as (select event_type, event_id, value, count(*) over (partition by event_type) as n, row_number() over (partition by event_type order by event_id) as a from events),
s as (select *, greatest(5, n // 20) as w, sum(value::decimal(30, 8)) over (partition by event_type order by a rows unbounded preceding) as t from e where n > 20)
select x.event_type, x.event_id, x.w::bigint as "window", round((x.t - coalesce(y.t, 0))::double / x.w, 6) as mean from s x left join s y on y.event_type = x.event_type and y.a = x.a - x.w where x.a >= x.w""")
def moving_average(spark, d):
    return mining.moving_average(read(spark, d, "events"), "event_type", "event_id", "value")


@query("""with e as (select event_type, event_id, value, count(*) over (partition by event_type) as n, row_number() over (partition by event_type order by event_id) as a from events),
g as (select event_type, n, min_by(value, a) as first_value, max_by(value, a) as last_value, min(value) as min_value, round(avg(value) filter (a > n - n // 4) - avg(value) filter (a > n - 2 * (n // 4) and a <= n - n // 4), 6) as change from e group by event_type, n)
select *, round(case when first_value > 0 then 100 * (first_value - last_value) / first_value else 0 end, 4) as reduction_percent, case when n < 20 then null when change < -0.005 then 'decreasing' when change > 0.005 then 'increasing' else 'plateaued' end as trend from g""")
def loss_trend(spark, d):
    return mining.trend(read(spark, d, "events"), "event_type", "event_id", "value")


@query("""with s as (select event_type, user_id, min_by(value, event_id) as first_score, max_by(value, event_id) as last_score from events group by all)
select *, case when last_score - first_score > 0.001 then 'improved' when abs(last_score - first_score) < 0.001 then 'unchanged' else 'decreased' end as verdict from s""")
def score_change(spark, d):
    return mining.score_change(read(spark, d, "events").withColumn("k", F.struct("event_type", "user_id")), "k", "event_id", "value").select("k.event_type", "k.user_id", "first_score", "last_score", "verdict")


# --- sinks, pages, training rows ------------------------------------------------------------------


@query("""with n as (select doc_id, upper(lang) as lang, 'new' as origin from documents where lang <> 'en' union all select doc_id + 10000000, lang, 'new' from documents where lang = 'en')
select doc_id, lang, 'old' as origin from documents where doc_id not in (select doc_id from n) union all select * from n""")
def upsert_latest(spark, d):
    docs = read(spark, d, "documents")
    old = docs.select("doc_id", "lang", F.lit("old").alias("origin"))
    new = docs.where("lang <> 'en'").select("doc_id", F.upper("lang").alias("lang"), F.lit("new").alias("origin"))
    more = docs.where("lang = 'en'").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "lang", F.lit("new").alias("origin"))
    rows = new.unionByName(more)
    return sinks.merged(old, sinks.latest(rows, "doc_id", "lang"), "doc_id")


_ENTITIES = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_H1 = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)<head\\b.*?</head\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
_H2 = f"regexp_replace(regexp_replace({_H1}, '(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/title)\\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query(f"select page_id, {STRIP.format('regexp_replace(regexp_replace(' + _ENTITIES.format(_H2) + ', ' + chr(39) + '[ ' + chr(92) + 't' + chr(92) + 'x0B' + chr(92) + 'f' + chr(92) + 'r]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + ' ?' + chr(92) + 'n[ ' + chr(92) + 'n]*' + chr(39) + ', chr(10), ' + chr(39) + 'g' + chr(39) + ')')} as body from pages")
def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", readers.html_text(F.col("html")).alias("body"))


@query("select doc_id, text as anchor, lang as positive, 1.0::float as label from documents where text <> '' and lang <> ''")
def training_examples(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.col("text").alias("anchor"), F.col("lang").alias("positive"), F.lit(None).cast("double").alias("label"))
    return mining.examples(rows)


@query("select doc_id, row_number() over (order by doc_id) - 1 as id from documents")
def sequential_ids(spark, d):
    return mining.sequential_ids(read(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "id")


from . import job_queries, made_queries, whole_queries  # noqa: E402, F401  register their queries
