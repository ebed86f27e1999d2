"""Whole jobs: documents to index, questions to answers, chunks to training pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import answering, blocks, chunking, mining, search, tables
from ..session import discard, materialize, path_exists, wider
from ..sources import sinks

Embedder = Callable[[list[str]], np.ndarray]


def hash_embedder(dims: int = 64) -> Callable[[], Embedder]:
    """A stand-in embedder: signed feature hashing of words, L2-normalised. It knows no meaning."""

    def make() -> Embedder:
        import zlib

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims), np.float32)
            for i, text in enumerate(texts):
                for word in (text or "").lower().split():
                    h = zlib.crc32(word.encode())
                    out[i, h % dims] += 1.0 if h >> 16 & 1 else -1.0
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

        return embed

    return make


def embed(rows: DataFrame, text_col: str, make: Callable[[], Embedder], out_col: str = "embedding", batch: int = 32) -> DataFrame:
    """Add a vector column by batches of texts; the model is built once per task."""

    def run(batches):
        model = make()
        for part in batches:
            texts = part.column(text_col).to_pylist()
            vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*part.schema.names, out_col])

    return rows.mapInArrow(run, wider(rows.schema, **{out_col: "array<float>"}))


def with_tables(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """Captions that have a table become table blocks: caption, then the cells as text.

    parsed: doc_id, page_number, block_idx, text, block_type; found: doc_id, page_number, nth,
    table_data. The i-th caption of a page takes that page's i-th table; each caption gives a block
    of its own, whatever follows it.
    """
    held = blocks.nth_table(parsed, found.select("doc_id", "page_number", "nth", "table_data")).select("doc_id", "page_number", "block_idx", "table_data")
    out = parsed.join(held, ["doc_id", "page_number", "block_idx"], "left")
    has = F.col("table_data").isNotNull()
    out = out.withColumn("text", F.when(has, tables.table_text(F.col("text"), F.col("table_data"))).otherwise(F.col("text")))
    return out.withColumn("block_type", F.when(F.col("block_type") == "table_header", "table").otherwise(F.col("block_type"))).drop("table_data")


def page_tables(items: DataFrame) -> DataFrame:
    """Recognised items to blocks, with the tables of each page put together.

    items: doc_id, page_number, block_idx, text, bbox. A page's items in order are cut at captions; the
    items after a caption that belong to its region become a grid, and the caption a table block with
    the grid as text; the others stay. Returns doc_id, page_number, block_idx, text, block_type (table, or null
    for items to classify), rows and cols. One page's items meet in one row.
    """
    order = Window.partitionBy("doc_id", "page_number").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    cut = items.withColumn("__nth", F.sum(blocks.is_caption(F.col("text")).cast("int")).over(order))
    cell = F.struct("block_idx", "text", "bbox")
    parts = cut.groupBy("doc_id", "page_number", "__nth").agg(F.sort_array(F.collect_list(cell)).alias("__items"))
    first = F.get("__items", F.lit(0))
    rest = F.slice("__items", 2, F.greatest(F.size("__items"), F.lit(1)))
    cells = F.when(F.col("__nth") > 0, tables.region(rest, F.coalesce(F.get(first["bbox"], F.lit(1)), F.lit(0)))).otherwise(F.slice(rest, 1, 0))
    found = tables.grid(parts.select("*", F.explode(F.array(cells)).alias("cells")))
    used = F.transform("cells", lambda c: c["block_idx"])
    text = F.when(F.size("cells") > 0, tables.table_text(first["text"], F.col("table_data"))).otherwise(first["text"])
    block = lambda i, text, kind, rows, cols: F.struct(i.alias("block_idx"), text.alias("text"), kind.alias("block_type"), rows.alias("rows"), cols.alias("cols"))
    none = F.lit(None).cast("int")
    table = F.array(block(first["block_idx"], text, F.lit("table"), F.col("rows"), F.col("cols")))
    plain = lambda xs: F.transform(xs, lambda c: block(c["block_idx"], c["text"], F.lit(None).cast("string"), none, none))
    others = plain(F.filter("__items", lambda c: ~F.array_contains(used, c["block_idx"])))
    behind = F.filter(others, lambda c: c["block_idx"] != first["block_idx"])
    out = F.when(F.col("__nth") > 0, F.concat(table, behind)).otherwise(others)
    return found.select("doc_id", "page_number", F.explode(out).alias("x")).select("doc_id", "page_number", "x.*")


def recognised_chunks(items: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Recognised items (see page_tables) to chunks: tables put together, the rest classified, then page by page."""
    found = page_tables(items)
    other = blocks.classify(found.where("block_type is null").drop("block_type", "rows", "cols"))
    whole = found.where("block_type is not null").select("doc_id", "page_number", "block_idx", "text", "block_type", F.lit(None).cast("string").alias("section_number"), F.lit(0).alias("level"))
    return chunking.chunk_pages(other.select(whole.columns).unionByName(whole), size, overlap)


def index_documents(spark: SparkSession, parsed: DataFrame, path: str, make: Callable[[], Embedder], size: int = 1000, overlap: int = 200, by_page: bool = False) -> DataFrame:
    """Blocks to a stored, embedded chunk dataset; returns what was written.

    parsed: doc_id, page_number, block_idx, text, block_type and, optionally, confidence. Chunks of
    a document that was stored before are replaced, or go where it has none now.
    """
    chunker = chunking.chunk_pages if by_page else chunking.chunk_documents
    chunks = chunker(parsed, size, overlap)
    ready = embed(chunks.withColumn("embed_text", chunking.embedding_text(chunks)), "embed_text", make).drop("embed_text")
    ready = materialize(ready, "embedded")  # the upsert reads it more than once, the model runs once
    sinks.upsert(spark, path, ready, "chunk_id", prune_by="doc_id", drop=parsed.select("doc_id").distinct())
    discard(ready)
    return sinks.current(spark, path)


def hybrid_search(questions: DataFrame, chunks: DataFrame, make: Callable[[], Embedder], scorer=None, wanted: dict | None = None, k: int = search.FINAL_SIZE, id_col: str = "chunk_key") -> DataFrame:
    """Questions (qid, question) to their k best chunks, with all ranks and scores.

    chunks: id_col (long), chunk_text, embedding and, optionally, has_table and filter columns. BM25
    and phrase clauses add up; table questions favour tables; neighbours see filtered chunks only.
    """
    held = search.filters(chunks, wanted)
    read = search.tokenised(held, id_col, "chunk_text")
    stats, terms = search.collection(read), search.query_terms(questions, "qid", "question")
    clauses = [(search.counted(read, terms), stats, search.BOOST_TEXT)]
    for field, boost in (("section_header", search.BOOST_HEADER), ("table_caption", search.BOOST_CAPTION)):
        if field in held.columns:
            named = search.tokenised(held, id_col, field)
            clauses.append((search.counted(named, terms), search.collection(named), boost))
    more = [search.phrase_clause(materialize(search.phrase_scores(read, stats, questions, "qid", "question"), "phrases"))]
    if "has_table" in held.columns:
        asks = questions.where(search.wants_table(F.col("question"))).select("qid")
        more.append(search.tables_clause(asks, held.where("has_table").select(F.col(id_col).alias("doc"))))
    words = search.best(clauses, terms, search.BM25_SIZE, more)
    asked = embed(questions, "question", make).select(F.col("qid").alias("id"), F.col("embedding").alias("v"))
    near = search.nearest(held.select(F.col(id_col).alias("id"), F.col("embedding").alias("v")), asked, search.KNN_SIZE, same=True)
    return search.final(search.rerank(search.fuse(words, near), scorer), k)


def answer(questions: DataFrame, hits: DataFrame, make: Callable[[], answering.Generator], attempts: int = 2, structured: bool = True, talk: DataFrame | None = None) -> DataFrame:
    """Answer each question from its hits (rank, chunk_text, file_name, page_number, has_table, ...).

    Questions without hits get a fixed answer. Facts that break their type's schema are asked for again with
    the fault, `attempts` times in all. A failed extraction falls back to a direct answer, a
    failed answer to the facts as text; a failed validation adds a warning, never blocks. talk (qid, talk)
    is what was said before, as history.recent_context() gives it; it goes before the question.
    """
    if talk is not None:
        before = talk.select("qid", F.col("talk").alias("__talk"))
        told = F.concat(F.lit("Before:\n"), F.col("__talk"), F.lit("\nNow: "), F.col("question"))
        questions = questions.join(before, "qid", "left").withColumn("__told", F.when(F.col("__talk").isNotNull(), told).otherwise(F.col("question"))).drop("__talk")
    else:
        questions = questions.withColumn("__told", F.col("question"))
    context = answering.pack_context(hits)
    hint = answering.table_hint(hits) if "table_header" in hits.columns else hits.select("qid").distinct().select("qid", F.lit(False).alias("has_tables"))
    # One row a question: contexts are packed once, whatever the number of steps that read them.
    rows = materialize(questions.join(context, "qid", "left").join(hint, "qid", "left"), "asked")
    found, none = rows.where("context is not null"), rows.where("context is null")
    said = F.when(F.coalesce("has_tables", F.lit(False)), "Some sources are tables; keep their rows and columns.").otherwise("")
    kinds = found.withColumn("__p", answering.prompt("type", question=F.col("question")))
    kinds = answering.generate(kinds, "__p", "__type", make).withColumn("query_type", answering.replied_type(F.col("__type"), F.col("question")))
    if structured:
        facts = kinds.withColumn("__p", answering.prompt("facts", question=F.col("__told"), query_type=F.col("query_type"), table_hint=said, context=F.col("context")))
        facts = answering.generate_checked(facts, "__p", "facts", make, lambda block: answering.facts_fault(block, F.col("query_type")), attempts)
    else:
        facts = kinds.withColumn("facts", F.lit(None).cast("string"))
    first = F.when(F.col("facts").isNull(), answering.prompt("direct", question=F.col("__told"), context=F.col("context"))).otherwise(answering.prompt("answer", question=F.col("__told"), facts=F.col("facts")))
    done = answering.generate(facts.withColumn("__p", first), "__p", "__answer", make)
    done = done.withColumn("answer", F.coalesce("__answer", F.when(F.col("facts").isNotNull(), answering.facts_as_text(F.col("facts"), F.col("query_type")))))
    more = F.when(answering.complement_wanted(F.col("query_type")) & F.col("facts").isNotNull(), answering.prompt("complement", question=F.col("question"), answer=F.col("answer"), context=F.col("context")))
    done = answering.generate(done.withColumn("__p", more), "__p", "__more", make)
    extra = answering.complement(F.col("__more"))
    done = done.withColumn("answer", F.concat_ws("\n\n", "answer", extra))
    flaw = F.when(F.col("facts").isNotNull(), answering.validation_error(F.col("question"), F.col("answer"), F.col("facts"), F.col("query_type")))
    mode = F.when(F.col("facts").isNotNull(), F.col("query_type")).otherwise("FALLBACK" if structured else "DIRECT")
    done = done.withColumn("validation_error", flaw).withColumn("answer", F.when(flaw.isNotNull(), F.concat("answer", F.lit("\n\nNote: this answer may be incomplete."))).otherwise(F.col("answer")))
    done = done.select("qid", "question", "answer", mode.alias("query_type"), F.when(F.col("facts").isNotNull(), answering.answer_confidence(F.col("facts"))).otherwise("MEDIUM" if structured else "UNKNOWN").alias("confidence"), F.col("validation_error").isNull().alias("is_valid"), "validation_error")
    empty = none.select("qid", "question", F.lit("No relevant information was found.").alias("answer"), F.lit("NONE").alias("query_type"), F.lit("UNKNOWN").alias("confidence"), F.lit(True).alias("is_valid"), F.lit(None).cast("string").alias("validation_error"))
    return done.unionByName(empty)


def ask_questions(spark: SparkSession, chunks: DataFrame, path: str, make: Callable[[], answering.Generator], make_embedder: Callable[[], Embedder], n: int = 2, parts: int = 8, valid: float = mining.VALID) -> DataFrame:
    """Questions that a generator writes for chunks (id, text, v): qid, source, question, sim, v.

    Replies are kept under `path`, part by part, so a run that was cut off asks only for chunks without a
    reply, and failed calls are made again by the next run. Unusable lines go; sim is the inner product of
    the unit vectors of question and chunk, and questions under `valid` go too.
    """
    held = chunks.select(F.col("id").cast("long").alias("id"), "text")
    for part in range(parts):
        own = held.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        if path_exists(spark, path):
            own = own.join(spark.read.parquet(path).select("id"), "id", "left_anti")
        said = answering.generate(own.withColumn("__p", answering.prompt("questions", n=F.lit(n), passage=F.col("text"))), "__p", "reply", make)
        replies = materialize(said.select("id", "reply"), "replies")
        replies.where("reply is not null").write.mode("append").parquet(path)
        discard(replies)
    lines = spark.read.parquet(path).dropDuplicates(["id"]).select("id", F.posexplode(mining.questions_of(F.col("reply"), n)).alias("nth", "question"))
    asked = embed(lines, "question", make_embedder, "v").withColumn("qid", F.col("id") * n + F.col("nth"))
    unit = lambda v: search.dot(v, v) ** 0.5
    met = asked.join(chunks.select(F.col("id").cast("long").alias("id"), F.col("v").alias("__v")), "id")
    sim = F.round(search.dot(F.col("v"), F.col("__v")) / F.greatest(unit(F.col("v")) * unit(F.col("__v")), F.lit(1e-300)), 6)
    return met.withColumn("sim", sim).where(F.col("sim") >= valid).select("qid", F.col("id").alias("source"), "question", "sim", "v")


def mine_pairs(chunks: DataFrame, questions: DataFrame, depth: int = mining.DEPTH, most: int | None = None) -> DataFrame:
    """Training pairs from chunks (id, doc, v) and questions (qid, source, sim, v): all four types.

    With `most`, the pairs of chunks in a hashed order up to the chunk that brings them to that number.
    """
    if not mining.enough(chunks):
        raise ValueError(f"fewer than {mining.MIN_CHUNKS} chunks")
    good = questions.where(F.col("sim") >= mining.VALID)
    near = search.nearest(chunks.select("id", "v"), good.select(F.col("qid").alias("id"), "v"), depth + 1, same=True)
    near = near.join(good.select("qid", "source"), "qid").where("doc <> source")
    place = F.row_number().over(mining.Window.partitionBy("qid").orderBy("rank"))
    near = near.withColumn("rank", place).where(F.col("rank") <= depth)
    home = chunks.select(F.col("id").alias("doc"), F.col("doc").alias("file"))
    src = chunks.select(F.col("id").alias("source"), F.col("doc").alias("src_file"))
    near = near.join(home, "doc").join(src, "source").withColumn("same", F.col("file") == F.col("src_file"))
    positives = good.select("qid", F.col("source").alias("doc"), F.col("sim").alias("score"))
    every = mining.pairs(near, positives, good.select("qid", "source"), chunks.select(F.col("id").alias("doc")))
    if most is None:
        return every
    return mining.within_budget(every.join(good.select("qid", "source"), "qid"), "source", most).drop("source")
