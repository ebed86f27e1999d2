"""BM25 search, exact neighbours, rank fusion, rerank and final ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import materialize
from . import shelves
from .shelves import B, K1

#: Budgets of the stages, the constant of rank fusion, rerank weights, clause boosts.
BM25_SIZE, KNN_SIZE, RERANK_SIZE, FINAL_SIZE, RRF_CONSTANT = 50, 30, 30, 10, 60
RRF_WEIGHT, RERANK_WEIGHT = 0.3, 0.7
BOOST_TEXT, BOOST_PHRASE, BOOST_HEADER, BOOST_CAPTION, BOOST_TABLE = 2.0, 3.0, 2.5, 2.0, 3.0
TABLE_CUES = ("table", "levels", "values", "ratings", "specifications")
SLOP = 2
#: Vectors of a shard of the exact search, and queries that pass it together.
SHARD_ROWS, QUERY_ROWS = 16_384, 64
#: Where every vector is a query: queries of a group; how many groups and rows small tables have; queries and vectors that meet at once.
GROUP_ROWS, LEAST_GROUPS, LEAST_ROWS, TILE, CHUNK = 16_384, 12, 2048, 256, 2048
#: More than single precision is off by for a product of unit vectors, for each of their components.
ROUNDING = 1.2e-7
#: Neighbouring ids of documents that BM25 deals to one shard.
BLOCK_IDS = 256


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: bool = False, stem: bool = False) -> DataFrame:
    """(doc, ts, dl) in the shared folder: one pass over the texts, from which a search takes all it needs."""
    return materialize(analysed(docs, id_col, text_col, fold, stem), "tokens")


def analysed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: bool = False, stem: bool = False) -> DataFrame:
    """tokenised() without the table: for few readers, as tokens take more room than the texts."""
    return docs.select(F.col(id_col).alias("doc"), tokens(text_col, fold, stem).alias("ts")).withColumn("dl", F.size("ts").cast("long"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: bool = False, stem: bool = False) -> DataFrame:
    """The inverted index: term, doc, tf, dl, with partial counts before its one shuffle. docs may be tokenised()."""
    rows = docs if "ts" in docs.columns else analysed(docs, id_col, text_col, fold, stem)
    each = rows.select("doc", "dl", F.explode("ts").alias("term"))
    return each.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def collection(docs: DataFrame, text_col: str = "text", fold: bool = False, stem: bool = False) -> DataFrame:
    """One row: n documents and their mean length in tokens. docs may be tokenised()."""
    rows = docs if "ts" in docs.columns else docs.select(F.size(tokens(text_col, fold, stem)).cast("long").alias("dl"))
    return rows.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(questions: DataFrame, id_col: str, text_col: str, fold: bool = False, stem: bool = False) -> DataFrame:
    return questions.select(F.col(id_col).alias("qid"), F.explode(F.array_distinct(tokens(text_col, fold, stem))).alias("term"))


def bm25_scores(index: DataFrame, stats: DataFrame, terms: DataFrame, boost: float = 1.0) -> DataFrame:
    """(qid, doc, score): the sum over the query's distinct terms. The index is pruned to query terms."""
    hits = index.join(terms.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    known = terms.join(df, "term").crossJoin(F.broadcast(stats)).select("qid", "term", "avgdl", idf().alias("idf"))  # stats: one row
    scored = hits.join(known, "term").select("qid", "doc", (boost * F.col("idf") * weight).alias("s"))
    return scored.groupBy("qid", "doc").agg(F.sum("s").alias("score"))


def asked_places(questions: DataFrame, id_col: str, text_col: str, fold: bool = False, stem: bool = False) -> DataFrame:
    """(qid, qpos, term): every token of the questions at its place."""
    return questions.select(F.col(id_col).alias("qid"), F.posexplode(tokens(text_col, fold, stem)).alias("qpos", "term"))


def counted(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, term, tf, dl) of tokenised() documents for the questions' terms: one row a token."""
    each = docs.select("doc", "dl", F.explode("ts").alias("term"))
    return each.join(terms.select("term").distinct(), "term", "left_semi").select("doc", "term", F.lit(1).alias("tf"), "dl")


def numbered(terms: DataFrame, parts: int = 16) -> DataFrame:
    """(term, number): each term of the questions once, with a small number of its own from 1."""
    each = terms.select("term").distinct().repartition(parts, "term").sortWithinPartitions("term").withColumn("m", F.monotonically_increasing_id())
    number = F.col("m").bitwiseAND((1 << 33) - 1) * parts + F.shiftright("m", 33) + 1  # place in its part, part
    return materialize(each.select("term", number.alias("number")), "terms")


def best(clauses: list[tuple[DataFrame, DataFrame, float]], terms: DataFrame, k: int, more: list[tuple[DataFrame, DataFrame]] = ()) -> DataFrame:
    """(qid, doc, score, rank): the k best documents of each question by the sum of BM25 clauses.

    clauses: rows of counted(), the collection()'s row and a boost each; more: entries and asks of shelves
    (tables_clause(), phrase_clause()) whose weights are given. Questions pass shards of documents, and only
    the best of each shard are shuffled, never all scored pairs.
    """
    stats = [st.first() for _, st, _ in clauses]  # a row each, for which texts are read once
    n = shelves.shards_of(sum((r.n * (r.avgdl or 0.0) for r in stats), 0.0))
    clauses = [(e, e.sparkSession.range(1).select(F.lit(r.n).alias("n"), F.lit(r.avgdl).cast("double").alias("avgdl")), boost) for (e, _, boost), r in zip(clauses, stats, strict=True)]
    numbers = numbered(terms)
    name = lambda i: (F.col("number") * len(clauses) + i).alias("tid")
    rows = [e.join(numbers, "term").crossJoin(F.broadcast(st)).select("doc", name(i), F.col("tf").alias("x"), shelves.norm(F.col("dl"), F.col("avgdl")).alias("y")) for i, (e, st, _) in enumerate(clauses)]  # st: one row
    rows += [e.select("doc", "tid", "x", "y") for e, _ in more]
    shelf, n = shelves.joined(materialize(shelves.pack(reduce(lambda a, b: a.unionByName(b), rows), n, add=True, block=BLOCK_IDS), "shelf"), n)
    df = shelves.frequencies(shelf, n)
    asks = [terms.join(numbers, "term").select("qid", name(i)).join(df, "tid").crossJoin(F.broadcast(st)).select("qid", "tid", (boost * idf()).alias("x")) for i, (_, st, boost) in enumerate(clauses)]  # st: one row
    asks += [a.select("qid", "tid", "x") for _, a in more]
    # Few rows, which several readers join: they are found once and known to be small.
    return materialize(top(shelves.best(shelf, reduce(lambda a, b: a.unionByName(b), asks), n, k), k), "best")


def bm25_best(docs: DataFrame, terms: DataFrame, k: int, boost: float = 1.0, more: list[tuple[DataFrame, DataFrame]] = ()) -> DataFrame:
    """best() over tokenised() or analysed() documents, which it reads twice."""
    return best([(counted(docs, terms), collection(docs), boost)], terms, k, more)


def tables_clause(asks: DataFrame, tabled: DataFrame, boost: float = BOOST_TABLE) -> tuple[DataFrame, DataFrame]:
    """The boost of tables (doc) for questions that want one (qid), for best()."""
    own = F.lit(0).cast("long").alias("tid")  # terms are numbered from 1
    one = tabled.select("doc").distinct().select("doc", own, F.lit(1.0).alias("x"), F.lit(K1).alias("y"))  # a gain of 1
    return one, asks.select("qid").distinct().select("qid", own, F.lit(boost).alias("x"))


def phrase_clause(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """phrases() for best(): each question has a term of its own, which its matches hold."""
    own = F.xxhash64(F.lit("phrase"), "qid").alias("tid")
    return scores.select("doc", own, F.col("tf").alias("x"), F.col("norm").alias("y")), scores.groupBy("qid").agg(F.first("weight").alias("x")).select("qid", own, "x")


def idf() -> Column:
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def placed(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, term, place, dl) of tokenised() documents for the questions' terms."""
    each = docs.select("doc", "dl", F.posexplode("ts").alias("place", "term"))
    return each.join(asked.select("term").distinct(), "term", "left_semi").select("doc", "term", "place", "dl")


def phrases(places: DataFrame, asked: DataFrame, stats: DataFrame, slop: int = SLOP, boost: float = BOOST_PHRASE) -> DataFrame:
    """(qid, doc, score, tf, norm, weight) of documents that hold all terms of a query within `slop` of their order.

    places: rows of placed(). Questions pass shards of documents; shifted places (place minus place in the
    query) of a match lie within `slop` of each other. The score is BM25 of the phrase count with summed idf.
    """
    row = stats.first()  # one row
    n = shelves.shards_of(row.n * (row.avgdl or 0.0))
    entries = places.select("doc", F.xxhash64("term").alias("tid"), F.col("place").alias("x"), F.col("dl").alias("y"))
    return phrases_of(shelves.pack(entries, n), n, asked, stats, slop, boost)


def phrases_of(shelf: DataFrame, n: int, asked: DataFrame, stats: DataFrame, slop: int = SLOP, boost: float = BOOST_PHRASE) -> DataFrame:
    """phrases() over a shelf of n shards: places by document and term's hash."""
    tid = F.xxhash64("term").alias("tid")
    ask = asked.select("qid", tid, F.col("qpos").alias("x"))
    tf, df = shelves.matches(shelf, ask, n, slop)
    rare = ask.join(df, "tid").crossJoin(F.broadcast(stats)).groupBy("qid").agg((boost * F.sum(idf())).alias("weight"), F.first("avgdl").alias("avgdl"))  # stats: one row
    out = tf.join(rare, "qid").withColumn("norm", shelves.norm(F.col("dl"), F.col("avgdl")))
    return out.select("qid", "doc", (F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))).alias("score"), "tf", "norm", "weight")


def phrase_scores(docs: DataFrame, stats: DataFrame, questions: DataFrame, qid_col: str, qtext_col: str, id_col: str = "doc_id", text_col: str = "text", slop: int = SLOP, boost: float = BOOST_PHRASE, fold: bool = False, stem: bool = False) -> DataFrame:
    """phrases() over documents (or tokenised() ones) that no index holds."""
    rows = docs if "ts" in docs.columns else analysed(docs, id_col, text_col, fold, stem)
    asked = asked_places(questions, qid_col, qtext_col, fold, stem)
    return phrases(placed(rows, asked), asked, stats, slop, boost)


def wants_table(question: Column) -> Column:
    low = F.lower(question)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in TABLE_CUES])


def should(*clauses: DataFrame) -> DataFrame:
    """SHOULD clauses: scores of all that match add up; at least one must match."""
    every = reduce(lambda a, b: a.unionByName(b), [c.select("qid", "doc", "score") for c in clauses])
    return every.groupBy("qid", "doc").agg(F.sum("score").alias("score"))


def table_clause(scores: DataFrame, asks: DataFrame, tabled: DataFrame, boost: float = BOOST_TABLE, k: int = BM25_SIZE) -> DataFrame:
    """(qid, doc, score): the boost of tables (doc) for questions that want one (qid), as far as the k best need it.

    It goes to tables among a question's scored documents (qid, doc, score) and to the 2 * k smallest
    ids of all tables: a question with fewer than k tables among its scored documents finds k others
    there, and with k or more no other table comes among its best. No question meets all tables.
    """
    hits = scores.select("qid", "doc").join(asks.select("qid"), "qid", "left_semi").join(tabled.select("doc"), "doc", "left_semi")
    first = tabled.select("doc").distinct().orderBy("doc").limit(2 * k).agg(F.collect_list("doc").alias("docs"))  # one row
    fill = asks.select("qid").distinct().crossJoin(F.broadcast(first)).select("qid", F.explode("docs").alias("doc"))
    return hits.select("qid", "doc").unionByName(fill).distinct().withColumn("score", F.lit(boost))


def filters(docs: DataFrame, wanted: dict | None) -> DataFrame:
    """AND of file_name, content_type (one or several) and has_table; other keys are ignored."""
    for key in ("file_name", "content_type", "has_table"):
        value = (wanted or {}).get(key)
        if value is not None:
            docs = docs.where(F.col(key).isin(list(value)) if isinstance(value, list | tuple | set) else F.col(key) == value)
    return docs


def top(scores: DataFrame, k: int, by: str | tuple[str, ...] = "qid", rank: str = "rank", digits: int = 6) -> DataFrame:
    """The k best rows of each query by rounded score, then id, with their rank from 1."""
    out = scores.withColumn("score", F.round("score", digits))
    order = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(F.desc("score"), "doc")
    return out.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, dims: int | None = None) -> Column:
    """Cosine of the first `dims` components; truncated vectors are normalised anew."""
    if dims:
        a, b = F.slice(a, 1, dims), F.slice(b, 1, dims)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors of a column as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(own: np.ndarray, ids: np.ndarray, ask: np.ndarray, asked: np.ndarray, k: int, dims: tuple[int | None, ...], unit: bool, same: bool) -> Iterator[tuple[int, int, int, float]]:
    """(dim, query, id, score) of the k best of each query, for every number of leading dimensions.

    Inner products grow from one number of dimensions to the next, so all of them cost one product.
    Scores are rounded to 6 digits before the cut, ties go to the smaller id: rows are sorted by id.
    """
    width, at = own.shape[1], 0
    dots, mine, theirs = np.zeros((len(ask), len(own))), np.zeros(len(own)), np.zeros(len(ask))
    for dim in sorted(dims, key=lambda d: d or width):
        to = min(dim or width, width)
        a, b = own[:, at:to], ask[:, at:to]
        dots += b @ a.T
        mine, theirs, at = mine + (a * a).sum(axis=1), theirs + (b * b).sum(axis=1), to
        scale = np.maximum(np.sqrt(theirs)[:, None] * np.sqrt(mine), 1e-300) if unit else 1.0
        for q, scores in zip(asked, np.round(dots / scale, 6), strict=True):
            if not same:
                scores = np.where(ids == q, -np.inf, scores)
            least = -np.partition(-scores, k - 1)[k - 1] if len(scores) > k else -np.inf
            found = np.flatnonzero((scores >= least) & (scores > -np.inf))
            for i in found[np.argsort(-scores[found], kind="stable")[:k]]:
                yield dim or 0, int(q), int(ids[i]), float(scores[i])


def _stream(k: int, dims: tuple[int | None, ...], unit: bool, same: bool):
    """Queries stream past the vectors of their shard, which come first; one shard is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, own, ids = None, [], None, None
        for batch in batches:
            key, ask = batch.column("shard").to_numpy(), batch.column("ask").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (ask[1:] != ask[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if a == b:
                    continue
                if key[a] != shard:
                    shard, parts, own = key[a], [], None
                v, i = batch.column("v").slice(a, b - a), batch.column("id").slice(a, b - a).to_numpy()
                if not ask[a]:
                    parts.append((i, _matrix(v)))
                    continue
                if not parts and own is None:
                    continue
                if own is None:
                    ids = np.concatenate([x for x, _ in parts])
                    order = np.argsort(ids, kind="stable")
                    own, ids, parts = np.concatenate([x for _, x in parts])[order], ids[order], []
                for c in range(0, len(i), QUERY_ROWS):
                    out = list(_best(own, ids, _matrix(v.slice(c, QUERY_ROWS)), i[c : c + QUERY_ROWS], k, dims, unit, same))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["dim", "qid", "doc", "score"])

    return run


def scan(shelf: DataFrame, ask: DataFrame, k: int, dims: tuple[int | None, ...] = (None,), unit: bool = True, same: bool = False) -> DataFrame:
    """(dim, qid, doc, score): of each query in a shard the k best of that shard. Both: shard (long), id (long), v.

    One shuffle by shard; memory is bounded by one shard and QUERY_ROWS queries, however many queries there are.
    """
    both = shelf.select("shard", F.lit(False).alias("ask"), "id", "v").unionByName(ask.select("shard", F.lit(True).alias("ask"), "id", "v"))
    dealt = both.where("v is not null").repartition("shard").sortWithinPartitions("shard", "ask")
    return dealt.mapInArrow(_stream(k, tuple(dims), unit, same), "dim int, qid bigint, doc bigint, score double")


def nearest_by_dims(vectors: DataFrame, queries: DataFrame, k: int = KNN_SIZE, dims: tuple[int | None, ...] = (None,), same: bool = False, unit: bool = True) -> DataFrame:
    """(dim, qid, doc, score, rank): exact neighbours by each number of leading dimensions, in one pass.

    Vectors are dealt to shards of bounded size, once; each query visits every shard and brings k
    rows a dimension back; a window merges them. Truncated vectors are normalised anew.
    """
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    long = F.col("id").cast("long").alias("id")
    shelf = vectors.select(long, "v", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    ask = queries.select(long, "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    return top(scan(shelf, ask, k, dims, unit, same), k, by=("dim", "qid"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = KNN_SIZE, dims: int | None = None, same: bool = False, unit: bool = True) -> DataFrame:
    """(qid, doc, score, rank): exact neighbours of each query (id, v) among vectors (id, v).

    Filters on vectors belong before this call. Scores have 6 digits, ties go to the smaller id.
    """
    return nearest_by_dims(vectors, queries, k, (dims,), same, unit).drop("dim")


def _places(held: np.ndarray) -> np.ndarray:
    """flatnonzero() of what is false nearly everywhere, by words of 8."""
    if held.size % 8:
        return np.flatnonzero(held)
    at = (np.flatnonzero(held.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return at[held[at]]


class _Nearest:
    """Queries of a group and the k best of them so far, by number of leading dimensions. Vectors come in the order of their ids."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, k: int, dims: tuple[int | None, ...]):
        self.ids, self.own, self.k = ids, own, k
        width = own.shape[1]
        self.dims = sorted(dims, key=lambda d: d or width)
        self.to = [min(d or width, width) for d in self.dims]
        self.norms, self.unit = self._norms(own), self._units(own)
        self.scores = np.full((len(dims), len(ids), k), -np.inf)
        self.docs = np.zeros((len(dims), len(ids), k), np.int64)

    def _norms(self, v: np.ndarray) -> list[np.ndarray]:
        return [np.sqrt((v[:, :to] * v[:, :to]).sum(axis=1)) for to in self.to]

    def _units(self, v: np.ndarray) -> list[np.ndarray]:
        return [(v[:, :to] / np.maximum(n, 1e-300)[:, None]).astype(np.float32) for to, n in zip(self.to, self._norms(v), strict=True)]

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Pairs are sifted in single precision with a margin; what passes is scored in double."""
        norms, units = self._norms(v), self._units(v)
        for a in range(0, len(self.ids), TILE):
            own = self.own[a : a + TILE]
            for i, to in enumerate(self.to):
                mine, least = self.norms[i][a : a + TILE], self.scores[i, a : a + TILE, -1]
                if not np.isinf(least).any():
                    held = self.unit[i][a : a + TILE] @ units[i].T > (least - 1e-6 - ROUNDING * (to + 8)).astype(np.float32)[:, None]
                    some = np.count_nonzero(held)
                    if not some:
                        continue
                    if some * 16 <= held.size:
                        q, d = np.divmod(_places(held.ravel()), len(ids))
                        self._keep(i, a, q, d, np.einsum("ij,ij->i", own[q, :to], v[d, :to]), mine, norms[i], ids)
                        continue
                # The first vectors, and many near the k-th: copies.
                self._take(i, a, own[:, :to] @ v[:, :to].T, mine, norms[i], ids)

    def _take(self, i: int, a: int, dots: np.ndarray, mine: np.ndarray, theirs: np.ndarray, ids: np.ndarray) -> None:
        least = self.scores[i, a : a + TILE, -1]
        sized = dots / np.maximum(theirs, 1e-300)
        if sized.shape[1] > self.k + 1 and np.isinf(least).any():  # the first vectors: rounding moves the k-th and its like by 1e-6 together; one may be the query's own row
            kth = np.partition(sized, -self.k - 1, axis=1)[:, -self.k - 1]
            held = sized >= np.where(np.isinf(least), kth - 1.1e-6 * mine, (np.maximum(least, -2.0) + 4e-7) * mine)[:, None]
        else:  # a later vector has to be better than the k-th by a digit, as ties go to the smaller id
            held = sized > np.where(np.isinf(least), -np.inf, (np.maximum(least, -2.0) + 4e-7) * mine)[:, None]
        q, d = np.nonzero(held)
        self._keep(i, a, q, d, dots[q, d], mine, theirs, ids)

    def _keep(self, i: int, a: int, q: np.ndarray, d: np.ndarray, dots: np.ndarray, mine: np.ndarray, theirs: np.ndarray, ids: np.ndarray) -> None:
        least = self.scores[i, a : a + TILE, -1]
        scores = np.round(dots / np.maximum(mine[q] * theirs[d], 1e-300), 6)
        use = (scores > least[q]) & (self.ids[a + q] != ids[d])
        q, docs, scores = q[use], ids[d[use]], scores[use]
        rows = np.unique(q)
        if not len(rows):
            return
        old_s, old_d = self.scores[i, a + rows], self.docs[i, a + rows]
        q, docs, scores = np.append(np.repeat(rows, self.k), q), np.append(old_d.ravel(), docs), np.append(old_s.ravel(), scores)
        order = np.lexsort((docs, -scores, q))
        place = np.searchsorted(q[order], rows)
        best = order[place[:, None] + np.arange(self.k)]
        self.scores[i, a + rows], self.docs[i, a + rows] = scores[best], docs[best]

    def found(self) -> Iterator[pa.RecordBatch]:
        for dim, scores, docs in zip(self.dims, self.scores, self.docs, strict=True):
            q, rank = np.nonzero(scores > -np.inf)
            columns = (np.full(len(q), dim or 0, np.int32), self.ids[q], docs[q, rank], scores[q, rank], (rank + 1).astype(np.int32))
            table = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["dim", "qid", "doc", "score", "rank"])
            for at in range(0, len(q), 65536):
                yield table.slice(at, 65536)


def _past(k: int, dims: tuple[int | None, ...]):
    """All vectors stream past the queries of a group, which come first; one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, parts, held = None, [], None
        for batch in batches:
            key, asks = batch.column("grp").to_numpy(), batch.column("vec").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if a == b:
                    continue
                if key[a] != grp:
                    if held:
                        yield from held.found()
                    grp, parts, held = key[a], [], None
                v, ids = _matrix(batch.column("v").slice(a, b - a)), batch.column("id").slice(a, b - a).to_numpy()
                if not asks[a]:
                    parts.append((ids, v))
                    continue
                if held is None and parts:
                    held, parts = _Nearest(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]), k, dims), []
                for c in range(0, len(ids) if held else 0, CHUNK):
                    held.meet(ids[c : c + CHUNK], v[c : c + CHUNK])
        if held:
            yield from held.found()

    return run


def nearest_to_all(vectors: DataFrame, k: int = KNN_SIZE, dims: tuple[int | None, ...] = (None,)) -> DataFrame:
    """nearest_by_dims() with every vector as a query: time grows with the square of their number, memory and results don't.

    A task holds one group of queries with their k best, and all vectors stream past it, so that no
    candidates are shuffled; the vectors are, once a group.
    """
    n = vectors.count()
    groups = max(1, -(-n // GROUP_ROWS), min(LEAST_GROUPS, -(-n // LEAST_ROWS)))
    held = vectors.where("v is not null").select(F.col("id").cast("long").alias("id"), "v")
    ask = held.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp"), F.lit(False).alias("vec"), "id", "v")
    past = held.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(True).alias("vec"), "id", "v")
    dealt = ask.unionByName(past).repartitionById(groups, "grp").sortWithinPartitions("grp", "vec", "id")
    return dealt.mapInArrow(_past(k, tuple(dims)), "dim int, qid bigint, doc bigint, score double, rank int")


def neighbours(vectors: DataFrame, queries: DataFrame, n: int = 20, most: int | None = None, seed: int = 42) -> DataFrame:
    """The n nearest other vectors, of all or, with `most`, of a sample that a hash picks."""
    if most is not None:
        vectors = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)
    return nearest(vectors, queries, n)


def fuse(bm25: DataFrame, vector: DataFrame, constant: int = RRF_CONSTANT, bm25_size: int = BM25_SIZE) -> DataFrame:
    """Reciprocal rank fusion: a full outer join on (qid, doc).

    Adds rrf_bm25, rrf_vector, rrf_score and ord, the order in which hits arrive: BM25 hits by rank,
    then vector-only hits by rank. Columns of both sides come from the BM25 side where it has them.
    """
    a, b = bm25.withColumnRenamed("rank", "bm25_rank"), vector.withColumnRenamed("rank", "vector_rank")
    shared = [c for c in a.columns if c in b.columns and c not in ("qid", "doc")]
    b = b.withColumnsRenamed({c: f"__{c}" for c in shared})
    out = a.join(b, ["qid", "doc"], "full_outer")
    for c in shared:
        out = out.withColumn(c, F.coalesce(c, f"__{c}")).drop(f"__{c}")
    part = lambda c: F.coalesce(1 / (constant + F.col(c)), F.lit(0.0))
    out = out.withColumn("rrf_bm25", part("bm25_rank")).withColumn("rrf_vector", part("vector_rank"))
    return out.withColumn("rrf_score", F.col("rrf_bm25") + F.col("rrf_vector")).withColumn("ord", F.coalesce("bm25_rank", F.lit(bm25_size) + F.col("vector_rank")))


def rerank(fused: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None, size: int = RERANK_SIZE, order: str = "insertion") -> DataFrame:
    """Add rerank_score and final_score. Only the first `size` candidates meet the scorer.

    order: "insertion" takes them as they arrived, "rrf" by fused score. scorer takes (qid, doc, ...)
    and returns (qid, doc, rerank_score); None leaves the fused score.
    """
    if scorer is None:
        return fused.withColumn("rerank_score", F.lit(0.0)).withColumn("final_score", F.col("rrf_score"))
    by = [F.col("ord")] if order == "insertion" else [F.desc("rrf_score"), F.col("ord")]
    out = fused.withColumn("__place", F.row_number().over(Window.partitionBy("qid").orderBy(*by)))
    scored = scorer(out.where(F.col("__place") <= size)).select("qid", "doc", "rerank_score")
    out = out.join(scored, ["qid", "doc"], "left")
    mixed = RRF_WEIGHT * F.col("rrf_score") + RERANK_WEIGHT * F.col("rerank_score")
    final = F.when(F.col("rerank_score").isNotNull(), mixed).otherwise(F.col("rrf_score"))
    return out.withColumn("final_score", final).withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0))).drop("__place")


def final(ranked: DataFrame, k: int = FINAL_SIZE) -> DataFrame:
    """The k best of each query by final score; ties keep the order of arrival."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("final_score", 9)), "ord")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_scorer(questions: DataFrame, docs: DataFrame, qid_col: str, qtext_col: str, id_col: str = "doc_id", text_col: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A deterministic stand-in for a cross-encoder: the share of query terms that a document holds."""
    asked = questions.select(F.col(qid_col).alias("qid"), F.array_distinct(tokens(qtext_col)).alias("qt"))
    held = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("__text"))

    def score(candidates: DataFrame) -> DataFrame:
        pairs = candidates.select("qid", "doc").join(asked, "qid").join(held, "doc")
        share = F.size(F.array_intersect("qt", tokens("__text"))) / F.greatest(F.size("qt"), F.lit(1))
        return pairs.select("qid", "doc", F.round(share, 6).alias("rerank_score"))

    return score
