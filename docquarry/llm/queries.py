"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bpe, changes, jaccard, language, mixing, neighbours, packing, quality, resampling, secrets, sharding, substrings, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = topk.search(docs, docs.where("doc_id % 50 = 0"))
    return found.withColumn("score", F.round("score", 6))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), hex_runs=True)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op7_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut(_table(spark, sf_dir, "documents"), with_text=False)


def op11_change_applier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.apply(_table(spark, sf_dir, "client_changes"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_bm25_topk, op3_nearest_neighbours, op4_byte_bpe, op5_secret_scan, op6_jaccard_join, op7_byte_sharding, op8_language_id, op9_quality_classifier, op10_substring_dedup, op11_change_applier, op12_source_mixing, op13_importance_resampling)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

#: The operators that SQL can express over whole tables.
SQL: dict[str, str] = {
    "op2_bm25_topk": rf"""with t as (select doc_id, regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') as ts from documents),
st as (select count(*)::double as n, avg(len(ts)) as mean from t),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ts) as term from t) group by all),
df as (select term, count(*) as df from tf group by term),
s as (select q.doc_id as query_id, d.doc_id as doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len(ts) / mean))), 9) as score
 from tf q join tf d using (term) join df using (term) join t on t.doc_id = d.doc_id, st where q.doc_id % 50 = 0 and q.doc_id <> d.doc_id group by 1, 2)
select query_id, row_number() over (partition by query_id order by score desc, doc_id)::int as rank, doc_id, round(score, 6) as score from s qualify rank <= 10""",
    "op6_jaccard_join": rf"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as ws from documents),
sh as (select distinct doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, count(g) as n from w left join sh using (doc_id) group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from n union select e.b, r.root from r join e on e.a = r.doc_id)
select doc_id, n as n_shingles, min(root) as component_id from r join n using (doc_id) group by doc_id, n""",
    "op10_substring_dedup": rf"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
p as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
f as (select g, min(doc_id) as first from p group by g),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as k from p join f using (g) where doc_id > first),
each as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as k from w),
kept as (select doc_id, string_agg(word, ' ' order by k) as kept, count(*) as n from each anti join gone using (doc_id, k) group by doc_id)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (doc_id)""",
}
