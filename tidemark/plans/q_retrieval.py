"""Retrieval, fusion and cutting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vectors as Vc
from tidemark.operators import ranking as R
from tidemark.plans import retrieve
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.session import attach, read

TERMS = ["compost", "heap", "lawn"]
BM25 = """t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as tok from documents), l as (select doc_id, len(tok) as len, tok from t), s as (select count(*) as n, avg(len) as avg from l),
    f as (select doc_id, len, term, len(list_filter(tok, lambda x: x = term)) as tf from l, (select unnest(['compost', 'heap', 'lawn']) as term)), df as (select term, count(*) as d from f where tf > 0 group by 1),
    b as (select doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) as score from f join df using (term), s where tf > 0 group by 1),
    lex as (select doc_id, score, (row_number() over (order by score desc, doc_id) - 1)::int as rank from b order by score desc, doc_id limit 100)"""
VEC = """q as (select embedding::double[] as q from embeddings where vec_id = 7), v as (select vec_id as doc_id, round(list_cosine_similarity(embedding::double[], q), 6) as sim from embeddings, q),
    vec as (select doc_id, sim, (row_number() over (order by sim desc, doc_id) - 1)::int as rank from v order by sim desc, doc_id limit 100)"""


def _lexical(spark, d):
    return R.bm25(read(spark, d, "documents"), "doc_id", "text", " ".join(TERMS)).withColumn("rank", F.col("rank").cast("int"))


def _vector(spark, d):
    e = read(spark, d, "embeddings")
    probe = e.where("vec_id = 7").select(F.col("embedding").alias("q"))
    rows = attach(e, probe, "p").select(F.col("vec_id").alias("doc_id"), F.round(Vc.cosine(F.col("embedding"), F.col("p.q")), 6).alias("sim"))
    return R.ranked(rows.orderBy(F.desc("sim"), "doc_id").limit(100), F.desc("sim"), F.col("doc_id")).withColumn("rank", F.col("rank").cast("int"))


@query(f"with {BM25} select * from lex")
def bm25_topk(spark, d):
    return _lexical(spark, d)


@query(f"""with {BM25.split(', lex as')[0]}, qs as (select * from (values (1, 'compost'), (1, 'heap'), (2, 'melody'), (3, 'tax'), (3, 'return')) x(query_id, term)),
    ix as (select doc_id, term, count(*) as tf, any_value(len) as len from (select doc_id, len, unnest(tok) as term from l) group by 1, 2), dd as (select term, count(*) as d from ix group by 1),
    sc as (select query_id, doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) as score from qs join ix using (term) join dd using (term), s group by 1, 2)
    select query_id, doc_id, score, (row_number() over (partition by query_id order by score desc, doc_id) - 1)::int as rank from sc qualify row_number() over (partition by query_id order by score desc, doc_id) <= 10""")
def bm25_batch(spark, d):
    docs = read(spark, d, "documents")
    from tidemark.functions.text import tokens

    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens("text"))).alias("avg"))
    qs = spark.createDataFrame([(1, "compost"), (1, "heap"), (2, "melody"), (3, "tax"), (3, "return")], "query_id int, term string")
    return R.bm25_batch(R.postings(docs, "doc_id", "text"), stats, qs, "doc_id").withColumn("rank", F.col("rank").cast("int"))


@query(f"with {VEC} select * from vec")
def vector_topk(spark, d):
    return _vector(spark, d)


@query(f"with {VEC} select doc_id, sim from v where 1 - sim <= 0.8")
def vector_threshold(spark, d):
    e = read(spark, d, "embeddings")
    probe = e.where("vec_id = 7").select(F.col("embedding").alias("q"))
    rows = attach(e, probe, "p").select(F.col("vec_id").alias("doc_id"), F.round(Vc.cosine(F.col("embedding"), F.col("p.q")), 6).alias("sim"))
    return rows.where(1 - F.col("sim") <= 0.8)


@query(f"with {BM25}, {VEC} select doc_id, round(sum(1.0::double / (60 + rank + 1)), 9) as score from (select doc_id, rank from lex union all select doc_id, rank from vec) group by 1")
def rrf_merge_k60(spark, d):
    return R.rrf([_lexical(spark, d), _vector(spark, d)], "doc_id")


@query(f"with {BM25}, {VEC} select doc_id, round(sum(1.0::double / (1 + rank)), 9) as score from (select doc_id, rank from lex union all select doc_id, rank from vec) group by 1")
def rrf_merge_k1(spark, d):
    return R.rrf([_lexical(spark, d), _vector(spark, d)], "doc_id", k=1, offset=0)


_DECAY = "case when created_at is null then 1.0 else exp(-(epoch_us(timestamp '2026-09-01') - epoch_us(created_at)) / 86400000000.0 * ln(2.0) / 30.0) end"


@query(f"""with {BM25}, {VEC}, u as (select doc_id, rank from lex union all select doc_id, rank from vec),
    fused as (select doc_id, sum(1.0::double / (60 + rank + 1) * {_DECAY}) as s from u join documents using (doc_id) group by 1)
    select doc_id, round(s, 9) as score, (row_number() over (order by round(s, 9) desc, doc_id) - 1)::int as rank from fused order by round(s, 9) desc, doc_id limit 10""")
def hybrid_search(spark, d):
    return retrieve.hybrid(spark, d, _lexical(spark, d), _vector(spark, d), F.lit("2026-09-01").cast("timestamp"))


@query(f"with {V.EPISODES} select id, round({_DECAY}, 9) as decay, round(least(2.0, 1 + 0.3 * ln(1 + coalesce(retrieval_count, 0))), 9) as boost from episodes_")
def recency_and_feedback(spark, d):
    e = V.episodes(spark, d)
    return e.select("id", F.round(R.recency(F.col("created_at"), F.lit("2026-09-01").cast("timestamp"), 30.0), 9).alias("decay"), F.round(R.feedback(F.col("retrieval_count")), 9).alias("boost"))


POOL = f"with {BM25}, {VEC}, pool as (select vec.doc_id, vec.sim, vec.rank, b.score as bm25_score, d.session_id from vec left join b using (doc_id) left join documents d using (doc_id))"


def _pool(spark, d):
    docs = read(spark, d, "documents")
    lex = R.bm25_scores(docs, "doc_id", "text", " ".join(TERMS)).select("doc_id", F.col("score").alias("bm25_score"))
    return _vector(spark, d).join(lex, "doc_id", "left").join(docs.select("doc_id", "session_id"), "doc_id", "left")


@query(f"""{POOL}, p as (select *, row_number() over (order by bm25_score is null, bm25_score desc, rank) - 1 as pos from pool)
    select doc_id, (row_number() over (order by round(1.0::double / (61 + rank) + case when bm25_score is not null then 1.0::double / (61 + pos) else 0 end, 9) desc, rank) - 1)::int as new_rank from p""")
def bm25_refusion(spark, d):
    return R.refuse_lexical(_pool(spark, d), "doc_id").select("doc_id", F.col("new_rank").cast("int").alias("new_rank"))


@query(f"{POOL} select doc_id, rank from pool where rank < (select least(greatest(count(*) filter (where sim >= 0.25 * (select max(sim) from pool)), 3), 20, count(*)) from pool)")
def adaptive_cutoff(spark, d):
    return R.cutoff(_vector(spark, d), "sim", 0.25, 3, 20).select("doc_id", "rank")


@query(f"{POOL} select doc_id from pool where sim >= 2.0 or ((select max(sim) from pool) < 2.0 and rank < 2)")
def floor_keep_min(spark, d):
    return R.floor(_vector(spark, d), "sim", 2.0, keep=2).select("doc_id")


@query(f"{POOL} select doc_id from pool where not ((select max(sim) from pool) > 0 and (select max(sim) from pool) < 0.58) or rank < 1")
def abstention_floor(spark, d):
    return R.abstain(_vector(spark, d), "sim", 0.58, keep=1).select("doc_id")


@query(f"""{POOL}, o as (select *, session_id is null or row_number() over (partition by session_id order by rank) <= 2 as ok from pool), k as (select *, row_number() over (order by ok desc, rank) as k from o)
    select doc_id, (row_number() over (order by rank) - 1)::int as served from k where k <= 20""")
def session_cap_backfill(spark, d):
    return R.cap_per_session(_pool(spark, d), "session_id", 20).select("doc_id", F.col("served").cast("int").alias("served"))


@query(f"""{POOL}, o as (select *, row_number() over (partition by session_id order by rank) as s from pool) select doc_id, (row_number() over (order by rank) - 1)::int as served from o where session_id is null or s = 1 qualify row_number() over (order by rank) <= 15""")
def dedupe_parent(spark, d):
    return R.first_per_parent(_pool(spark, d), "session_id", 15).select("doc_id", F.col("served").cast("int").alias("served"))


@query(None)
def query_echo(spark, d):
    docs = read(spark, d, "documents")
    top = R.bm25(docs, "doc_id", "text", "compost heap lawn", k=60).join(docs.select("doc_id", "text"), "doc_id")
    q = "Keep an eye on the compost heap: it was overwatered many times last month, said the lawn edge group of the plot"
    return R.query_echo(top, "text", q).select("doc_id", "rank")


@query(None)
def recall_overview(spark, d):
    return retrieve.recall(spark, d, "compost heap lawn edge", 7)


@query(None)
def markdown_chunks(spark, d):
    from tidemark.functions.markdown import chunked

    return chunked(read(spark, d, "documents"), "doc_id", "text")


@query(None)
def web_result_union(spark, d):
    from tidemark.sources.web_results import parse

    rows = read(spark, d, "websearch").unionByName(read(spark, d, "exa_search_deep_researcher_start"))
    return parse(rows).select("result_id", "kind", "query", F.size("items").alias("items"), "research_id", "reason")
