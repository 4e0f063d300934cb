"""Hybrid retrieval as one plan: legs, fusion, gates, served buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vectors as Vc
from tidemark.operators import ranking as R
from tidemark.session import attach, read

#: A scorer takes the candidates with a text column and a query and adds `rerank`. The default is lexical.
Scorer = Callable[[DataFrame, str, str], DataFrame]


def lexical_scorer(df: DataFrame, text: str, query: str) -> DataFrame:
    """Share of the query's terms that the first 4000 characters of a text hold: deterministic, JVM-side."""
    terms = sorted(set(query.lower().split()))
    toks = T.tokens(F.substring(text, 1, 4000))
    hits = sum(F.array_contains(toks, t).cast("int") for t in terms) if terms else F.lit(0)
    return df.withColumn("rerank", F.round(hits / F.lit(max(len(terms), 1)), 6))


def hybrid(spark: SparkSession, d: str, lexical: DataFrame, vector: DataFrame, now: Column, n: int = 10) -> DataFrame:
    """doc_id, score, rank: both legs fused with a 30-day recency weight on every occurrence."""
    times = read(spark, d, "documents").select("doc_id", "created_at")
    legs = lexical.select("doc_id", "rank").unionByName(vector.select("doc_id", "rank")).join(times, "doc_id")
    part = F.lit(1.0) / (60 + F.col("rank") + 1) * R.recency(F.col("created_at"), now, 30.0)
    fused = legs.withColumn("_s", part).groupBy("doc_id").agg(F.round(F.sum("_s"), 9).alias("score"))
    top = fused.orderBy(F.desc("score"), "doc_id").limit(n)
    return R.ranked(top, F.desc("score"), F.col("doc_id")).withColumn("rank", F.col("rank").cast("int"))


def recall(
    spark: SparkSession, d: str, query: str, probe: int, project: str | None = None, session: str | None = None, now: str = "2026-09-01",
    scorer: Scorer = lexical_scorer, floor: float = 0.0, n: int = 3,
) -> DataFrame:
    """The served passages of a query: session, content, rank.

    BM25 and vector top-k over episodes, fused; the pool of 100 reranked by a pluggable scorer, recency put back,
    own session excluded, lexical order fused in, echoes dropped, two per session, n served, all or nothing below
    the floor. The embedding of the query is a row of the embeddings table, since embedders are external.
    """
    docs = read(spark, d, "documents").where("text is not null")
    if project is not None:
        docs = docs.where(F.col("project") == project)
    lex = R.bm25(docs, "doc_id", "text", T_clean(query), k=100)
    e = read(spark, d, "embeddings")
    q = e.where(F.col("vec_id") == probe).select(F.col("embedding").alias("q"))
    near = attach(e.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), q, "probe")
    near = near.select(F.col("vec_id").alias("doc_id"), Vc.cosine(F.col("embedding"), F.col("probe.q")).alias("sim")).orderBy(F.desc("sim"), "doc_id").limit(100)
    vec = R.ranked(near, F.desc("sim"), F.col("doc_id"))
    fused = R.rrf([lex.select("doc_id", "rank"), vec.select("doc_id", "rank")], "doc_id").orderBy(F.desc("score"), "doc_id").limit(100)
    pool = fused.join(docs.select("doc_id", "text", "session_id", "created_at"), "doc_id").join(lex.select("doc_id", F.col("score").alias("bm25_score")), "doc_id", "left")
    scored = R.rerank_recency(scorer(pool, "text", query), "rerank", "created_at", F.lit(now).cast("timestamp"))
    scored = R.self_excluded(scored, "session_id", session)
    ordered = R.refuse_lexical(R.ranked(scored, F.desc("adjusted"), F.desc("score"), F.col("doc_id")), "doc_id").drop("rank").withColumnRenamed("new_rank", "rank")
    kept = R.query_echo(R.abstain(ordered, "rerank", floor), "text", query)
    served = R.cap_per_session(kept, "session_id", n)
    return served.select("doc_id", "session_id", F.col("served").cast("int").alias("rank"), F.substring("text", 1, 1500).alias("content"), "rerank")


def T_clean(query: str) -> str:
    """A query with only letters, digits and spaces."""
    return "".join(c if c.isalnum() or c.isspace() else " " for c in query).strip()


def recall_turns(episodes: DataFrame, query: str, probe: Column | None, now: Column, n: int = 5, tau: float = 0.5, most: int = 10, scorer: Scorer = lexical_scorer) -> DataFrame:
    """Full turns of a query: both legs over episodes (id, content, session_id, created_at, retrieval_count and, with a
    probe, embedding), fused with recency and feedback weights, reranked on the head and the best stretch of long
    turns, and cut at tau times the top score, n to `most` of them."""
    from tidemark.plans.buckets import best_window

    legs = [R.bm25(episodes, "id", "content", T_clean(query), 100).select("id", "rank")]
    if probe is not None:
        legs.append(R.ranked(Vc.nearest(episodes, F.col("embedding"), probe, 100, "id").select("id", "sim"), F.desc("sim"), F.col("id")).select("id", "rank"))
    meta = episodes.select("id", "session_id", "created_at", "retrieval_count", "content")
    hits = None
    for leg in legs:
        hits = leg if hits is None else hits.unionByName(leg)
    hits = hits.join(meta.select("id", "created_at", "retrieval_count"), "id")
    weight = R.recency(F.col("created_at"), now, 30.0) * R.feedback(F.col("retrieval_count"))
    fused = R.rrf([hits.withColumn("w", weight)], "id", weight=F.col("w"))
    pool = fused.orderBy(F.desc("score"), "id").limit(100).join(meta, "id")
    head = scorer(pool, "content", query).withColumnRenamed("rerank", "_head")
    both = scorer(head.withColumn("_win", best_window(F.col("content"), query)), "_win", query).withColumn("rerank", F.greatest("_head", "rerank")).drop("_head", "_win")
    ranked = R.ranked(R.rerank_recency(both, "rerank", "created_at", now), F.desc("adjusted"), F.desc("score"), F.col("id"))
    return R.cutoff(ranked, "adjusted", tau, n, most).select("id", "session_id", "rank", "rerank", "content")
