"""Scoring, fusion and cutting of ranked frames. A ranked frame has an id and a 0-based rank."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.session import attach

K1, B = 1.2, 0.75


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """A 0-based rank over a bounded frame (the output of a top-k); it is one window, so never use it on a table."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def bm25_scores(docs: DataFrame, id_col: str, text: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """id, score of every document with a term of the query, in no order.

    Term frequencies of the few query terms and the length of each document come out of array expressions,
    document frequencies and the mean length are one aggregate row, a scalar subquery. A query without a
    letter or digit has no result.
    """
    terms = sorted(set(re.findall(r"[a-z0-9]+", query.lower())))
    if not terms:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    toks = docs.select(id_col, T.tokens(text).alias("_t")).select(
        id_col, F.size("_t").alias("_len"), *(_count("_t", t).alias(f"_f{i}") for i, t in enumerate(terms))
    )
    stats = toks.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(terms))))
    parts = []
    for i in range(len(terms)):
        f, d = F.col(f"_f{i}"), F.col(f"_s._d{i}")
        idf = F.log(1 + (F.col("_s._n") - d + 0.5) / (d + 0.5))
        parts.append(idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_len") / F.col("_s._avg"))))
    hit = reduce(lambda x, y: x | y, (F.col(f"_f{i}") > 0 for i in range(len(terms))))
    return attach(toks.where(hit), stats, "_s").withColumn("score", F.round(reduce(lambda x, y: x + y, parts), 6)).select(id_col, "score")


def bm25(docs: DataFrame, id_col: str, text: str, query: str, k: int = 100, k1: float = K1, b: float = B) -> DataFrame:
    """id, score, rank of the k best documents for the terms of a query; any term may match."""
    top = bm25_scores(docs, id_col, text, query, k1, b).orderBy(F.desc("score"), id_col).limit(k)
    return ranked(top, F.desc("score"), F.col(id_col))


def postings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """term, id, tf, len: the inverted index as a table, to be written bucketed by term and read by many queries."""
    toks = docs.select(id_col, T.tokens(text).alias("_t")).select(id_col, F.size("_t").alias("len"), F.explode("_t").alias("term"))
    return toks.groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def bm25_batch(index: DataFrame, stats: DataFrame, queries: DataFrame, id_col: str, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score, rank for many queries (query_id, term) over an index; stats: one row n, avg.

    The index is met by an equi-join on the term; scores are summed map-side before the per-query top k.
    """
    df = index.join(queries.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = attach(index.join(queries.distinct(), "term").join(df, "term"), stats, "s")
    idf = F.log(1 + (F.col("s.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("s.avg")))
    scored = hits.groupBy("query_id", id_col).agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def recency(ts: Column, now: Column, half_life_days: float) -> Column:
    """exp(-age ln 2 / half life); 1 for null; above 1 for the future."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.when(ts.isNull(), F.lit(1.0)).otherwise(F.exp(-age * F.log(F.lit(2.0)) / half_life_days))


def feedback(count: Column) -> Column:
    """1 + 0.3 ln(1 + n), at most 2."""
    return F.least(F.lit(2.0), 1 + 0.3 * F.log1p(F.coalesce(count, F.lit(0)).cast("double")))


def rrf(lists: list[DataFrame], id_col: str, k: int = 60, offset: int = 1, weight: Column | None = None) -> DataFrame:
    """id, score: the sum of weight / (k + rank + offset) over all occurrences, also repeated ones in one list."""
    w = F.lit(1.0) if weight is None else weight
    parts = (x.select(id_col, (w / (k + F.col("rank") + offset)).alias("_s")) for x in lists)
    return reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.round(F.sum("_s"), 9).alias("score"))


def refuse_lexical(df: DataFrame, id_col: str, rank: str = "rank", bm25_score: str = "bm25_score", k: int = 60, weight: float = 1.0, lift_cap: int = 0) -> DataFrame:
    """The order of a ranked list fused with the order of its lexical scores; rows without one keep their rank's term."""
    by = Window.orderBy(F.col(bm25_score).isNull(), F.desc(bm25_score), F.col(rank))
    pos = F.row_number().over(by) - 1
    lex = F.when(F.col(bm25_score).isNotNull() & ((F.lit(lift_cap) == 0) | (F.col("_p") < lift_cap)), weight / (k + F.col("_p") + 1)).otherwise(0.0)
    fused = df.withColumn("_p", pos).withColumn("fused", F.round(F.lit(1.0) / (k + F.col(rank) + 1) + lex, 9))
    return ranked(fused.drop("_p"), F.desc("fused"), F.col(rank), name="new_rank")


def reserve_lexical(df: DataFrame, window: int, reserve: int, rank: str = "rank", bm25_score: str = "bm25_score") -> DataFrame:
    """The first window - reserve rows stay, then the best lexical rows from below, then the rest."""
    head = F.col(rank) < max(window - reserve, 0)
    by = Window.orderBy(head, F.col(bm25_score).isNull(), F.desc(bm25_score), F.col(rank))
    lifted = ~head & F.col(bm25_score).isNotNull() & (F.row_number().over(by) <= reserve)
    group = F.when(head, 0).when(F.col("_l"), 1).otherwise(2)
    out = df.withColumn("_l", lifted).withColumn("_g", group)
    return ranked(out, F.col("_g"), F.when(F.col("_g") == 1, -F.col(bm25_score)).otherwise(F.lit(0.0)), F.col(rank), name="new_rank").drop("_l", "_g")


def cutoff(df: DataFrame, score: str, tau: float, least: int, most: int, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Rows kept by a score of at least tau times the top one, between least and most; most if the top isn't positive."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    top, n = F.max(score).over(w), F.count(F.lit(1)).over(w)
    keep = F.sum((F.col(score) >= F.lit(tau) * F.col("_top")).cast("int")).over(w)
    k = F.when(F.col("_top") <= 0, F.least(F.col("_n"), F.lit(most))).otherwise(F.least(F.greatest(F.col("_keep"), F.lit(least)), F.lit(most), F.col("_n")))
    return df.withColumn("_top", top).withColumn("_n", n).withColumn("_keep", keep).where(F.col(rank) < k).drop("_top", "_n", "_keep")


def floor(df: DataFrame, score: str, least: float, keep: int = 0, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Rows with at least a score; if none is left, the first `keep`."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    return df.withColumn("_any", F.max(score).over(w)).where((F.col(score) >= least) | ((F.col("_any") < least) & (F.col(rank) < keep))).drop("_any")


def abstain(df: DataFrame, score: str, least: float, keep: int = 0, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """The whole bucket if its top score reaches the floor or there is no real score (top 0), else the first `keep`."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    return df.withColumn("_top", F.max(score).over(w)).where(~((F.col("_top") > 0) & (F.col("_top") < least)) | (F.col(rank) < keep)).drop("_top")


def cap_per_session(df: DataFrame, session: str, n: int, cap: int = 2, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """n rows in rank order with at most cap per session, filled up by rank if too few; null sessions are never capped."""
    group = by or []
    seen = F.row_number().over(Window.partitionBy(*group, session).orderBy(rank))
    out = df.withColumn("_ok", F.col(session).isNull() | (seen <= cap))
    w = Window.partitionBy(*(group or [F.lit(1)]))
    kept = F.row_number().over(w.orderBy(F.desc("_ok"), rank))
    served = out.withColumn("_k", kept).where(F.col("_k") <= n)
    return served.withColumn("served", F.row_number().over(w.orderBy(rank)) - 1).drop("_ok", "_k")


def first_per_parent(df: DataFrame, parent: str, n: int, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """The first row of each parent, in rank order, n at most; rows without a parent all count."""
    group = by or []
    seen = F.row_number().over(Window.partitionBy(*group, parent).orderBy(rank))
    out = df.withColumn("_s", seen).where(F.col(parent).isNull() | (F.col("_s") == 1))
    w = Window.partitionBy(*(group or [F.lit(1)])).orderBy(rank)
    return out.withColumn("served", F.row_number().over(w) - 1).where(F.col("served") < n).drop("_s")


def rerank_recency(df: DataFrame, score: str, ts: str, now: Column, half_life_days: float = 14.0, least: float = 0.25) -> DataFrame:
    """Scores times recency, never below `least`; untouched where the top score isn't positive."""
    top = F.max(score).over(Window.partitionBy(F.lit(1)))
    return df.withColumn("_top", top).withColumn("adjusted", F.when(F.col("_top") <= 0, F.col(score)).otherwise(F.col(score) * F.greatest(F.lit(least), recency(F.col(ts), now, half_life_days)))).drop("_top")


def self_excluded(df: DataFrame, session: str, current: str | None) -> DataFrame:
    """Without the rows of the asking session; rows without a session stay."""
    return df if current is None else df.where(~F.col(session).eqNullSafe(F.lit(current)))


def query_echo(df: DataFrame, content: str, query: str, rank: str = "rank", need: int | None = None) -> DataFrame:
    """Rows that are no echo of the query.

    An echo shares a five-word shingle of 25 characters or more and then a substring of min(60, max(40, half the
    query)) characters with it. The shingle test runs in the JVM; only its few hits reach Python. With `need`, rows
    after the need-th survivor are left unscanned, as they can't be served.
    """
    q = " ".join(query.split()).lower()
    words = q.split(" ")
    sh = [s for i in range(len(words) - 4) if len(s := " ".join(words[i : i + 5])) >= 25]
    if len(q) < 40 or not sh:
        return df
    limit = min(60, max(40, len(q) // 2))
    flat = T.squashed(F.coalesce(F.col(content), F.lit("")))

    # a common substring of the needed length is one of the query's own substrings of that length
    pieces = {q[i : i + limit] for i in range(len(q) - limit + 1)}

    @F.pandas_udf("boolean")
    def echo(texts: pd.Series) -> pd.Series:
        found = lambda t: t is not None and any(t[i : i + limit] in pieces for i in range(len(t) - limit + 1))
        return texts.map(found).astype(bool)

    out = df.withColumn("_flat", flat).withColumn("_hit", reduce(lambda a, b: a | b, (F.col("_flat").contains(s) for s in sh)))
    out = out.withColumn("_echo", F.when(F.col("_hit"), echo("_flat")).otherwise(False))
    if need is not None:
        before = F.coalesce(F.sum((~F.col("_echo")).cast("int")).over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("_before", before).where(~F.col("_echo") | (F.col("_before") >= need)).drop("_before")
    else:
        out = out.where(~F.col("_echo"))
    return out.drop("_flat", "_hit", "_echo")
