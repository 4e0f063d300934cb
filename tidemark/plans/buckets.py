"""The buckets of a recall and the drill-down reads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vectors as Vc
from tidemark.functions.markdown import chunk
from tidemark.operators import graph as G
from tidemark.operators import ranking as R
from tidemark.plans.retrieve import Scorer, T_clean, lexical_scorer


def kg_facts(edges: DataFrame, entities: DataFrame, query: str, probe: Column, focus: list[str], limit: int = 12) -> DataFrame:
    """uuid, fact, t_valid, rank: vector, lexical and one-hop legs over live facts, fused with k = 60.

    edges: uuid, src_uuid, tgt_uuid, fact, t_valid, t_invalid, embedding; entities: uuid, name, embedding. Scope is a
    filter before the legs. An edge met from two seeds counts twice.
    """
    live = edges.where(F.col("t_invalid").isNull() & (F.coalesce("fact", F.lit("")) != ""))
    vec = R.ranked(Vc.nearest(live, F.col("embedding"), probe, limit * 3, "uuid").select("uuid", "sim"), F.desc("sim"), F.col("uuid"))
    lex = R.bm25(live, "uuid", "fact", T_clean(query), limit * 3)
    near = Vc.nearest(entities, F.col("embedding"), probe, 25, "uuid").select(F.col("uuid").alias("node"), "name", F.round(1 - F.col("sim"), 9).alias("distance"))
    seeds = G.pick_seeds(near, G.degree(live), focus)
    hop = G.one_hop(edges, seeds.select("node", "seed_rank"))
    hop = R.ranked(hop.join(live.select("uuid"), "uuid", "left_semi").select("uuid", "seed_rank", "hop"), F.col("seed_rank"), F.col("hop"))
    fused = R.rrf([vec.select("uuid", "rank"), lex.select("uuid", "rank"), hop.select("uuid", "rank")], "uuid").orderBy(F.desc("score"), "uuid").limit(limit)
    return R.ranked(fused.join(live.select("uuid", "fact", "t_valid"), "uuid"), F.desc("score"), F.col("uuid"))


def web_bucket(chunks: DataFrame, query: str, probe: Column | None, scorer: Scorer = lexical_scorer, floor: float = 0.60, n: int = 3) -> DataFrame:
    """id, web_artifact_id, rerank, served: both legs fused, 60 reranked, those below the floor dropped unless there is
    no score at all, one per page. chunks: id, web_artifact_id, content, embedding (may be absent without a probe)."""
    legs = [R.bm25(chunks, "id", "content", T_clean(query), 60).select("id", "rank")]
    if probe is not None:
        legs.append(R.ranked(Vc.nearest(chunks, F.col("embedding"), probe, 60, "id").select("id", "sim"), F.desc("sim"), F.col("id")).select("id", "rank"))
    pool = R.rrf(legs, "id").orderBy(F.desc("score"), "id").limit(60).join(chunks.select("id", "web_artifact_id", "content"), "id")
    ranked = R.ranked(scorer(pool, "content", query), F.desc("rerank"), F.desc("score"), F.col("id"))
    top = F.max("rerank").over(Window.partitionBy(F.lit(1)))
    kept = ranked.withColumn("_top", top).where((F.col("_top") <= 0) | (F.col("rerank") >= floor)).drop("_top")
    return R.first_per_parent(kept, "web_artifact_id", n).select("id", "web_artifact_id", "rerank", F.col("served").cast("int").alias("served"))


def notes_bucket(notes: DataFrame, query: str, order: list[Column], project: str | None, scorer: Scorer = lexical_scorer, floor: float = 0.60, n: int = 3) -> DataFrame:
    """id ('n:<id>'), hook, note (700 characters), project: 24 nearest live notes in scope by `order` (similarity of the
    hook), floored on "hook — body"."""
    live = notes.where(F.col("superseded_by").isNull()).where(T.note_scope(F.col("type"), F.col("project"), project))
    pool = R.ranked(live.orderBy(*order, "id").limit(24), *order, F.col("id"))
    scored = scorer(pool.withColumn("_t", F.substring(F.concat_ws(" — ", "hook", "body"), 1, 4000)), "_t", query)
    kept = scored.where(F.col("rerank") >= floor) if floor > 0 else scored
    out = R.ranked(kept, F.desc("rerank"), F.col("rank"), name="served").where(F.col("served") < n)
    note = F.when(F.length("body") > 700, F.concat(F.substring("body", 1, 700), F.lit("…"))).otherwise(F.col("body"))
    return out.select(F.concat(F.lit("n:"), "id").alias("id"), "hook", note.alias("note"), "project", F.col("served").cast("int").alias("served"))


def best_window(content: Column, query: str, cap: int = 4000, size: int = 1024, k1: float = 1.5, b: float = 0.75) -> Column:
    """The `cap` characters around the stretch of `size` with the best BM25 against the query."""
    terms = sorted(set(query.lower().split()))
    c = F.coalesce(content, F.lit(""))
    n = F.greatest(F.ceil(F.length(c) / size), F.lit(1)).cast("int")
    wins = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.regexp_extract_all(F.lower(F.substring(c, i * size + 1, F.lit(size))), F.lit(r"[a-z0-9_./#+-]+"), F.lit(0)))
    avg = F.aggregate(wins, F.lit(0.0), lambda s, w: s + F.size(w)) / n

    def score(w: Column) -> Column:
        out = F.lit(0.0)
        for t in terms:
            f = _count(w, t)
            df = _holding(wins, t)
            out = out + F.when(f > 0, F.log(1 + (n - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.size(w) / avg))).otherwise(0.0)
        return out

    scores = F.transform(wins, score)
    best = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    lo = F.greatest(F.lit(0), best * size + size // 2 - cap // 2)
    return F.when(n <= 1, F.substring(c, 1, cap)).otherwise(F.substring(c, lo + 1, F.lit(cap)))


def _count(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def _holding(wins: Column, term: str) -> Column:
    return F.size(F.filter(wins, lambda w: F.array_contains(w, term)))


def passages(episodes: DataFrame, query: str, scorer: Scorer = lexical_scorer, n: int = 3, most: int = 80, cap: int = 2, slack: float = 0.0) -> DataFrame:
    """The n best passages of ranked episodes (id, session_id, project, created_at, content, rank), with who said them.

    Chunks in episode order, `most` of them, reranked; two per session, filled up. With slack a capped passage keeps
    its place unless one of another session scores within the slack, a fold over the pool of one query.
    """
    schema = "id long, session_id string, project string, date string, content string, lo int, hi int, pos int, whole string"

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.sort_values("rank").itertuples():
            for a, b in chunk(r.content):
                if r.content[a:b].strip():
                    rows.append((r.id, r.session_id, r.project, None if pd.isna(r.created_at) else str(r.created_at)[:10], r.content[a:b], a, b, len(rows), r.content))
        return pd.DataFrame(rows[:most], columns=[c.split()[0] for c in schema.split(", ")])

    top = episodes.where(F.trim(F.coalesce("content", F.lit(""))) != "").select("id", "session_id", "project", "created_at", "content", "rank")
    pool = top.withColumn("_q", F.lit(0)).groupBy("_q").applyInPandas(cut, schema)  # the top k of one query
    ranked = R.ranked(scorer(pool, "content", query), F.desc("rerank"), F.col("pos"))
    served = R.cap_per_session(ranked, "session_id", n, cap) if slack <= 0 else cap_with_slack(ranked, n, cap, slack)
    role = T.role_of(F.col("whole"), F.col("lo"), F.col("hi"))
    return served.select(F.concat(F.lit("e:"), "id").alias("id"), "content", "project", "date", F.col("session_id").alias("session"), role.alias("role"), F.col("served").cast("int").alias("served"))


def cap_with_slack(ranked: DataFrame, n: int, cap: int, slack: float) -> DataFrame:
    """The session cap that yields only to near ties; ranked: session_id, rerank, rank and more, of one query."""
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema) + ", served int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        per: dict[str, int] = {}
        full = lambda s: s is not None and per.get(s, 0) >= cap
        chosen = []
        rows = list(zip(pdf["session_id"].where(pdf["session_id"].notna(), None), pdf["rerank"]))
        for i, (s, score) in enumerate(rows):
            if len(chosen) == n:
                break
            if full(s):
                other = next((x for t, x in rows[i + 1 :] if t != s and not full(t)), None)
                if other is not None and score - other <= slack:
                    continue
            if s is not None:
                per[s] = per.get(s, 0) + 1
            chosen.append(i)
        chosen += [i for i in range(len(rows)) if i not in chosen][: max(0, n - len(chosen))]
        got = pdf.iloc[chosen].sort_values("rank")
        return got.assign(served=pd.Series(range(len(got)), index=got.index, dtype="int32"))

    return ranked.withColumn("_q", F.lit(0)).groupBy("_q").applyInPandas(lambda pdf: fold(pdf.drop(columns="_q")), out)


def fetch(episodes: DataFrame, notes: DataFrame, ids: list, most: int = 20) -> tuple[DataFrame, DataFrame, list[str]]:
    """(episodes, notes, skipped) of mixed ids 'e:N', N and 'n:N', in the order asked for, `most` of them."""
    spark = episodes.sparkSession
    seen, want, skipped = set(), [], []
    for x in ids:
        s = "" if isinstance(x, bool) else str(x)
        kind, num = (s[0], s[2:]) if s[:2] in ("e:", "n:") else ("e", s)
        if not num.isdigit():
            skipped.append(str(x))
        elif (kind, int(num)) not in seen and len(want) < most:
            seen.add((kind, int(num)))
            want.append((kind, int(num), len(want)))
    asked = spark.createDataFrame(want, "kind string, id long, n int")
    side = lambda df, k: df.join(F.broadcast(asked.where(F.col("kind") == k).select("id", "n")), "id").orderBy("n")  # noqa: E731 - at most `most` ids
    return side(episodes, "e"), side(notes, "n"), skipped


def contradictions(new: DataFrame, edges: DataFrame, floor: float = 0.7, top: int = 5) -> DataFrame:
    """new_uuid, uuid, sim: live facts between the same ends at least `floor` similar (1 without an embedding), the
    `top` nearest, left to a judge. new: uuid, src_uuid, tgt_uuid, embedding."""
    old = edges.where("t_invalid is null").select("uuid", "src_uuid", "tgt_uuid", F.col("embedding").alias("_o"))
    met = new.select(F.col("uuid").alias("new_uuid"), "src_uuid", "tgt_uuid", F.col("embedding").alias("_n")).join(old, ["src_uuid", "tgt_uuid"]).where("uuid <> new_uuid")
    met = met.withColumn("sim", F.when(F.col("_o").isNull(), F.lit(1.0)).otherwise(F.round(Vc.cosine(F.col("_n"), F.col("_o")), 6))).where(F.col("sim") >= floor)
    w = Window.partitionBy("new_uuid").orderBy(F.desc("sim"), "uuid")
    return met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("new_uuid", "uuid", "sim")
