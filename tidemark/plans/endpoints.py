"""Composite reads behind a dashboard: each a composition of operators, one plan a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import analytics as A
from tidemark.operators.mutate import flags_now
from tidemark.operators.ranking import bm25, bm25_scores


def catalog(episodes: DataFrame, groups: list[tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    return {"projects": A.counted(episodes, "project").orderBy(F.desc("n"), "project"), "groups": A.union_values(groups).orderBy("value")}


def episode(episodes: DataFrame, flags: DataFrame, ident: int) -> DataFrame:
    """One episode and whether it is flagged. flags: events as for flags_now()."""
    on = flags_now(flags).where("kind = 'episode'").select(F.col("item_id").cast("long").alias("id"), F.lit(True).alias("flagged"))
    return episodes.where(F.col("id") == ident).join(on, "id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def derived(edges: DataFrame, events: DataFrame, ident: int, most: int = 200) -> dict[str, DataFrame]:
    """Facts and events that came from an episode."""
    facts = edges.where(F.array_contains("episodes", ident)).orderBy(F.col("t_invalid").isNotNull(), F.desc_nulls_last("t_valid"), "uuid").limit(most)
    return {"facts": facts, "events": events.where(F.col("source_ref") == f"ep:{ident}").orderBy(F.desc_nulls_last("t_valid"), "id").limit(most)}


def session(episodes: DataFrame, session_id: str, most: int = 500) -> DataFrame:
    return episodes.where(F.col("session_id") == session_id).orderBy("sequence", "id").limit(most)


def search(tabs: dict[str, tuple[DataFrame, str, str]], query: str, tab: str, limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(totals of all tabs, hits of one). tabs: name -> (frame, id, text)."""
    totals = None
    for k, (df, i, t) in tabs.items():
        one = bm25_scores(df, i, t, query).agg(F.count(F.lit(1)).alias("n")).withColumn("tab", F.lit(k))
        totals = one if totals is None else totals.unionByName(one)
    df, i, t = tabs[tab]
    return totals, bm25(df, i, t, query, offset + limit).where(F.col("rank") >= offset).orderBy("rank")


def recall_history(metrics: DataFrame, since: Column, limit: int = 50) -> DataFrame:
    return metrics.where(F.col("created_at") > since).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def flags_list(flags: DataFrame, gists: dict[str, DataFrame]) -> DataFrame:
    """Live flags with the gist of what is flagged. gists: kind -> (item_id, gist)."""
    every = None
    for k, df in gists.items():
        one = df.select(F.lit(k).alias("kind"), F.col("item_id").cast("string").alias("item_id"), "gist")
        every = one if every is None else every.unionByName(one)
    return flags_now(flags).withColumn("item_id", F.col("item_id").cast("string")).join(every, ["kind", "item_id"], "left")


def preferences(prefs: DataFrame, most: int = 500) -> DataFrame:
    """Live ones first, then by the last assertion; with the text of what replaced them."""
    by = prefs.select(F.col("id").alias("superseded_by"), F.col("pref").alias("superseding"))
    return prefs.join(by, "superseded_by", "left").orderBy(F.col("t_invalid").isNotNull(), F.desc_nulls_last("last_asserted"), "id").limit(most)


def top_preferences(prefs: DataFrame, n: int = 10) -> DataFrame:
    return prefs.where("t_invalid is null").orderBy(F.desc("assert_count"), F.desc_nulls_last("last_asserted"), "id").limit(n)


def dream_runs(runs: DataFrame, n: int = 30) -> DataFrame:
    return runs.withColumn("seconds", F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")).orderBy(F.desc("started_at"), "id").limit(n)


def behavior_files(files: DataFrame) -> DataFrame:
    """The newest surface of each file, in a group by the shape of its path."""
    p = F.col("path")
    group = F.when(p.startswith("skills/"), "skills").when(p.contains("/memory/"), "memory").when(p.endswith("CLAUDE.md") | p.endswith("AGENTS.md"), "instructions").when(p.startswith("rules/"), "rules").otherwise("other")
    return A.distinct_on(files, ["path"], [F.desc_nulls_last("updated_at"), F.col("surface_id")]).withColumn("group", group).withColumn("bytes", F.octet_length("content"))


def proposals(lanes: list[DataFrame], most: int = 200) -> DataFrame:
    """All lanes' proposals (lane, id, score, updated_at), `most` of each, together."""
    out = None
    for x in lanes:
        one = x.orderBy(F.desc_nulls_last("score"), F.desc("updated_at"), "id").limit(most)
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("updated_at"), "lane", "id")


def skill_proposals(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where((F.col("status") == "proposed") & (F.col("rejected_until").isNull() | (F.col("rejected_until") <= now))).orderBy(F.desc("score"), "id")


def provenance(evidence: DataFrame, episodes: DataFrame) -> DataFrame:
    """candidate_id and the episodes of the sessions its evidence names."""
    return evidence.where("session_id is not null").select("candidate_id", "session_id").distinct().join(episodes.select("session_id", F.col("id").alias("episode_id"), "sequence"), "session_id")


def with_children(parents: DataFrame, children: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Parents with their files as a sorted list; children of one parent are few."""
    c = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("children"))
    return parents.join(c, key, "left")


def evidence_sessions(rows: DataFrame) -> DataFrame:
    """id, sessions: distinct sessions in the evidence arrays of proposals."""
    return rows.select("id", F.explode_outer("evidence").alias("e")).groupBy("id").agg(F.countDistinct("e.session_id").alias("sessions"))


def lineage(chunks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Web chunks with the page they came from."""
    return chunks.join(artifacts.select(F.col("id").alias("web_artifact_id"), "url", "title", "fetched_at"), "web_artifact_id")


def segment_time(episodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk id, valid_at: the time of its last source episode."""
    return chunks.select(F.col("id"), F.explode("episode_ids").alias("episode_id")).join(episodes.select(F.col("id").alias("episode_id"), "created_at"), "episode_id").groupBy("id").agg(F.max("created_at").alias("valid_at"))


def board(notes: DataFrame, recent: DataFrame, project: str | None) -> DataFrame:
    """The lines of a session's board: notes in scope by kind, then recent events, within its limits."""
    from tidemark.functions.text import note_scope

    kind = F.when(F.col("type") == "user", 0).when(F.col("type") == "feedback", 1).when(F.col("type") == "project", 2).otherwise(3)
    n = notes.where(F.col("superseded_by").isNull() & note_scope(F.col("type"), F.col("project"), project)).select(F.concat(F.lit("n:"), "id").alias("id"), kind.alias("class"), F.col("updated_at").alias("ts"), F.col("hook").alias("text"))
    r = recent.select(F.concat(F.lit("t:"), "id").alias("id"), F.lit(4).alias("class"), "ts", "text")
    lines = n.orderBy("class", F.desc_nulls_last("ts"), "id").limit(80).unionByName(r.orderBy(F.desc("ts"), "id").limit(80))
    return A.trim_board(lines)


def latest_by_ref(notes: DataFrame) -> DataFrame:
    return A.distinct_on(notes.where("source_ref is not null"), ["source_ref"], [F.desc_nulls_last("updated_at"), F.desc("id")])


def raised_since(rows: DataFrame, since: Column, n: int = 5) -> DataFrame:
    """Proposals since a run began: their number and the first few."""
    w = Window.orderBy(F.desc("updated_at"), "id")
    fresh = rows.where((F.col("status") == "proposed") & (F.col("updated_at") >= since))
    total = fresh.agg(F.count(F.lit(1)).alias("total"))
    return fresh.orderBy(F.desc("updated_at"), "id").limit(n).withColumn("n", F.row_number().over(w)).withColumn("total", total.scalar())
