"""Bitemporal facts: closing, reinforcing, supersession, date repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def close(edges: DataFrame, closures: DataFrame, now: Column) -> DataFrame:
    """Edges with those of closures (uuid, at, by) closed: t_invalid and invalid_at at `at` or now; invalidated_by kept
    where the closure names none. Closed edges are never deleted."""
    c = closures.groupBy("uuid").agg(F.min("at").alias("_at"), F.max("by").alias("_by"), F.lit(True).alias("_c"))
    t = edges.schema["t_invalid"].dataType
    when = F.coalesce(F.col("_at").cast(t), now.cast(t))
    out = edges.join(c, "uuid", "left")
    out = out.withColumn("t_invalid", F.when(F.col("_c"), when).otherwise(F.col("t_invalid"))).withColumn("invalidated_by", F.coalesce("_by", "invalidated_by"))
    return out.select(*edges.columns)


def reinforce(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """Edges with more sources (uuid, ids): the union of distinct ids; mention_count + 1 only if an id is new."""
    d = delta.select("uuid", F.explode("ids").alias("i")).groupBy("uuid").agg(F.sort_array(F.collect_set("i")).alias("_ids"))
    out = edges.join(d, "uuid", "left")
    new = F.size(F.array_except(F.col("_ids"), F.col("episodes"))) > 0
    out = out.withColumn("mention_count", F.col("mention_count") + F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0))
    return out.withColumn("episodes", F.when(F.col("_ids").isNull(), F.col("episodes")).otherwise(F.array_union("episodes", "_ids"))).select(*edges.columns)


def superseded_pairs(edges: DataFrame, served: DataFrame, n: int = 2) -> DataFrame:
    """uuid, old_uuid, rank: for served live edges (uuid, rank) the latest closed edge between the same ends, n in all."""
    now = edges.where("t_invalid is null").join(served, "uuid")
    old = edges.where("t_invalid is not null").select(F.col("uuid").alias("old_uuid"), "src_uuid", "tgt_uuid", F.col("t_invalid").alias("closed"))
    met = now.select("uuid", "rank", "src_uuid", "tgt_uuid").join(old, ["src_uuid", "tgt_uuid"])
    w = Window.partitionBy("uuid").orderBy(F.desc("closed"), "old_uuid")
    return met.withColumn("rn", F.row_number().over(w)).where("rn = 1").orderBy("rank", "uuid").limit(n).select("uuid", "old_uuid", "rank")


def successors(closed_near: DataFrame, edges: DataFrame, served: DataFrame, n: int = 3) -> DataFrame:
    """uuid, successor: live successors of closed edges near a query (uuid, invalidated_by, sim), not served yet."""
    new = edges.where("t_invalid is null").select(F.col("uuid").alias("successor"))
    met = closed_near.where("invalidated_by is not null").join(new, F.col("invalidated_by") == F.col("successor")).join(served.select(F.col("uuid").alias("successor")), "successor", "left_anti")
    w = Window.partitionBy("successor").orderBy(F.desc("sim"), "uuid")
    return met.withColumn("rn", F.row_number().over(w)).where("rn = 1").orderBy(F.desc("sim"), "uuid").limit(n).select("uuid", "successor", "sim")


def overlay(edges: DataFrame, served_episodes: DataFrame) -> DataFrame:
    """episode_id, current: live edges that replaced what a served episode said."""
    old = edges.where("t_invalid is not null and invalidated_by is not null").select(F.explode("episodes").alias("episode_id"), "invalidated_by")
    met = old.join(served_episodes.select("episode_id").distinct(), "episode_id").join(edges.where("t_invalid is null").select(F.col("uuid").alias("invalidated_by")), "invalidated_by", "left_semi")
    return met.groupBy("episode_id").agg(F.sort_array(F.collect_set("invalidated_by")).alias("current"))


def restamp(facts: DataFrame, sources: DataFrame, most_days: float = 1.0) -> DataFrame:
    """uuid, t_valid, right: facts dated more than a day off the last of their source episodes (episode_id, created_at),
    unless stated as a date of its own (midnight or noon)."""
    src = facts.select("uuid", "t_valid", F.explode("episodes").alias("episode_id")).join(sources, "episode_id")
    got = src.groupBy("uuid", "t_valid").agg(F.max("created_at").alias("right"))
    off = F.abs(F.unix_micros(F.col("t_valid").cast("timestamp")) - F.unix_micros(F.col("right").cast("timestamp"))) > most_days * 86_400_000_000
    clock = F.date_format("t_valid", "HH:mm:ss")
    return got.where(off & ~clock.isin("00:00:00", "12:00:00"))


def pref_action(new: DataFrame, live_prefs: DataFrame, sim: Column, reassert: float = 0.90, supersede: float = 0.78) -> DataFrame:
    """id, action, target_id from the nearest live preference: reassert, supersede (like against dislike), confirm or insert.

    new: id, polarity; live_prefs: pair rows (id, pref_id, polarity_old, and what sim needs).
    """
    near = live_prefs.withColumn("_sim", sim).groupBy("id").agg(F.max(F.struct("_sim", -F.col("pref_id"), F.col("polarity_old"), F.col("pref_id"))).alias("t"))
    out = new.join(near, "id", "left")
    s, flip = F.col("t._sim"), F.array_sort(F.array("polarity", "t.polarity_old")) == F.array(F.lit("dislike"), F.lit("like"))
    action = F.when(s >= reassert, "reassert").when((s >= supersede) & flip, "supersede").when(s >= supersede, "confirm").otherwise("insert")
    return out.select("id", action.alias("action"), F.when(action != "insert", F.col("t.pref_id")).alias("target_id"))


def gate(sim: Column, high: float = 0.95, low: float = 0.70) -> Column:
    """merge, new or gray; no similarity is gray."""
    return F.when(sim.isNull(), "gray").when(sim >= high, "merge").when(sim <= low, "new").otherwise("gray")
