"""Graph operators over edge frames (uuid, src_uuid, tgt_uuid, ...); joins, no graph library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """node, other and kept columns: every edge from both ends. Two equi-joinable halves instead of an OR join."""
    out = edges.select(F.col("src_uuid").alias("node"), F.col("tgt_uuid").alias("other"), *keep)
    back = edges.where(F.col("src_uuid") != F.col("tgt_uuid")).select(F.col("tgt_uuid").alias("node"), F.col("src_uuid").alias("other"), *keep)
    return out.unionByName(back)


def live(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("t_invalid").isNull())


def as_of(edges: DataFrame, at: Column) -> DataFrame:
    """Edges visible at a time: without or before their valid-from; superseded ones stay visible."""
    return edges.where(F.col("t_valid").isNull() | (F.col("t_valid") <= at))


def degree(edges: DataFrame) -> DataFrame:
    """node, degree over both ends; counted map-side, so hubs are no hot keys."""
    ends = edges.select(F.col("src_uuid").alias("node")).unionByName(edges.select(F.col("tgt_uuid").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def one_hop(edges: DataFrame, seeds: DataFrame, per_seed: int = 8) -> DataFrame:
    """seed_rank, node, other, uuid, t_valid: the newest live edges of each seed (node, seed_rank), either direction."""
    met = both_ways(live(edges), "uuid", "t_valid").join(seeds, "node")
    w = Window.partitionBy("node").orderBy(F.desc_nulls_last("t_valid"), "uuid")
    return met.withColumn("hop", F.row_number().over(w)).where(F.col("hop") <= per_seed)


def pick_seeds(candidates: DataFrame, degrees: DataFrame, focus: list[str], n: int = 8, bonus: float = 0.3) -> DataFrame:
    """node, distance, seed_rank: the first n connected candidates by raw distance, then re-sorted with a bonus for
    names in focus; the bonus can't bring in one beyond the first n."""
    rows = candidates.join(degrees.where("degree > 0"), "node")
    first = rows.orderBy("distance", "node").limit(n)
    adjusted = F.col("distance") - F.when(F.col("name").isin(focus) if focus else F.lit(False), F.lit(bonus)).otherwise(0.0)
    return first.withColumn("adjusted", F.round(adjusted, 9)).withColumn("seed_rank", F.row_number().over(Window.orderBy("adjusted", "node")) - 1)


def neighbours(edges: DataFrame, seed: str, depth: int = 2, nodes: int = 150, edge_cap: int = 500, level_cap: int = 6000) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a seed, depth 1 or 2, either direction, with deterministic caps.

    Nodes: seed first, then degree, then id. Edges: those at the seed first, then newest; nodes left without an edge
    are dropped. Every level is one join of the frontier with the edges.
    """
    spark = edges.sparkSession
    ways = both_ways(edges, "uuid", "t_valid")
    found = spark.createDataFrame([(seed, 0)], "node string, level int")
    frontier = found
    for level in range(1, min(max(depth, 1), 2) + 1):
        step = ways.join(frontier.select("node"), "node").orderBy(F.desc_nulls_last("t_valid"), "uuid", "other").limit(level_cap)
        fresh = step.select(F.col("other").alias("node")).distinct().join(found, "node", "left_anti").withColumn("level", F.lit(level))
        found = found.unionByName(fresh)
        frontier = fresh
    ranked = found.join(degree(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kept = ranked.orderBy(F.col("level") != 0, F.desc("degree"), "node").limit(nodes)
    inside = edges.join(kept.select(F.col("node").alias("src_uuid")), "src_uuid", "left_semi").join(kept.select(F.col("node").alias("tgt_uuid")), "tgt_uuid", "left_semi")
    at_seed = (F.col("src_uuid") == seed) | (F.col("tgt_uuid") == seed)
    inside = inside.orderBy(~at_seed, F.desc_nulls_last("t_valid"), "uuid").limit(edge_cap)
    ends = inside.select(F.col("src_uuid").alias("node")).union(inside.select(F.col("tgt_uuid").alias("node"))).distinct()
    return kept.join(ends, "node", "left_semi").unionByName(kept.where(F.col("level") == 0)).distinct(), inside


def resolve_seed(entities: DataFrame, degrees: DataFrame, said: str) -> DataFrame:
    """One entity for what was said: by uuid, else normalised name, else the best connected name that contains it."""
    low = said.strip().lower()
    how = F.when(F.col("uuid") == said, 0).when(F.col("normalized_name") == low, 1).when(F.lower("name").contains(low), 2)
    rows = entities.withColumn("how", how).where("how is not null").join(degrees.withColumnRenamed("node", "uuid"), "uuid", "left")
    return rows.orderBy("how", F.desc_nulls_last("degree"), "uuid").limit(1)


def dossier(edges: DataFrame, at: Column) -> DataFrame:
    """node, live, closed, first_valid, neighbours: what is known of each entity."""
    ways = both_ways(edges, "uuid", "t_valid", "t_invalid")
    alive = F.col("t_invalid").isNull() | (F.col("t_invalid") > at)
    return ways.groupBy("node").agg(F.count_if(alive).alias("live"), F.count_if(~alive).alias("closed"), F.min("t_valid").alias("first_valid"), F.countDistinct("other").alias("neighbours"))


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least node): connected components by alternating large-star and small-star steps.

    Each step is one aggregation; the number of steps grows with the logarithm of the graph. A hub is no group to be
    collected: only minima are taken, and those are combined map-side. Lineage is cut with checkpoints.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    all_nodes = cut(edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct())
    edges = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # large star: neighbours above a node hang onto the least of its neighbourhood
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours hang onto the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = cut(small.where("u != v"))
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            break
        edges = small
    return all_nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def link_graph(files: DataFrame, path: str, body: str) -> DataFrame:
    """source, target: wikilinks between files."""
    from tidemark.functions.text import wikilinks

    return files.select(F.col(path).alias("source"), F.explode(wikilinks(F.coalesce(F.col(body), F.lit("")))).alias("target")).distinct()


def typeahead(entities: DataFrame, degrees: DataFrame, said: str, n: int = 10) -> DataFrame:
    """Entities whose name contains what was typed, the best connected first."""
    rows = entities.where(F.lower("name").contains(said.strip().lower())) if said.strip() else entities.limit(0)
    return rows.join(degrees.withColumnRenamed("node", "uuid"), "uuid", "left").orderBy(F.desc_nulls_last("degree"), "name", "uuid").limit(n)


def with_names(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with src_name and tgt_name from entities (uuid, name); null where an end is unknown."""
    e = entities.groupBy("uuid").agg(F.min("name").alias("name"))
    side = lambda c: e.select(F.col("uuid").alias(f"{c}_uuid"), F.col("name").alias(f"{c}_name"))
    return edges.join(side("src"), "src_uuid", "left").join(side("tgt"), "tgt_uuid", "left")
