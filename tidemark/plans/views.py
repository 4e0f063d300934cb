"""Driver tables in the roles of the memory store's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import read


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes without redelivered rows."""
    return read(spark, d, "episodes").dropDuplicates(["id"])


EPISODES = "episodes_ as (select * from episodes qualify row_number() over (partition by id order by batch_no) = 1)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Facts between suppliers and parts, one per return flag; those with R are closed and point to the one with N."""
    key = F.concat(F.lit("s"), "l_suppkey", F.lit("-p"), "l_partkey", F.lit("-"))
    g = read(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(
        F.min("l_shipdate").alias("t_valid"), F.max("l_shipdate").alias("_last"), F.count(F.lit(1)).cast("int").alias("mention_count"), F.sort_array(F.collect_set("l_orderkey")).alias("episodes")
    )
    closed = F.col("l_returnflag") == "R"
    return g.select(
        F.concat(key, "l_returnflag").alias("uuid"), F.concat(F.lit("s"), "l_suppkey").alias("src_uuid"), F.concat(F.lit("p"), "l_partkey").alias("tgt_uuid"), "t_valid",
        F.when(closed, F.col("_last")).alias("t_invalid"), "mention_count", F.when(closed, F.concat(key, F.lit("N"))).alias("invalidated_by"), "episodes",
    )


EDGES = """edges as (
    select 's' || l_suppkey || '-p' || l_partkey || '-' || l_returnflag as uuid, 's' || l_suppkey as src_uuid, 'p' || l_partkey as tgt_uuid, min(l_shipdate) as t_valid,
           case when l_returnflag = 'R' then max(l_shipdate) end as t_invalid, count(*)::int as mention_count,
           case when l_returnflag = 'R' then 's' || l_suppkey || '-p' || l_partkey || '-N' end as invalidated_by, list_sort(list(distinct l_orderkey)) as episodes
    from lineitem group by l_suppkey, l_partkey, l_returnflag)"""
WAYS = "ways as (select src_uuid as node, tgt_uuid as other, uuid, t_valid, t_invalid from edges union all select tgt_uuid, src_uuid, uuid, t_valid, t_invalid from edges where src_uuid <> tgt_uuid)"
