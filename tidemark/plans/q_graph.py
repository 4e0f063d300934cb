"""Graph and bitemporal queries over supplier-part facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import mutate as X
from tidemark.operators import temporal as B
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.session import cut, read

AT = "timestamp_ntz'2000-01-01 00:00:00'"
E = f"with {V.EDGES}"


def _seeds(spark, d):
    s = read(spark, d, "supplier").orderBy("s_suppkey").limit(5).select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_suppkey").cast("int").alias("seed_rank"))
    return s


@query(f"{E} select node, count(*) as degree from (select src_uuid as node from edges where t_invalid is null union all select tgt_uuid from edges where t_invalid is null) group by 1")
def entity_degree(spark, d):
    return G.degree(G.live(V.edges(spark, d)))


@query(f"""{E}, {V.WAYS}, s as (select 's' || s_suppkey as node, s_suppkey::int as seed_rank from supplier order by s_suppkey limit 5)
    select node, other, uuid, seed_rank, hop::int as hop from (select w.*, seed_rank, row_number() over (partition by w.node order by t_valid desc, uuid) as hop from ways w join s using (node) where t_invalid is null) where hop <= 8""")
def one_hop_per_seed(spark, d):
    return G.one_hop(V.edges(spark, d), _seeds(spark, d)).select("node", "other", "uuid", "seed_rank", F.col("hop").cast("int").alias("hop"))


@query(f"""{E}, {V.WAYS}, one as (select distinct other as node from (select other from ways where node = 's1' order by t_valid desc, uuid, other limit 6000)),
    two as (select distinct w.other as node from (select w.other from ways w join one on w.node = one.node order by w.t_valid desc, w.uuid, w.other limit 6000) w),
    found as (select 's1' as node, 0 as level union all select node, 1 from one where node <> 's1' union all select node, 2 from two where node <> 's1' and node not in (select node from one)),
    deg as (select node, count(*) as degree from (select src_uuid as node from edges union all select tgt_uuid from edges) group by 1),
    kept as (select f.node, level, coalesce(degree, 0) as degree from found f left join deg using (node) order by level <> 0, coalesce(degree, 0) desc, f.node limit 150),
    ins as (select e.* from edges e where src_uuid in (select node from kept) and tgt_uuid in (select node from kept) order by not (src_uuid = 's1' or tgt_uuid = 's1'), t_valid desc, uuid limit 500)
    select node, level::int as level, degree from kept where level = 0 or node in (select src_uuid from ins union select tgt_uuid from ins)""")
def bfs_two_hops(spark, d):
    nodes, _ = G.neighbours(cut(V.edges(spark, d)), "s1")  # several passes over one view
    return nodes.select("node", F.col("level").cast("int").alias("level"), "degree")


@query(f"{E} select uuid, src_uuid, tgt_uuid from edges where t_valid is null or t_valid <= timestamp '2000-01-01'")
def edge_as_of(spark, d):
    return G.as_of(V.edges(spark, d), F.expr(AT)).select("uuid", "src_uuid", "tgt_uuid")


@query(f"""{E}, s as (select uuid, (row_number() over (order by uuid) - 1)::int as rank from (select uuid from edges where t_invalid is null order by uuid limit 400)),
    m as (select l.uuid, s.rank, o.uuid as old_uuid, row_number() over (partition by l.uuid order by o.t_invalid desc, o.uuid) as rn from edges l join s using (uuid) join edges o on o.src_uuid = l.src_uuid and o.tgt_uuid = l.tgt_uuid and o.t_invalid is not null where l.t_invalid is null)
    select uuid, old_uuid, rank from m where rn = 1 order by rank, uuid limit 50""")
def superseded_pairs(spark, d):
    e = V.edges(spark, d)
    from tidemark.operators.ranking import ranked

    served = ranked(e.where("t_invalid is null").orderBy("uuid").limit(400).select("uuid"), F.col("uuid"))
    return B.superseded_pairs(e, served, 50).select("uuid", "old_uuid", F.col("rank").cast("int").alias("rank"))


@query(f"""{E}, near as (select uuid, invalidated_by, 1.0 / (1 + mention_count) as sim from edges where t_invalid is not null order by t_invalid desc, uuid limit 100),
    m as (select near.uuid, e.uuid as successor, sim, row_number() over (partition by e.uuid order by sim desc, near.uuid) as rn from near join edges e on e.uuid = near.invalidated_by and e.t_invalid is null)
    select uuid, successor, round(sim, 6) as sim from m where rn = 1 order by sim desc, uuid limit 3""")
def surface_successor(spark, d):
    e = V.edges(spark, d)
    near = e.where("t_invalid is not null").orderBy(F.desc("t_invalid"), "uuid").limit(100).select("uuid", "invalidated_by", (F.lit(1.0) / (1 + F.col("mention_count"))).alias("sim"))
    return B.successors(near, e, e.select("uuid").limit(0)).withColumn("sim", F.round("sim", 6))


@query(f"""{E}, o as (select unnest(episodes) as episode_id, invalidated_by from edges where t_invalid is not null)
    select episode_id, string_agg(distinct invalidated_by, ',' order by invalidated_by) as current from o join orders on o_orderkey = episode_id where invalidated_by in (select uuid from edges where t_invalid is null) group by 1""")
def validity_overlay(spark, d):
    served = read(spark, d, "orders").select(F.col("o_orderkey").alias("episode_id"))
    return B.overlay(V.edges(spark, d), served).select("episode_id", F.array_join("current", ",").alias("current"))


@query(f"""{E}, {V.WAYS} select node, count(*) filter (where t_invalid is null or t_invalid > timestamp '2000-01-01') as live, count(*) filter (where t_invalid <= timestamp '2000-01-01') as closed, min(t_valid) as first_valid, count(distinct other) as neighbours from ways group by 1""")
def entity_dossier_stats(spark, d):
    return G.dossier(V.edges(spark, d), F.expr(AT))


@query(f"""{E}, s as (select uuid, t_valid, unnest(episodes) as o_orderkey from edges), g as (select uuid, t_valid, max(o_orderdate) as "right" from s join orders using (o_orderkey) group by 1, 2)
    select * from g where abs(epoch_us(t_valid) - epoch_us("right")) > 86400000000 and strftime(t_valid + interval 1 hour, '%H:%M:%S') not in ('00:00:00', '12:00:00')""")
def restamp_dates(spark, d):
    e = V.edges(spark, d)
    src = read(spark, d, "orders").select(F.col("o_orderkey").alias("episode_id"), F.col("o_orderdate").alias("created_at"))
    shifted = e.withColumn("t_valid", F.expr("t_valid + interval 1 hour"))  # driver dates are all at midnight
    out = B.restamp(shifted, src.withColumn("created_at", F.expr("created_at + interval 1 hour")))
    return out.select("uuid", F.expr("t_valid - interval 1 hour").alias("t_valid"), F.expr("right - interval 1 hour").alias("right"))


@query(f"""{E}, gone as (select o_orderkey from orders where o_orderpriority = '1-URGENT'), s as (select uuid, unnest(episodes) as o from edges), k as (select uuid, count(*) as kept from s where o not in (select o_orderkey from gone) group by 1)
    select uuid, kept from k""")
def provenance_unlink(spark, d):
    gone = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("episode_id"))
    return X.unlink(V.edges(spark, d), gone).select("uuid", F.size("episodes").cast("long").alias("kept"))


@query(f"""{E}, dl as (select uuid, [1, 2, 3]::bigint[] as ids from edges where mention_count >= 2)
    select e.uuid, (e.mention_count + case when d.uuid is not null and len(list_filter([1, 2, 3], lambda x: not list_contains(e.episodes, x))) > 0 then 1 else 0 end)::int as mention_count,
           len(list_distinct(list_concat(e.episodes, coalesce(d.ids, [])))) as sources from edges e left join dl d using (uuid)""")
def reinforce_edges(spark, d):
    e = V.edges(spark, d)
    delta = e.where("mention_count >= 2").select("uuid", F.expr("array(1L, 2L, 3L)").alias("ids"))
    return B.reinforce(e, delta).select("uuid", "mention_count", F.size("episodes").cast("long").alias("sources"))


@query(f"""{E} select uuid, case when uuid like '%-A' and mention_count >= 2 then timestamp '2005-01-01' else t_invalid end as t_invalid, case when uuid like '%-A' and mention_count >= 2 then replace(uuid, '-A', '-N') else invalidated_by end as invalidated_by from edges""")
def close_edges(spark, d):
    e = V.edges(spark, d)
    c = e.where("uuid like '%-A' and mention_count >= 2").select("uuid", F.expr("timestamp_ntz'2005-01-01 00:00:00'").alias("at"), F.regexp_replace("uuid", "-A$", "-N").alias("by"))
    return B.close(e, c, F.expr("timestamp_ntz'2005-01-01 00:00:00'")).select("uuid", "t_invalid", "invalidated_by")


@query(None)
def components(spark, d):
    return G.components(V.edges(spark, d).where("mention_count >= 2"), "src_uuid", "tgt_uuid")


@query("""with b as (select id, t, unnest(regexp_extract_all(t, '\\[\\[([^\\]|#\\n]+)', 1)) as target from (select id, 'see [[' || project || ']] and [[' || type || '|alias]]' as t from notes)) select distinct id, regexp_replace(target, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as target from b where regexp_replace(target, '[\\s\\p{Z}]+', '', 'g') <> ''""")
def link_graph(spark, d):
    files = read(spark, d, "notes").select("id", F.concat(F.lit("see [["), "project", F.lit("]] and [["), "type", F.lit("|alias]]")).alias("t"))
    return G.link_graph(files, "id", "t").select(F.col("source").alias("id"), "target")
