"""The store's mutations, ledgers and session operators on the driver's tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import analytics as A
from tidemark.operators import graph as G
from tidemark.operators import mining as M
from tidemark.operators import mutate as X
from tidemark.operators import ranking as K
from tidemark.operators import resolve as R
from tidemark.operators import sessionize as S
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.session import read

NOTES = "n as (select * from notes where id is not null qualify row_number() over (partition by id order by owner_id) = 1)"


def _notes(spark, d):
    return read(spark, d, "notes").where("id is not null").dropDuplicates(["id"])


@query("""with old as (select c_custkey as k, c_name as name from customer where c_custkey % 3 <> 0), new as (select o_custkey as k, min(o_orderpriority) as name from orders group by 1)
    select * from old union all select * from new where k not in (select k from old)""")
def insert_ignore(spark, d):
    old = read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return X.insert_ignore(old, read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("name")), ["k"], ["name"])


@query("""with c as (select c_custkey as k, c_name as name, c_acctbal as bal from customer), old as (select * from c where k % 3 <> 0), new as (select k, name || '!' as name, bal * 2 as bal from c where k % 2 = 0)
    select coalesce(o.k, n.k) as k, case when o.k is null then n.name else o.name end as name, round(coalesce(n.bal, o.bal), 4) as bal from old o full join new n on o.k = n.k""")
def upsert_fixed(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.where("k % 2 = 0").select("k", F.concat("name", F.lit("!")).alias("name"), (F.col("bal") * 2).alias("bal"))
    return X.upsert(c.where("k % 3 <> 0"), new, ["k"], fixed=["name"]).withColumn("bal", F.round("bal", 4))


@query("""select p_partkey as k, case when p_partkey % 7 = 0 then p_name || ' new' else p_name end as name from part where p_partkey % 5 = 0 or p_partkey % 7 = 0""")
def upsert_changed(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    new = p.withColumn("name", F.when(F.col("k") % 7 == 0, F.concat("name", F.lit(" new"))).otherwise(F.col("name"))).withColumn("h", F.md5("name"))
    return X.changed(p.where("k % 5 <> 0").withColumn("h", F.md5("name")), new, ["k"], "h").select("k", "name")


@query("""with o as (select o_custkey as k, max(o_orderdate) filter (o_orderkey % 2 = 0) as was, max(o_orderdate) filter (o_orderkey % 2 = 1) as now_ from orders group by 1) select k, greatest(was, now_) as mark from o""")
def watermark_rises(spark, d):
    mark = lambda n: F.max(F.when(F.col("o_orderkey") % 2 == n, F.col("o_orderdate")))
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(mark(0).alias("was"), mark(1).alias("now"))
    return o.select("k", X.watermark(F.col("was"), F.col("now")).alias("mark"))


@query("""select l_orderkey as k, l_linenumber as n from lineitem where l_orderkey % 4 <> 0 union all select distinct l_orderkey, -1 from lineitem where l_orderkey % 4 = 0""")
def children_replaced(spark, d):
    old = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    return X.replace_children(old, old.where("k % 4 = 0").select("k", F.lit(-1).alias("n")).distinct(), "k")


@query("""select p_partkey as k, case when p_partkey % 6 = 0 then p_name || '+' else p_name end as description, case when p_partkey % 6 = 0 then null else p_size end as vec from part""")
def embedding_reset(spark, d):
    old = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("description"), F.col("p_size").alias("vec"))
    delta = old.where("k % 3 = 0").select("k", F.when(F.col("k") % 6 == 0, F.concat("description", F.lit("+"))).otherwise(F.col("description")).alias("description"))
    return X.reset_if_changed(old, delta, ["k"], "description", "vec")


@query(f"""with {NOTES} select id, body, case when id % 10 = 1 then 'delete' else 'update' end as op from n where id % 10 = 1 or (id % 10 = 2 and body is not null)""")
def change_history(spark, d):
    old = _notes(spark, d).select("id", "body")
    new = old.where("id % 10 <> 1").withColumn("body", F.when(F.col("id") % 10 == 2, F.concat("body", F.lit("."))).otherwise(F.col("body")))
    return X.history(old, new, "id", "body", F.lit("2026-01-01").cast("timestamp")).drop("at")


@query("""with r as (select distinct event_type as name from events union all select 'never') select name, count(e.event_type) as fire_count, max(e.ts) as last_fired from r left join events e on e.event_type = name and e.value > 50 group by 1""")
def usage_rollup(spark, d):
    e = read(spark, d, "events")
    registry = e.select(F.col("event_type").alias("name")).distinct().union(spark.createDataFrame([("never",)], "name string"))
    return X.usage_rollup(registry, e.where("value > 50").select(F.col("event_type").alias("skill"), F.col("ts").alias("fired_at")))


_QUEUE = "q as (select o_orderkey as id, case o_orderstatus when 'P' then 'pending' when 'O' then 'processing' else 'done' end as status, (o_orderkey % 4)::int as attempts, o_orderdate as claimed_at from orders)"


def _queue(spark, d):
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "processing").otherwise("done").alias("status"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempts"), F.col("o_orderdate").cast("timestamp").alias("claimed_at"), F.lit(None).cast("timestamp").alias("processed_at"),
    )


@query(f"""with {_QUEUE} select id, case when status <> 'processing' then status when id % 3 <> 0 then 'done' when attempts + 1 >= 3 then 'failed' else 'pending' end as status, case when status = 'processing' and id % 3 = 0 then attempts + 1 else attempts end as attempts,
    status = 'processing' as processed from q""")
def queue_finish(spark, d):
    q = _queue(spark, d)
    done = q.where("status = 'processing'").select("id", (F.col("id") % 3 != 0).alias("ok"))
    return X.finish(q, done, F.lit("2026-01-01").cast("timestamp")).select("id", "status", "attempts", F.col("processed_at").isNotNull().alias("processed"))


@query(f"""with {_QUEUE} select id, case when status = 'processing' and claimed_at < timestamp '2002-01-01' - interval 45 minute then 'pending' else status end as status, case when status = 'processing' and claimed_at < timestamp '2002-01-01' - interval 45 minute then null else claimed_at end as claimed_at from q""")
def queue_stale(spark, d):
    return X.release_stale(_queue(spark, d), F.lit("2002-01-01").cast("timestamp")).select("id", "status", F.col("claimed_at").cast("timestamp_ntz").alias("claimed_at"))


@query("""with p as (select c_custkey as id, c_name as pref, 1 + (c_custkey % 3)::int as assert_count from customer),
    c as (select o_custkey % 97 as id, count(*) filter (o_orderkey % 3 = 0) as re, count(*) filter (o_orderkey % 3 = 1) as mg, arg_max(o_orderstatus, o_orderkey) filter (o_orderkey % 3 = 1) as text, min(1000000 + o_orderkey) filter (o_orderkey % 3 = 2) as by_ from orders group by 1)
    select p.id, coalesce(c.text, p.pref) as pref, p.assert_count + coalesce(c.re + c.mg, 0)::int as assert_count, c.by_ as superseded_by, c.by_ is not null as closed from p left join c using (id)
    union all select 1000000 + o_orderkey, o_orderstatus, 1, null, false from orders where o_orderkey % 3 = 2""")
def preferences_applied(spark, d):
    c = read(spark, d, "customer")
    t = F.lit(None).cast("timestamp")
    prefs = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("pref"), F.lit("like").alias("polarity"), (1 + F.col("c_custkey") % 3).cast("int").alias("assert_count"), t.alias("last_asserted"), t.alias("t_invalid"), F.lit(None).cast("long").alias("superseded_by"))
    k = F.col("o_orderkey") % 3
    decided = read(spark, d, "orders").select(
        F.when(k == 0, "reassert").when(k == 1, "merge").otherwise("supersede").alias("action"), (F.col("o_custkey") % 97).alias("target_id"),
        F.when(k == 2, 1000000 + F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("id"), F.col("o_orderstatus").alias("pref"), F.lit("like").alias("polarity"),
    )
    out = X.apply_preferences(prefs, decided, F.lit("2026-01-01").cast("timestamp"))
    return out.select("id", "pref", "assert_count", "superseded_by", F.col("t_invalid").isNotNull().alias("closed"))


@query(f"""with {NOTES} select id, case when id % 8 = 2 then 'reference' else type end as type, case when id % 8 = 0 then 'new hook' else hook end as hook, case when id % 8 = 1 then 5000000 + id else superseded_by end as superseded_by,
        case when id % 8 in (0, 1) then timestamp '2026-06-01' else updated_at end as updated_at from n
    union all select 5000000 + id, 'user', 'new hook', null, timestamp '2026-06-01' from n where id % 8 in (1, 3)""")
def note_mutations(spark, d):
    n = _notes(spark, d)
    k = F.col("id") % 8
    decided = n.where(k <= 3).select(
        F.when(k == 0, "update").when(k == 1, "supersede").when(k == 2, "retype").otherwise("insert").alias("action"), F.when(k < 3, F.col("id")).alias("target_id"),
        (F.when((k == 1) | (k == 3), 5000000).otherwise(0) + F.col("id")).alias("id"), F.when(k == 2, "reference").otherwise("user").alias("type"), F.lit("new hook").alias("hook"), F.lit("new body").alias("body"),
    )
    return X.apply_notes(n, decided, F.lit("2026-06-01").cast("timestamp_ntz")).select("id", "type", "hook", "superseded_by", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query(f"""with {NOTES} select id, case when superseded_by in (select id from n where id % 5 <> 0) then superseded_by end as superseded_by from n where id % 5 <> 0""")
def dangling_cleared(spark, d):
    return X.clear_dangling(_notes(spark, d).where("id % 5 <> 0"), "superseded_by", "id").select("id", "superseded_by")


@query("""with c as (select * from chunks where id is not null qualify row_number() over (partition by id order by session_id) = 1), h as (select id, bool_or(e % 9 = 0) as hit, bool_or(e is null or e % 9 <> 0) as other from (select id, unnest(episode_ids) as e from c) group by 1)
    select count(*) as dropped, count(*) filter (other) as mixed from h where hit""")
def mixed_chunks(spark, d):
    c = read(spark, d, "chunks").where("id is not null").dropDuplicates(["id"])
    gone = read(spark, d, "episodes").where("id % 9 = 0").select(F.col("id").alias("episode_id"))
    extra = c.select(F.explode("episode_ids").alias("episode_id")).where("episode_id % 9 = 0")
    return X.drop_mixed_chunks(c, gone.union(extra))[1]


@query("""with r as (select o_custkey % 500 as id, count(*) as n, min(o_orderdate) as t from orders group by 1) select e.event_id as id, 1 + coalesce(r.n, 0)::int as reported_count, least(e.ts, r.t) as t_valid from events e left join r on r.id = e.event_id""")
def retold_events(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.lit(1).alias("reported_count"), F.col("ts").alias("t_valid"))
    return X.merge_retold(e, read(spark, d, "orders").select((F.col("o_custkey") % 500).alias("id"), F.col("o_orderdate").alias("t_valid")))


@query("""select session_id from (select 's' || user_id as session_id, arg_max(event_type <> 'view', (ts, event_id)) as p from events group by 1) where p union select 's' || c_custkey from customer where 's' || c_custkey not in (select 's' || user_id from events)""")
def private_sessions(spark, d):
    changes = read(spark, d, "events").select(F.concat(F.lit("s"), "user_id").alias("session_id"), (F.col("event_type") != "view").alias("private"), F.struct("ts", "event_id").alias("at"))
    return X.mark_private(read(spark, d, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("session_id")), changes)


@query(f"""with {V.EPISODES}, s as (select user_id as id, count(*) as n from events group by 1) select e.id, (coalesce(e.retrieval_count, 0) + coalesce(s.n, 0))::int as retrieval_count from episodes_ e left join s using (id)""")
def retrieval_counts(spark, d):
    return X.count_retrievals(V.episodes(spark, d), read(spark, d, "events").select(F.col("user_id").alias("id"))).select("id", "retrieval_count")


@query(f"""with {V.EDGES}, c as (select 's' || l_suppkey || '-p' || l_partkey || '-A' as uuid from lineitem where l_linenumber = 7 group by 1)
    select uuid, case when uuid in (select uuid from c) then timestamp '2026-01-01' else t_invalid end as t_invalid, case when uuid in (select uuid from c) then 'judge' else invalidated_by end as invalidated_by from edges
    union all select 'x' || n_nationkey, null, null from nation""")
def edges_written(spark, d):
    e = V.edges(spark, d)
    c = read(spark, d, "lineitem").where("l_linenumber = 7").select(F.concat(F.lit("s"), "l_suppkey", F.lit("-p"), "l_partkey", F.lit("-A")).alias("uuid")).distinct()
    c = c.select("uuid", F.lit(None).cast("timestamp_ntz").alias("at"), F.lit("judge").alias("by"))
    new = read(spark, d, "nation").select(F.concat(F.lit("x"), "n_nationkey").alias("uuid"))
    fresh = new.select(*(F.col("uuid") if k == "uuid" else F.lit(None).cast(e.schema[k].dataType).alias(k) for k in e.columns))
    return X.write_edges(e, fresh.union(e.limit(5)), c, F.lit("2026-01-01").cast("timestamp_ntz")).select("uuid", "t_invalid", "invalidated_by")


_SIMS = "s as (select o_custkey as new_id, 'u' || (o_orderkey % 40) as uuid, max((o_orderkey % 50) / 50.0) as sim from orders group by 1, 2)"


def _sims(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("new_id"), F.concat(F.lit("u"), F.col("o_orderkey") % 40).alias("uuid")).agg(F.max((F.col("o_orderkey") % 50) / 50.0).alias("sim"))


@query(f"""with {_SIMS}, g as (select new_id, list_sort(list(uuid) filter (sim >= 0.95)) as m, list_sort(list(uuid) filter (sim > 0.70 and sim < 0.95)) as y from s group by 1)
    select c_custkey as new_id, case when len(m) > 0 then 'skip' when len(y) > 0 then 'ask' else 'insert' end as action, coalesce(array_to_string(m, ','), '') as reinforce, case when coalesce(len(m), 0) > 0 then '' else coalesce(array_to_string(y, ','), '') end as ask
    from customer left join g on g.new_id = c_custkey""")
def gate_enforced(spark, d):
    new = read(spark, d, "customer").select(F.col("c_custkey").alias("new_id"))
    out = R.enforce_gate(new, _sims(spark, d))
    return out.select("new_id", "action", F.array_join("reinforce", ",").alias("reinforce"), F.array_join("ask", ",").alias("ask"))


@query(f"""with {_SIMS}, own as (select new_id, uuid, 'pair' as pool, sim from s where sim >= 0.9), near as (select new_id, uuid, 'semantic' as pool, sim from s where sim < 0.96 qualify row_number() over (partition by new_id order by sim desc, uuid) <= 8)
    select * from own union all select * from near where (new_id, uuid) not in (select (new_id, uuid) from own)""")
def pools(spark, d):
    s = _sims(spark, d)
    return R.candidate_pools(s.where("sim >= 0.9"), s.where("sim < 0.96").withColumn("rank", -F.col("sim")))


@query(f"""with {NOTES}, near as (select n.id, m.id as note_id, m.type, ((n.id * 7 + m.id * 3) % 100) / 100.0 as sim, case m.id % 3 when 0 then 'same' when 1 then 'contradicts' else 'distinct' end as verdict from n join n m on m.id = n.id - 1 or m.id = n.id - 2),
    b as (select near.id, arg_min(struct_pack(k := note_id, v := verdict), (-sim, note_id)) as b from near join n using (id) where sim >= 0.8 and near.type = n.type group by 1)
    select n.id, case b.b.v when 'same' then 'update' when 'contradicts' then 'supersede' else 'create' end as action, case when b.b.v in ('same', 'contradicts') then b.b.k end as target_id from n left join b using (id)""")
def note_reconciled(spark, d):
    n = _notes(spark, d).select("id", "type", "project")
    m = n.select(F.col("id").alias("note_id"), "type")
    near = n.select("id", F.explode(F.array(F.col("id") - 1, F.col("id") - 2)).alias("note_id")).join(m, "note_id").withColumn("sim", ((F.col("id") * 7 + F.col("note_id") * 3) % 100) / 100.0)
    near = near.withColumn("verdict", F.when(F.col("note_id") % 3 == 0, "same").when(F.col("note_id") % 3 == 1, "contradicts").otherwise("distinct"))
    return R.reconcile_note(n, near)


@query("""with e as (select (event_id % 60) as candidate_id, event_id as seq, (user_id % 20)::varchar as session_id, event_type as signal, 'g' as class, (ts::date)::varchar as scan_night, case when event_id % 2 = 0 then 0 else 1 end as fresh from events),
    f as (select * from e qualify row_number() over (partition by candidate_id, session_id, signal, class, scan_night order by fresh, seq) = 1) select candidate_id, seq, session_id, signal from f qualify row_number() over (partition by candidate_id order by fresh desc, seq desc) <= 60""")
def evidence_union(spark, d):
    e = read(spark, d, "events").select((F.col("event_id") % 60).alias("candidate_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 20).cast("string").alias("session_id"), F.col("event_type").alias("signal"), F.lit("g").alias("class"), F.to_date("ts").cast("string").alias("scan_night"))
    return R.union_evidence(e.where("seq % 2 = 0"), e.where("seq % 2 = 1")).select("candidate_id", "seq", "session_id", "signal")


@query("""select event_id as id, coalesce(case when event_id % 5 = 0 then null else value / 100 end >= 1.5, false) or (event_type = 'error' and event_id % 2 = 0) or (event_type = 'view' and (coalesce((event_id % 6) >= 4, false) or event_id % 4 >= 2)) as passes from events""")
def gate_passed(spark, d):
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "retune").when(F.col("event_type") == "view", "derive").otherwise("other")
    return read(spark, d, "events").select(i.alias("id"), R.passes_gate(kind, F.when(i % 5 != 0, F.col("value") / 100), i % 2 == 0, i % 6, i % 4).alias("passes"))


@query("""with l as (select l_suppkey as id, list(distinct 'o' || (l_orderkey % 30)) as sessions, list(distinct 't' || (l_partkey % 25)) as tokens from lineitem where l_linenumber = 6 group by 1), a as (select * from l where id % 2 = 0), b as (select * from l where id % 2 = 1),
    m as (select a.id, b.id as match, len(list_intersect(a.sessions, b.sessions)) as si, len(list_intersect(a.tokens, b.tokens)) as ti, len(a.sessions) + len(b.sessions) as sn, len(a.tokens) + len(b.tokens) as tn from a, b),
    j as (select id, match, si / (sn - si) as sj, ti / (tn - ti) as tj from m where si > 0 or ti > 0)
    select id, arg_min(match, (-greatest(sj, tj * 0.9), match)) as match from j where (sj >= 0.4 and tj >= 0.15) or tj >= 0.6 group by 1""")
def ledger_match(spark, d):
    l = read(spark, d, "lineitem").where("l_linenumber = 6").groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set(F.concat(F.lit("o"), F.col("l_orderkey") % 30)).alias("sessions"), F.collect_set(F.concat(F.lit("t"), F.col("l_partkey") % 25)).alias("tokens"))  # noqa: E741
    return R.match_candidates(l.where("id % 2 = 0"), l.where("id % 2 = 1"))


@query("""with t as (select unnest(['', 'other', 'Tool', 'Service', 'Library', 'Project', 'Product', 'Person', null]) as t), ok as (select * from (values ('Tool', 'Service'), ('Tool', 'Library'), ('Library', 'Service'), ('Project', 'Product')) v(x, y))
    select coalesce(a.t, '-') as a, coalesce(b.t, '-') as b, coalesce(a.t, '') in ('', 'other', 'Concept') or coalesce(b.t, '') in ('', 'other', 'Concept') or a.t = b.t or exists (select 1 from ok where (x = a.t and y = b.t) or (x = b.t and y = a.t)) as ok from t a, t b""")
def types_compatible(spark, d):
    kinds = [("",), ("other",), ("Tool",), ("Service",), ("Library",), ("Project",), ("Product",), ("Person",), (None,)]
    rows = [(x, y) for (x,) in kinds for (y,) in kinds]
    t = spark.createDataFrame(rows, "a string, b string")
    return t.select(F.coalesce("a", F.lit("-")).alias("a"), F.coalesce("b", F.lit("-")).alias("b"), R.type_compatible(F.col("a"), F.col("b")).alias("ok"))


@query("""with p as (select case lower(p_brand) when 'brand#11' then 'Brand#22' else p_brand end as name, p_name as summary from part) select name, arg_max(summary, (length(summary), summary)) as summary from p group by 1""")
def aliases_collapsed(spark, d):
    return R.collapse_aliases(read(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_name").alias("summary")), {"brand#11": "Brand#22"})


@query("""select o_orderkey as id, case when length(o_orderpriority) > length(o_orderstatus) then o_orderpriority else o_orderstatus end as summary from orders""")
def summary_merged(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), R.merge_summary(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("summary"))


@query("""select event_type as skill, count(*) as fired, count(*) filter (value > 80) as dismissed, coalesce((select count(*) from orders o where substring(o_orderpriority, 1, 1) = '1' and o_orderkey % 7 = 0 and not exists (select 1 from events x where x.event_type = e.event_type and x.user_id = o.o_custkey)), 0) * (event_type = 'error')::int as asked from events e group by 1""")
def fired_histogram(spark, d):
    fires = read(spark, d, "events").select(F.col("event_type").alias("skill"), F.col("user_id").alias("session_id"), (F.col("value") > 80).alias("dismissed"))
    asked = read(spark, d, "orders").where("substring(o_orderpriority, 1, 1) = '1' and o_orderkey % 7 = 0").select(F.lit("error").alias("skill"), F.col("o_custkey").alias("session_id"))
    return R.fired_histogram(fires, asked)


@query("""with w as (select user_id, event_id, event_type = 'signup' as u, sum((event_type = 'signup')::int) over (partition by user_id order by event_id) as n, first_value(event_type = 'signup') over (partition by user_id order by event_id) as f from events) select user_id, event_id, (case when f then n else n + 1 end)::int as turn from w""")
def turns_grouped(spark, d):
    return S.turn_groups(read(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "signup").select("user_id", "event_id", "turn")


@query("""with w as (select *, event_type = 'error' as ev, last_value(case when event_type = 'error' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as event_pos from events)
    select user_id, event_id, event_pos from w where not ev and event_pos is not null qualify row_number() over (partition by user_id, event_pos order by event_id) <= 3""")
def aftermath(spark, d):
    return S.aftermath(read(spark, d, "events"), F.col("event_type") == "error", 3, "user_id", "event_id").select("user_id", "event_id", "event_pos")


@query(f"""with {V.EPISODES}, t as (select session_id, max(sequence) as top from episodes_ where id % 2 = 0 group by 1) select e.id, (coalesce(t.top, 0) + row_number() over (partition by e.session_id order by e.id))::int as sequence from episodes_ e left join t using (session_id) where e.id % 2 = 1 and e.session_id is not null""")
def sequence_assigned(spark, d):
    e = V.episodes(spark, d).where("session_id is not null")
    return X.assign_sequence(e.where("id % 2 = 1").drop("sequence"), e.where("id % 2 = 0"), order="id").select("id", "sequence")


@query(f"""with {V.EPISODES}, m as (select session_id from episodes_ group by 1 having max(created_at) > timestamp '2026-03-01') select id from episodes_ where session_id in (select session_id from m)""")
def sessions_touched(spark, d):
    return M.touched_sessions(V.episodes(spark, d), F.lit("2026-03-01").cast("timestamp_ntz")).select("id")


@query("""with f as (select event_id as id, user_id, ts from events where event_type = 'error'), e as (select event_id as pos, user_id, ts from events where event_type = 'purchase') select f.id, arg_min(e.pos, (abs(epoch_us(f.ts) - epoch_us(e.ts)), e.pos)) as pos from f join e using (user_id) group by 1""")
def nearest_purchase(spark, d):
    e = read(spark, d, "events")
    return M.nearest_event(e.where("event_type = 'error'").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("at")), e.where("event_type = 'purchase'").select(F.col("event_id").alias("pos"), "user_id", "ts"), "user_id")


@query("""with c as (select 's' || s_suppkey as node, s_name as name, s_suppkey * 0.001 as distance, (select count(*) from (select distinct l_partkey from lineitem where l_suppkey = s_suppkey)) as degree from supplier), f as (select * from c where degree > 0 order by distance, node limit 8)
    select node, round(distance - case when name in ('Supplier#000000007', 'Supplier#000000003') then 0.3 else 0 end, 9) as adjusted, (row_number() over (order by round(distance - case when name in ('Supplier#000000007', 'Supplier#000000003') then 0.3 else 0 end, 9), node) - 1)::int as seed_rank from f""")
def seeds_picked(spark, d):
    deg = read(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("node")).agg(F.countDistinct("l_partkey").alias("degree"))
    c = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_name").alias("name"), (F.col("s_suppkey") * 0.001).alias("distance"))
    return G.pick_seeds(c, deg, ["Supplier#000000007", "Supplier#000000003"]).select("node", "adjusted", "seed_rank")


@query(f"""with {V.EDGES}, e as (select 's' || s_suppkey as uuid, s_name as name from supplier union all select 'p' || p_partkey, p_name from part where p_partkey % 3 <> 0) select g.uuid, a.name as src_name, b.name as tgt_name from edges g left join e a on a.uuid = g.src_uuid left join e b on b.uuid = g.tgt_uuid""")
def edges_named(spark, d):
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("uuid"), F.col("s_name").alias("name"))
    p = read(spark, d, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("uuid"), F.col("p_name").alias("name"))
    return G.with_names(V.edges(spark, d), s.union(p)).select("uuid", "src_name", "tgt_name")


@query("""with d as (select l_partkey as k, count(*) as degree from lineitem group by 1) select 'p' || p_partkey as uuid, p_name as name from part left join d on k = p_partkey where lower(p_name) like '%re%' order by degree desc nulls last, p_name, uuid limit 10""")
def typeahead(spark, d):
    deg = read(spark, d, "lineitem").groupBy(F.concat(F.lit("p"), "l_partkey").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    e = read(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("uuid"), F.col("p_name").alias("name"))
    return G.typeahead(e, deg, " Re ").select("uuid", "name")


@query(f"""with {V.EPISODES}, a as (select min(session_id) as s from episodes_) select id from episodes_ where session_id is null or session_id <> (select s from a)""")
def session_excluded(spark, d):
    e = V.episodes(spark, d)
    return K.self_excluded(e, "session_id", e.agg(F.min("session_id")).first()[0]).select("id")


@query("""select count(*) as n, false as estimated from lineitem""")
def count_exact(spark, d):
    return A.exact_count(read(spark, d, "lineitem"))


@query("""select o_custkey as k, bool_and(o_orderstatus <> 'F') as all_open, bool_or(o_totalprice > 300000) as any_large from orders group by 1""")
def all_open(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.bool_and(F.col("o_orderstatus") != "F").alias("all_open"), F.bool_or(F.col("o_totalprice") > 300000).alias("any_large"))


@query("""with u as (select user_id as k, 1 as tier, count(*) as n from events group by 1 union all select o_custkey, 2, count(*) from orders group by 1 union all select c_custkey, 3, 0 from customer) select k, min(tier) as tier, max(n) as n from u group by 1""")
def best_tiers(spark, d):
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("tier", F.lit(1))
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("tier", F.lit(2))
    return A.tiers([e, o, read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(3).alias("tier"), F.lit(0).cast("long").alias("n"))], ["k"])


@query("""select c_custkey as k, exists (select 1 from orders where o_custkey = c_custkey) or exists (select 1 from events where user_id = c_custkey) as known from customer""")
def known_customers(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return A.known_in(c, "k", read(spark, d, "orders").select(F.col("o_custkey").alias("k")), read(spark, d, "events").select(F.col("user_id").alias("k")))


@query(f"""with {V.EPISODES}, c as (select session_id, sequence, content from episodes_ union all select session_id, start_sequence, content from (select * from chunks qualify row_number() over (partition by id order by session_id) = 1)) select session_id, count(*) as n, count(distinct sequence) as places from c group by 1""")
def mining_corpus(spark, d):
    c = M.corpus(V.episodes(spark, d), read(spark, d, "chunks").dropDuplicates(["id"]))
    return c.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sequence").alias("places"))


@query("""with r as (select event_type as fp, user_id as session_id, ts as at_, case when event_id % 3 = 0 then null else 'a' || (event_id % 11) end as atom from events),
    x as (select fp, list_sort(list(distinct atom))[1:2] as l from r where atom is not null group by 1) select fp, count(distinct session_id) as sessions, count(*) as uses, min(at_) as first_at, array_to_string(any_value(l), ',') as examples from r left join x using (fp) group by 1""")
def occurrence_index(spark, d):
    i = F.col("event_id")
    rows = read(spark, d, "events").select(F.col("event_type").alias("fp"), F.col("user_id").alias("session_id"), F.col("ts").alias("at"), F.when(i % 3 != 0, F.concat(F.lit("a"), i % 11)).alias("atom"))
    return M.occurrences(rows).withColumn("examples", F.array_join("examples", ","))


@query("""select event_id as id, case when a = b then a else 'disagree' end as verdict from (select event_id, case event_id % 3 when 0 then 'duplicate' when 1 then 'contradicts' else 'distinct' end as a, case event_id % 5 when 0 then 'duplicate' when 1 then 'contradicts' else 'distinct' end as b from events)""")
def verdict_consensus(spark, d):
    v = lambda n: F.when(F.col("event_id") % n == 0, "duplicate").when(F.col("event_id") % n == 1, "contradicts").otherwise("distinct")
    return read(spark, d, "events").select(F.col("event_id").alias("id"), R.pair_verdict(v(3), v(5)).alias("verdict"))


@query(f"""with {V.EDGES} select uuid from edges where t_valid is null or t_valid <= timestamp '1999-06-01'""")
def facts_as_of(spark, d):
    return G.as_of(V.edges(spark, d), F.lit("1999-06-01").cast("timestamp_ntz")).select("uuid")


@query("""select o_orderkey as id, case when s is null or s < 0.85 then 'new' when s >= 0.95 then 'accept' else 'confirm' end as stage from (select o_orderkey, case when o_orderkey % 10 = 0 then null else (o_orderkey % 100) / 100.0 end as s from orders)""")
def vector_stage(spark, d):
    i = F.col("o_orderkey")
    return read(spark, d, "orders").select(i.alias("id"), R.vector_resolution(F.when(i % 10 != 0, (i % 100) / 100.0)).alias("stage"))


@query("""select l_orderkey as id from (select distinct l_orderkey, (l_orderkey % 9)::int as contradictions from lineitem) where contradictions >= 4""")
def saturated_facts(spark, d):
    return X.saturated(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") % 9).cast("int").alias("contradictions")).distinct(), 2)
