"""Resolution, deduplication, gates and mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vectors as Vc
from tidemark.operators import mutate as X
from tidemark.operators import resolve as R
from tidemark.operators import temporal as B
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.session import attach, read

NORM = "regexp_replace(regexp_replace(lower({0}), '\\s+', ' ', 'g'), '^[\\s.,;:!?\"''()\\[\\]{{}}<>]+|[\\s.,;:!?\"''()\\[\\]{{}}<>]+$', '', 'g')"


@query(f"""with {V.EPISODES}, a as (select *, case when span_id is null then 1 else row_number() over (partition by session_id, span_id order by id) end as ra from episodes_),
    b as (select *, case when content is null then 1 else row_number() over (partition by project, md5(content) order by id) end as rb from a where ra = 1) select id from b where rb = 1""")
def exact_dedup_md5(spark, d):
    return R.exact_dedup(V.episodes(spark, d)).select("id")


@query("""with a as (select * from web_artifacts qualify row_number() over (partition by id order by kind) = 1) select id from a where content_hash is null or id = (select min(b.id) from a b where b.content_hash = a.content_hash)""")
def canonical_hash_min(spark, d):
    return R.canonical_min(read(spark, d, "web_artifacts").dropDuplicates(["id"]), "content_hash", "id").select("id")


@query("""with c as (select * from web_chunks qualify row_number() over (partition by id order by idx) = 1), q as (select id from c where id % 3 = 0)
    select c.id from c where not exists (select 1 from q where q.id = c.id) and c.context_prefix is not null""")
def anti_enqueued(spark, d):
    c = read(spark, d, "web_chunks").dropDuplicates(["id"])
    queue = c.where("id % 3 = 0").select("id", F.lit("pending").alias("status"))
    return X.enqueue(queue, c.where("context_prefix is not null").select("id"), ["id"])


@query(f"select distinct p_name as name, {NORM.format('p_name')} as norm from part")
def normalized_names(spark, d):
    return read(spark, d, "part").select(F.col("p_name").alias("name")).distinct().select("name", T.normalized_name(F.col("name")).alias("norm"))


@query("""with n as (select distinct p_name as name, replace(lower(p_name), ' ', '') as s from part), c as (select name, length(s) as n, unnest(string_split(s, '')) as ch from n), k as (select name, n, ch, count(*) as k from c group by all)
    select name, round(-sum(k / n * log2(k / n)), 6) as entropy from k group by 1""")
def name_entropy(spark, d):
    return read(spark, d, "part").select(F.col("p_name").alias("name")).distinct().select("name", F.round(T.entropy(T.normalized_name(F.col("name"))), 6).alias("entropy"))


@query("""with n as (select distinct c_name as name, replace(regexp_replace(lower(c_name), '[^a-z0-9'' ]', ' ', 'g'), ' ', '') as s from customer),
    g as (select distinct name, substring(s, i::int, 3) as gram from n, lateral (select unnest(range(1, greatest(length(s) - 1, 2))) as i)) select name, count(*) as grams from g group by 1""")
def shingle_sets(spark, d):
    return read(spark, d, "customer").select(F.col("c_name").alias("name")).distinct().select("name", F.size(T.shingles(T.fuzzy_name(F.col("name")))).cast("long").alias("grams"))


_FUZZY = """with n as (select p_partkey as id, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9'' ]', ' ', 'g'), '\\s+', ' ', 'g')) as f from part), nn as (select p_partkey as id, regexp_replace(lower(p_name), '\\s+', ' ', 'g') as m from part), ch as (select id, length(replace(m, ' ', '')) as n, unnest(string_split(replace(m, ' ', ''), '')) as ch from nn),
    kk as (select id, n, ch, count(*) as k from ch group by all), en as (select id, -sum(k / n * log2(k / n)) as h from kk group by 1),
    c as (select f, min(id) as id from n join en using (id) join nn using (id) where h >= 2.0 and not (length(m) < 6 and m not like '% %') group by 1),
    g as (select distinct id, substring(replace(f, ' ', ''), i::int, 3) as t from c, lateral (select unnest(range(1, greatest(length(replace(f, ' ', '')) - 1, 2))) as i)),
    z as (select id, count(*) as n from g group by 1), p as (select x.id as a, y.id as b, count(*) as k from g x join g y on x.t = y.t and x.id < y.id group by 1, 2)
    select a, b, round(k / (za.n + zb.n - k), 6) as similarity from p join z za on za.id = a join z zb on zb.id = b where round(k / (za.n + zb.n - k), 6) >= 0.7"""


@query(_FUZZY)
def fuzzy_name_pairs(spark, d):
    return R.fuzzy_pairs(read(spark, d, "part"), "p_partkey", "p_name", 0.7)


@query("""with e as (select vec_id as id, embedding as v from embeddings) select a.id as a, b.id as b, round(list_cosine_similarity(a.v::double[], b.v::double[]), 6) as sim from e a join e b on a.id < b.id and round(list_cosine_similarity(a.v::double[], b.v::double[]), 6) >= 0.5""")
def vector_pairs(spark, d):
    return R.similar_pairs(read(spark, d, "embeddings"), "vec_id", "embedding", 0.5)


@query("""with e as (select vec_id as id, label, embedding::double[] as v, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as s from embeddings)
    select id, case when s >= 0.95 then 'merge' when s <= 0.70 then 'new' else 'gray' end as decision from e""")
def gate_decisions(spark, d):
    e = read(spark, d, "embeddings")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return attach(e, probe, "p").select(F.col("vec_id").alias("id"), B.gate(Vc.cosine(F.col("embedding"), F.col("p.q"))).alias("decision"))


@query("""with e as (select vec_id as id, label as owner, vec_id % 4 < 2 as likes, embedding::double[] as v from embeddings),
    m as (select n.id, n.likes, p.id as pref_id, p.likes as ol, list_cosine_similarity(n.v, p.v) as s, row_number() over (partition by n.id order by list_cosine_similarity(n.v, p.v) desc, p.id) as rn from e n join e p on p.owner = n.owner and p.id % 2 = 0 and n.id % 2 = 1)
    select e.id, case when s >= 0.3 then 'reassert' when s >= 0.2 and m.likes <> ol then 'supersede' when s >= 0.2 then 'confirm' else 'insert' end as action, case when s >= 0.2 then pref_id end as target_id from e left join m on m.id = e.id and rn = 1 where e.id % 2 = 1""")
def pref_action(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("owner"), F.when(F.col("vec_id") % 4 < 2, "like").otherwise("dislike").alias("polarity"), "embedding")
    new, old = e.where("id % 2 = 1"), e.where("id % 2 = 0").select(F.col("id").alias("pref_id"), "owner", F.col("polarity").alias("polarity_old"), F.col("embedding").alias("w"))
    # a new preference meets the live ones of its owner, a person's few
    pairs = new.select("id", "owner", "embedding").join(old, "owner")
    return B.pref_action(new, pairs, Vc.cosine(F.col("embedding"), F.col("w")), 0.3, 0.2)


@query(f"""with ev as (select (event_id % 50)::bigint as candidate_id, user_id::varchar as session_id, case when event_type in ('error', 'click') then 'grounded' else 'judge' end as class,
        case event_type when 'error' then 'reject' when 'click' then 'accept' else 'gap_scan' end as signal, (ts::date)::varchar as night from events)
    select candidate_id, count(distinct case when class = 'judge' then session_id end) as judge_sessions, count(distinct case when class = 'grounded' then session_id end) as grounded_sessions,
           coalesce(sum(case when class = 'judge' then 1.0 end), 0)::double as judge_weight, coalesce(sum(case when class = 'grounded' then case signal when 'accept' then 3.0 when 'reject' then -3.0 end end), 0)::double as grounded_weight,
           count(distinct night) as scan_nights, (coalesce(sum(case when class = 'grounded' then case signal when 'accept' then 3.0 when 'reject' then -3.0 end end), 0) + 0.5 * coalesce(sum(case when class = 'judge' then 1.0 end), 0))::double as score from ev group by 1""")
def evidence_rollup(spark, d):
    e = read(spark, d, "events").select(
        (F.col("event_id") % 50).alias("candidate_id"), F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_type").isin("error", "click"), "grounded").otherwise("judge").alias("class"),
        F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "click", "accept").otherwise("gap_scan").alias("signal"), F.to_date("ts").cast("string").alias("scan_night"), F.lit(None).cast("string").alias("quote"),
    )
    return R.evidence_rollup(e).drop("quoted")


@query("""select o_orderkey as id, case when o_orderstatus = 'O' and o_orderdate < timestamp '2002-01-01' - interval 28 day then 'retired' when o_orderstatus = 'O' then 'observe' else o_orderstatus end as status from orders""")
def ttl_decay(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "observe").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").cast("timestamp").alias("last"))
    return o.select("id", R.decayed(F.col("status"), F.col("last"), F.lit("2002-01-01 00:00:00").cast("timestamp")).alias("status"))


@query("""with old as (select c_custkey as k, c_name as name, c_acctbal as bal from customer where c_custkey % 3 <> 0), new as (select c_custkey as k, case when c_custkey % 2 = 0 then null else c_name || '*' end as name, c_acctbal + 1 as bal from customer where c_custkey % 5 = 0)
    select coalesce(o.k, n.k) as k, coalesce(n.name, o.name) as name, round(case when n.k is not null then n.bal else o.bal end, 4) as bal from old o full join new n on o.k = n.k""")
def upsert_versions(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.where("k % 5 = 0").select("k", F.when(F.col("k") % 2 != 0, F.concat("name", F.lit("*"))).alias("name"), (F.col("bal") + 1).alias("bal"))
    return X.upsert(c.where("k % 3 <> 0"), new, ["k"], keep=["name"]).withColumn("bal", F.round("bal", 4))


@query("""with t as (select event_id as id, 'episode' as kind, user_id as item_id, ts as at_, event_type in ('view', 'click') as f from events), r as (select *, row_number() over (partition by kind, item_id order by at_ desc, id desc) as rn from t) select kind, item_id from r where rn = 1 and f""")
def flags_live(spark, d):
    t = read(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("episode").alias("kind"), F.col("user_id").alias("item_id"), F.col("ts").alias("at"), F.col("event_type").isin("view", "click").alias("on"))
    return X.flags_now(t)


@query("""with n as (select * from notes qualify row_number() over (partition by id order by owner_id) = 1), m as (select id as note_a, created_at + interval 10 day as judged_at from n where id % 4 = 0)
    select n.id from n left join m on m.note_a = n.id where judged_at is null or judged_at < updated_at""")
def retype_memo(spark, d):
    n = read(spark, d, "notes").dropDuplicates(["id"])
    memo = n.where("id % 4 = 0").select(F.col("id").alias("note_a"), F.expr("created_at + interval 10 day").alias("judged_at"))
    return R.retype_due(n, memo).select("id")


@query("""with n as (select * from notes qualify row_number() over (partition by id order by owner_id) = 1) select id, type from n where type in ('user', 'feedback') or project = 'atlas-gateway'""")
def note_scope(spark, d):
    return read(spark, d, "notes").dropDuplicates(["id"]).where(T.note_scope(F.col("type"), F.col("project"), "atlas-gateway")).select("id", "type")


@query("""with s as (select o_orderkey as id, o_orderdate::date as turn, case o_orderkey % 4 when 0 then (o_orderdate::date + 1)::varchar when 1 then (o_orderdate::date - 800)::varchar when 2 then 'soon' else (o_orderdate::date - 30)::varchar end as said from orders)
    select id, case when said ~ '^\\d{4}-\\d{2}-\\d{2}$' and try_cast(said as date) <= turn + 1 and try_cast(said as date) >= turn - 730 then try_cast(said as date) else turn end as day from s""")
def event_dates(spark, d):
    turn = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, F.date_add(turn, 1).cast("string")).when(k == 1, F.date_sub(turn, 800).cast("string")).when(k == 2, "soon").otherwise(F.date_sub(turn, 30).cast("string"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.event_date(said, turn).alias("day"))


@query("""with q as (select o_orderkey as id, case o_orderstatus when 'P' then 'pending' when 'O' then 'processing' else 'done' end as status, left(o_orderpriority, 1)::int as priority, o_orderdate as enqueued_at from orders),
    c as (select id from q where status = 'pending' order by priority, enqueued_at, id limit 8) select id, case when id in (select id from c) then 'processing' else status end as status from q""")
def queue_claim(spark, d):
    q = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "processing").otherwise("done").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("enqueued_at"), F.lit(None).cast("timestamp").alias("claimed_at"))
    return X.claim(q, 8, F.lit("2026-01-01").cast("timestamp")).select("id", "status")


@query("""with e as (select event_id as id, user_id::varchar as project, ts, case when event_type = 'error' then 'fix #' || (event_id % 900 + 10) else '' end as fact from events where event_type = 'error'),
    i as (select *, regexp_extract(fact, '#\\d+') as ident from e) select a.id, b.id as match from i a join i b on a.ident = b.ident and a.id < b.id and a.project = b.project and abs(epoch(a.ts) - epoch(b.ts)) <= 2592000""")
def identifier_matches(spark, d):
    e = read(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("project"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("fix #"), F.col("event_id") % 900 + 10).alias("fact"))
    return R.identifier_matches(e, 720)


@query("""with e as (select v.vec_id as id, v.label::varchar as project, e.ts, v.embedding::double[] as v from embeddings v join events e on e.event_id = v.vec_id),
    m as (select a.id, b.id as match, round(list_cosine_similarity(a.v, b.v), 6) as sim from e a join e b on a.project = b.project and a.id <> b.id and abs(floor(epoch(a.ts)) - floor(epoch(b.ts))) <= 86400 where round(list_cosine_similarity(a.v, b.v), 6) > 0.1)
    select id, match, sim from m qualify row_number() over (partition by id order by sim desc, match) <= 3""")
def time_band_match(spark, d):
    e = read(spark, d, "embeddings").join(read(spark, d, "events"), F.col("vec_id") == F.col("event_id"))
    rows = e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("project"), F.col("ts").cast("timestamp").alias("ts"), F.col("embedding").alias("v"))
    return R.time_band_matches(rows, 1, 3, Vc.cosine(F.col("x"), F.col("y")), 0.1)
