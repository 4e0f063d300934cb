"""Buckets, drill-down reads and the larger mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vectors as Vc
from tidemark.operators import mining as M
from tidemark.operators import mutate as X
from tidemark.plans import buckets as K
from tidemark.plans import endpoints as E
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.session import read

CHUNKS = "c as (select * from web_chunks qualify row_number() over (partition by id order by idx) = 1), a as (select * from web_artifacts qualify row_number() over (partition by id order by kind) = 1)"


def _web(spark, d):
    return read(spark, d, "web_chunks").dropDuplicates(["id"]), read(spark, d, "web_artifacts").dropDuplicates(["id"])


@query(f"with {V.EPISODES} select id, sequence from episodes_ where id in (3, 5, 7)")
def fetch_ids(spark, d):
    eps, notes = V.episodes(spark, d), read(spark, d, "notes").dropDuplicates(["id"])
    got, _, _ = K.fetch(eps, notes, ["e:5", 3, "7", "e:5", "x:1", True, "n:2"])
    return got.select("id", "sequence")


@query(f"""with {CHUNKS}, k as (select content_hash, min(id) as keep from a where content_hash is not null group by 1),
    x as (select c.id, c.content, coalesce(list_sum(list_transform(regexp_extract_all(c.content, '!?\\[[^\\]]*\\]\\([^)]*\\)'), lambda l: length(l))), 0) / nullif(length(c.content), 0) as dens from c join a on a.id = c.web_artifact_id left join k using (content_hash)
          where c.context_prefix is not null and a.kind in ('web_scrape', 'research_brief') and (content_hash is null or a.id = keep) and c.id % 7 <> 0)
    select count(*) as candidates, count(*) filter (where not (length(content) < 200) and not (dens > 0.6)) as enqueued, count(*) filter (where length(content) < 200) as skipped_too_small, count(*) filter (where not (length(content) < 200) and dens > 0.6) as skipped_link_density from x""")
def enqueue_web_chunks(spark, d):
    c, a = _web(spark, d)
    queue = c.where("id % 7 = 0").select(F.col("id").alias("web_chunk_id"))
    return X.enqueue_web_chunks(c.where("content is not null"), a, queue)[1]


@query(f"with {CHUNKS} select c.id, a.url, a.title from c join a on a.id = c.web_artifact_id")
def web_lineage(spark, d):
    c, a = _web(spark, d)
    return E.lineage(c, a).select("id", "url", "title")


@query(f"""with {V.EPISODES}, k as (select * from chunks qualify row_number() over (partition by id order by start_sequence) = 1), x as (select id, unnest(episode_ids) as e from k)
    select x.id, max(created_at) as valid_at from x join episodes_ on episodes_.id = x.e group by 1""")
def segment_time(spark, d):
    return E.segment_time(V.episodes(spark, d), read(spark, d, "chunks").dropDuplicates(["id"]))


@query("""with n as (select * from notes qualify row_number() over (partition by id order by owner_id) = 1) select source_ref, id from n where source_ref is not null qualify row_number() over (partition by source_ref order by updated_at desc nulls last, id desc) = 1""")
def note_by_source(spark, d):
    return E.latest_by_ref(read(spark, d, "notes").dropDuplicates(["id"])).select("source_ref", "id")


@query("""with p as (select event_id as id, 'git:' || user_id as source, (event_id % 400)::varchar as source_ref, ts as t_valid, event_type as fact, case when event_id % 3 = 0 then 2 end as salience, case when event_id % 5 = 0 then 'personal' end as domain from events),
    f as (select * from p qualify row_number() over (partition by source, source_ref order by t_valid, fact) = 1)
    select source, source_ref, coalesce(salience, 1) as salience, coalesce(domain, 'technical') as domain from f where not (source_ref = '7')""")
def push_events(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("git:"), "user_id").alias("source"), (F.col("event_id") % 400).cast("string").alias("source_ref"), F.col("ts").alias("t_valid"), F.col("event_type").alias("fact"), F.when(F.col("event_id") % 3 == 0, 2).alias("salience"), F.when(F.col("event_id") % 5 == 0, "personal").alias("domain"))
    stored = e.where("source_ref = '7'").select("source", "source_ref").distinct()
    return X.push_events(stored, e).select("source", "source_ref", "salience", "domain")


@query("""with n as (select * from notes qualify row_number() over (partition by id order by owner_id) = 1), t as (select id, coalesce(hook, '') || chr(10) || coalesce(body, '') as t, lower(coalesce(project, '')) as p from n)
    select id, case when regexp_matches(t, '(?i)\\b(book|movie|doctor|gym|sleep|diet|insurance|birthday)\\b') then 'personal' when regexp_matches(t, '(?i)\\b(python|docker|redis|kafka|async)\\b') then 'technical' else 'technical' end as g
    from t where not regexp_matches(t, '(?i)\\b(family|sister|brother|mom|mother|dad|father|parent|cousin|uncle|aunt|nephew|niece|girlfriend|boyfriend|wife|husband|partner|spouse|dating|dated|friend|friends|cottage|vacation|holiday|wedding|dentist|appointment|medication|drinking|exercise|novel|film|recruiter|hiring|interview)\\b')""")
def group_routing(spark, d):
    n = read(spark, d, "notes").dropDuplicates(["id"])
    t = F.concat_ws("\n", F.coalesce("hook", F.lit("")), F.coalesce("body", F.lit("")))
    rare = r"(?i)\b(family|sister|brother|mom|mother|dad|father|parent|cousin|uncle|aunt|nephew|niece|girlfriend|boyfriend|wife|husband|partner|spouse|dating|dated|friend|friends|cottage|vacation|holiday|wedding|dentist|appointment|medication|drinking|exercise|novel|film|recruiter|hiring|interview)\b"
    return n.where(~t.rlike(rare)).select("id", T.group_of(F.coalesce("hook", F.lit("")), F.col("body"), F.lit(None).cast("string")).alias("g"))


@query(None)
def fire_events(spark, d):
    return M.fire_events(V.episodes(spark, d))


@query(None)
def web_bucket(spark, d):
    c, _ = _web(spark, d)
    return K.web_bucket(c.where("content is not null"), "compost heap", None, floor=0.5)


@query(None)
def notes_bucket(spark, d):
    n = read(spark, d, "notes").dropDuplicates(["id"])
    return K.notes_bucket(n, "dashboard port", [F.desc(F.col("hook").contains("dashboard"))], "atlas-gateway", floor=0.5)


@query(None)
def kg_facts(spark, d):
    emb = read(spark, d, "embeddings")
    probe = Vc.literal(list(emb.where("vec_id = 7").select("embedding").first()[0])) if not emb.where("vec_id = 7").isEmpty() else Vc.literal([0.0] * 64)
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name")
    vec = emb.select(F.col("vec_id").alias("k"), "embedding")
    e = V.edges(spark, d).withColumn("k", F.substring("tgt_uuid", 2, 20).cast("long")).join(parts, "k").join(vec, "k", "left").withColumnRenamed("p_name", "fact")
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("uuid"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")).join(vec, "k")
    return K.kg_facts(e, s, "red widget", probe, ["Supplier#000000003"]).select("uuid", "fact", "t_valid", "rank")


@query(None)
def passages(spark, d):
    eps = V.episodes(spark, d)
    from tidemark.operators.ranking import bm25

    top = bm25(eps, "id", "content", "compost heap", 20)
    return K.passages(eps.join(top.select("id", "rank"), "id"), "compost heap")


@query(f"""with {V.EDGES}, v as (select vec_id, embedding::double[] as v from embeddings), n as (select uuid, src_uuid, tgt_uuid, cast(src_uuid[2:] as int) % 100 as k from edges where t_invalid is null),
    x as (select n.*, v from n left join v on v.vec_id = n.k and n.k % 10 <> 0),
    m as (select a.uuid as new_uuid, b.uuid, case when b.v is null then 1.0 when a.v is null then null else round(list_cosine_similarity(a.v, b.v), 6) end as sim from x a join x b on a.src_uuid = b.src_uuid and a.tgt_uuid = b.tgt_uuid and a.uuid <> b.uuid)
    select new_uuid, uuid, sim from m where sim >= 0.2 qualify row_number() over (partition by new_uuid order by sim desc, uuid) <= 5""")
def contradiction_candidates(spark, d):
    live = V.edges(spark, d).where("t_invalid is null").withColumn("k", F.substring("src_uuid", 2, 20).cast("int") % 100)
    e = live.join(read(spark, d, "embeddings").select(F.col("vec_id").alias("k"), "embedding"), "k", "left").withColumn("embedding", F.when(F.col("k") % 10 != 0, F.col("embedding")))
    return K.contradictions(e, e, 0.2)
