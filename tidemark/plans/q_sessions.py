"""Sessions, windows and mining."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import mining as M
from tidemark.operators import sessionize as S
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.session import read

_WIN = f"""with {V.EPISODES}, r as (select session_id, sequence, id, content, project, row_number() over w as rn, count(*) over (partition by session_id order by sequence, id rows between current row and 3 following) as ahead,
        list(id) over (partition by session_id order by sequence, id rows between current row and 3 following) as ids, last_value(sequence) over (partition by session_id order by sequence, id rows between current row and 3 following) as end_sequence,
        list(nullif(content, '')) over (partition by session_id order by sequence, id rows between current row and 3 following) as texts
    from episodes_ window w as (partition by session_id order by sequence, id))"""


@query(f"""{_WIN} select session_id, sequence as start_sequence, end_sequence, list_aggregate(ids, 'string_agg', ',') as ids, md5(list_aggregate(list_filter(texts, lambda x: x is not null), 'string_agg', chr(10) || chr(10) || '---' || chr(10) || chr(10))) as content_md5
    from r where (rn - 1) % 3 = 0 and ahead = 4""")
def chunk_windows(spark, d):
    out = S.chunk_windows(V.episodes(spark, d))
    return out.select("session_id", "start_sequence", "end_sequence", F.array_join(F.col("episode_ids").cast("array<string>"), ",").alias("ids"), F.md5("content").alias("content_md5"))


@query(f"""with {V.EPISODES}, e as (select session_id, count(*) as episodes, max(sequence) as last from episodes_ group by 1), c as (select session_id, max(end_sequence) as chunked from chunks group by 1)
    select session_id, episodes, last, chunked from e left join c using (session_id) where (chunked is null and episodes >= 4) or last >= chunked + 3""")
def pending_windows(spark, d):
    return S.pending_windows(V.episodes(spark, d), read(spark, d, "chunks"))


@query(f"""with {V.EPISODES}, r as (select session_id, sequence, ((row_number() over (partition by session_id order by sequence, id) - 1) // 5)::int as segment from episodes_)
    select session_id, segment, count(*) as n, min(sequence) as first_sequence, max(sequence) as last_sequence from r group by 1, 2 having count(*) = 5""")
def tumbling_segments(spark, d):
    return S.segments(V.episodes(spark, d), 5)


@query("""with r as (select user_id, event_id, epoch_us(ts) // 60000000 as minute, value from events where event_type in ('error', 'click')),
    g as (select *, case when minute - lag(minute) over w > 600 or lag(minute) over w is null then 1 else 0 end as jump from r window w as (partition by user_id order by minute, event_id)),
    a as (select *, sum(jump) over (partition by user_id order by minute, event_id) as arc from g)
    select user_id, arc::bigint as arc, min(minute) as seq_min, max(minute) as seq_max, round(sum(value), 4) as score, count(*) as episodes from a group by 1, 2""")
def gap_arcs(spark, d):
    rows = read(spark, d, "events").where("event_type in ('error', 'click')").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).alias("minute"), "value")
    return S.gap_arcs(rows, ["user_id"], "minute", 600, "value", "event_id").withColumn("score", F.round("score", 4))


@query(f"""with {V.EPISODES}, r as (select session_id, sequence, id, lower(trim(coalesce(lead(human_turn) over (partition by session_id order by sequence, id), ''))) as next from episodes_)
    select session_id, sequence, id from r where len(list_filter(regexp_split_to_array(next, '\\s+'), lambda x: x <> '')) between 1 and 12 and regexp_matches(next, '{M.REJECT.replace("'", "''")}')""")
def lead_dismissal(spark, d):
    rows = V.episodes(spark, d).select("session_id", "sequence", "id", F.lead("human_turn").over(Window.partitionBy("session_id").orderBy("sequence", "id")).alias("next"))
    return rows.where(M.dismissed(F.col("next"))).select("session_id", "sequence", "id")


@query(f"""with {V.EPISODES} select session_id, count(nullif(human_turn, '')) as user_turns, left(arg_min(nullif(human_turn, ''), (sequence, id)) filter (where nullif(human_turn, '') is not null), 600) as first_user from episodes_ group by 1""")
def session_view(spark, d):
    return M.session_view(V.episodes(spark, d)).select("session_id", "user_turns", "first_user")


_MARK = lambda ms, w: " + ".join(f"(case when contains(t, '{m}') then {w} else 0 end)" for m in ms)


@query(f"""with {V.EPISODES}, r as (select id, sequence, regexp_replace(lower(coalesce(human_turn, '')), '[’'']', '', 'g') as t from episodes_),
    s as (select id, case when trim(t) = '' then 0 else {_MARK(M.HARD, 2)} + case when sequence > 1 and len(list_filter(regexp_split_to_array(trim(t), '\\s+'), lambda x: x <> '')) <= 80 then {_MARK(M.SOFT, 1)} else 0 end end as score from r)
    select id, score from s where score > 0""")
def correction_score(spark, d):
    rows = V.episodes(spark, d).select("id", M.correction_score(F.col("human_turn"), F.col("sequence")).alias("score"))
    return rows.where("score > 0")


@query("""with r as (select distinct user_id as session_id, (epoch_us(ts) // 3600000000) as pos, event_type as item from events)
    select least(x.item, y.item) as a, greatest(x.item, y.item) as b, count(distinct x.session_id) as sessions from r x join r y on x.session_id = y.session_id and y.pos - x.pos between 0 and 8 and x.item <> y.item group by 1, 2""")
def cooccurrence_pairs(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("session_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("pos"), F.col("event_type").alias("item"))
    return M.cooccurrence(rows, "session_id", "pos", "item")


@query(f"""with {V.EPISODES}, e as (select session_id, sequence, id, row_number() over (partition by session_id order by sequence, id) as rn from episodes_ where regexp_matches(lower(human_turn), '\\berror|fails\\b'))
    select o.session_id, e.sequence as around, o.id from e join episodes_ o on o.session_id = e.session_id and o.sequence between e.sequence - 2 and e.sequence + 2 where rn = 1""")
def neighbourhood(spark, d):
    eps = V.episodes(spark, d)
    hit = eps.where(F.lower("human_turn").rlike(r"\berror|fails\b"))
    anchors = hit.groupBy("session_id").agg(F.min(F.struct("sequence", "id")).alias("m")).select("session_id", F.col("m.sequence").alias("around"))
    return S.neighbourhood(eps, anchors, 2).select("session_id", "around", "id")


@query(f"""with {V.EPISODES} select id, has from (select id, regexp_matches(coalesce(human_turn, ''), '(?i)\\b(?:19|20)\\d{{2}}\\b|\\d{{1,2}}:\\d{{2}}|\\b(?:last|next|this|past) (?:week|month|day|year)s?\\b|\\b\\d+[-\\s]?(?:week|day|month|hour)s?\\b') as has from episodes_) where has""")
def duration_marker(spark, d):
    pat = r"(?i)\b(?:19|20)\d{2}\b|\d{1,2}:\d{2}|\b(?:last|next|this|past) (?:week|month|day|year)s?\b|\b\d+[-\s]?(?:week|day|month|hour)s?\b"
    return V.episodes(spark, d).select("id", F.coalesce("human_turn", F.lit("")).rlike(pat).alias("has")).where("has")


@query(None)
def temporal_marker(spark, d):
    return V.episodes(spark, d).select("id", T.has_temporal_marker(F.col("content")).alias("has")).where("has")


@query(f"with {V.EPISODES} select id from episodes_ where not ({' or '.join(f'''contains(lower(coalesce(content, '')), '{s}')''' for s in T.SIGNATURES)})")
def contamination_filter(spark, d):
    return V.episodes(spark, d).where(~T.contaminated(F.col("content"))).select("id")


@query("""with c as (select * from web_chunks qualify row_number() over (partition by id order by idx) = 1), l as (select id, content, regexp_extract_all(content, '!?\\[[^\\]]*\\]\\([^)]*\\)') as links from c)
    select id, round(case when coalesce(length(content), 0) = 0 then 0.0 else coalesce(list_sum(list_transform(links, lambda x: length(x))), 0) / length(content) end, 6) as density, length(content) >= 200 as big from l""")
def link_density(spark, d):
    rows = read(spark, d, "web_chunks").dropDuplicates(["id"])
    return rows.select("id", F.round(T.link_density(F.col("content")), 6).alias("density"), (F.length("content") >= 200).alias("big"))


@query("""with a as (select distinct url from web_artifacts where url is not null), p as (select url, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as s, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as h,
        regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as p, regexp_extract(trim(url), '^[^?#]*(\\?[^#]+)', 1) as q from a)
    select url, case when s = '' or h = '' then null else s || '://' || h || case when p = '' then '/' when length(p) > 1 then rtrim(p, '/') else p end || q end as canonical from p""")
def url_canonical(spark, d):
    rows = read(spark, d, "web_artifacts").where("url is not null").select("url").distinct()
    return rows.select("url", T.canonical_url(F.col("url")).alias("canonical"))


@query("""with i as (select distinct event_id, unnest(regexp_extract_all(lower('fix #' || (event_id % 90 + 10) || ' in ' || md5(event_type)), '#\\d{2,6}\\b|\\b[0-9a-f]{7,40}\\b')) as ident from events)
    select ident, count(*) as n from i group by 1""")
def ident_match(spark, d):
    fact = F.concat(F.lit("fix #"), F.col("event_id") % 90 + 10, F.lit(" in "), F.md5("event_type"))
    return read(spark, d, "events").select("event_id", F.explode(F.array_distinct(T.identifiers(fact))).alias("ident")).groupBy("ident").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def command_fingerprints(spark, d):
    return M.fingerprints(V.episodes(spark, d))


@query(f"with {V.EPISODES}, l as (select id, regexp_extract(regexp_replace(human_turn, '^\\s+|\\s+$', '', 'g'), '^([^\\r\\n]*)', 1) as t from episodes_ where human_turn is not null) select id, left(case when regexp_extract(t, '^(.*?[.!?])(?:\\s|$)', 1) = '' then t else regexp_extract(t, '^(.*?[.!?])(?:\\s|$)', 1) end, 120) as hook from l")
def derived_hook(spark, d):
    return V.episodes(spark, d).where("human_turn is not null").select("id", T.hook(F.col("human_turn")).alias("hook"))
