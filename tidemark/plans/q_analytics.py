"""Dashboard analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import analytics as A
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.session import attach, read

NOW = "2026-09-01 00:00:00"


def _metrics(spark, d):
    return read(spark, d, "recall_metrics").dropDuplicates(["id"])


METRICS = "m as (select * from recall_metrics qualify row_number() over (partition by id order by kind) = 1)"


@query(f"""with {METRICS}, c as (select *, case when isnan(ms_total) then null else ms_total::double end as t, case when isnan(ms_rerank) then null else ms_rerank::double end as r from m)
    select date_trunc('hour', created_at) as bucket, count(*) as n, round(quantile_cont(t, 0.5), 3) as total_p50, round(quantile_cont(t, 0.95), 3) as total_p95, round(quantile_cont(r, 0.95), 3) as rerank_p95 from c
    where t is null or t < 'infinity'::double group by 1""")
def hourly_percentiles(spark, d):
    rows = _metrics(spark, d).where("ms_total is null or isnan(ms_total) or ms_total < double('infinity')")
    out = A.percentile_series(rows, "created_at", {"total_p50": ("ms_total", 0.5), "total_p95": ("ms_total", 0.95), "rerank_p95": ("ms_rerank", 0.95)})
    return out.select("bucket", "n", *(F.round(c, 3).alias(c) for c in ("total_p50", "total_p95", "rerank_p95")))


@query(f"""with {METRICS}, b as (select least(9, greatest(0, floor(rerank_top_score::double * 10)::int)) as bin from m where rerank_top_score is not null and not isnan(rerank_top_score))
    select r.range::int as bin, count(b.bin) as n from range(10) r left join b on b.bin = r.range group by 1""")
def score_histogram(spark, d):
    return A.histogram(_metrics(spark, d), "rerank_top_score", 0.0, 1.0, 10)


@query(f"""with {V.EPISODES}, days as (select unnest(generate_series(date '2026-06-01' - interval 29 day, date '2026-06-01', interval 1 day))::date as day)
    select day, count(e.id) as n from days left join episodes_ e on e.created_at::date = day group by 1""")
def daily_sparkline(spark, d):
    return A.sparkline(V.episodes(spark, d), "created_at", F.lit("2026-06-01").cast("date"))


@query("select o_orderpriority, count(*) filter (where o_orderstatus = 'O') as O, count(*) filter (where o_orderstatus = 'P') as P, count(*) filter (where o_orderstatus = 'F') as F from orders group by 1")
def queue_depth(spark, d):
    return A.gauge(read(spark, d, "orders"), "o_orderstatus", ["O", "P", "F"], ["o_orderpriority"])


@query("select date_trunc('hour', ts) as hour, count(*) as n, count(*) filter (where event_type = 'error') as failed from events group by 1")
def throughput_hourly(spark, d):
    return read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query(f"with {METRICS} select id, kind, round(ms_total::double, 3) as ms_total from m where not isnan(ms_total) and ms_total < 'infinity'::float order by ms_total desc, id limit 10")
def slowest_n(spark, d):
    rows = _metrics(spark, d).where("not isnan(ms_total) and ms_total < float('infinity')")
    return rows.orderBy(F.desc("ms_total"), "id").limit(10).select("id", "kind", F.round(F.col("ms_total").cast("double"), 3).alias("ms_total"))


@query("select event_id, ts, user_id from events where event_type = 'error' order by ts desc, event_id limit 20")
def failures_recent(spark, d):
    return read(spark, d, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "ts", "user_id")


@query(f"""with {V.EPISODES}, e as (select *, row_number() over (partition by project, created_at::date order by retrieval_count desc, created_at desc, id) as rn from episodes_)
    select project, created_at::date as day, rn, id from e where rn <= 3""")
def digest_top3_per_day(spark, d):
    rows = V.episodes(spark, d).withColumn("day", F.to_date("created_at"))
    top = A.top_per_group(rows, ["project", "day"], [F.desc_nulls_last("retrieval_count"), F.desc_nulls_last("created_at"), F.col("id")], 3)
    return top.select("project", "day", "rn", "id")


@query(f"with {V.EPISODES} select coalesce(nullif(project, ''), 'untagged') as project, count(*) as n from episodes_ group by 1")
def catalog_projects(spark, d):
    return A.counted(V.episodes(spark, d), "project")


@query("select group_id as value from notes where group_id is not null union select group_id from recall_metrics where group_id is not null union select platform from episodes where platform is not null")
def catalog_group_union(spark, d):
    return A.union_values([(read(spark, d, "notes"), "group_id"), (read(spark, d, "recall_metrics"), "group_id"), (read(spark, d, "episodes"), "platform")])


_FEED = f"""with {V.EPISODES}, n as (select * from notes qualify row_number() over (partition by id order by owner_id) = 1), w as (select * from web_artifacts qualify row_number() over (partition by id order by kind) = 1),
    f as (select 'episode' as kind, created_at as ts, id::varchar as id, left(human_turn, 40) as text from episodes_
          union all select 'note', created_at, id::varchar, left(hook, 40) from n union all select 'web', fetched_at, id::varchar, left(title, 40) from w)"""


def _feed_parts(spark, d):
    n, w = read(spark, d, "notes").dropDuplicates(["id"]), read(spark, d, "web_artifacts").dropDuplicates(["id"])
    part = lambda df, kind, ts, text: df.where(F.col(ts).isNotNull()).select(F.lit(kind).alias("kind"), F.col(ts).alias("ts"), "id", F.substring(text, 1, 40).alias("text"))
    return [part(V.episodes(spark, d), "episode", "created_at", "human_turn"), part(n, "note", "created_at", "hook"), part(w, "web", "fetched_at", "title")]


@query(f"{_FEED} select * from f where ts is not null order by ts desc, id desc limit 50")
def feed_page(spark, d):
    return A.feed(_feed_parts(spark, d), 50)


@query(f"{_FEED} select * from f where ts < timestamp '2026-05-01 12:00:00' or (ts = timestamp '2026-05-01 12:00:00' and id < '5') order by ts desc, id desc limit 50")
def keyset_timeline(spark, d):
    return A.feed(_feed_parts(spark, d), 50, ("2026-05-01 12:00:00", "5"))


@query(f"with {V.EPISODES} select session_id, id, sequence from episodes_ qualify row_number() over (partition by session_id order by created_at desc nulls last, id desc) = 1")
def distinct_on_session(spark, d):
    return A.distinct_on(V.episodes(spark, d), ["session_id"], [F.desc_nulls_last("created_at"), F.desc("id")]).select("session_id", "id", "sequence")


@query(f"""with {METRICS}, k as (select event_id as id, ts, event_type, value, user_id from events),
    r as (select *, row_number() over (order by case event_type when 'error' then 0 when 'purchase' then 1 else 2 end, ts desc, id rows unbounded preceding) as line from k)
    select id, line from r where line <= 80""")
def board_order(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2).alias("class"), "ts", F.lit("").alias("text"))
    top = rows.orderBy("class", F.desc("ts"), "id").limit(80)
    return A.trim_board(top).select("id", "line")


@query("select count(*) filter (where o_orderstatus = 'P') + (select count(*) from events where event_type = 'error') as pending from orders")
def pending_badge(spark, d):
    a = read(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "P").alias("a"))
    b = read(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("b"))
    return attach(a, b, "b").select((F.col("a") + F.col("b.b")).alias("pending"))


@query(f"with {METRICS} select kind, sum(coalesce(chars, 0))::bigint as chars, floor(sum(coalesce(chars, 0)) / 4)::bigint as est_tokens, count(*) filter (where rerank_top_score < 0.58 and rerank_top_score > 0) as would_abstain from m group by 1")
def served_tokens(spark, d):
    rows = _metrics(spark, d)
    return rows.groupBy("kind").agg(F.sum(F.coalesce("chars", F.lit(0))).alias("chars"), F.floor(F.sum(F.coalesce("chars", F.lit(0))) / 4).alias("est_tokens"), F.count_if((F.col("rerank_top_score") < 0.58) & (F.col("rerank_top_score") > 0)).alias("would_abstain"))


@query("""with f as (select case when event_type in ('view', 'click') then 'e' when event_type = 'error' then 't' else 'w' end as bucket, case when event_type in ('click', 'purchase') then 1 else 0 end as good from events)
    select bucket, sum(good)::bigint as helpful, sum(1 - good)::bigint as noise, round(avg(good), 6) as precision from f group by 1""")
def feedback_precision(spark, d):
    kind = F.when(F.col("event_type").isin("view", "click"), "e").when(F.col("event_type") == "error", "t").otherwise("w")
    cited = F.array(F.concat(kind, F.lit(":"), "event_id"))
    good = F.col("event_type").isin("click", "purchase")
    rows = read(spark, d, "events").select(F.when(good, cited).otherwise(F.array().cast("array<string>")).alias("helpful"), F.when(~good, cited).otherwise(F.array().cast("array<string>")).alias("noise"))
    return A.feedback_precision(rows)
