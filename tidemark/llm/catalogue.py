"""Queries of this subpackage by name, and their SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import batches, conversations, encoding, mixing, percentiles, personal, residue, splitting, subjects, survivors
from tidemark.session import read

PROBS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.broken_sessions(read(spark, d, "episodes"))


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(read(spark, d, "episodes"))


def p1_fragments(spark: SparkSession, d: str) -> DataFrame:
    return conversations.fragments(read(spark, d, "episodes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(read(spark, d, "web_chunks"), read(spark, d, "chunks"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    texts = splitting.split_texts(read(spark, d, "web_chunks"), "id", "content", "char_start")
    return texts.where("n_pieces > 1").select("id", "piece", "n_pieces", "content", "char_start", "char_end", "page_start")


def p2_windows(spark: SparkSession, d: str) -> DataFrame:
    out = splitting.split_windows(read(spark, d, "chunks"), "id", "episode_ids", episodes=read(spark, d, "episodes")).where("n_pieces > 1")
    return out.withColumn("episode_ids", F.array_join(F.col("episode_ids").cast("array<string>"), ","))


def p6_fused(spark: SparkSession, d: str) -> DataFrame:
    return survivors.fused(read(spark, d, "notes"))


RESULTS = ("websearch", "exa_search_deep_researcher_start")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue({t: read(spark, d, t) for t in RESULTS}).select("result_table", "result_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.findings(read(spark, d, "episodes"), read(spark, d, "notes"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redactions(read(spark, d, "episodes"), read(spark, d, "notes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return batches.refusals(read(spark, d, "episodes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.suppliers(read(spark, d, "notes")).select("group_min_id", "field", "note_id")


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(read(spark, d, "notes"))


def _timings(spark: SparkSession, d: str) -> DataFrame:
    """One row per call and timing; a redelivered row counts once."""
    rows = read(spark, d, "recall_metrics").select("id", "created_at", "kind", "source", "ms_total", "ms_rerank").distinct()
    metric = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("ms")) for m in ("ms_total", "ms_rerank"))))
    return rows.select(F.to_date("created_at").alias("day"), "kind", "source", metric.alias("m")).select("day", "kind", "source", "m.metric", "m.ms").where("ms >= 0")


def p7_daily(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.sketch(_timings(spark, d), ["day", "kind", "source", "metric"], "ms")


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    keys = ["kind", "source", "metric"]
    out = percentiles.quantiles(percentiles.merge(p7_daily(spark, d), keys), keys, PROBS)
    return out.select(*keys, "n", *(F.round(p, 6).alias(p) for p in PROBS))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(read(spark, d, "documents"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.select(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = read(spark, d, "mix_targets")
    return mixing.shares(mixing.select(read(spark, d, "documents"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    parsed = subjects.parse(docs)
    model = subjects.train(docs, read(spark, d, "subjects"), read(spark, d, "subject_labels"), parsed=parsed)
    return subjects.assign(docs, model, parsed=parsed).select("doc_id", "subject")


def queries():
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}


def _p1_sql() -> str:
    c = conversations
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    blank, notice, transport = lit(c.BLANK), "|".join(c.NOTICES), "|".join(c.TRANSPORT)
    bracketed = lit(rf"^{c._OPEN} ?(?:{notice}|{transport}) ?[.!…]*{c._CLOSE}[.!]?$")
    naked = lit(c.NAKED)

    def missing(x: str) -> str:
        plain = f"trim(regexp_replace(coalesce({x}, ''), {blank}, ' ', 'g'))"
        low = f"lower({plain})"
        return (
            rf"({x} is null or not regexp_matches({plain}, '[\p{{L}}\p{{N}}\p{{So}}]') or (length(trim({x})) <= 400 and length({plain}) <= 200 and "
            rf"(regexp_matches({low}, {bracketed}) or regexp_matches({low}, {naked}) or (regexp_matches({low}, {lit(f'^(?:{transport})$')}) and not regexp_matches({low}, '^\d+$')))))"
        )

    squeezed = lambda x: f"regexp_replace(coalesce({x}, ''), {blank}, '', 'g')"
    return f"""
        with n as (
            select session_id, sequence, count(distinct {squeezed('human_turn')} || chr(1) || {squeezed('assistant_turn')}) as nodes,
                   bool_or({missing('human_turn')} or {missing('assistant_turn')}) as bad
            from episodes where session_id is not null group by 1, 2)
        select session_id from n group by 1
        having min(sequence) > 1 or max(sequence) - min(sequence) + 1 > count(sequence) or max(nodes) > 1 or bool_or(bad) or bool_or(sequence is null)"""


def oracle_sql():
    inv = repr(1.0 / math.log(1.01 / 0.99))
    g = repr((1 + percentiles.ALPHA) / (1 - percentiles.ALPHA))
    rows = """
        with r as (select distinct id, created_at, kind, source, ms_total, ms_rerank from recall_metrics),
        m as (select created_at::date as day, kind, source, 'ms_total' as metric, ms_total::double as ms from r
              union all select created_at::date, kind, source, 'ms_rerank', ms_rerank::double from r),
        v as (select *, case when ms = 0 then 0 else 1 end as sign, case when ms = 0 then 0 else ceil(ln(ms) * %s)::int end as bucket
              from m where ms is not null and not isnan(ms) and ms < 'infinity'::double and ms >= 0)""" % inv
    picks = ", ".join(f"round(min(case when cum > floor({p} * (n - 1)) then val end), 6) as {name}" for name, p in PROBS.items())
    return {
        "p1_found": _p1_sql(),
        "p2_found": """
            select distinct 'web_chunks' as item_table, id as item_id from web_chunks where length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) > 1500
            union all select distinct 'chunks', id from chunks where len(list_distinct(list_filter(episode_ids, lambda x: x is not null))) > 4""",
        "p2_windows": """
            with e as (select distinct id, list_filter(episode_ids, lambda x: x is not null) as l from chunks),
            d as (select distinct id, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: list_position(l, x[1]) = x[2]), lambda x: x[1]) as e from e),
            n as (select id, e, ceil((len(e) - 1) / 3.0)::int as n_pieces from d where len(e) > 4)
            select id, k::int as piece, n_pieces, list_aggregate(e[k * 3 + 1 : k * 3 + 4], 'string_agg', ',') as episode_ids from n, lateral (select unnest(range(n_pieces)) as k)""",
        "p7_daily": f"{rows} select day, kind, source, metric, sign, bucket, count(*) as n from v group by all",
        "p7_percentiles": f"""{rows},
            b as (select kind, source, metric, sign, bucket, count(*) as c from v group by all),
            w as (select *, sum(c) over (partition by kind, source, metric order by sign, bucket) as cum, sum(c) over (partition by kind, source, metric) as n,
                  case when sign = 0 then 0.0 else 2.0 * power({g}::double, bucket) / ({g}::double + 1) end as val from b)
            select kind, source, metric, max(n)::bigint as n, {picks} from w group by 1, 2, 3""",
    }
