"""Dashboard analytics: series, histograms, feeds, gauges, digests, catalogues."""

from __future__ import annotations

import base64
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_series(df: DataFrame, ts: str, legs: dict[str, tuple[str, float]], unit: str = "hour") -> DataFrame:
    """Exact percentiles per time bucket: bucket, n, one column per leg (column, probability). Nulls and NaN ignored."""
    rows = df.withColumn("bucket", F.date_trunc(unit, ts))
    aggs = [F.expr(f"percentile_cont({p}) within group (order by case when isnan(cast({c} as double)) then null else cast({c} as double) end)").alias(n) for n, (c, p) in legs.items()]
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *aggs)


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin (0-based), n: all bins, with zeros; values below go to the first, values at or above the top to the last."""
    b = F.expr(f"width_bucket(cast({value} as double), {lo}D, {hi}D, {bins})")
    got = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.greatest(F.lit(0), F.least(F.lit(bins - 1), b - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def sparkline(df: DataFrame, ts: str, last_day: Column, days: int = 30) -> DataFrame:
    """day, n for exactly `days` days up to last_day, zeros filled in. last_day is a date of a one-row expression."""
    got = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last_day, days - 1), last_day)).alias("day"))
    return frame.join(got, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def gauge(df: DataFrame, status: str, states: list[str], by: list[str] | None = None) -> DataFrame:
    """One column per state with its count, in one pass."""
    aggs = [F.count_if(F.col(status) == s).alias(s) for s in states]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """The first k rows of each group; Spark prunes to k rows a group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_rn").drop("_rn")


def encode_cursor(ts: str, ident: str) -> str:
    return base64.urlsafe_b64encode(f"{ts}|{ident}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    ts, _, ident = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().rpartition("|")
    return ts, ident


def after(ts: Column, ident: Column, cursor_ts: Column, cursor_id: Column) -> Column:
    """Keyset predicate for (ts desc, id as text desc)."""
    return (ts < cursor_ts) | ((ts == cursor_ts) & (ident.cast("string") < cursor_id))


def feed(parts: list[DataFrame], limit: int, cursor: tuple[str, str] | None = None) -> DataFrame:
    """The newest `limit` rows of several kinds (kind, ts, id, text), ids compared as text.

    Each part is cut to `limit` on its own before the union, so the final sort sees a few pages at most.
    """
    order = [F.desc("ts"), F.desc("id")]
    cut = []
    for p in parts:
        p = p.select("kind", "ts", F.col("id").cast("string").alias("id"), "text")
        if cursor:
            p = p.where(after(F.col("ts"), F.col("id"), F.lit(cursor[0]).cast(p.schema["ts"].dataType), F.lit(cursor[1])))
        cut.append(p.orderBy(*order).limit(limit))
    return reduce(DataFrame.unionByName, cut).orderBy(*order).limit(limit)


def counted(df: DataFrame, col: str, untagged: str = "untagged") -> DataFrame:
    """Bucket counts of a column, null and '' as `untagged`."""
    return df.groupBy(F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(untagged)).alias(col)).agg(F.count(F.lit(1)).alias("n"))


def union_values(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct values of several columns."""
    return reduce(DataFrame.union, (d.select(F.col(c).alias("value")).where(F.col(c).isNotNull()) for d, c in parts)).distinct()


def window_seconds(spec: str, least: int = 3600, most: int = 30 * 86400) -> int:
    """7d, 48h, 90m or seconds, clamped to an hour and 30 days."""
    unit = {"d": 86400, "h": 3600, "m": 60, "s": 1}.get(spec[-1:].lower(), 1)
    number = spec[:-1] if spec[-1:].isalpha() else spec
    return max(least, min(most, int(float(number) * unit)))


def trim_board(lines: DataFrame, most_lines: int = 80, most_tokens: int = 2000) -> DataFrame:
    """Lines kept on a board: dropped by class (higher first), then oldest, until both limits hold.

    lines: id, class, ts, text. Kept are the best lines whose running count and tokens (a quarter of the characters)
    stay within the limits. The board is a page; the input is the output of top-k queries.
    """
    w = Window.orderBy("class", F.desc("ts"), "id").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.floor(F.length("text") / 4)
    return lines.withColumn("line", F.count(F.lit(1)).over(w)).withColumn("tokens", F.sum(cost).over(w)).where((F.col("line") <= most_lines) & (F.col("tokens") <= most_tokens))


def served_cost(df: DataFrame, *texts: str) -> DataFrame:
    """chars and est_tokens of what was served."""
    n = F.coalesce(F.sum(reduce(lambda a, b: a + b, (F.length(F.coalesce(F.col(t), F.lit(""))) for t in texts))), F.lit(0))
    return df.agg(n.alias("chars"), F.floor(n / 4).alias("est_tokens"))


def feedback_precision(feedback: DataFrame) -> DataFrame:
    """bucket, helpful, noise, precision: cited ids by their kind. feedback: helpful, noise (arrays of ids)."""
    one = lambda c, v: feedback.select(F.explode(c).alias("id"), F.lit(v).alias("good"))
    rows = one("helpful", 1).unionByName(one("noise", 0)).select(F.substring_index("id", ":", 1).alias("bucket"), "good")
    return rows.groupBy("bucket").agg(F.sum("good").alias("helpful"), F.sum(1 - F.col("good")).alias("noise"), F.round(F.avg("good"), 6).alias("precision"))


def exact_count(df: DataFrame) -> DataFrame:
    """n, estimated: counts come from file footers or one partial aggregate per task, so they are never estimated."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("estimated"))


def tiers(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """keys, tier, n over frames of (keys, tier, n): the best tier of each key and the largest n seen."""
    rows = parts[0].select(*keys, "tier", "n")
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*keys, "tier", "n"))
    return rows.groupBy(*keys).agg(F.min("tier").alias("tier"), F.max("n").alias("n"))


def known_in(rows: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows with `known`: whether their key is in any of the other frames (each of which has that column)."""
    out = rows
    for i, o in enumerate(others):
        out = out.join(o.select(key).distinct().withColumn(f"_k{i}", F.lit(True)), key, "left")
    marks = [F.col(f"_k{i}").isNotNull() for i in range(len(others))]
    any_ = marks[0] if marks else F.lit(False)
    for m in marks[1:]:
        any_ = any_ | m
    return out.withColumn("known", any_).select(*rows.columns, "known")
