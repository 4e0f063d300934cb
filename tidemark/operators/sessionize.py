"""Turns, episodes, windows and arcs over ordered session rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\n\n---\n\n"


def turn_groups(records: DataFrame, session: str, pos: str, is_user_turn: Column) -> DataFrame:
    """Rows with turn (1-based): a new one at each real user text; rows before the first belong to turn 1."""
    w = Window.partitionBy(session).orderBy(pos)
    starts = F.sum(is_user_turn.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(is_user_turn).over(w)
    # a session that opens without a user text has its leading rows as a turn of their own
    return records.withColumn("turn", F.when(first, starts).otherwise(starts + 1).cast("int"))


def assemble_episodes(records: DataFrame, session: str = "session_id", pos: str = "pos", span: str = "jsonl:", cap: int = 3000, spoken: bool = False) -> DataFrame:
    """Episodes of grouped records: session_id, pos, turn, kind, text, tool, uuid, ts.

    Kinds: user, assistant, tool, result, title, attachments; other rows only bring their uuid and ts. Content is the
    tagged parts joined by blank lines: context (300 characters of the reply before), user and assistant (`cap`),
    tool (300), result (500; up to 20 characters dropped), title (200). The last uuid after the prefix `span` is the
    span; a repeated span keeps its first episode but uses up a sequence number. `spoken` drops turns without words.
    """
    kind, text = F.col("kind"), F.col("text")
    tag = lambda t, n: F.concat(F.lit(f"[{t}] "), F.substring(text, 1, n))
    part = (
        F.when(kind == "user", tag("user", cap))
        .when(kind == "assistant", tag("assistant", cap))
        .when(kind == "tool", F.concat(F.lit("[tool:"), F.coalesce("tool", F.lit("tool")), F.lit("] "), F.substring(text, 1, 300)))
        .when((kind == "result") & (F.length(text) > 20), tag("result", 500))
        .when(kind == "title", tag("title", 200))
        .when(kind == "attachments", F.concat(F.lit("[attachments] "), text))
    )
    first_user = F.row_number().over(Window.partitionBy(session, "turn", "kind").orderBy(pos)) == 1
    rows = records.withColumn("part", part).withColumn("_fu", first_user)
    rows = rows.withColumn("part", F.when((kind == "user") & ~F.col("_fu"), None).otherwise(F.col("part")))
    turns = rows.groupBy(session, "turn").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct(F.col(pos).alias("p"), "part")))), lambda x: x["part"]).alias("parts"),
        F.min_by(F.when((kind == "user") & (text != ""), F.substring(text, 1, 3000)), F.when(kind == "user", F.col(pos))).alias("human_turn"),
        F.max_by(F.when(kind == "assistant", text), F.when((kind == "assistant") & (text != ""), F.col(pos))).alias("assistant_turn"),
        F.max_by("uuid", F.when(F.col("uuid").isNotNull(), F.col(pos))).alias("uuid"),
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col(pos))).alias("created_at"),
    )
    w = Window.partitionBy(session).orderBy("turn")
    said = F.last("assistant_turn", ignorenulls=False).over(w.rowsBetween(-1, -1))
    turns = turns.withColumn("_prev", said).withColumn("sequence", F.row_number().over(w))
    turns = turns.withColumn("parts", F.when(F.coalesce(F.col("_prev"), F.lit("")) != "", F.concat(F.array(F.concat(F.lit("[context] "), F.substring(F.trim("_prev"), 1, 300))), "parts")).otherwise(F.col("parts")))
    if spoken:
        turns = turns.where("human_turn is not null or assistant_turn is not null")
    turns = turns.where(F.size("parts") > 0).withColumn("span_id", F.when(F.col("uuid").isNotNull(), F.concat(F.lit(span), "uuid")))
    again = F.row_number().over(Window.partitionBy(session, "span_id").orderBy("sequence"))
    turns = turns.withColumn("_again", F.when(F.col("span_id").isNull(), 1).otherwise(again)).where(F.col("_again") == 1)
    clean = lambda c: F.regexp_replace(c, "\x00", "")
    return turns.select(session, "sequence", clean("human_turn").alias("human_turn"), clean("assistant_turn").alias("assistant_turn"), clean(F.array_join("parts", "\n\n")).alias("content"), "span_id", "created_at")


def chunk_windows(episodes: DataFrame, size: int = 4, step: int = 3, existing: DataFrame | None = None) -> DataFrame:
    """Complete windows of `size` consecutive episodes every `step`: session_id, start_sequence, end_sequence,
    episode_ids, content, project (of the session's first episode). Blank contents are left out of the text; a window
    without any text, or already in `existing`, is none."""
    w = Window.partitionBy("session_id").orderBy("sequence", "id")
    ahead = w.rowsBetween(0, size - 1)
    rows = episodes.select("session_id", "sequence", "id", "project", "content")
    rows = rows.withColumn("rn", F.row_number().over(w)).withColumn("left", F.count(F.lit(1)).over(ahead)).withColumn("first_project", F.first("project").over(w))
    rows = rows.withColumn("episode_ids", F.collect_list("id").over(ahead)).withColumn("end_sequence", F.last("sequence").over(ahead))
    rows = rows.withColumn("texts", F.collect_list(F.when(F.col("content") != "", F.col("content"))).over(ahead))
    out = rows.where(((F.col("rn") - 1) % step == 0) & (F.col("left") == size)).select(
        "session_id", F.col("sequence").alias("start_sequence"), "end_sequence", "episode_ids", F.array_join("texts", SEPARATOR).alias("content"), F.col("first_project").alias("project")
    )
    out = out.where(F.trim(F.regexp_replace("content", r"\s+", "")) != "")
    return out if existing is None else out.join(existing.select("session_id", "start_sequence", "end_sequence"), ["session_id", "start_sequence", "end_sequence"], "left_anti")


def pending_windows(episodes: DataFrame, chunks: DataFrame, size: int = 4, step: int = 3) -> DataFrame:
    """Sessions with a window to build: no chunks and at least `size` episodes, or `step` more than the last chunk."""
    e = episodes.groupBy("session_id").agg(F.count(F.lit(1)).alias("episodes"), F.max("sequence").alias("last"))
    c = chunks.groupBy("session_id").agg(F.max("end_sequence").alias("chunked"))
    out = e.join(c, "session_id", "left")
    return out.where((F.col("chunked").isNull() & (F.col("episodes") >= size)) | (F.col("last") >= F.col("chunked") + step))


def segments(episodes: DataFrame, size: int = 25) -> DataFrame:
    """Complete tumbling segments: session_id, segment (0-based), first and last sequence; the tail is dropped."""
    rn = F.row_number().over(Window.partitionBy("session_id").orderBy("sequence", "id"))
    rows = episodes.select("session_id", "sequence", "id").withColumn("segment", F.floor((rn - 1) / size).cast("int"))
    return rows.groupBy("session_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence")).where(F.col("n") == size)


def gap_arcs(rows: DataFrame, key: list[str], pos: str, gap: int, score: str, tie: str) -> DataFrame:
    """Arcs of rows whose positions follow within `gap`: key, arc (1-based), seq_min, seq_max, score, episodes."""
    w = Window.partitionBy(*key).orderBy(pos, tie)
    jump = F.coalesce(F.col(pos) - F.lag(pos).over(w) > gap, F.lit(True)).cast("int")
    arcs = rows.withColumn("_new", jump).withColumn("arc", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return arcs.groupBy(*key, "arc").agg(F.min(pos).alias("seq_min"), F.max(pos).alias("seq_max"), F.sum(score).alias("score"), F.count(F.lit(1)).alias("episodes"))


def aftermath(rows: DataFrame, is_event: Column, n: int, session: str = "session_id", pos: str = "sequence") -> DataFrame:
    """For each event row the up to n rows after it, stopping before the next event: event_pos, then the row."""
    w = Window.partitionBy(session).orderBy(pos)
    last = F.last(F.when(is_event, F.col(pos)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_event", is_event).withColumn("event_pos", last).where(~F.col("_event") & F.col("event_pos").isNotNull())
    nth = F.row_number().over(Window.partitionBy(session, "event_pos").orderBy(pos))
    return rows.withColumn("nth", nth).where(F.col("nth") <= n).drop("_event")


def neighbourhood(episodes: DataFrame, anchors: DataFrame, radius: int = 3) -> DataFrame:
    """Episodes within `radius` (10 at most) sequences of each anchor (session_id, around)."""
    r = max(0, min(radius, 10))
    return episodes.join(anchors, "session_id").where(F.col("sequence").between(F.col("around") - r, F.col("around") + r))


def page(episodes: DataFrame, session_id: str, offset: int = 0, limit: int = 25) -> DataFrame:
    """A page of a session in order, 25 rows at most."""
    return episodes.where(F.col("session_id") == session_id).orderBy("sequence", "id").offset(max(0, offset)).limit(max(1, min(limit, 25)))


def pack(rows: DataFrame, key: str, order: str, size: Column, most_items: int = 1000, most_size: int = 100_000) -> DataFrame:
    """Greedy batches in order within a key: rows with batch (0-based). A batch has at least one item and otherwise
    at most most_items and most_size. A fold over the ordered group; keys are what bounds a task, so pack within
    partitions of the data, never the whole table under one key."""
    schema = rows.withColumn("_size", size.cast("long"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema) + ", batch int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        batch, n, total, got = 0, 0, 0, []
        for s in pdf["_size"].fillna(0):
            if n and (n >= most_items or total + s > most_size):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + s
            got.append(batch)
        return pdf.assign(batch=pd.Series(got, index=pdf.index, dtype="int32"))

    return schema.groupBy(key).applyInPandas(fold, out).drop("_size")


def plan_from_cursor(records: DataFrame, cursor: int, n: int) -> DataFrame:
    """Batches of about n records per file, cut only where a user turn begins: file, first, last, next_cursor.

    records: file, offset, is_user_turn. The last batch's cursor is the start of its last turn, which may still grow
    and so is shipped again.
    """
    rows = records.where(F.col("offset") >= cursor)

    def plan(batches: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        pdf = batches.sort_values("offset")
        starts = [int(o) for o, u in zip(pdf["offset"], pdf["is_user_turn"]) if u] or [int(pdf["offset"].iloc[0])]
        offs = [int(o) for o in pdf["offset"]]
        out, lo, count = [], offs[0], 0
        marks = set(starts)
        for o in offs:
            if o in marks and count >= n:
                out.append((lo, last, o))
                lo, count = o, 0
            last = o
            count += 1
        out.append((lo, offs[-1], starts[-1]))
        return pd.DataFrame([(pdf["file"].iloc[0], a, b, c) for a, b, c in out], columns=["file", "first", "last", "next_cursor"])

    return rows.groupBy("file").applyInPandas(plan, "file string, first long, last long, next_cursor long")
