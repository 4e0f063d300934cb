"""Structured Streaming: ingest of transcripts, chunks emitted once, change feed, gauge.

The store is at-least-once safe: every step is idempotent by natural keys, so a batch delivered again changes nothing.
Deduplication has no horizon, hence the store is asked in foreachBatch instead of growing state without bound; late
rows are never dropped and continue the numbering of their session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.mutate import assign_sequence
from tidemark.operators.resolve import exact_dedup
from tidemark.operators.sessionize import SEPARATOR
from tidemark.session import exists
from tidemark.sources.transcripts import session_episodes

EPISODE = "session_id string, sequence int, human_turn string, assistant_turn string, content string, span_id string, created_at timestamp, project string, id long"


def admit_episodes(new: DataFrame, stored: DataFrame, private: DataFrame | None = None) -> DataFrame:
    """Episodes to append: no contaminated content, no harness calls, no private sessions, no replays; numbered after
    what is stored. The same function serves backfills and streams."""
    rows = new.where(~T.contaminated(F.col("content")) & ~T.harness_call(F.col("content")))
    if private is not None:
        rows = rows.join(private.select("session_id"), "session_id", "left_anti")
    rows = rows.withColumn("id", F.xxhash64("session_id", F.coalesce("span_id", F.col("sequence").cast("string")), "content"))
    fresh = exact_dedup(rows, stored, order="sequence")
    return assign_sequence(fresh.withColumnRenamed("sequence", "pos"), stored, order="pos").drop("pos")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """What is stored; nothing only where the folder isn't there, so an unreadable store is an error and not an empty one."""
    return spark.read.schema(EPISODE).parquet(path) if exists(spark, path) else spark.createDataFrame([], EPISODE)


def ingest_batch(batch: DataFrame, store: str, private: DataFrame | None = None) -> None:
    """One micro-batch of whole transcript files (file, value) into the store."""
    spark = batch.sparkSession
    lines = batch.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "value")).where(F.trim("value") != "")
    new = session_episodes(lines).withColumn("project", F.lit(None).cast("string"))
    admit_episodes(new, _stored(spark, store), private).select(*(c.split()[0] for c in EPISODE.split(", "))).write.mode("append").parquet(store)


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str, private: DataFrame | None = None):
    """A query that takes transcript files as they appear. A file that grew is shipped whole; replays are no-ops."""
    files = spark.readStream.format("text").option("wholetext", "true").load(source).select(F.input_file_name().alias("file"), "value")
    return files.writeStream.foreachBatch(lambda df, _: ingest_batch(df, store, private)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHUNK = "session_id string, start_sequence int, end_sequence int, episode_ids array<long>, content string"


def chunk_stream(episodes: DataFrame, size: int = 4, step: int = 3) -> DataFrame:
    """Complete windows of a stream of episodes (session_id, sequence, id, content), each exactly once.

    The state of a session is its last episodes, fewer than a window, and the place of the last one taken: session length
    doesn't matter. An episode at or before that place was taken already or comes too late for its window, and is left out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, ids, texts, *upto = state.get if state.exists else ([], [], [], None, None)
        rows = pd.concat(list(batches)).drop_duplicates("id").sort_values(["sequence", "id"])
        done = set(ids)
        out = []
        for s, i, t in zip(rows["sequence"], rows["id"], rows["content"]):
            if int(i) in done or (upto[0] is not None and (int(s), int(i)) <= tuple(upto)):  # delivered again, or later than its window
                continue
            upto = [int(s), int(i)]
            seqs, ids, texts = [*seqs, int(s)], [*ids, int(i)], [*texts, t or ""]
            if len(ids) == size:
                text = SEPARATOR.join(x for x in texts if x)
                if text.strip():
                    out.append((key[0], seqs[0], seqs[-1], ids, text))
                seqs, ids, texts = seqs[step:], ids[step:], texts[step:]
        state.update((seqs, ids, texts, *upto))
        yield pd.DataFrame(out, columns=["session_id", "start_sequence", "end_sequence", "episode_ids", "content"])

    return episodes.groupBy("session_id").applyInPandasWithState(
        emit, CHUNK, "seqs array<int>, ids array<long>, texts array<string>, upto int, upto_id long", "append", GroupStateTimeout.NoTimeout
    )


def change_feed(rows: DataFrame, kind: str, ident: str, ts: str) -> DataFrame:
    """kind, id, ts of appended rows, from a stream or a batch: the payload of a notification."""
    return rows.select(F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("id"), F.col(ts).alias("ts"))


def resume(seen: int | None, oldest: int, newest: int) -> tuple[str, int]:
    """Where a reader of a bounded feed goes on: ('replay', first), ('reset', newest) if its place is gone or unknown."""
    if seen is None or seen > newest or seen + 1 < oldest:
        return "reset", newest
    return "replay", seen + 1


def queue_gauge(queue: DataFrame) -> DataFrame:
    """Depth by status; in a stream for complete mode."""
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def metrics_windows(rows: DataFrame, ts: str = "created_at", late: str = "1 hour") -> DataFrame:
    """Calls and errors per hour and kind. Only metrics have a watermark; memory tables never drop late rows."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("emb_ok")).alias("failed")).select(F.col("w.start").alias("hour"), "kind", "n", "failed")


def run(stream: DataFrame, into: Callable[[DataFrame, int], None], checkpoint: str):
    """All available input through foreachBatch, once."""
    return stream.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
