"""Mutations as functions: old table and delta in, new table out. Plain Parquet has no row-level updates, so a caller
writes the result as a new version. Every one is idempotent: applied twice it gives the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(delta: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key of a delta, the last by order."""
    return delta.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, delta: DataFrame, keys: list[str], keep: list[str] | None = None, fixed: list[str] | None = None) -> DataFrame:
    """Old rows with those of the delta; columns in `keep` change only to a value, those in `fixed` never."""
    keep, fixed = set(keep or []), set(fixed or [])
    o, d = old.alias("o"), delta.withColumn("_new", F.lit(True)).alias("d")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    cols = []
    for c in old.columns:
        was, now = F.col(f"o.{c}"), F.col(f"d.{c}") if c in delta.columns else F.col(f"o.{c}")
        inserted = F.col("_new").isNotNull() & F.col("_old").isNull()
        if c in keys or c in keep:
            v = F.coalesce(now, was)
        elif c in fixed:
            v = F.when(inserted, now).otherwise(was)
        else:
            v = F.when(F.col("_new").isNotNull(), now).otherwise(was)
        cols.append(v.alias(c))
    return old.withColumn("_old", F.lit(True)).alias("o").join(d, on, "full_outer").select(*cols)


def insert_ignore(old: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Old rows and the first of each new key."""
    fresh = last_of(delta, keys, [F.col(c) for c in order]).join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def changed(old: DataFrame, delta: DataFrame, keys: list[str], hashed: str) -> DataFrame:
    """Delta rows that are new or whose hash differs."""
    was = old.select(*keys, F.col(hashed).alias("_was"))
    return delta.join(was, keys, "left").where(~F.col("_was").eqNullSafe(F.col(hashed))).drop("_was")


def history(old: DataFrame, new: DataFrame, key: str, body: str, now: Column) -> DataFrame:
    """Old images of rows whose body changed or that are gone: key, body, op, at."""
    n = new.select(key, F.col(body).alias("_b"), F.lit(True).alias("_there"))
    out = old.join(n, key, "left").where(F.col("_there").isNull() | ~F.col(body).eqNullSafe(F.col("_b")))
    return out.select(key, body, F.when(F.col("_there").isNull(), "delete").otherwise("update").alias("op"), now.alias("at"))


def replace_children(old: DataFrame, delta: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in the delta replaced by the delta's. A parent without children in the delta keeps its own."""
    return old.join(delta.select(parent).distinct(), parent, "left_anti").unionByName(delta.select(*old.columns))


def reset_if_changed(old: DataFrame, delta: DataFrame, keys: list[str], watched: str, reset: str) -> DataFrame:
    """upsert() in which a row whose `watched` column changes loses its `reset` column (a derived value, now stale)."""
    was = old.select(*keys, F.col(watched).alias("_was"), F.col(reset).alias("_had"))
    same = F.col("_was").eqNullSafe(F.col(watched))
    kind = old.schema[reset].dataType
    return upsert(old, delta.join(was, keys, "left").withColumn(reset, F.when(same, F.col("_had")).otherwise(F.lit(None).cast(kind))).drop("_was", "_had"), keys)


def apply_notes(notes: DataFrame, decided: DataFrame, now: Column) -> DataFrame:
    """Notes after decisions (action, target_id, id, type, hook, body): insert; update (hook and body in place); supersede
    (the target points to the new note, which is inserted); retype (type only, updated_at as it was). One decision per
    target and action counts, the last by id; decisions on notes that aren't there do nothing. Applied twice it is the same."""
    last = lambda action: decided.where(F.col("action") == action).groupBy(F.col("target_id").alias("id")).agg(F.max_by(F.struct("id", "type", "hook", "body"), "id").alias(f"_{action}"))
    out = notes
    for action in ("update", "supersede", "retype"):
        out = out.join(last(action), "id", "left")
    u, s, r = F.col("_update"), F.col("_supersede"), F.col("_retype")
    touched = u.isNotNull() | s.isNotNull()
    new = {
        "hook": F.when(u.isNotNull(), u["hook"]).otherwise(F.col("hook")), "body": F.when(u.isNotNull(), u["body"]).otherwise(F.col("body")), "type": F.coalesce(r["type"], F.col("type")),
        "superseded_by": F.coalesce(s["id"], F.col("superseded_by")), "updated_at": F.when(touched, now.cast(notes.schema["updated_at"].dataType)).otherwise(F.col("updated_at")),
    }
    out = out.select(*(new.get(c, F.col(c)).alias(c) for c in notes.columns))
    fresh = decided.where("action in ('insert', 'supersede')").dropDuplicates(["id"]).join(notes.select("id"), "id", "left_anti")
    have = {"id": F.col("id"), "type": F.col("type"), "hook": F.col("hook"), "body": F.col("body"), "created_at": now, "updated_at": now}
    return out.unionByName(fresh.select(*((have[c] if c in have else F.lit(None)).cast(notes.schema[c].dataType).alias(c) for c in notes.columns)))


def mark_private(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Private sessions after changes (session_id, private, at): the last change of a session decides."""
    last = changes.groupBy("session_id").agg(F.max_by("private", "at").alias("_p"))
    kept = sessions.select("session_id").distinct().join(last, "session_id", "left").where("coalesce(_p, true)").select("session_id")
    return kept.union(last.where("_p").select("session_id")).distinct()


def count_retrievals(episodes: DataFrame, served: DataFrame) -> DataFrame:
    """Episodes with retrieval_count raised by how often each was served (id, one row per serving); served ids that aren't
    stored change nothing. Summed before the join, so an episode served by every query is one row."""
    n = served.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return episodes.join(n, "id", "left").withColumn("retrieval_count", (F.coalesce("retrieval_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast(episodes.schema["retrieval_count"].dataType)).drop("_n")


def watermark(old: Column, new: Column) -> Column:
    """A mark that only rises."""
    return F.greatest(old, new)


def unlink(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without the sources in gone (episode_id): dropped if they had no other, else unlinked."""
    src = edges.select("uuid", F.explode("episodes").alias("episode_id"))
    left = src.join(gone.select("episode_id").distinct(), "episode_id", "left_anti").groupBy("uuid").agg(F.sort_array(F.collect_set("episode_id")).alias("_left"))
    out = edges.join(left, "uuid", "left").where((F.size("episodes") == 0) | F.col("_left").isNotNull())
    return out.withColumn("episodes", F.when(F.size("episodes") == 0, F.col("episodes")).otherwise(F.filter("episodes", lambda x: F.array_contains(F.col("_left"), x)))).select(*edges.columns)


def clear_dangling(rows: DataFrame, pointer: str, ident: str) -> DataFrame:
    """Rows with pointers to missing rows set to null."""
    there = rows.select(F.col(ident).alias("_t")).distinct()
    out = rows.join(there, F.col(pointer) == F.col("_t"), "left").withColumn(pointer, F.col("_t"))
    return out.select(*rows.columns)


def drop_mixed_chunks(chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks without any source in gone, one row with how many were dropped and how many of them had other sources)."""
    g = gone.select("episode_id").distinct().withColumn("_g", F.lit(True))
    hit = chunks.select("id", F.explode("episode_ids").alias("episode_id")).join(g, "episode_id", "left").groupBy("id").agg(F.max(F.col("_g").isNotNull()).alias("hit"), F.max(F.col("_g").isNull()).alias("other"))
    kept = chunks.join(hit.where("hit").select("id"), "id", "left_anti")
    return kept, hit.where("hit").agg(F.count(F.lit(1)).alias("dropped"), F.count_if("other").alias("mixed"))


def flags_now(events: DataFrame) -> DataFrame:
    """kind, item_id of flags that are on: the latest toggle of each decides."""
    return last_of(events, ["kind", "item_id"], [F.desc("at"), F.desc("id")]).where("on").select("kind", "item_id")


def assign_sequence(new: DataFrame, stored: DataFrame, session: str = "session_id", order: str = "pos") -> DataFrame:
    """New rows numbered after the largest stored sequence of their session."""
    top = stored.groupBy(session).agg(F.max("sequence").alias("_top"))
    nth = F.row_number().over(Window.partitionBy(session).orderBy(order))
    return new.join(top, session, "left").withColumn("sequence", (F.coalesce("_top", F.lit(0)) + nth).cast("int")).drop("_top")


def enqueue(queue: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose key isn't among live entries (pending or processing) of the queue."""
    live = queue.where(F.col("status").isin("pending", "processing")).select(*keys).distinct()
    return items.join(live, keys, "left_anti").dropDuplicates(keys)


def claim(queue: DataFrame, n: int, now: Column) -> DataFrame:
    """The queue with its first n pending items (priority, then age) claimed. The n ids are a top-k, joined back."""
    ids = queue.where("status = 'pending'").orderBy("priority", "enqueued_at", "id").limit(n).select("id", F.lit(True).alias("_c"))
    out = queue.join(F.broadcast(ids), "id", "left")
    return out.withColumn("status", F.when(F.col("_c"), "processing").otherwise(F.col("status"))).withColumn("claimed_at", F.when(F.col("_c"), now).otherwise(F.col("claimed_at"))).select(*queue.columns)


def finish(queue: DataFrame, done: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """Outcomes (id, ok): done, or failed attempts put back until there were `most`."""
    d = done.groupBy("id").agg(F.max("ok").alias("_ok"))
    out = queue.join(d, "id", "left").withColumn("attempts", F.col("attempts") + F.when(F.col("_ok") == F.lit(False), 1).otherwise(0))
    st = F.when(F.col("_ok"), "done").when(F.col("_ok") == F.lit(False), F.when(F.col("attempts") >= most, "failed").otherwise("pending")).otherwise(F.col("status"))
    return out.withColumn("status", st).withColumn("processed_at", F.when(F.col("_ok").isNotNull(), now).otherwise(F.col("processed_at"))).select(*queue.columns)


def release_stale(queue: DataFrame, now: Column, minutes: int = 45) -> DataFrame:
    """Claims older than the limit back to pending."""
    old = (F.col("status") == "processing") & (F.col("claimed_at") < now - F.make_interval(mins=F.lit(minutes)))
    fresh = {"claimed_at": F.when(~old | old.isNull(), F.col("claimed_at")), "status": F.when(old, "pending").otherwise(F.col("status"))}
    return queue.select(*(fresh[c].alias(c) if c in fresh else F.col(c) for c in queue.columns))


def usage_rollup(registry: DataFrame, fired: DataFrame) -> DataFrame:
    """Registry rows with fire_count and last_fired from the log (skill, fired_at)."""
    r = fired.groupBy(F.col("skill").alias("name")).agg(F.count(F.lit(1)).alias("fire_count"), F.max("fired_at").alias("last_fired"))
    return registry.drop("fire_count", "last_fired").join(r, "name", "left").withColumn("fire_count", F.coalesce("fire_count", F.lit(0)))


def apply_preferences(prefs: DataFrame, decided: DataFrame, now: Column) -> DataFrame:
    """Preferences after decisions (action, target_id, id, pref, polarity): reasserted, merged (reasserted under the newest
    wording), superseded and linked, inserted."""
    r = decided.where("action in ('reassert', 'merge')").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    s = decided.where("action = 'supersede'").groupBy(F.col("target_id").alias("id")).agg(F.min("id").alias("_by"))
    m = decided.where("action = 'merge'").groupBy(F.col("target_id").alias("id")).agg(F.max_by("pref", "id").alias("_text"))
    out = prefs.join(r, "id", "left").join(s, "id", "left").join(m, "id", "left").withColumn("pref", F.coalesce("_text", "pref"))
    out = out.withColumn("assert_count", F.col("assert_count") + F.coalesce("_n", F.lit(0)).cast("int")).withColumn("last_asserted", F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_asserted")))
    out = out.withColumn("t_invalid", F.when(F.col("_by").isNotNull(), now).otherwise(F.col("t_invalid"))).withColumn("superseded_by", F.coalesce("_by", "superseded_by")).select(*prefs.columns)
    new = decided.where("action in ('insert', 'supersede')")
    blank = {c: F.lit(None).cast(prefs.schema[c].dataType).alias(c) for c in prefs.columns}
    have = {"id": F.col("id"), "pref": F.col("pref"), "polarity": F.col("polarity"), "assert_count": F.lit(1).cast("int").alias("assert_count"), "last_asserted": now.alias("last_asserted")}
    return out.unionByName(new.select(*(have.get(c, blank[c]) for c in prefs.columns)).join(prefs.select("id"), "id", "left_anti").select(*prefs.columns))


def merge_retold(events: DataFrame, retold: DataFrame) -> DataFrame:
    """Events reported again (id, t_valid): reported_count + 1 each, t_valid the earlier one."""
    r = retold.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("t_valid").alias("_t"))
    out = events.join(r, "id", "left").withColumn("reported_count", F.col("reported_count") + F.coalesce("_n", F.lit(0)).cast("int"))
    return out.withColumn("t_valid", F.least("t_valid", "_t")).select(*events.columns)


def enqueue_web_chunks(chunks: DataFrame, artifacts: DataFrame, queue: DataFrame, since: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(queue rows, one row of counts): embedded chunks of scraped pages and briefs that aren't queued, one artifact
    per content hash, at least 200 characters and at most 60 % links."""
    from tidemark.functions.text import link_density

    kinds = artifacts.where(F.col("kind").isin("web_scrape", "research_brief"))
    if since is not None:
        kinds = kinds.where(F.col("fetched_at") >= since)
    least = artifacts.where("content_hash is not null").groupBy("content_hash").agg(F.min("id").alias("_keep"))
    kinds = kinds.join(least, "content_hash", "left").where("content_hash is null or id = _keep").select(F.col("id").alias("web_artifact_id"), "session_id")
    cand = chunks.where("context_prefix is not null").join(kinds, "web_artifact_id").join(queue.select(F.col("web_chunk_id").alias("id")), "id", "left_anti")
    why = F.when(F.length("content") < 200, "small").when(link_density(F.col("content")) > 0.60, "links").otherwise("in")
    cand = cand.select("id", "session_id", "content", why.alias("why"))
    counts = cand.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("why") == "in").alias("enqueued"), F.count_if(F.col("why") == "small").alias("skipped_too_small"), F.count_if(F.col("why") == "links").alias("skipped_link_density"))
    rows = cand.where("why = 'in'").select(F.col("id").alias("web_chunk_id"), "session_id", "content", F.lit("web_chunk").alias("content_type"), F.lit(5).alias("priority"), F.lit("pending").alias("status"))
    return rows, counts


def push_events(stored: DataFrame, pushed: DataFrame) -> DataFrame:
    """Events to insert: new (source, source_ref), the first of each in the push; salience 1 and the domain of their
    source (git is technical) where none is given."""
    rows = last_of(pushed, ["source", "source_ref"], [F.col("t_valid"), F.col("fact")]).join(stored.select("source", "source_ref"), ["source", "source_ref"], "left_anti")
    domain = F.when(F.col("domain").isin("personal", "technical"), F.col("domain")).when(F.col("source").startswith("git:"), "technical")
    return rows.withColumn("salience", F.coalesce("salience", F.lit(1))).withColumn("domain", domain)


def remember(said: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, episodes, queue items) of statements to keep (id, content, hook, body, type, project, session_id): the
    hook is derived where there is none, the statement is also kept as a manual episode and queued for extraction."""
    from tidemark.functions.text import hook

    body = F.coalesce(F.nullif("body", F.lit("")), F.col("content"))
    n = said.select("id", F.coalesce(F.nullif("hook", F.lit("")), hook(F.col("content"))).alias("hook"), body.alias("body"), F.coalesce("type", F.lit("project")).alias("type"), "project", now.alias("created_at"))
    e = said.select(F.coalesce("session_id", F.concat(F.lit("manual-"), F.col("id").cast("string"))).alias("session_id"), F.lit("manual").alias("source"), F.col("content"), "project", now.alias("created_at"))
    return n, e, e.select("session_id", "content", F.lit("manual").alias("content_type"), F.lit("pending").alias("status"), F.lit(0).alias("priority"))


def feedback_rows(said: DataFrame) -> DataFrame:
    """Feedback (query, helpful, noise, missing, found_via) that is valid: a query, and only ids as they are served.
    found_via is collapsed to 60 characters."""
    from tidemark.functions.text import served_id

    empty = F.array().cast("array<string>")
    good = lambda c: F.forall(F.coalesce(c, empty), served_id)
    rows = said.where((F.trim(F.coalesce("query", F.lit(""))) != "") & good(F.col("helpful")) & good(F.col("noise")))
    via = F.nullif(F.substring(F.trim(F.regexp_replace(F.coalesce("found_via", F.lit("")), r"\s+", " ")), 1, 60), F.lit(""))
    return rows.select(F.trim("query").alias("query"), F.coalesce("helpful", empty).alias("helpful"), F.coalesce("noise", empty).alias("noise"), "missing", via.alias("found_via"))


def write_edges(old: DataFrame, new: DataFrame, closures: DataFrame, now: Column) -> DataFrame:
    """Edges after a write plan: closures (uuid, at, by) applied, new edges inserted once. A new edge that is itself
    contradicted by a newer one comes closed, since its closure is applied after the insert."""
    from tidemark.operators.temporal import close

    return close(insert_ignore(old, new, ["uuid"], ["uuid"]), closures, now)


def saturated(counts: DataFrame, rounds: int, most: int = 8, least: int = 4) -> DataFrame:
    """Facts (id, contradictions) whose last round found enough contradictions to look again, while rounds are left."""
    return counts.where(F.lit(rounds < most) & (F.col("contradictions") >= least)).select("id")
