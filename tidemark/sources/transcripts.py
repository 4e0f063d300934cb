"""Readers of transcripts and exports. Each turns its format into common record rows
(session_id, pos, turn, kind, text, tool, uuid, ts), so that one assembly makes the episodes of all of them, in batch
as in streaming. Files are read whole, one per session or export shard, because lines have to keep their order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import machinery
from tidemark.operators.sessionize import assemble_episodes, turn_groups

BLOCK = "array<struct<type:string,text:string,content:string,id:string,tool_use_id:string,name:string,input:string>>"
# First words of injected user messages of rollout files.
ROLLOUT_MACHINERY = ["<environment_context>", "<user_instructions>", "<turn_context>", "<permissions", "<skills_instructions>", "<multi_agent", "<collaboration_mode>", "<system-reminder>"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, value: the lines of all files below a path that aren't blank."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "value"))
    return whole.where(F.trim("value") != "")


def _blocks(content: Column) -> Column:
    """A message's content as blocks; a plain string is one text block. A JSON null or object is none."""
    plain = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("content", "id", "tool_use_id", "name", "input"))))
    return F.when(content.rlike(r"^\s*\["), F.coalesce(F.from_json(content, BLOCK), plain.cast(BLOCK))).when(content.isNull(), F.array().cast(BLOCK)).otherwise(plain.cast(BLOCK))


def _detail(inp: Column) -> Column:
    keys = ("command", "file_path", "query", "prompt", "url")
    return F.coalesce(*(F.nullif(F.get_json_object(inp, f"$.{k}"), F.lit("")) for k in keys), F.when(~inp.isin("{}", ""), F.substring(inp, 1, 120)))


def _result_text(raw: Column) -> Column:
    texts = F.transform(F.filter(F.from_json(raw, "array<struct<type:string,text:string>>"), lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.trim(F.when(raw.rlike(r"^\s*\["), F.array_join(texts, " ")).otherwise(F.coalesce(raw, F.lit(""))))


def session_records(rows: DataFrame) -> DataFrame:
    """Record rows of agent session files (file, pos, value): user and assistant records only, without sidechains and
    records that are client machinery alone. Lines that aren't JSON objects are skipped."""
    schema = "type string, isSidechain boolean, sessionId string, uuid string, timestamp string, cwd string, message struct<content:string,model:string>"
    rec = rows.where(F.col("value").rlike(r"^\s*\{")).select("file", "pos", F.from_json("value", schema).alias("r")).select("file", "pos", "r.*")
    rec = rec.where(F.col("type").isin("user", "assistant") & ~F.coalesce("isSidechain", F.lit(False))).withColumn("blocks", _blocks(F.col("message.content")))
    words = F.filter("blocks", lambda b: (b["type"] == "text") & (F.trim(F.coalesce(b["text"], b["content"], F.lit(""))) != ""))
    real = F.exists(words, lambda b: ~machinery(F.coalesce(b["text"], b["content"])))
    has_result = F.exists("blocks", lambda b: b["type"] == "tool_result")
    is_user = F.col("type") == "user"
    rec = rec.withColumn("opens", is_user & real).where(~is_user | real | has_result)
    sid = F.first("sessionId", ignorenulls=True).over(Window.partitionBy("file"))
    rec = turn_groups(rec.withColumn("session_id", sid).where("session_id is not null"), "session_id", "pos", F.col("opens"))
    last_text = F.try_element_at(F.filter("blocks", lambda b: (b["type"] == "text") & (F.trim(F.coalesce(b["text"], b["content"], F.lit(""))) != "")), F.lit(-1))
    said = F.array(F.struct(is_user_kind(is_user).alias("kind"), F.trim(F.coalesce(last_text["text"], last_text["content"])).alias("text"), F.lit(None).cast("string").alias("tool")))
    uses = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: F.struct(F.lit("tool").alias("kind"), _detail(b["input"]).alias("text"), F.coalesce(b["name"], F.lit("tool")).alias("tool")))
    results = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_result"), lambda b: F.struct(F.lit("result").alias("kind"), _result_text(b["content"]).alias("text"), F.lit(None).cast("string").alias("tool")))
    parts = F.when(is_user, F.concat(said, results)).otherwise(F.concat(uses, said))
    out = rec.select("session_id", "pos", "turn", "uuid", F.try_to_timestamp("timestamp").alias("ts"), "cwd", F.col("message.model").alias("model"), F.posexplode(parts).alias("k", "p"))
    return out.select("session_id", (F.col("pos").cast("long") * 1000 + F.col("k")).alias("pos"), "turn", F.when(F.coalesce(F.col("p.text"), F.lit("")) != "", F.col("p.kind")).alias("kind"), "p.text", "p.tool", "uuid", "ts", "cwd", "model")


def is_user_kind(is_user: Column) -> Column:
    return F.when(is_user, "user").otherwise("assistant")


def session_episodes(rows: DataFrame) -> DataFrame:
    return assemble_episodes(session_records(rows))


def rollout_records(rows: DataFrame) -> DataFrame:
    """Record rows of rollout files: session_meta and turn_context lines carry the session, response_item lines the
    items. Developer messages, reasoning and injected user messages are left out."""
    schema = "type string, timestamp string, payload struct<type:string,role:string,id:string,session_id:string,name:string,input:string,arguments:string,content:string,output:string,action:struct<command:string,query:string>>"
    rec = rows.where(F.col("value").rlike(r"^\s*\{")).select("file", "pos", F.from_json("value", schema).alias("r")).select("file", "pos", "r.*")
    whole = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    meta = F.last(F.when(F.col("type") == "session_meta", F.coalesce("payload.session_id", "payload.id")), ignorenulls=True).over(whole)
    hint = F.nullif(F.regexp_extract("file", r"rollout-.*-([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\.jsonl$", 1), F.lit(""))
    rec = rec.withColumn("session_id", F.coalesce(meta, hint)).where((F.col("type") == "response_item") & F.col("session_id").isNotNull())

    def joined(c: Column) -> Column:
        got = F.filter(F.from_json(c, "array<struct<type:string,text:string>>"), lambda b: b["type"].isin("input_text", "output_text", "text") & (F.trim(F.coalesce(b["text"], F.lit(""))) != ""))
        return F.trim(F.when(c.rlike(r"^\s*\["), F.array_join(F.transform(got, lambda b: F.trim(b["text"])), "\n")).otherwise(F.coalesce(c, F.lit(""))))

    kind, role = F.col("payload.type"), F.col("payload.role")
    text = joined(F.col("payload.content"))
    injected = F.lit(False)
    for p in ROLLOUT_MACHINERY:
        injected = injected | F.ltrim(text).startswith(p)
    user = (kind == "message") & (role == "user")
    rec = rec.withColumn("said", text).where(
        kind.isin("message", "custom_tool_call", "custom_tool_call_output", "function_call", "function_call_output", "local_shell_call", "web_search_call")
        & ~((kind == "message") & (F.coalesce(role, F.lit("")) == "developer")) & ~(user & ((text == "") | injected))
    )
    shell = F.coalesce(F.array_join(F.from_json("payload.action.command", "array<string>"), " "), F.col("payload.action.command"))
    detail = F.when(kind == "custom_tool_call", F.col("payload.input")).when(kind == "function_call", F.col("payload.arguments")).when(kind == "local_shell_call", shell).when(kind == "web_search_call", F.col("payload.action.query"))
    tool = F.when(kind == "custom_tool_call", F.coalesce("payload.name", F.lit("tool"))).when(kind == "function_call", F.coalesce("payload.name", F.lit("function"))).when(kind == "local_shell_call", "shell").otherwise("web_search")
    is_out = kind.isin("custom_tool_call_output", "function_call_output")
    body = F.when(kind == "message", F.col("said")).when(is_out, joined(F.col("payload.output"))).otherwise(F.trim(F.coalesce(detail, F.lit(""))))
    what = F.when(user, "user").when(kind == "message", "assistant").when(is_out, "result").otherwise("tool")
    rec = turn_groups(rec.withColumn("opens", user), "session_id", "pos", F.col("opens"))
    return rec.select("session_id", F.col("pos").cast("long").alias("pos"), "turn", F.when(body != "", what).alias("kind"), body.alias("text"), tool.alias("tool"), F.col("payload.id").alias("uuid"), F.try_to_timestamp("timestamp").alias("ts"))


def rollout_episodes(rows: DataFrame) -> DataFrame:
    return assemble_episodes(rollout_records(rows), span="codex:")


def chat_export_records(spark: SparkSession, path: str) -> DataFrame:
    """Record rows of a nested chat export: conversations with sorted messages, a title and attachments' names."""
    schema = (
        "uuid string, name string, chat_messages array<struct<uuid:string,sender:string,text:string,created_at:string,content:array<struct<type:string,text:string>>,"
        "attachments:array<struct<file_name:string,name:string>>,files:array<struct<file_name:string,name:string>>>>"
    )
    convo = spark.read.schema(schema).json(path, multiLine=True).where(F.col("uuid").isNotNull())
    msgs = F.array_sort("chat_messages", lambda a, b: F.when(F.coalesce(a["created_at"], F.lit("")) < F.coalesce(b["created_at"], F.lit("")), -1).when(F.coalesce(a["created_at"], F.lit("")) > F.coalesce(b["created_at"], F.lit("")), 1).otherwise(0))
    rec = convo.select(F.col("uuid").alias("session_id"), F.trim(F.coalesce("name", F.lit(""))).alias("title"), F.posexplode(msgs).alias("n", "m"))
    pieces = F.filter(F.transform(F.filter(F.coalesce("m.content", F.array()), lambda b: b["type"] == "text"), lambda b: F.trim(F.coalesce(b["text"], F.lit("")))), lambda t: t != "")
    text = F.when(F.size(pieces) > 0, F.array_join(pieces, "\n\n")).otherwise(F.trim(F.coalesce("m.text", F.lit(""))))
    names = F.filter(F.transform(F.concat(F.coalesce("m.attachments", F.array()), F.coalesce("m.files", F.array())), lambda a: F.coalesce(a["file_name"], a["name"])), lambda x: x.isNotNull())
    rec = rec.withColumn("text", text).withColumn("files", names)
    rec = turn_groups(rec.withColumn("opens", (F.col("m.sender") == "human") & (F.col("text") != "")), "session_id", "n", F.col("opens"))
    human, model = F.col("m.sender") == "human", F.col("m.sender") == "assistant"
    none = F.lit(None).cast("string")
    parts = F.array(
        F.struct(F.when((F.col("n") == 0) & (F.col("title") != ""), "title").alias("kind"), F.col("title").alias("text")),
        F.struct(F.when(F.col("text") != "", F.when(human, "user").when(model, "assistant")).alias("kind"), F.col("text").alias("text")),
        F.struct(F.when(human & (F.size("files") > 0), "attachments").alias("kind"), F.array_join(F.transform("files", lambda x: F.concat(F.lit("file:"), x)), " ").alias("text")),
    )
    out = rec.select("session_id", "n", "turn", F.col("m.uuid").alias("uuid"), F.try_to_timestamp("m.created_at").alias("ts"), F.posexplode(parts).alias("k", "p"))
    return out.select("session_id", (F.col("n").cast("long") * 10 + F.col("k")).alias("pos"), "turn", "p.kind", "p.text", none.alias("tool"), F.concat_ws(":", "session_id", "uuid").alias("uuid"), "ts")


def chat_export_episodes(spark: SparkSession, path: str) -> DataFrame:
    return assemble_episodes(chat_export_records(spark, path), span="claude_ai:", cap=5000, spoken=True)


def tree_export_records(spark: SparkSession, path: str) -> DataFrame:
    """Record rows of an export whose messages form a tree: the branch from the current node to its root, in order;
    without a usable branch all messages by time. Conversations not to be remembered are skipped. The walk follows
    parents within one conversation's map and stops at a node seen before."""
    node = "struct<parent:string,message:struct<id:string,author:struct<role:string>,create_time:double,metadata:struct<model_slug:string>,content:struct<content_type:string,parts:array<string>>>>"
    schema = f"conversation_id string, id string, title string, is_do_not_remember boolean, create_time double, current_node string, mapping map<string,{node}>"
    convo = spark.read.schema(schema).json(path, multiLine=True).withColumn("session_id", F.coalesce("conversation_id", "id"))
    convo = convo.where(F.col("session_id").isNotNull() & ~F.coalesce("is_do_not_remember", F.lit(False)))

    @F.pandas_udf("array<string>")
    def path_to(current: pd.Series, links: pd.Series) -> pd.Series:
        def one(at: str | None, pairs) -> list[str]:
            parent, seen = {p["k"]: p["p"] for p in pairs} if pairs is not None else {}, {}
            while at in parent and at not in seen:
                seen[at] = True  # in order of the walk
                at = parent[at]
            return [*seen][::-1]

        return pd.Series([one(a, x) for a, x in zip(current, links)], dtype=object)

    # only ids leave the JVM, and a walk is linear in the branch
    links = F.transform(F.map_entries("mapping"), lambda e: F.struct(e["key"].alias("k"), e["value"]["parent"].alias("p")))
    convo = convo.withColumn("_branch", path_to("current_node", links))
    branch = F.coalesce("_branch", F.array().cast("array<string>"))
    on = F.filter(F.transform(branch, lambda k: F.try_element_at(F.col("mapping"), k)["message"]), lambda m: m.isNotNull())
    every = F.array_sort(F.filter(F.transform(F.map_values("mapping"), lambda n: n["message"]), lambda m: m.isNotNull()), lambda a, b: F.when(F.coalesce(a["create_time"], F.lit(0.0)) < F.coalesce(b["create_time"], F.lit(0.0)), -1).otherwise(1))
    rec = convo.where("size(mapping) > 0").select("session_id", F.trim(F.coalesce("title", F.lit(""))).alias("title"), "create_time", F.posexplode(F.when(F.size(on) > 0, on).otherwise(every)).alias("n", "m"))
    bits = F.filter(F.transform(F.coalesce("m.content.parts", F.array()), lambda p: F.when(p.rlike(r"^\s*\{"), F.lit("[image]")).otherwise(F.trim(p))), lambda p: p != "")
    text = F.when(F.col("m.content.content_type").isin("text", "multimodal_text"), F.array_join(bits, "\n\n")).otherwise("")
    role = F.col("m.author.role")
    rec = rec.withColumn("text", text).where(role.isin("user", "assistant") & (F.col("text") != ""))
    w = Window.partitionBy("session_id").orderBy("n")
    rec = turn_groups(rec.withColumn("first", F.row_number().over(w) == 1).withColumn("opens", role == "user"), "session_id", "n", F.col("opens"))
    parts = F.array(F.struct(F.when(F.col("first") & (F.col("title") != ""), "title").alias("kind"), F.col("title").alias("text")), F.struct(role.alias("kind"), F.col("text").alias("text")))
    out = rec.select("session_id", "n", "turn", F.col("m.id").alias("uuid"), F.timestamp_seconds(F.coalesce("m.create_time", "create_time")).alias("ts"), F.posexplode(parts).alias("k", "p"))
    return out.select("session_id", (F.col("n").cast("long") * 10 + F.col("k")).alias("pos"), "turn", "p.kind", "p.text", F.lit(None).cast("string").alias("tool"), "uuid", "ts")


def tree_export_episodes(spark: SparkSession, path: str) -> DataFrame:
    return assemble_episodes(tree_export_records(spark, path), span="openai:")


def bubble_records(kv: DataFrame) -> DataFrame:
    """Record rows of an editor's key-value table (key, value): bubbleId:<composer>:<bubble> keys with JSON values,
    grouped by composer, ordered by creation, then id. Read the table over JDBC or from an export."""
    schema = "type int, text string, createdAt string, toolResults array<struct<name:string,tool:string,result:string,output:string>>"
    rec = kv.where(F.col("key").rlike(r"^bubbleId:[^:]+:.+")).select(F.regexp_extract("key", r"^bubbleId:([^:]+):(.+)$", 1).alias("session_id"), F.regexp_extract("key", r"^bubbleId:([^:]+):(.+)$", 2).alias("bubble"), F.from_json(F.col("value").cast("string"), schema).alias("b"))
    rec = rec.where("b is not null").withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.coalesce("b.createdAt", F.lit("")), "bubble")))
    text = F.trim(F.coalesce("b.text", F.lit("")))
    rec = turn_groups(rec.withColumn("opens", (F.col("b.type") == 1) & (text != "")), "session_id", "n", F.col("opens"))
    said = F.array(F.struct(F.when(text != "", F.when(F.col("b.type") == 1, "user").when(F.col("b.type") == 2, "assistant")).alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("tool")))
    out = F.coalesce("b.toolResults", F.array())
    tools = F.transform(F.filter(out, lambda r: F.length(F.trim(F.coalesce(r["result"], r["output"], F.lit("")))) > 20), lambda r: F.struct(F.lit("tool").alias("kind"), F.trim(F.coalesce(r["result"], r["output"])).alias("text"), F.coalesce(r["name"], r["tool"], F.lit("tool")).alias("tool")))
    parts = F.concat(said, F.when(F.col("b.type") == 2, tools).otherwise(F.array()))
    got = rec.select("session_id", "n", "turn", F.concat_ws(":", "session_id", "bubble").alias("uuid"), F.try_to_timestamp("b.createdAt").alias("ts"), F.posexplode(parts).alias("k", "p"))
    return got.select("session_id", (F.col("n").cast("long") * 1000 + F.col("k")).alias("pos"), "turn", "p.kind", "p.text", "p.tool", "uuid", "ts")


def bubble_episodes(kv: DataFrame) -> DataFrame:
    return assemble_episodes(bubble_records(kv), span="cursor-sqlite:", spoken=True)


def tool_calls(rows: DataFrame) -> DataFrame:
    """file, tool_use_id, name, input, result, pos: tool uses with the result that follows them in the same file.
    Uses without a result and results without a use are dropped; a repeated id pairs with its first result after it."""
    rec = rows.where(F.col("value").rlike(r"^\s*\{")).select("file", "pos", F.from_json("value", "message struct<content:string>").alias("r"))
    b = rec.select("file", "pos", F.explode(_blocks(F.col("r.message.content"))).alias("b"))
    uses = b.where("b.type = 'tool_use' and b.id is not null").select("file", F.col("b.id").alias("tool_use_id"), "pos", "b.name", "b.input")
    results = b.where("b.type = 'tool_result' and b.tool_use_id is not null").select("file", F.col("b.tool_use_id").alias("tool_use_id"), F.col("pos").alias("rpos"), _result_text(F.col("b.content")).alias("result"))
    met = uses.join(results, ["file", "tool_use_id"]).where("rpos > pos")
    return met.groupBy("file", "tool_use_id").agg(F.min_by(F.struct("name", "input", "result", "pos"), F.struct("pos", "rpos")).alias("m")).select("file", "tool_use_id", "m.*")


def archived_threads(calls: DataFrame) -> DataFrame:
    """kind, source_id, url, content of shell calls that fetched a thread or a transcript."""
    cmd = F.get_json_object("input", "$.command")
    unq = lambda c: F.regexp_replace(c, r"^['\"]+|['\"]+$", "")
    x = unq(F.regexp_extract(cmd, r"(?:^|[;&|]\s*|\s)bird\s+thread\s+(\S+)", 1))
    xid = F.when(x.rlike(r"/status/\d+"), F.regexp_extract(x, r"/status/(\d+)", 1)).when(x.rlike(r"^\d{8,}$"), x)
    bsky = unq(F.regexp_extract(cmd, r"(?:bsky[\"']?|\$BSKY[\"']?)\s+thread\s+(\S+)", 1))
    bid = F.nullif(F.regexp_extract(bsky, r"/post/([a-z0-9]+)", 1), F.lit(""))
    vid = F.when(cmd.contains("WEBVTT"), F.nullif(F.regexp_extract(cmd, r"/tmp/yt_([A-Za-z0-9_-]{6,})", 1), F.lit("")))
    hit = (
        F.when(xid.isNotNull(), F.struct(F.lit("x_thread").alias("kind"), F.concat(F.lit("thread:x:"), xid).alias("source_id"), F.concat(F.lit("https://x.com/i/status/"), xid).alias("url")))
        .when(bid.isNotNull(), F.struct(F.lit("bsky_thread").alias("kind"), F.concat(F.lit("thread:bsky:"), bid).alias("source_id"), F.when(bsky.startswith("http"), bsky).otherwise(F.concat(F.lit("https://bsky.app/search?q="), bid)).alias("url")))
        .when(vid.isNotNull(), F.struct(F.lit("yt_transcript").alias("kind"), F.concat(F.lit("transcript:"), vid).alias("source_id"), F.concat(F.lit("https://www.youtube.com/watch?v="), vid).alias("url")))
    )
    return calls.where(F.col("name") == "Bash").select(hit.alias("h"), F.col("result").alias("content")).where("h is not null and content != ''").select("h.*", "content")


def commits(rows: DataFrame, project: str) -> DataFrame:
    """Timeline events of commit rows (sha, authored_at, parents, subject, added, deleted; one row per changed file).

    Salience: 0 for merges, bumps and housekeeping prefixes, 2 for features, fixes and speedups with over 200 changed
    lines or an issue number, else 1.
    """
    c = rows.groupBy("sha").agg(F.first("authored_at").alias("t_valid"), F.first("parents").alias("parents"), F.first("subject").alias("subject"), F.sum(F.coalesce(F.try_to_number("added", F.lit("999999999")), F.lit(0)) + F.coalesce(F.try_to_number("deleted", F.lit("999999999")), F.lit(0))).cast("long").alias("churn"))
    low = F.lower("subject")
    prefix = F.substring_index(F.lower(F.trim(F.substring_index("subject", ":", 1))), "(", 1)
    merge = F.size(F.split(F.trim(F.coalesce("parents", F.lit(""))), r"\s+")) > 1
    quiet = merge | low.startswith("merge ") | low.startswith("bump ") | low.contains("dependabot") | prefix.isin("chore", "ci", "docs", "style", "test", "build", "revert")
    big = prefix.isin("feat", "fix", "perf") & ((F.col("churn") > 200) | F.col("subject").contains("#"))
    return c.select("t_valid", F.concat(F.lit(f"committed to {project}: "), "subject").alias("fact"), F.lit(f"git:{project}").alias("source"), F.col("sha").alias("source_ref"), F.lit(project).alias("project"), F.when(quiet, 0).when(big, 2).otherwise(1).alias("salience"), F.lit("technical").alias("domain"), "churn")


def note_files(spark: SparkSession, path: str, default: str | None = None) -> DataFrame:
    """Notes from Markdown files with front matter: name, hook, body, type, project.

    Hook: description (200 characters), else the first sentence of the first line of content, else the name. Type: a
    valid metadata type, else a prefix of the file name, else the default, else 'project'.
    """
    kinds = ["user", "feedback", "project", "reference"]
    df = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), F.regexp_replace("value", "\r\n", "\n").alias("t"))
    fenced = F.col("t").rlike(r"(?s)^---\n.*?\n---(?:\n|$)")
    head = F.when(fenced, F.regexp_extract("t", r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)).otherwise("")
    body = F.trim(F.when(fenced, F.regexp_replace("t", r"(?s)^---\n.*?\n---(?:\n|$)", "")).otherwise(F.col("t")))
    top = lambda k: F.nullif(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1), F.lit(""))
    under = lambda k: F.nullif(F.regexp_extract(head, rf"(?m)^[ \t]+{k}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1), F.lit(""))
    line = F.regexp_extract(F.regexp_replace(body, r"(?m)^[ \t]*(?:#+[ \t]*)?(?:-*)[ \t]*$\n?", ""), r"(?m)^[ \t]*#*[ \t]*(\S[^\n]*)$", 1)
    first = F.regexp_extract(line, r"^(.*?[.!?])(?:\s|$)", 1)
    name = F.coalesce(top("name"), F.col("stem"))
    hook = F.coalesce(top("description"), F.nullif(F.when(first != "", first).otherwise(line), F.lit("")), name)
    by_name = F.coalesce(*(F.when(F.col("stem").startswith(k + "_"), k) for k in kinds))
    kind = F.coalesce(F.when(under("type").isin(kinds), under("type")), by_name, F.lit(default if default in kinds else "project"))
    return df.select(name.alias("name"), F.substring(F.trim(hook), 1, 200).alias("hook"), body.alias("body"), kind.alias("type"), under("project").alias("project"))
