"""Readers on small files, and stream against batch."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import transcripts as R
from tidemark.sources import web_results as W
from tidemark.streaming import ingest as I


def write(path, records):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in records))
    return str(path)


def user(text, n, **kw):
    return {"type": "user", "uuid": f"u{n}", "sessionId": "s1", "timestamp": "2026-01-01T00:00:00Z", "cwd": "/w/proj", "message": {"content": text}} | kw


def bot(blocks, n, **kw):
    return {"type": "assistant", "uuid": f"a{n}", "sessionId": "s1", "timestamp": "2026-01-01T00:00:01Z", "message": {"content": blocks, "model": "m"}} | kw


SESSION = [
    user("first question", 1), bot([{"type": "text", "text": "let me see"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "git status"}}], 1),
    {"type": "user", "uuid": "r1", "sessionId": "s1", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "a result that is long enough"}]}},
    bot([{"type": "text", "text": "first answer"}], 2), "not json", "", user("<command-name>x", 9), user("side", 8, isSidechain=True),
    user([{"type": "text", "text": "second question"}], 2), bot("plain answer", 3), user("second question", 2), bot("plain answer", 3),
]


def test_session_files(spark, tmp_path):
    write(tmp_path / "a.jsonl", SESSION)
    got = R.session_episodes(R.lines(spark, str(tmp_path))).orderBy("sequence").collect()
    assert [(r.sequence, r.human_turn, r.assistant_turn, r.span_id) for r in got] == [(1, "first question", "first answer", "jsonl:a2"), (2, "second question", "plain answer", "jsonl:a3")]
    assert got[0].content == "[user] first question\n\n[tool:Bash] git status\n\n[assistant] let me see\n\n[result] a result that is long enough\n\n[assistant] first answer"
    assert got[1].content.startswith("[context] first answer\n\n[user] second question")


def test_tool_calls(spark, tmp_path):
    recs = [bot([{"type": "tool_use", "id": "t9", "name": "Bash", "input": {"command": "bird thread https://x.com/i/status/123456789"}}], 1), {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t9", "content": [{"type": "text", "text": "posts"}]}]}}]
    calls = R.tool_calls(R.lines(spark, write(tmp_path / "b.jsonl", recs)))
    assert [(r.tool_use_id, r.result) for r in calls.collect()] == [("t9", "posts")]
    assert [tuple(r) for r in R.archived_threads(calls).collect()] == [("x_thread", "thread:x:123456789", "https://x.com/i/status/123456789", "posts")]


def test_rollout(spark, tmp_path):
    item = lambda p, t="response_item": {"type": t, "timestamp": "2026-01-01T00:00:00Z", "payload": p}
    recs = [item({"session_id": "r1", "cwd": "/x"}, "session_meta"), item({"type": "message", "role": "developer", "content": "no"}), item({"type": "message", "role": "user", "id": "i1", "content": [{"type": "input_text", "text": "hello there"}]}),
            item({"type": "reasoning"}), item({"type": "local_shell_call", "action": {"command": ["ls", "-l"]}}), item({"type": "function_call_output", "output": "an output that is long enough"}), item({"type": "message", "role": "assistant", "id": "i2", "content": [{"type": "output_text", "text": "hi"}]})]
    r = R.rollout_episodes(R.lines(spark, write(tmp_path / "c.jsonl", recs))).collect()
    assert len(r) == 1 and r[0].content == "[user] hello there\n\n[tool:shell] ls -l\n\n[result] an output that is long enough\n\n[assistant] hi" and r[0].span_id == "codex:i2"


def test_chat_export(spark, tmp_path):
    msg = lambda i, s, t, **kw: {"uuid": f"m{i}", "sender": s, "text": t, "created_at": f"2026-01-0{i}T00:00:00Z"} | kw
    convo = [{"uuid": "c1", "name": "Title", "chat_messages": [msg(2, "assistant", "answer"), msg(1, "human", "question", attachments=[{"file_name": "a.txt"}])]}, {"name": "no id"}]
    p = tmp_path / "conversations.json"
    p.write_text(json.dumps(convo))
    r = R.chat_export_episodes(spark, str(p)).collect()
    assert len(r) == 1 and r[0].content == "[title] Title\n\n[user] question\n\n[attachments] file:a.txt\n\n[assistant] answer"


def test_tree_export(spark, tmp_path):
    node = lambda i, parent, role, text: {"parent": parent, "message": {"id": i, "author": {"role": role}, "create_time": 1.0, "content": {"content_type": "text", "parts": [text]}}}
    m = {"a": node("a", None, "user", "q"), "b": node("b", "a", "assistant", "old"), "c": node("c", "a", "assistant", "new"), "x": node("x", "x", "user", "loop")}
    convo = [{"conversation_id": "t1", "title": "T", "current_node": "c", "mapping": m}, {"conversation_id": "t2", "is_do_not_remember": True, "current_node": "a", "mapping": m}, {"conversation_id": "t3", "current_node": "x", "mapping": m}]
    p = tmp_path / "conversations.json"
    p.write_text(json.dumps(convo))
    r = {x.session_id: x for x in R.tree_export_episodes(spark, str(p)).collect()}
    assert set(r) == {"t1", "t3"} and r["t1"].content == "[title] T\n\n[user] q\n\n[assistant] new" and r["t3"].human_turn == "loop"


def test_bubbles(spark):
    v = lambda t, x, at, **kw: json.dumps({"type": t, "text": x, "createdAt": at} | kw)
    kv = spark.createDataFrame([("bubbleId:c:2", v(2, "answer", "2", toolResults=[{"name": "grep", "result": "a result that is long enough"}])), ("bubbleId:c:1", v(1, "question", "1")), ("other", "x"), ("bubbleId:c:3", "broken")], "key string, value string")
    r = R.bubble_episodes(kv).collect()
    assert len(r) == 1 and r[0].content == "[user] question\n\n[assistant] answer\n\n[tool:grep] a result that is long enough"


def test_commits_and_notes(spark, tmp_path):
    rows = spark.createDataFrame([("1", "t", "p", "feat: big", "150", "60"), ("1", "t", "p", "feat: big", "-", "-"), ("2", "t", "p q", "x", "1", "1"), ("3", "t", "p", "docs(a): y", "1", "1"), ("4", "t", "p", "other", "1", "1")], "sha string, authored_at string, parents string, subject string, added string, deleted string")
    assert {r.source_ref: (r.salience, r.churn) for r in R.commits(rows, "repo").collect()} == {"1": (2, 210), "2": (0, 2), "3": (0, 2), "4": (1, 2)}
    (tmp_path / "feedback_x.md").write_text('---\nname: "N"\nmetadata:\n  project: p\n---\n# Head line. More\nbody')
    (tmp_path / "y.md").write_text("plain text only")
    got = {r.name: (r.hook, r.type, r.project) for r in R.note_files(spark, str(tmp_path)).collect()}
    assert got == {"N": ("Head line.", "feedback", "p"), "y": ("plain text only", "project", None)}


def test_web_results(spark):
    rows = [
        (1, "WebSearch", '{"query": "q"}', 'Web search results\n\nLinks: [{"title": "T", "url": "u1"}, {"title": "no url"}]\n\ntext'), (2, "WebFetch", '{"url": "u"}', "REDIRECT DETECTED: x"),
        (3, "mcp__x__deep_researcher_start", "{}", '{"success": true, "researchId": "r", "instructions": "i"}'), (4, "mcp__x__deep_researcher_check", "{}", '{"status": "running"}'),
        (5, "mcp__x__web_search_exa", '{"query": "z"}', "Title: A\nURL: ua\nAuthor: N/A\n\nTitle: B\nURL: ub"), (6, "WebFetch", '{"url": "u"}', None), (7, "mcp__x__crawling_exa", "{}", "# Page\nURL: https://p.example/x\n\nbody"),
    ]
    got = {r.result_id: r for r in W.parse(spark.createDataFrame(rows, "result_id int, tool_name string, tool_input string, result_text string")).collect()}
    assert [got[i].kind for i in range(1, 8)] == ["search", "error", "research_job_ref", "error", "search", "error", "scrape"]
    assert [x.url for x in got[1].items] == ["u1"] and got[2].reason == "redirect_detected" and got[4].reason == "status_running" and [x.url for x in got[5].items] == ["ua", "ub"] and got[6].reason == "empty"
    assert got[7].url == "https://p.example/x" and got[7].title == "Page"


def test_stream_equals_batch_and_replays_are_no_ops(spark, tmp_path):
    src, store = tmp_path / "in", tmp_path / "store"
    src.mkdir()
    write(src / "a.jsonl", SESSION[:4])
    I.ingest(spark, str(src), str(store), str(tmp_path / "cp")).awaitTermination()
    write(src / "b.jsonl", SESSION)  # the session again, grown
    I.ingest(spark, str(src), str(store), str(tmp_path / "cp")).awaitTermination()
    got = [(r.sequence, r.human_turn) for r in spark.read.parquet(str(store)).orderBy("sequence").collect()]
    assert got == [(1, "first question"), (2, "second question")]


def test_stream_chunks_once(spark, tmp_path):
    from tidemark.operators.sessionize import chunk_windows

    schema = "session_id string, sequence int, id long, content string, project string"
    src = tmp_path / "eps"
    out = []
    for lo, hi in ((1, 5), (5, 11)):
        spark.createDataFrame([("s", i, i, f"c{i}", "p") for i in range(lo, hi)], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = I.chunk_stream(spark.readStream.schema(schema).parquet(str(src)))
        q = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        q.awaitTermination()
    want = chunk_windows(spark.read.parquet(str(src))).collect()
    assert sorted((r.start_sequence, r.end_sequence, r.content) for r in out) == sorted((r.start_sequence, r.end_sequence, r.content) for r in want) and want


def test_admission(spark):
    eps = spark.createDataFrame([("s", 1, "h", "a", "[user] QUESTION: x REFERENCE ANSWER (ground truth): y", None), ("s", 2, "h", "a", "ok", "sp"), ("p", 1, "h", "a", "secret", "sq"), ("s", 3, "h", "a", "ok", "sr")], "session_id string, sequence int, human_turn string, assistant_turn string, content string, span_id string").withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("project", F.lit(None).cast("string"))
    private = spark.createDataFrame([("p",)], "session_id string")
    got = I.admit_episodes(eps, spark.createDataFrame([], I.EPISODE), private).collect()
    assert [(r.session_id, r.sequence, r.content) for r in got] == [("s", 1, "ok")]


@pytest.mark.parametrize("seen,want", [(None, ("reset", 9)), (5, ("replay", 6)), (2, ("reset", 9)), (12, ("reset", 9))])
def test_resume(seen, want):
    assert I.resume(seen, 5, 9) == want
