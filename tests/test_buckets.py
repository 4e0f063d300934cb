"""Buckets, drill-down reads, endpoint compositions."""

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vectors as Vc
from tidemark.operators import mining as M
from tidemark.operators import mutate as X
from tidemark.plans import buckets as K
from tidemark.plans import endpoints as E


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_roles(spark):
    text = "[title] t\n\n[user] hello there\n\n[assistant] good day\n\n[tool:x] y"
    role = lambda a, b: one(spark, T.role_of(F.lit(text), F.lit(a), F.lit(b)))
    assert role(0, 8) is None
    assert role(12, 20) == "user" and role(18, 22) == "user"
    assert role(text.index("[assistant]"), len(text)) == "assistant"
    assert role(12, len(text)) == "mixed" and role(5, 5) is None
    assert one(spark, T.role_of(F.lit("plain"), F.lit(0), F.lit(5))) is None


def test_best_window(spark):
    text = "filler words " * 300 + "needle in the hay " + "filler words " * 300
    got = one(spark, K.best_window(F.lit(text), "needle hay", 2000))
    assert len(got) == 2000 and "needle" in got
    assert one(spark, K.best_window(F.lit("short"), "x", 100)) == "short"
    assert one(spark, K.best_window(F.lit(None).cast("string"), "x", 100)) == ""


def test_slack(spark):
    rows = [("a", "s", 0.9), ("b", "s", 0.8), ("c", "s", 0.7), ("d", "t", 0.65), ("e", None, 0.1)]
    df = spark.createDataFrame([(i, s, x, r) for r, (i, s, x) in enumerate(rows)], "id string, session_id string, rerank double, rank int")
    ids = lambda n, slack: [r.id for r in K.cap_with_slack(df, n, 2, slack).orderBy("served").collect()]
    assert ids(3, 0.1) == ["a", "b", "d"]  # near tie: another session
    assert ids(3, 0.01) == ["a", "b", "c"]  # clearly better: the cap yields


def test_passages(spark):
    rows = [(1, "s", "p", None, "[user] about apples\n\n[assistant] apple pie is nice", 0), (2, "s", None, None, "nothing here", 1), (3, "t", None, None, None, 2)]
    df = spark.createDataFrame(rows, "id long, session_id string, project string, created_at timestamp, content string, rank int")
    got = K.passages(df, "apple pie", n=1).collect()
    assert [(r.id, r.role) for r in got] == [("e:1", "mixed")]


def test_fetch_keeps_order_and_reports(spark):
    e = spark.createDataFrame([(i, f"c{i}") for i in range(30)], "id long, content string")
    n = spark.createDataFrame([(2, "h")], "id long, hook string")
    eps, notes, skipped = K.fetch(e, n, ["e:9", 4, "9", "zz", "n:2", None])
    assert [r.id for r in eps.collect()] == [9, 4] and notes.count() == 1 and skipped == ["zz", "None"]
    eps, _, _ = K.fetch(e, n, list(range(30)))
    assert eps.count() == 20


def edges(spark):
    hot = lambda i: [1.0 if k == i else 0.0 for k in range(4)]
    rows = [("e1", "x", "y", "apples are red", None, hot(0)), ("e2", "y", "z", "pears are green", None, hot(1)), ("e3", "x", "z", "old apples", "2020", hot(0)), ("e4", "x", "w", None, None, None)]
    return spark.createDataFrame([(a, b, c, f, "2019", t, v) for a, b, c, f, t, v in rows], "uuid string, src_uuid string, tgt_uuid string, fact string, t_valid string, t_invalid string, embedding array<float>")


def test_kg_facts_and_contradictions(spark):
    ents = spark.createDataFrame([("x", "X", [1.0, 0.0, 0.0, 0.0]), ("q", "lonely", [1.0, 0.0, 0.0, 0.0])], "uuid string, name string, embedding array<float>")
    got = [r.uuid for r in K.kg_facts(edges(spark), ents, "apples", Vc.literal([1.0, 0, 0, 0]), []).orderBy("rank").collect()]
    assert got[0] == "e1" and set(got) == {"e1", "e2"}  # live facts with a text only
    e = edges(spark)
    new = spark.createDataFrame([("n", "x", "y", [1.0, 0.0, 0.0, 0.0])], "uuid string, src_uuid string, tgt_uuid string, embedding array<float>")
    assert [tuple(r) for r in K.contradictions(new, e).collect()] == [("n", "e1", 1.0)]


def test_remember_and_feedback(spark):
    said = spark.createDataFrame([(1, "First line. More.\nsecond", None, "", "user", "p", None)], "id int, content string, hook string, body string, type string, project string, session_id string")
    n, e, q = X.remember(said, F.lit("2026-01-01").cast("timestamp"))
    r = n.first()
    assert (r.hook, r.body) == ("First line.", "First line. More.\nsecond") and e.first().session_id == "manual-1" and q.first().status == "pending"
    fb = spark.createDataFrame([("q", ["e:1"], None, None, " a  b "), ("q", ["zz"], None, None, None), (" ", None, None, None, None)], "query string, helpful array<string>, noise array<string>, missing string, found_via string")
    assert [(r.query, r.helpful, r.noise, r.found_via) for r in X.feedback_rows(fb).collect()] == [("q", ["e:1"], [], "a b")]


def test_fires(spark):
    rows = [("s", 1, 1, "x", "[tool:Skill] {'skill': 'deploy-app'}", None), ("s", 2, 2, "no, that's wrong", "y", None), ("s", 3, 3, "z", "[tool:Skill] skill: other", None), ("t", 1, 4, "no", None, None)]
    df = spark.createDataFrame(rows, "session_id string, sequence int, id int, human_turn string, content string, created_at timestamp")
    assert {(r.skill, r.dismissed) for r in M.fire_events(df).collect()} == {("deploy-app", True), ("other", False)}
    asks = df.withColumn("human_turn", F.lit("please turn this into a skill"))
    assert M.skill_requests(asks).count() == 4


def test_groups(spark):
    g = lambda n, p=None: one(spark, T.group_of(F.lit(n), F.lit(None).cast("string"), F.lit(p).cast("string")))
    assert (g("my sister's docker box"), g("docker"), g("thing", "Jobs"), g("thing")) == ("personal", "technical", "personal", "technical")


def test_endpoints(spark):
    flags = spark.createDataFrame([(1, "episode", 5, "1", True), (2, "episode", 5, "2", False), (3, "episode", 6, "1", True)], "id int, kind string, item_id int, at string, on boolean")
    eps = spark.createDataFrame([(5, "a"), (6, "b")], "id long, gist string")
    assert E.episode(eps, flags, 6).first().flagged and not E.episode(eps, flags, 5).first().flagged
    got = E.flags_list(flags, {"episode": eps.select(F.col("id").alias("item_id"), "gist")}).collect()
    assert [(r.item_id, r.gist) for r in got] == [("6", "b")]
    prefs = spark.createDataFrame([(1, "p", None, "2", 2), (2, "q", "2020", "3", None)], "id int, pref string, t_invalid string, last_asserted string, superseded_by int").withColumn("assert_count", F.lit(1))
    assert [(r.id, r.superseding) for r in E.preferences(prefs).collect()] == [(1, "q"), (2, None)]
    totals, hits = E.search({"a": (eps, "id", "gist"), "b": (eps, "id", "gist")}, "b", "a")
    assert {r.tab: r.n for r in totals.collect()} == {"a": 1, "b": 1} and hits.count() == 1
    props = spark.createDataFrame([("l", 1, 0.5, "2"), ("l", 2, None, "3")], "lane string, id int, score double, updated_at string").withColumn("status", F.lit("proposed"))
    assert [r.id for r in E.proposals([props]).collect()] == [2, 1]
    assert E.raised_since(props, F.lit("3")).first().total == 1
    kids = spark.createDataFrame([("x", "b"), ("x", "a")], "name string, path string")
    assert [c.path for c in E.with_children(spark.createDataFrame([("x",), ("y",)], "name string"), kids, "name", ["path"]).where("name = 'x'").first().children] == ["a", "b"]


def test_embedding(spark):
    from tidemark.functions.embedding import embed_pending, hashed

    df = spark.createDataFrame([(1, "apple pie", None), (2, "pie apple", None), (3, " ", None), (4, None, None), (5, "x", [1.0])], "id long, t string, e array<float>")
    got = {r.id: r.embedding for r in embed_pending(df, "id", "t", "e", hashed(8), 1).collect()}
    assert set(got) == {1, 2} and got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-5


def test_turns(spark):
    from tidemark.plans.retrieve import recall_turns

    rows = [(1, "apple pie recipe", "s", "2026-01-01 00:00:00", 3), (2, "apple tree", "s", "2020-01-01 00:00:00", 0), (3, "nothing", "t", None, None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, content string, session_id string, created_at string, retrieval_count int").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = recall_turns(df, "apple pie", None, F.lit("2026-01-02").cast("timestamp"), n=1).orderBy("rank").collect()
    assert [r.id for r in got] == [1]


def test_pools_gates_and_rules(spark):
    from tidemark.operators import graph as G
    from tidemark.operators import resolve as R

    pairs = spark.createDataFrame([(1, "a", 0.96)], "new_id int, uuid string, sim double")
    sem = spark.createDataFrame([(1, "a", 0, 0.96), (1, "b", 1, 0.8), (2, "c", 0, None), (3, "d", 0, 0.5)], "new_id int, uuid string, rank int, sim double")
    pools = R.candidate_pools(pairs, sem)
    assert {(r.new_id, r.uuid, r.pool) for r in pools.collect()} == {(1, "a", "pair"), (1, "b", "semantic"), (2, "c", "semantic"), (3, "d", "semantic")}
    new = spark.createDataFrame([(1,), (2,), (3,), (4,)], "new_id int")
    assert {r.new_id: (r.action, r.reinforce, r.ask) for r in R.enforce_gate(new, pools).collect()} == {1: ("skip", ["a"], []), 2: ("ask", [], ["c"]), 3: ("insert", [], []), 4: ("insert", [], [])}
    notes = spark.createDataFrame([(1, "user"), (2, "user")], "id int, type string")
    near = spark.createDataFrame([(1, 7, "project", 0.99, "same"), (1, 8, "user", 0.85, "contradicts"), (2, 9, "user", 0.5, "same")], "id int, note_id int, type string, sim double, verdict string")
    assert {tuple(r) for r in R.reconcile_note(notes, near).collect()} == {(1, "supersede", 8), (2, "create", None)}
    rules = spark.createDataFrame([(5, "Never use em dashes in prose"), (6, "")], "id int, rule string")
    said = spark.createDataFrame([(1, "never use em dashes"), (2, "something else"), (3, None)], "id int, rule string")
    assert {tuple(r) for r in R.same_rule(said, rules, ["in", "the"]).collect()} == {(1, 5)}
    ents = spark.createDataFrame([("u1", "Alpha"), ("u2", "Alphabet")], "uuid string, name string")
    deg = spark.createDataFrame([("u2", 3)], "node string, degree long")
    assert [r.uuid for r in G.typeahead(ents, deg, "ALPHA").collect()] == ["u2", "u1"] and G.typeahead(ents, deg, " ").count() == 0
