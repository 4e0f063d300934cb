"""Operators on literal frames: properties, nulls, ties, empty input."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import markdown
from tidemark.functions import text as T
from tidemark.operators import analytics as A
from tidemark.operators import graph as G
from tidemark.operators import mining as M
from tidemark.operators import mutate as X
from tidemark.operators import ranking as R
from tidemark.operators import resolve as E
from tidemark.operators import sessionize as S
from tidemark.operators import temporal as B


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("cmd,want", [
    ("ssh -4 box docker restart web", "ssh:box>docker:restart:web"),
    ("ssh box 'uptime'", "ssh:box>bin:uptime"),
    ("ssh box strange thing", "ssh:box>strange"),
    ("docker exec -it db psql -c x", "docker-exec:db:psql"),
    ("docker compose up -d api", "docker:compose up:api"),
    ("python3 ~/scripts/run.py --x", "script:run.py"),
    ("curl -s https://a.example/v1/12/x?y=1", "curl:https://a.example/v1/N/x"),
    ("sudo systemctl --user restart api.service", "systemctl:restart:api.service"),
    ("git -C /x status", "git:status"),
    ("git bisect", None),
    ("node src/tools/build.js", "node:build.js"),
    ("kubectl get pods", "kubectl:get:pods"),
    ("jq . file.json", "bin:jq:."),
    ("cat x | psql -d y", "psql:direct"),
    ("ls", None),
    ("", None),
])
def test_fingerprint(spark, cmd, want):
    assert one(spark, M.fingerprint(F.lit(cmd))) == want


def test_marks_and_atoms(spark):
    text = "[user] x\n[tool:Bash] git status && jq . a\n# note\nssh h uptime; ls\n[result] y\n[tool:mcp__web__get] z"
    rows = spark.createDataFrame([("s", 1, text), ("s", 2, None)], "session_id string, sequence int, content string")
    got = {r.fp for r in M.fingerprints(rows).collect()}
    assert {"git:status", "tool:mcp:web:get"} <= got
    assert one(spark, M.eligible(F.lit("git:status"))) is False


def test_correction_score(spark):
    s = lambda t, n: one(spark, M.correction_score(F.lit(t), F.lit(n)))
    assert s("that didn’t work, same error", 1) == 4
    assert s("wrong, try again", 1) == 0
    assert s("wrong, try again", 2) == 2
    assert s("wrong " * 100, 2) == 0
    assert s("  ", 5) == 0


def test_names(spark):
    assert one(spark, T.normalized_name(F.lit('  "Foo   Bar." '))) == "foo bar"
    assert one(spark, T.shingles(F.lit("ab"))) == ["ab"]
    assert one(spark, T.shingles(F.lit(""))) == []
    assert one(spark, T.jaccard(F.expr("array()"), F.expr("array()"))) == 1.0
    assert one(spark, T.entropy(F.lit("aaaa"))) == 0.0
    assert abs(one(spark, T.entropy(F.lit("ab ab"))) - 1.0) < 1e-9
    assert one(spark, T.fuzzy_eligible(F.lit("api"))) is False
    assert one(spark, T.banned_name(F.lit("3 weeks"))) == "figure-name"
    assert one(spark, T.banned_name(F.lit("2024 plan"))) == "abstraction-name"
    assert one(spark, T.banned_name(F.lit("the Acme strategy"))) is None
    assert one(spark, T.banned_name(F.lit("Acme"))) is None


def test_urls_and_ids(spark):
    u = lambda x: one(spark, T.canonical_url(F.lit(x)))
    assert u("HTTPS://Ex.COM/A/?q=1#f") == "https://ex.com/A?q=1"
    assert u("https://ex.com") == "https://ex.com/"
    assert u("nope") is None
    assert one(spark, T.identifiers(F.lit("Fix #12 in abcdef1"))) == ["#12", "abcdef1"]
    assert one(spark, T.wikilinks(F.lit("[[A|b]] [[C#d]] [[ ]]"))) == ["A", "C"]
    assert one(spark, T.served_id(F.lit("e:12"))) and not one(spark, T.served_id(F.lit("x:1")))


def episodes(spark, n, session="s"):
    return spark.createDataFrame([(i, session, i, "p", f"c{i}", None) for i in range(1, n + 1)], "id long, session_id string, sequence int, project string, content string, span_id string")


@pytest.mark.parametrize("n,want", [(0, 0), (3, 0), (4, 1), (6, 1), (7, 2), (10, 3)])
def test_windows(spark, n, want):
    got = S.chunk_windows(episodes(spark, n)).collect()
    assert len(got) == want
    assert all(len(r.episode_ids) == 4 for r in got)
    seen = spark.createDataFrame([("s", 1, 4)], "session_id string, start_sequence int, end_sequence int")
    assert S.chunk_windows(episodes(spark, n), existing=seen).count() == max(0, want - 1)


def test_arcs_split_at_gaps(spark):
    rows = spark.createDataFrame([("s", p, 1, i) for i, p in enumerate([1, 3, 9, 16, 17])], "k string, pos int, score int, i int")
    got = {(r.seq_min, r.seq_max, r.score) for r in S.gap_arcs(rows, ["k"], "pos", 6, "score", "i").collect()}
    assert got == {(1, 9, 3), (16, 17, 2)}


def test_pack(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 5, 20, 1, 1])], "k string, i int, s int")
    got = [r.batch for r in S.pack(rows, "k", "i", F.col("s"), 3, 10).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 2]


def test_plan_cuts_at_turns(spark):
    rows = spark.createDataFrame([("f", i, i in (0, 3, 5)) for i in range(7)], "file string, offset long, is_user_turn boolean")
    got = [tuple(r) for r in S.plan_from_cursor(rows, 0, 2).orderBy("first").collect()]
    assert got == [("f", 0, 2, 3), ("f", 3, 4, 5), ("f", 5, 6, 5)]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "id string, rank int, score double, session string")


def test_rrf_is_order_free_and_counts_repeats(spark):
    a = ranked(spark, [("x", 0, 1.0, None), ("y", 1, 1.0, None)])
    b = ranked(spark, [("y", 0, 1.0, None), ("y", 3, 1.0, None)])
    p, q = ({r.id: r.score for r in R.rrf(ls, "id").collect()} for ls in ([a, b], [b, a]))
    assert p == q
    assert abs(p["y"] - (1 / 62 + 1 / 61 + 1 / 64)) < 1e-8


def test_cap_backfills_and_spares_null_sessions(spark):
    df = ranked(spark, [("a", 0, 1.0, "s"), ("b", 1, 1.0, "s"), ("c", 2, 1.0, "s"), ("d", 3, 1.0, None), ("e", 4, 1.0, None), ("f", 5, 1.0, None)])
    assert [r.id for r in R.cap_per_session(df, "session", 4).orderBy("served").collect()] == ["a", "b", "d", "e"]
    same = ranked(spark, [(c, i, 1.0, "s") for i, c in enumerate("abcd")])
    assert [r.id for r in R.cap_per_session(same, "session", 3).orderBy("served").collect()] == ["a", "b", "c"]


def test_cutoff_floor_abstain(spark):
    df = ranked(spark, [("a", 0, 0.9, None), ("b", 1, 0.5, None), ("c", 2, 0.1, None)])
    assert R.cutoff(df, "score", 0.5, 1, 5).count() == 2
    assert R.cutoff(df, "score", 0.99, 2, 5).count() == 2
    assert R.cutoff(df.withColumn("score", F.lit(0.0)), "score", 0.5, 1, 2).count() == 2
    assert [r.id for r in R.floor(df, "score", 0.95, keep=1).collect()] == ["a"]
    assert R.floor(df, "score", 0.95).count() == 0
    assert R.abstain(df, "score", 0.95).count() == 0
    assert R.abstain(df.withColumn("score", F.lit(0.0)), "score", 0.95).count() == 3


def test_refusion_lifts_lexical_hits(spark):
    rows = [(f"d{i}", i, 10.0 if i == 20 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, rank int, bm25_score double")
    got = {r.id: r.new_rank for r in R.refuse_lexical(df, "id").collect()}
    assert got["d20"] < 5 and len(got) == 30
    plain = R.refuse_lexical(df.withColumn("bm25_score", F.lit(None).cast("double")), "id").collect()
    assert all(r.rank == r.new_rank for r in plain)
    kept = {r.id: r.new_rank for r in R.reserve_lexical(df, 20, 2).collect()}
    assert kept["d20"] == 18 and sorted(kept.values()) == list(range(30))


def test_echo(spark):
    q = "please compare the third quarter budget with the plan for the new harbour office in detail"
    df = spark.createDataFrame([("a", 0, "he said: " + q.upper() + " ok"), ("b", 1, "a plan for the harbour"), ("c", 2, None)], "id string, rank int, content string")
    assert [r.id for r in R.query_echo(df, "content", q).orderBy("rank").collect()] == ["b", "c"]
    assert R.query_echo(df, "content", "short").count() == 3


def test_bm25_edge_cases(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, None), (3, ""), (4, "apple")], "id int, t string")
    assert [r.id for r in R.bm25(docs, "id", "t", "Apple!").orderBy("rank").collect()] == [4, 1]
    assert R.bm25(docs, "id", "t", "?!").count() == 0
    assert R.bm25(docs.limit(0), "id", "t", "apple").count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, b) for b in range(101, 140)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in G.components(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def test_fuzzy_pairs_match_brute_force(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randint(6, 16))) for _ in range(150)] + ["alpha service", "alpha-service", "alphas service", None, ""]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {(r.a, r.b) for r in E.fuzzy_pairs(df, "id", "name", 0.6).collect()}
    forms = df.select("id", T.fuzzy_name(F.col("name")).alias("f"), T.shingles(T.fuzzy_name(F.col("name"))).alias("g"), T.fuzzy_eligible(T.normalized_name(F.col("name"))).alias("ok")).where("ok and f != ''").collect()
    first = {}
    for r in sorted(forms, key=lambda r: r.id):
        first.setdefault(r.f, r)
    reps = sorted(first.values(), key=lambda r: r.id)
    want = {(x.id, y.id) for i, x in enumerate(reps) for y in reps[i + 1 :] if len(set(x.g) & set(y.g)) / len(set(x.g) | set(y.g)) >= 0.6}
    assert got == want and want


def test_similar_vectors(spark):
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, [x + rng.gauss(0, 0.1) for x in v]) for i, v in enumerate(base)] + [(200, base[0]), (201, None), (202, [0.0] * 16)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = {(r.a, r.b) for r in E.similar_pairs(df, "id", "v", 0.9).collect()}
    assert {(i, 100 + i) for i in range(40)} <= got
    assert not any(b in (200, 201, 202) for _, b in got)  # an equal vector is in its class, others are none


def test_ladder(spark):
    new = spark.createDataFrame([(1, "Acme Poller", "Tool"), (2, "acme-poller!", "Tool"), (3, "api", None), (4, "acme pollers", "Person")], "id int, name string, supertype string")
    known = spark.createDataFrame([("u1", "acme poller", "Tool"), ("u2", "Acme-Pollar", "Service")], "uuid string, name string, supertype string")
    got = {r.id: (r.stage, r.matches) for r in E.resolve_ladder(new, known, 0.5).collect()}
    assert got[1] == ("exact", ["u1"]) and got[2][0] == "candidates" and got[2][1][0] == "u1"
    assert got[3] == ("none", []) and got[4] == ("none", [])


def test_evidence(spark):
    rows = [(1, "a", "judge", "gap_scan", "n1", None), (1, "a", "judge", "gap_scan", "n2", ""), (1, "b", "grounded", "accept", None, "q"), (1, None, "grounded", "reject", None, None)]
    r = E.evidence_rollup(spark.createDataFrame(rows, "candidate_id int, session_id string, class string, signal string, scan_night string, quote string")).first()
    assert (r.judge_sessions, r.grounded_sessions, r.judge_weight, r.grounded_weight, r.score, r.scan_nights, r.quoted) == (1, 1, 2.0, 0.0, 1.0, 3, True)


def test_match_candidates(spark):
    new = spark.createDataFrame([(1, ["s1", "s2"], ["vpn", "acl"]), (2, ["s9"], ["zzz"]), (3, ["s1", "s2"], ["cake", "flour"])], "id int, sessions array<string>, tokens array<string>")
    old = spark.createDataFrame([(10, ["s1", "s2", "s3"], ["vpn", "acl", "x"])], "id int, sessions array<string>, tokens array<string>")
    assert {(r.id, r.match) for r in E.match_candidates(new, old).collect()} == {(1, 10)}  # 3 is vetoed by its signature


def _sets(rng, n, first, universe):
    pick = lambda p: [f"{p}{rng.randrange(universe)}" for _ in range(rng.randint(0, 8))] + [None] * (rng.random() < 0.1)
    rows = [(first + i, pick("s"), pick("t")) for i in range(n)]
    return [*rows, *[(first + n + i, r[1], r[2]) for i, r in enumerate(rows[:20])]]


@pytest.mark.parametrize("universe", [9, 60])
@pytest.mark.parametrize("hot", [10**9, 60, 0])
def test_match_candidates_match_brute_force(spark, universe, hot):
    rng, shape = random.Random(universe), "id int, sessions array<string>, tokens array<string>"
    new, old = _sets(rng, 150, 0, universe), _sets(rng, 120, 1000, universe)
    want = set()
    for i, s, t in new:
        best = None
        for m, s2, t2 in old:
            a, b, c, d = (set(x) - {None} for x in (s, s2, t, t2))
            sj, tj = (len(x & y) / len(x | y) if x and y else 0.0 for x, y in ((a, b), (c, d)))
            if (sj >= 0.4 and not (c and d and tj < 0.15)) or tj >= 0.6:
                best = min(best or (9, 0), (-max(sj, tj * 0.9), m))
        want |= {(i, best[1])} if best else set()
    got = E.match_candidates(spark.createDataFrame(new, shape), spark.createDataFrame(old, shape), hot=hot, block=50)
    assert {tuple(r) for r in got.select("id", "match").collect()} == want and len(want) > 5


def test_match_candidates_shuffle_no_pairs(spark):
    rng, shape = random.Random(1), "id int, sessions array<string>, tokens array<string>"
    some = lambda first: spark.createDataFrame([(first + i, [f"o{k}" for k in range(30) if rng.random() < 0.8], [f"t{k}" for k in range(25) if rng.random() < 0.8]) for i in range(600)], shape)
    new, old = some(0), some(1000)
    written = lambda: sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorSummary("driver")])
    before = written()
    assert E.match_candidates(new, old).count() == 600
    assert written() - before < 3_000_000  # 360,000 pairs

def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", "z")], "k int, v string, w string")
    once = X.upsert(old, new, ["k"], keep=["v"])
    assert {tuple(r) for r in once.collect()} == {(1, "a", "x"), (2, "b", "y"), (3, "c", "z")}
    assert {tuple(r) for r in X.upsert(once, new, ["k"], keep=["v"]).collect()} == {tuple(r) for r in once.collect()}
    assert {tuple(r) for r in X.insert_ignore(old, new, ["k"], ["v"]).collect()} == {(1, "a", "x"), (2, "b", None), (3, "c", "z")}


def facts(spark):
    return spark.createDataFrame([("a", "x", "y", None, None, 1, [1, 2]), ("b", "x", "y", "2020-01-01", "a", 1, [2]), ("c", "y", "z", None, None, 1, [])], "uuid string, src_uuid string, tgt_uuid string, t_invalid string, invalidated_by string, mention_count int, episodes array<long>")


def test_close_reinforce_unlink(spark):
    e = facts(spark)
    c = spark.createDataFrame([("a", None, "c")], "uuid string, at string, by string")
    closed = {r.uuid: r for r in B.close(e, c, F.lit("2021-01-01")).collect()}
    assert closed["a"].t_invalid == "2021-01-01" and closed["a"].invalidated_by == "c" and closed["b"].t_invalid == "2020-01-01"
    d = spark.createDataFrame([("a", [2, 3]), ("b", [2])], "uuid string, ids array<long>")
    r = {x.uuid: x for x in B.reinforce(e, d).collect()}
    assert (r["a"].mention_count, r["a"].episodes) == (2, [1, 2, 3]) and r["b"].mention_count == 1
    gone = spark.createDataFrame([(2,)], "episode_id long")
    left = {x.uuid: x.episodes for x in X.unlink(e, gone).collect()}
    assert left == {"a": [1], "c": []}


def test_queue(spark):
    q = spark.createDataFrame([(1, "pending", 5, "b"), (2, "pending", 0, "c"), (3, "processing", 0, "a")], "id int, status string, priority int, enqueued_at string").selectExpr("*", "timestamp'2020-01-01' as claimed_at", "0 as attempts", "cast(null as timestamp) as processed_at")
    now = F.lit("2020-01-02").cast("timestamp")
    assert {r.id: r.status for r in X.claim(q, 1, now).collect()} == {1: "pending", 2: "processing", 3: "processing"}
    assert {r.id: r.status for r in X.release_stale(q, now).collect()}[3] == "pending"
    done = spark.createDataFrame([(2, True), (3, False)], "id int, ok boolean")
    got = {r.id: (r.status, r.attempts) for r in X.finish(q, done, now).collect()}
    assert got[2] == ("done", 0) and got[3] == ("pending", 1)


def test_pref_action(spark):
    new = spark.createDataFrame([(1, "like"), (2, "like"), (3, "rule"), (4, "like")], "id int, polarity string")
    live = spark.createDataFrame([(1, 9, "like", 0.95), (2, 9, "dislike", 0.8), (3, 9, "like", 0.8), (4, 9, "like", 0.1)], "id int, pref_id int, polarity_old string, s double")
    got = {r.id: (r.action, r.target_id) for r in B.pref_action(new, live, F.col("s")).collect()}
    assert got == {1: ("reassert", 9), 2: ("supersede", 9), 3: ("confirm", 9), 4: ("insert", None)}


def test_feed_compares_ids_as_text(spark):
    p = spark.createDataFrame([("k", "t", 9, ""), ("k", "t", 10, ""), ("k", "s", 1, "")], "kind string, ts string, id int, text string")
    assert [r.id for r in A.feed([p], 10).collect()] == ["9", "10", "1"]
    assert [r.id for r in A.feed([p], 10, ("t", "9")).collect()] == ["10", "1"]
    assert A.decode_cursor(A.encode_cursor("2020|x", "7")) == ("2020|x", "7")
    assert A.window_seconds("7d") == 604800 and A.window_seconds("5s") == 3600 and A.window_seconds("99d") == 2592000


@pytest.mark.parametrize("text", ["", "short", "word " * 900, "x" * 4000, "a. " * 2000, "# h\n\n" + "para one. " * 200 + "\n## k\n" + "line\n" * 500 + "```\n" + "code\n" * 600 + "```\nend"])
def test_markdown_covers_text(text):
    spans = markdown.chunk(text)
    covered = set()
    for a, b in spans:
        assert 0 <= a < b <= len(text)
        covered |= set(range(a, b))
    assert covered == set(range(len(text)))
    fence = text.find("```")
    if fence >= 0:
        assert any(a <= fence and text.rfind("```") + 3 <= b for a, b in spans)
    else:
        assert all(b - a <= 1800 for a, b in spans)
