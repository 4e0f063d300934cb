"""Entity resolution and deduplication: exact, fuzzy, by vector; gates and ledgers."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.vectors import cosine
from tidemark.session import cut

PERMS, BANDS, ROWS = 64, 16, 4
#: Pairs of one element in a ledger above which its rows are compared in blocks, and rows in a block.
HOT_PAIRS, BLOCK = 4096, 2048
# Supertypes that may be anything, and pairs that may be the same.
PERMISSIVE = ["", "other", "Concept"]
ALLOWED = [("Tool", "Service"), ("Tool", "Library"), ("Library", "Service"), ("Project", "Product")]
# Weights of grounded evidence; judged signals weigh 1.
GROUNDED = {"explicit_request": 3.0, "accept": 3.0, "reject": -3.0, "post_change_fired": 2.0, "dismissal": 1.0, "user_correction": 1.0}


def exact_dedup(new: DataFrame, stored: DataFrame | None = None, ident: str = "id", order: str = "id") -> DataFrame:
    """New episodes that are no replay: neither their span_id nor their project and content are stored, and they are
    the first of their kind in the batch. Null spans and null contents never match.

    The first of a kind is a minimum, taken per task before the shuffle, and rows without a key stay out of it, so neither
    a text sent a million times nor all rows without a span are gathered in one task. Rows meet their minimum by order
    and id; rows equal in both are one."""
    rows = new.withColumn("_h", F.when(F.col("content").isNotNull(), F.md5("content"))).withColumn("_o", F.col(order)).withColumn("_i", F.col(ident)).dropDuplicates(["_o", "_i"])

    def first(df: DataFrame, keys: list[str]) -> DataFrame:
        keyed = df.where(F.col(keys[-1]).isNotNull())
        keep = keyed.groupBy(*keys).agg(F.min(F.struct("_o", "_i")).alias("_f")).select(F.col("_f._o").alias("_ko"), F.col("_f._i").alias("_ki"), F.lit(True).alias("_k"))
        met = df.join(keep, F.col("_o").eqNullSafe(F.col("_ko")) & F.col("_i").eqNullSafe(F.col("_ki")), "left")
        return met.where(F.col(keys[-1]).isNull() | F.col("_k")).select(df.columns)

    rows = first(first(rows, ["session_id", "span_id"]), ["project", "_h"])
    if stored is not None:
        spans = stored.where("span_id is not null").select("span_id").distinct()
        hashes = stored.where("content is not null").select(F.col("project").alias("_p"), F.md5("content").alias("_sh")).distinct()
        rows = rows.join(spans, "span_id", "left_anti").join(hashes, F.col("project").eqNullSafe(F.col("_p")) & (F.col("_h") == F.col("_sh")), "left_anti")
    return rows.select(*new.columns)


def canonical_min(df: DataFrame, key: str, ident: str) -> DataFrame:
    """Rows that are the least id of their key; rows with a null key all stay. Aggregated, so a hot key is no sort."""
    keep = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ident).alias("_keep"))
    return df.join(keep, [key], "left").where(F.col(key).isNull() | (F.col(ident) == F.col("_keep"))).drop("_keep")


def type_compatible(a: Column, b: Column) -> Column:
    """Whether two supertypes may merge: one untyped or permissive, equal, or an allowed pair."""
    free = F.coalesce(a, F.lit("")).isin(PERMISSIVE) | F.coalesce(b, F.lit("")).isin(PERMISSIVE)
    pairs = reduce(lambda x, y: x | y, (((a == p) & (b == q)) | ((a == q) & (b == p)) for p, q in ALLOWED))
    return free | F.coalesce(a == b, F.lit(False)) | F.coalesce(pairs, F.lit(False))


def minhash_bands(df: DataFrame, ident: str, grams: Column, perms: int = PERMS, rows: int = ROWS) -> DataFrame:
    """id, band: the band hashes of the MinHash signature of an array of strings (none for an empty one)."""
    sig = F.transform(F.sequence(F.lit(0), F.lit(perms - 1)), lambda p: F.array_min(F.transform(grams, lambda g: F.xxhash64(g, p))))
    bands = F.transform(F.sequence(F.lit(0), F.lit(perms // rows - 1)), lambda b: F.xxhash64(b, F.slice(sig, b * rows + 1, rows)))
    return df.where(F.size(grams) > 0).select(F.col(ident), F.explode(bands).alias("band"))


def fuzzy_pairs(names: DataFrame, ident: str, name: str, floor: float = 0.7) -> DataFrame:
    """a, b, similarity of ids whose normalised names have a 3-gram Jaccard similarity of at least `floor`.

    Names are compared once per distinct fuzzy form: rows with an equal form are one class (of its least id), and the
    membership is what the caller joins back. Candidates come from a prefix filter, which is exact: with the grams of
    all names in one order, rarest first, two sets of similarity t share one of their first (1 - t) n + 1 grams. The
    rarest grams are the shortest lists, and sizes must be within the factor t, so few pairs reach the exact check.
    """
    norm = T.normalized_name(F.col(name))
    rows = names.select(F.col(ident).alias("id"), norm.alias("n"), T.fuzzy_name(F.col(name)).alias("f")).where(T.fuzzy_eligible(F.col("n"))).where("f != ''")
    forms = cut(rows.groupBy("f").agg(F.min("id").alias("id")).withColumn("g", T.shingles(F.col("f"))))
    df = forms.select(F.explode("g").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = forms.select("id", F.size("g").alias("n"), F.explode("g").alias("t")).join(df, "t")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))
    prefix = ranked.withColumn("k", nth).where(F.col("k") <= F.floor((1 - floor) * F.col("n") + 1e-9) + 1).select("id", "t", "n")
    met = prefix.select(F.col("id").alias("a"), "t", F.col("n").alias("na")).join(prefix.select(F.col("id").alias("b"), "t", F.col("n").alias("nb")), "t")
    cand = met.where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= floor * F.greatest("na", "nb"))).select("a", "b").distinct()
    side = lambda c: forms.select(F.col("id").alias(c), F.col("g").alias(f"g_{c}"))
    both = cand.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", F.round(T.jaccard(F.col("g_a"), F.col("g_b")), 6))
    return both.where(F.col("similarity") >= floor).select("a", "b", "similarity")


def resolve_ladder(new: DataFrame, known: DataFrame, floor: float = 0.7, top: int = 3) -> DataFrame:
    """id, stage, matches for new names (id, name, supertype) against known ones (uuid, name, supertype):

    exact (normalised names equal, least uuid), candidates (up to `top` by Jaccard, of compatible types, left to a
    confirmation), none (too little information, or nothing similar).
    """
    n = new.select("id", T.normalized_name(F.col("name")).alias("n"), T.shingles(T.fuzzy_name(F.col("name"))).alias("g"), "supertype")
    k = known.select("uuid", T.normalized_name(F.col("name")).alias("n"), T.shingles(T.fuzzy_name(F.col("name"))).alias("kg"), F.col("supertype").alias("kt"))
    exact = n.where("n != ''").join(k.groupBy("n").agg(F.min("uuid").alias("uuid")), "n").select("id", "uuid")
    open_ = n.join(exact, "id", "left_anti").where(T.fuzzy_eligible(F.col("n")))
    met = minhash_bands(open_, "id", F.col("g")).join(minhash_bands(k.withColumnRenamed("kg", "g"), "uuid", F.col("g")), "band").select("id", "uuid").distinct()
    met = met.join(open_.select("id", "g", "supertype"), "id").join(k.select("uuid", "kg", "kt"), "uuid").withColumn("j", T.jaccard(F.col("g"), F.col("kg")))
    met = met.where((F.col("j") >= floor) & type_compatible(F.col("supertype"), F.col("kt")))
    w = Window.partitionBy("id").orderBy(F.desc("j"), "uuid")
    cand = met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "uuid"))), lambda x: x["uuid"]).alias("c"))
    out = n.select("id").join(exact, "id", "left").join(cand, "id", "left")
    return out.select("id", F.when(F.col("uuid").isNotNull(), "exact").when(F.col("c").isNotNull(), "candidates").otherwise("none").alias("stage"), F.when(F.col("uuid").isNotNull(), F.array("uuid")).otherwise(F.coalesce("c", F.array().cast("array<string>"))).alias("matches"))


def vector_resolution(sim: Column, new_below: float = 0.85, accept_from: float = 0.95) -> Column:
    return F.when(sim.isNull() | (sim < new_below), "new").when(sim >= accept_from, "accept").otherwise("confirm")


def collapse_aliases(entities: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Entities under their canonical names, one row per name with the longest summary. aliases is configuration."""
    m = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)) if aliases else F.create_map().cast("map<string,string>")
    named = entities.withColumn("name", F.coalesce(F.try_element_at(m, T.normalized_name(F.col("name"))), F.col("name")))
    return named.groupBy("name").agg(F.max_by("summary", F.struct(F.length(F.coalesce("summary", F.lit(""))), "summary")).alias("summary"))


def merge_summary(old: Column, new: Column) -> Column:
    """The longer summary that isn't empty; the old one on a tie."""
    return F.when(F.length(F.coalesce(new, F.lit(""))) > F.length(F.coalesce(old, F.lit(""))), new).otherwise(old)


def valid_facts(facts: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, entities): facts whose ends are declared and differ, within one group; entities some fact uses.
    Texts are cut at 2000, 1200, 200 and 100 characters."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    e = entities.select(key(F.col("name")).alias("k"), "group_id").distinct()
    side = lambda c: e.select(F.col("k").alias(f"k_{c}"), F.col("group_id").alias(f"g_{c}"))
    f = facts.withColumn("k_s", key(F.col("source"))).withColumn("k_t", key(F.col("target"))).join(side("s"), "k_s").join(side("t"), "k_t").where("g_s = g_t and k_s != k_t")
    used = f.select(F.col("k_s").alias("k")).union(f.select(F.col("k_t").alias("k"))).distinct()
    kept = entities.withColumn("k", key(F.col("name"))).join(used, "k", "left_semi").drop("k")
    cap = lambda c, n: F.substring(c, 1, n).alias(c)
    return f.select("source", "target", cap("name", 100), cap("fact", 2000)), kept.select(cap("name", 200), cap("summary", 1200), "group_id")


def similar_pairs(rows: DataFrame, ident: str, vec: str, floor: float, keep: list[str] | None = None, tables: int = 24, hot: int = 400) -> DataFrame:
    """a, b, sim (cosine at least `floor`) between ids, a < b.

    Equal vectors are one class of their least id. Candidates share a key of random hyperplane signs in one of
    `tables` tables, with as many signs as miss a pair at the floor with a probability of about 0.001; below a floor
    of 0.7 that is little better than comparing all, so such floors are for small tables. Keys shared by more than
    `hot` classes are refined to twice the signs in four times the tables, which misses as few. Verified exactly.
    """
    keep = keep or []
    bits = max(2, int(math.log(0.25) / math.log(1 - math.acos(floor) / math.pi)))
    v = rows.where(F.col(vec).isNotNull()).select(F.col(ident).alias("id"), F.col(vec).cast("array<double>").alias("v"), *keep)
    classes = cut(v.groupBy("v", *keep).agg(F.min("id").alias("id")))
    dims = F.size("v")

    def sign(seed: Column) -> Column:
        dotp = F.aggregate(F.zip_with("v", F.sequence(F.lit(1), dims), lambda x, i: x * (F.pmod(F.xxhash64(seed, i), F.lit(2000001)) - 1000000)), F.lit(0.0), lambda s, x: s + x)
        return F.when(dotp >= 0, F.lit(1)).otherwise(F.lit(0))

    def keyed(df: DataFrame, t: int, n: int) -> DataFrame:
        signs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: sign(b + t * 1000))
        return df.select("id", "v", *keep, F.xxhash64(F.lit(t), signs, *keep).alias("key"))

    bands = cut(reduce(DataFrame.unionByName, (keyed(classes, t, bits).select("id", "key") for t in range(tables))))
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    warm = bands.join(sizes.where(F.col("n") <= hot).select("key"), "key")
    pairs = warm.withColumnRenamed("id", "a").join(warm.withColumnRenamed("id", "b"), "key").where("a < b").select("a", "b")
    crowd = classes.join(bands.join(sizes.where(F.col("n") > hot).select("key"), "key", "left_semi").select("id").distinct(), "id", "left_semi")
    if not crowd.isEmpty():
        fine = cut(reduce(DataFrame.unionByName, (keyed(crowd, 100 + t, bits * 2).select("id", "key") for t in range(tables * 4))))
        pairs = pairs.unionByName(fine.withColumnRenamed("id", "a").join(fine.withColumnRenamed("id", "b"), "key").where("a < b").select("a", "b"))
    side = lambda c: classes.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}"))
    met = pairs.distinct().join(side("a"), "a").join(side("b"), "b").withColumn("sim", F.round(cosine(F.col("v_a"), F.col("v_b")), 6))
    return met.where(F.col("sim") >= floor).select("a", "b", "sim")


def time_band_matches(events: DataFrame, days: int, k: int, sim: Column, floor: float) -> DataFrame:
    """id, match, sim: up to k events of the same project within +-days of each event, at least `floor` similar.

    Joined on (project, bucket of `days`) and the two neighbouring buckets, so no project is compared as a whole.
    events: id, project, ts, source, and what sim needs as x and y columns (v).
    """
    span = days * 86_400
    rows = events.withColumn("_b", F.floor(F.unix_timestamp("ts") / span))
    left = rows.select(F.col("id"), "project", F.col("ts").alias("t"), F.col("v").alias("x"), F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
    right = rows.select(F.col("id").alias("match"), "project", F.col("ts").alias("u"), F.col("v").alias("y"), "_b")
    met = left.join(right, ["project", "_b"]).where((F.col("id") != F.col("match")) & (F.abs(F.unix_timestamp("t") - F.unix_timestamp("u")) <= span)).withColumn("sim", F.round(sim, 6)).where(F.col("sim") > floor)
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "match")
    return met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("id", "match", "sim")


def identifier_matches(events: DataFrame, hours: int = 72) -> DataFrame:
    """id, match: events that name the same issue or commit within +-hours, of the same project or without one."""
    ids = events.select("id", "project", "ts", F.explode(F.array_distinct(T.identifiers(F.coalesce("fact", F.lit(""))))).alias("ident"))
    a, b = ids.select("ident", F.col("id"), F.col("project").alias("p"), F.col("ts").alias("t")), ids.select("ident", F.col("id").alias("match"), F.col("project").alias("q"), F.col("ts").alias("u"))
    met = a.join(b, "ident").where("id < match").where(F.abs(F.unix_timestamp("t") - F.unix_timestamp("u")) <= hours * 3600)
    return met.where(F.col("p").isNull() | F.col("q").isNull() | (F.col("p") == F.col("q"))).select("id", "match").distinct()


def evidence_rollup(evidence: DataFrame) -> DataFrame:
    """candidate_id, judge_sessions, grounded_sessions, judge_weight, grounded_weight, score, scan_nights."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in GROUNDED.items() for x in kv))[F.col("signal")], F.lit(1.0))
    g = F.col("class") == "grounded"
    out = evidence.groupBy("candidate_id").agg(
        F.countDistinct(F.when(~g, F.nullif("session_id", F.lit("")))).alias("judge_sessions"), F.countDistinct(F.when(g, F.nullif("session_id", F.lit("")))).alias("grounded_sessions"),
        F.coalesce(F.sum(F.when(~g, 1.0)), F.lit(0.0)).alias("judge_weight"), F.coalesce(F.sum(F.when(g, weight)), F.lit(0.0)).alias("grounded_weight"),
        F.countDistinct(F.coalesce("scan_night", F.lit("-"))).alias("scan_nights"), F.max(F.trim(F.coalesce("quote", F.lit(""))) != "").alias("quoted"),
    )
    return out.withColumn("score", F.col("grounded_weight") + 0.5 * F.col("judge_weight"))


def passes_gate(kind: Column, score: Column, quoted: Column, salience: Column, nights: Column) -> Column:
    """Whether an observed candidate is proposed."""
    return F.coalesce(score >= 1.5, F.lit(False)) | ((kind == "retune") & quoted) | ((kind == "derive") & (F.coalesce(salience >= 4, F.lit(False)) | (nights >= 2)))


def union_evidence(old: DataFrame, new: DataFrame, keep: int = 60) -> DataFrame:
    """Evidence of both (candidate_id, seq, session_id, signal, class, scan_night, ...): the first of each key, then
    the last `keep` per candidate. new follows old."""
    rows = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    key = Window.partitionBy("candidate_id", "session_id", "signal", "class", "scan_night").orderBy("_n", "seq")
    rows = rows.withColumn("_r", F.row_number().over(key)).where("_r = 1")
    last = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("_n"), F.desc("seq")))
    return rows.withColumn("_l", last).where(F.col("_l") <= keep).drop("_n", "_r", "_l")


def _sets(d: DataFrame) -> DataFrame:
    """id, sessions, tokens as sorted sets; a null in a set is nothing, a row without one of the sets meets nobody."""
    sets = [F.sort_array(F.array_distinct(F.array_compact(c))).alias(c) for c in ("sessions", "tokens")]
    return d.where("id is not null and sessions is not null and tokens is not null").select("id", *sets)


def _classes(d: DataFrame) -> DataFrame:
    """id (of the class), own, sessions, tokens: rows with equal sets are one, own is the least id of them."""
    return cut(_sets(d).groupBy("sessions", "tokens").agg(F.min("id").alias("own")).withColumn("id", F.monotonically_increasing_id()))


def _elements(d: DataFrame) -> DataFrame:
    """id, kind, need, e: the elements of both sets. need: how many a match has in common with the set at least (two
    fifths of the sessions or three of the tokens), in whole numbers."""
    out = None
    for c, fifths in (("sessions", 2), ("tokens", 3)):
        rows = d.select("id", F.lit(c[0]).alias("kind"), F.floor((F.size(c) * fifths + 4) / 5).cast("int").alias("need"), F.explode(c).alias("e"))
        rows = rows.withColumn("e", F.concat("kind", F.lit(":"), "e"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _prefix(elements: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, e: of each set the elements with the fewest pairs, so many that a match has the first common one among them."""
    rows = elements.join(sizes, "e").groupBy("id", "kind", "need").agg(F.sort_array(F.collect_list(F.struct("pairs", "e"))).alias("es"))
    return rows.where("size(es) >= need").select("id", F.explode(F.slice("es", 1, F.size("es") - F.col("need") + 1)).alias("x")).select("id", "x.e")


def _common(left: pa.Table, right: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """How many elements each left row's set has in common with each right row's, and how many both have together."""
    sides = [t[name].combine_chunks() for t in (left, right)]
    sides = [s.chunk(0) if isinstance(s, pa.ChunkedArray) else s for s in sides]
    codes = pa.concat_arrays([pc.list_flatten(s) for s in sides]).dictionary_encode().indices
    codes = codes.to_numpy()
    rows = [pc.list_parent_indices(s).to_numpy() for s in sides]
    a, b = codes[: len(rows[0])], codes[len(rows[0]) :]
    size = np.add.outer(*(np.bincount(r, minlength=t.num_rows).astype(np.float64) for r, t in zip(rows, (left, right))))
    both = np.zeros((left.num_rows, right.num_rows), np.float32)
    most = codes.max(initial=-1) + 1
    na, nb = (np.bincount(c, minlength=most) for c in (a, b))
    often = na * nb * 64 > both.size
    for at in np.array_split(np.flatnonzero(often), math.ceil(often.sum() / 1024) or 1):  # by matrix, some columns at a time
        col = np.full(most, -1)
        col[at] = np.arange(len(at))
        hot = []
        for r, c, t in zip(rows, (a, b), (left, right)):
            m = np.zeros((t.num_rows, len(at)), np.float32)
            keep = col[c] >= 0
            m[r[keep], col[c][keep]] = 1
            hot.append(m)
        both += hot[0] @ hot[1].T
    seldom = (na > 0) & (nb > 0) & ~often
    keep = [seldom[c] for c in (a, b)]
    order = [np.argsort(c[k], kind="stable") for c, k in zip((a, b), keep)]
    split = [np.split(r[k][o], np.cumsum(n[seldom])[:-1]) if seldom.any() else [] for r, k, o, n in zip(rows, keep, order, (na, nb))]
    for x, y in zip(*split):
        both[np.ix_(x, y)] += 1
    return both, size - both


def _best(left: pa.Table, right: pa.Table) -> pa.Table:
    """id, match, rank: the best match of each left row within two blocks of rows."""
    right = right.sort_by("own")  # of equal ranks the first one stays
    met, rank, fits = np.zeros((left.num_rows, right.num_rows), bool), [], []
    for name in ("sessions", "tokens"):
        both, either = _common(left, right, name)
        met |= both > 0
        rank.append(both / np.maximum(either, 1))
        fits.append(pc.list_value_length(left[name]).to_numpy() > 0)
        fits.append(pc.list_value_length(right[name]).to_numpy() > 0)
    sj, tj = rank
    veto = np.logical_and.outer(fits[2], fits[3]) & (tj < 0.15)
    met &= ((sj >= 0.4) & ~veto) | (tj >= 0.6)
    best = np.where(met, np.maximum(sj, tj * 0.9), -1.0)
    at = best.argmax(axis=1)
    top = best[np.arange(len(at)), at]
    of = np.flatnonzero(top >= 0)
    return pa.table({"id": left["id"].take(pa.array(of)), "match": right["own"].take(pa.array(at[of])), "rank": top[of]})


def match_candidates(new: DataFrame, ledger: DataFrame, hot: int = HOT_PAIRS, block: int = BLOCK) -> DataFrame:
    """id, match: the ledger row a new candidate is: session overlap of at least 0.4, unless the signatures disagree
    (below 0.15), or signatures of at least 0.6; best by max(session, 0.9 signature). new, ledger: id, sessions, tokens.

    Equal rows are one class. Classes are met through the sessions or tokens that the overlap asks for, the rarest first.
    An element with more than `hot` pairs makes no pair rows: its classes are compared block by block, and only the best
    match of each class leaves a block. Where the hot elements together make more pairs than there are, their classes are
    compared once, whatever the element.
    """
    a, b = _classes(new), _classes(ledger)
    ea, eb = _elements(a), _elements(b)
    count = lambda x, n: x.groupBy("e").agg(F.count(F.lit(1)).alias(n))
    sizes = cut(count(ea, "n").join(count(eb, "m"), "e").select("e", (F.col("n") * F.col("m")).alias("pairs")))
    pa_, pb = cut(_prefix(ea, sizes)), cut(_prefix(eb, sizes))
    keys = cut(count(pa_, "n").join(count(pb, "m"), "e"))
    is_hot = F.col("n") * F.col("m") > hot
    cold = keys.where(~is_hot).select("e")
    cand = pa_.join(cold, "e").join(pb.select("e", F.col("id").alias("match")), "e").select("id", "match").distinct()
    met = cand.join(a.select("id", F.col("sessions").alias("s1"), F.col("tokens").alias("t1")), "id").join(b.select(F.col("id").alias("match"), "own", F.col("sessions").alias("s2"), F.col("tokens").alias("t2")), "match")
    some = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), T.jaccard(F.col(a), F.col(b))).otherwise(0.0)
    met = met.withColumn("sj", some("s1", "s2")).withColumn("tj", some("t1", "t2"))
    veto = (F.size("t1") > 0) & (F.size("t2") > 0) & (F.col("tj") < 0.15)
    met = met.where(((F.col("sj") >= 0.4) & ~veto) | (F.col("tj") >= 0.6)).select("id", F.col("own").alias("match"), F.greatest("sj", F.col("tj") * 0.9).alias("rank"))
    hot_keys = keys.where(is_hot)
    pairs = hot_keys.agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    if pairs:
        left, right = (p.join(hot_keys, "e").select("id", "e", "n", "m") for p in (pa_, pb))
        n, m = (x.select("id").distinct().count() for x in (left, right))
        if pairs > n * m:
            left, right = (x.select("id", F.lit("").alias("e"), F.lit(n).alias("n"), F.lit(m).alias("m")).distinct() for x in (left, right))
        parts = lambda c: F.ceil(F.col(c) / F.lit(block)).cast("int")
        mine = lambda c: F.pmod(F.xxhash64("id"), parts(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
        left = left.select("id", "e", mine("n").alias("i"), every("m").alias("j")).join(a, "id")
        right = right.select("id", "e", every("n").alias("i"), mine("m").alias("j")).join(b, "id")
        met = met.unionByName(left.groupBy("e", "i", "j").cogroup(right.groupBy("e", "i", "j")).applyInArrow(_best, f"id long, match {b.schema['own'].dataType.simpleString()}, rank double"))
    first = F.min(F.struct((-F.col("rank")).alias("r"), "match")).alias("m")
    found = a.join(met.groupBy("id").agg(first), "id").select("sessions", "tokens", "m")
    rows = _sets(new).join(found, ["sessions", "tokens"])
    return rows.groupBy("id").agg(F.min("m").getField("match").alias("match"))


def rule_tokens(c: Column, stop: list[str]) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(stop)))


def decayed(status: Column, last_seen: Column, now: Column, days: int = 28) -> Column:
    """Status after the time limit: only observed rows retire."""
    return F.when((status == "observe") & (last_seen < now - F.make_interval(days=F.lit(days))), "retired").otherwise(status)


def pair_verdict(first: Column, second: Column) -> Column:
    """The verdict of two judgements in swapped order: kept only if both agree ('duplicate', 'contradicts', 'distinct')."""
    return F.when(first == second, first).otherwise("disagree")


def retype_due(notes: DataFrame, memo: DataFrame) -> DataFrame:
    """Notes never judged, or updated after their judgement. memo: note_a, judged_at."""
    last = memo.groupBy("note_a").agg(F.max("judged_at").alias("judged_at"))
    return notes.join(last, notes["id"] == last["note_a"], "left").where("judged_at is null or judged_at < updated_at").drop("note_a", "judged_at")


def candidate_pools(pairs: DataFrame, semantic: DataFrame, most: int = 8) -> DataFrame:
    """new_id, uuid, pool, sim: candidates of new facts from the pair pool (same ends) and the semantic pool (new_id,
    uuid, rank, sim), the `most` first of the latter; one in both is in the pair pool."""
    own = pairs.select("new_id", "uuid", F.lit("pair").alias("pool"), "sim").distinct()
    w = Window.partitionBy("new_id").orderBy("rank", "uuid")
    near = semantic.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select("new_id", "uuid", F.lit("semantic").alias("pool"), "sim")
    return own.unionByName(near.join(own.select("new_id", "uuid"), ["new_id", "uuid"], "left_anti"))


def enforce_gate(new: DataFrame, candidates: DataFrame, high: float = 0.95, low: float = 0.70) -> DataFrame:
    """new_id, action, reinforce, ask for each new fact: skip (a merge candidate; all of them are reinforced), ask (only
    gray ones are left for a judge), insert (none left). candidates: new_id, uuid, sim."""
    from tidemark.operators.temporal import gate

    c = candidates.withColumn("d", gate(F.col("sim"), high, low)).groupBy("new_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("d") == "merge", F.col("uuid")))).alias("reinforce"), F.sort_array(F.collect_set(F.when(F.col("d") == "gray", F.col("uuid")))).alias("ask")
    )
    none = F.array().cast("array<string>")
    out = new.select("new_id").join(c, "new_id", "left").withColumn("reinforce", F.coalesce("reinforce", none)).withColumn("ask", F.coalesce("ask", none))
    skip = F.size("reinforce") > 0
    return out.select("new_id", F.when(skip, "skip").when(F.size("ask") > 0, "ask").otherwise("insert").alias("action"), "reinforce", F.when(skip, none).otherwise(F.col("ask")).alias("ask"))


def reconcile_note(new: DataFrame, near: DataFrame, floor: float = 0.80) -> DataFrame:
    """id, action, target_id: a new note (id, type, project) against near ones (id, note_id, type, sim, verdict): the
    nearest of its type from the floor on is the same (update), contradicted (supersede) or distinct (create) as judged;
    without one it is created."""
    best = near.where(F.col("sim") >= floor).join(new.select("id", F.col("type").alias("_t")), "id").where("type = _t")
    best = best.groupBy("id").agg(F.min_by(F.struct("note_id", "verdict"), F.struct(-F.col("sim"), "note_id")).alias("b"))
    action = F.when(F.col("b.verdict") == "same", "update").when(F.col("b.verdict") == "contradicts", "supersede").otherwise("create")
    return new.select("id").join(best, "id", "left").select("id", action.alias("action"), F.when(action != "create", F.col("b.note_id")).alias("target_id"))


def same_rule(new: DataFrame, rules: DataFrame, stop: list[str], floor: float = 0.5) -> DataFrame:
    """id, rule_id: the known rule a new one restates, by token Jaccard (0 for two empty ones); the first best."""
    el = lambda d, i, c: d.select(F.col("id").alias(i), rule_tokens(F.col("rule"), stop).alias(c))
    a, b = el(new, "id", "x"), el(rules, "rule_id", "y")
    cand = a.select("id", F.explode("x").alias("t")).join(b.select("rule_id", F.explode("y").alias("t")), "t").select("id", "rule_id").distinct()
    met = cand.join(a, "id").join(b, "rule_id").withColumn("j", T.jaccard(F.col("x"), F.col("y"), empty=0.0)).where(F.col("j") >= floor)
    return met.groupBy("id").agg(F.min_by("rule_id", F.struct(-F.col("j"), "rule_id")).alias("rule_id"))


def fired_histogram(fires: DataFrame, requests: DataFrame) -> DataFrame:
    """skill, fired, dismissed, asked: how often each skill fired, was rejected, and was asked for without firing."""
    f = fires.groupBy("skill").agg(F.count(F.lit(1)).alias("fired"), F.count_if("dismissed").alias("dismissed"))
    r = requests.join(fires.select("skill", "session_id").distinct(), ["skill", "session_id"], "left_anti").groupBy("skill").agg(F.count(F.lit(1)).alias("asked"))
    return f.join(r, "skill", "full_outer").fillna(0, ["fired", "dismissed", "asked"])
