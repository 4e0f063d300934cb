"""Problem 6: one surviving record per group of notes that state the same memory.

Notes of one owner and group belong together if they name the same things: the codes and numbers (tokens with a
digit) and the rare words of hook and body. The test table fixes which member supplies a field, so survivors() takes
the values by that order; fuse() is the estimator for fields without such an order: Bayesian fusion of the members'
claims, with source accuracies and copying between sources estimated from the shared minority values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textnorm import fold, strip_markup
from tidemark.session import cut

FIELDS = ["project", "type", "hook", "body", "source_ref"]
# What stands for nothing, lower case.
STAND_INS = [
    "", "(empty)", "(leer)", "(nada)", "(none)", "(null)", "(see body)", "(see hook)", "(siehe hook)", "(unknown)", "-", "--", "---",
    "...", "?", "??", "???", "[empty]", "[none]", "_", "empty", "keine", "kein", "leer", "missing", "n.a.", "n/a", "na", "nan", "nada", "nil",
    "ninguno", "none", "not available", "not set", "null", "s/d", "see above", "see body", "see hook", "sin datos", "tba", "tbd", "todo",
    "unbekannt", "undefined", "unknown", "unset", "xxx", "…", "–", "—",
]
# Words that carry nothing of a memory wherever they stand.
FUNCTION_WORDS = {
    "again", "also", "and", "aber", "auch", "bei", "but", "das", "der", "die", "eh", "ein", "eine", "einfach", "el", "es", "for", "from",
    "fwd", "is", "ist", "it", "just", "la", "las", "los", "mit", "nur", "of", "oder", "ok", "okay", "only", "or", "para", "pero", "please", "pues",
    "quite", "re", "really", "repost", "resent", "retry", "solo", "still", "tambien", "the", "then", "this", "to", "und", "very", "was", "well",
    "with", "y",
}
#: A word found in at least this share of all (owner, group) pairs, and in at least 3, is no name.
COMMON = 0.005
_TOKEN = regex.compile(r"[^\W_]+(?:[-.][^\W_]+)*")
_HYPHENS = {ord(c): "-" for c in "‐‑‒–—−"}


def filled(c: Column) -> Column:
    """Not null, blank or a stand-in for nothing."""
    plain = F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}\p{Cf}]+", " ")))
    return F.coalesce(~plain.isin(STAND_INS), F.lit(False))


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(fold(strip_markup(text).translate(_HYPHENS))) if text else []


def _tokens(notes: DataFrame) -> DataFrame:
    """One row per note with the token sets of its filled hook and body; redelivered rows count once."""
    rows = notes.where(F.col("id").isNotNull()).select("id", "owner_id", "group_id", F.when(filled(F.col("hook")), F.col("hook")).alias("hook"), F.when(filled(F.col("body")), F.col("body")).alias("body")).dropDuplicates(["id"])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, b = [sorted(set(tokens(x))) for x in pdf["hook"]], [sorted(set(tokens(x))) for x in pdf["body"]]
            yield pdf[["id", "owner_id", "group_id"]].assign(hook=h, body=b)

    return rows.mapInPandas(make, "id long, owner_id string, group_id string, hook array<string>, body array<string>")


def note_groups(notes: DataFrame, common: float = COMMON) -> DataFrame:
    """id, key: notes with an equal key state the same memory.

    A full note is known by its entities, the tokens of both hook and body that hold a digit or are rare in the
    corpus: key = hash of owner, group and entities. A note with one side left blank takes the key of the full notes
    of its owner and group whose entities it all contains (the largest such set); if there are none, its own digits
    and rare words are its entities. Keys are compared by hash, no pairs of notes are made, so a group of copies of
    any size is a plain aggregation. Notes with no entity at all are the same if all their words are.
    """
    rows = cut(_tokens(notes))
    place = F.struct("owner_id", "group_id")
    df = rows.select(F.explode(F.array_distinct(F.concat("hook", "body"))).alias("t"), place.alias("p")).distinct().groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    places = rows.select(place.alias("p")).distinct().agg(F.count(F.lit(1)).alias("places"))
    # frequent words only: at most 1 / common times the mean number of words, whatever the corpus
    frequent = df.withColumn("places", places.scalar()).where((F.col("n") >= 3) & (F.col("n") >= F.col("places") * common) & ~F.col("t").rlike(r"\d")).select("t")
    words = rows.select("id", "owner_id", "group_id", F.explode(F.array_distinct(F.concat("hook", "body"))).alias("t"), "hook", "body")
    words = words.select(
        "id", "owner_id", "group_id", "t", F.array_contains("hook", F.col("t")).alias("h"), F.array_contains("body", F.col("t")).alias("b"),
        (F.size("hook") > 0).alias("has_h"), (F.size("body") > 0).alias("has_b"),
    ).where(~F.col("t").isin(sorted(FUNCTION_WORDS)) & (F.length("t") > 1))
    rare = words.join(frequent, "t", "left_anti")
    full = F.col("has_h") & F.col("has_b")
    own = rare.where(~full | (F.col("h") & F.col("b"))).groupBy("id").agg(F.sort_array(F.collect_set("t")).alias("e"))
    base = rows.join(own, "id", "left").select(
        "id", "owner_id", "group_id", F.coalesce("e", F.array().cast("array<string>")).alias("e"), ((F.size("hook") > 0) & (F.size("body") > 0)).alias("full"),
        F.array_sort(F.array_distinct(F.concat("hook", "body"))).alias("all"),
    )
    base = cut(base)
    # distinct entity sets of full notes meet the notes with a blank side at one of their entities
    known = base.where(F.col("full") & (F.size("e") > 0)).select("owner_id", "group_id", "e").distinct()
    part = base.where(~F.col("full") & (F.size("e") > 0))
    code = F.element_at(F.filter("e", lambda x: x.rlike(r"\d")), 1)
    sets = known.select("owner_id", "group_id", F.col("e").alias("known"), F.coalesce(code, F.element_at("e", 1)).alias("t"))
    met = part.select("id", "owner_id", "group_id", "e", F.explode("e").alias("t")).join(sets, ["owner_id", "group_id", "t"])
    met = met.where(F.size(F.array_except("known", "e")) == 0)
    best = met.groupBy("id").agg(F.max(F.struct(F.size("known").alias("n"), "known")).getField("known").alias("known"))
    final = base.join(best, "id", "left").withColumn("e", F.coalesce("known", "e"))
    key = F.xxhash64("owner_id", "group_id", F.when(F.size("e") > 0, F.to_json("e")).otherwise(F.to_json("all")), F.size("e") == 0)
    return final.where((F.size("e") > 0) | (F.size("all") > 0)).select("id", key.alias("key"))


def suppliers(notes: DataFrame) -> DataFrame:
    """group_min_id, field, note_id, value: who supplies each field of each group of two or more notes.

    Among members with the field filled: superseded_by null first, then later updated_at (null last), then larger id.
    Maxima of structs, so aggregation is partial and a huge group is no single task.
    """
    rows = notes.select("id", "superseded_by", "updated_at", *FIELDS).dropDuplicates(["id"]).join(note_groups(notes), "id")
    best = [
        F.max(F.when(filled(F.col(f)), F.struct(F.col("superseded_by").isNull().alias("live"), F.coalesce(F.col("updated_at").cast("timestamp"), F.lit("0001-01-02").cast("timestamp")).alias("at"), "id", F.col(f).alias("value")))).alias(f)
        for f in FIELDS
    ]
    groups = rows.groupBy("key").agg(F.min("id").alias("group_min_id"), F.count(F.lit(1)).alias("n"), *best).where("n > 1")
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("s")) for f in FIELDS)))
    return groups.select("group_min_id", fields.alias("x")).where("x.s is not null").select("group_min_id", "x.field", F.col("x.s.id").alias("note_id"), F.col("x.s.value").alias("value"))


def survivors(notes: DataFrame) -> DataFrame:
    """The surviving record of each group: group_min_id and the five fields (null where no member has a value)."""
    return suppliers(notes).groupBy("group_min_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS))


#: Values a field could wrongly have, chance that a copier copies, prior chance that one source copies another.
FALSE_VALUES, COPY, PRIOR = 20, 0.8, 0.1


def claims(notes: DataFrame, keys: DataFrame) -> DataFrame:
    """obj (group key), field, source, value: what each source says of each group of keys (id, key). The source of a note
    is the kind of its source_ref with its embed_model; repeated claims of one source are one."""
    rows = notes.select("id", "embed_model", *FIELDS).join(keys.select("id", "key"), "id").dropDuplicates(["id"])
    ref = F.when(filled(F.col("source_ref")), F.substring_index("source_ref", ":", 1)).otherwise("-")
    rows = rows.withColumn("source", F.concat_ws("/", F.coalesce("embed_model", F.lit("-")), ref))
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.when(filled(F.col(f)), F.col(f)).alias("value")) for f in FIELDS)))
    out = rows.select(F.col("key").alias("obj"), "source", fields.alias("x")).select("obj", "source", "x.field", "x.value").where("value is not null")
    return out.distinct()


def fuse(said: DataFrame, rounds: int = 4) -> DataFrame:
    """obj, field, value, confidence: the value of maximum posterior of each object and field.

    said: obj, field, source, value. In turns, values are scored by the accuracies of their sources, accuracies are the
    mean posterior of a source's claims, and sources that share more minority values than their accuracies explain are
    taken for copies: a vote counts less for every more accurate source of the same value it may have copied from.
    Sources are kinds of origin, not records: an object has at most one claim per source and field whatever its number of
    records, and what the driver sees is one row per source and one per pair of sources that meet. Where every user is a
    source of its own, give their groups instead.
    """
    said = cut(said.select("obj", "field", "source", "value").distinct())
    accuracy = {r.source: 0.8 for r in said.select("source").distinct().collect()}
    # before anything is known of values, agreement alone tells copies from independent sources
    copied = _copies(said.withColumn("p", F.lit(1.0)), accuracy)
    scored = None
    for _ in range(rounds):
        scored = cut(_posterior(said, accuracy, copied))
        each = said.join(scored, ["obj", "field", "value"])
        accuracy = {r.source: min(0.99, max(0.01, r.a)) for r in each.groupBy("source").agg(F.avg("p").alias("a")).collect()}
        copied = _copies(each, accuracy)
    if scored is None:
        return said.select("obj", "field", "value", F.lit(None).cast("double").alias("confidence"))
    best = scored.groupBy("obj", "field").agg(F.max(F.struct("p", "value")).alias("b"))
    return best.select("obj", "field", "b.value", F.round("b.p", 6).alias("confidence"))


def _posterior(said: DataFrame, accuracy: dict[str, float], copied: dict[tuple[str, str], float]) -> DataFrame:
    @F.pandas_udf("double")
    def votes(sources: pd.Series) -> pd.Series:
        def one(names) -> float:
            total, before = 0.0, []
            for s in sorted(names, key=lambda x: (-accuracy.get(x, 0.5), x)):
                own = 1.0
                for t in before:
                    own *= 1 - COPY * copied.get((min(s, t), max(s, t)), 0.0)
                a = accuracy.get(s, 0.5)
                total += own * math.log(FALSE_VALUES * a / (1 - a))
                before.append(s)
            return total

        return sources.map(one)

    values = said.groupBy("obj", "field", "value").agg(F.collect_set("source").alias("s")).select("obj", "field", "value", votes("s").alias("c"))
    peak = values.groupBy("obj", "field").agg(F.max("c").alias("m"), F.count(F.lit(1)).alias("k"))
    mass = values.join(peak, ["obj", "field"]).withColumn("e", F.exp(F.col("c") - F.col("m")))
    total = mass.groupBy("obj", "field").agg((F.sum("e") + F.greatest(F.lit(FALSE_VALUES + 1) - F.max("k"), F.lit(0)) * F.exp(-F.max("m"))).alias("t"))
    return mass.join(total, ["obj", "field"]).select("obj", "field", "value", (F.col("e") / F.col("t")).alias("p"))


def _copies(each: DataFrame, accuracy: dict[str, float]) -> dict[tuple[str, str], float]:
    """The posterior that one of two sources copies the other."""
    left, right = (each.select("obj", "field", F.col("source").alias(c), F.col("value").alias(f"v{c}"), F.col("p").alias(f"p{c}")) for c in "ab")
    both = left.join(right, ["obj", "field"]).where("a < b")
    same = F.col("va") == F.col("vb")
    seen = both.groupBy("a", "b").agg(F.sum(F.when(same, F.col("pa")).otherwise(0.0)).alias("t"), F.sum(F.when(same, 1 - F.col("pa")).otherwise(0.0)).alias("f"), F.sum(F.when(~same, 1.0).otherwise(0.0)).alias("d")).collect()
    out = {}
    for r in seen:
        x, y = accuracy[r.a], accuracy[r.b]
        true, false = x * y, (1 - x) * (1 - y) / FALSE_VALUES
        z = max(x, y)
        ratio = (
            r.t * math.log((z * COPY + true * (1 - COPY)) / true) + r.f * math.log(((1 - z) * COPY + false * (1 - COPY)) / false) + r.d * math.log(1 - COPY)
        )
        out[r.a, r.b] = 1 / (1 + (1 - PRIOR) / PRIOR * math.exp(-max(-50.0, min(50.0, ratio))))
    return out


def fused(notes: DataFrame) -> DataFrame:
    """group_min_id, field, value, confidence for groups of two or more notes. Groups of one have nothing to fuse and
    tell nothing of copies, so they stay out."""
    keys = cut(note_groups(notes))
    groups = cut(keys.groupBy("key").agg(F.min("id").alias("group_min_id"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    said = claims(notes, keys.join(groups, "key"))
    return fuse(said).join(groups, F.col("obj") == F.col("key")).select("group_min_id", "field", "value", "confidence")
