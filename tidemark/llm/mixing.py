"""Problem 9: sources mixed to target weights.

Membership. A document whose source is known belongs to it. One with a null source gets posteriors over all sources from
a naive Bayes classifier of its make-up (line starts, shapes and counts), fitted on a bounded sample of labelled documents (MAX_LABELLED, by
hash of the id). So every document contributes expected tokens to the domains of a mix.

Rates. Every document has a rate between 0 and its cap, max_repeats of its source, or the least one of the mix where the
source is only estimated. Projected gradient steps minimise the squared relative distance between expected and target
tokens of all domains of a mix. Documents with equal memberships have equal rates, so they are aggregated to membership
profiles first: one per known source, and one per distinct posterior (in sixteenths) of the estimated ones. The steps run
over those profiles, so every document has the rate that steps over single documents would give it. The size of a mix is the largest at which every domain can reach its share: the least of max_repeats *
tokens / share; if no domain of a mix has a limit, each of its documents occurs at least once.

Selection. A rate of 2.3 means two occurrences of every document and a third one of documents with 30 % of the tokens.
Which ones is decided by a hash of the document: tokens are summed in BINS hash ranges per source, ranges below the
wanted amount are taken whole, and within the one range where it is reached documents are taken while they fit. What is
left open then is closed by the one document of nearest length. Documents of estimated source are taken by their hash
with the probability of the rate's fraction.

Sources not in a mix are no part of it; shares of the domains with documents are scaled up, those without are reported
with 0 tokens. Weights that are null, NaN or not positive, and max_repeats below 1, leave a source out. Documents without
tokens are not selected.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.encoding import Encoder, chunks, lexicon, vocabulary
from tidemark.session import cut

#: Hash ranges per source: the range in which documents are taken one by one holds a BINS-th of a source.
BINS = 4096
STEPS = 12
#: Labelled documents used for the fit at most.
MAX_LABELLED = 6000
#: The membership of an estimate, whatever the order of its map.
PROFILE = "to_json(array_sort(map_entries(estimate)))"
_WORD = re.compile(r"[^\W\d_]+")
_START = re.compile(r"^\s*(\S{1,12})", re.M)


def _features(text: str) -> list[str]:
    """What a text is made of, not what it is about: how lines begin, how many there are, and how long they run."""
    lines = [x for x in text.split("\n") if x.strip()]
    starts = {"^" + re.sub(r"\d+", "0", s) for s in _START.findall(text)}
    shapes = {"~" + re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "0", x.strip()[:12])) for x in lines}
    sizes = [f"lines {len(lines).bit_length()}", f"blank {text.count(chr(10) * 2).bit_length()}", f"words {len(_WORD.findall(text)).bit_length()}", f"marks {len(re.findall('[.!?]', text)).bit_length()}"]
    return [*starts, *shapes, *sizes * 2]


class Sources:
    """Naive Bayes over the sources: posteriors of a text, sharpened by the root of its length only."""

    def __init__(self, docs: list[tuple[str, str]]):
        self.names = sorted({s for _, s in docs})
        place = {s: i for i, s in enumerate(self.names)}
        counts: dict[str, np.ndarray] = {}
        self.prior = np.ones(len(self.names))
        for text, s in docs:
            self.prior[place[s]] += 1
            for f, n in Counter(_features(text)).items():
                counts.setdefault(f, np.zeros(len(self.names)))[place[s]] += n
        kept = [f for f, c in counts.items() if c.sum() >= 3]
        self.index = {f: i for i, f in enumerate(kept)}
        table = np.array([counts[f] for f in kept]).reshape(len(kept), len(self.names)) + 0.1
        self.table = np.log(table / table.sum(axis=0))
        self.prior = np.log(self.prior / self.prior.sum())

    def posterior(self, text: str | None) -> np.ndarray:
        """Of each name; the prior where nothing is known of the text."""
        at = [self.index[f] for f in _features(text or "") if f in self.index]
        z = self.prior.copy()
        if at:
            z += self.table[at].sum(axis=0) / math.sqrt(len(at))
        z = np.exp(z - z.max()) if len(z) else z
        return z / z.sum() if len(z) else z


def classifier(documents: DataFrame, max_labelled: int = MAX_LABELLED) -> Sources:
    """Fitted on at most max_labelled documents with a source and a text, chosen by a hash of the id."""
    rows = documents.where("doc_id is not null and source is not null and length(text) > 0").select("doc_id", "source", "text")
    sample = rows.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_labelled)
    return Sources([(r["text"], r["source"]) for r in sorted(sample.collect(), key=lambda r: r["doc_id"])])


def count(documents: DataFrame, model: Sources, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, source, tokens, estimate (source -> share in sixteenths, null where the source is known). One scan of the
    texts besides that of the lexicon; only documents without a source are classified."""
    words, path = lexicon(documents, "text", ranks), vocabulary(ranks)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by max_labelled documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, m = Encoder.get(words, path), shared.value
        for batch in batches:
            texts, known = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            n = np.concatenate([enc.encode(texts[lo:hi], ids=False)[0] for lo, hi in chunks(texts)] or [np.zeros(0, np.int64)])
            soft = []
            for t, s in zip(texts, known):
                p = np.round(m.posterior(t) * 16).astype(int) if s is None and t else []
                soft.append([(m.names[i], int(p[i])) for i in np.flatnonzero(p)] if len(p) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(soft, pa.map_(pa.string(), pa.int32()))], names=["doc_id", "source", "tokens", "estimate"])

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), "source", F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, source string, tokens long, estimate map<string,int>")


def _targets(targets: DataFrame) -> DataFrame:
    """One row per mix and source: weights of repeated rows add up once."""
    rows = targets.where("mix is not null and source is not null and weight > 0 and not isnan(weight) and (max_repeats is null or max_repeats >= 1)")
    return rows.select("mix", "source", F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("max_repeats")).distinct().groupBy("mix", "source").agg(
        F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats")
    )


def _goals(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """mix, source, share, goal (tokens), have, max_repeats: a bounded table, one row per target."""
    rows = _targets(targets).join(totals, "source")
    by = Window.partitionBy("mix")  # rows of a mix are sources, not documents
    rows = rows.withColumn("share", F.col("weight") / F.sum("weight").over(by))
    reach = F.min(F.col("max_repeats") * F.col("have") / F.col("share")).over(by)
    free = F.max(F.col("have") / F.col("share")).over(by)
    return rows.select("mix", "source", "share", (F.coalesce(reach, free) * F.col("share")).alias("goal"), "have", "max_repeats")


class Rates:
    """Rates of membership profiles in one mix after projected gradient steps: force holds the sum of the steps' pulls per
    domain between projections, so the rate of any profile follows from it and the profile alone."""

    def __init__(self, goals: dict[str, float], have: dict[str, float], caps: dict[str, float]):
        self.goals, self.have, self.caps = goals, have, caps
        self.pulls: list[dict[str, float]] = []

    def cap(self, source: str | None) -> float:
        return self.caps[source] if source is not None else min(self.caps.values(), default=0.0)

    def rate(self, source: str | None, member: dict[str, float]) -> float:
        x, top = 0.0, self.cap(source)
        for pull in self.pulls:
            x = min(top, max(0.0, x + sum(p * pull.get(s, 0.0) for s, p in member.items())))
        return x

    def step(self, profiles: list[tuple[str | None, dict[str, float], float]]) -> None:
        """One gradient step of the squared relative distances, scaled by what a unit rate of the domain weighs."""
        expected = Counter()
        for source, member, tokens in profiles:
            x = self.rate(source, member)
            for s, p in member.items():
                if s in self.goals:
                    expected[s] += x * p * tokens
        self.pulls.append({s: (g - expected[s]) / self.have[s] for s, g in self.goals.items()})


def fit(counts: DataFrame, targets: DataFrame, steps: int = STEPS) -> tuple[dict[str, Rates], list[tuple]]:
    """Rates of every mix, and the goals as rows. What comes to the driver is one row per target and per profile."""
    counts = counts.where("tokens > 0")
    totals = cut(counts.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("have")))
    goals = [tuple(r) for r in _goals(totals, targets).collect()]
    guessed = counts.where("source is null and estimate is not null")
    profiles = [(r["source"], {r["source"]: 1.0}, float(r["have"])) for r in totals.join(_targets(targets).select("source").distinct(), "source").collect()]
    member: dict[str, dict[str, float]] = {}
    for r in guessed.groupBy(F.expr(PROFILE).alias("profile")).agg(F.sum("tokens").alias("n")).orderBy("profile").collect():
        member[r["profile"]] = {e["key"]: e["value"] / 16 for e in json.loads(r["profile"])}
        profiles.append((None, member[r["profile"]], float(r["n"])))
    out = {}
    for mix in sorted({g[0] for g in goals}):
        mine = [g for g in goals if g[0] == mix]
        rates = Rates({g[1]: g[3] for g in mine}, {g[1]: float(g[4]) for g in mine}, {g[1]: float("inf") if g[5] is None else float(g[5]) for g in mine})
        own = [p for p in profiles if p[0] is None or p[0] in rates.goals]
        for _ in range(steps):
            rates.step(own)
        rates.soft = {p: rates.rate(None, m) for p, m in member.items()}
        rates.hard = {g[1]: rates.rate(g[1], {g[1]: 1.0}) for g in mine}
        out[mix] = rates
    return out, goals


def select(documents: DataFrame, targets: DataFrame, bins: int = BINS, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """mix, doc_id, source, tokens, repeats, estimate: the documents of each mix and how often each occurs."""
    return select_counted(cut(count(documents, classifier(documents), ranks)), targets, bins)


def select_counted(counts: DataFrame, targets: DataFrame, bins: int = BINS) -> DataFrame:
    """select() for documents whose tokens are known: doc_id, source, tokens, estimate (optional)."""
    spark = counts.sparkSession
    if "estimate" not in counts.columns:
        counts = counts.withColumn("estimate", F.lit(None).cast("map<string,int>"))
    counts = counts.where("tokens > 0")
    rates, goals = fit(counts, targets)
    hard = [(mix, s, int(x + 1e-9), max(0.0, x - int(x + 1e-9))) for mix, r in rates.items() for s, x in r.hard.items()]
    soft = [(mix, p, x) for mix, r in rates.items() for p, x in r.soft.items() if x > 0]
    plan = spark.createDataFrame(hard, "mix string, source string, whole int, part double")  # one row per target
    place = F.xxhash64("doc_id", F.lit(9))
    docs = counts.select("doc_id", "source", "tokens", "estimate", F.pmod(place, F.lit(bins)).cast("int").alias("bin"), place.alias("h"))
    known = docs.where("source is not null").drop("estimate")
    sums = known.groupBy("source", "bin").agg(F.sum("tokens").alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bin"))).withColumn("have", F.sum("n").over(Window.partitionBy("source")))  # at most `bins` rows a source
    edge = upto.join(F.broadcast(plan), "source").withColumn("want", F.col("part") * F.col("have")).where(F.col("upto") > F.col("want"))
    edge = cut(edge.groupBy("mix", "source").agg(F.max("whole").alias("whole"), F.min(F.struct("bin", (F.col("want") - F.col("upto") + F.col("n")).alias("left"))).alias("e")).select("mix", "source", "whole", F.col("e.bin").alias("edge"), F.col("e.left").alias("left")))
    met = known.join(F.broadcast(edge), "source")  # one row per target
    cum = F.sum("tokens").over(Window.partitionBy("mix", "source", "bin").orderBy("h", "doc_id"))
    at_edge = met.where("bin = edge").withColumn("more", (cum <= F.col("left")).cast("int"))
    taken = met.where("bin != edge").withColumn("more", (F.col("bin") < F.col("edge")).cast("int")).unionByName(at_edge)
    taken = cut(taken.select("mix", "doc_id", "source", "tokens", "whole", "more", "edge", "left", "bin"))
    # the document of nearest length closes what is left open
    got = taken.where("bin = edge").groupBy("mix", "source").agg((F.max("left") - F.sum(F.col("tokens") * F.col("more"))).alias("open"))
    near = taken.where("more = 0").join(F.broadcast(got), ["mix", "source"]).where(F.abs(F.col("tokens") - F.col("open")) < F.col("open"))
    last = near.groupBy("mix", "source").agg(F.min(F.struct(F.abs(F.col("tokens") - F.col("open")).alias("d"), "doc_id")).getField("doc_id").alias("last"))
    full = taken.join(F.broadcast(last), ["mix", "source"], "left").withColumn("repeats", F.col("whole") + F.col("more") + F.coalesce((F.col("doc_id") == F.col("last")).cast("int"), F.lit(0)))
    out = full.where("repeats > 0").select("mix", "doc_id", "source", "tokens", "repeats", F.lit(None).cast("map<string,int>").alias("estimate"))
    if soft:
        unit = (F.col("h").cast("double") / F.lit(2.0**64)) + 0.5
        by_profile = spark.createDataFrame(soft, "mix string, profile string, rate double")
        guess = docs.where("source is null and estimate is not null").withColumn("profile", F.expr(PROFILE)).join(by_profile, "profile")
        repeats = F.floor("rate").cast("int") + (unit < F.col("rate") - F.floor("rate")).cast("int")
        out = out.unionByName(guess.select("mix", "doc_id", "source", "tokens", repeats.alias("repeats"), "estimate").where("repeats > 0"))
    # a repeated doc_id counts once
    return out.dropDuplicates(["mix", "doc_id"])


def shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """mix, source, target_share, documents, occurrences, tokens, expected (tokens with those of estimated source),
    share (of the expected tokens), max_repeats, most_repeats: what was reached.

    target_share is the share after domains without documents are taken out, 0 for those. Every source of a mix has a row.
    """
    of = F.col("tokens") * F.col("repeats")
    hard = selected.where("source is not null").groupBy("mix", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("repeats").alias("occurrences"), F.sum(of).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    soft = selected.where("source is null").select("mix", of.alias("n"), F.explode("estimate").alias("source", "p")).groupBy("mix", "source").agg(F.sum(F.col("n") * F.col("p") / 16).alias("soft"))
    out = _targets(targets).join(hard, ["mix", "source"], "left").join(soft, ["mix", "source"], "left").fillna(0, ["documents", "occurrences", "tokens", "most_repeats", "soft"])
    by = Window.partitionBy("mix")
    weight = F.when(F.col("tokens") > 0, F.col("weight")).otherwise(0.0)
    expected = F.col("tokens") + F.col("soft")
    part = lambda x: F.when(F.sum(x).over(by) > 0, x / F.sum(x).over(by)).otherwise(0.0)
    return out.select("mix", "source", part(weight).alias("target_share"), "documents", "occurrences", "tokens", expected.alias("expected"), part(expected).alias("share"), "max_repeats", "most_repeats")
