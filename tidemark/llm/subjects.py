"""Problem 10: the subject areas of each document.

Weighted terms (words and word pairs) of each subject are curated from the labelled table: a term counts for a subject
if it is met there far more often than elsewhere; figures of speech are met everywhere and so weigh nothing. The terms
form one multi-pattern automaton. Each prose sentence of a document is matched against it; the sum of the weights of
its terms, scaled by their rarity in the corpus and by the length of the sentence, names the sentence's subject if it
exceeds a threshold calibrated on the labels. A document has every subject that at least a quarter of its sentences
are about.

The fit runs on the driver over a bounded sample of labelled documents (MAX_LABELLED, by hash of the id); rarity and the
share of a term's use that falls to a subject are counted over all documents with sentences. Terms are weighed in Spark,
and of those with a weight the MAX_TERMS heaviest make the model, whose size is thereby bounded. Texts are cut into
sentences once; the two passes after that read the sentences. Null, empty and blank texts and bare machine output have
no subject.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch

#: Labelled documents used for the fit at most, and terms with a weight kept at most.
MAX_LABELLED, MAX_TERMS = 6000, 200_000
#: Share of a document's sentences that makes a subject.
SHARE = 0.25
#: Passes over the corpus that extend the terms.
EXPANSIONS = 1
_LINE = re.compile(r"^\s*(?:(?:Human|Assistant|User|System|Preference|Note|Summary)[^:\n]{0,80}:|\[\d+\]|\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d)?)?|[-*•>]+|\d{1,3}[.)])\s*", re.I)
_SKIP = re.compile(r"^\s*(?:#|\$ |Links:|https?://|[{}\]<|]|\[[{\[\"]|```|---|Web search results|Traceback|at \w+ ?\()")
_SENT = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
# Words that prose of en, de, es can hardly do without.
_GLUE = frozenset("""a after an and are as at be before but by can des de der das dem den die du ein eine el en es for from für geht gesagt had has have he how im in is ist it
keine la las le lo los más me mit my nach nicht no noch not nothing of on one only or para per por que se she should sich sin so sobre still than that the there they this to two und
une very von was we were what when which while who why will wir with wurde würde y you zu zuerst""".split())  # fmt: skip


def sentences(text: str) -> list[list[str]]:
    """The prose sentences of a text as lower-case words: at least four words, one of them a function word."""
    out = []
    for line in text.split("\n"):
        line = _LINE.sub("", line)
        if _SKIP.match(line):
            continue
        for s in _SENT.split(line):
            w = [x.casefold() for x in _WORD.findall(s)]
            if len(w) >= 4 and "=" not in s and not _GLUE.isdisjoint(w):
                out.append(w)
    return out


def _terms(words: list[str]) -> set[str]:
    return {w for w in words if len(w) > 2} | {f"{a} {b}" for a, b in zip(words, words[1:])}


class Model:
    """Terms with a weight per subject, and the threshold of a sentence."""

    def __init__(self, subjects: list[str], weights: dict[str, dict[int, float]], threshold: float = 0.0, scaled: bool = False):
        """scaled: the weights hold the rarity of their terms already."""
        self.subjects, self.weights, self.threshold, self.scaled = subjects, weights, threshold, scaled
        self._auto = None

    def __getstate__(self):
        return {"subjects": self.subjects, "weights": self.weights, "threshold": self.threshold, "scaled": self.scaled, "_auto": None}

    def automaton(self):
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for t, w in self.weights.items():
                self._auto.add_word(f" {t} ", tuple(w.items()))
            self._auto.make_automaton()
        return self._auto

    def subject(self, words: list[str]) -> tuple[int, float]:
        """The best subject of a sentence and by how much it leads, per square root of the words."""
        score: dict[int, float] = defaultdict(float)
        if self.weights:
            for _, ws in self.automaton().iter(" " + " ".join(words) + " "):
                for s, w in ws:
                    score[s] += w
        if not score:
            return -1, 0.0
        top = sorted(score.values(), reverse=True)
        best = max(score, key=score.get)
        return best, (top[0] - (top[1] if len(top) > 1 else 0.0)) / math.sqrt(len(words))

    def shares(self, ss: list[list[str]]) -> dict[int, float]:
        """Share of the prose sentences about each subject."""
        hits = Counter()
        for w in ss:
            s, lead = self.subject(w)
            if s >= 0 and lead >= self.threshold:
                hits[s] += 1
        return {s: n / len(ss) for s, n in hits.items()}


def _weigh(counts: dict[str, Counter], totals: Counter, k: int, rarity: dict[str, float] | None = None) -> dict[str, dict[int, float]]:
    out = {}
    for t, c in counts.items():
        n = sum(c.values())
        if n < 2:
            continue
        rate = {s: (v / totals[s]) for s, v in c.items()}
        total = sum(rate.values())
        best = max(rate, key=rate.get)
        # share of the term's use that falls to the subject, shrunk towards even shares where it is rarely seen
        p = (rate[best] / total * n + 1.0 / k * 2) / (n + 2)
        if p >= 0.55:
            out[t] = {best: math.log(p * k) * (rarity.get(t, 1.0) if rarity else 1.0)}
    if len(out) > MAX_TERMS:
        keep = sorted(out, key=lambda t: (-max(out[t].values()) * math.log1p(sum(counts[t].values())), t))[:MAX_TERMS]
        out = {t: out[t] for t in keep}
    return out


def fit(docs: list[tuple[str, list[str]]], subjects: list[tuple[str, str]], rounds: int = 2) -> Model:
    """A model from (text, labels) pairs and the subjects with their scope, whose words count as one mention."""
    names = [s for s, _ in subjects]
    index = {s: i for i, s in enumerate(names)}
    seeds = [(index[s], w) for s, scope in subjects for w in [[s.casefold(), *(x.casefold() for x in _WORD.findall(scope or ""))]]]
    parsed = [(sentences(t), [index[x] for x in labels if x in index]) for t, labels in docs if t]
    k = max(len(names), 1)

    def count(assign) -> tuple[dict[str, Counter], Counter]:
        counts, totals = defaultdict(Counter), Counter({i: 1 for i in range(k)})
        for s, w in seeds:
            for t in set(w) - _GLUE:
                counts[t][s] += 1
        for ss, labels in parsed:
            for w in ss:
                s = assign(w, labels)
                if s is not None:
                    totals[s] += 1
                    for t in _terms(w):
                        counts[t][s] += 1
        return counts, totals

    model = Model(names, _weigh(*count(lambda w, ls: ls[0] if len(ls) == 1 else None), k))
    for _ in range(rounds):
        # sentences off the label's subject, and wrong labels, now go where their other terms say

        def assign(w, ls, m=model):
            s, lead = m.subject(w)
            return s if s >= 0 and lead > 0.3 else None

        model = Model(names, _weigh(*count(assign), k))
    return model


def calibrate(model: Model, docs: list[tuple[str, list[str]]]) -> Model:
    """The threshold under which most labelled documents have exactly their labels; the middle of the best ones."""
    index = {s: i for i, s in enumerate(model.subjects)}
    parsed = []
    for t, labels in docs:
        ss = [model.subject(w) for w in sentences(t)] if t else []
        if ss:
            parsed.append((ss, {index[x] for x in labels if x in index}))
    best: list[tuple[int, float]] = []
    for step in range(1, 25):
        th = step * 0.05
        right = 0
        for ss, want in parsed:
            n = Counter(s for s, lead in ss if s >= 0 and lead >= th)
            right += {s for s, v in n.items() if v >= SHARE * len(ss)} == want
        best.append((right, th))
    top = max(r for r, _ in best) if best else 0
    good = [th for r, th in best if r >= top - max(1, len(parsed) // 500)]
    model.threshold = good[len(good) // 2] if good else 0.3
    return model


def parse(documents: DataFrame) -> DataFrame:
    """doc_id and sentences (words joined by spaces) of the documents with any: the one scan of the texts, written to the
    shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ss = [" ".join(w) for w in sentences(t)] if t else []
                if ss:
                    ids.append(i)
                    out.append(ss)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "ss"])

    at = scratch(documents.sparkSession, "sentences")
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows.mapInArrow(run, "doc_id long, ss array<string>").write.parquet(at)
    return documents.sparkSession.read.parquet(at)


def train(documents: DataFrame, subjects: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, parsed: DataFrame | None = None) -> Model:
    """Fit, weigh by corpus rarity and calibrate. The sample of labelled documents is bounded, the corpus isn't."""
    # one row per subject area
    names = [(r["subject"], r["scope"]) for r in subjects.where("subject is not null").groupBy("subject").agg(F.min("scope").alias("scope")).orderBy("subject").collect()]
    want = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("labels"))
    want = want.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = documents.select("doc_id", "text").join(want, "doc_id").toPandas().sort_values("doc_id")
    docs = list(zip(rows["text"], rows["labels"].map(list)))
    docs = [(t, ls) for t, ls in docs if t]
    model = fit(docs, names)
    parsed = parse(documents) if parsed is None else parsed
    for _ in range(EXPANSIONS):
        model = expand(calibrate(model, docs), parsed)
    return calibrate(model, docs)


def expand(model: Model, parsed: DataFrame) -> Model:
    """The model with the words of the whole corpus: in each document whose recognised sentences agree on a subject,
    every word not in a sentence of another subject counts for it. Rarity is the number of all documents of a word, and a
    word must be of one subject wherever it is recognised and not be met mostly elsewhere."""
    k = len(model.subjects)
    shared = parsed.sparkSession.sparkContext.broadcast(model)  # at most MAX_TERMS terms, and those of the labels

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, seen, every = shared.value, Counter(), Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame([(t, s, n) for (t, s), n in seen.items()] + [(t, -1, n) for t, n in every.items()], columns=["term", "subject", "n"])

        for pdf in batches:
            for ss in pdf["ss"]:
                every[""] += 1
                ws = [set(x.split()) for x in ss]
                every.update(set().union(*ws))
                said = [m.subject(x.split()) for x in ss]
                votes = Counter(s for s, lead in said if s >= 0 and lead >= m.threshold)
                if not votes:
                    continue
                top, n = votes.most_common(1)[0]
                if n < 0.8 * sum(votes.values()) or n < 0.4 * len(ss):
                    continue
                seen["", top] += 1
                seen.update((t, top) for t in set().union(*(w for w, (s, lead) in zip(ws, said) if s == top or lead < m.threshold)))
            if len(seen) + len(every) > 300_000:
                yield out()
                seen.clear()
                every.clear()
        yield out()

    counts = parsed.select("ss").mapInPandas(count, "term string, subject int, n long").groupBy("term", "subject").agg(F.sum("n").alias("n"))
    where = scratch(parsed.sparkSession, "terms")
    counts.write.parquet(where)
    counts = parsed.sparkSession.read.parquet(where)
    totals = {r["subject"]: r["n"] for r in counts.where("term = ''").collect()}  # one row per subject
    docs = max(totals.pop(-1, 1), 1)
    if not totals:
        return model
    rate = F.col("n") / F.element_at(F.create_map(*(F.lit(x) for p in totals.items() for x in p)), F.col("subject"))
    per = counts.where(F.length("term") > 2).groupBy("term").agg(
        F.sum(F.when(F.col("subject") >= 0, F.col("n"))).alias("said"), F.max(F.when(F.col("subject") < 0, F.col("n"))).alias("df"),
        F.sum(F.when(F.col("subject") >= 0, rate)).alias("rates"), F.max(F.when(F.col("subject") >= 0, F.struct(rate.alias("rate"), "subject"))).alias("best"),
    )
    p = (F.col("best.rate") / F.col("rates") * F.col("said") + 2.0 / k) / (F.col("said") + 2)
    rare = F.least(F.lit(1.0), 0.4 + F.log((F.lit(1.0) + docs) / (1 + F.col("df"))) / math.log(1 + docs))
    kept = per.where((F.col("said") >= 4) & (p >= 0.6) & (F.col("said") * 4 >= F.col("df"))).select("term", F.col("best.subject").alias("s"), (F.log(p * k) * rare).alias("w"), "said")
    rows = kept.orderBy(F.desc(F.col("w") * F.log1p("said")), "term").limit(MAX_TERMS).toPandas()
    weights = {t: {int(s): w} for t, s, w in zip(rows["term"], rows["s"], rows["w"])}
    # the words of the labels' terms, at most those of MAX_LABELLED documents
    own = sorted({(x,) for t in model.weights for x in t.split()})
    known = parsed.sparkSession.createDataFrame(own, "term string")
    frequent = dict(counts.where("subject = -1").join(F.broadcast(known), "term").select("term", "n").collect())
    for t, w in model.weights.items():
        if t not in weights:
            n = min((frequent.get(x, 1) for x in t.split()), default=1)
            scale = min(1.0, 0.4 + math.log((1 + docs) / (1 + n)) / math.log(1 + docs))
            weights[t] = {s: v * (1.0 if model.scaled else scale) for s, v in w.items()}
    return Model(model.subjects, weights, scaled=True)


def assign(documents: DataFrame, model: Model, share: float = SHARE, parsed: DataFrame | None = None) -> DataFrame:
    """doc_id, subject, share: every subject that at least `share` of a document's sentences are about."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most MAX_TERMS terms, and those of the labels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            rows = [(i, m.subjects[s], v) for i, ss in zip(pdf["doc_id"], pdf["ss"]) for s, v in m.shares([x.split() for x in ss]).items() if v >= share]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "share"])

    parsed = parse(documents) if parsed is None else parsed
    return parsed.mapInPandas(run, "doc_id long, subject string, share double").distinct()
