"""Problem 5: new batches deduplicated against all accepted history.

Fingerprint. Of the distinct words of question and of reply, in their normal form, BLOCKS * ROWS random orders each take
the least word. One bit of 32 of them per side makes a 64-bit fingerprint: texts that share the part J of their words
differ in (1 - J) / 2 of its bits in the mean. ROWS least words of the question with ROWS of the reply make a block, so
two texts share one block with the probability J_question^ROWS * J_reply^ROWS: 0.22 where one word in eight is replaced
on both sides, and of BLOCKS none with 0.1 %. (Blocks cut from the sign bits of one random projection, the usual
form, are equal too rarely at that distance: 17 % of those bits differ.) As both sides are in every block, the same
question with another reply is no candidate.

Store. A folder with the tables `blocks` (key, id, fingerprint: the rotated block tables in one, key = hash of project,
table and block), `texts` (id, hash of the project, words of both sides, fingerprint), `refused` and a `log` of finished
batches. Both tables are bucketed by their key: a batch's keys and candidates are shuffled to the buckets, stored rows stay
where they are. What follows the batch: fingerprints, shuffles, candidates, comparisons, appended rows. What touches the
history: one pass over the narrow columns of `blocks` and, for the candidates, one over `texts`, both without a shuffle.

Plans. The driver pays for each plan and stage, whatever the rows, and a replay has those of all its batches. So a batch
is few plans: the rows of a key meet once, where fingerprints already part most pairs, what is read again is written to
the batch's work folder, and one sorted pass of a task over the verified pairs, three integers each, decides them.

A batch is judged once: its rows carry a commit number that counts only when it is in the log, which is written last. A
call that died leaves rows nobody reads; the same batch again returns what was found the first time. One writer at a
time. Ties: within a batch the smaller id is accepted. Exact copies (same words and project) are one class, of which
only the first enters the tables.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import conversations
from tidemark.llm.textnorm import words
from tidemark.session import exists, remove, scratch

#: Block tables, and least words of each side in a block.
BLOCKS, ROWS = 28, 3
#: For files of hashes and texts, which hardly recur.
PLAIN = {"parquet.enable.dictionary": "false"}
#: Most differing bits, of 64, of a candidate worth its words. A fifth of the words replaced is 11 in the mean.
MAX_BITS = 24
#: Largest share of changed words in question and in reply.
MAX_CHANGED = 0.2
#: Texts of blocks with more than this make no pair rows but are compared where they are.
HOT = 64
#: Rows of each side that are compared at once in such a block, and hash ranges of words.
SQUARE, BINS = 2048, 64

_rng = np.random.Generator(np.random.PCG64(5))
_MIX = _rng.integers(0, 2**64, BLOCKS * ROWS, np.uint64)
_ODD = _rng.integers(0, 2**64, BLOCKS * ROWS, np.uint64) | np.uint64(1)
_STIR = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _least(lists: list[list[str]]) -> np.ndarray:
    """For each list of words the least hash of its words under each random order; a list without words is one empty word."""
    if len(_hashes) > 500_000:  # memory of a worker; entries are recomputed
        _hashes.clear()
    flat, starts = [], []
    for ws in lists:
        starts.append(len(flat))
        flat.extend(map(_hashes.__getitem__, set(ws) or ("",)))
    h = np.array(flat, np.uint64)
    return np.stack([np.minimum.reduceat((h ^ m) * o, starts) for m, o in zip(_MIX, _ODD)], axis=1)


def marks(questions: list[list[str]], replies: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n) and blocks (n x BLOCKS) of texts given as word lists, as signed 64-bit integers."""
    if not questions:
        return np.zeros(0, np.int64), np.zeros((0, BLOCKS), np.int64)
    q, r = _least(questions), _least(replies)
    bits = (np.concatenate([q[:, :32], r[:, :32]], axis=1) >> np.uint64(20)) & np.uint64(1)
    fp = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    block = np.zeros((len(q), BLOCKS), np.uint64)
    for side in (q.reshape(-1, BLOCKS, ROWS), r.reshape(-1, BLOCKS, ROWS)):
        for k in range(ROWS):
            block = ((block ^ side[:, :, k]) * _STIR) ^ ((block ^ side[:, :, k]) >> np.uint64(29))
    return fp.view(np.int64), block.view(np.int64)


def fingerprints(episodes: DataFrame) -> DataFrame:
    """id, class (hash of project and words), space (hash of the project), q, r (words of both sides), fp, blocks. Turns
    without question or reply have none, nor have rows without an id. Of a class, the least id of a record batch has all
    columns, further ones id and class only: the least id of all has them, and many copies move few bytes."""
    rows = episodes.where(~conversations.missing(F.col("human_turn")) & ~conversations.missing(F.col("assistant_turn")))
    rows = rows.where(F.col("id").isNotNull()).select(
        # a null project is a project: the flag keeps it apart from any string
        F.col("id").cast("long"), F.xxhash64(F.col("project").isNull(), "project").alias("space"), "human_turn", "assistant_turn"
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, space = batch.column(0), batch.column(1)
            q, r = ([words(x) for x in batch.column(i).to_pylist()] for i in (2, 3))
            qs, rs = [" ".join(x) for x in q], [" ".join(x) for x in r]
            cls = [xxhash.xxh128_digest(f"{p}\n{a}\n{b}") for p, a, b in zip(space.to_pylist(), qs, rs)]
            first: dict[bytes, int] = {}
            for i in np.argsort(ids.to_numpy(), kind="stable").tolist():
                first.setdefault(cls[i], i)
            whole = sorted(first.values())
            rest = np.setdiff1d(np.arange(len(cls)), whole)
            fp, block = marks([q[i] for i in whole], [r[i] for i in whole])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, block.size + 1, BLOCKS, dtype=np.int32)), pa.array(block.ravel()))
            texts = [pa.array([x[i] for i in whole], pa.string()) for x in (qs, rs)]
            cls = pa.array(cls, pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(whole, pa.int64())), cls.take(pa.array(whole, pa.int64())), space.take(pa.array(whole, pa.int64())), *texts, pa.array(fp), lists], names=names)
            if len(rest):
                none = [pa.nulls(len(rest), t) for t in (pa.int64(), pa.string(), pa.string(), pa.int64(), lists.type)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rest)), cls.take(pa.array(rest)), *none], names=names)

    names = ["id", "class", "space", "q", "r", "fp", "blocks"]
    return rows.mapInArrow(make, "id long, class binary, space long, q string, r string, fp long, blocks array<long>")


def block_rows(texts: DataFrame) -> DataFrame:
    """Rows (key, id, fp) of the block tables."""
    each = texts.select("id", "space", "fp", F.posexplode("blocks").alias("k", "block"))
    return each.select(F.xxhash64("space", "k", "block").alias("key"), "id", "fp")


def _same(a: list[str], b: list[str], most: float) -> bool:
    """Whether two word lists differ in at most the given share of words (edits without moves)."""
    n, m = len(a), len(b)
    if a == b:
        return True
    room = int(most * max(n, m))
    if abs(n - m) > room or not room:
        return False
    k = 0
    while k < min(n, m) and a[k] == b[k]:
        k += 1
    end = 0
    while end < min(n, m) - k and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    a, b = a[k : n - end], b[k : m - end]
    n, m = len(a), len(b)
    big = room + 1
    row = {j: j for j in range(min(m, room) + 1)}
    for i in range(1, n + 1):  # banded edit distance
        new = {}
        for j in range(max(0, i - room), min(m, i + room) + 1):
            best = row.get(j, big) + 1
            if j:
                best = min(best, new.get(j - 1, big) + 1, row.get(j - 1, big) + (a[i - 1] != b[j - 1]))
            else:
                best = min(best, i)
            new[j] = best
        row = new
        if min(row.values()) > room:
            return False
    return row.get(m, big) <= room


class Store:
    """The accepted history in a folder of the shared file system. Buckets: as many as the session has shuffle partitions
    when the store is made, unless given."""

    COLUMNS = {"blocks": "key long, id long, fp long, commit long", "texts": "id long, space long, q string, r string, fp long, commit long"}
    KEY = {"blocks": "key", "texts": "id"}
    LOG = "token string, commit long, buckets int"

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder
        log = f"{folder}/log"
        # one row per finished batch
        rows = spark.read.schema(self.LOG).parquet(log).collect() if exists(spark, log) else []
        self.commits = {r["token"]: r["commit"] for r in rows}
        self.buckets = rows[0]["buckets"] if rows else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _table(self, name: str) -> str:
        table = f"tidemark_{name}_{xxhash.xxh64_hexdigest(self.folder)}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({self.COLUMNS[name]}) USING parquet OPTIONS ({', '.join(f"'{k}' '{v}'" for k, v in PLAIN.items())}) CLUSTERED BY ({self.KEY[name]}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return table

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.table(self._table(name)).where(F.col("commit").isin(list(self.commits.values()))).drop("commit")

    def append(self, name: str, df: DataFrame, commit: int) -> None:
        key = self.KEY[name]
        df.withColumn("commit", F.lit(commit)).repartition(self.buckets, key).write.mode("append").insertInto(self._table(name))

    def refused(self, token: str) -> DataFrame:
        return self.spark.read.schema("id_a long, id_b long").parquet(f"{self.folder}/refused/commit={self.commits[token]}")

    def finish(self, token: str, commit: int) -> None:
        self.spark.createDataFrame([(token, commit, self.buckets)], self.LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        self.commits[token] = commit

    def forget(self) -> None:
        """Remove the block tables and texts of a store that is needed no more; what was refused stays."""
        for name in self.COLUMNS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
            remove(self.spark, f"{self.folder}/{name}")


def admit(history: str, batch: DataFrame, token: str | None = None, seed: bool = False, hot: int = HOT, buckets: int | None = None) -> DataFrame:
    """One batch against the stored history; returns id_a, id_b: each refused row and the accepted one it repeats.

    Appends what is accepted. With `seed` the batch is accepted as it is. `token` names the batch; without one it is a
    hash of the batch's rows. A token met before changes nothing and returns the first result. An id that was accepted
    before with the same words is the same row, neither refused nor appended. Of an id with several texts in one batch
    each text is judged. An empty batch is recorded and refuses nothing.
    """
    spark = batch.sparkSession
    store = Store(spark, history, buckets)
    if token is None:
        cols = ["id", "project", "human_turn", "assistant_turn"]
        of = batch.select(F.xxhash64(*cols).cast("decimal(38,0)").alias("h")).distinct().agg(F.count(F.lit(1)), F.coalesce(F.sum("h"), F.lit(0))).first()
        token = f"{of[0]}:{of[1]}"
    if token in store.commits:
        return store.refused(token)
    commit = random.getrandbits(62)
    work = f"{history}/work-{commit}"
    keep = _keeper(spark, work)
    # the first of a class stands for it and has the texts
    of = Window.partitionBy("class").orderBy("id", F.col("fp").isNull())
    each = fingerprints(batch).select("*", F.first("id").over(of.rowsBetween(Window.unboundedPreceding, 0)).alias("rep"), F.row_number().over(of).alias("nth"))
    rows, _ = keep(each.select("id", "rep", *(F.when(F.col("nth") == 1, F.col(c)).alias(c) for c in ("space", "q", "r", "fp", "blocks"))))
    reps = rows.where("fp is not null").select("id", "space", "q", "r", "fp", "blocks")
    out = f"{history}/refused/commit={commit}"
    if seed:
        spark.createDataFrame([], "id_a long, id_b long").write.parquet(out)
        fresh = reps
    else:
        by, _ = keep(_resolve(_edges(store, reps, hot, keep)))
        members = rows.select("id", "rep").join(by.select(F.col("b").alias("rep"), F.col("a").alias("by")), "rep", "left")
        # refused by whoever refused the first of the class, or else by that one
        refused = members.select(F.coalesce("by", "rep").alias("id_a"), F.col("id").alias("id_b")).where("id_a != id_b").distinct()
        refused.join(by.where("known").select(F.col("b").alias("id_b")), "id_b", "left_anti").select("id_a", "id_b").write.parquet(out)
        fresh = reps.join(by.select(F.col("b").alias("id")), "id", "left_anti")
    store.append("texts", fresh.select("id", "space", "q", "r", "fp"), commit)
    store.append("blocks", block_rows(fresh), commit)
    store.finish(token, commit)
    remove(spark, work)
    return store.refused(token)


def refusals(episodes: DataFrame, hot: int = HOT) -> DataFrame:
    """id_a, id_b of all batches of a table: they are admitted one after the other to a new store, batch 0 as it is.

    A null batch_no is 0. The list of batch numbers is one integer per batch.
    """
    at = scratch(episodes.sparkSession, "history")
    no = F.col("batch_no")
    numbers = sorted({r[0] or 0 for r in episodes.select(no).distinct().collect()})
    out = None
    for n in numbers:
        # plain comparisons, which a reader of files can skip by
        got = admit(at, episodes.where((no == 0) | no.isNull() if n == 0 else no == n), f"batch {n}", seed=n == 0, hot=hot)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return episodes.sparkSession.createDataFrame([], "id_a long, id_b long")
    Store(episodes.sparkSession, at).forget()
    return out.distinct()


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


Keep = Callable[[DataFrame], tuple[DataFrame, int]]


def _keeper(spark: SparkSession, work: str) -> Keep:
    """A function that writes rows to a file of the batch's work folder and returns them, read from there, and their number."""
    names = itertools.count()

    def keep(df: DataFrame) -> tuple[DataFrame, int]:
        at, seen = f"{work}/{next(names)}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.options(**PLAIN).parquet(at)
        return spark.read.schema(df.schema).parquet(at), seen.get["n"]

    return keep


def _verify(pairs: DataFrame, store: Store, reps: DataFrame, only: bool | None = None) -> DataFrame:
    """Of pairs (a, b, old) those whose fingerprints and then whose words agree. old: a is of the history. only: the value
    of old where all pairs have the same."""
    cols = ["id", "space", "q", "r", "fp"]
    right = reps.select(*(F.col(c).alias(f"{c}2") for c in cols))
    # rows with the same b are together for both the distinct and the join
    near = pairs.select("a", "b", "old").repartition("b").distinct().join(right, F.col("b") == F.col("id2")).drop("id2")
    sides = [near.where("not old").join(reps.select(*cols), F.col("a") == F.col("id"))] if not only else []
    if only or (only is None and store.commits):
        # the candidates are the hashed side: the stored rows are read in passing, neither shuffled nor sorted
        sides.append(store.rows("texts").select(*cols).join(near.where("old").hint("shuffle_hash"), F.col("a") == F.col("id")))

    @F.pandas_udf("boolean")
    def same(q: pd.Series, q2: pd.Series, r: pd.Series, r2: pd.Series) -> pd.Series:
        return pd.Series([_same(a.split(), b.split(), MAX_CHANGED) and _same(c.split(), d.split(), MAX_CHANGED) for a, b, c, d in zip(q, q2, r, r2)])

    # written so that it is no join key: the stored rows are bucketed by id alone
    one_space = F.col("space").bitwiseXOR(F.col("space2")) == 0
    out = None
    for s in sides:
        s = s.where(_near("fp", "fp2") & one_space).where(same("q", "q2", "r", "r2")).select("a", "b", "old")
        out = s if out is None else out.unionByName(s)
    return out


#: Kinds of rows of _meetings(): pairs within the batch and with the history, rows of hot blocks of the batch and of the history.
PAIR, PAIR_OLD, HERE, THERE = range(4)


def _pairs(key: np.ndarray, ids: np.ndarray, fp: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, old: of rows sorted by key the pairs of one key, at least one of the batch, whose fingerprints are near."""
    out, i, step = [], np.arange(len(key)), 0
    while len(i):  # a row and the one `step` after it
        step += 1
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        j = i + step
        fits = ~(old[i] & old[j]) & (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= MAX_BITS)
        out.append((i[fits], j[fits]))
    i, j = (np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in (0, 1))
    swap = old[j] | (~old[i] & (ids[j] < ids[i]))
    a, b, past = ids[np.where(swap, j, i)], ids[np.where(swap, i, j)], old[i] | old[j]
    fits = past | (a < b)
    return a[fits], b[fits], past[fits]


def _meetings(store: Store, reps: DataFrame, hot: int) -> DataFrame:
    """kind, a, b, key, fp: pairs (a, b) that share a block and whose fingerprints are near; of blocks with more than `hot`
    texts of batch or history all texts (a, key, fp) that the batch meets there."""
    mine = block_rows(reps)
    rows = mine.select("*", F.lit(False).alias("old"))
    if store.commits:
        # the batch is the hashed side: the stored rows are read in passing, neither shuffled nor sorted
        keys = mine.select("key").repartition(store.buckets, "key").hint("shuffle_hash")
        rows = rows.union(store.rows("blocks").select("key", "id", "fp").join(keys, "key", "left_semi").select("*", F.lit(True).alias("old")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, burns = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)], None  # the last key's rows; the last key if hot
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rest = [np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(rest)]
            key, ids, fp, old = rest
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            past = np.add.reduceat(old.astype(np.int64), starts)
            is_hot = (past > hot) | (sizes - past > hot) | ((key[starts] == burns) if burns is not None else False)
            burns = key[-1] if is_hot[-1] else None
            each = np.repeat(is_hot, sizes)
            end = len(key) if batch is None or is_hot[-1] else starts[-1]  # more rows of the last key may follow
            cold = np.flatnonzero(~each[:end])
            a, b, o = _pairs(*(x[cold] for x in rest))
            if len(a):
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.where(o, PAIR_OLD, PAIR).astype(np.int32)), pa.array(a), pa.array(b), none, none], names=names)
            if each.any():
                none = pa.nulls(int(each.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.where(old[each], THERE, HERE).astype(np.int32)), pa.array(ids[each]), none, pa.array(key[each]), pa.array(fp[each])], names=names)
            rest = [x[end:] for x in rest]

    names = ["kind", "a", "b", "key", "fp"]
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(make, "kind int, a long, b long, key long, fp long")


def _edges(store: Store, reps: DataFrame, hot: int, keep: Keep) -> DataFrame:
    """a, b, old: verified pairs of a batch's texts with accepted ones and with smaller ids of the batch."""
    seen = Observation()
    at, _ = keep(_meetings(store, reps, hot).observe(seen, F.coalesce(F.max("kind"), F.lit(0)).alias("top")))
    pairs = at.where(F.col("kind") <= PAIR_OLD).select("a", "b", (F.col("kind") == PAIR_OLD).alias("old"))
    if seen.get["top"] < HERE:
        return _verify(pairs, store, reps)
    here, there = (at.where(F.col("kind") == k).select("key", F.col("a").alias("id"), "fp") for k in (HERE, THERE))
    return _hot_edges(store, reps, here, there if seen.get["top"] == THERE else None, pairs, keep)


def _sketch(texts: DataFrame) -> DataFrame:
    """id, fp, counts: how many words of question and of reply fall into each of BINS hash ranges."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, 2, BINS), np.uint16)
            for side in (0, 1):
                for i, t in enumerate(batch.column(1 + side).to_pylist()):
                    counts[i, side] = np.minimum(np.bincount([xxhash.xxh32_intdigest(w) % BINS for w in t.split()], minlength=BINS), 2**16 - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array([x.tobytes() for x in counts], pa.binary())], names=["id", "fp", "counts"])

    return texts.select("id", "q", "r", "fp").mapInArrow(make, "id long, fp long, counts binary")


def _close(left: pa.Table, right: pa.Table, old: bool) -> pa.Table:
    """a, b: of the texts of a hot block those pairs whose fingerprints, and whose counts of words, allow a repeat. Texts
    that differ in d words have at least the longer one's words less d in common, and no fewer in common ranges."""
    a, b = (t["id"].to_numpy() for t in (left, right))
    fa, fb = (t["fp"].to_numpy().view(np.uint64) for t in (left, right))
    ca, cb = (np.frombuffer(b"".join(t["counts"].to_pylist()), np.uint16).reshape(-1, 2, BINS) for t in (left, right))
    na, nb = (c.sum(axis=2, dtype=np.int64) for c in (ca, cb))
    new_a, new_b = (t["new"].to_numpy(zero_copy_only=False).astype(bool) for t in (left, right))
    out = []
    for lo in range(0, len(b), 128):
        part = slice(lo, lo + 128)
        fits = np.bitwise_count(fa[:, None] ^ fb[None, part]) <= MAX_BITS
        fits &= new_a[:, None] | new_b[None, part]
        if not old:
            fits &= a[:, None] < b[None, part]
        x, y = np.nonzero(fits)
        y += lo
        for at in np.array_split(np.arange(len(x)), len(x) // 50_000 + 1):
            i, j = x[at], y[at]
            most = np.maximum(na[i], nb[j])
            common = np.minimum(ca[i], cb[j]).sum(axis=2, dtype=np.int64)
            keep = (most - common <= (MAX_CHANGED * most).astype(np.int64)).all(axis=1)
            out.append(np.stack([a[i[keep]], b[j[keep]]]))
    pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def _meet(a: DataFrame, b: DataFrame, of_a: DataFrame, of_b: DataFrame, old: bool) -> DataFrame:
    """Pairs (a, b, old) of rows (key, id, new) with the same key of which one is new, by blocks of rows: only what may be
    a repeat leaves a block. of_a, of_b: their sketches."""
    sizes = a.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(b.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key")
    parts = lambda c: F.ceil(F.col(c) / F.lit(SQUARE)).cast("int")
    mine = lambda c: F.pmod(F.xxhash64("id"), parts(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    left = a.join(sizes, "key").select("key", "id", "new", mine("n").alias("i"), every("m").alias("j")).join(of_a, "id")
    right = b.join(sizes, "key").select("key", "id", "new", every("n").alias("i"), mine("m").alias("j")).join(of_b, "id")
    left, right = (x.toDF(*x.columns) for x in (left, right))  # both may come from one table
    close = left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInArrow(lambda x, y: _close(x, y, old), "a long, b long")
    return close.distinct().withColumn("old", F.lit(old))


def _hot_edges(store: Store, reps: DataFrame, here: DataFrame, there: DataFrame | None, pairs: DataFrame, keep: Keep) -> DataFrame:
    """Edges of pairs and within hot blocks. Every text of a hot block is first compared with the least id of batch and of history
    there. Who repeats it has no smaller original in that block, and who is refused is nobody's original: a mass of near
    copies is met by its leaders. All other pairs are compared. If a leader turns out to be refused, or a refused text to
    be accepted, what was left out for its sake is compared in a further round, until nothing is."""
    least = lambda d, old: d.groupBy("key").agg(F.min(F.struct("id", "fp")).alias("l")).select("key", F.col("l.id").alias("a"), F.col("l.fp").alias("fp2"), F.lit(old).alias("old"))
    leaders = least(here, False) if there is None else least(here, False).unionByName(least(there, True))
    to, _ = keep(here.join(leaders, "key").where("old or a < id").where(_near("fp", "fp2")).select("key", "a", F.col("id").alias("b"), "old"))
    here = here.select("key", "id").distinct()
    edges, _ = keep(_verify(pairs.unionByName(to.select("a", "b", "old")), store, reps))
    done, _ = keep(to.join(edges.distinct(), ["a", "b", "old"]).select("key", "a", F.col("b").alias("id"), "old"))
    fresh, _ = keep(_sketch(reps.join(here.select("id").distinct(), "id")))
    all_new = lambda d: d.withColumn("new", F.lit(True))
    if there is not None:
        there = there.select("key", "id").distinct()
        past, _ = keep(_sketch(store.rows("texts").join(there.select("id").distinct().hint("shuffle_hash"), "id")))
        rest = here.join(done.where("old"), ["key", "id"], "left_anti")
        edges = edges.unionByName(keep(_verify(_meet(all_new(there), all_new(rest), past, fresh, True), store, reps, True))[0])
    tried: list[DataFrame | None] = [None, None]
    while True:
        gone, _ = keep(_resolve(edges).where("a is not null").select("b"))
        led_now = done.where("not old").join(gone.withColumnRenamed("b", "a"), "a", "left_anti")
        want = [here.join(gone.withColumnRenamed("b", "id"), "id", "left_anti"), here.join(led_now, ["key", "id"], "left_anti")]
        new = [keep((w if t is None else w.join(t, ["key", "id"], "left_anti")).select("key", "id")) for w, t in zip(want, tried)]
        if not any(n for _, n in new):
            return edges
        a, b = (all_new(x) if t is None else all_new(x).unionByName(t.withColumn("new", F.lit(False))) for (x, _), t in zip(new, tried))
        edges = edges.unionByName(keep(_verify(_meet(a, b, fresh, fresh, False), store, reps, False))[0])
        tried = [x if t is None else t.unionByName(x) for t, (x, _) in zip(tried, new)]


def _resolve(edges: DataFrame) -> DataFrame:
    """b, a, known: of the verified pairs, a the accepted one with the smallest id that refuses b, null if none does; known
    if b is an accepted id of the history.

    What repeats the history is refused. The rest is decided in order of ids, in one task: an a within the batch is smaller
    than its b, so it is decided when b is met. The task keeps the ids that are refused.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: set[int] = set()
        at, by, known = None, None, False
        for batch in itertools.chain(batches, [None]):
            out = []
            for a, b, old in zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else [(0, None, False)]:
                if b != at:
                    if by is not None or known:
                        out.append((at, by, known))
                    if by is not None:
                        gone.add(at)
                    at, by, known = b, None, False
                if a == b:
                    known |= old
                elif old or a not in gone:
                    by = a if by is None else min(by, a)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_()))], names=["b", "a", "known"])

    return edges.repartition(1).sortWithinPartitions("b").mapInArrow(make, "b long, a long, known boolean")
