"""Problem 8: the whole corpus encoded with a public byte-level BPE tokenizer.

Words (pieces of the pre-tokenizer) follow a steep distribution, so the frequent ones are compiled once into a
minimal acyclic transducer: a deterministic automaton over bytes with shared suffixes, whose transitions carry the
number of accepted words skipped. The sum along a path is the word's rank in sorted order, and that is its row in a
table of id lists. Automaton and table are arrays in the shared folder, memory-mapped by every worker where that folder
is a mounted file system and broadcast (a few MB, bounded by LEXICON) where it isn't; all distinct
words of a batch walk it together, one byte a step. Words outside the lexicon are merged exactly, pair by pair, in
rank order. So the lexicon decides only about speed: its size is a parameter, and any lexicon gives the same ids.

Null and empty texts have an empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import local_path, scratch

#: Words in the lexicon at most.
LEXICON = 1 << 16
#: Longer words are merged, never stored.
LONGEST = 48
#: Characters handled at a time within a batch.
CHUNK = 2_000_000


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the ranks of a public byte-level BPE lie. A path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def splitter() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: always the leftmost pair of least rank is joined next. O(n log n)."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end, prev, alive = [i + 1 for i in range(n)], [i - 1 for i in range(n)], [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop or not alive[j]:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = prev[i]
        if p >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def compile_lexicon(words: Iterable[bytes], ranks: dict[bytes, int], folder: str | None) -> dict[str, np.ndarray]:
    """The transducer of a set of words: keys (state << 8 | byte, sorted), target, skip, final, offsets, ids; written to
    a folder if one is given.

    States are merged bottom-up while sorted words come in (a register of equal states), so suffixes are shared and
    the automaton is minimal without ever holding the trie.
    """
    register: dict[tuple, int] = {}
    trans: list[tuple[tuple[int, int], ...]] = []
    final: list[bool] = []
    count: list[int] = []

    def freeze(node: list) -> int:
        sig = (node[0], tuple(node[1]))
        got = register.get(sig)
        if got is None:
            got = register[sig] = len(trans)
            trans.append(sig[1])
            final.append(node[0])
            count.append(node[0] + sum(count[t] for _, t in sig[1]))
        return got

    stack: list[list] = [[False, []]]
    last = b""
    ordered = sorted(w for w in set(words) if 0 < len(w) <= LONGEST)
    for w in ordered:
        k = 0
        while k < min(len(w), len(last)) and w[k] == last[k]:
            k += 1
        for i in range(len(last), k, -1):
            node = stack.pop()
            stack[-1][1].append((last[i - 1], freeze(node)))
        stack += [[False, []] for _ in range(len(w) - k)]
        stack[-1][0] = True
        last = w
    for i in range(len(last), 0, -1):
        node = stack.pop()
        stack[-1][1].append((last[i - 1], freeze(node)))
    root = freeze(stack[0])
    rows = []
    for s, ts in enumerate(trans):
        skip = int(final[s])
        for b, t in ts:
            rows.append((s << 8 | b, t, skip))
            skip += count[t]
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    lists = [merge(w, ranks) for w in ordered]
    arrays = {
        "keys": table[:, 0], "target": table[:, 1].astype(np.int32), "skip": table[:, 2].astype(np.int32), "final": np.array(final, dtype=bool),
        "offsets": np.cumsum([0, *map(len, lists)]).astype(np.int64), "ids": np.array([i for x in lists for i in x], dtype=np.int32), "root": np.array([root]),
    }
    if folder:
        os.makedirs(folder, exist_ok=True)
        for name, a in arrays.items():
            np.save(os.path.join(folder, f"{name}.npy"), a)
    return arrays


class Encoder:
    """A compiled lexicon and the ranks, as a worker uses them."""

    _cache: dict[tuple[str, str], Encoder] = {}

    def __init__(self, source: str | dict[str, np.ndarray], ranks: str):
        """source: the folder of the arrays, or the arrays."""
        for name in ("keys", "target", "skip", "final", "offsets", "ids", "root"):
            setattr(self, name, np.load(os.path.join(source, f"{name}.npy"), mmap_mode="r") if isinstance(source, str) else source[name])
        self.root = int(self.root[0])
        self.ranks = load_ranks(ranks)
        self.split = splitter()

    @classmethod
    def get(cls, lexicon: Lexicon, ranks: str) -> Encoder:
        key = (lexicon.name, ranks)
        if key not in cls._cache:
            cls._cache = {key: cls(lexicon.shared.value if lexicon.shared else lexicon.name, ranks)}
        return cls._cache[key]

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The row of each word in the table of id lists, -1 for words outside the lexicon."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero((size > 0) & (size <= LONGEST))
        if not len(live):
            return out
        wide = int(size[live].max())
        flat = np.frombuffer(b"".join(words[i].ljust(wide, b"\0") for i in live), np.uint8).reshape(len(live), wide)
        state, rank, left = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64), size[live]
        row = np.arange(len(live))
        for k in range(wide):
            on = left[row] > k
            done = row[~on]
            hit = done[self.final[state[done]]]
            out[live[hit]] = rank[hit]
            row = row[on]
            if not len(row):
                break
            want = state[row] << 8 | flat[row, k]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[at] == want
            row, at = row[ok], at[ok]
            state[row] = self.target[at]
            rank[row] += self.skip[at]
        hit = row[(left[row] == wide) & self.final[state[row]]] if len(row) else row
        out[live[hit]] = rank[hit]
        return out

    def encode(self, texts: list[str | None], ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and, end to end, the ids of the texts."""
        pieces, words = [], []
        for t in texts:
            w = self.split.findall(t) if t else []
            pieces.append(len(w))
            words += w
        if not words:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        code, distinct = pd.factorize(np.array(words, dtype=object))
        raw = [w.encode("utf-8", "replace") for w in distinct]
        rank = self.lookup(raw)
        known = rank >= 0
        size = np.zeros(len(raw), np.int64)
        size[known] = self.offsets[rank[known] + 1] - self.offsets[rank[known]]
        new = [merge(raw[i], self.ranks) for i in np.flatnonzero(~known)]
        size[~known] = [len(x) for x in new]
        each = size[code]
        ends = np.cumsum([0, *pieces])
        total = np.concatenate([[0], np.cumsum(each)])
        n = total[ends[1:]] - total[ends[:-1]]
        if not ids:
            return n, np.zeros(0, np.int32)
        extra = np.array([i for x in new for i in x], dtype=np.int32)
        start = np.zeros(len(raw), np.int64)
        start[known] = self.offsets[rank[known]]
        start[~known] = len(self.ids) + np.cumsum([0, *map(len, new)])[:-1] if new else 0
        pool = np.concatenate([self.ids, extra]) if len(extra) else self.ids
        place = np.repeat(start[code] - total[:-1], each) + np.arange(total[-1])
        return n, np.asarray(pool[place], dtype=np.int32)


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """Words up to LONGEST bytes and how often they occur in all texts; counted per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(), Counter()

        def out() -> pa.RecordBatch:
            keep = [(w, n) for w, n in seen.items() if len(w.encode("utf-8", "replace")) <= LONGEST]
            return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in keep], pa.string()), "n": pa.array([n for _, n in keep], pa.int64())})

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(split.findall(t))
            if len(seen) > 300_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Where the workers find a compiled lexicon: the folder `name`, or a broadcast of its arrays."""

    name: str
    shared: Broadcast | None = None


def lexicon(docs: DataFrame, text: str = "text", ranks: str = "byte_bpe_50k.tiktoken", size: int = LEXICON) -> Lexicon:
    """Compile the most frequent words of the corpus."""
    top = word_counts(docs, text).where("n > 1").orderBy(F.desc("n"), "word").limit(size).select("word").toPandas()["word"]
    uri = scratch(docs.sparkSession, "lexicon")
    mounted = uri.startswith(("file:", "/"))
    arrays = compile_lexicon((w.encode("utf-8", "replace") for w in top), load_ranks(vocabulary(ranks)), local_path(uri) if mounted else None)
    return Lexicon(local_path(uri)) if mounted else Lexicon(uri, docs.sparkSession.sparkContext.broadcast(arrays))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size > CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranks: str = "byte_bpe_50k.tiktoken", size: int = LEXICON) -> DataFrame:
    """id_col, ids: one row per input row. Two scans (words, ids); only word counts are shuffled."""
    words, path = lexicon(docs, text, ranks, size), vocabulary(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.get(words, path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                n, ids = enc.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", ranks: str = "byte_bpe_50k.tiktoken", size: int = LEXICON) -> DataFrame:
    """The kept columns and tokens (the number of ids of the text); the texts don't leave the scan."""
    words, path = lexicon(docs, text, ranks, size), vocabulary(ranks)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.get(words, path)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            n = np.concatenate([enc.encode(texts[lo:hi], ids=False)[0] for lo, hi in chunks(texts)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n)], names=[*keep, "tokens"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    return docs.select(*keep, F.col(text).cast("string")).mapInArrow(run, f"{schema}, tokens long")
