"""Markdown chunker: fences are atoms, a ladder of separators, greedy merging, overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separators from coarse to fine; a separator opens the piece after it.
LADDER = ["\n## ", "\n# ", "\n### ", "\n\n", "\n", ". ", " "]
TARGET, OVERLAP = 1500, 300
_FENCE = re.compile(r"```[^\n]*\n.*?\n```|~~~[^\n]*\n.*?\n~~~", re.S)


def _marks(text: str) -> list[list[int]]:
    """For each separator the positions where a piece may begin, none inside a fence."""
    fences = [(m.start(), m.end()) for m in _FENCE.finditer(text)]
    out = []
    for sep in LADDER:
        spots, at, f = [], text.find(sep), 0
        while at >= 0:
            while f < len(fences) and fences[f][1] <= at:
                f += 1
            if not (f < len(fences) and fences[f][0] < at):
                spots.append(at)
            at = text.find(sep, at + len(sep))
        out.append(spots)
    return out


def _pieces(lo: int, hi: int, level: int, marks: list[list[int]], fences: list[tuple[int, int]], target: int) -> list[tuple[int, int]]:
    if hi - lo <= target:
        return [(lo, hi)]
    for k in range(level, len(LADDER)):
        cuts = [c for c in marks[k] if lo < c < hi]
        if cuts:
            bounds = [lo, *cuts, hi]
            return [p for a, b in zip(bounds, bounds[1:]) for p in _pieces(a, b, k + 1, marks, fences, target)]
    if any(a <= lo and hi <= b for a, b in fences):
        return [(lo, hi)]  # a fence is never cut
    inside = [(a, b) for a, b in fences if lo < b and a < hi]
    if inside:
        a, b = inside[0]
        parts = [(lo, a), (a, b), (b, hi)]
        return [p for x, y in parts if x < y for p in (_pieces(x, y, len(LADDER), marks, fences, target) if (x, y) != (a, b) else [(a, b)])]
    return [(x, min(x + target, hi)) for x in range(lo, hi, target)]


def chunk(text: str | None, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Chunks of a text as (start, end); a text within the target is one, an empty one none. Each chunk after the
    first starts up to `overlap` characters earlier, at the first space of that stretch."""
    if not text:
        return []
    if len(text) <= target:
        return [(0, len(text))]
    fences = [(m.start(), m.end()) for m in _FENCE.finditer(text)]
    merged: list[list[int]] = []
    for a, b in _pieces(0, len(text), 0, _marks(text), fences, target):
        if merged and b - merged[-1][0] <= target:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    out = [(merged[0][0], merged[0][1])]
    for (pa, _), (a, b) in zip(merged, merged[1:]):
        start = max(pa, a - overlap)
        space = text.find(" ", start, a)
        out.append((space + 1 if space > start else start, b))
    return out


def chunked(df: DataFrame, ident: str, text: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """id, idx, content, char_start, char_end. Texts within the target don't go to Python."""
    base = df.select(F.col(ident).alias("id"), F.col(text).alias("content")).where(F.length("content") > 0)
    small = base.where(F.length("content") <= target).select("id", F.lit(0).alias("idx"), "content", F.lit(0).alias("char_start"), F.length("content").alias("char_end"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, t[a:b], a, b) for i, t in zip(pdf["id"], pdf["content"]) for k, (a, b) in enumerate(chunk(t, target, overlap))]
            yield pd.DataFrame(rows, columns=["id", "idx", "content", "char_start", "char_end"])

    many = base.where(F.length("content") > target).mapInPandas(run, "id long, idx int, content string, char_start int, char_end int")
    return many.unionByName(small)
