"""Problem 2: oversized items cut into pieces at natural boundaries.

Texts are parsed into a tree - sections by heading, blocks (fences and tables are atoms), lines, sentences, words,
characters. Packing goes bottom-up: a subtree within the limit is one unit, sibling units are merged while they fit,
and only a node beyond the limit is descended into. Every piece but the first starts with exactly the last `overlap`
characters of the one before, and offsets are positions in the item.

Windows of ids are cut by the same rule: their tree is sessions, runs of consecutive sequence numbers, ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 300
EDGE = " \t\r\n"
_FENCE = re.compile(r"^\s{0,3}(```|~~~)")
_HEAD = re.compile(r"^\s{0,3}(#{1,6})\s")
_LIST = re.compile(r"^\s*(?:[-*+]|\d{1,3}[.)])\s")
_SENT = re.compile(r"(?<=[.!?…。！？])[\"'”’)\]]*\s+|(?<=[。！？])")
_WORD = re.compile(r"\s+")
_SIGN = re.compile(r"[,;:/&|)}\]>]+")


def _cuts(text: str, lo: int, hi: int, pattern: re.Pattern) -> list[tuple[int, int]]:
    """[lo, hi) in pieces that end after each match."""
    out, at = [], lo
    for m in pattern.finditer(text, lo, hi):
        if at < m.end() < hi:
            out.append((at, m.end()))
            at = m.end()
    out.append((at, hi))
    return out


def _blocks(text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """Blocks of a text as (level, start, end); level 1-6 opens a section, 7 is a list item, 8 any other block."""
    out: list[tuple[int, int, int]] = []
    at, start, level, fence, table = lo, lo, 0, "", False
    while at < hi:
        end = text.find("\n", at, hi)
        end = hi if end < 0 else end + 1
        line = text[at:end]
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1] == fence:
                fence = ""
        else:
            row = line.lstrip().startswith("|")
            head = _HEAD.match(line)
            new = len(head[1]) if head else 7 if _LIST.match(line) else 8
            if at > start and (head or mark or new == 7 or row != table or (text[start:at].endswith("\n\n") and not row)):
                out.append((level, start, at))
                start = at
            if at == start:
                level = new
            table = row
            fence = mark[1] if mark else ""
        at = end
    if start < hi:
        out.append((level, start, hi))
    return out


def _tree(blocks: list[tuple[int, int, int]], depth: int = 1) -> list:
    """Nested lists: a heading of a level owns what follows up to the next one of its level or above."""
    if depth > 7 or len(blocks) < 2:
        return blocks
    groups: list[list] = []
    for b in blocks:
        if b[0] == depth or not groups:
            groups.append([b])
        else:
            groups[-1].append(b)
    return [g[0] if len(g) == 1 else _tree(g, depth + 1) for g in groups] if len(groups) > 1 else _tree(blocks, depth + 1)


def _span(node) -> tuple[int, int]:
    if isinstance(node, tuple):
        return node[-2], node[-1]
    return _span(node[0])[0], _span(node[-1])[1]


def _pack(text: str, nodes: list, room: int) -> list[tuple[int, int]]:
    """Units of at most `room` characters; siblings merged, oversized nodes descended into."""
    units: list[tuple[int, int]] = []
    open_ = False  # whether the last unit may take more siblings
    for node in nodes:
        lo, hi = _span(node)
        if hi - lo <= room:
            if open_ and hi - units[-1][0] <= room:
                units[-1] = (units[-1][0], hi)
            else:
                units.append((lo, hi))
            open_ = True
            continue
        inner = _pack(text, node, room) if isinstance(node, list) else _leaf(text, lo, hi, room)
        if open_ and inner[0][1] - units[-1][0] <= room:
            units[-1] = (units[-1][0], inner[0][1])
            inner = inner[1:]
        units += inner
        open_ = True
    return units


def _leaf(text: str, lo: int, hi: int, room: int) -> list[tuple[int, int]]:
    """A block beyond the limit: by line, sentence, word, punctuation, then anywhere."""
    for pattern in (re.compile("\n"), _SENT, _WORD, _SIGN):
        parts = _cuts(text, lo, hi, pattern)
        if len(parts) > 1:
            return _pack(text, [(8, a, b) for a, b in parts], room)
    return [(a, min(a + room, hi)) for a in range(lo, hi, room)]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces of a text as (start, end) without the white space at its ends; one piece if it is within the limit."""
    lo, hi = len(text) - len(text.lstrip(EDGE)), len(text.rstrip(EDGE))
    if hi - lo <= limit:
        return [(lo, hi)] if hi > lo else []
    units = _pack(text, _tree(_blocks(text, lo, hi)), limit - overlap)
    if len(units) > 1 and units[0][1] - lo < overlap:  # the first piece has room for its sibling, and must hold the overlap
        units[:2] = [(lo, units[1][1])]
    return [(a - overlap if k else lo, b) for k, (a, b) in enumerate(units)]


def split_texts(df: DataFrame, id_col: str, text: str, start: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Each distinct item in pieces: id, piece (0-based), n_pieces, content, char_start, char_end.

    Offsets are in the item; where `start` names a column with its place in the page, page_start is that place plus
    the piece's (null where it is null). Items within the limit pass through in the JVM as one piece; only oversized
    ones go to Python. Null and blank texts and rows without an id have no piece. A redelivered row counts once.
    """
    base = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("content"), (F.col(start) if start else F.lit(None)).cast("long").alias("at")).distinct()
    base = base.withColumn("_t", F.expr(r"trim(BOTH ' \t\r\n' FROM content)")).where(F.length("_t") > 0)
    small = base.where(F.length("_t") <= limit)
    lead = F.length("content") - F.length(F.expr(r"ltrim(' \t\r\n', content)"))
    one = small.select(
        "id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.col("_t").alias("content"), lead.cast("int").alias("char_start"),
        (lead + F.length("_t")).cast("int").alias("char_end"), (F.col("at") + lead).alias("page_start"),
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, content, at in zip(pdf["id"], pdf["content"], pdf["at"]):
                spans = split_text(content, limit, overlap)
                rows += [(i, k, len(spans), content[a:b], a, b, None if pd.isna(at) else int(at) + a) for k, (a, b) in enumerate(spans)]
            out = pd.DataFrame(rows, columns=["id", "piece", "n_pieces", "content", "char_start", "char_end", "page_start"])
            yield out.astype({"page_start": "Int64"})

    schema = "id long, piece int, n_pieces int, content string, char_start int, char_end int, page_start long"
    many = base.where(F.length("_t") > limit).select("id", "content", "at").mapInPandas(cut, schema)
    return many.unionByName(one)


def pack_ids(runs: list[list[int]], limit: int, overlap: int) -> list[list[int]]:
    """Pieces of at most `limit` ids, each but the first begun with the last `overlap` ids of the one before. A run is cut
    only if it doesn't fit into one piece."""
    pieces: list[list[int]] = []
    open_: list[int] = []
    for run in runs:
        if open_ and len(open_) + len(run) > limit and len(run) <= limit - overlap:
            pieces.append(open_)
            open_ = open_[-overlap:] if overlap else []
        for i in run:
            if len(open_) == limit:
                pieces.append(open_)
                open_ = open_[-overlap:] if overlap else []
            open_ = [*open_, i]
    return [*pieces, open_] if open_ else pieces


def split_windows(df: DataFrame, id_col: str, ids: str, limit: int = 4, overlap: int = 1, episodes: DataFrame | None = None) -> DataFrame:
    """Windows of ids in pieces of at most `limit` distinct ids, `overlap` shared by neighbours: id, piece, n_pieces, episode_ids.

    Null elements are dropped, repeated ones kept once at their first place. With `episodes` (id, session_id, sequence)
    windows are cut where the session changes or skips a number, as far as the limit allows; ids without an episode
    continue the run they stand in. Without it, or where nothing is skipped, pieces are as long as the limit allows.
    """
    clean = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.array_distinct(F.array_compact(F.col(ids))).alias("e")).distinct().where(F.size("e") > 0)
    step = limit - overlap
    n = F.greatest(F.lit(1), F.ceil((F.size("e") - overlap) / F.lit(step))).cast("int")
    plain = clean if episodes is None else clean.where(F.size("e") <= limit)
    out = plain.withColumn("n_pieces", n).select(
        "id", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"), "n_pieces", "e"
    ).select("id", "piece", "n_pieces", F.slice("e", F.col("piece") * step + 1, limit).alias("episode_ids"))
    if episodes is None:
        return out
    known = episodes.where("id is not null").groupBy(F.col("id").alias("x")).agg(F.min(F.struct("session_id", "sequence")).alias("at"))
    big = clean.where(F.size("e") > limit).withColumn("w", F.xxhash64("id", "e"))
    each = big.select("w", "id", F.posexplode("e").alias("k", "x")).join(known, "x", "left")
    # a list holds what one row held
    again = each.groupBy("w", "id").agg(F.array_sort(F.collect_list(F.struct("k", "x", F.col("at.session_id").alias("s"), F.col("at.sequence").alias("n")))).alias("l"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, l in zip(pdf["id"], pdf["l"]):
                runs: list[list[int]] = []
                last = None
                for e in l:
                    here = None if e["n"] is None else (e["s"], e["n"])
                    if not runs or (here and last and (here[0] != last[0] or here[1] not in (last[1], last[1] + 1))):
                        runs.append([])
                    runs[-1].append(e["x"])
                    last = here or last
                pieces = pack_ids(runs, limit, overlap)
                rows += [(i, k, len(pieces), x) for k, x in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["id", "piece", "n_pieces", "episode_ids"])

    return out.unionByName(again.select("id", "l").mapInPandas(pack, "id long, piece int, n_pieces int, episode_ids array<long>"))


def oversized(web_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_table, item_id of each item that had to be cut."""
    cut = F.col("n_pieces") > 1
    texts = split_texts(web_chunks, "id", "content", "char_start").where(cut).select(F.lit("web_chunks").alias("item_table"), F.col("id").alias("item_id"))
    wins = split_windows(chunks, "id", "episode_ids").where(cut).select(F.lit("chunks").alias("item_table"), F.col("id").alias("item_id"))
    return texts.unionByName(wins).distinct()
