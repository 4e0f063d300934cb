"""Embedders are external; this is the interface and a deterministic stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts in, unit vectors out.
Embedder = Callable[[list[str]], np.ndarray]


def hashed(dims: int = 64) -> Embedder:
    """Words hashed to signed coordinates, scaled to length 1: equal texts have equal vectors on every machine."""

    def embed(texts: list[str]) -> np.ndarray:
        import re

        import xxhash

        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dims] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return embed


def embed_pending(df: DataFrame, ident: str, text: str, embedding: str, embedder: Embedder, batch: int = 96) -> DataFrame:
    """The rows without an embedding, with one: id, embedding. Null and blank texts stay without. Batches of `batch`
    texts, so a caller of a service is bounded whatever the partition."""
    rows = df.where(F.col(embedding).isNull() & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")).select(F.col(ident).alias("id"), F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": [v.tolist() for v in embedder(list(part["t"]))]})

    return rows.mapInPandas(run, f"id {df.schema[ident].dataType.simpleString()}, embedding array<float>")
