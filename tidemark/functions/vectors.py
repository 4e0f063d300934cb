"""Vector expressions on array<float> columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length, null where one is null."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def literal(vec: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vec))


def nearest(df: DataFrame, vec: Column, query: Column, k: int, tie: str, name: str = "sim") -> DataFrame:
    """The k rows most similar to a query vector: a partial top-k per task, no sort of the table."""
    return df.where(vec.isNotNull()).withColumn(name, cosine(vec, query)).orderBy(F.desc(name), tie).limit(k)


def within(df: DataFrame, vec: Column, query: Column, distance: float, name: str = "sim") -> DataFrame:
    """Rows within a cosine distance of the query vector."""
    return df.where(vec.isNotNull()).withColumn(name, cosine(vec, query)).where(F.lit(1.0) - F.col(name) <= distance)
