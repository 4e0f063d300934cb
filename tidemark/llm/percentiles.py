"""Problem 7: percentiles of very large numeric columns from mergeable logarithmic buckets.

A value x > 0 falls into bucket i = ceil(log_g(x)), g = (1 + a) / (1 - a); every value of the bucket is within a
relative error a of its estimate 2 g^i / (g + 1). Negative values have buckets of their own, zero has one. Sketches
are plain rows (group, sign, bucket, n): they are merged by adding counts, so daily results combine to any period,
and a hot group is pre-aggregated map-side to a few thousand rows before anything is shuffled.

Null, NaN and infinite values are no values. Empty input gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Guaranteed relative error of a percentile.
ALPHA = 0.01


def _gamma(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def sketch(df: DataFrame, keys: list[str], value: str | Column, alpha: float = ALPHA) -> DataFrame:
    """Bucket counts of a value per keys: keys, sign (-1, 0, 1), bucket, n."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    inv = 1.0 / math.log(_gamma(alpha))
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    sign = F.signum("_v").cast("int")
    bucket = F.when(F.col("_v") == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs("_v")) * F.lit(inv))).cast("int")
    return rows.groupBy(*keys, sign.alias("sign"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of several partitions, days or groups as one per keys."""
    return sketches.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def quantiles(merged: DataFrame, keys: list[str], probs: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """One row per keys with n and an estimate for each named probability (the value of rank floor(p (n - 1)) + 1).

    The window runs over buckets, at most a few thousand a group whatever the number of values.
    """
    g = _gamma(alpha)
    place = F.col("sign") * F.col("bucket")
    by = Window.partitionBy(*keys)
    upto = by.orderBy("sign", place).rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("_cum", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(by))
    value = F.col("sign") * F.lit(2.0) * F.pow(F.lit(g), F.col("bucket")) / F.lit(g + 1)
    return ranked.withColumn("_value", value).groupBy(*keys).agg(
        F.max("_all").alias("n"),
        *(
            F.min(F.when(F.col("_cum") > F.floor(F.lit(p) * (F.col("_all") - 1)), F.struct("sign", place.alias("p"), F.col("_value").alias("v"))))
            .getField("v").alias(name)
            for name, p in probs.items()
        ),
    )
