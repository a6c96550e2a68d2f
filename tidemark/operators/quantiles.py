"""Exact quantiles without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rank error of the sketch is at most 1/ACCURACY of the rows; MARGIN is safely wider.
ACCURACY = 10_000
MARGIN = 0.0005


def exact_quantile(df: DataFrame, keys, value: str, p: float, name: str = "quantile") -> DataFrame:
    """Linearly interpolated quantile ``p`` of each group.

    A mergeable sketch gives two values that certainly enclose the wanted ranks.
    Rows below them are only counted; the thin band between them is ranked.
    """
    keys = list(keys)
    v = F.col(value)
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))
    bounds = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", [max(p - MARGIN, 0.0), min(p + MARGIN, 1.0)], ACCURACY).alias("_b"),
        F.count("_v").alias("_n"),
    )
    # Equal values are merged before anything is sorted. The rows below the band become
    # one row holding their largest value, those above one row holding their smallest.
    side = F.when(F.col("_v") < F.col("_b")[0], -1).when(F.col("_v") > F.col("_b")[1], 1).otherwise(0)
    merged = (
        rows.join(bounds, keys)
        .groupBy(*keys, "_n", side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_same"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        .withColumn("_v", F.when(F.col("_side") < 0, F.col("_max")).otherwise(F.col("_min")))
    )
    upwards = Window.partitionBy(*keys).orderBy("_v")
    position = p * (F.col("_n") - 1)
    k = F.floor(position)
    ranked = merged.withColumn(
        "_end", F.sum("_c").over(upwards.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_next", F.lead("_v").over(upwards))
    at_k = ranked.where((F.col("_end") - F.col("_c") <= k) & (k < F.col("_end")))
    upper = F.when(k + 1 < F.col("_end"), F.col("_v")).otherwise(F.coalesce(F.col("_next"), F.col("_v")))
    return at_k.select(*keys, (F.col("_v") + (upper - F.col("_v")) * (position - k)).alias(name))
