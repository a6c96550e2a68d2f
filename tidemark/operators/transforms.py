"""Target and feature transforms, each fitted per series on train rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.splits import TRAIN
from tidemark.session import cut_lineage, task_count

#: Rows of one series that are summed up together while a power is fitted.
BLOCK_ROWS = 65_536


def _train(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == TRAIN) if "split" in df.columns else df


def standardize(df: DataFrame, keys, columns, skip_prefixes=("public", "school")) -> DataFrame:
    """``(x - mean) / sample deviation`` of the train rows; a deviation of 0 counts as 1."""
    columns = [c for c in columns if not c.startswith(tuple(skip_prefixes))]
    stats = _train(df).groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.when(F.stddev_samp(c) == 0, 1.0).otherwise(F.stddev_samp(c)).alias(f"_s_{c}") for c in columns],
    )
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns}
    return df.join(stats, list(keys)).withColumns(scaled).select(*df.columns)


def log_transform(df: DataFrame, keys, target: str = "y") -> DataFrame:
    """``ln(y + 1)`` for series with a zero, else ``ln y``; negative values are an error.

    Adds ``log_shift`` (1 or 0), which the inverse needs.
    """
    least = df.groupBy(*keys).agg(F.min(target).alias("_min"), F.max(F.col(target) == 0).alias("_zero"))
    y = F.col(target)
    checked = F.when(F.col("_min") < 0, F.raise_error(F.lit("negative values cannot be log-transformed")).cast("double"))
    return (
        df.join(least, list(keys))
        .withColumn("log_shift", F.when(F.col("_zero"), 1).otherwise(0))
        .withColumn(target, checked.otherwise(F.log(y + F.col("log_shift"))))
        .drop("_min", "_zero")
    )


def log_inverse(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.exp(c) - F.col("log_shift") for c in columns})


def yeo_johnson(y: str, lam: str) -> str:
    """The two-sided power transform of Yeo and Johnson (2000), as an SQL expression."""
    return _yeo_johnson_of_log(f"signum({y})", f"log1p(abs({y}))", lam)


def _yeo_johnson_of_log(sign: str, size: str, lam: str) -> str:
    power = f"(CASE WHEN {sign} < 0 THEN 2 - ({lam}) ELSE {lam} END)"
    return f"({sign} * CASE WHEN abs({power}) < 1e-9 THEN {size} ELSE expm1({power} * {size}) / {power} END)"


def yeo_johnson_inverse(z: Column, lam: Column) -> Column:
    up = F.when(F.abs(lam) < 1e-9, F.expm1(z)).otherwise(F.pow(z * lam + 1, 1 / lam) - 1)
    down_power = 2 - lam
    down = F.when(F.abs(down_power) < 1e-9, -F.expm1(-z)).otherwise(1 - F.pow(1 - z * down_power, 1 / down_power))
    return F.when(z >= 0, up).otherwise(down)


def _log_likelihood(sign: str, size: str, lam: str) -> str:
    """Aggregate: profile log-likelihood of a normal fit after the transform with ``lam`` (one value per group)."""
    z = _yeo_johnson_of_log(sign, size, lam)
    return f"-count({size}) / 2 * ln(var_pop({z})) + sum((({lam}) - 1) * {sign} * {size})"


def power_fit(
    df: DataFrame, keys, target: str = "y", low: float = -5.0, high: float = 5.0, points: int = 21, rounds: int = 4
) -> DataFrame:
    """Maximum-likelihood lambda per key with the mean and population deviation of the transformed target.

    Each round is one aggregate over the train rows that scores all grid points; the next round searches between the neighbours of the best point.
    """
    keys = list(keys)
    y = F.col(target)
    # rows of a series lie together (long series in blocks), so that a task sums up few series times grid points
    block = F.floor(F.col("t") / BLOCK_ROWS) if "t" in df.columns else F.lit(0)
    rows = _train(df).select(*keys, F.signum(y).alias("_sign"), F.log1p(F.abs(y)).alias("_size"), block.alias("_block"))
    if rounds > 1:
        rows = cut_lineage(rows, "power")
    half = (points - 1) // 2
    step = (high - low) / (points - 1)
    centre, best = F.lit((low + high) / 2), None
    for _ in range(rounds):
        scored = rows if best is None else rows.join(best, keys)
        offsets = F.explode(F.lit([i * step for i in range(-half, half + 1)]))
        scored = scored.repartition(task_count(df), *keys, "_block")
        scored = scored.select(*keys, "_sign", "_size", centre.alias("_centre"), offsets.alias("_offset"))
        # partial sums leave every task as one row per series and grid point
        likelihoods = (
            scored.withColumn("lambda", F.col("_centre") + F.col("_offset"))
            .groupBy(*keys, "lambda")
            .agg(F.expr(_log_likelihood("_sign", "_size", "lambda")).alias("_l"))
        )
        best = likelihoods.groupBy(*keys).agg(F.max_by("lambda", "_l").alias("lambda"))
        centre, step = F.col("lambda"), 2 * step / (points - 1)
    z = F.expr(_yeo_johnson_of_log("_sign", "_size", "lambda"))
    moments = rows.join(best, keys).groupBy(*keys, "lambda").agg(F.avg(z).alias("z_mean"), F.stddev_pop(z).alias("_sd"))
    return moments.withColumn("z_std", F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))).drop("_sd")


def power_transform(df: DataFrame, keys, fitted: DataFrame, target: str = "y") -> DataFrame:
    z = (F.expr(yeo_johnson(f"`{target}`", "lambda")) - F.col("z_mean")) / F.col("z_std")
    return df.join(fitted, list(keys)).withColumn(target, z)


def power_inverse(df: DataFrame, columns) -> DataFrame:
    """Undo :func:`power_transform` on columns of a table that carries its ``lambda, z_mean, z_std``."""
    return df.withColumns(
        {c: yeo_johnson_inverse(F.col(c) * F.col("z_std") + F.col("z_mean"), F.col("lambda")) for c in columns}
    )


def pca_fit(df: DataFrame, keys, columns, variance: float = 0.95) -> DataFrame:
    """Components of the standardised columns, from one aggregate of moments per series.

    Keeps the fewest components whose share of the variance exceeds ``variance``. The
    sign makes the largest loading positive. Series with missing train values get none.
    """
    keys, columns = list(keys), list(columns)
    p = len(columns)
    rows = _train(df)
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    moments = rows.groupBy(*keys).agg(
        F.min(complete).alias("_complete"),
        F.array(*[F.avg(c) for c in columns]).alias("mean"),
        F.array(*[F.stddev_pop(c) for c in columns]).alias("std"),
        F.array(*[F.covar_pop(columns[i], columns[j]) for i, j in cells]).alias("_cov"),
    ).where("_complete").drop("_complete")
    schema = T.StructType(
        [f for f in moments.schema.fields if f.name != "_cov"]
        + [
            T.StructField("loadings", T.ArrayType(T.ArrayType(T.DoubleType()))),
            T.StructField("explained", T.ArrayType(T.DoubleType())),
        ]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            loadings, explained, stds = [], [], []
            for std, cov in zip(batch["std"], batch["_cov"]):
                std = np.where(np.asarray(std) == 0, 1.0, std)
                full = np.zeros((p, p))
                for (i, j), c in zip(cells, cov):
                    full[i, j] = full[j, i] = c / (std[i] * std[j])
                values, vectors = np.linalg.eigh(full)
                values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1].T
                share = values / max(values.sum(), 1e-300)
                k = min(int(np.searchsorted(np.cumsum(share), variance, side="right")) + 1, p)
                signs = np.sign(vectors[np.arange(p), np.abs(vectors).argmax(axis=1)])
                loadings.append([list(v) for v in (vectors * signs[:, None])[:k]])
                explained.append(list(share[:k]))
                stds.append(list(std))
            yield batch.drop(columns=["_cov"]).assign(std=stds, loadings=loadings, explained=explained)

    return moments.mapInPandas(solve, schema)


def pca_transform(df: DataFrame, keys, fitted: DataFrame, columns) -> DataFrame:
    """Replace the columns by ``PC0, PC1, ..``; components a series does not keep are NULL."""
    columns = list(columns)
    z = F.array(*[(F.col(c) - F.col("mean")[i]) / F.col("std")[i] for i, c in enumerate(columns)])
    one = lambda weights: F.aggregate(
        F.zip_with(F.col("_z"), weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b
    )
    return (
        df.join(fitted, list(keys))
        .withColumn("_z", z)
        .withColumn("_scores", F.transform("loadings", one))
        .withColumns({f"PC{i}": F.get("_scores", F.lit(i)) for i in range(len(columns))})
        .drop("_z", "_scores", "mean", "std", "loadings", "explained", *columns)
    )


def ramp_feasible(start: Column, end: Column, max_factor: Column, slope: Column) -> Column:
    """Whether a ramp can climb to its factor and come back within its range; factor 1 always can."""
    a = F.abs(F.round(max_factor - 1, 3))
    full = F.floor(start + a / slope)
    down = F.floor(end - a / slope)
    return (a == 0) | ((full <= down) & (a >= slope))


def ramp_factor(t: Column, start: Column, end: Column, max_factor: Column, slope: Column) -> Column:
    """Scale factor at position t: climbs by ``slope`` per row, holds, and comes back before ``end``."""
    a = F.abs(F.round(max_factor - 1, 3))
    full = F.floor(start + a / slope)
    down = F.floor(end - a / slope)
    climbed = F.least(F.greatest(t - start + 1, F.lit(0)), full - start + 1) * slope
    fallen = F.greatest(t - down + 1, F.lit(0)) * slope
    level = F.greatest(F.least(climbed, a) - fallen, F.lit(0.0))
    inside = (t >= start) & (t < end) & (a > 0)
    return F.when(inside, 1 + F.signum(max_factor - 1) * level).otherwise(1.0)
