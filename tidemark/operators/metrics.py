"""Error metrics and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantile


def rmse(df: DataFrame, keys, actual: str = "y", prediction: str = "prediction", name: str = "rmse") -> DataFrame:
    """Root mean squared error per key; ``status`` is ``nan`` and the error NULL when a value is missing."""
    missing = (
        F.col(actual).isNull() | F.col(prediction).isNull() | F.isnan(actual) | F.isnan(prediction)
    )
    error = F.col(prediction) - F.col(actual)
    return df.groupBy(*keys).agg(
        F.when(~F.max(missing), F.sqrt(F.avg(error * error))).alias(name),
        F.when(F.max(missing), "nan").otherwise("ok").alias("status"),
    )


def align(predictions: DataFrame, actual: DataFrame, keys, t: str = "t") -> DataFrame:
    """Predictions with the observed value of the same series and position."""
    return predictions.join(actual, [*keys, t])


def rmse_ratio(runs: DataFrame, base: DataFrame, on) -> DataFrame:
    """Each run's error relative to the base model on the same scenario."""
    return runs.join(base, list(on)).withColumn("rmse_ratio", F.col("rmse") / F.col("rmse_base"))


def run_summary(runs: DataFrame, param: str = "param_id", group: str = "season") -> DataFrame:
    """Mean, population deviation and median over scenarios, per group and over all groups (group NULL).

    Expects ``rmse, rmse_ratio, rmse_base, n_cps, n_refits``. Base errors enter once per
    scenario, so their mean is over the same rows.
    """
    values = ("rmse", "rmse_ratio", "rmse_base")
    aggregates = [F.avg(v).alias(f"{v}_mean") for v in values] + [F.stddev_pop(v).alias(f"{v}_std") for v in values]
    aggregates += [F.sum("n_cps").alias("n_cps"), F.sum("n_refits").alias("n_refits")]
    levels = runs.withColumn("_g", F.explode(F.array(F.struct(F.col(group).alias("g"), F.lit(0).alias("all")),
                                                       F.struct(F.lit(None).cast(dict(runs.dtypes)[group]).alias("g"), F.lit(1).alias("all")))))
    levels = levels.withColumn("_group", F.col("_g.g")).withColumn("_all", F.col("_g.all")).drop("_g", group)
    summary = levels.groupBy(param, "_group", "_all").agg(*aggregates)
    median = exact_quantile(
        levels.withColumn("_gk", F.coalesce(F.col("_group").cast("string"), F.lit(""))),
        [param, "_gk", "_all"], "rmse_ratio", 0.5, "rmse_ratio_median",
    )
    return (
        summary.withColumn("_gk", F.coalesce(F.col("_group").cast("string"), F.lit("")))
        .join(median, [param, "_gk", "_all"], "left")
        .withColumnRenamed("_group", group)
        .drop("_gk", "_all")
    )


def pivot_scenarios(runs: DataFrame, scenarios, param: str | list[str] = "param_id", scenario: str = "scenario_id") -> DataFrame:
    """Wide form: one column per metric and known scenario."""
    values = ("rmse", "rmse_ratio", "rmse_base")
    return runs.groupBy(param).agg(
        *[
            F.max(F.when(F.col(scenario) == s, F.col(v))).alias(f"{v}_scen{s}")
            for v in values
            for s in scenarios
        ]
    )


def fold_summary(scores: DataFrame, keys, value: str = "rmse", prefix: str = "shuf_cv_") -> DataFrame:
    """Mean, population deviation and the list of fold values in fold order. Failed folds are skipped."""
    ok = scores.where(F.col(value).isNotNull())
    return ok.groupBy(*keys).agg(
        F.avg(value).alias(f"{prefix}{value}_mean"),
        F.stddev_pop(value).alias(f"{prefix}{value}_std"),
        F.transform(F.array_sort(F.collect_list(F.struct("fold", value))), lambda s: s[value]).alias(f"{prefix}{value}"),
    )
