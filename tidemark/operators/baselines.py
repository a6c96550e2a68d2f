"""Naive rivals: random walk, seasonal random walk, historical average."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import expanding_moments, windowed
from tidemark.operators.splits import TEST, TRAIN
from tidemark.spec import DUMMY_PREDICTION, SeriesSpec


def random_walk(
    df: DataFrame, spec: SeriesSpec, lag: int = 1, one_step: bool = False, name: str = "prediction", dummy: bool = False
) -> DataFrame:
    """Prediction = value ``lag`` rows back; many steps ahead, the last ``lag`` train values repeat.

    Needs ``split`` and ``n_train``. Rows without a value ``lag`` rows back get NULL, or
    the exported marker with ``dummy``.
    """
    y = spec.target
    by_fold = spec.with_keys("fold") if "fold" in df.columns else spec
    keys = list(by_fold.keys)
    shifted = windowed(df, by_fold, lag, lambda w: {"_shifted": F.lag(y, lag).over(w)})
    if dummy:
        shifted = shifted.withColumn("_shifted", F.coalesce("_shifted", F.lit(DUMMY_PREDICTION)))
    if one_step:
        return shifted.withColumnRenamed("_shifted", name)
    # A train part shorter than the lag repeats as a whole.
    cycle = F.least(F.lit(lag), F.col("n_train"))
    first = F.col("n_train") - cycle
    last_values = (
        df.where((F.col("split") == TRAIN) & (F.col("t") >= first))
        .select(*keys, (F.col("t") - first).alias("_phase"), F.col(y).alias("_last"))
    )
    phase = F.when(F.col("split") == TEST, F.pmod(F.col("t") - F.col("n_train"), cycle))
    return (
        shifted.withColumn("_phase", phase)
        .join(last_values, [*keys, "_phase"], "left")
        .withColumn(name, F.when(F.col("split") == TEST, F.col("_last")).otherwise(F.col("_shifted")))
        .drop("_phase", "_last", "_shifted")
    )


def historical_average(
    df: DataFrame, spec: SeriesSpec, one_step: bool = False, name: str = "prediction"
) -> DataFrame:
    """Train mean; one step ahead, each test row gets the mean of all rows before it."""
    by_fold = spec.with_keys("fold") if "fold" in df.columns else spec
    keys = list(by_fold.keys)
    means = df.where(F.col("split") == TRAIN).groupBy(*keys).agg(F.avg(spec.target).alias("_mean"))
    out = df.join(means, keys, "left")
    if not one_step:
        return out.withColumnRenamed("_mean", name)
    seen = expanding_moments(out, by_fold, spec.target)
    return seen.withColumn(name, F.when(F.col("split") == TEST, F.col("mean_seen")).otherwise(F.col("_mean"))).drop(
        "_mean", "n_seen", "mean_seen", "std_pop_seen", "std_samp_seen"
    )


def all_baselines(df: DataFrame, spec: SeriesSpec, one_step: bool = False) -> DataFrame:
    """The three rivals side by side in long form: ``model, prediction``."""
    out = random_walk(df, spec, 1, one_step, "rw")
    out = random_walk(out, spec, spec.season, one_step, "seasonal_rw")
    out = historical_average(out, spec, one_step, "hist_avg")
    models = ("rw", "seasonal_rw", "hist_avg")
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in models])
    return out.withColumn("_p", F.explode(pairs)).select(
        *[c for c in out.columns if c not in models], "_p.model", "_p.prediction"
    )
