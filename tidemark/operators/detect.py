"""Online change points on seasonal differences.

Neither detector looks at model output, so scores of all series are computed
ahead of any fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.detectors import RunLengths, burn_in_rows, change_scores
from tidemark.functions.groups import map_sorted_groups
from tidemark.operators.blocks import block_window, expanding_moments, in_blocks
from tidemark.operators.features import seasonal_difference
from tidemark.operators.quantiles import exact_quantile
from tidemark.operators.scale import scale_columns, scale_lookback
from tidemark.session import task_count
from tidemark.spec import OnlineSpec, SeriesSpec


def change_finder_scores(
    df: DataFrame, spec: SeriesSpec, online: OnlineSpec | list[OnlineSpec], with_scale: bool = False, density: str = "after"
) -> DataFrame:
    """Seasonal difference ``dy`` and change score of each row.

    The score forgets its past exponentially. A block therefore starts its scan
    a burn-in before its first row, after which the scores equal those of a scan
    from the start of the series to the last digit, and one long series is scored
    by many tasks. With ``with_scale`` the output scale is computed in the same pass.
    """
    variants = [o.resolved(spec.season) for o in (online if isinstance(online, (list, tuple)) else [online])]
    season = spec.season
    lookback = max(
        max(season + burn_in_rows(o.cf_r, o.cf_order, o.cf_smooth), scale_lookback(season, o.scale_window))
        for o in variants
    )
    keys = [*spec.keys, "_block"]
    extra = [c for c in df.columns if c not in (*spec.keys, "t", spec.target)]
    blocks = (
        in_blocks(df, spec, lookback)
        .repartition(task_count(df), *keys)
        .sortWithinPartitions(*keys, "t")
    )
    if with_scale:
        blocks = blocks.select("*", _scale_by_variant(spec, variants).alias("scale"))
        extra = [*extra, "scale"]
    schema = T.StructType(
        [blocks.schema[c] for c in (*spec.keys, "t", spec.target, *extra)]
        + [T.StructField("dy", T.DoubleType()), T.StructField("score", T.DoubleType())]
    )
    target = spec.target
    settings = [(o.cf_r, o.cf_order, o.cf_smooth) for o in variants]
    several = len(variants) > 1
    columns = [f.name for f in schema.fields]

    def score(group: pd.DataFrame) -> pd.DataFrame:
        y = group[target].to_numpy(dtype=float)
        dy, scores = np.full(len(y), np.nan), np.full(len(y), np.nan)
        if len(y) > season:
            r, order, smooth = settings[int(group["param_id"].iloc[0]) if several else 0]
            dy[season:] = y[season:] - y[:-season]
            scores[season:] = change_scores(dy[season:], r, order, smooth, density)
        out = group.assign(dy=dy, score=scores)
        return out.loc[~group["_halo"].to_numpy(), columns]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map_sorted_groups(batches, keys, score)

    out = blocks.mapInPandas(scan, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("dy", "score")})


def _scale_by_variant(spec: SeriesSpec, variants: list[OnlineSpec]) -> Column:
    """Output scale by each row's own window and number of seasons."""
    w = block_window(spec)
    chosen = None
    for window, seasons in sorted({(o.scale_window, o.scale_seasons) for o in variants}):
        scale = scale_columns(w, spec.target, spec.season, window, seasons)["scale"]
        users = [i for i, o in enumerate(variants) if (o.scale_window, o.scale_seasons) == (window, seasons)]
        if len(users) == len(variants):
            return scale
        mine = F.col("param_id").isin(users)
        chosen = F.when(mine, scale) if chosen is None else chosen.when(mine, scale)
    return chosen


def change_points_by_score(scores: DataFrame, spec: SeriesSpec, percentile) -> DataFrame:
    """Flag test rows whose score reaches the percentile of the train scores.

    ``percentile`` is a number, or a list of them that rows refer to by ``param_id``.
    """
    train = scores.where((F.col("t") < F.col("n_train")) & F.col("score").isNotNull())
    if isinstance(percentile, (list, tuple)):
        parts = [
            exact_quantile(train.where(F.col("param_id").isin([i for i, q in enumerate(percentile) if q == p])),
                           spec.keys, "score", p / 100, "threshold")
            for p in sorted(set(percentile))
        ]
        thresholds = reduce(DataFrame.unionByName, parts)
    else:
        thresholds = exact_quantile(train, spec.keys, "score", percentile / 100, "threshold")
    is_test = F.col("t") >= F.col("n_train")
    return scores.join(thresholds, list(spec.keys), "left").withColumn(
        "change_point", F.coalesce(is_test & (F.col("score") >= F.col("threshold")), F.lit(False))
    )


def run_length_change_points(df: DataFrame, spec: SeriesSpec, online: OnlineSpec) -> DataFrame:
    """Flag test rows at which the most likely run length falls.

    Train differences are standardised by the train mean and deviation, a test
    difference by those of all differences before it. The posterior is a recursion
    over the whole past, so each series is read in order by one task, which holds
    only the run lengths with noticeable mass.
    """
    online = online.resolved(spec.season)
    keys = list(spec.keys)
    rows = seasonal_difference(df, spec).where(F.col("dy").isNotNull())
    rows = expanding_moments(rows, spec, "dy")
    train = rows.where(F.col("t") < F.col("n_train")).groupBy(*keys).agg(
        F.avg("dy").alias("_m"), F.stddev_pop("dy").alias("_s")
    )
    in_train = F.col("t") < F.col("n_train")
    mean = F.when(in_train, F.col("_m")).otherwise(F.col("mean_seen"))
    std = F.when(in_train, F.col("_s")).otherwise(F.col("std_pop_seen"))
    z = F.coalesce((F.col("dy") - mean) / F.nullif(std, F.lit(0.0)), F.lit(0.0))
    ready = (
        rows.join(train, keys)
        .withColumn("z", z)
        .drop("_m", "_s", "n_seen", "mean_seen", "std_pop_seen", "std_samp_seen")
        .repartition(task_count(df), *keys)
        .sortWithinPartitions(*keys, "t")
    )
    schema = T.StructType(
        [f for f in ready.schema.fields if f.name != "z"]
        + [T.StructField("run_length", T.LongType()), T.StructField("change_point", T.BooleanType())]
    )
    hazard = online.const_hazard

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, before = None, None, None
        for batch in batches:
            ids = list(zip(*[batch[k] for k in keys]))
            runs, flags = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=bool)
            t, n_train = batch["t"].to_numpy(), batch["n_train"].to_numpy()
            for i, (key, z) in enumerate(zip(ids, batch["z"].to_numpy())):
                if key != current:
                    current, state, before = key, RunLengths(hazard), None
                runs[i] = state.update(z)
                # the first test row has no earlier test row to compare with
                flags[i] = t[i] > n_train[i] and runs[i] < before
                before = runs[i]
            yield batch.drop(columns=["z"]).assign(run_length=runs, change_point=flags)

    return ready.mapInPandas(scan, schema)
