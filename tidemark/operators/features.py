"""Lag, rolling, seasonal and weekday features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.blocks import full_frame, windowed, with_position
from tidemark.spec import FeatureSpec, SeriesSpec


def lag_columns(w: WindowSpec, features, lags) -> dict[str, Column]:
    return {f"stat_{f}_lag{i}": F.lag(f, i).over(w) for f in features for i in lags}


def seasonal_lag_columns(w: WindowSpec, features, lags, season: int) -> dict[str, Column]:
    return {f"stat_{f}_seaslag{i}": F.lag(f, season + i - 1).over(w) for f in features for i in lags}


def rolling_columns(w: WindowSpec, features, n: int, maxima=None) -> dict[str, Column]:
    """Mean (and maximum, for ``maxima``) of the n rows before the current one."""
    maxima = features if maxima is None else maxima
    columns = {f"stat_{f}_rolling_mean{n}": full_frame(F.col(f), F.avg, w, n) for f in features}
    columns |= {f"stat_{f}_rolling_max{n}": full_frame(F.col(f), F.max, w, n) for f in maxima}
    return columns


def rolling_seasonal_columns(w: WindowSpec, features, n: int, season: int) -> dict[str, Column]:
    """As :func:`rolling_columns` one season earlier; nothing when the season is shorter than the window."""
    if season < n:
        return {}
    last = -(season + 1)
    columns = {f"stat_{f}_rolling_seasonal_mean{n}": full_frame(F.col(f), F.avg, w, n, last) for f in features}
    columns |= {f"stat_{f}_rolling_seasonal_max{n}": full_frame(F.col(f), F.max, w, n, last) for f in features}
    return columns


def seasonal_difference(df: DataFrame, spec: SeriesSpec, name: str = "dy") -> DataFrame:
    y = F.col(spec.target)
    return windowed(df, spec, spec.season, lambda w: {name: y - F.lag(y, spec.season).over(w)})


def add_statistics(
    df: DataFrame, spec: SeriesSpec, features: FeatureSpec, season: int | None = None, weekday: bool = True
) -> DataFrame:
    """All lag and rolling features in one pass over the series, then the weekday features."""
    season = spec.season if season is None else season
    seasonal = tuple(f for f in features.features if f not in features.non_seasonal)
    n = features.window or season
    n_seasonal = features.seasonal_window or season

    def columns(w: WindowSpec) -> dict[str, Column]:
        out = lag_columns(w, features.features, features.lags)
        out |= seasonal_lag_columns(w, seasonal, features.lags, season)
        out |= rolling_columns(w, features.features, n, seasonal)
        out |= rolling_seasonal_columns(w, seasonal, n_seasonal, season)
        return out

    lookback = max([season + i for i in features.lags] + [n, season + n_seasonal + 1])
    out = windowed(df, spec, lookback, columns)
    wanted = features.weekday_stats if features.weekday_stats is not None else season == 7
    return add_weekday_statistics(out, spec, seasonal, features.weekday_window) if weekday and wanted else out


def add_weekday_statistics(df: DataFrame, spec: SeriesSpec, features, n: int = 4) -> DataFrame:
    """Rolling mean and maximum over the last n rows of the same weekday.

    Each (series, weekday) pair is a series of its own with its own positions, so
    gaps in the dates do not shift the frames.
    """
    daily = df.withColumnRenamed("t", "_t").withColumn("_weekday", F.weekday(spec.ts))
    per_day = spec.with_keys("_weekday")

    def columns(w: WindowSpec) -> dict[str, Column]:
        out = {f"stat_{f}_weekday_rolling_mean{n}": full_frame(F.col(f), F.avg, w, n) for f in features}
        out |= {f"stat_{f}_weekday_rolling_max{n}": full_frame(F.col(f), F.max, w, n) for f in features}
        return out

    return windowed(with_position(daily, per_day), per_day, n, columns).drop("t", "_weekday").withColumnRenamed("_t", "t")
