"""Output scale: the target's level now against the same place in earlier seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.blocks import full_frame, windowed
from tidemark.spec import SeriesSpec


def scale_lookback(season: int, window: int) -> int:
    return 2 * season + window


def scale_columns(w: WindowSpec, target: str, season: int, window: int, seasons: int = 2) -> dict[str, Column]:
    """Level of the last ``window`` rows, of the same rows one and two seasons back, and their ratio.

    NULL until all values are there, and where an earlier level is 0.
    """
    y = F.col(target)
    now = full_frame(y, F.avg, w, window, 0)
    one_back = full_frame(y, F.avg, w, window, -season)
    ratio = now / F.nullif(one_back, F.lit(0.0))
    columns = {"mean_now": now, "mean_prev1": one_back}
    if seasons == 2:
        two_back = full_frame(y, F.avg, w, window, -2 * season)
        columns["mean_prev2"] = two_back
        ratio = (ratio + now / F.nullif(two_back, F.lit(0.0))) / 2
    columns["scale"] = ratio
    return columns


def output_scale(df: DataFrame, spec: SeriesSpec, window: int, seasons: int = 2) -> DataFrame:
    return windowed(
        df,
        spec,
        scale_lookback(spec.season, window),
        lambda w: scale_columns(w, spec.target, spec.season, window, seasons),
    )
