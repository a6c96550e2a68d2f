"""Calendar resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.spec import SeriesSpec


def _resample(df: DataFrame, spec: SeriesSpec, label, sums) -> DataFrame:
    values = [c for c in df.columns if c not in (*spec.keys, spec.ts, "t")]
    return df.groupBy(*spec.keys, label.alias(spec.ts)).agg(
        *[(F.coalesce(F.sum(c), F.lit(0)) if c in sums else F.avg(c)).alias(c) for c in values]
    )


def weekly(df: DataFrame, spec: SeriesSpec, sums=()) -> DataFrame:
    """Weeks ending on Sunday: sums of the target columns (0 where all are missing), means of all others."""
    label = F.date_add(F.to_date(F.date_trunc("week", F.col(spec.ts))), 6).cast("timestamp")
    return _resample(df, spec, label, sums)


def monthly(df: DataFrame, spec: SeriesSpec, sums=()) -> DataFrame:
    """Months labelled by their last day, means of all columns but ``sums``."""
    return _resample(df, spec, F.last_day(spec.ts).cast("timestamp"), sums)
