"""Calendar features: date parts, special days, holiday counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.spec import EVENT_LAGS, NO_HOLIDAY_NEAR, SPECIAL_DAYS, SeriesSpec

HOLIDAY = "public_holiday"
NO_HOLIDAY = "no"


def add_date_parts(df: DataFrame, spec: SeriesSpec, season: int | None = None) -> DataFrame:
    """Month always; day and weekday (Monday 0) unless quarterly or monthly; hour for a daily season."""
    season = spec.season if season is None else season
    ts = F.col(spec.ts)
    parts = {"cal_date_month": F.month(ts)}
    if season not in (4, 12):
        parts["cal_date_day_of_month"] = F.dayofmonth(ts)
        parts["cal_date_weekday"] = F.weekday(ts)
    if season == 24:
        parts["cal_date_hour"] = F.hour(ts)
    return df.withColumns(parts)


def mark_special_days(df: DataFrame, spec: SeriesSpec, holiday: str = HOLIDAY) -> DataFrame:
    """Valentine's day and mother's day (second Sunday of May) overwrite the holiday column."""
    ts = F.col(spec.ts)
    mothers_day = (F.month(ts) == 5) & (F.weekday(ts) == 6) & F.dayofmonth(ts).between(8, 14)
    valentine = (F.month(ts) == 2) & (F.dayofmonth(ts) == 14)
    return df.withColumn(
        holiday, F.when(mothers_day, "MothersDay").when(valentine, "Valentine").otherwise(F.col(holiday))
    )


def _is_contiguous(lags) -> bool:
    return sorted(lags) == list(range(min(lags), max(lags) + 1))


def add_holiday_counters(
    df: DataFrame,
    spec: SeriesSpec,
    event_lags=EVENT_LAGS,
    special_days=SPECIAL_DAYS,
    holiday: str = HOLIDAY,
) -> DataFrame:
    """Days until (negative: since) a near holiday, else 99; the latest holiday wins.

    One counter for any holiday and one for each special day. The holiday column
    itself is dropped. Holidays are few, so they are joined to the days around
    them; with contiguous lags a bounded range frame per year part does the same
    without a join.
    """
    counters = {"cal_PublicHoliday_Counter": F.col(holiday) != NO_HOLIDAY}
    counters |= {f"cal_{d}_Counter": F.col(holiday) == d for d in special_days}
    build = _counters_by_frame if _is_contiguous(event_lags) else _counters_by_join
    return build(df, spec, event_lags, counters).drop(holiday)


def _counters_by_frame(df: DataFrame, spec: SeriesSpec, lags, counters: dict[str, Column]) -> DataFrame:
    # Blocks of days with a halo on both sides, so that one long series spreads over many tasks.
    reach = max(abs(lag) for lag in lags)
    size = max(spec.block_rows, 2 * reach + 1)
    day = F.unix_date(F.to_date(spec.ts))
    own = F.floor(day / size)
    copies = F.array(
        own,
        F.when(F.pmod(day, F.lit(size)) >= size - reach, own + 1),
        F.when(F.pmod(day, F.lit(size)) < reach, own - 1),
    )
    rows = df.withColumn("_day", day).withColumn("_own", own).withColumn("_block", F.explode(F.array_compact(copies)))
    frame = Window.partitionBy(*spec.keys, "_block").orderBy("_day").rangeBetween(-max(lags), -min(lags))
    out = rows.select(
        "*",
        *[
            F.coalesce(F.max(F.when(hit, F.col("_day"))).over(frame) - F.col("_day"), F.lit(NO_HOLIDAY_NEAR)).alias(name)
            for name, hit in counters.items()
        ],
    )
    return out.where(F.col("_block") == F.col("_own")).drop("_day", "_own", "_block")


def _counters_by_join(df: DataFrame, spec: SeriesSpec, lags, counters: dict[str, Column]) -> DataFrame:
    keys = list(spec.keys)
    day = F.unix_date(F.to_date(spec.ts))
    rows = df.withColumn("_day", day)
    any_hit = reduce(lambda a, b: a | b, counters.values())
    near = (
        rows.where(any_hit)
        .select(*keys, F.col("_day").alias("_h"), *[hit.alias(f"_is_{n}") for n, hit in counters.items()])
        .withColumn("_lag", F.explode(F.array(*[F.lit(lag) for lag in lags])))
        .withColumn("_day", F.col("_h") + F.col("_lag"))
        .groupBy(*keys, "_day")
        .agg(*[F.max(F.when(F.col(f"_is_{n}"), F.col("_h"))).alias(f"_last_{n}") for n in counters])
    )
    return (
        rows.join(near, [*keys, "_day"], "left")
        .withColumns(
            {n: F.coalesce(F.col(f"_last_{n}") - F.col("_day"), F.lit(NO_HOLIDAY_NEAR)) for n in counters}
        )
        .drop("_day", *[f"_last_{n}" for n in counters])
    )


def add_calendar(df: DataFrame, spec: SeriesSpec, event_lags=EVENT_LAGS, special_days=SPECIAL_DAYS, season=None) -> DataFrame:
    out = add_date_parts(df, spec, season)
    if HOLIDAY in df.columns:
        out = add_holiday_counters(mark_special_days(out, spec), spec, event_lags, special_days)
    return out
