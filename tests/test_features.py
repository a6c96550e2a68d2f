from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from conftest import by_series, close, series_frame
from pyspark.sql import functions as F

from tidemark.operators import blocks, features, scale
from tidemark.spec import FeatureSpec, SeriesSpec

SPEC = SeriesSpec(season=7, step="day")


@pytest.fixture()
def values(rng):
    long = rng.normal(50, 10, 90).round(2).tolist()
    for i in (5, 33, 34, 60):
        long[i] = None
    return {"long": long, "other": rng.normal(5, 1, 61).round(2).tolist(), "short": [1.0, 2.0, 3.0], "one": [4.0]}


@pytest.mark.parametrize("block_rows", [65_536, 16])
def test_statistics_equal_pandas(spark, values, block_rows):
    spec = replace(SPEC, block_rows=block_rows)
    df = features.add_statistics(
        series_frame(spark, values), spec, FeatureSpec(lags=(1, 2, 9), window=4, seasonal_window=3), weekday=False
    )
    names = [c for c in df.columns if c.startswith("stat_")]
    got = by_series(df, *names)
    assert {k: len(v[names[0]]) for k, v in got.items()} == {k: len(v) for k, v in values.items()}
    for key, y in values.items():
        s = pd.Series(y, dtype=float)
        want = {f"stat_y_lag{i}": s.shift(i) for i in (1, 2, 9)}
        want |= {f"stat_y_seaslag{i}": s.shift(7 + i - 1) for i in (1, 2, 9)}
        want["stat_y_rolling_mean4"] = s.shift(1).rolling(4).mean()
        want["stat_y_rolling_max4"] = s.shift(1).rolling(4).max()
        want["stat_y_rolling_seasonal_mean3"] = s.shift(8).rolling(3).mean()
        want["stat_y_rolling_seasonal_max3"] = s.shift(8).rolling(3).max()
        assert set(want) == set(names)
        for name, column in want.items():
            assert close(got[key][name], column), (key, name)


def test_seasonal_window_longer_than_season_gives_nothing(spark, values):
    df = features.add_statistics(
        series_frame(spark, values), SPEC, FeatureSpec(lags=(1,), seasonal_window=8), weekday=False
    )
    assert not [c for c in df.columns if "rolling_seasonal" in c]


def test_non_seasonal_features_get_only_lags_and_mean(spark, values):
    df = series_frame(spark, values).withColumn("mean_temp", F.col("y"))
    out = features.add_statistics(df, SPEC, FeatureSpec(features=("mean_temp",), lags=(1,)))
    assert sorted(c for c in out.columns if c.startswith("stat_")) == ["stat_mean_temp_lag1", "stat_mean_temp_rolling_mean7"]


def test_weekday_statistics_ignore_gaps(spark, values):
    df = series_frame(spark, values).where("t % 10 <> 4")
    out = features.add_weekday_statistics(df, SPEC, ("y",), 2)
    got = by_series(out, "t", "stat_y_weekday_rolling_mean2", "stat_y_weekday_rolling_max2")
    for key, y in values.items():
        s = pd.DataFrame({"y": pd.Series(y, dtype=float), "day": pd.date_range("2020-01-01", periods=len(y)).weekday})
        s = s[s.index % 10 != 4]
        rolled = s.groupby("day")["y"].transform(lambda v: v.shift(1).rolling(2).mean())
        assert got[key]["t"] == list(s.index)
        assert close(got[key]["stat_y_weekday_rolling_mean2"], rolled)


def test_position_numbers_rows_over_time_buckets(spark, rng):
    days = sorted(rng.choice(4000, 300, replace=False).tolist())
    df = spark.createDataFrame([("a", d) for d in days] + [("b", 3)], "series_id string, d int").select(
        "series_id", F.date_add(F.lit("2000-01-01").cast("date"), F.col("d")).cast("timestamp").alias("ts"), "d"
    )
    out = blocks.with_position(df, replace(SPEC, block_rows=100))
    got = by_series(out, "t", "d")
    assert got["a"]["t"] == list(range(300)) and got["a"]["d"] == days
    assert got["b"]["t"] == [0]


@pytest.mark.parametrize("step", ["hour", "day", "week", "month", "quarter"])
def test_dense_calendar_fills_gaps(spark, step):
    freq = {"hour": "h", "day": "D", "week": "W-MON", "month": "MS", "quarter": "QS"}[step]
    df = series_frame(spark, {"a": [float(i) for i in range(9)]}, "1999-11-01", freq).where("t not in (3, 4)").drop("t")
    got = by_series(blocks.dense_calendar(df, SeriesSpec(step=step)), "t", "y", "ts")["a"]
    assert got["t"] == list(range(9))
    assert got["y"] == [0.0, 1.0, 2.0, 0.0, 0.0, 5.0, 6.0, 7.0, 8.0]
    assert got["ts"] == [d.to_pydatetime() for d in pd.date_range("1999-11-01", periods=9, freq=freq)]


@pytest.mark.parametrize("current", [False, True])
def test_expanding_moments(spark, values, current):
    out = blocks.expanding_moments(series_frame(spark, values), replace(SPEC, block_rows=13), current=current)
    got = by_series(out, "n_seen", "mean_seen", "std_pop_seen", "std_samp_seen")
    for key, y in values.items():
        s = pd.Series(y, dtype=float)
        s = s if current else s.shift(1)
        grown = s.expanding()
        assert close(got[key]["n_seen"], grown.count() if len(y) > 1 or current else [0])
        assert close(got[key]["mean_seen"], grown.mean())
        assert close(got[key]["std_samp_seen"], grown.std())
        assert close(got[key]["std_pop_seen"], grown.std(ddof=0))


def test_last_rows_join(spark, values):
    ends = spark.createDataFrame([("long", 0), ("long", 11), ("long", 80), ("short", 2)], "series_id string, e long")
    rows = series_frame(spark, values).select("series_id", "t", "y")
    got = blocks.last_rows_join(rows, ends, SPEC, "e", 12).groupBy("series_id", "e").agg(F.sort_array(F.collect_list("t")).alias("t"))
    assert {(r.series_id, r.e): r.t for r in got.collect()} == {
        ("long", 0): [0], ("long", 11): list(range(12)), ("long", 80): list(range(69, 81)), ("short", 2): [0, 1, 2],
    }


def test_output_scale(spark, rng):
    y = rng.uniform(1, 9, 60).tolist()
    for seasons in (1, 2):
        got = by_series(scale.output_scale(series_frame(spark, {"a": y}), SPEC, 3, seasons), "scale")["a"]["scale"]
        for t in range(60):
            level = lambda back: np.mean(y[t - back - 2 : t - back + 1])
            if t < 7 * seasons + 2:
                assert got[t] is None
            else:
                ratios = [level(0) / level(7 * (k + 1)) for k in range(seasons)]
                assert got[t] == pytest.approx(np.mean(ratios))


def test_scale_of_zero_season_is_null(spark):
    got = by_series(scale.output_scale(series_frame(spark, {"a": [0.0] * 20 + [1.0] * 10}), SPEC, 2, 1), "scale")
    assert all(v is None for v in got["a"]["scale"][:24])


def test_empty_table(spark):
    empty = series_frame(spark, {"a": [1.0]}).limit(0)
    assert features.add_statistics(empty, SPEC, FeatureSpec()).count() == 0
    assert blocks.dense_calendar(empty.drop("t"), SPEC).count() == 0
