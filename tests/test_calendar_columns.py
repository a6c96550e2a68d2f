import datetime as dt

import pandas as pd
import pytest
from conftest import by_series, series_frame
from pyspark.sql import functions as F

from tidemark.operators import calendar, columns, resample
from tidemark.spec import SeriesSpec

SPEC = SeriesSpec(season=7, step="day")
HOLIDAYS = {"2020-01-05": "no", "2020-01-06": "Karfreitag", "2020-01-09": "Ostermontag", "2020-02-29": "Karfreitag"}


def daily(spark, days=120, gap=None):
    df = series_frame(spark, {"a": [1.0] * days, "b": [2.0] * 20})
    pairs = [F.when(F.to_date("ts") == d, h) for d, h in HOLIDAYS.items()]
    df = df.withColumn("public_holiday", F.coalesce(*pairs, F.lit("no")))
    return df.where(gap) if gap else df


def counters_by_loop(rows, lags, day):
    """The last holiday written wins, as in a pass over the days."""
    dates = {r.ts.date(): 99 for r in rows}
    for r in sorted(rows, key=lambda r: r.ts):
        if (r.public_holiday != "no") if day is None else (r.public_holiday == day):
            for lag in lags:
                at = r.ts.date() + dt.timedelta(days=lag)
                if at in dates:
                    dates[at] = -lag
    return dates


@pytest.mark.parametrize("lags", [tuple(range(-7, 4)), (-9, -2, 0, 5)])
@pytest.mark.parametrize("block_rows", [65_536, 17])
@pytest.mark.parametrize("gap", [None, "t % 11 <> 5"])
def test_holiday_counters(spark, lags, block_rows, gap):
    spec = SeriesSpec(season=7, step="day", block_rows=block_rows)
    marked = calendar.mark_special_days(daily(spark, gap=gap), spec)
    out = calendar.add_holiday_counters(marked, spec, lags).collect()
    rows = marked.collect()
    assert len(out) == len(rows)
    for key in ("a", "b"):
        mine = [r for r in rows if r.series_id == key]
        for name, day in (("PublicHoliday", None), ("Valentine", "Valentine"), ("Karfreitag", "Karfreitag")):
            want = counters_by_loop(mine, lags, day)
            got = {r.ts.date(): r[f"cal_{name}_Counter"] for r in out if r.series_id == key}
            assert got == want


def test_special_days(spark):
    df = series_frame(spark, {"a": [0.0] * 800}).withColumn("public_holiday", F.lit("no"))
    marked = calendar.mark_special_days(df, SPEC).where("public_holiday <> 'no'").orderBy("t").collect()
    assert [(r.ts.date().isoformat(), r.public_holiday) for r in marked] == [
        ("2020-02-14", "Valentine"), ("2020-05-10", "MothersDay"), ("2021-02-14", "Valentine"),
        ("2021-05-09", "MothersDay"), ("2022-02-14", "Valentine"),
    ]


@pytest.mark.parametrize("season, parts", [(12, {"month"}), (7, {"month", "day_of_month", "weekday"}), (24, {"month", "day_of_month", "weekday", "hour"})])
def test_date_parts(spark, season, parts):
    out = calendar.add_date_parts(series_frame(spark, {"a": [1.0]}), SeriesSpec(season=season))
    assert {c.removeprefix("cal_date_") for c in out.columns if c.startswith("cal_")} == parts


def test_resample(spark):
    df = series_frame(spark, {"a": [float(i) for i in range(40)]}).withColumn("z", F.col("y")).drop("t")
    got = {r.ts.date(): (r.y, r.z) for r in resample.weekly(df, SPEC, sums=("y",)).collect()}
    frame = pd.DataFrame({"y": range(40)}, index=pd.date_range("2020-01-01", periods=40))
    want = {d.date(): (v.sum(), v.mean()) for d, v in frame["y"].resample("W")}
    assert got == want
    months = {r.ts.date(): r.y for r in resample.monthly(df, SPEC).collect()}
    assert months == {d.date(): v.mean() for d, v in frame["y"].resample("ME")}


def test_column_tools(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None, "x", float("nan")), (2, 2.0, 5.0, "y", 3.0)], "t long, a double, b double, c string, d double"
    ).withColumn("a2", F.col("a")).withColumn("b2", F.col("b")).withColumn("Unnamed: 0", F.lit(1))
    assert {(r.column_name, r.same_as) for r in columns.duplicate_columns(df, "t").collect()} == {("a2", "a"), ("b2", "b")}
    assert [r.s for r in columns.condense(df, ["a", "b"], "s").orderBy("t").collect()] == [None, 7.0]
    assert "Unnamed: 0" not in columns.drop_columns(df, containing="Unnamed").columns
    hot = columns.one_hot(df, columns.levels_of(df, ["c"])).orderBy("t").collect()
    assert [(r.c_x, r.c_y) for r in hot] == [(1, 0), (0, 1)]
    assert [r[0] for r in df.orderBy("t").select(columns.zero_if_nan(F.col("d"))).collect()] == [0.0, 3.0]
    checked = columns.has_missing(df, ["c"], ["a", "b", "d"]).orderBy("c").collect()
    assert [(r.a_missing, r.b_missing, r.d_missing) for r in checked] == [(False, True, True), (False, False, False)]
    typed = columns.set_types(df.drop("Unnamed: 0"), strings=("c",), keep=("t",))
    assert dict(typed.dtypes)["t"] == "bigint" and typed.where("d is null").count() == 1


def test_drop_dates_tolerates_absent_days(spark):
    df = series_frame(spark, {"a": [1.0] * 10}).where("t <> 4")
    assert by_series(columns.drop_dates(df, SPEC, "2020-01-04", "2020-01-06"), "t")["a"]["t"] == [0, 1, 2, 6, 7, 8, 9]


def test_dummy_rows_go(spark):
    df = spark.createDataFrame([(1, -9999.0), (2, 3.0), (3, None)], "t long, prediction double")
    assert [r.t for r in columns.drop_dummy(df).orderBy("t").collect()] == [2, 3]
