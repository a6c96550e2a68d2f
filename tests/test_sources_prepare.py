import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from conftest import by_series, close, series_frame
from pyspark.sql import functions as F

from tidemark.operators.blocks import with_position
from tidemark.plans import prepare, search
from tidemark.session import new_table_path
from tidemark.sources import csv_series
from tidemark.spec import DatasetSpec, FeatureSpec, SeriesSpec

DAILY = SeriesSpec(season=7, step="day", target="Sold")

HEADER = "Date;Sold;Wholesale;mean_temp;total_prec_flag;public_holiday;school_holiday;Unnamed: 7"


def write_text(tmp_path, lines):
    file = tmp_path / "table.csv"
    file.write_text("\n".join([HEADER, *lines]))
    return str(file)


def test_read_european_table(spark, tmp_path):
    path = write_text(tmp_path, ["07.02.2020;448;;-0,333333333;False;no;no;", "2020-02-08;;12.5;8,6875;True;Karfreitag;winterferien;"])
    df = csv_series.read_series(spark, path)
    assert [(c, t) for c, t in df.dtypes] == [
        ("series_id", "string"), ("ts", "timestamp"), ("Sold", "double"), ("Wholesale", "double"), ("mean_temp", "double"),
        ("total_prec_flag", "double"), ("public_holiday", "string"), ("school_holiday", "string"),
    ]
    rows = df.orderBy("ts").collect()
    assert tuple(rows[0])[1:] == (dt.datetime(2020, 2, 7), 448.0, None, -0.333333333, 0.0, "no", "no")
    assert tuple(rows[1])[1:] == (dt.datetime(2020, 2, 8), None, 12.5, 8.6875, 1.0, "Karfreitag", "winterferien")


def test_write_and_read_back(spark):
    df = series_frame(spark, {"a": [1.5, None, -2.25]}).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    path = new_table_path(spark, "csv")
    csv_series.write_series(df.select("day", "series_id", "y", F.array("t").alias("nested")), path)
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    assert "1,5000000000" in text and "-2,2500000000" in text and "[0]" in text
    back = csv_series.read_series(spark, path, index="day", key="series_id").orderBy("ts").collect()
    assert [r.y for r in back] == [1.5, None, -2.25]


def test_results_by_run_key(spark):
    path = new_table_path(spark, "results")
    csv_series.write_results(spark.createDataFrame([("x", 1.0), ("y", 2.0)], "target string, rmse double"), path, ["target"])
    assert spark.read.parquet(path).where("target = 'y'").first().rmse == 2.0


def test_stored_settings(spark):
    text = '{"config_id": 3, "kernel": "[[\\"rbf\\"]]", "alpha": 0.1, "n_restarts": 5, "standardize": true, "normalize_y": false}'
    row = spark.createDataFrame([(text,)], "j string").select(search.stored_settings(F.col("j")).alias("s")).first().s
    assert (row.config_id, row.alpha, row.standardize, row.normalize_y, row.dim_reduction) == (3, 0.1, True, False, None)


@pytest.fixture()
def raw(spark, rng):
    n = 95
    days = pd.date_range("2020-02-07", periods=n)
    rows = []
    for i, d in enumerate(days):
        sold = None if i in (4, 40, 41) else float(rng.integers(50, 400))
        holiday = {"2020-04-10": "Karfreitag", "2020-04-13": "Ostermontag", "2020-05-01": "Erster Mai"}.get(d.strftime("%Y-%m-%d"), "no")
        rows.append(("shop", d.to_pydatetime(), sold, float(rng.integers(0, 900)), float(rng.normal(8, 4)), holiday, "osterferien" if 60 <= i < 74 else "no"))
    return spark.createDataFrame(rows, "series_id string, ts timestamp, Sold double, Wholesale double, mean_temp double, public_holiday string, school_holiday string")


DATA = DatasetSpec("shop", series=DAILY, features=FeatureSpec(features=("Sold", "mean_temp"), lags=(1, 7)), targets=("Sold", "Wholesale"))


def test_prepared_table(spark, raw):
    out = prepare.prepare(raw, DATA, "full", "mean")
    names = prepare.feature_columns(out, DAILY)
    assert "Wholesale" not in names and "public_holiday" not in names
    assert {"school_holiday_no", "school_holiday_osterferien", "cal_date_weekday", "cal_PublicHoliday_Counter", "cal_Karfreitag_Counter",
            "stat_Sold_seaslag7", "stat_mean_temp_lag1", "stat_Sold_weekday_rolling_mean4", "stat_Sold_rolling_seasonal_max7"} <= set(names)
    assert "stat_mean_temp_seaslag1" not in names
    rows = out.orderBy("t").collect()
    assert [r.t for r in rows] == list(range(95)) and [r.split for r in rows] == ["train"] * 76 + ["test"] * 19
    source = [r.Sold for r in raw.orderBy("ts").collect()]
    mean = np.mean([v for v in source[:76] if v is not None])
    filled = [mean if v is None else v for v in source]
    assert close([r.Sold for r in rows], filled)
    lagged = [None] + filled[:-1]
    assert close([r.stat_Sold_lag1 for r in rows][1:], lagged[1:])
    # rows without a lag get the train mean of the feature
    assert rows[0].stat_Sold_lag1 == pytest.approx(np.mean(lagged[1:76]))
    assert out.dropna().count() == 95


@pytest.mark.parametrize("featureset, has, lacks", [("none", [], ["stat_", "cal_"]), ("cal", ["cal_"], ["stat_"]), ("stat", ["stat_"], ["cal_", "holiday"])])
def test_feature_sets(spark, raw, featureset, has, lacks):
    names = prepare.feature_columns(prepare.prepare(raw, DATA, featureset, None), DAILY)
    assert all(any(p in n for n in names) for p in has) and not any(p in n for n in names for p in lacks)
    if featureset == "none":
        assert "public_holiday_Karfreitag" in names


def test_rows_without_target_are_dropped_when_not_imputed(spark, raw):
    out = prepare.prepare(raw, DATA, "cal", None)
    assert out.count() == 92 and sorted(r.t for r in out.collect()) == list(range(92))


def test_expanding_folds_impute_with_their_own_train_rows(spark, raw):
    spec = replace(DATA, split_perc=None, series=replace(DAILY, season=20))
    out = prepare.prepare(raw, spec, "none", "mean")
    source = [r.Sold for r in raw.orderBy("ts").collect()]
    for fold in (0, 1):
        rows = out.where(F.col("fold") == fold).orderBy("t").collect()
        cut = 40 + 20 * fold
        assert [r.split for r in rows] == ["train"] * cut + ["test"] * 20
        assert rows[4].Sold == pytest.approx(np.mean([v for v in source[:cut] if v is not None]))


def test_weekly_preparation(spark, raw):
    spec = replace(DATA, weekly=True, series=replace(DAILY, season=28))
    out = prepare.prepare(raw, spec, "full", "mean")
    rows = out.orderBy("t").collect()
    assert [r.t for r in rows] == list(range(15))
    source = pd.Series([r.Sold for r in raw.orderBy("ts").collect()], index=pd.date_range("2020-02-07", periods=95), dtype=float)
    source = source.fillna(source[:76].mean())
    assert close([r.Sold for r in rows], source.resample("W").sum())
    assert rows[5].stat_Sold_seaslag2 == pytest.approx(source.resample("W").sum().iloc[0])
    assert "cal_date_weekday" not in out.columns and "cal_date_month" in out.columns


def test_reduced_features(spark, raw):
    out = prepare.prepare(raw, DATA, "full", "mean", "pca")
    assert {c for c in prepare.feature_columns(out, DAILY)} >= {"PC0", "PC1"} and "mean_temp" not in out.columns


def test_variants(spark, raw):
    spec = replace(DATA, break_date="2020-03-01", drop_from="2020-05-01", drop_columns=("mean_temp",))
    got = {r.variant: r["count"] for r in prepare.variants(raw, spec).groupBy("variant").count().collect()}
    assert got == {"shop": 84, "shop_before_break": 23}


def test_model_rows(spark, raw):
    out = with_position(raw, DAILY)
    rows = prepare.model_rows(out, DAILY, ["Sold", "mean_temp"])
    assert rows.count() == 92 and len(rows.first().x) == 2
    assert by_series(rows, "x")["shop"]["x"][0][0] == out.where("t = 0").first().Sold
