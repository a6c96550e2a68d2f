"""One query per operator, over series built from the whole tables."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.config import explode_config
from tidemark.functions.rand import order_key
from tidemark.operators import augment, baselines, calendar, columns, detect, features, impute, metrics, resample
from tidemark.operators import scale as scales
from tidemark.operators import splits, transforms
from tidemark.operators.blocks import (
    dense_calendar,
    expanding_moments,
    full_frame,
    last_rows_join,
    windowed,
    with_position,
)
from tidemark.operators.quantiles import exact_quantile
from tidemark.operators.response import respond
from tidemark.plans import inducing, models, online, prepare, scenario, search
from tidemark.session import cut_lineage, new_table_path
from tidemark.sources import csv_series
from tidemark.sources.tables import (
    DAILY,
    HOURLY,
    MONTHLY,
    events_hourly,
    orders_daily,
    revenue_monthly,
    shipments_daily,
    supplier_monthly,
    table,
)
from tidemark.spec import DatasetSpec, FeatureSpec, GPSpec, OnlineSpec
from tidemark.streaming import online as streaming

KEY = ["series_id"]
TRAIN_SHARE = 0.8
ONLINE_SHARE = 0.6
SEASONAL_GP = GPSpec(kernel=(("constant", "periodic"), ("white",)), period=12, alpha=1e-3)
SETTING = OnlineSpec(cf_thr_perc=70)


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison. Halves go up with a little room, so that values which
    differ in their last bits only do not part at a half."""
    unit = 10.0**digits
    return F.floor((F.col(c) if isinstance(c, str) else c) * unit + 0.5003) / unit


def rounded(df: DataFrame, digits: int = 6, keep=()) -> DataFrame:
    return df.select(
        [r(c, digits).alias(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes]
    )


def _stats(df: DataFrame, prefix: str = "stat_") -> DataFrame:
    return rounded(df.select("series_id", "t", *[c for c in df.columns if c.startswith(prefix)]))


# --- window features -------------------------------------------------------------------------------------------


def q_densify(spark, sf):
    return rounded(supplier_monthly(spark, sf).select("series_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "t", "y"))


def q_lags(spark, sf):
    df = supplier_monthly(spark, sf)
    return _stats(windowed(df, MONTHLY, 3, lambda w: features.lag_columns(w, ("y",), (1, 2, 3))))


def q_seasonal_lags(spark, sf):
    df = supplier_monthly(spark, sf)
    return _stats(windowed(df, MONTHLY, 14, lambda w: features.seasonal_lag_columns(w, ("y",), (1, 2, 3), 12)))


def q_seasonal_diff(spark, sf):
    return rounded(features.seasonal_difference(supplier_monthly(spark, sf), MONTHLY).select("series_id", "t", "dy"))


def q_rolling(spark, sf):
    df = supplier_monthly(spark, sf)
    return _stats(windowed(df, MONTHLY, 12, lambda w: features.rolling_columns(w, ("y",), 12)))


def q_rolling_seasonal(spark, sf):
    df = supplier_monthly(spark, sf)
    return _stats(windowed(df, MONTHLY, 19, lambda w: features.rolling_seasonal_columns(w, ("y",), 6, 12)))


def q_rolling_weekday(spark, sf):
    return _stats(features.add_weekday_statistics(shipments_daily(spark, sf), DAILY, ("y",), 4))


def q_position(spark, sf):
    """Row positions of a table with gaps: every order of a customer in time order."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("series_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey",
    )
    per_day = orders.groupBy("series_id", "ts").agg(F.min("o_orderkey").alias("first_order"), F.count(F.lit(1)).alias("n"))
    return with_position(per_day, DAILY).select("series_id", "t", "first_order", "n")


def q_standardize_expanding(spark, sf):
    """Statistics a growing (and a moving) train part has when each row arrives."""
    df = expanding_moments(supplier_monthly(spark, sf), MONTHLY)

    def moving(w):
        frame = w.rowsBetween(-24, -1)
        return {"mean_moving": full_frame(F.col("y"), F.avg, w, 24), "std_moving": F.when(F.count("y").over(frame) == 24, F.stddev_samp("y").over(frame))}

    out = windowed(df, MONTHLY, 24, moving)
    return rounded(out.select("series_id", "t", "n_seen", "mean_seen", "std_samp_seen", "std_pop_seen", "mean_moving", "std_moving"), 5)


# --- calendar ---------------------------------------------------------------------------------------------------


def q_date_parts(spark, sf):
    df = calendar.add_date_parts(events_hourly(spark, sf), HOURLY)
    return df.select("series_id", "t", *[F.col(c).cast("int").alias(c) for c in df.columns if c.startswith("cal_")])


def q_valentine_mothersday(spark, sf):
    return calendar.mark_special_days(orders_daily(spark, sf), DAILY).select("series_id", "t", "public_holiday")


def _counters(spark, sf, lags, special):
    marked = calendar.mark_special_days(orders_daily(spark, sf), DAILY)
    df = calendar.add_holiday_counters(marked, DAILY, lags, special)
    return df.select("series_id", "t", *[F.col(c).cast("int").alias(c) for c in df.columns if c.endswith("_Counter")])


def q_holiday_counters(spark, sf):
    return _counters(spark, sf, tuple(range(-7, 4)), ())


def q_special_day_counters(spark, sf):
    return _counters(spark, sf, tuple(range(-7, 4)), ("Valentine", "MothersDay"))


def q_holiday_counters_sparse(spark, sf):
    return _counters(spark, sf, (-14, -7, 0, 7), ())


# --- preparation ------------------------------------------------------------------------------------------------


def q_resample_week(spark, sf):
    df = shipments_daily(spark, sf).withColumn("level", F.col("y")).withColumn("month", F.month("ts").cast("double"))
    out = resample.weekly(df.drop("t"), DAILY, sums=("y",))
    return rounded(out.select("series_id", F.date_format("ts", "yyyy-MM-dd").alias("week_end"), "y", "level", "month"))


def q_resample_month(spark, sf):
    out = resample.monthly(shipments_daily(spark, sf).drop("t"), DAILY)
    return rounded(out.select("series_id", F.date_format("ts", "yyyy-MM-dd").alias("month_end"), "y"))


def q_onehot(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return columns.one_hot(df, columns.levels_of(df, ["c_mktsegment"]))


def q_condense(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rounded(columns.condense(df, ["l_discount", "l_tax"], "rates"))


def q_drop_columns(spark, sf):
    df = table(spark, sf, "supplier")
    return columns.drop_columns(df, ["s_acctbal"], containing="name")


def q_drop_dates(spark, sf):
    df = columns.drop_dates(shipments_daily(spark, sf), DAILY, "1996-01-01", "1997-06-30")
    return rounded(df.select("series_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "y"))


def q_set_types(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    return columns.set_types(df, strings=("p_brand",))


def q_dup_columns(spark, sf):
    df = table(spark, sf, "orders").withColumns(
        {"price_copy": F.col("o_totalprice"), "status_copy": F.col("o_orderstatus"), "price_other": F.col("o_totalprice") * 2}
    )
    return columns.duplicate_columns(df, "o_orderkey")


def q_nan_zero(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return df.select("event_id", columns.zero_if_nan(F.col("value")).alias("value"))


def q_missing_check(spark, sf):
    return columns.has_missing(events_hourly(spark, sf), KEY, ["y", "v", "w"])


def q_variants(spark, sf):
    data = DatasetSpec("ship", series=DAILY, break_date="1998-01-01")
    return prepare.variants(shipments_daily(spark, sf), data).groupBy("series_id", "variant").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("y"), 2).alias("total")
    )


def _with_holes(spark, sf):
    return splits.split_percentage(events_hourly(spark, sf), HOURLY, TRAIN_SHARE)


def _imputed(df):
    return rounded(df.select("series_id", "t", "v", "w"))


def q_impute_mean(spark, sf):
    return _imputed(impute.impute_mean(_with_holes(spark, sf), KEY, ["v", "w"]))


def q_impute_median(spark, sf):
    return _imputed(impute.impute_median(_with_holes(spark, sf), KEY, ["v", "w"]))


def q_impute_knn(spark, sf):
    return _imputed(impute.impute_knn(cut_lineage(_with_holes(spark, sf), "holes"), KEY, ["v", "w"]))


def q_impute_iterative(spark, sf):
    return _imputed(impute.impute_iterative(_with_holes(spark, sf), KEY, ["v", "w"]))


def q_imputed_split(spark, sf):
    """Expanding folds, each imputed with the means of its own train rows."""
    df = events_hourly(spark, sf)
    return rounded(prepare.imputed_split(df, HOURLY, ["v", "w"], "mean", None, 240, 120).select("series_id", "fold", "t", "split", "v", "w"))


def q_quantile(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("series_id"), "l_extendedprice")
    return rounded(exact_quantile(df, KEY, "l_extendedprice", 0.9, "p90"), 4)


# --- splits and transforms ---------------------------------------------------------------------------------------


def q_split_pct(spark, sf):
    return splits.split_percentage(supplier_monthly(spark, sf), MONTHLY, TRAIN_SHARE).select("series_id", "t", "split", "n_train")


def q_split_ts(spark, sf):
    return splits.split_expanding(supplier_monthly(spark, sf), MONTHLY, 24, 12).select("series_id", "fold", "t", "split", "n_train")


def q_split_shuffle(spark, sf):
    out = splits.split_shuffled(supplier_monthly(spark, sf), MONTHLY)
    return out.groupBy("series_id", "fold", "split").agg(F.count(F.lit(1)).alias("n"))


def q_standardize(spark, sf):
    df = splits.split_percentage(supplier_monthly(spark, sf), MONTHLY, TRAIN_SHARE)
    return rounded(transforms.standardize(df, KEY, ["y"]).select("series_id", "t", "y"))


def q_log(spark, sf):
    return rounded(transforms.log_transform(supplier_monthly(spark, sf), KEY).select("series_id", "t", "y", "log_shift"))


def q_power(spark, sf):
    """Most likely lambda on the first grid."""
    df = splits.split_percentage(revenue_monthly(spark, sf).withColumn("y", F.col("y") / 1e6), MONTHLY, TRAIN_SHARE)
    return rounded(transforms.power_fit(df, KEY, low=-2.0, high=2.0, points=17, rounds=1))


def q_power_refined(spark, sf):
    df = splits.split_percentage(supplier_monthly(spark, sf), MONTHLY, TRAIN_SHARE)
    out = transforms.power_transform(df, KEY, transforms.power_fit(df, KEY))
    back = transforms.power_inverse(out.withColumn("back", F.col("y")), ["back"])
    return rounded(back.select("series_id", "t", "lambda", "y", "back"), 3)


def _two_features(spark, sf):
    df = windowed(supplier_monthly(spark, sf), MONTHLY, 1, lambda w: {"before": F.lag("y", 1).over(w)})
    return splits.split_percentage(df.dropna().withColumn("t", F.col("t") - 1), MONTHLY, TRAIN_SHARE)


def q_pca_variance(spark, sf):
    fitted = transforms.pca_fit(_two_features(spark, sf), KEY, ["y", "before"])
    return rounded(fitted.select("series_id", F.size("explained").alias("n_components"), F.col("explained")[0].alias("share")))


def q_pca_scores(spark, sf):
    df = _two_features(spark, sf)
    fitted = transforms.pca_fit(df, KEY, ["y", "before"])
    return rounded(transforms.pca_transform(df, KEY, fitted, ["y", "before"]).select("series_id", "t", "PC0", "PC1"))


def q_ramp(spark, sf):
    df = online.with_n_train(revenue_monthly(spark, sf), MONTHLY, ONLINE_SHARE)
    cells = explode_config(df, scenario.scenarios(12), scenario.SCENARIO_SCHEMA)
    return rounded(scenario.inject(cells).select("series_id", "scenario_id", "t", "status", "y"), 4)


# --- baselines and metrics ----------------------------------------------------------------------------------------


def _split_suppliers(spark, sf):
    return splits.split_percentage(supplier_monthly(spark, sf), MONTHLY, TRAIN_SHARE)


def q_rw(spark, sf):
    df = baselines.random_walk(_split_suppliers(spark, sf), MONTHLY, 1, one_step=True, name="one_step", dummy=True)
    return rounded(baselines.random_walk(df, MONTHLY, 1, name="many_steps").select("series_id", "t", "one_step", "many_steps"))


def q_seasonal_rw(spark, sf):
    df = baselines.random_walk(_split_suppliers(spark, sf), MONTHLY, 12, one_step=True, name="one_step", dummy=True)
    return rounded(baselines.random_walk(df, MONTHLY, 12, name="many_steps").select("series_id", "t", "one_step", "many_steps"))


def q_hist_avg(spark, sf):
    df = baselines.historical_average(_split_suppliers(spark, sf), MONTHLY, one_step=True, name="one_step")
    return rounded(baselines.historical_average(df, MONTHLY, name="many_steps").select("series_id", "t", "one_step", "many_steps"))


def q_drop_dummy(spark, sf):
    df = baselines.random_walk(_split_suppliers(spark, sf), MONTHLY, 12, one_step=True, dummy=True)
    return rounded(columns.drop_dummy(df).select("series_id", "t", "prediction"))


def q_rmse_baselines(spark, sf):
    df = baselines.all_baselines(_split_suppliers(spark, sf), MONTHLY).where(F.col("split") == "test")
    return rounded(metrics.rmse(df, ["series_id", "model"]))


def _runs(spark, sf):
    """A table of run results: suppliers as settings, line numbers as scenarios, flags as seasons."""
    raw = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("param_id"), (F.col("l_linenumber") - 1).alias("scenario_id"),
        F.when(F.col("l_returnflag") == "A", 20).when(F.col("l_returnflag") == "N", 50).otherwise(100).alias("season"),
    )
    runs = raw.agg(F.sum("l_quantity").alias("rmse"), F.count(F.lit(1)).alias("n_cps"), F.max("l_orderkey").alias("n_refits"))
    return runs.withColumn("rmse_base", F.col("n_cps") * 20.0)


def q_run_summary(spark, sf):
    runs = _runs(spark, sf).withColumn("rmse_ratio", F.col("rmse") / F.col("rmse_base"))
    return rounded(metrics.run_summary(runs), 5)


def q_pivot_scenarios_by_season(spark, sf):
    """Every run: the season stays a key."""
    runs = _runs(spark, sf).withColumn("rmse_ratio", F.col("rmse") / F.col("rmse_base"))
    return rounded(metrics.pivot_scenarios(runs, range(7), ["param_id", "season"]))


def q_rmse_ratio(spark, sf):
    runs = _runs(spark, sf)
    base = runs.groupBy("scenario_id", "season").agg(F.avg("rmse").alias("rmse_base"))
    return rounded(metrics.rmse_ratio(runs.drop("rmse_base"), base, ["scenario_id", "season"]).select("param_id", "scenario_id", "season", "rmse_ratio"))


def q_fold_summary_by_season(spark, sf):
    """Every run: the season stays a key."""
    runs = _runs(spark, sf).withColumnRenamed("scenario_id", "fold")
    out = metrics.fold_summary(runs, ["param_id", "season"], prefix="")
    return rounded(out.withColumn("folds", F.array_join(F.transform("rmse", lambda v: v.cast("long").cast("string")), ",")).drop("rmse"))


def q_best_setting(spark, sf):
    """Best usable result row per season: lowest mean error, deviation known and not 0."""
    runs = _runs(spark, sf).groupBy("season", F.col("param_id").alias("config_id")).agg(
        F.avg("rmse").alias("shuf_cv_rmse_mean"), F.stddev_pop("rmse").alias("shuf_cv_rmse_std")
    )
    return rounded(search.best_config(runs, ["season"]))


def q_running_best(spark, sf):
    runs = _runs(spark, sf).groupBy("season", F.col("param_id").alias("config_id")).agg(F.avg("rmse").alias("rmse_test"))
    return rounded(search.running_best(runs, ["season"]))


def q_shuffle_order(spark, sf):
    """Seeded shuffle as a sort key: every row once, in an order free of time."""
    df = supplier_monthly(spark, sf)
    return df.select("series_id", "t", order_key(0, F.col("series_id"), F.col("t")).alias("shuffle_key"))


def q_tail(spark, sf):
    df = _split_suppliers(spark, sf)
    return df.where((F.col("t") < F.col("n_train")) & (F.col("t") >= F.col("n_train") - 12)).select("series_id", "t", "y")


# --- scale, detectors, triggers, augmentation ----------------------------------------------------------------------


def q_output_scale(spark, sf):
    df = scales.output_scale(supplier_monthly(spark, sf), MONTHLY, 2)
    return rounded(df.select("series_id", "t", "mean_now", "mean_prev1", "mean_prev2", "scale"))


def _online_suppliers(spark, sf):
    return online.with_n_train(supplier_monthly(spark, sf), MONTHLY, ONLINE_SHARE)


def q_cf_scores(spark, sf):
    df = detect.change_finder_scores(supplier_monthly(spark, sf), MONTHLY, SETTING)
    return rounded(df.select("series_id", "t", "score"), 5)


def q_cf_change_points(spark, sf):
    slim = _online_suppliers(spark, sf).select("series_id", "t", "y", "n_train")
    scored = cut_lineage(detect.change_finder_scores(slim, MONTHLY, SETTING), "scores")
    flagged = detect.change_points_by_score(scored, MONTHLY, 70)
    return rounded(flagged.where("change_point").select("series_id", "t", (F.col("t") - F.col("n_train")).alias("offset"), "score", "threshold"), 5)


def q_bocd_change_points(spark, sf):
    df = online.with_n_train(events_hourly(spark, sf).select("series_id", "t", "y"), HOURLY, ONLINE_SHARE)
    return detect.run_length_change_points(df, HOURLY, OnlineSpec(cpd="bocd")).select("series_id", "t", "run_length", "change_point")


def _flagged(spark, sf):
    """Test rows with a change point wherever the target moved by over 30 %."""
    df = scales.output_scale(_online_suppliers(spark, sf), MONTHLY, 2)
    jump = F.abs(F.col("y") / F.nullif(F.col("before"), F.lit(0.0)) - 1) > 0.3
    df = windowed(df, MONTHLY, 1, lambda w: {"before": F.lag("y", 1).over(w)})
    flagged = df.withColumn("change_point", F.coalesce(jump, F.lit(False))).where(F.col("t") >= F.col("n_train"))
    return cut_lineage(flagged.select("series_id", "t", "n_train", "y", "change_point", "scale"), "flagged")


def q_triggers(spark, sf):
    out = respond(_flagged(spark, sf), MONTHLY, 0.1)
    return rounded(out.select("series_id", "t", "triggered", "refit_t", "scale_old"))


def q_model_in_force(spark, sf):
    """The same as an as-of lookup: the last trigger strictly before each row."""
    out = respond(_flagged(spark, sf), MONTHLY, 0.1)
    w = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    looked_up = F.coalesce(F.last(F.when(F.col("triggered"), F.col("t")), ignorenulls=True).over(w), F.lit(-1).cast("long"))
    return out.groupBy("series_id").agg(F.max("refit_t").alias("last_refit"), F.count_if("triggered").alias("n")).join(
        out.select("series_id", "t", (looked_up == F.col("refit_t")).alias("same")).groupBy("series_id").agg(F.min("same").alias("same")),
        "series_id",
    )


def _triggers(spark, sf):
    out = respond(_flagged(spark, sf), MONTHLY, 0.1)
    return out.where("triggered").select("series_id", F.col("t").alias("refit_t"), "scale")


def q_training_windows(spark, sf):
    rows = supplier_monthly(spark, sf).select("series_id", "t", "y")
    joined = last_rows_join(rows, _triggers(spark, sf), MONTHLY, "refit_t", 24)
    return rounded(joined.groupBy("series_id", "refit_t").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.min("t").alias("first_t")))


def _histories(spark, sf, length: int = 24):
    rows = supplier_monthly(spark, sf).withColumn("x", F.array(F.col("t").cast("double")))
    return augment.history(rows, _triggers(spark, sf), MONTHLY, "refit_t", length)


def q_augment_scaled(spark, sf):
    out = _histories(spark, sf).withColumn("row", F.explode(augment.scaled(F.col("rows"), F.col("scale"))))
    return rounded(out.select("series_id", "refit_t", "row.t", "row.y"))


def q_augment_append(spark, sf):
    both = F.concat(
        F.transform("rows", lambda p: F.struct(p["t"].alias("t"), p["y"].alias("y"), F.lit(False).alias("scaled"))),
        F.transform(augment.scaled(F.col("rows"), F.col("scale")), lambda p: F.struct(p["t"].alias("t"), p["y"].alias("y"), F.lit(True).alias("scaled"))),
    )
    out = _histories(spark, sf).withColumn("row", F.explode(both))
    return rounded(out.select("series_id", "refit_t", "row.t", "row.y", "row.scaled"))


def _rebalanced(spark, sf, setting):
    out = augment.augmented(_histories(spark, sf, 120), MONTHLY, setting)
    return rounded(out.select("series_id", "refit_t", F.size("ys").alias("n"), F.array_max("ys").alias("largest"),
                              F.aggregate("ys", F.lit(0.0), lambda a, b: a + b).alias("total")))


def q_augment_smogn(spark, sf):
    return _rebalanced(spark, sf, OnlineSpec(da="smogn", append="before", rel_thr=0.3))


def q_augment_gn(spark, sf):
    return _rebalanced(spark, sf, OnlineSpec(da="gn", o_perc=2.0, u_perc=0.5))


# --- search, models, online ------------------------------------------------------------------------------------------


def q_kernel_grid(spark, sf):
    series = revenue_monthly(spark, sf).select("series_id").distinct()
    entries = [{"kernel_id": i, "kernel": models.kernel_text(k)} for i, k in enumerate(search.kernel_grid())]
    return explode_config(series, entries, "kernel_id int, kernel string").drop("kernel_id")


def q_param_sample(spark, sf):
    return search.assign_configs(revenue_monthly(spark, sf), KEY, search.sample_configs(0.1))


def q_param_draws(spark, sf):
    draws = [{"param_id": i, "scale_thr": o.scale_thr, "cf_r": o.cf_r, "cf_smooth": o.cf_smooth, "cf_thr_perc": o.cf_thr_perc}
             for i, o in enumerate(scenario.draw_settings())]
    series = revenue_monthly(spark, sf).select("series_id").distinct()
    return explode_config(series, draws, "param_id int, scale_thr double, cf_r double, cf_smooth int, cf_thr_perc double")


def _phase(df):
    """Position in the year as the only feature, as an angle."""
    return df.withColumn("x", F.array((F.col("t") % 12) / 12 * 6.283185307179586))


def _timed(df):
    return df.withColumn("x", F.array(F.col("t").cast("double")))


def q_gpr_fit_predict(spark, sf):
    series = cut_lineage(online.with_n_train(_timed(supplier_monthly(spark, sf)), MONTHLY, TRAIN_SHARE), "series")
    base = models.fit(online.base_jobs(series, KEY, SEASONAL_GP, None), SEASONAL_GP)
    return rounded(models.predict(series.select("series_id", "t", "x"), base, KEY), 2)


def q_gpr_inducing(spark, sf):
    """Daily shipments by two inducing points with given parameters; every row of a series is in its sums."""
    rows = shipments_daily(spark, sf).withColumn("x", F.array(F.col("t") / 100.0))
    gp = GPSpec(kernel=(("rbf",),), alpha=0.5)
    given = inducing.given_models(rows, DAILY, gp, [math.log(2.0)], [[5.0], [15.0]])
    solved = cut_lineage(inducing.solve(given, inducing.gram_sums(rows, DAILY, given), DAILY), "inducing")
    found = inducing.predict(rows.select("series_id", "t", "x"), solved, KEY)
    return rounded(found.join(solved.select("series_id", "method", "rows_used"), "series_id"), 4)


def q_gpr_insample(spark, sf):
    """Errors in and out of sample of the fitted models."""
    series = cut_lineage(online.with_n_train(_timed(revenue_monthly(spark, sf)), MONTHLY, TRAIN_SHARE), "series")
    base = models.fit(online.base_jobs(series, KEY, SEASONAL_GP, None), SEASONAL_GP)
    predicted = models.predict(series.select("series_id", "t", "x"), base, KEY)
    part = F.when(F.col("t") < F.col("n_train"), "train").otherwise("test").alias("part")
    return rounded(metrics.rmse(predicted.join(series.select("series_id", "t", "y", "n_train"), ["series_id", "t"])
                                .withColumn("part", part), ["series_id", "part"]), 2)


def q_gpr_cross_validation(spark, sf):
    series = _timed(revenue_monthly(spark, sf)).withColumn("n_train", F.lit(0).cast("long"))
    folds = cut_lineage(splits.split_shuffled(series, MONTHLY), "folds")
    ids = ["series_id", "fold"]
    jobs = models.with_settings(models.training_arrays(folds.where("split = 'train'"), ids), SEASONAL_GP)
    test = folds.where("split = 'test'")
    predicted = models.predict(test.select(*ids, "t", "x"), models.fit(jobs, SEASONAL_GP), ids)
    errors = metrics.rmse(predicted.join(test.select(*ids, "t", "y"), [*ids, "t"]), ids)
    return rounded(metrics.fold_summary(errors, KEY).drop("shuf_cv_rmse"), 2)


def _daily_prepared(spark, sf, reduction):
    data = DatasetSpec("orders", series=DAILY, features=FeatureSpec())
    return prepare.prepare(orders_daily(spark, sf), data, "full", "mean", reduction)


def q_prepare(spark, sf):
    """The whole feature pipeline on daily orders."""
    return rounded(_daily_prepared(spark, sf, None).drop("ts"))


def q_prepare_pca(spark, sf):
    return rounded(_daily_prepared(spark, sf, "pca").drop("ts"))


def q_prepare_weekly(spark, sf):
    data = DatasetSpec("shipments", series=replace(DAILY, season=364), features=FeatureSpec(), weekly=True)
    return rounded(prepare.prepare(shipments_daily(spark, sf).drop("t"), data, "full", "mean").drop("ts"))


#: Share of the configuration grid that is searched: 1,958 of 19,584.
SEARCH_SHARE = 0.1


@lru_cache(maxsize=1)
def _searched(spark, sf):
    """Prepared rows and feature names per kind of reduction, and the results of a search over a sample of the grid.

    The results are stored, and one session's queries share them.
    """
    data = DatasetSpec("revenue", series=MONTHLY, features=FeatureSpec(lags=(1, 2, 3)))
    raw = cut_lineage(revenue_monthly(spark, sf).drop("t"), "revenue")
    rows, names = {}, {}
    for kind in search.DIM_REDUCTIONS:
        prepared = prepare.prepare(raw, data, "full", "mean", None if kind == "none" else kind)
        names[kind] = prepare.feature_columns(prepared, MONTHLY)
        if kind == "pca":
            # components a series does not keep are 0 for its model
            prepared = prepared.fillna(0.0, subset=names[kind])
        rows[kind] = prepare.model_rows(prepared, MONTHLY, names[kind])
    results = search.run_search(rows, MONTHLY, search.sample_configs(SEARCH_SHARE), names, period=12)
    return rows, names, cut_lineage(results, "search-results")


def q_gpr_search(spark, sf):
    """Offline search with a sample of the configuration grid, with and without reduced features."""
    return rounded(_searched(spark, sf)[2].drop("theta", "shuf_cv_rmse"), 1)


def q_best_config(spark, sf):
    return rounded(search.best_config(_searched(spark, sf)[2], KEY).drop("theta", "shuf_cv_rmse"), 1)


def q_best_replay(spark, sf):
    """Every online method with each segment's best configuration."""
    rows, names, results = _searched(spark, sf)
    return rounded(search.replay(rows, search.best_config(results, KEY), MONTHLY, SETTING, names, period=12), 2)


def _online_series(spark, sf, source=supplier_monthly):
    return online.with_n_train(_timed(source(spark, sf)), MONTHLY, ONLINE_SHARE)


def q_online_refit(spark, sf):
    """Predictions of the online response and of the base model for every test row of every supplier."""
    run = online.run_online(_online_series(spark, sf), MONTHLY, SETTING, SEASONAL_GP)
    return rounded(run.predictions, 2)


def q_online_failures(spark, sf):
    """States where refits fail: on the last four rows, with a feature that is missing in every eleventh month."""
    x = F.when(F.col("t") % 11 == 5, F.lit(float("nan"))).otherwise(F.col("t").cast("double"))
    rows = cut_lineage(supplier_monthly(spark, sf).select("series_id", "t", "y", F.array(x).alias("x")), "series")
    gp = GPSpec(kernel=(("rbf",),))

    def refit(triggers):
        window = last_rows_join(rows, triggers.select("series_id", "refit_t"), MONTHLY, "refit_t", 4)
        jobs = models.training_arrays(window, ["series_id", "refit_t"]).withColumn("model", F.lit(online.ONLINE))
        return models.fit(models.with_settings(jobs, gp), gp)

    state, fitted = online.settled(_flagged(spark, sf), MONTHLY, OnlineSpec(), refit)
    failed = fitted.select("series_id", F.col("refit_t").alias("t"), (F.col("status") != "ok").alias("failed"))
    joined = state.join(failed, ["series_id", "t"], "left")
    return rounded(joined.select("series_id", "t", "triggered", "refit_t", "scale_old", F.coalesce("failed", F.lit(False)).alias("failed")))


def q_online_bocd(spark, sf):
    run = online.run_online(_online_series(spark, sf, revenue_monthly), MONTHLY, OnlineSpec(cpd="bocd"), SEASONAL_GP)
    return rounded(run.states.select("series_id", "t", "change_point", "triggered", "refit_t", "scale_old", "reason"))


def q_rivals(spark, sf):
    """Error of every method on every segment."""
    series = cut_lineage(_online_series(spark, sf, revenue_monthly), "series")
    predictions = online.all_methods(series, MONTHLY, SETTING, SEASONAL_GP)
    return rounded(online.compare_methods(predictions, series, MONTHLY), 2)


def q_run_statistics(spark, sf):
    series = cut_lineage(_online_series(spark, sf, revenue_monthly), "series")
    run = online.run_online(series, MONTHLY, OnlineSpec(da="smogn", append="before", cf_thr_perc=70), SEASONAL_GP)
    return rounded(online.run_statistics(run, series, MONTHLY), 2)


def q_scenarios(spark, sf):
    """Named ramps times drawn settings on every segment."""
    series = cut_lineage(_phase(online.with_n_train(revenue_monthly(spark, sf), MONTHLY, ONLINE_SHARE)), "series")
    gp = GPSpec(alpha=0.1)
    return rounded(scenario.scenario_suite(series, MONTHLY, scenario.draw_settings(5), gp).drop("start_off", "end_off"), 3)


def q_heatmap(spark, sf):
    """Slope against largest factor on every segment."""
    series = cut_lineage(_phase(online.with_n_train(revenue_monthly(spark, sf), MONTHLY, ONLINE_SHARE)), "series")
    cells = scenario.shape_cells(series, MONTHLY, (0.5, 5.0, 0.5))
    return rounded(scenario.heat_map(series, cells, MONTHLY, SETTING, GPSpec(alpha=0.1)), 3)


def q_heatmap_positions(spark, sf):
    """Start against end of the ramp on every segment."""
    series = cut_lineage(_phase(online.with_n_train(revenue_monthly(spark, sf), MONTHLY, ONLINE_SHARE)), "series")
    cells = scenario.position_cells(series, MONTHLY, 0.2, 2.0)
    return rounded(scenario.heat_map(series, cells, MONTHLY, SETTING, GPSpec(alpha=0.1)), 3)


def q_online_stream(spark, sf):
    """The online response as a stream over supplier rows."""
    source, out, marks = (new_table_path(spark, n) for n in ("stream-in", "stream-out", "stream-marks"))
    series = _timed(supplier_monthly(spark, sf))
    series.write.parquet(source)
    rows = spark.readStream.schema(series.schema).parquet(source)
    streaming.run_available(streaming.online_stream(rows, MONTHLY, SETTING, SEASONAL_GP, n_train=48), out, marks)
    return rounded(spark.read.parquet(out), 2)


# --- files ------------------------------------------------------------------------------------------------------------


def q_csv_roundtrip(spark, sf):
    """Write daily shipments as European CSV and read them back."""
    path = new_table_path(spark, "csv")
    df = shipments_daily(spark, sf)
    csv_series.write_series(df.select(F.date_format("ts", "dd.MM.yyyy").alias("Date"), "series_id", "y", (F.col("y") / 8).alias("eighth")), path)
    back = csv_series.read_series(spark, path, index="Date", key="series_id")
    return rounded(back.select("series_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "y", "eighth"))


def q_results_roundtrip(spark, sf):
    """Write run results by season and read one table back."""
    path = new_table_path(spark, "results")
    csv_series.write_results(_runs(spark, sf), path, ["season"])
    return rounded(spark.read.parquet(path).select("param_id", "scenario_id", "season", "rmse", "rmse_base", "n_cps", "n_refits"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return q_online_refit(spark, sf)


QUERIES = {name: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}
