"""Offline configuration search: every configuration of every series is one independent fit."""

from __future__ import annotations

import random
from dataclasses import replace
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.config import explode_config
from tidemark.operators.metrics import fold_summary
from tidemark.operators.splits import TEST, TRAIN, split_shuffled
from tidemark.plans import models, online
from tidemark.session import cut_lineage
from tidemark.spec import GPSpec, OnlineSpec, SeriesSpec

# Base kernels and parameter values of the search.
BASE_KERNELS = ("constant", "matern", "periodic", "rbf", "rational_quadratic", "white")
DIM_REDUCTIONS = ("none", "pca")
ALPHAS = (1e-5, 1e-3, 1e-1, 1.0, 1e1, 1e3)
RESTARTS = (0, 5, 10)
SWITCH = (False, True)

CONFIG_SCHEMA = (
    "config_id int, dim_reduction string, kernel string, alpha double, n_restarts int,"
    " standardize boolean, normalize_y boolean"
)
FULL_FIT = -1


def kernel_grid() -> list[tuple[tuple[str, ...], ...]]:
    """Single kernels, sums and products of two, and five forms of three, as sums of products."""
    grid = [((a,),) for a in BASE_KERNELS]
    for a, b in combinations(BASE_KERNELS, 2):
        grid += [((a,), (b,)), ((a, b),)]
    for a, b, c in combinations(BASE_KERNELS, 3):
        grid += [((a,), (b,), (c,)), ((a, b, c),), ((a, b), (c,)), ((a,), (b, c)), ((a, c), (b,))]
    return grid


def grid_axes() -> list[tuple[str, tuple]]:
    kernels = tuple(models.kernel_text(k) for k in kernel_grid())
    return [
        ("dim_reduction", DIM_REDUCTIONS), ("kernel", kernels), ("alpha", ALPHAS),
        ("n_restarts", RESTARTS), ("standardize", SWITCH), ("normalize_y", SWITCH),
    ]


def grid_size() -> int:
    size = 1
    for _, values in grid_axes():
        size *= len(values)
    return size


def config(config_id: int) -> dict:
    """The configuration with this number; the last axis varies fastest."""
    entry, rest = {}, config_id
    for name, values in reversed(grid_axes()):
        rest, at = divmod(rest, len(values))
        entry[name] = values[at]
    return {"config_id": config_id, **entry}


def sample_configs(share: float, seed: int = 42) -> list[dict]:
    """A share of the grid without replacement, ordered so that equal preparations are adjacent."""
    picked = random.Random(seed).sample(range(grid_size()), int(share * grid_size()))
    return [config(i) for i in sorted(picked)]


def assign_configs(series: DataFrame, keys, configs: list[dict]) -> DataFrame:
    """One row per series and configuration."""
    return explode_config(series.select(*keys).distinct(), configs, CONFIG_SCHEMA)


def run_search(
    prepared: dict[str, DataFrame], spec: SeriesSpec, configs: list[dict], features: dict[str, list[str]],
    period: int | None = None, cap: int | None = None,
) -> DataFrame:
    """Cross-validate, fit and test every configuration on every series.

    ``prepared`` has model rows (``t, x, y, fold, split, n_train``) per kind of dimension reduction. Training
    sets are built once per series, fold and kind, and then meet their configurations by kernel. Returns one row per series
    and configuration with test error, cross-validation errors and status.
    """
    keys = list(spec.keys)
    results = None
    for kind, rows in prepared.items():
        mine = [c for c in configs if c["dim_reduction"] == kind]
        if not mine:
            continue
        rows = cut_lineage(rows, "prepared")
        # cv is FULL_FIT for the fit on all train rows, else the number of the random split
        ids = [*keys, "fold", "cv"]
        by_fold = spec.with_keys("fold")
        recent = F.lit(True) if cap is None else F.col("t") >= F.col("n_train") - cap
        train = rows.where(F.col("split") == TRAIN).where(recent)
        inner = split_shuffled(
            train.drop("split").withColumnRenamed("fold", "_fold"), _renamed(by_fold)
        ).withColumnRenamed("fold", "cv").withColumnRenamed("_fold", "fold")
        whole = rows.where((F.col("split") == TEST) | recent).withColumn("cv", F.lit(FULL_FIT))
        sets = cut_lineage(whole.select(*ids, "t", "x", spec.target, "split").unionByName(
            inner.select(*ids, "t", "x", spec.target, "split")), "sets")
        arrays = cut_lineage(models.training_arrays(sets.where(F.col("split") == TRAIN), ids, spec.target), "training-sets")
        fitted = cut_lineage(models.fit_grid(arrays, ids, mine, GPSpec(period=period), features[kind], together="cv"), "search-fits")
        points = sets.where(F.col("split") == TEST).select(*ids, "t", "x", F.col(spec.target).alias("y"))
        errors = models.score_grid(points, fitted, arrays, ids)
        one_kind = fitted.join(errors, [*ids, "config_id"], "left").withColumns(
            {"dim_reduction": F.lit(kind), "n_features": F.lit(len(features[kind]))}
        )
        results = one_kind if results is None else results.unionByName(one_kind)
    results = cut_lineage(results, "search")
    settings = ["config_id", "dim_reduction", "kernel", "alpha", "n_restarts", "standardize", "normalize_y"]
    # a configuration's test error is the mean over the outer folds, as are its cross-validation errors
    test = results.where(F.col("cv") == FULL_FIT).groupBy(*keys, *settings).agg(
        F.when(F.count("rmse") == F.count(F.lit(1)), F.avg("rmse")).alias("rmse_test"),
        F.max_by("theta", "fold").alias("theta"),
        F.when(F.count_if(F.col("status") != "ok") > 0, "failed").otherwise("ok").alias("status"),
        F.max("error").alias("error"),
    )
    inner_errors = results.where(F.col("cv") != FULL_FIT).groupBy(*keys, "config_id", F.col("cv").alias("fold")).agg(
        F.avg("rmse").alias("rmse")
    )
    return test.join(fold_summary(inner_errors, [*keys, "config_id"]), [*keys, "config_id"], "left")


def _renamed(spec: SeriesSpec) -> SeriesSpec:
    return replace(spec, keys=tuple("_fold" if k == "fold" else k for k in spec.keys))


def clean_results(results: DataFrame) -> DataFrame:
    """Results usable for a choice: all cross-validation columns present and a deviation other than 0."""
    cv = [c for c in results.columns if "cv" in c]
    usable = results.dropna(subset=cv)
    return usable.where(~F.isnan("shuf_cv_rmse_std") & (F.col("shuf_cv_rmse_std") != 0))


def best_config(results: DataFrame, keys, by: str = "shuf_cv_rmse_mean") -> DataFrame:
    """The configuration with the least error per series; ties go to the lower number."""
    rest = [c for c in results.columns if c not in keys]
    order = F.struct(F.col(by), F.col("config_id"))
    best = clean_results(results).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def replay(
    prepared: dict[str, DataFrame], best: DataFrame, spec: SeriesSpec, setting: OnlineSpec, features: dict[str, list[str]],
    period: int | None = None,
) -> DataFrame:
    """Run every online method with each series' best configuration; one error column per method."""
    keys = list(spec.keys)
    best = cut_lineage(best.select(*keys, "dim_reduction", *models.SETTINGS), "best")
    out = None
    for kind, rows in prepared.items():
        chosen = best.where(F.col("dim_reduction") == kind).drop("dim_reduction")
        if chosen.isEmpty():
            continue
        mine = cut_lineage(
            rows.join(chosen.select(*keys), keys, "left_semi").select(*keys, "t", spec.target, "x", "n_train"), "replay"
        )
        predictions = online.all_methods(mine, spec, setting, GPSpec(period=period), features[kind], chosen)
        errors = online.compare_methods(predictions, mine, spec).withColumn("dim_reduction", F.lit(kind))
        out = errors if out is None else out.unionByName(errors)
    return out


def running_best(results: DataFrame, keys, value: str = "rmse_test", order: str = "config_id", block: int = 10_000) -> DataFrame:
    """Best error up to each run and whether the run improved it.

    Runs are cut into blocks of their numbers: the best of all blocks before comes from one row per block, so that a key with
    very many runs is not one window.
    """
    keys = list(keys)
    rows = results.withColumn("_block", F.floor(F.col(order) / block))
    lowest = rows.groupBy(*keys, "_block").agg(F.min(value).alias("_lowest"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lowest.select(*keys, "_block", F.min("_lowest").over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    earlier = F.least(F.min(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    return rows.join(carried, [*keys, "_block"]).withColumn("_earlier", earlier).withColumns({
        "best_so_far": F.least(value, "_earlier"),
        "improved": F.coalesce(F.col(value) < F.col("_earlier"), F.col(value).isNotNull()),
    }).drop("_block", "_carried", "_earlier")


def stored_settings(text: Column) -> Column:
    """Typed settings from a stored JSON result row."""
    return F.from_json(text, CONFIG_SCHEMA)
