"""The online response over a whole table of series, as one batch plan.

Scores, scales and triggers depend on the target only, and every refit starts from
the base model. So instead of walking through time, the plan finds all triggers
first, fits all refits of all series side by side, and then predicts every test
row with the model that was in force when it arrived.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.augment import as_arrays, augmented, history, last_of
from tidemark.operators.blocks import last_rows_join, windowed
from tidemark.operators.detect import change_finder_scores, change_points_by_score, run_length_change_points
from tidemark.operators.metrics import align, rmse
from tidemark.operators.response import BASE_MODEL, respond
from tidemark.operators.scale import output_scale
from tidemark.operators.splits import split_percentage
from tidemark.plans import models
from tidemark.session import cut_lineage
from tidemark.spec import GPSpec, OnlineSpec, SeriesSpec

ONLINE, BASE = "online", "base"
RETRAIN, MOVING, SCALED = "cpd_retrain", "cpd_moving_window", "cpd_scaled"
METHODS = (ONLINE, BASE, RETRAIN, MOVING, SCALED, "refit_every_1", "refit_every_2", "moving_window")
BIAS_WEIGHT = 0.8
# 0.6 ** 90 is below double precision: older errors no longer count
BIAS_ROWS = 90


@dataclass
class OnlineRun:
    """Tables of one run."""

    states: DataFrame  # per test row: change point, scale, trigger, model in force
    triggers: DataFrame
    models: DataFrame  # refits with their status
    predictions: DataFrame  # long: model, prediction, lower_conf, upper_conf


def with_n_train(series: DataFrame, spec: SeriesSpec, share: float) -> DataFrame:
    """Series of ``t, y, x`` with the number of train rows of each key."""
    return split_percentage(series, spec, share).drop("fold", "split")


def flagged_rows(series: DataFrame, spec: SeriesSpec, online) -> DataFrame:
    """Change points and scale of every test row; neither depends on what was refitted before.

    ``online`` is one setting, or a list that rows refer to by their key ``param_id``.
    """
    several = isinstance(online, (list, tuple))
    variants = [o.resolved(spec.season) for o in (online if several else [online])]
    slim = series.select(*spec.keys, "t", F.col(spec.target), "n_train")
    if variants[0].cpd == "cf":
        scored = cut_lineage(change_finder_scores(slim, spec, online, with_scale=True), "scores")
        flagged = change_points_by_score(scored, spec, _each(variants, "cf_thr_perc", several))
    elif several:
        raise ValueError("lists of settings need the change score detector")
    else:
        o = variants[0]
        scale = output_scale(slim, spec, o.scale_window, o.scale_seasons).select(*spec.keys, "t", "scale")
        flagged = cut_lineage(run_length_change_points(slim, spec, o).join(scale, [*spec.keys, "t"]), "flagged")
    return flagged.where(F.col("t") >= F.col("n_train")).select(
        *spec.keys, "t", F.col(spec.target), "n_train", "change_point", "scale"
    )


def states(flagged: DataFrame, spec: SeriesSpec, online, failed: DataFrame | None = None) -> DataFrame:
    """Change points, triggers and the model in force for every test row, given the refits known to fail."""
    several = isinstance(online, (list, tuple))
    variants = [o.resolved(spec.season) for o in (online if several else [online])]
    return respond(flagged, spec, _each(variants, "scale_thr", several), failed).withColumn("offset", F.col("t") - F.col("n_train"))


def _triggers(state: DataFrame, spec: SeriesSpec) -> DataFrame:
    return state.where("triggered").select(*spec.keys, F.col("t").alias("refit_t"), "scale", "scale_old", "offset")


def settled(flagged: DataFrame, spec: SeriesSpec, online, refit) -> tuple[DataFrame, DataFrame]:
    """States and refits that agree: the scale and the model in force move only where a refit succeeded.

    Whether a refit fails depends on its row alone, so failures only add up. Only series with a new failure are run again,
    and of their triggers only those not fitted yet are; ``refit`` turns triggers into fitted models.
    """
    keys = list(spec.keys)
    state = cut_lineage(states(flagged, spec, online), "states")
    fitted = cut_lineage(refit(_triggers(state, spec)), "refits")
    failed = None
    while True:
        bad = fitted.where((F.col("model") == ONLINE) & (F.col("status") != "ok")).select(*keys, F.col("refit_t").alias("t")).distinct()
        new = bad if failed is None else bad.join(failed, [*keys, "t"], "left_anti")
        if new.isEmpty():
            asked = state.where("triggered").select(*keys, F.col("t").alias("refit_t"))
            return state, fitted if failed is None else fitted.join(asked, [*keys, "refit_t"], "left_semi")
        touched = cut_lineage(new.select(*keys).distinct(), "touched")
        failed = cut_lineage(bad, "failed-refits")
        again = states(flagged.join(touched, keys, "left_semi"), spec, online, failed)
        state = cut_lineage(state.join(touched, keys, "left_anti").unionByName(again), "states")
        missing = _triggers(state, spec).join(fitted.select(*keys, "refit_t").distinct(), [*keys, "refit_t"], "left_anti")
        fitted = cut_lineage(fitted.unionByName(refit(missing)), "refits")


def _each(variants, name: str, several: bool):
    values = [getattr(v, name) for v in variants]
    return values if several else values[0]


def base_jobs(
    series: DataFrame, keys, gp: GPSpec, cap: int | None, target: str = "y", chosen: DataFrame | None = None
) -> DataFrame:
    """One job per key: its train rows, only the last ``cap`` of them if that is given."""
    train = series.where(F.col("t") < F.col("n_train")).withColumn("t_end", F.col("n_train"))
    return models.with_settings(models.training_arrays(train, keys, target, cap), gp, chosen)


def refit_jobs(series: DataFrame, triggers: DataFrame, spec: SeriesSpec, online, rivals: bool) -> DataFrame:
    """Training sets ``xs, ys`` per trigger and model."""
    first = (online[0] if isinstance(online, (list, tuple)) else online).resolved(spec.season)
    longest = first.max_samples
    if rivals:  # the rival that refits on its whole past needs all rows, unless a cap is given
        longest = None if first.rival_cap is None else max(first.max_samples, first.rival_cap, spec.season)
    ends = triggers.select(*spec.keys, "refit_t", "scale")
    past = history(series, ends, spec, "refit_t", longest)
    jobs = augmented(past, spec, online).withColumn("model", F.lit(ONLINE))
    if rivals:
        kinds = {RETRAIN: F.col("rows") if first.rival_cap is None else last_of(F.col("rows"), first.rival_cap), MOVING: last_of(F.col("rows"), spec.season)}
        options = F.array(*[F.struct(F.lit(m).alias("model"), r.alias("rows")) for m, r in kinds.items()])
        others = (
            past.withColumn("_k", F.explode(options))
            .withColumn("model", F.col("_k.model"))
            .withColumn("rows", F.col("_k.rows"))
            .drop("_k")
        )
        jobs = jobs.unionByName(as_arrays(others))
    return jobs.drop("scale")


def run_online(
    series: DataFrame,
    spec: SeriesSpec,
    online: OnlineSpec | list[OnlineSpec],
    gp: GPSpec,
    features=("x",),
    rivals: bool = False,
    base_cap: int | None = None,
    base_series: DataFrame | None = None,
    base_keys=None,
    chosen: DataFrame | None = None,
) -> OnlineRun:
    """Predict, detect and refit over the test rows of all series.

    ``series`` holds ``t``, the target, the feature array ``x`` and ``n_train``. With ``rivals``, the
    refits on unscaled history and on the last season and the scaled predictions come along. Every test row has a
    prediction per model: a series without a base model (its fit failed, or it has no train rows) has nulls there.
    Runs that share their train rows and features (scenarios, settings) share a base model: it is then
    fitted on ``base_series`` for each of ``base_keys``. ``chosen`` gives every series its own model settings.
    """
    first = (online[0] if isinstance(online, (list, tuple)) else online).resolved(spec.season)
    keys = list(spec.keys)
    series = cut_lineage(series, "series")
    base_series = series if base_series is None else base_series
    base_keys = keys if base_keys is None else list(base_keys)

    base = base_jobs(base_series, base_keys, gp, base_cap, spec.target, chosen)
    base = cut_lineage(models.fit(base, gp, features), "base")
    test = base_series.where(F.col("t") >= F.col("n_train")).select(*base_keys, "t", "x")
    base_predictions = cut_lineage(models.predict(test, base, base_keys), "base-predictions")

    starts = base.where(F.col("status") == "ok").select(*base_keys, F.col("theta").alias("theta0"))

    def refit(triggers: DataFrame) -> DataFrame:
        jobs = refit_jobs(series, triggers.select(*keys, "refit_t", "scale"), spec, online, rivals).join(starts, base_keys)
        return models.fit(models.with_settings(jobs, gp, chosen), gp, features)

    state, fitted = settled(cut_lineage(flagged_rows(series, spec, online), "flagged"), spec, online, refit)
    triggers = _triggers(state, spec)

    kinds = [ONLINE] + ([RETRAIN, MOVING] if rivals else [])
    in_force = _in_force(state, fitted, spec, kinds)
    own = [*keys, "model", "t", "prediction", "lower_conf", "upper_conf"]
    untouched = in_force.where(F.col("refit_t") == BASE_MODEL).join(base_predictions, [*base_keys, "t"]).select(*own)
    points = in_force.where(F.col("refit_t") != BASE_MODEL).join(series.select(*keys, "t", "x"), [*keys, "t"])
    refitted = models.predict(
        points.select(*keys, "model", "refit_t", "t", "x"), fitted, [*keys, "model", "refit_t"]
    ).select(*own)
    base_rows = (
        state.select(*keys, "t").join(base_predictions, [*base_keys, "t"]).withColumn("model", F.lit(BASE)).select(*own)
    )
    predictions = untouched.unionByName(refitted).unionByName(base_rows)
    if rivals:
        predictions = cut_lineage(predictions, "predictions")
        multiplied = ONLINE if first.scale_of == "current" else BASE
        scaled_rival = predictions.where(F.col("model") == multiplied).join(
            state.select(*keys, "t", "scale_old"), [*keys, "t"]
        )
        predictions = predictions.unionByName(
            scaled_rival.withColumns(
                {c: F.col(c) * F.col("scale_old") for c in ("prediction", "lower_conf", "upper_conf")}
            ).withColumn("model", F.lit(SCALED)).select(*own)
        )
    return OnlineRun(state, triggers, fitted, predictions)


def _in_force(state: DataFrame, fitted: DataFrame, spec: SeriesSpec, kinds) -> DataFrame:
    """Model and refit of each test row; after a failed refit the last good one stays."""
    keys = list(spec.keys)
    earlier = Window.partitionBy(*keys, "model").orderBy("refit_t").rowsBetween(Window.unboundedPreceding, 0)
    good = F.when(F.col("status") == "ok", F.col("refit_t"))
    standing = fitted.select(
        *keys, "model", "refit_t",
        F.coalesce(F.last(good, ignorenulls=True).over(earlier), F.lit(BASE_MODEL)).cast("long").alias("_standing"),
    )
    rows = state.select(*keys, "t", "refit_t").withColumn("model", F.explode(F.array(*[F.lit(k) for k in kinds])))
    return (
        rows.join(standing, [*keys, "model", "refit_t"], "left")
        .withColumn("refit_t", F.coalesce("_standing", F.lit(BASE_MODEL).cast("long")))
        .drop("_standing")
    )


def run_statistics(run: OnlineRun, series: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Per series: change points, refits attempted and done, error of each model (one row per model)."""
    keys = list(spec.keys)
    counts = run.states.groupBy(*keys).agg(
        F.count_if("change_point").alias("n_cps"), F.count_if("triggered").alias("n_refits")
    )
    done = run.models.where(F.col("model") == ONLINE).groupBy(*keys).agg(
        F.count_if(F.col("status") == "ok").alias("n_refit_ok")
    )
    actual = series.where(F.col("t") >= F.col("n_train")).select(*keys, "t", F.col(spec.target).alias("y"))
    errors = rmse(run.predictions.join(actual, [*keys, "t"]), [*keys, "model"])
    return (
        errors.join(counts, keys)
        .join(done, keys, "left")
        .withColumn("n_refit_ok", F.coalesce("n_refit_ok", F.lit(0)))
    )


def periodic_refits(
    series: DataFrame, spec: SeriesSpec, gp: GPSpec, every: int, features=("x",), cap: int | None = None,
    chosen: DataFrame | None = None,
) -> DataFrame:
    """Rival: refit after every ``every`` test rows on all rows so far, or the last ``cap``."""
    keys = list(spec.keys)
    test = series.where(F.col("t") >= F.col("n_train"))
    done = F.floor((F.col("t") - F.col("n_train")) / every)
    in_force = F.when(done > 0, F.col("n_train") + done * every - 1).otherwise(BASE_MODEL).cast("long")
    points = test.select(*keys, "t", "x", in_force.alias("refit_t"), "n_train")
    return _refit_often(series, points, spec, gp, features, cap, chosen).withColumn("model", F.lit(f"refit_every_{every}"))


def moving_window_refits(
    series: DataFrame, spec: SeriesSpec, gp: GPSpec, features=("x",), cap: int | None = None,
    chosen: DataFrame | None = None,
) -> DataFrame:
    """Rival: refit on a sliding window after every row, with a running correction of the bias.

    The window has the length of the train part (or the last ``cap`` rows of it). The
    correction is a linear recursion on past errors whose weights shrink by 0.6 per
    row, so it is a fold over a bounded frame.
    """
    keys = list(spec.keys)
    test = series.where(F.col("t") >= F.col("n_train"))
    in_force = F.when(F.col("t") > F.col("n_train"), F.col("t") - 1).otherwise(BASE_MODEL).cast("long")
    points = test.select(*keys, "t", "x", in_force.alias("refit_t"), "n_train")
    raw = _refit_often(series, points, spec, gp, features, cap, chosen, sliding=True)
    joined = raw.join(test.select(*keys, "t", F.col(spec.target).alias("_y")), [*keys, "t"]).withColumn(
        "_e", F.col("_y") - F.col("prediction")
    )
    step = lambda bias, e: BIAS_WEIGHT * e - (2 * BIAS_WEIGHT - 1) * bias
    corrected = windowed(
        joined, spec, BIAS_ROWS,
        lambda w: {"_bias": F.aggregate(F.collect_list("_e").over(w.rowsBetween(-BIAS_ROWS, -1)), F.lit(0.0), step)},
    )
    return corrected.withColumns(
        {c: F.col(c) + F.col("_bias") for c in ("prediction", "lower_conf", "upper_conf")}
    ).drop("_bias", "_e", "_y").withColumn("model", F.lit("moving_window"))


def all_methods(
    series: DataFrame, spec: SeriesSpec, online: OnlineSpec, gp: GPSpec, features=("x",), chosen: DataFrame | None = None
) -> DataFrame:
    """Predictions of the online response and of every rival, in long form."""
    run = run_online(series, spec, online, gp, features, rivals=True, chosen=chosen)
    names = run.predictions.columns
    rivals = [periodic_refits(series, spec, gp, every, features, chosen=chosen) for every in (1, 2)]
    rivals.append(moving_window_refits(series, spec, gp, features, chosen=chosen))
    out = run.predictions
    for rival in rivals:
        out = out.unionByName(rival.select(*names))
    return out


def compare_methods(predictions: DataFrame, series: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One error column per method and one row per series."""
    keys = list(spec.keys)
    actual = series.where(F.col("t") >= F.col("n_train")).select(*keys, "t", F.col(spec.target).alias("y"))
    errors = rmse(align(predictions, actual, keys), [*keys, "model"])
    return errors.groupBy(*keys).agg(
        *[F.max(F.when(F.col("model") == m, F.col("rmse"))).alias(f"rmse_{m}") for m in METHODS]
    )


def _refit_often(series, points, spec: SeriesSpec, gp: GPSpec, features, cap: int | None, chosen, sliding: bool = False) -> DataFrame:
    keys = list(spec.keys)
    # the base model of a key is its fit on the rows before the test part
    end = F.when(F.col("refit_t") == BASE_MODEL, F.col("n_train") - 1).otherwise(F.col("refit_t"))
    ends = points.select(*keys, "refit_t", "n_train", end.alias("_end")).distinct()
    rows = series.select(*keys, "t", "x", F.col(spec.target).alias("y"))
    joined = last_rows_join(rows, ends, spec, "_end", cap)
    if sliding:
        joined = joined.where(F.col("t") > F.col("_end") - F.col("n_train"))
    jobs = models.with_settings(models.training_arrays(joined, [*keys, "refit_t"]), gp, chosen)
    fitted = cut_lineage(models.fit(jobs, gp, features), "often-refitted")
    # after a failed refit the last good one stays in force; the rows of a series without any keep nulls
    earlier = Window.partitionBy(*keys).orderBy("refit_t").rowsBetween(Window.unboundedPreceding, 0)
    good = F.last(F.when(F.col("status") == "ok", F.col("refit_t")), ignorenulls=True).over(earlier)
    standing = fitted.select(*keys, "refit_t", good.alias("_good"))
    placed = points.join(standing, [*keys, "refit_t"], "left").withColumn("refit_t", F.coalesce("_good", "refit_t"))
    return models.predict(placed.select(*keys, "refit_t", "t", "x"), fitted, [*keys, "refit_t"]).drop("refit_t")
