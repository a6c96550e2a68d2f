"""One bounded Gaussian-process model per key, fitted across the cluster.

A fit is one row of a job table: its training set as flat arrays and its
settings. Fitting maps over rows, so Spark spreads the jobs and nothing is
grouped in memory. Matrices are not stored; prediction rebuilds them from the
training set, per chunk of rows to predict.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import gp as numerics
from tidemark.functions.config import explode_config
from tidemark.operators.augment import as_arrays
from tidemark.session import task_count
from tidemark.spec import GPSpec

CHUNK_ROWS = 2_048
#: Starts that a row of a search fits side by side, and rows that a task gets.
STARTS_PER_ROW, JOBS_PER_TASK = 64, 8
#: Jobs that a task fits side by side, and cells of their matrices.
STACK_JOBS, STACK_CELLS = 256, 1 << 21
DOUBLES = T.ArrayType(T.DoubleType())
FITTED = [
    T.StructField("theta", DOUBLES),
    T.StructField("likelihood", T.DoubleType()),
    T.StructField("converged", T.BooleanType()),
    T.StructField("x_mean", DOUBLES),
    T.StructField("x_std", DOUBLES),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
]
SETTINGS = ("kernel", "alpha", "n_restarts", "standardize", "normalize_y")


def kernel_text(kernel) -> str:
    return json.dumps([list(term) for term in kernel])


def kernel_of(text: str):
    return tuple(tuple(term) for term in json.loads(text))


def with_settings(jobs: DataFrame, gp: GPSpec, chosen: DataFrame | None = None) -> DataFrame:
    """Model settings on every job: those of ``gp``, or a series' own from ``chosen`` (say, its best configuration)."""
    if chosen is not None:
        keys = [c for c in chosen.columns if c not in SETTINGS]
        return jobs.join(chosen, keys)
    return jobs.withColumns(
        {
            "kernel": F.lit(kernel_text(gp.kernel)),
            "alpha": F.lit(float(gp.alpha)),
            "n_restarts": F.lit(int(gp.n_restarts)),
            "standardize": F.lit(bool(gp.standardize)),
            "normalize_y": F.lit(bool(gp.normalize_y)),
        }
    )


def training_arrays(rows: DataFrame, keys, target: str = "y", cap: int | None = None) -> DataFrame:
    """Jobs from long rows ``t, x, y``: the last ``cap`` rows of each key as arrays.

    The cap is applied before rows are collected; keys are expected to hold all
    columns that identify a job. ``t_end`` (exclusive end of the rows) is needed
    with a cap.
    """
    if cap is not None:
        rows = rows.where(F.col("t") >= F.col("t_end") - cap)
    grouped = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("t", "x", F.col(target).alias("y")))).alias("rows")
    )
    return as_arrays(grouped)


def _standard(x: np.ndarray, skip: np.ndarray):
    mean = x.mean(axis=0)
    std = x.std(axis=0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
    std = np.where((std == 0) | ~np.isfinite(std), 1.0, std)
    return np.where(skip, 0.0, mean), np.where(skip, 1.0, std)


def fit(jobs: DataFrame, gp: GPSpec, features=("x",)) -> DataFrame:
    """Fit every job; adds ``theta, likelihood, converged, x_mean, x_std, status, error``.

    Starts from ``theta0`` when the column is there, else from the kernel's start
    values. A failing job gives a row with its error and stops nothing. Columns named
    ``public..`` or ``school..`` are not standardised.
    """
    period = gp.period
    skip = np.array([f.startswith(("public", "school")) for f in features])
    seed = gp.seed
    schema = T.StructType([*jobs.schema.fields, *FITTED])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            jobs = batch.to_dict("records")
            found: list[dict] = [{}] * len(jobs)
            for some in _stacks(jobs):
                for i, f in zip(some, _fit_stack([jobs[i] for i in some], skip, period, seed)):
                    found[i] = f
            out = batch.copy()
            for name in ("theta", "likelihood", "converged", "x_mean", "x_std", "status", "error"):
                out[name] = [f[name] for f in found]
            yield out

    ids = [c for c in jobs.columns if c not in ("xs", "ys", "theta0", *SETTINGS)]
    # hashing the keys once more keeps Spark from taking an earlier, merged shuffle for this one
    return jobs.repartition(task_count(jobs), F.xxhash64(*ids)).mapInPandas(work, schema)


def _stacks(jobs: list[dict]) -> Iterator[list[int]]:
    """Numbers of jobs of one kernel, few enough to be fitted side by side; similar sizes go together."""
    some, cells, last = [], 0, None
    for i in sorted(range(len(jobs)), key=lambda i: (jobs[i]["kernel"], len(jobs[i]["ys"]))):
        own = len(jobs[i]["ys"]) ** 2 * (int(jobs[i]["n_restarts"]) + 1)
        if some and (jobs[i]["kernel"] != last or len(some) >= STACK_JOBS or cells + own > STACK_CELLS):
            yield some
            some, cells = [], 0
        some.append(i)
        cells, last = cells + own, jobs[i]["kernel"]
    if some:
        yield some


def _fit_stack(jobs: list[dict], skip: np.ndarray, period: int | None, seed: int) -> list[dict]:
    """Fits of jobs of one kernel, each as if it were alone."""
    out = [dict(theta=None, likelihood=None, converged=None, x_mean=None, x_std=None, status="failed", error=None) for _ in jobs]
    sets, owner, starts, mine = [], [], [], []
    for job, result in zip(jobs, out):
        try:
            kernel = kernel_of(job["kernel"])
            x, y, mean, std = _training_set(job["xs"], job["ys"], job["standardize"], skip)
            first = numerics.starts_of(kernel, period, int(job["n_restarts"]), seed, job.get("theta0"))
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as problem:
            result["error"] = str(problem)
            continue
        owner += [len(sets)] * len(first)
        sets.append(((x - mean) / std, y))
        starts.append(first)
        mine.append((job, result, mean, std))
    if not mine:
        return out
    each = [len(s) for s in starts]
    spread = lambda values: np.repeat(np.array(values), each)
    try:
        fits = numerics.fit_starts(
            kernel, sets, owner, np.concatenate(starts), spread([float(j["alpha"]) for j, *_ in mine]),
            spread([bool(j["normalize_y"]) for j, *_ in mine]), period,
        )
    except (ValueError, ArithmeticError, np.linalg.LinAlgError) as problem:
        if len(jobs) == 1:
            mine[0][1]["error"] = str(problem)
            return out
        return [_fit_stack([job], skip, period, seed)[0] for job in jobs]
    for (_, result, mean, std), end, n in zip(mine, np.cumsum(each), each):
        best = max(fits[end - n : end], key=lambda f: f.likelihood)
        if not np.isfinite(best.likelihood):
            result["error"] = "kernel matrix is not positive definite"
            continue
        result |= dict(theta=best.theta.tolist(), likelihood=best.likelihood, converged=best.converged,
                       x_mean=mean.tolist(), x_std=std.tolist(), status="ok")
    return out


def grid_rows(configs: list[dict]) -> list[dict]:
    """Configurations by kernel as literal rows ``kernel, part, runs``, with at most ``STARTS_PER_ROW`` starts in a row.

    A run is some starts of one configuration, so restarts are spread over rows as well.
    """
    entries: list[dict] = []
    for kernel, group in groupby(sorted(configs, key=lambda c: (c["kernel"], c["config_id"])), lambda c: c["kernel"]):
        runs, held = [], 0
        for c in group:
            first = 0
            while first <= c["n_restarts"]:
                starts = min(c["n_restarts"] + 1 - first, STARTS_PER_ROW - held)
                runs.append({k: c[k] for k in ("config_id", *SETTINGS)} | {"first": first, "starts": starts})
                first, held = first + starts, held + starts
                if held == STARTS_PER_ROW:
                    entries.append({"kernel": kernel, "part": len(entries), "runs": json.dumps(runs)})
                    runs, held = [], 0
        if runs:
            entries.append({"kernel": kernel, "part": len(entries), "runs": json.dumps(runs)})
    return entries


def _spread(jobs: DataFrame, rows: int, by) -> DataFrame:
    """Jobs over tasks of at most ``JOBS_PER_TASK``, ``rows`` of them in all."""
    return jobs.repartition(max(task_count(jobs), -(-rows // JOBS_PER_TASK)), F.xxhash64(*by))


def fit_grid(arrays: DataFrame, ids, configs: list[dict], gp: GPSpec, features=("x",), together: str | None = None) -> DataFrame:
    """The best start of every configuration on every training set ``ids, xs, ys``: ``ids, config_id``, its settings, and what ``fit`` adds.

    A job is one kernel with the training sets that differ only in the column ``together`` (say, the splits of a cross
    validation; few by nature): every set has one matrix of distances, and all its configurations and starts go side by
    side. Starts and results are those of ``fit`` for each configuration alone.
    """
    ids, period, seed = list(ids), gp.period, gp.seed
    skip = np.array([f.startswith(("public", "school")) for f in features])
    entries = grid_rows(configs)
    groups = [c for c in ids if c != together]
    number = F.col(together) if together else F.lit(0)
    sets = arrays.groupBy(*groups).agg(F.collect_list(F.struct(number.cast("int").alias("number"), "xs", "ys")).alias("sets"))
    sets = sets.select(*groups, F.col("sets.number").alias("numbers"), F.col("sets.xs").alias("xs"), F.col("sets.ys").alias("ys"))
    jobs = explode_config(sets, entries, "kernel string, part int, runs string")
    settings = "config_id int, kernel string, alpha double, n_restarts int, standardize boolean, normalize_y boolean"
    found = "theta array<double>, likelihood double, converged boolean, x_mean array<double>, x_std array<double>, status string, error string"
    own = T.StructType.fromDDL(f"number int, {settings}, part int, {found}")
    schema = T.StructType([*(jobs.schema[c] for c in groups), *own.fields])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [dict(zip(groups, (job[c] for c in groups)), part=job["part"], **run)
                    for job in batch.to_dict("records") for run in _fit_runs(job, skip, period, seed)]
            yield pd.DataFrame(rows, columns=schema.names)

    runs = _spread(jobs, arrays.count() * len(entries), [*groups, "part"]).mapInPandas(work, schema)
    if together:
        runs = runs.withColumnRenamed("number", together)
    best = F.struct(F.coalesce("likelihood", F.lit(float("-inf"))), -F.col("part"))
    fitted = [c for c in own.names if c not in ("number", "config_id", "part")]
    return runs.groupBy(*ids, "config_id").agg(F.max_by(F.struct(*fitted), best).alias("best")).select(*ids, "config_id", "best.*")


def _fit_runs(job: dict, skip: np.ndarray, period: int | None, seed: int) -> list[dict]:
    """The best start of every run on every set of a job."""
    kernel, out = kernel_of(job["kernel"]), []
    runs = json.loads(job["runs"])
    sets, means, todo = [], [], []
    for number, xs, ys in zip(job["numbers"], job["xs"], job["ys"]):
        for standardize in sorted({r["standardize"] for r in runs}):
            mine = [r for r in runs if r["standardize"] == standardize]
            try:
                x, y, mean, std = _training_set(xs, ys, standardize, skip)
            except (ValueError, ArithmeticError, np.linalg.LinAlgError) as problem:
                out += [_failed_run(number, r, str(problem)) for r in mine]
                continue
            todo += [(number, r, len(sets)) for r in mine]
            sets.append(((x - mean) / std, y))
            means.append((mean, std))
    if not todo:
        return out
    starts = [numerics.starts_of(kernel, period, r["n_restarts"], seed)[r["first"] : r["first"] + r["starts"]] for _, r, _ in todo]
    each = [len(s) for s in starts]
    spread = lambda values: np.repeat(np.array(values), each)
    fits = numerics.fit_starts(
        kernel, sets, spread([k for *_, k in todo]), np.concatenate(starts), spread([float(r["alpha"]) for _, r, _ in todo]),
        spread([r["normalize_y"] for _, r, _ in todo]), period,
    )
    for (number, run, k), end, n in zip(todo, np.cumsum(each), each):
        best = max(fits[end - n : end], key=lambda f: f.likelihood)
        if not np.isfinite(best.likelihood):
            out.append(_failed_run(number, run, "kernel matrix is not positive definite"))
            continue
        mean, std = means[k]
        out.append({c: run[c] for c in ("config_id", *SETTINGS)} | dict(
            number=number, theta=best.theta.tolist(), likelihood=best.likelihood, converged=best.converged,
            x_mean=mean.tolist(), x_std=std.tolist(), status="ok", error=None,
        ))
    return out


def _failed_run(number: int, run: dict, error: str) -> dict:
    empty = dict(theta=None, likelihood=None, converged=None, x_mean=None, x_std=None)
    return {c: run[c] for c in ("config_id", *SETTINGS)} | empty | dict(number=number, status="failed", error=error)


def score_grid(points: DataFrame, fitted: DataFrame, arrays: DataFrame, ids) -> DataFrame:
    """``ids, config_id, rmse`` of every fitted configuration on the ``points (ids, t, x, y)`` of its set.

    A training set meets its points in chunks and its models by kernel; only summed errors are shuffled.
    """
    ids = list(ids)
    chunks = points.groupBy(*ids, F.floor(F.col("t") / CHUNK_ROWS).alias("chunk")).agg(
        F.collect_list(F.struct("x", "y")).alias("rows")
    ).select(*ids, "chunk", F.flatten(F.transform("rows", lambda r: r["x"])).alias("new_x"), F.col("rows.y").alias("new_y"))
    model = F.struct("config_id", "theta", "alpha", "normalize_y", "x_mean", "x_std")
    models = fitted.where(F.col("status") == "ok").groupBy(*ids, "kernel").agg(F.to_json(F.collect_list(model)).alias("models"))
    jobs = chunks.join(arrays.select(*ids, "xs", "ys"), ids).join(models, ids)
    schema = T.StructType([*(jobs.schema[c] for c in ids), *T.StructType.fromDDL("config_id int, squares double, n long").fields])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[*(job[c] for c in ids), *scored] for job in batch.to_dict("records") for scored in _score_models(job)]
            yield pd.DataFrame(rows, columns=schema.names)

    kernels = fitted.select("kernel").distinct().count()
    sums = _spread(jobs, arrays.count() * kernels, [*ids, "kernel", "chunk"]).mapInPandas(work, schema)
    return sums.groupBy(*ids, "config_id").agg(
        F.when(F.count("squares") == F.count(F.lit(1)), F.sqrt(F.sum("squares") / F.sum("n"))).alias("rmse")
    )


def _score_models(job: dict) -> Iterator[tuple[int, float | None, int]]:
    """Squared errors of each model of one kernel; null where a prediction or a value is missing."""
    kernel, y, actual = kernel_of(job["kernel"]), np.asarray(job["ys"], dtype=float), np.asarray(job["new_y"], dtype=float)
    x, new = np.asarray(job["xs"], dtype=float).reshape(len(y), -1), np.asarray(job["new_x"], dtype=float).reshape(len(actual), -1)
    for m in json.loads(job["models"]):
        mean, std = np.array(m["x_mean"]), np.array(m["x_std"])
        try:
            found, _ = numerics.predict(kernel, m["theta"], (x - mean) / std, y, m["alpha"], m["normalize_y"], (new - mean) / std)
        except np.linalg.LinAlgError:
            found = np.full(len(actual), np.nan)
        yield m["config_id"], float(((found - actual) ** 2).sum()), len(actual)


def _training_set(xs, ys, standardize: bool, skip: np.ndarray):
    y = np.asarray(ys, dtype=float)
    if len(y) == 0:
        raise ValueError("no training rows")
    x = np.asarray(xs, dtype=float).reshape(len(y), -1)
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("missing values in the training rows")
    mean, std = _standard(x, skip) if standardize else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    return x, y, mean, std


def predict(points: DataFrame, models: DataFrame, on) -> DataFrame:
    """Prediction with a 95 % interval for every point, from the model with equal ``on`` columns.

    A point whose model failed, or that has none, keeps its row, with nulls. ``points`` has the ``on`` columns, ``t`` and ``x``; several models of one key (say, rivals) may
    match one point and give one row each. Points meet a model in chunks of at most
    ``CHUNK_ROWS`` rows, so a model in force for very long is applied by many tasks.
    """
    on = list(on)
    extra = [c for c in models.columns if c not in (*on, "xs", "ys", "theta0", "likelihood", "converged", "error", "status",
                                                    "theta", "x_mean", "x_std", *SETTINGS)]
    chunks = (
        points.withColumn("_chunk", F.floor(F.col("t") / CHUNK_ROWS))
        .groupBy(*on, "_chunk")
        .agg(F.collect_list(F.struct("t", "x")).alias("_rows"))
        .withColumn("_t", F.transform("_rows", lambda r: r["t"]))
        .withColumn("_x", F.flatten(F.transform("_rows", lambda r: r["x"])))
        .drop("_rows")
    )
    known = [F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in ("xs", "ys", "theta", "x_mean", "x_std")]
    usable = models.select(*on, *extra, *known, *[c for c in SETTINGS if c != "n_restarts"])
    paired = chunks.join(usable, on, "left")
    ids = [*on, *extra]
    schema = T.StructType(
        [paired.schema[c] for c in ids]
        + [
            T.StructField("t", T.LongType()),
            T.StructField("prediction", T.DoubleType()),
            T.StructField("lower_conf", T.DoubleType()),
            T.StructField("upper_conf", T.DoubleType()),
        ]
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_predict_one(job) for job in batch.to_dict("records")]
            if found:
                t, centre, half = (np.concatenate(c) for c in zip(*found))
                rows = batch[ids].iloc[np.repeat(np.arange(len(batch)), [len(f[0]) for f in found])].reset_index(drop=True)
                yield rows.assign(t=t, prediction=centre, lower_conf=centre - half, upper_conf=centre + half)

    return paired.repartition(task_count(paired), F.xxhash64(*ids, "_chunk")).mapInPandas(work, schema)


def _predict_one(job: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, predictions and half the widths of their intervals."""
    centre = half = np.full(len(job["_t"]), np.nan)
    if job["theta"] is not None:
        y = np.asarray(job["ys"], dtype=float)
        mean, std = np.asarray(job["x_mean"]), np.asarray(job["x_std"])
        x = (np.asarray(job["xs"], dtype=float).reshape(len(y), -1) - mean) / std
        new = (np.asarray(job["_x"], dtype=float).reshape(len(job["_t"]), -1) - mean) / std
        try:
            centre, spread = numerics.predict(kernel_of(job["kernel"]), job["theta"], x, y, job["alpha"], job["normalize_y"], new)
            half = numerics.INTERVAL * spread
        except np.linalg.LinAlgError:  # a matrix on the edge of being positive definite
            pass
    return np.asarray(job["_t"], dtype=np.int64), centre, half
