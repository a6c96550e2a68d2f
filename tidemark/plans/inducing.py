"""Gaussian-process models of long series: inducing points, and sums over all rows.

An exact model needs a matrix of all rows with all rows. Here a series is represented by a fixed number of points, and every
row enters through its kernel values to them (deterministic training conditional; Quinonero-Candela and Rasmussen 2005).
Those values are summed up in blocks by many tasks, so one series may be of any length, and what is solved has the size of
the points. With all rows as points the model is the exact one. Parameters of the kernel come from an exact fit to a
bounded sample of the rows, drawn by hash (all rows of a series that has no more), or are given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import gp as numerics
from tidemark.functions.rand import order_key
from tidemark.operators.splits import smallest_by_hash
from tidemark.plans import models
from tidemark.session import cut_lineage
from tidemark.spec import GPSpec, SeriesSpec

#: Inducing points of a series, and rows that the parameters of its kernel are fitted to.
POINTS, SAMPLE_ROWS = 64, 512
#: Partial sums that a task holds before it hands them on.
HELD = 256
METHOD = "inducing"
SETTINGS = ("kernel", "alpha", "normalize_y", "theta", "x_mean", "x_std")


def sample_models(rows: DataFrame, spec: SeriesSpec, gp: GPSpec, features=("x",), points: int = POINTS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per series the kernel's parameters, fitted exactly to a sample of rows, and inducing points from it: the columns of
    ``models.fit`` and ``points``, an array of feature arrays. A failed fit is a row with its ``status`` and ``error``."""
    keys = list(spec.keys)
    known = rows.where(F.col(spec.target).isNotNull())
    drawn = order_key(gp.seed, *[F.col(k) for k in keys], F.col("t"))
    some = smallest_by_hash(known, keys, F.lit(sample_rows), drawn, "_drawn").where("_drawn").drop("_drawn")
    some = cut_lineage(some.select(*keys, "t", "x", spec.target), "gp-sample")
    fitted = models.fit(models.with_settings(models.training_arrays(some, keys, spec.target), gp), gp, features).drop("xs", "ys")
    ranked = F.array_sort(F.collect_list(F.struct(drawn.alias("h"), "t", "x")))  # at most SAMPLE_ROWS
    chosen = some.groupBy(*keys).agg(F.slice(ranked, 1, points)["x"].alias("points"))
    return fitted.join(chosen, keys)


def given_models(rows: DataFrame, spec: SeriesSpec, gp: GPSpec, theta: list[float], points: list[list[float]]) -> DataFrame:
    """The same parameters (logarithms, in the order of the kernel) and points for every series; features are taken as they are."""
    width = len(points[0])
    array = lambda values: F.array(*[F.lit(float(v)) for v in values])
    return models.with_settings(rows.select(*spec.keys).distinct(), gp).withColumns({
        "theta": array(theta), "likelihood": F.lit(None).cast("double"), "converged": F.lit(None).cast("boolean"),
        "x_mean": array([0.0] * width), "x_std": array([1.0] * width), "status": F.lit("ok"), "error": F.lit(None).cast("string"),
        "points": F.array(*[array(p) for p in points]),
    })


def gram_sums(rows: DataFrame, spec: SeriesSpec, fitted: DataFrame) -> DataFrame:
    """Per series one array of sums over all its rows with a target: count, target, its square, kernel values to the points, these times the
    target, and their products with each other. Of fixed size, added up in tasks and then by Spark."""
    keys = list(spec.keys)
    known = rows.where(F.col(spec.target).isNotNull())
    blocks = known.groupBy(*keys, F.floor(F.col("t") / models.CHUNK_ROWS).alias("_block")).agg(
        F.collect_list(F.struct("x", F.col(spec.target).cast("double").alias("y"))).alias("_rows")
    ).select(*keys, F.flatten(F.transform("_rows", lambda r: r["x"])).alias("_x"), F.col("_rows.y").alias("_y"))
    jobs = blocks.join(fitted.where("status = 'ok'").select(*keys, *SETTINGS, F.flatten("points").alias("_z")), keys)
    schema = T.StructType([*(jobs.schema[k] for k in keys), T.StructField("sums", models.DOUBLES)])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def hand_on() -> pd.DataFrame:
            out = pd.DataFrame([[*k, v.tolist()] for k, v in held.items()], columns=schema.names)
            held.clear()
            return out

        for batch in batches:
            for job in batch.to_dict("records"):
                key, sums = tuple(job[k] for k in keys), _block_sums(job)
                held[key] = held[key] + sums if key in held else sums
                if len(held) >= HELD:
                    yield hand_on()
        if held:
            yield hand_on()

    parts = jobs.mapInPandas(add_up, schema)
    cells = parts.select(*keys, F.posexplode("sums").alias("_at", "_value")).groupBy(*keys, "_at").agg(F.sum("_value").alias("_value"))
    whole = F.array_sort(F.collect_list(F.struct("_at", "_value")))
    return cells.groupBy(*keys).agg(whole["_value"].alias("sums"))


def _points(job: dict) -> np.ndarray:
    """Standardised inducing points."""
    mean, std = np.asarray(job["x_mean"]), np.asarray(job["x_std"])
    return (np.asarray(job["_z"], dtype=float).reshape(-1, len(mean)) - mean) / std


def _across(job: dict, x, z: np.ndarray) -> np.ndarray:
    mean, std = np.asarray(job["x_mean"]), np.asarray(job["x_std"])
    new = (np.asarray(x, dtype=float).reshape(-1, len(mean)) - mean) / std
    return numerics.kernel_matrix(models.kernel_of(job["kernel"]), job["theta"], numerics.distances(new, z), False)


def _block_sums(job: dict) -> np.ndarray:
    y = np.asarray(job["_y"], dtype=float)
    k = _across(job, job["_x"], _points(job))
    gram = k.T @ k
    return np.concatenate([[len(y), y.sum(), y @ y], k.sum(axis=0), k.T @ y, gram[np.tril_indices(len(gram))]])


def solve(fitted: DataFrame, sums: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Models ready to predict: ``weights`` and ``matrix`` of the size of the points, ``method`` and ``rows_used``."""
    keys = list(spec.keys)
    jobs = fitted.drop("n_restarts", "standardize").withColumn("_z", F.flatten("points")).join(sums, keys, "left")
    own = T.StructType.fromDDL("weights array<double>, matrix array<double>, y_mean double, y_std double, rows_used long, method string")
    kept = [f for f in jobs.schema.fields if f.name not in ("sums", "_z", "points")]
    schema = T.StructType([*kept, T.StructField("_z", models.DOUBLES), *own.fields])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [job | _solved(job) for job in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=schema.names)

    return jobs.mapInPandas(work, schema)


def _solved(job: dict) -> dict:
    out = dict(weights=None, matrix=None, y_mean=None, y_std=None, rows_used=0, method=METHOD)
    if job["status"] != "ok" or job["sums"] is None:
        return out
    z, sums, kernel = _points(job), np.asarray(job["sums"]), models.kernel_of(job["kernel"])
    m = len(z)
    n, total, squares = sums[:3]
    mean, std = 0.0, 1.0
    if job["normalize_y"]:
        mean = total / n
        std = np.sqrt(max(squares / n - mean * mean, 0.0)) or 1.0
    pull = (sums[3 + m : 3 + 2 * m] - mean * sums[3 : 3 + m]) / std
    gram = np.zeros((m, m))
    gram[np.tril_indices(m)] = sums[3 + 2 * m :]
    gram += np.tril(gram, -1).T
    among = numerics.kernel_matrix(kernel, job["theta"], numerics.distances(z, z), False)
    alone = [numerics.kernel_matrix(kernel, job["theta"], np.zeros((1, 1)), same)[0, 0] for same in (True, False)]
    noise = job["alpha"] + alone[0] - alone[1]
    # points that lie on each other would leave the system singular
    among[np.diag_indices(m)] += 1e-10 * max(alone[1], 1e-300)
    try:
        half = np.linalg.inv(np.linalg.cholesky(among))
        inner = np.linalg.inv(noise * np.eye(m) + half @ gram @ half.T)
    except np.linalg.LinAlgError:
        return out | dict(status="failed", error="kernel matrix of the inducing points is not positive definite")
    weights, matrix = half.T @ (inner @ (half @ pull)), half.T @ (np.eye(m) - noise * inner) @ half
    return out | dict(weights=weights.tolist(), matrix=matrix.ravel().tolist(), y_mean=float(mean), y_std=float(std), rows_used=int(n))


def fit(rows: DataFrame, spec: SeriesSpec, gp: GPSpec, features=("x",), points: int = POINTS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One inducing-point model per series from long rows ``t, x`` and target; rows without target do not train.

    Failed fits are rows with ``status`` and ``error``. A series without any target has no row; an empty table gives none.
    """
    fitted = cut_lineage(sample_models(rows, spec, gp, features, points, sample_rows), "gp-fitted")
    return cut_lineage(solve(fitted, gram_sums(rows, spec, fitted), spec), "gp-inducing")


def predict(points: DataFrame, solved: DataFrame, on) -> DataFrame:
    """``on, t, prediction, lower_conf, upper_conf`` for points ``on, t, x``; a series without a model keeps its rows, with nulls."""
    on = list(on)
    chunks = points.groupBy(*on, F.floor(F.col("t") / models.CHUNK_ROWS).alias("_chunk")).agg(
        F.collect_list(F.struct("t", "x")).alias("_rows")
    ).select(*on, F.col("_rows.t").alias("_t"), F.flatten(F.transform("_rows", lambda r: r["x"])).alias("_x"))
    usable = solved.where(F.col("weights").isNotNull())
    jobs = chunks.join(usable.select(*on, *SETTINGS, "_z", "weights", "matrix", "y_mean", "y_std"), on, "left")
    schema = T.StructType([*(jobs.schema[c] for c in on), *T.StructType.fromDDL(
        "t long, prediction double, lower_conf double, upper_conf double").fields])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for job in batch.to_dict("records"):
                yield _predicted(job, on)

    return jobs.mapInPandas(work, schema)


def _predicted(job: dict, on: list[str]) -> pd.DataFrame:
    out = pd.DataFrame({"t": np.asarray(job["_t"], np.int64), "prediction": np.nan, "lower_conf": np.nan, "upper_conf": np.nan})
    if job["weights"] is not None:
        z = _points(job)
        k = _across(job, job["_x"], z)
        prior = numerics.kernel_matrix(models.kernel_of(job["kernel"]), job["theta"], np.zeros((1, 1)), True)[0, 0]
        matrix = np.asarray(job["matrix"]).reshape(len(z), len(z))
        spread = np.sqrt(np.clip(prior - ((k @ matrix) * k).sum(axis=1), 0, None)) * job["y_std"]
        centre = k @ np.asarray(job["weights"]) * job["y_std"] + job["y_mean"]
        half = numerics.INTERVAL * spread
        out["prediction"], out["lower_conf"], out["upper_conf"] = centre, centre - half, centre + half
    for i, c in enumerate(on):
        out.insert(i, c, job[c])
    return out
