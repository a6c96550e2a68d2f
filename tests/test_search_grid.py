"""The configuration search over stacked fits equals fits and scores one by one."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import gp
from tidemark.plans import models, search
from tidemark.spec import GPSpec


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(5)
    out = {}
    for key, n in (("a", 40), ("b", 23), ("c", 1)):
        t = np.arange(n)
        out[key] = (np.stack([np.sin(2 * np.pi * t / 12), rng.standard_normal(n)], axis=1), 20 + 5 * np.sin(2 * np.pi * t / 12) + rng.standard_normal(n))
    return out


def jobs_of(spark, sets):
    rows = [(k, x.ravel().tolist(), y.tolist()) for k, (x, y) in sets.items()]
    return spark.createDataFrame(rows, "series_id string, xs array<double>, ys array<double>")


def chosen_configs():
    picked = [search.config(i) for i in range(17, search.grid_size() // 2, 977)]
    return [c | {"n_restarts": n} for c, n in zip(picked, (0, 5, 10, 3, 5, 0, 10, 1, 5, 7))]


def test_stacked_inverse_and_failures(rng):
    for n in (1, 7, 8, 9, 40, 51, 64):
        a = rng.standard_normal((12, n, n + 3))
        low = np.linalg.cholesky(a @ a.transpose(0, 2, 1) + np.eye(n))
        assert np.allclose(gp._inverse_lower(low) @ low, np.eye(n), atol=1e-8)
    d = np.zeros((9, 10))  # four equal points: singular without noise
    y = rng.standard_normal((9, 4))
    alpha = np.where(np.arange(9) % 3 == 0, -1e-3, 0.5)
    theta = rng.normal(0, 1, (9, 1))
    value, gradient = gp.likelihoods((("rbf",),), theta, d, y, alpha)
    assert (np.isneginf(value) == (alpha < 0)).all() and (gradient[alpha < 0] == 0).all()
    for i in np.flatnonzero(alpha > 0):
        alone = gp.likelihoods((("rbf",),), theta[i : i + 1], d[:1], y[i : i + 1], alpha[i : i + 1])
        assert value[i] == pytest.approx(alone[0][0]) and gradient[i] == pytest.approx(alone[1][0])


def test_rows_of_an_ascent_do_not_touch_each_other(rng):
    sets = [(rng.standard_normal((n, 2)), rng.standard_normal(n)) for n in (30, 24, 30)]
    owner = np.array([0, 1, 2, 0, 1, 1, 2, 0])
    kernel = (("rational_quadratic",), ("periodic", "constant"))
    starts = gp.starts_of(kernel, 12, 7)
    assert (gp.starts_of(kernel, 12, 3) == starts[:4]).all()
    alpha, normal = np.array([0.1, 1.0] * 4), np.array([True, False, False, True] * 2)
    together = gp.fit_starts(kernel, sets, owner, starts, alpha, normal, 12)
    for i, f in enumerate(together):
        one = slice(i, i + 1)
        alone = gp.fit_starts(kernel, [sets[owner[i]]], [0], starts[one], alpha[one], normal[one], 12)[0]
        assert f.likelihood == pytest.approx(alone.likelihood, rel=1e-6, abs=1e-6) and f.converged == alone.converged


def test_an_ascent_cut_short_says_so(rng, monkeypatch):
    x, y = rng.standard_normal((25, 1)), rng.standard_normal(25)
    monkeypatch.setattr(gp.maximise, "__defaults__", (1, 1e-5))
    assert not gp.fit((("rbf", "periodic"),), x, y, 0.1, True).converged


@pytest.mark.parametrize(("per_row", "together"), [(64, None), (4, "cv"), (64, "cv")])
def test_grid_equals_single_fits(spark, sets, monkeypatch, per_row, together):
    monkeypatch.setattr(models, "STARTS_PER_ROW", per_row)
    configs, arrays, spec = chosen_configs(), jobs_of(spark, sets), GPSpec(period=12)
    entries = models.grid_rows(configs)
    assert sum(r["starts"] for e in entries for r in json.loads(e["runs"])) == sum(c["n_restarts"] + 1 for c in configs)
    assert all(sum(r["starts"] for r in json.loads(e["runs"])) <= per_row for e in entries)
    if together:  # one job for all three sets
        numbered = arrays.withColumn("cv", F.ascii("series_id")).withColumn("key", F.lit("k")).drop("series_id")
        fitted = models.fit_grid(numbered, ["key", "cv"], configs, spec, ("x", "public_y"), together).withColumn("series_id", F.char("cv"))
    else:
        fitted = models.fit_grid(arrays, ["series_id"], configs, spec, ("x", "public_y"))
    got = {(r.series_id, r.config_id): r for r in fitted.collect()}
    assert len(got) == 3 * len(configs)
    single = search.explode_config(arrays, configs, search.CONFIG_SCHEMA)
    for r in models.fit(single, spec, ("x", "public_y")).collect():
        g = got[r.series_id, r.config_id]
        assert (g.status, g.kernel, g.alpha, g.n_restarts) == (r.status, r.kernel, r.alpha, r.n_restarts)
        assert g.likelihood == pytest.approx(r.likelihood, rel=1e-6, abs=1e-5) and list(g.x_mean) == list(r.x_mean)


def test_scores_equal_joined_predictions(spark, sets, monkeypatch):
    monkeypatch.setattr(models, "CHUNK_ROWS", 5)
    configs, arrays = chosen_configs()[:4], jobs_of(spark, sets)
    fitted = models.fit_grid(arrays, ["series_id"], configs, GPSpec(period=12))
    rows = [(k, t, [math.sin(t), 0.5], 20.0 + t if (k, t) != ("b", 3) else None) for k in sets for t in range(12)]
    points = spark.createDataFrame(rows, "series_id string, t long, x array<double>, y double")
    got = {(r.series_id, r.config_id): r.rmse for r in models.score_grid(points, fitted, arrays, ["series_id"]).collect()}
    plain = models.predict(points.drop("y"), fitted.join(arrays, "series_id"), ["series_id"]).join(points, ["series_id", "t"])
    want = plain.groupBy("series_id", "config_id").agg(
        F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2)).alias("rmse"), F.count_if(F.col("y").isNull()).alias("gaps")
    ).collect()
    assert len(got) == len(want) == 12
    for r in want:
        assert got[r.series_id, r.config_id] == (None if r.gaps else pytest.approx(r.rmse))


def test_rows_of_failed_fits_stay(spark):
    """A series whose fit fails and one without train rows keep their predictions' rows, and their place in the comparison."""
    from tidemark.plans import online
    from tidemark.spec import OnlineSpec, SeriesSpec

    spec = SeriesSpec(season=4)
    rows = [("good", t, 10.0 + t % 4 + 0.01 * t, [float(t)], 30) for t in range(40)]
    rows += [("broken", t, 5.0 + t % 4, [float("nan") if t < 30 else float(t)], 30) for t in range(40)]
    rows += [("late", t, 3.0, [float(t)], 0) for t in range(6)]
    series = spark.createDataFrame(rows, "series_id string, t long, y double, x array<double>, n_train long")
    gp_spec = GPSpec(kernel=(("rbf",), ("white",)))
    run = online.run_online(series, spec, OnlineSpec(), gp_spec)
    found = {(r.series_id, r.model): (r.n, r.known) for r in run.predictions.groupBy("series_id", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count("prediction").alias("known")).collect()}
    assert found["good", "base"] == (10, 10) and found["broken", "base"] == (10, 0) and found["late", "base"] == (6, 0)
    assert found["broken", "online"][0] == 10 and found["late", "online"][0] == 6
    often = online.periodic_refits(series, spec, gp_spec, 2)
    counts = {r.series_id: (r.n, r.known) for r in often.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("prediction").alias("known")).collect()}
    assert counts["good"] == (10, 10) and counts["broken"] == (10, 0) and counts["late"][0] == 6
    compared = {r.series_id: r for r in online.compare_methods(run.predictions, series, spec).collect()}
    assert set(compared) == {"good", "broken", "late"} and compared["broken"].rmse_base is None and compared["good"].rmse_base > 0


def test_running_best_in_blocks(spark, rng):
    rows = [("a", int(i), None if i % 13 == 0 else float(v)) for i, v in enumerate(rng.lognormal(0, 1, 300).round(1))] + [("b", 5, None), ("b", 9, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, config_id int, rmse_test double").repartition(7)
    out = {(r.series_id, r.config_id): (r.best_so_far, r.improved) for r in search.running_best(df, ["series_id"], block=7).collect()}
    best: dict = {}
    for key, i, v in rows:
        seen = best.get(key)
        improved = v is not None and (seen is None or v < seen)
        best[key] = v if seen is None else seen if v is None else min(v, seen)
        assert out[key, i] == (best[key], improved)


def test_season_of_quarterly_weeks():
    from tidemark.spec import DatasetSpec, SeriesSpec

    year = SeriesSpec(season=364)
    assert [DatasetSpec(n, series=year, weekly=w, quarter=q).model_season for n, w, q in (
        ("x", True, None), ("x_quarter", True, None), ("x", True, True), ("x_quarter", True, False), ("x_quarter", False, None))] == [52, 13, 13, 52, 364]
