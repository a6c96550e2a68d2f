"""Inducing-point models against the exact model, a plain closed form, and one very long series."""

import numpy as np
import pytest
from conftest import by_series, series_frame
from pyspark.sql import functions as F

from tidemark.functions import gp
from tidemark.plans import inducing, models
from tidemark.spec import GPSpec, SeriesSpec

SPEC = SeriesSpec(season=12)
KERNEL = (("constant", "rbf"), ("white",))


def timed(spark, values):
    return series_frame(spark, values).withColumn("x", F.array(F.col("t").cast("double") / 10))


def test_all_rows_as_points_give_the_exact_model(spark, rng):
    values = {"a": list(np.sin(np.arange(60) / 7) * 3 + rng.standard_normal(60) * 0.1), "b": [5.0] * 20, "c": [None] * 3}
    values["a"][7] = None
    rows, spec = timed(spark, values), GPSpec(kernel=KERNEL, alpha=0.05)
    solved = inducing.fit(rows, SPEC, spec, points=100)
    got = by_series(inducing.predict(rows, solved, ["series_id"]), "prediction", "lower_conf", "upper_conf")
    jobs = models.with_settings(models.training_arrays(rows.where("y IS NOT NULL"), ["series_id"]), spec)
    exact = by_series(models.predict(rows.select("series_id", "t", "x"), models.fit(jobs, spec), ["series_id"]), "prediction", "lower_conf", "upper_conf")
    for key in ("a", "b"):
        for c in exact[key]:
            assert got[key][c] == pytest.approx(exact[key][c], rel=1e-3, abs=1e-3)
    assert got["c"]["prediction"] == [None] * 3
    assert {r.series_id: (r.method, r.rows_used, r.status) for r in solved.collect()} == {"a": ("inducing", 59, "ok"), "b": ("inducing", 20, "ok")}


def test_sums_over_blocks_equal_one_matrix(spark, rng, monkeypatch):
    monkeypatch.setattr(models, "CHUNK_ROWS", 7)
    monkeypatch.setattr(inducing, "HELD", 2)
    n, spec = 300, GPSpec(kernel=KERNEL, alpha=0.3)
    values = {k: list(np.cos(np.arange(n) / (9 + i)) + rng.standard_normal(n) * 0.2) for i, k in enumerate("abcde")}
    rows = timed(spark, values).repartition(6)
    solved = inducing.fit(rows, SPEC, spec, points=9, sample_rows=50)
    got = by_series(inducing.predict(rows, solved, ["series_id"]), "prediction", "upper_conf")
    x = np.arange(n)[:, None] / 10
    for r in solved.collect():
        y = np.array(values[r.series_id])
        z = np.array(r._z).reshape(-1, 1)
        target = (y - y.mean()) / y.std()
        among, across = (gp.kernel_matrix(KERNEL, r.theta, gp.distances(a, z), False) for a in (z, x))
        noise = 0.3 + np.exp(r.theta[2])
        among += 1e-10 * np.exp(r.theta[0]) * np.eye(9)
        weights = np.linalg.solve(noise * among + across.T @ across, across.T @ target)
        assert got[r.series_id]["prediction"] == pytest.approx(across @ weights * y.std() + y.mean(), rel=1e-5, abs=1e-5)
        lost = np.einsum("ij,ij->i", across @ (np.linalg.inv(among) - noise * np.linalg.inv(noise * among + across.T @ across)), across)
        spread = np.sqrt(np.clip(np.exp(r.theta[0]) + np.exp(r.theta[2]) - lost, 0, None)) * y.std()
        assert np.array(got[r.series_id]["upper_conf"]) - np.array(got[r.series_id]["prediction"]) == pytest.approx(1.96 * spread, rel=1e-3, abs=1e-3)
        assert r.rows_used == n and len(z) == 9


def test_a_series_of_a_million_rows_in_many_tasks(spark):
    n = 1_000_000
    rows = spark.range(n).select(
        F.lit("s").alias("series_id"), F.col("id").alias("t"), F.array((F.col("id") % 365) / 365.0).alias("x"),
        (10 + 3 * F.sin((F.col("id") % 365) / 365.0 * 6.283185307179586) + (F.xxhash64("id") % 100) / 200.0).alias("y"),
    )
    solved = inducing.fit(rows, SPEC, GPSpec(kernel=(("rbf",), ("white",)), alpha=0.1), points=24, sample_rows=200)
    model = solved.first()
    assert (model.rows_used, model.status) == (n, "ok")
    out = inducing.predict(rows.where("t < 365"), solved, ["series_id"]).join(rows, ["series_id", "t"])
    truth = 10 + 3 * F.sin(F.col("x")[0] * 6.283185307179586)
    assert out.agg(F.max(F.abs(F.col("prediction") - truth))).first()[0] < 0.1


def test_empty_table_and_failed_fit(spark):
    rows = timed(spark, {"a": [1.0, 2.0, 3.0]})
    assert inducing.fit(rows.limit(0), SPEC, GPSpec()).count() == 0
    broken = rows.withColumn("x", F.array(F.lit(float("nan"))))
    solved = inducing.fit(broken, SPEC, GPSpec())
    assert [(r.status, r.weights, r.rows_used) for r in solved.collect()] == [("failed", None, 0)]
    assert [r.prediction for r in inducing.predict(rows, solved, ["series_id"]).collect()] == [None] * 3
