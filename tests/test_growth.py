"""Work that grows no faster than the tables: shared steps are stored, sums stay local, small models are fitted side by side."""

import numpy as np
import pytest
from conftest import series_frame

from tidemark.catalog import queries
from tidemark.functions import gp as numerics
from tidemark.functions import resample
from tidemark.operators import transforms
from tidemark.plans import models

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_hist_avg", "q_augment_scaled", "q_augment_append", "q_augment_gn", "q_augment_smogn"])
def test_suppliers_are_summed_up_once(spark, name):
    assert _plan(queries.QUERIES[name](spark, SMALL)).count("lineitem.parquet") == 0


def test_a_power_grid_is_summed_up_where_its_series_lies(spark):
    df = series_frame(spark, {"a": [1.0, 2.0, 5.0, 3.0] * 5, "b": [4.0, 9.0, 1.0] * 6})
    plan = _plan(transforms.power_fit(df, ["series_id"], rounds=1))
    below = plan[plan.index("Generate explode"):]
    assert "Exchange hashpartitioning(series_id" in below


def _jobs(rng, count):
    kernel = models.kernel_text((("constant", "periodic"), ("white",)))
    sizes = rng.integers(20, 24, count)
    jobs = [
        dict(xs=np.arange(n, dtype=float), ys=np.sin(np.arange(n) / 2) + rng.normal(0, 0.2, n), kernel=kernel, alpha=1e-3,
             n_restarts=0, standardize=bool(i % 2), normalize_y=True, theta0=None if i % 3 else np.zeros(4))
        for i, n in enumerate(sizes)
    ]
    jobs[3]["ys"][2] = np.nan
    jobs[5]["xs"] = rng.normal(0, 3, sizes[5])  # not at regular positions
    return jobs


def test_models_fitted_side_by_side_equal_those_fitted_alone(rng, monkeypatch):
    jobs, ascents = _jobs(rng, 40), []
    plain = numerics.maximise
    monkeypatch.setattr(numerics, "maximise", lambda *a, **k: ascents.append(len(a[1])) or plain(*a, **k))
    skip = np.array([False])
    together = models._fit_stack(jobs, skip, 12, 42)
    assert ascents == [39]
    assert together == [models._fit_stack([job], skip, 12, 42)[0] for job in jobs]
    assert [f["status"] for f in together].count("failed") == 1 and together[3]["error"] == "missing values in the training rows"


def test_shared_distances_give_the_same_likelihood(rng):
    x, y = np.arange(30, dtype=float)[:, None], rng.normal(size=30)
    kernel, theta, alpha = (("constant", "periodic"), ("white",)), np.log([[2.0, 1.5, 11.0, 0.3]]), np.array([1e-3])
    few, share = numerics.places(x)
    assert len(few) == 30 + 0 and share is not None
    one = numerics.likelihoods(kernel, theta, few[None], y[None], alpha, numerics.Cells(30, share))
    all_cells = numerics.likelihoods(kernel, theta, numerics.distances(x, x)[np.tril_indices(30)][None], y[None], alpha)
    assert np.allclose(one[0], all_cells[0], rtol=1e-12) and np.allclose(one[1], all_cells[1], rtol=1e-9)


def test_resampling_needs_no_median_per_row(rng, monkeypatch):
    y = rng.gamma(2, 50, 90)
    assert np.allclose(resample.quartiles(y), np.percentile(y, [25, 50, 75]), rtol=0, atol=0)
    calls = []
    plain = np.median
    monkeypatch.setattr(np, "median", lambda *a, **k: calls.append(1) or plain(*a, **k))
    resample.interpolate_rare(np.arange(90.0)[:, None], y, np.random.default_rng(1), 0.3, 1.5, "high", False)
    assert len(calls) <= 1
