import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from conftest import by_series, series_frame
from pyspark.sql import functions as F

from tidemark.functions import detectors
from tidemark.functions.groups import map_sorted_groups
from tidemark.operators import detect
from tidemark.operators.response import respond
from tidemark.spec import OnlineSpec, SeriesSpec

SPEC = SeriesSpec(season=12)


def sdar_loop(x, r, order, density):
    """One value at a time."""
    mu, s, c = 0.0, 0.0, np.zeros(order + 1)
    model, out = None, []
    for t in range(order, len(x)):
        past = x[t - order : t][::-1]
        if density == "before" and model is not None:
            m, a, v = model
            loss_from = (m + a @ (past - m), v)
        mu = (1 - r) * mu + r * x[t]
        for j in range(order + 1):
            other = x[t] if j == 0 else past[j - 1]
            c[j] = (1 - r) * c[j] + r * (x[t] - mu) * (other - mu)
        matrix = np.array([[c[abs(i - j)] for j in range(order)] for i in range(order)])
        a = np.linalg.solve(matrix, c[1:]) if order > 1 else c[1:] / c[0]
        fitted = mu + a @ (past - mu)
        s = (1 - r) * s + r * (x[t] - fitted) ** 2
        if density == "after":
            loss_from = (fitted, s)
        if density == "before" and model is None:
            out.append(0.0)
        else:
            f, v = loss_from
            v = max(v, detectors.MIN_VARIANCE)
            out.append(0.5 * math.log(2 * math.pi * v) + (x[t] - f) ** 2 / (2 * v))
        model = (mu, a.copy(), s)
    return np.array(out)


@pytest.mark.parametrize("order", [1, 2])
@pytest.mark.parametrize("density", ["after", "before"])
def test_sdar_equals_a_loop(rng, order, density):
    x = rng.normal(100, 20, 300)
    got = detectors.sdar_scores(x, 0.3, order, density)
    assert np.allclose(got, sdar_loop(x, 0.3, order, density), rtol=1e-6, atol=1e-6)


def test_ewma_equals_a_loop(rng):
    u, z = rng.normal(size=333), 5.0
    want = []
    for v in u:
        z = 0.9 * z + 0.1 * v
        want.append(z)
    assert np.allclose(detectors.ewma(u, 0.1, 5.0), want)


def test_change_scores_start_when_windows_are_full(rng):
    scores = detectors.change_scores(rng.normal(size=40), 0.4, 1, 4)
    first = 1 + 3 + 1 + 1
    assert (scores[:first] == 0).all() and (scores[first:] != 0).all()


@pytest.mark.parametrize("r", [0.2, 0.5])
def test_blocks_give_the_scores_of_the_whole_series(spark, rng, r):
    y = (1e6 * (2 + np.sin(np.arange(3000) / 6)) + rng.normal(0, 1e5, 3000)).tolist()
    df = series_frame(spark, {"a": y, "b": y[:50]}, freq="h")
    online = OnlineSpec(cf_r=r)
    whole = by_series(detect.change_finder_scores(df, SPEC, online), "score", "dy")
    lookback = 12 + detectors.burn_in_rows(r, 1, 4)
    assert lookback < 1500
    parts = by_series(detect.change_finder_scores(df, replace(SPEC, block_rows=lookback), online, with_scale=True), "score", "scale")
    assert len(parts["a"]["score"]) == 3000
    assert np.allclose(parts["a"]["score"][12:], whole["a"]["score"][12:], rtol=1e-12, atol=1e-12)
    want = detectors.change_scores(np.array(y[12:]) - np.array(y[:-12]), r, 1, 4)
    assert np.allclose(whole["a"]["score"][12:], want, rtol=1e-9)
    assert whole["b"]["score"][:12] == [None] * 12


def test_threshold_and_change_points(spark, rng):
    y = rng.normal(10, 1, 200)
    y[150:] *= 4
    df = series_frame(spark, {"a": y.tolist()}, freq="h").withColumn("n_train", F.lit(120).cast("long"))
    flagged = detect.change_points_by_score(detect.change_finder_scores(df.select("series_id", "t", "y", "n_train"), SPEC, OnlineSpec()), SPEC, 90)
    got = by_series(flagged, "score", "change_point", "threshold")["a"]
    train = got["score"][12:120]
    assert got["threshold"][0] == pytest.approx(np.percentile(train, 90))
    assert got["change_point"] == [t >= 120 and got["score"][t] >= got["threshold"][0] for t in range(200)]
    assert any(got["change_point"][150:156])


def run_lengths_full(z, hazard):
    """All run lengths kept."""
    h = 1 / hazard
    p, mu, kappa, alpha, beta = np.ones(1), np.zeros(1), np.ones(1), np.ones(1), np.ones(1)
    out = []
    for x in z:
        scale2 = beta * (kappa + 1) / (alpha * kappa)
        pdf = np.array([
            math.exp(math.lgamma(a + 0.5) - math.lgamma(a)) / math.sqrt(math.pi * 2 * a * s) * (1 + (x - m) ** 2 / (2 * a * s)) ** (-(2 * a + 1) / 2)
            for a, s, m in zip(alpha, scale2, mu)
        ])
        p = np.concatenate([[(p * pdf).sum() * h], p * pdf * (1 - h)])
        p /= p.sum()
        beta = np.concatenate([[1.0], beta + kappa * (x - mu) ** 2 / (2 * (kappa + 1))])
        mu = np.concatenate([[0.0], (kappa * mu + x) / (kappa + 1)])
        kappa, alpha = np.concatenate([[1.0], kappa + 1]), np.concatenate([[1.0], alpha + 0.5])
        out.append(int(p.argmax()))
    return out


def test_run_lengths_equal_the_unpruned_posterior(rng):
    z = np.concatenate([rng.normal(0, 1, 150), rng.normal(4, 1, 100), rng.normal(-3, 0.3, 80)])
    state = detectors.RunLengths(24)
    assert [state.update(v) for v in z] == run_lengths_full(z, 24)


def test_gamma_step_beyond_the_table():
    a = np.array([1.0, 1.5, 1999.5, 3000.0, 1e5])
    want = [math.lgamma(v + 0.5) - math.lgamma(v) for v in a]
    assert np.allclose(detectors._gamma_step(a), want, rtol=1e-9)


def test_run_length_change_points_equal_a_loop(spark, rng):
    y = rng.normal(10, 1, 150)
    y[110:] += 8
    df = series_frame(spark, {"a": y.tolist(), "b": y[::-1].tolist()}, freq="h").withColumn("n_train", F.lit(90).cast("long"))
    got = by_series(detect.run_length_change_points(df, SPEC, OnlineSpec(cpd="bocd")), "t", "run_length", "change_point")
    for key, v in (("a", y), ("b", y[::-1])):
        d = v[12:] - v[:-12]
        train = d[: 90 - 12]
        z = [(x - train.mean()) / train.std() for x in train]
        z += [(d[i] - d[:i].mean()) / d[:i].std() for i in range(78, len(d))]
        runs = run_lengths_full(z, 24)
        assert got[key]["run_length"] == runs
        want = [12 + i > 90 and runs[i] < runs[i - 1] for i in range(len(d))]
        assert got[key]["change_point"] == want
    assert any(got["a"]["change_point"])


def test_groups_cross_batches():
    frame = pd.DataFrame({"k": ["a"] * 5 + ["b"] * 2 + ["c"] * 9, "j": [1] * 4 + [2] * 3 + [1] * 9, "v": range(16)})
    for width in (1, 2, 3, 7, 16):
        batches = [frame.iloc[i : i + width] for i in range(0, 16, width)]
        out = pd.concat(map_sorted_groups(iter(batches), ["k", "j"], lambda g: g[["k", "j"]].iloc[:1].assign(n=len(g), s=g["v"].sum())))
        want = frame.groupby(["k", "j"])["v"].agg(["size", "sum"]).reset_index()
        assert out.values.tolist() == want.values.tolist()


def response_loop(scale, flags, thr):
    old, refit, rows = 1.0, -1, []
    for t, (s, flag) in enumerate(zip(scale, flags)):
        rows.append((old, refit))
        if flag and s is not None and s != 0 and math.isfinite(s) and old > 0 and abs(s - old) / old > thr:
            old, refit = s, t
    return rows


@pytest.mark.parametrize("block_rows", [65_536, 50, 7])
@pytest.mark.parametrize("thr", [0.05, 0.3, 2.0])
def test_response_equals_a_loop(spark, rng, block_rows, thr):
    rows, want = [], {}
    for key in range(12):
        n = 300
        scale = np.exp(rng.normal(0, [0.02, 0.3, 1.0][key % 3], n).cumsum() if key % 2 else rng.normal(0, 0.4, n)).tolist()
        flags = (rng.random(n) < [0.1, 0.5, 1.0][key % 3]).tolist()
        for i in rng.choice(n, 10, replace=False):
            scale[i] = [None, 0.0, float("inf"), None][i % 4]
        if key == 5:
            scale[200] = -0.5
            flags[200] = True
        rows += [(str(key), t, s, f) for t, (s, f) in enumerate(zip(scale, flags))]
        want[str(key)] = response_loop(scale, flags, thr)
    df = spark.createDataFrame(rows, "series_id string, t long, scale double, change_point boolean").repartition(5)
    out = respond(df, replace(SPEC, block_rows=block_rows), thr)
    got = by_series(out, "scale_old", "refit_t", "triggered", "reason")
    for key, states in want.items():
        assert got[key]["refit_t"] == [r for _, r in states], key
        assert got[key]["scale_old"] == [o for o, _ in states]
        fired = {r for _, r in states if r >= 0}
        assert {t for t, f in enumerate(got[key]["triggered"]) if f} >= fired
    assert {r for v in got.values() for r in v["reason"]} >= {None, "no scale", "unusable scale", "below threshold"}


def test_settings_per_row(spark, rng):
    """A list of settings gives what each setting gives alone."""
    y = (10 + rng.normal(0, 1, 120)).tolist()
    settings = [OnlineSpec(cf_r=0.2, cf_smooth=3, scale_window=2, cf_thr_perc=70), OnlineSpec(cf_r=0.5, cf_smooth=6, scale_window=4, scale_seasons=1, cf_thr_perc=90)]
    df = series_frame(spark, {"a": y}, freq="h").withColumn("n_train", F.lit(80).cast("long")).select("series_id", "t", "y", "n_train")
    keyed = df.withColumn("param_id", F.explode(F.lit([0, 1])))
    spec = SPEC.with_keys("param_id")
    scores = detect.change_finder_scores(keyed, spec, settings, with_scale=True)
    together = detect.change_points_by_score(scores, spec, [70, 90])
    for i, o in enumerate(settings):
        alone = detect.change_points_by_score(detect.change_finder_scores(df, SPEC, o, with_scale=True), SPEC, o.cf_thr_perc)
        a = by_series(alone, "score", "scale", "change_point", "threshold")
        b = by_series(together.where(F.col("param_id") == i), "score", "scale", "change_point", "threshold")
        assert a == b


def test_missing_values_do_not_spread(rng):
    x = rng.normal(size=200)
    whole = detectors.change_scores(x[:120], 0.4, 1, 4)
    gaps = x.copy()
    gaps[[30, 31, 130]] = np.nan
    scores = detectors.change_scores(gaps, 0.4, 1, 4)
    assert np.array_equal(np.flatnonzero(np.isnan(scores)), [30, 31, 130])
    assert np.allclose(scores[:30], whole[:30])
    later = gaps.copy()
    later[150:] = np.nan
    assert np.allclose(detectors.change_scores(later, 0.4, 1, 4)[:150], scores[:150], equal_nan=True)


def test_base_fit_uses_all_train_rows(spark):
    from tidemark.plans.online import base_jobs
    from tidemark.spec import GPSpec

    rows = [("a", t, [float(t)], float(t % 12), 400) for t in range(450)]
    series = spark.createDataFrame(rows, "series_id string, t long, x array<double>, y double, n_train long")
    jobs = base_jobs(series, ["series_id"], GPSpec(kernel=(("white",),)), None).collect()
    assert len(jobs[0].ys) == 400
