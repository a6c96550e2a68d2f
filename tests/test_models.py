import math

import numpy as np
import pytest
from conftest import by_series, series_frame
from pyspark.sql import functions as F

from tidemark.functions import gp
from tidemark.functions.resample import interpolate_rare, noise_copies, relevance
from tidemark.plans import models, online, scenario, search
from tidemark.session import new_table_path
from tidemark.spec import GPSpec, OnlineSpec, SeriesSpec
from tidemark.streaming import online as streaming

SPEC = SeriesSpec(season=12)
KERNELS = [k for k in search.kernel_grid()]


@pytest.mark.parametrize("kernel", KERNELS[::9], ids=str)
def test_gradient_equals_differences(rng, kernel):
    x, y = rng.uniform(0, 20, (25, 1)), rng.normal(size=25)
    d = gp.distances(x, x)
    theta, _ = gp.parameters(kernel, 12)
    theta = theta + rng.normal(0, 0.1, len(theta))
    if kernel[0][0] == "constant":
        theta[0] -= 5.0
    _, g = gp.log_likelihood(kernel, theta, d, y, 0.1)
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        up, down = (gp.log_likelihood(kernel, theta + s, d, y, 0.1)[0] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-3)


def test_posterior_of_three_points():
    x, y, new = np.array([[0.0], [1.0], [3.0]]), np.array([1.0, 2.0, 0.5]), np.array([[0.5], [2.0]])
    kernel, theta = (("rbf",),), np.log([1.5])
    k = lambda a, b: np.exp(-((a - b.T) ** 2) / (2 * 1.5**2))
    inverse = np.linalg.inv(k(x, x) + 0.2 * np.eye(3))
    mean, std = gp.predict(kernel, theta, x, y, 0.2, False, new)
    assert np.allclose(mean, k(new, x) @ inverse @ y)
    assert np.allclose(std**2, 1 - np.diag(k(new, x) @ inverse @ k(x, new)))
    value, _ = gp.log_likelihood(kernel, theta, gp.distances(x, x), y, 0.2)
    assert value == pytest.approx(-0.5 * y @ inverse @ y + 0.5 * np.log(np.linalg.det(inverse)) - 1.5 * np.log(2 * np.pi))


def test_fit_finds_the_length_scale(rng):
    x = np.sort(rng.uniform(0, 30, (120, 1)), axis=0)
    truth = np.exp(-((x - x.T) ** 2) / (2 * 2.0**2)) + 0.05 * np.eye(120)
    y = np.linalg.cholesky(truth) @ rng.normal(size=120)
    found = gp.fit((("rbf",),), x, y, 0.05, False, restarts=2)
    assert math.exp(found.theta[0]) == pytest.approx(2.0, rel=0.25)
    _, bounds = gp.parameters((("rbf",),), None)
    grid = [gp.log_likelihood((("rbf",),), np.array([t]), gp.distances(x, x), y, 0.05)[0] for t in np.linspace(*bounds[0], 100)]
    assert found.likelihood >= max(grid) - 1e-3


def test_kernel_grid_and_sample():
    assert len(KERNELS) == len(set(KERNELS)) == 136
    assert search.grid_size() == 19_584
    sample = search.sample_configs(0.1)
    assert len(sample) == len({c["config_id"] for c in sample}) == 1_958
    assert [search.config(i) for i in (0, 1)] == [search.config(0), search.config(0) | {"config_id": 1, "normalize_y": True}]


def seasonal(spark, n=96, keys=("a", "b"), noise=0.02, seed=3, factor=None):
    rng = np.random.default_rng(seed)
    values = {}
    for k in keys:
        y = (3 + np.sin(2 * np.pi * np.arange(n) / 12)) * (1 + noise * rng.normal(size=n))
        values[k] = (y * (1 if factor is None else factor)).tolist()
    df = series_frame(spark, values, freq="MS")
    return df.withColumn("x", F.array((F.col("t") % 12) / 12 * 2 * math.pi)).withColumn("n_train", F.lit(60).cast("long"))


GP = GPSpec(alpha=0.1)
ONLINE = OnlineSpec(cf_thr_perc=70)


def test_standardised_fit_and_predict_per_series(spark):
    series = seasonal(spark)
    spec = GPSpec(kernel=(("periodic",), ("white",)), alpha=1e-6, standardize=True)
    fitted = models.fit(online.base_jobs(series, ["series_id"], spec, 60), spec)
    rows = models.predict(series.select("series_id", "t", "x"), fitted, ["series_id"]).join(series, ["series_id", "t"]).collect()
    assert len(rows) == 192
    error = np.sqrt(np.mean([(r.prediction - r.y) ** 2 for r in rows]))
    assert error < 0.15
    inside = np.mean([r.lower_conf <= r.y <= r.upper_conf for r in rows])
    assert inside > 0.9


def test_failing_job_gives_a_row(spark):
    jobs = spark.createDataFrame([("good", [0.0, 1.0, 2.0], [1.0, 2.0, 3.0]), ("bad", [0.0, 1.0], [1.0, float("nan")]), ("none", [], [])],
                                 "series_id string, xs array<double>, ys array<double>")
    got = {r.series_id: r for r in models.fit(models.with_settings(jobs, GP), GP).collect()}
    assert got["good"].status == "ok" and got["good"].error is None
    assert got["bad"].status == got["none"].status == "failed" and "missing" in got["bad"].error


def ramp(n=96, start=72):
    factor = np.ones(n)
    factor[start:] = 2.0
    return factor


def test_online_response_beats_the_base_model_after_a_shift(spark):
    series = seasonal(spark, factor=ramp())
    run = online.run_online(series, SPEC, ONLINE, GP, rivals=True)
    stats = {(r.series_id, r.model): r for r in online.run_statistics(run, series, SPEC).collect()}
    for key in ("a", "b"):
        assert stats[key, "online"].n_refits >= 1 == stats[key, "online"].n_refits / stats[key, "online"].n_refit_ok
        assert stats[key, "online"].rmse < 0.8 * stats[key, "base"].rmse
    assert {m for _, m in stats} == {"online", "base", "cpd_retrain", "cpd_moving_window", "cpd_scaled"}
    counts = run.predictions.groupBy("series_id", "model").count().collect()
    assert {r["count"] for r in counts} == {36}


def test_other_series_and_row_order_change_nothing(spark):
    one = online.run_online(seasonal(spark, keys=("a",), factor=ramp()), SPEC, ONLINE, GP)
    more = seasonal(spark, keys=("a", "b", "c"), factor=ramp()).repartition(7)
    many = online.run_online(more, SPEC, ONLINE, GP)
    a = by_series(one.predictions.where("model = 'online'"), "prediction", "upper_conf")["a"]
    b = by_series(many.predictions.where("model = 'online'"), "prediction", "upper_conf")["a"]
    assert np.allclose(a["prediction"], b["prediction"]) and np.allclose(a["upper_conf"], b["upper_conf"])


def online_loop(y, x, n_train, setting, gp_spec):
    """The response as a walk through time for one series."""
    from tidemark.functions.detectors import change_scores

    o = setting.resolved(12)
    kernel, period = gp_spec.kernel, gp_spec.period
    scores = change_scores(y[12:] - y[:-12], o.cf_r, o.cf_order, o.cf_smooth)
    threshold = np.percentile(scores[: n_train - 12], o.cf_thr_perc)
    first = slice(max(0, n_train - o.max_samples), n_train)
    base = gp.fit(kernel, x[first], y[first], gp_spec.alpha, gp_spec.normalize_y, period=period)
    current, data, old, out = base.theta, (x[first], y[first]), 1.0, []
    for t in range(n_train, len(y)):
        mean, _ = gp.predict(kernel, current, *data, gp_spec.alpha, gp_spec.normalize_y, x[t : t + 1])
        out.append((mean[0], old))
        if scores[t - 12] < threshold or t < 24 + o.scale_window - 1:
            continue
        level = lambda back: y[t - back - o.scale_window + 1 : t - back + 1].mean()
        scale = np.mean([level(0) / level(12), level(0) / level(24)])
        if abs(scale - old) / old > o.scale_thr:
            part = slice(max(0, t + 1 - o.max_samples), t + 1)
            data = (x[part], y[part] * scale)
            current, old = gp.fit(kernel, *data, gp_spec.alpha, gp_spec.normalize_y, theta0=base.theta, period=period).theta, scale
    return out


def test_batch_plan_equals_a_walk_through_time(spark):
    series = seasonal(spark, factor=ramp())
    spec = GPSpec(kernel=(("constant", "periodic"), ("white",)), period=12, alpha=1e-3)
    run = online.run_online(series, SPEC, ONLINE, spec)
    got = by_series(run.predictions.where("model = 'online'"), "prediction")
    olds = by_series(run.states, "scale_old")
    data = by_series(series, "y", "x")
    for key in ("a", "b"):
        want = online_loop(np.array(data[key]["y"]), np.array(data[key]["x"]), 60, ONLINE, spec)
        assert np.allclose(olds[key]["scale_old"], [o for _, o in want])
        assert np.allclose(got[key]["prediction"], [p for p, _ in want], rtol=1e-6)
        assert len({o for _, o in want}) > 1


def test_stream_equals_batch_and_marks_late_rows(spark):
    series = seasonal(spark, factor=ramp())
    run = online.run_online(series, SPEC, ONLINE, GP)
    source, out, marks = (new_table_path(spark, n) for n in ("in", "out", "marks"))
    series.limit(0).write.parquet(source)
    rows = spark.readStream.schema(series.schema).parquet(source)

    def feed(part):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = streaming.online_stream(rows, SPEC, ONLINE, GP, n_train=60, reorder_rows=12)
        streaming.run_available(stream, out, marks)

    feed(series.where("t < 70"))
    feed(series.where("t between 72 and 80"))  # a gap of two rows, filled by the next part
    feed(series.where("t between 70 and 71 or t > 80"))
    feed(series.where("t = 65"))
    got = spark.read.parquet(out)
    assert got.where("late").count() == 2
    fresh = by_series(got.where("not late and t >= 60"), "t", "prediction", "lower_conf", "triggered", "scale_old")
    batch = by_series(run.predictions.where("model = 'online'").join(run.states, ["series_id", "t"]), "t", "prediction", "lower_conf", "triggered", "scale_old")
    for key in ("a", "b"):
        assert fresh[key]["t"] == batch[key]["t"] and fresh[key]["triggered"] == batch[key]["triggered"]
        for c in ("prediction", "lower_conf", "scale_old"):
            assert np.allclose(fresh[key][c], batch[key][c], rtol=1e-8)
    assert any(fresh["a"]["triggered"])


def test_periodic_and_moving_window_refits(spark):
    series = seasonal(spark, n=70, keys=("a",))
    data = by_series(series, "y", "x")["a"]
    y, x = np.array(data["y"]), np.array(data["x"])
    kernel = GP.kernel

    def one(t, first, last):
        f = gp.fit(kernel, x[first:last], y[first:last], GP.alpha, True)
        return gp.predict(kernel, f.theta, x[first:last], y[first:last], GP.alpha, True, x[t : t + 1])[0][0]

    got = by_series(online.periodic_refits(series, SPEC, GP, 3, cap=1000), "prediction")["a"]["prediction"]
    assert np.allclose(got, [one(t, 0, 60 + (t - 60) // 3 * 3) for t in range(60, 70)])
    got = by_series(online.moving_window_refits(series, SPEC, GP, cap=1000), "prediction")["a"]["prediction"]
    bias, want = 0.0, []
    for t in range(60, 70):
        want.append(one(t, t - 60, t) + bias)
        bias = 0.8 * (y[t] - want[-1]) + 0.2 * bias
    assert np.allclose(got, want)


@pytest.mark.parametrize("da", ["smogn", "gn"])
def test_rebalanced_refits(spark, da):
    series = seasonal(spark, factor=ramp())
    run = online.run_online(series, SPEC, OnlineSpec(da=da, append="before", cf_thr_perc=70, o_perc=2.0, u_perc=0.8), GP)
    assert run.models.where("status <> 'ok'").count() == 0 < run.models.count()
    sizes = [len(r.ys) for r in run.models.collect()]
    assert min(sizes) > 20


def test_rebalancing_of_one_sample(rng):
    x, y = rng.normal(size=(100, 2)), np.concatenate([rng.normal(0, 1, 90), rng.normal(9, 0.1, 10)])
    assert relevance(y, 1.5, "high")[90:].min() == 1 and relevance(y, 1.5, "low")[90:].max() == 0
    nx, ny = interpolate_rare(x, y, np.random.default_rng(1), 0.9, 1.5, "high", False)
    assert len(ny) == len(nx) > 100 and (ny > 8).sum() > 60
    nx, ny = noise_copies(x, y, np.random.default_rng(1), 0.9, 3.0, 0.5)
    assert (ny > 8).sum() == 40 and len(ny) < 100


@pytest.mark.parametrize("season, feasible", [(20, 22), (50, 22), (100, 23)])
def test_scenarios(spark, season, feasible):
    cells = scenario.scenarios(season)
    assert len(cells) == 23 and len({c["name"] for c in cells}) == 23
    df = spark.createDataFrame([(c["start_off"], c["end_off"], c["slope"], c["max_factor"]) for c in cells], "s long, e long, k double, f double")
    start = 3 * season
    ok = scenario.ramp_feasible(F.col("s") + start, F.col("e") + start, F.col("f"), F.col("k"))
    assert df.where(ok).count() == feasible


@pytest.mark.parametrize("factors, counts", [((0.5, 5.0, 0.5), (77, 13, 10)), ((0.4, 3.0, 0.2), (92, 38, 10))])
def test_heat_map_cells(spark, factors, counts):
    spec = SeriesSpec(season=50)
    series = spark.createDataFrame([("a", 150)], "series_id string, n_train long")
    start, end = F.col("n_train") + F.col("start_off"), F.col("n_train") + F.col("end_off")
    ok = scenario.ramp_feasible(start, end, F.col("max_factor"), F.col("slope"))
    kind = F.when(F.round(F.col("max_factor") - 1, 3) == 0, "no-op").when(ok, "run").otherwise("infeasible")
    got = {r.kind: r["count"] for r in scenario.shape_cells(series, spec, factors).groupBy(kind.alias("kind")).count().collect()}
    assert (got["run"], got["infeasible"], got["no-op"]) == counts


@pytest.mark.parametrize("slope, factor, step, shortest", [(0.2, 2.0, 10, 1), (0.4, 3.0, None, 1), (0.1, 2.5, 5, 40), (0.2, 1.0, 25, 30)])
def test_position_cells(spark, slope, factor, step, shortest):
    series = series_frame(spark, {"a": [1.0] * 250, "b": [1.0] * 150}).withColumn("n_train", F.lit(150).cast("long"))
    cells = scenario.position_cells(series, SeriesSpec(season=50), slope, factor, step, shortest)
    by, climb = step or 10, math.floor(round(abs(factor - 1), 3) / slope + 1e-9)
    want = {(s, e) for s in range(0, 101, by) for e in range(s + by, 101, by) if e - s >= max(shortest, 2 * climb)}
    found = [(r.start_off, r.end_off) for r in cells.where("t = 0").collect()]
    assert len(found) == len(set(found)) and set(found) == want and cells.where("series_id = 'b'").count() == 0


def test_draws():
    for da in ("scaled", "smogn", "gn"):
        draws = scenario.draw_settings(30, da)
        assert len(draws) == 30 and draws == scenario.draw_settings(30, da)
    assert len(scenario.draw_settings(100, "scaled", "bocd")) == 100


def test_scenario_run_equals_a_single_run(spark):
    series = seasonal(spark, keys=("a",))
    settings = [OnlineSpec(cf_thr_perc=70, scale_window=2), OnlineSpec(cf_thr_perc=80, scale_window=3, scale_seasons=1)]
    cells = series.withColumn("scenario_id", F.lit(4)).withColumns(
        {"start_off": F.lit(2).cast("long"), "end_off": F.lit(30).cast("long"), "slope": F.lit(0.25), "max_factor": F.lit(2.0)}
    ).unionByName(series.withColumn("scenario_id", F.lit(5)).withColumns(
        {"start_off": F.lit(2).cast("long"), "end_off": F.lit(6).cast("long"), "slope": F.lit(0.1), "max_factor": F.lit(2.0)}))
    got = {(r.scenario_id, r.param_id): r for r in scenario.run_scenarios(series, cells, SPEC, settings, GP).collect()}
    assert got[5, 0].status == got[5, 1].status == "infeasible" and got[5, 0].rmse is None
    injected = scenario.inject(cells.where("scenario_id = 4")).select(*series.columns)
    for i, setting in enumerate(settings):
        run = online.run_online(injected, SPEC, setting, GP, base_series=series)
        stats = {r.model: r for r in online.run_statistics(run, injected, SPEC).collect()}
        assert got[4, i].rmse == pytest.approx(stats["online"].rmse) and got[4, i].rmse_base == pytest.approx(stats["base"].rmse)
        assert (got[4, i].n_cps, got[4, i].n_refits) == (stats["online"].n_cps, stats["online"].n_refits)
        assert got[4, i].rmse_ratio < 1


def test_search_job(spark):
    series = seasonal(spark, keys=("a", "b"))
    rows = series.withColumn("fold", F.lit(0)).withColumn("split", F.when(F.col("t") < 60, "train").otherwise("test"))
    configs = [search.config(i) | {"dim_reduction": "none", "n_restarts": 0} for i in (4, 200, 3000)]
    out = search.run_search({"none": rows}, SPEC, configs, {"none": ["x"]}, period=12)
    got = out.collect()
    assert len(got) == 6 and {r.status for r in got} == {"ok"}
    assert all(len(r.shuf_cv_rmse) == 5 and r.shuf_cv_rmse_mean == pytest.approx(np.mean(r.shuf_cv_rmse)) for r in got)
    best = search.best_config(out, ["series_id"]).collect()
    for r in best:
        assert r.shuf_cv_rmse_mean == min(g.shuf_cv_rmse_mean for g in got if g.series_id == r.series_id)


def test_invalid_settings_are_refused():
    for bad in (dict(cpd="x"), dict(da="x"), dict(scale_seasons=3), dict(scale_of="x")):
        with pytest.raises(ValueError):
            OnlineSpec(**bad)
    with pytest.raises(ValueError):
        SeriesSpec(step="fortnight")
