import numpy as np
import pytest
from conftest import by_series, close, series_frame
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import baselines, impute, metrics, splits, transforms
from tidemark.operators.quantiles import exact_quantile
from tidemark.spec import SeriesSpec

SPEC = SeriesSpec(season=12)


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.7, 0.9, 0.95, 1.0])
def test_exact_quantile(spark, rng, p):
    groups = {
        "one": [3.0], "two": [1.0, 9.0], "four": [4.0, 1.0, 3.0, 2.0], "ties": [0.0] * 50 + [1.0] * 3,
        "many": rng.lognormal(0, 3, 30_000).tolist(), "null": [1.0, None, 2.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r.q for r in exact_quantile(df, ["k"], "v", p, "q").collect()}
    for k, vs in groups.items():
        want = np.percentile([v for v in vs if v is not None], p * 100)
        assert got[k] == pytest.approx(want, rel=1e-12, abs=1e-12), k


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=40), st.sampled_from([0.05, 0.25, 0.5, 0.66, 0.9]))
def test_exact_quantile_of_any_small_list(spark, values, p):
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    assert exact_quantile(df, ["k"], "v", p, "q").first().q == pytest.approx(np.percentile(values, p * 100))


def test_percentage_and_expanding_split(spark):
    df = series_frame(spark, {"a": [1.0] * 10, "b": [1.0] * 3}, freq="MS")
    pct = by_series(splits.split(df, SPEC, 0.75), "split", "n_train")
    assert pct["a"]["split"] == ["train"] * 7 + ["test"] * 3 and pct["b"]["n_train"] == [2, 2, 2]
    rows = splits.split(df, SPEC, None, 4, 3).collect()
    seen = sorted((r.series_id, r.fold, r.split, r.t) for r in rows)
    want = []
    for key, n in (("a", 10), ("b", 3)):
        cut = 4
        for fold in range(-(-n // 7)):
            want += [(key, fold, "train", t) for t in range(min(cut, n))]
            want += [(key, fold, "test", t) for t in range(cut, min(cut + 3, n))]
            cut += 3
    assert seen == sorted(want)


def test_shuffled_split(spark):
    df = series_frame(spark, {"a": [1.0] * 101, "b": [1.0] * 30, "small": [1.0] * 29}, freq="MS")
    out = splits.split_shuffled(df, SPEC)
    counts = {(r.series_id, r.fold): r.n for r in out.where("split = 'test'").groupBy("series_id", "fold").agg(F.count("*").alias("n")).collect()}
    assert counts == {("a", f): 21 for f in range(5)} | {("b", f): 6 for f in range(5)}
    again = splits.split_shuffled(df.repartition(3), SPEC)
    assert out.exceptAll(again).count() == 0
    tests = {f: sorted(r.t for r in out.where(f"series_id = 'a' and fold = {f} and split = 'test'").collect()) for f in range(5)}
    assert len({tuple(v) for v in tests.values()}) == 5


def test_smallest_by_hash_equals_a_sort(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    h = F.xxhash64("t")
    got = {r.t for r in splits.smallest_by_hash(df, ["k"], F.lit(777), h, "hit").where("hit").collect()}
    want = {r.t for r in df.orderBy(F.shiftrightunsigned(h, 54), F.shiftrightunsigned(h, 1)).limit(777).collect()}
    assert got == want


def baseline_loop(y, n_train, lag, one_step):
    if one_step:
        return [None] * min(lag, len(y)) + y[:-lag] if lag < len(y) else [None] * len(y)
    last = y[:n_train][-lag:]
    shifted = ([None] * lag + y)[: len(y)]
    return shifted[:n_train] + [last[i % len(last)] for i in range(len(y) - n_train)]


@pytest.mark.parametrize("lag", [1, 12])
@pytest.mark.parametrize("one_step", [False, True])
def test_random_walk(spark, rng, lag, one_step):
    values = {"a": rng.normal(size=50).tolist(), "b": rng.normal(size=9).tolist()}
    df = splits.split_percentage(series_frame(spark, values, freq="MS"), SPEC, 0.6)
    got = by_series(baselines.random_walk(df, SPEC, lag, one_step), "prediction")
    for key, y in values.items():
        assert close(got[key]["prediction"], baseline_loop(y, int(len(y) * 0.6), lag, one_step)), key


def test_historical_average_and_rmse(spark, rng):
    y = rng.normal(size=20).tolist()
    df = splits.split_percentage(series_frame(spark, {"a": y}, freq="MS"), SPEC, 0.5)
    got = by_series(baselines.historical_average(df, SPEC, one_step=True), "prediction")["a"]["prediction"]
    assert close(got, [np.mean(y[:10])] * 10 + [np.mean(y[:i]) for i in range(10, 20)])
    errors = metrics.rmse(baselines.all_baselines(df, SPEC).where("split = 'test'"), ["model"]).collect()
    want = np.sqrt(np.mean((np.mean(y[:10]) - np.array(y[10:])) ** 2))
    assert {r.model: r.rmse for r in errors}["hist_avg"] == pytest.approx(want)


def test_rmse_with_missing_values_has_status(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, None), ("b", 1.0, 3.0)], "k string, y double, prediction double")
    got = {r.k: (r.rmse, r.status) for r in metrics.rmse(df, ["k"]).collect()}
    assert got == {"a": (None, "nan"), "b": (2.0, "ok")}


def holes(spark, rng, n=160):
    x = rng.normal(20, 5, n)
    table = np.stack([x, 2 * x + rng.normal(0, 0.5, n), 50 - x + rng.normal(0, 0.5, n)], axis=1)
    full = table.copy()
    table[rng.random(table.shape) < 0.2] = np.nan
    rows = [(k, i, *[None if np.isnan(v) else float(v) for v in row]) for k in ("a", "b") for i, row in enumerate(table)]
    df = spark.createDataFrame(rows, "series_id string, t long, p double, q double, r double")
    return df.withColumn("split", F.when(F.col("t") < 120, "train").otherwise("test")), table, full


def knn_brute(table, n_train, k):
    out = table.copy()
    d = table.shape[1]
    for i, row in enumerate(table):
        for c in np.flatnonzero(np.isnan(row)):
            found = []
            for j in range(n_train):
                both = ~np.isnan(row) & ~np.isnan(table[j])
                if not np.isnan(table[j, c]) and both.any():
                    found.append((((row - table[j])[both] ** 2).sum() * d / both.sum(), j))
            best = [table[j, c] for _, j in sorted(found)[:k]]
            out[i, c] = np.mean(best) if best else np.nanmean(table[:n_train, c])
    return out


def test_knn_imputation_equals_brute_force(spark, rng):
    df, table, _ = holes(spark, rng)
    want = knn_brute(table, 120, 10)
    for key in ("a", "b"):
        rows = impute.impute_knn(df, ["series_id"], ["p", "q", "r"]).where(F.col("series_id") == key).orderBy("t").collect()
        assert np.allclose([[r.p, r.q, r.r] for r in rows], want, atol=1e-9)


def test_simple_imputation(spark, rng):
    df, table, _ = holes(spark, rng)
    for method, statistic in (("mean", np.nanmean), ("median", np.nanmedian)):
        rows = impute.impute(df, ["series_id"], ["p", "q", "r"], method).where("series_id = 'a'").orderBy("t").collect()
        want = np.where(np.isnan(table), statistic(table[:120], axis=0), table)
        assert np.allclose([[r.p, r.q, r.r] for r in rows], want)


def test_columns_complete_in_train_stay_as_they_are(spark):
    df = spark.createDataFrame([("a", 0, 1.0, "train"), ("a", 1, 2.0, "train"), ("a", 2, None, "test")], "series_id string, t long, p double, split string")
    assert impute.impute_mean(df, ["series_id"], ["p"]).where("p is null").count() == 1


def test_iterative_imputation_recovers_linear_relations(spark, rng):
    df, table, full = holes(spark, rng)
    rows = impute.impute_iterative(df, ["series_id"], ["p", "q", "r"], sample=False).where("series_id = 'a'").orderBy("t").collect()
    got = np.array([[r.p, r.q, r.r] for r in rows])
    known = ~np.isnan(table)
    assert np.allclose(got[known], table[known])
    one_missing = (~known).sum(axis=1) == 1
    lost = ~known & one_missing[:, None]
    assert np.abs(got[lost] - full[lost]).max() < 3
    drawn = impute.impute_iterative(df, ["series_id"], ["p", "q", "r"]).where("series_id = 'a'").orderBy("t").collect()
    assert np.array([[r.p, r.q, r.r] for r in drawn]).min() >= 0


def test_power_transform_maximises_the_likelihood(spark, rng):
    values = {"a": rng.lognormal(1, 0.6, 200).tolist(), "b": (-rng.lognormal(0.5, 0.5, 150)).tolist()}
    df = series_frame(spark, values, freq="D")
    fitted = {r.series_id: r for r in transforms.power_fit(df, ["series_id"]).collect()}

    def yj(y, lam):
        power = np.where(y >= 0, lam, 2 - lam)
        return np.sign(y) * np.expm1(power * np.log1p(np.abs(y))) / power

    for key, y in values.items():
        y = np.array(y)
        grid = np.arange(-2, 4, 0.001) + 1e-7
        score = [-len(y) / 2 * np.log(np.var(yj(y, g))) + (g - 1) * (np.sign(y) * np.log1p(np.abs(y))).sum() for g in grid]
        assert fitted[key]["lambda"] == pytest.approx(grid[int(np.argmax(score))], abs=2e-3)
    out = transforms.power_transform(df, ["series_id"], transforms.power_fit(df, ["series_id"]))
    back = by_series(transforms.power_inverse(out, ["y"]), "y")
    z = by_series(out, "y")
    for key, y in values.items():
        assert close(back[key]["y"], y, 1e-7)
        assert np.mean(z[key]["y"]) == pytest.approx(0, abs=1e-9) and np.std(z[key]["y"]) == pytest.approx(1)


def test_log_transform(spark):
    df = series_frame(spark, {"a": [0.0, 1.0], "b": [1.0, 2.0]})
    out = transforms.log_transform(df, ["series_id"])
    got = by_series(out, "y")
    assert close(got["a"]["y"], np.log1p([0, 1])) and close(got["b"]["y"], np.log([1, 2]))
    assert close(by_series(transforms.log_inverse(out, ["y"]), "y")["a"]["y"], [0, 1])
    with pytest.raises(Exception, match="negative"):
        transforms.log_transform(series_frame(spark, {"a": [-1.0]}), ["series_id"]).collect()


def test_standardize_uses_train_and_leaves_holidays(spark):
    df = series_frame(spark, {"a": [1.0, 2.0, 3.0, 9.0]}).withColumn("split", F.when(F.col("t") < 3, "train").otherwise("test"))
    df = df.withColumn("public_x", F.lit(5.0)).withColumn("flat", F.lit(4.0))
    rows = transforms.standardize(df, ["series_id"], ["y", "public_x", "flat"]).orderBy("t").collect()
    assert [(r.y, r.public_x, r.flat) for r in rows] == [(-1.0, 5.0, 0.0), (0.0, 5.0, 0.0), (1.0, 5.0, 0.0), (7.0, 5.0, 0.0)]


def test_pca_equals_numpy(spark, rng):
    base = rng.normal(size=(80, 2))
    x = np.concatenate([base, base @ rng.normal(size=(2, 2)) + 0.05 * rng.normal(size=(80, 2))], axis=1)
    rows = [("a", i, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, t long, a double, b double, c double, d double")
    fitted = transforms.pca_fit(df, ["series_id"], list("abcd"))
    got = transforms.pca_transform(df, ["series_id"], fitted, list("abcd")).orderBy("t").collect()
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int(np.argmax(np.cumsum(values) / values.sum() > 0.95)) + 1
    assert fitted.first().loadings is not None and len(fitted.first().explained) == k
    for i in range(k):
        v = vectors[:, i] * np.sign(vectors[np.abs(vectors[:, i]).argmax(), i])
        assert np.allclose([r[f"PC{i}"] for r in got], z @ v, atol=1e-8)
    assert got[0][f"PC{k}"] is None if k < 4 else True


def ramp_loop(n, start, end, top, slope):
    """Row by row: climb, hold, come back."""
    a = abs(round(top - 1, 3))
    if a == 0:
        return [1.0] * n
    down, full = int(end - a / slope), int(start + a / slope)
    if full > down or a < slope:
        return None
    signed, factor, out = (slope if top > 1 else -slope), 1.0, [1.0] * n
    for i in range(start, end):
        if i <= full:
            factor += signed
            factor = min(factor, top) if signed > 0 else max(factor, top)
        if i >= down:
            factor -= signed
            factor = max(factor, 1.0) if top > 1 else min(factor, 1.0)
        out[i] = factor
    return out


def test_ramp_equals_a_row_loop(spark):
    cases = [(s, e, round(0.4 + 0.2 * f, 2), round(0.05 + 0.15 * k, 2)) for s in (0, 3, 20) for e in (15, 37, 60) for f in range(11) for k in range(5)]
    cells = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id long, s long, e long, f double, k double")
    a = (F.col("s"), F.col("e"), F.col("f"), F.col("k"))
    rows = cells.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(69)))).select(
        "id", "t", transforms.ramp_feasible(*a).alias("ok"), transforms.ramp_factor(F.col("t"), *a).alias("v")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, [r.ok, [None] * 70])[1][r.t] = r.v
    checked = 0
    for i, case in enumerate(cases):
        want = ramp_loop(70, *case)
        assert got[i][0] == (want is not None), case
        if want is not None:
            assert np.allclose(got[i][1], want, atol=1e-9), case
            checked += 1
    assert checked > 150


def test_run_summary_is_per_group_and_overall(spark, rng):
    rows = [(p, s, k, float(rng.uniform(1, 2)), float(rng.uniform(1, 2)), 1, 2) for p in range(2) for s in (20, 50) for k in range(5)]
    runs = spark.createDataFrame(rows, "param_id int, season int, scenario_id int, rmse double, rmse_base double, n_cps long, n_refits long")
    runs = runs.withColumn("rmse_ratio", F.col("rmse") / F.col("rmse_base"))
    got = {(r.param_id, r.season): r for r in metrics.run_summary(runs).collect()}
    assert len(got) == 6
    frame = runs.toPandas()
    for (p, s), r in got.items():
        part = frame[(frame.param_id == p) & ((frame.season == s) if s is not None else True)]
        assert r.rmse_mean == pytest.approx(part.rmse.mean()) and r.rmse_ratio_std == pytest.approx(part.rmse_ratio.std(ddof=0))
        assert r.rmse_ratio_median == pytest.approx(part.rmse_ratio.median()) and r.n_refits == 2 * len(part)
