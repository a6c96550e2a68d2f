"""Refits that fail: triggers fire, but neither scale nor model moves."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.response import respond
from tidemark.plans import online
from tidemark.spec import OnlineSpec, SeriesSpec


def walk(rows, threshold, failed):
    """The rule, row by row."""
    old, refit, out = 1.0, -1, []
    for t, change, scale in rows:
        state = (refit, old)
        fired = change and scale is not None and scale != 0 and old > 0 and abs(scale - old) / old > threshold
        if fired and t not in failed:
            old, refit = scale, t
        out.append((t, bool(fired), *state))
    return out


@pytest.fixture(scope="module")
def flagged(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key in range(6):
        for t in range(60):
            scale = None if rng.random() < 0.1 else float(np.round(rng.lognormal(0, 0.4), 3))
            rows.append((str(key), t, bool(rng.random() < 0.6), scale, 0, 1.0, key % 2))
    return spark.createDataFrame(rows, "series_id string, t long, change_point boolean, scale double, n_train int, y double, param_id int")


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_failed_refits_move_nothing(spark, flagged, block_rows):
    rng = np.random.default_rng(8)
    bad = {str(k): set(rng.choice(60, 20, replace=False).tolist()) for k in range(6)}
    failed = spark.createDataFrame([(k, int(k) % 2, int(t)) for k, ts in bad.items() for t in ts], "series_id string, param_id int, t long")
    spec = replace(SeriesSpec(keys=("series_id", "param_id"), season=12), block_rows=block_rows)
    for threshold in (0.1, [0.05, 0.3]):
        got = {}
        for r in respond(flagged, spec, threshold, failed).collect():
            got.setdefault(r.series_id, []).append((r.t, r.triggered, r.refit_t, r.scale_old))
            assert (r.reason is None) == (r.triggered or not r.change_point)
        for key, ts in bad.items():
            rows = [(r.t, r.change_point, r.scale) for r in flagged.where(F.col("series_id") == key).orderBy("t").collect()]
            limit = threshold[int(key) % 2] if isinstance(threshold, list) else threshold
            assert sorted(got[key]) == walk(rows, limit, ts)


def test_states_and_refits_settle(spark, flagged):
    """Failures known only after fitting; only what is new is fitted."""
    fails = lambda key, t: (t * 7 + int(key)) % 3 == 0
    asked = []

    def refit(triggers):
        asked.append({(r.series_id, r.refit_t) for r in triggers.collect()})
        ok = (F.col("refit_t") * 7 + F.col("series_id").cast("int")) % 3 != 0
        return triggers.select("series_id", "refit_t", F.lit(online.ONLINE).alias("model"), F.when(ok, "ok").otherwise("failed").alias("status"))

    spec = SeriesSpec(keys=("series_id",), season=12)
    state, fitted = online.settled(flagged.drop("param_id"), spec, OnlineSpec(), refit)
    got = {}
    for r in state.collect():
        got.setdefault(r.series_id, []).append((r.t, r.triggered, r.refit_t, r.scale_old))
    fired = set()
    for key in map(str, range(6)):
        rows = [(r.t, r.change_point, r.scale) for r in flagged.where(F.col("series_id") == key).orderBy("t").collect()]
        want = walk(rows, 0.1, {t for t in range(60) if fails(key, t)})
        assert sorted(got[key]) == want
        fired |= {(key, t) for t, hit, *_ in want if hit}
    assert {(r.series_id, r.refit_t) for r in fitted.collect()} == fired
    assert len(asked) > 1 and sum(map(len, asked)) == len(set.union(*asked))


def test_no_triggers(spark, flagged):
    quiet = flagged.drop("param_id").withColumn("change_point", F.lit(False))
    state, fitted = online.settled(quiet, SeriesSpec(season=12), OnlineSpec(), lambda t: t.select(
        "series_id", "refit_t", F.lit(online.ONLINE).alias("model"), F.lit("ok").alias("status")))
    assert fitted.count() == 0 and state.where("triggered").count() == 0 and state.count() == 360
