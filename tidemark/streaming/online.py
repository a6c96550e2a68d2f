"""The online response as a keyed stateful stream.

The state of a series is a bounded buffer of its latest rows plus the model in
force. Change scores forget their past, so scoring the buffer gives the scores
of the whole history; no detector state needs to be carried. The stream then
gives the same predictions and triggers as the batch plan on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import gp as numerics
from tidemark.functions.detectors import burn_in_rows, change_scores
from tidemark.operators.response import BASE_MODEL, START_SCALE, fires
from tidemark.spec import GPSpec, OnlineSpec, SeriesSpec

#: Refits of a series that are fitted side by side.
REFITS = 64
OUTPUT = (
    "t bigint, y double, late boolean, prediction double, lower_conf double, upper_conf double, score double,"
    " change_point boolean, scale double, triggered boolean, refit_t bigint, scale_old double"
)
STATE = (
    "n bigint, ts array<bigint>, ys array<double>, xs array<double>, waiting_t array<bigint>,"
    " waiting_y array<double>, waiting_x array<double>, threshold double, scale_old double, refit_t bigint,"
    " base_theta array<double>, theta array<double>, train_x array<double>, train_y array<double>"
)


def online_stream(
    rows: DataFrame,
    spec: SeriesSpec,
    online: OnlineSpec,
    gp: GPSpec,
    n_train: int,
    n_features: int = 1,
    reorder_rows: int = 0,
    base_cap: int | None = None,
    watermark: str = "1 day",
) -> DataFrame:
    """Online response on a stream of ``series_id, ts, t, y, x``.

    The first ``n_train`` rows of a series fit its base model and its score threshold. Rows come out in
    order of ``t``; up to ``reorder_rows`` rows per series wait for a gap to close. A row at or before the last one
    handled comes out with ``late`` set and changes nothing. Uses the change score detector with scaled history.
    """
    if online.cpd != "cf" or online.da != "scaled":
        raise ValueError("the stream supports the change score detector with scaled history")
    if len(spec.keys) != 1:
        raise ValueError("the stream needs a single series key")
    step = _stepper(spec, online.resolved(spec.season), gp, n_train, n_features, reorder_rows, base_cap)
    key = spec.keys[0]
    return (
        rows.withWatermark(spec.ts, watermark)
        .select(key, "t", F.col(spec.target).alias("y"), "x")
        .groupBy(key)
        .applyInPandasWithState(
            step, f"{key} string, {OUTPUT}", STATE, "append", GroupStateTimeout.NoTimeout
        )
    )


def _stepper(spec, online: OnlineSpec, gp: GPSpec, n_train: int, d: int, reorder: int, base_cap):
    season, window = spec.season, online.scale_window
    names = [f.split()[0] for f in STATE.split(", ")]
    outputs = [f.split()[0] for f in OUTPUT.split(", ")]
    key_name = spec.keys[0]
    need = max(online.max_samples, season + burn_in_rows(online.cf_r, online.cf_order, online.cf_smooth), 2 * season + window)

    def fit(x, y, theta0):
        mean, std = _standard(x) if gp.standardize else (np.zeros(d), np.ones(d))
        found = numerics.fit(gp.kernel, (x - mean) / std, y, gp.alpha, gp.normalize_y, theta0=theta0,
                             period=gp.period, restarts=gp.n_restarts, seed=gp.seed)
        return found.theta

    def predictor(s):
        x, y = s["train_x"].reshape(-1, d), s["train_y"]
        mean, std = _standard(x) if gp.standardize else (np.zeros(d), np.ones(d))
        posterior = numerics.Posterior(gp.kernel, s["theta"], (x - mean) / std, y, gp.alpha, gp.normalize_y)
        return lambda new: posterior((new - mean) / std)

    def scale_at(y, at):
        """Output scale at position ``at`` of ``y``; NaN until all seasons are there."""
        if at + 1 < online.scale_seasons * season + window:
            return np.nan
        level = lambda back: y[at - back - window + 1 : at - back + 1].mean()
        parts = [level(season * k) for k in range(1, online.scale_seasons + 1)]
        return np.nan if 0 in parts else float(np.mean([level(0) / p for p in parts]))

    def recent(x, y, at, scale):
        """The training set of a refit at position ``at``."""
        begin = max(0, at + 1 - online.max_samples)
        return x[begin : at + 1], y[begin : at + 1] * scale

    def fit_all(sets, theta0):
        """Parameters of refits fitted side by side, None where a fit fails; each as if it were alone."""
        try:
            ready = []
            for x, y in sets:
                mean, std = _standard(x) if gp.standardize else (np.zeros(d), np.ones(d))
                ready.append(((x - mean) / std, y))
            starts = numerics.starts_of(gp.kernel, gp.period, gp.n_restarts, gp.seed, theta0)
            n = len(starts) * len(sets)
            found = numerics.fit_starts(gp.kernel, ready, np.repeat(np.arange(len(sets)), len(starts)), np.tile(starts, (len(sets), 1)),
                                        np.full(n, gp.alpha), np.full(n, gp.normalize_y), gp.period)
        except (ValueError, ArithmeticError, np.linalg.LinAlgError):
            return [None] if len(sets) == 1 else [fit_all([one], theta0)[0] for one in sets]
        best = [max(found[i : i + len(starts)], key=lambda f: f.likelihood) for i in range(0, n, len(starts))]
        return [f.theta if np.isfinite(f.likelihood) else None for f in best]

    def settle(s, x, y, scores, scales):
        """Positions that trigger, and the parameters refitted there (None where the fit fails).

        Some triggers are found as if no refit failed, and fitted side by side; after one that fails the rows are looked at again.
        """
        found, fits, old, at = {}, {}, s["scale_old"], min(scales, default=len(y))
        while at < len(y):
            some, ahead, in_force = [], at, old
            while ahead < len(y) and len(some) < REFITS:
                scale = scales[ahead]
                usable = scores[ahead] >= s["threshold"] and np.isfinite(scale) and scale != 0 and in_force > 0
                if usable and fires(scale, in_force, online.scale_thr):
                    some.append(ahead)
                    in_force = scale
                ahead += 1
            todo = [k for k in some if k not in fits]
            if todo:
                fits |= zip(todo, fit_all([recent(x, y, k, scales[k]) for k in todo], s["base_theta"]))
            for k in some:
                found[k] = fits[k]
                if fits[k] is None:
                    ahead = k + 1
                    break
                old = scales[k]
            at = ahead
        return found

    def take(s, rows):
        """Handle rows in order; returns their outputs."""
        known = len(s["ys"])
        t = np.concatenate([s["ts"], [r[0] for r in rows]]).astype(np.int64)
        y = np.concatenate([s["ys"], [r[1] for r in rows]])
        x = np.concatenate([s["xs"].reshape(-1, d), [r[2] for r in rows]])
        # scores look back only, so those of all new rows come from one pass over the buffer and the rows
        scores = np.full(len(y), np.nan)
        if len(y) > season:
            scores[season:] = change_scores(y[season:] - y[:-season], online.cf_r, online.cf_order, online.cf_smooth)
        begin = known + max(0, n_train - int(s["n"]))  # the first row that is predicted
        if s["n"] < n_train and begin <= len(y):
            first = scores[season:begin]
            first = first[np.isfinite(first)]
            s["threshold"] = float(np.percentile(first, online.cf_thr_perc)) if len(first) else np.inf
            oldest = 0 if base_cap is None else max(0, begin - base_cap)
            s["train_x"], s["train_y"] = x[oldest:begin].ravel(), y[oldest:begin]
            s["theta"] = s["base_theta"] = fit(x[oldest:begin], s["train_y"], None)
        scales = {at: scale_at(y, at) for at in range(begin, len(y))}
        refits = settle(s, x, y, scores, scales)
        results, model = [], None
        for at in range(known, len(y)):
            out = dict.fromkeys(outputs)
            out |= dict(t=t[at], y=y[at], late=False, change_point=False, triggered=False,
                        refit_t=s["refit_t"], scale_old=s["scale_old"])
            results.append(out)
            s["n"] += 1
            if at < begin:
                continue
            model = predictor(s) if model is None else model
            centre, spread = model(x[at : at + 1])
            half = numerics.INTERVAL * spread[0]
            out |= dict(prediction=centre[0], lower_conf=centre[0] - half, upper_conf=centre[0] + half,
                        score=scores[at], scale=scales[at], change_point=bool(scores[at] >= s["threshold"]))
            if at in refits:
                out["triggered"] = True
                if refits[at] is not None:  # else the model in force stays
                    s["train_x"], s["train_y"] = (v.ravel() for v in recent(x, y, at, scales[at]))
                    s["theta"], s["scale_old"], s["refit_t"], model = refits[at], scales[at], t[at], None
        keep = n_train if s["n"] < n_train else need
        s["ts"], s["ys"], s["xs"] = t[-keep:], y[-keep:], x[-keep:].ravel()
        return results

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(names, state.get)) if state.exists else _empty(names)
        for name in names:
            if isinstance(s[name], (list, tuple)):
                s[name] = np.asarray(s[name])
        new = pd.concat(list(batches))
        waiting = [
            (int(t), float(y), np.asarray(x, dtype=float)) for t, y, x in zip(new["t"], new["y"], new["x"])
        ] + [
            (int(t), float(y), x)
            for t, y, x in zip(s["waiting_t"], s["waiting_y"], s["waiting_x"].reshape(-1, d))
        ]
        waiting.sort(key=lambda r: r[0])
        results, ready, held = [], [], []
        last = int(s["ts"][-1]) if len(s["ts"]) else None
        for at, (t, y, x) in enumerate(waiting):
            if last is not None and t <= last:
                results.append(dict.fromkeys(outputs) | dict(t=t, y=y, late=True, change_point=False, triggered=False))
            elif last is None or t == last + 1 or len(waiting) - at > reorder:
                ready.append((t, y, x))
                last = t
            else:
                held = waiting[at:]
                break
        if ready:
            results += take(s, ready)
        s["waiting_t"] = np.array([r[0] for r in held], dtype=np.int64)
        s["waiting_y"] = np.array([r[1] for r in held])
        s["waiting_x"] = np.concatenate([r[2] for r in held]) if held else np.zeros(0)
        state.update(tuple(v.tolist() if isinstance(v, (np.ndarray, np.generic)) else v for v in (s[n] for n in names)))
        if results:
            out = pd.DataFrame(results, columns=outputs)
            out.insert(0, key_name, key[0])
            for c in ("prediction", "lower_conf", "upper_conf", "score", "scale", "scale_old"):
                out[c] = out[c].astype(float)
            out["refit_t"] = out["refit_t"].astype("Int64")
            yield out

    return step


def _standard(x: np.ndarray):
    std = x.std(axis=0, ddof=1)
    return x.mean(axis=0), np.where(std == 0, 1.0, std)


def _empty(names) -> dict:
    s = dict.fromkeys(names)
    for name in ("ys", "xs", "waiting_y", "waiting_x", "train_x", "train_y", "theta", "base_theta"):
        s[name] = np.zeros(0)
    s["ts"] = s["waiting_t"] = np.zeros(0, dtype=np.int64)
    return s | dict(n=0, threshold=np.inf, scale_old=START_SCALE, refit_t=BASE_MODEL)


def run_available(stream: DataFrame, path: str, checkpoint: str, by: str | None = None) -> None:
    """Process what the source holds now, append the results to ``path`` and stop."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if by:
        writer = writer.partitionBy(by)
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
