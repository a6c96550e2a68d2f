"""Rebalancing of one bounded regression sample: rare targets copied with noise or interpolated."""

from __future__ import annotations

import numpy as np

NEIGHBOURS = 5
NOISE_SHARE = 0.02


def quartiles(y: np.ndarray) -> list[float]:
    """The three quartiles as ``np.percentile`` gives them, without its checks, which cost more than a short sample."""
    if np.isnan(y).any():
        return [np.nan] * 3
    ordered, found = np.sort(y).tolist(), []
    for share in (0.25, 0.5, 0.75):
        place = share * (len(ordered) - 1)
        at = int(place)
        low, high, part = ordered[at], ordered[min(at + 1, len(ordered) - 1)], place - at
        found.append(high - (high - low) * (1 - part) if part >= 0.5 else low + (high - low) * part)
    return found


def relevance(y: np.ndarray, coef: float, side: str) -> np.ndarray:
    """0 at the median, 1 at the box-plot fence (``coef`` times the quartile range) of the chosen side(s)."""
    q1, median, q3 = quartiles(y)
    spread = max(q3 - q1, 1e-12)
    sides = {}
    if side != "low":
        sides["high"] = np.minimum(np.maximum((y - median) / max(q3 + coef * spread - median, 1e-12), 0.0), 1.0)
    if side != "high":
        sides["low"] = np.minimum(np.maximum((median - y) / max(median - q1 + coef * spread, 1e-12), 0.0), 1.0)
    return np.maximum(sides["high"], sides["low"]) if side == "both" else sides[side]


def interpolate_rare(x, y, rng, rel_thr: float, rel_coef: float, side: str, under_samp: bool):
    """Oversample rare targets between near neighbours, with noise where neighbours are far (SMOGN, 2017).

    Rare rows are copied until they are as many as the normal ones.
    """
    rare = relevance(y, rel_coef, side) >= rel_thr
    n_rare, n_normal = int(rare.sum()), int((~rare).sum())
    if n_rare < 2 or n_normal == 0:
        return x, y
    rx, ry = x[rare], y[rare]
    scale = x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    gap = (rx[:, None, :] - rx[None, :, :]) / scale
    d = np.sqrt((gap * gap).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    k = min(NEIGHBOURS, n_rare - 1)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    nearest = np.take_along_axis(d, near, axis=1)  # in order of distance
    safe = (nearest[:, (k - 1) // 2] + nearest[:, k // 2]) / 4  # half the median
    copies = max(n_normal - n_rare, 0)
    seeds = np.resize(rng.permutation(n_rare), copies)
    picks = near[seeds, rng.integers(0, k, copies)]
    share = rng.random((copies, 1))
    close = d[seeds, picks] < safe[seeds]
    between_x = rx[seeds] + share * (rx[picks] - rx[seeds])
    between_y = ry[seeds] + share[:, 0] * (ry[picks] - ry[seeds])
    noisy_x = rx[seeds] + rng.normal(0, NOISE_SHARE, (copies, x.shape[1])) * rx.std(axis=0)
    noisy_y = ry[seeds] + rng.normal(0, NOISE_SHARE, copies) * ry.std()
    new_x = np.where(close[:, None], between_x, noisy_x)
    new_y = np.where(close, between_y, noisy_y)
    kept = np.arange(n_normal)
    if under_samp:
        kept = np.sort(rng.permutation(n_normal)[: max(n_normal // 2, n_rare)])
    return np.concatenate([x[~rare][kept], rx, new_x]), np.concatenate([y[~rare][kept], ry, new_y])


def noise_copies(x, y, rng, thr: float, o_perc: float, u_perc: float):
    """Copy rare targets ``o_perc`` times with Gaussian noise and keep a share ``u_perc`` of the normal rows."""
    rare = relevance(y, 1.5, "both") >= thr
    n_rare, n_normal = int(rare.sum()), int((~rare).sum())
    if n_rare == 0:
        return x, y
    rx, ry = x[rare], y[rare]
    copies = int(n_rare * o_perc)
    picks = np.resize(rng.permutation(n_rare), copies)
    new_x = rx[picks] + rng.normal(0, NOISE_SHARE, (copies, x.shape[1])) * x.std(axis=0)
    new_y = ry[picks] + rng.normal(0, NOISE_SHARE, copies) * y.std()
    kept = np.sort(rng.permutation(n_normal)[: int(np.ceil(n_normal * u_perc))])
    return np.concatenate([x[~rare][kept], rx, new_x]), np.concatenate([y[~rare][kept], ry, new_y])
