"""Change-point scores over one stretch of a series, and their row-by-row form for streams."""

from __future__ import annotations

import math

import numpy as np

CHUNK = 64
# Floor of the innovation variance.
MIN_VARIANCE = 1e-12
# Weight at which an exponentially forgotten start is beyond double precision.
FORGOTTEN = 1e-40


def forgetting_rows(r: float) -> int:
    """Rows after which a start weighs less than ``FORGOTTEN``."""
    return math.ceil(math.log(FORGOTTEN) / math.log1p(-r))


def burn_in_rows(r: float, order: int, smooth: int) -> int:
    """Rows of history after which change scores no longer depend on where the scan began."""
    # two stages, each chaining three averages (mean, covariance, variance)
    return 2 * (forgetting_rows(r) + order) + 2 * smooth


def ewma(u: np.ndarray, r: float, start: float = 0.0) -> np.ndarray:
    """``z[t] = (1-r) z[t-1] + r u[t]``, in chunks: a matrix product inside, a carry between."""
    n = len(u)
    if n == 0:
        return np.zeros(0)
    rows = -(-n // CHUNK)
    padded = np.zeros(rows * CHUNK)
    padded[:n] = u
    lag = np.subtract.outer(np.arange(CHUNK), np.arange(CHUNK))
    kernel = np.where(lag >= 0, r * (1 - r) ** np.clip(lag, 0, None), 0.0)
    local = padded.reshape(rows, CHUNK) @ kernel.T
    decay = (1 - r) ** np.arange(1, CHUNK + 1)
    carry = start
    for i in range(rows):
        local[i] += decay * carry
        carry = local[i, -1]
    return local.ravel()[:n]


def sdar_scores(x: np.ndarray, r: float, order: int, density: str = "after") -> np.ndarray:
    """Log loss of each value under a discounting autoregressive model (Takeuchi and Yamanishi 2006).

    Every statistic of the model is an exponential average of quantities known from
    the averages before it, so whole stretches are computed at once. The first
    ``order`` values only fill the lags. ``density`` tells whether a value is scored
    by the model that already includes it or by the model before it.
    """
    n = len(x) - order
    if n <= 0:
        return np.zeros(0)
    now = x[order:]
    past = np.stack([x[order - j : len(x) - j] for j in range(1, order + 1)])
    mean = ewma(now, r)
    centred = now - mean
    cov = np.stack([ewma(centred * centred, r)] + [ewma(centred * (p - mean), r) for p in past])
    ar = _yule_walker(cov)
    fitted = mean + (ar * (past - mean)).sum(axis=0)
    variance = ewma((now - fitted) ** 2, r)
    if density == "before":
        mean, ar = _one_back(mean), np.apply_along_axis(_one_back, 1, ar)
        fitted = mean + (ar * (past - mean)).sum(axis=0)
        variance = _one_back(variance)
    variance = np.maximum(variance, MIN_VARIANCE)
    loss = 0.5 * np.log(2 * math.pi * variance) + (now - fitted) ** 2 / (2 * variance)
    if density == "before":
        loss[0] = 0.0
    return loss


def _one_back(v: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], v[:-1]])


def _yule_walker(cov: np.ndarray) -> np.ndarray:
    """Autoregressive weights for each column of autocovariances ``cov[0..k]``."""
    k = len(cov) - 1
    c0 = np.where(np.abs(cov[0]) < 1e-300, 1.0, cov[0])
    if k == 1:
        return (cov[1] / c0)[None, :]
    distance = np.abs(np.subtract.outer(np.arange(k), np.arange(k)))
    matrices = np.moveaxis(cov[distance], -1, 0) + 1e-12 * c0[:, None, None] * np.eye(k)
    right = cov[1:].T[:, :, None]
    try:
        return np.linalg.solve(matrices, right)[:, :, 0].T
    except np.linalg.LinAlgError:
        return (np.linalg.pinv(matrices) @ right)[:, :, 0].T


def trailing_mean(v: np.ndarray, n: int) -> np.ndarray:
    """Means of each full window of ``n`` values."""
    if len(v) < n:
        return np.zeros(0)
    return np.lib.stride_tricks.sliding_window_view(v, n).mean(axis=1)


def change_scores(
    x: np.ndarray, r: float, order: int, smooth: int, density: str = "after", smooth2: int | None = None
) -> np.ndarray:
    """Two-stage change score of each value; 0 until all windows are full.

    A missing value has no score and changes nothing: the next one continues from the values before it. So a
    score never depends on a later value.
    """
    missing = ~np.isfinite(x)
    if missing.any():
        out = np.full(len(x), np.nan)
        out[~missing] = change_scores(x[~missing], r, order, smooth, density, smooth2)
        return out
    smooth2 = round(smooth / 2) if smooth2 is None else smooth2
    first = trailing_mean(sdar_scores(x, r, order, density), smooth)
    second = trailing_mean(sdar_scores(first, r, order, density), smooth2)
    out = np.zeros(len(x))
    if len(second):
        out[len(x) - len(second) :] = second
    return out


_HALVES = np.arange(4_000) / 2 + 1
_GAMMA_STEPS = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in _HALVES])


def _gamma_step(a: np.ndarray) -> np.ndarray:
    """``lgamma(a + 1/2) - lgamma(a)`` at multiples of 1/2; large arguments by their series."""
    at = np.rint(2 * (a - 1)).astype(np.int64)
    tabled = _GAMMA_STEPS[np.minimum(at, len(_GAMMA_STEPS) - 1)]
    return np.where(at < len(_GAMMA_STEPS), tabled, 0.5 * np.log(a) - 1 / (8 * a) + 1 / (192 * a**3))


class RunLengths:
    """Posterior over the time since the last change (Adams and MacKay 2007), constant hazard.

    Normal data with unknown mean and variance; prior mean 0, kappa 1, alpha 1, beta 1.
    All run lengths whose mass has not vanished in double precision are held. With ``least`` above 0, those with less
    mass are dropped, which moves at most that share of the mass per run length and value to the others.
    """

    def __init__(self, hazard_lambda: float, least: float = 0.0):
        self.least = least
        self.hazard = 1.0 / hazard_lambda
        self.runs = np.zeros(1, dtype=np.int64)
        self.mass = np.ones(1)
        self.mu, self.kappa, self.alpha, self.beta = np.zeros(1), np.ones(1), np.ones(1), np.ones(1)

    def update(self, x: float) -> int:
        """Take one value; returns the most likely run length."""
        density = self._student_t(x)
        grown = self.mass * density * (1 - self.hazard)
        changed = (self.mass * density).sum() * self.hazard
        mass = np.concatenate([[changed], grown])
        total = mass.sum()
        mass = mass / total if total > 0 else np.concatenate([[1.0], np.zeros(len(grown))])
        shift = x - self.mu
        beta = self.beta + self.kappa * shift**2 / (2 * (self.kappa + 1))
        mu = (self.kappa * self.mu + x) / (self.kappa + 1)
        keep = (mass > 0) & (mass >= self.least)
        keep[0] = True
        self.runs = np.concatenate([[0], self.runs + 1])[keep]
        self.mass = mass[keep] / mass[keep].sum()
        self.mu = np.concatenate([[0.0], mu])[keep]
        self.kappa = np.concatenate([[1.0], self.kappa + 1])[keep]
        self.alpha = np.concatenate([[1.0], self.alpha + 0.5])[keep]
        self.beta = np.concatenate([[1.0], beta])[keep]
        return int(self.runs[self.mass.argmax()])

    def _student_t(self, x: float) -> np.ndarray:
        df = 2 * self.alpha
        scale2 = self.beta * (self.kappa + 1) / (self.alpha * self.kappa)
        lg = _gamma_step(self.alpha)
        z = (x - self.mu) ** 2 / scale2
        return np.exp(lg - 0.5 * np.log(math.pi * df * scale2) - (df + 1) / 2 * np.log1p(z / df))
