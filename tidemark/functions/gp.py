"""Gaussian-process regression for one bounded training set (Rasmussen and Williams 2006, algorithm 2.1).

A kernel is a sum of products of base kernels, written as nested tuples of names.
Parameters are optimised in log space, from many starts and for many settings of one kernel side by side, so that
matrices are evaluated and factorised in stacks. Spark decides which sets are fitted where; nothing here knows about tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Start values and bounds of the base kernels' parameters.
WIDE = (1e-5, 1e5)
CONSTANT_START = 1000.0

INTERVAL = 1.96

#: Steps of one ascent; a fit that has not settled by then says so.
STEPS = 60
#: Cells of kernel matrices evaluated together, and the size of a block inverted at once.
CELLS, BLOCK = 1 << 15, 24


def parameters(kernel, period: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Log start values and log bounds of all parameters of ``kernel``, in leaf order."""
    if period:
        span = (max(int(period * 0.8), 1e-5), max(int(period * 1.2), 1e-5))
        periodic = [(1.0, WIDE), (float(period), span)]
    else:
        periodic = [(1.0, WIDE), (1.0, WIDE)]
    table = {
        "constant": [(CONSTANT_START, WIDE)],
        "matern": [(1.0, WIDE)],
        "periodic": periodic,
        "rbf": [(1.0, WIDE)],
        "rational_quadratic": [(1.0, WIDE), (1.0, WIDE)],
        "white": [(1.0, WIDE)],
    }
    leaves = [p for term in kernel for name in term for p in table[name]]
    return np.log([v for v, _ in leaves]), np.log([b for _, b in leaves])


def _leaf(name: str, theta: np.ndarray, d: np.ndarray, same: np.ndarray | float, grad: bool):
    """Values, derivatives by log parameter, and number of parameters used; a row per row of ``theta``."""
    first = np.exp(theta[:, :1])
    if name == "constant":
        return first, [first], 1
    if name == "white":
        k = first * same
        return k, [k], 1
    if name in ("rbf", "rational_quadratic"):
        q = np.square(d / first)
    if name == "rbf":
        k = np.exp(-0.5 * q)
        return k, [k * q] if grad else [], 1
    if name == "matern":
        s = math.sqrt(3) * d / first
        e = np.exp(-s)
        return (1 + s) * e, [s * s * e] if grad else [], 1
    second = np.exp(theta[:, 1:2])
    if name == "rational_quadratic":
        base = q / (2 * second)
        logs = np.log1p(base)
        k = np.exp(-second * logs)
        base += 1
        return k, [q * k / base, k * (q / (2 * base) - second * logs)] if grad else [], 2
    if name == "periodic":
        arg = math.pi * d / second
        sin = np.sin(arg)
        square = (sin / first) ** 2
        k = np.exp(-2 * square)
        return k, [k * 4 * square, k * 4 * arg * sin * np.cos(arg) / first**2] if grad else [], 2
    raise ValueError(f"unknown kernel {name!r}")


def kernel_values(kernel, theta: np.ndarray, d: np.ndarray, same: np.ndarray | float, grad: bool = False):
    """Kernel at the distances ``d`` (a row each, or one for all) for each row of ``theta``, and its derivatives; ``same`` is 1
    where a point meets itself."""
    total, derivatives, at = np.zeros((len(theta), d.shape[-1])), [], 0
    for term in kernel:
        values, parts = [], []
        for name in term:
            k, dk, used = _leaf(name, theta[:, at:], d, same, grad)
            values.append(k)
            parts.append(dk)
            at += used
        total += math.prod(values[1:], start=values[0])
        if grad:
            for i, dk in enumerate(parts):
                others = [v for j, v in enumerate(values) if j != i]
                derivatives += [math.prod(others, start=g) for g in dk]
    return total, derivatives


def kernel_matrix(kernel, theta: np.ndarray, d: np.ndarray, same: bool) -> np.ndarray:
    """The matrix for one ``theta``; with ``same``, ``d`` holds the distances of points to themselves in order."""
    diagonal = np.eye(*d.shape).ravel() if same else 0.0
    return kernel_values(kernel, np.asarray(theta, float)[None], d.ravel(), diagonal)[0].reshape(d.shape)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] == 1:
        return np.abs(a - b.T)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.clip(square, 0, None))


@lru_cache(maxsize=16)
def _triangle(n: int) -> tuple[np.ndarray, ...]:
    """Of the lower triangle: its cells in the matrix, the matrix' cells in it, 1 on the diagonal, and how often cells count."""
    rows, cols = np.tril_indices(n)
    back = np.zeros((n, n), np.int64)
    back[rows, cols] = back[cols, rows] = np.arange(len(rows))
    diagonal = (rows == cols).astype(float)
    return rows * n + cols, back.ravel(), diagonal, 2 - diagonal


def _inverse_lower(low: np.ndarray) -> np.ndarray:
    """Inverses of stacked lower triangular matrices: the blocks on the diagonals first, then joined pairwise.

    The way does not depend on the number of matrices, because a fit must not depend on what is fitted beside it.
    """
    count, n, _ = low.shape
    if n <= BLOCK:
        return np.linalg.inv(low)
    blocks = -(-n // BLOCK)
    rest, whole = np.arange(n, blocks * BLOCK), np.zeros((count, blocks * BLOCK, blocks * BLOCK))
    whole[:, :n, :n], whole[:, rest, rest] = low, 1.0
    on, out = np.arange(blocks), np.zeros_like(whole)
    in_blocks = (count, blocks, BLOCK, blocks, BLOCK)
    out.reshape(in_blocks)[:, on, :, on, :] = np.linalg.inv(whole.reshape(in_blocks)[:, on, :, on, :])

    def join(a: int, c: int) -> None:
        b = (a + c) // 2 // BLOCK * BLOCK
        if a < b:
            join(a, b)
            join(b, c)
            out[:, b:c, a:b] = -(out[:, b:c, b:c] @ (whole[:, b:c, a:b] @ out[:, a:b, a:b]))

    join(0, blocks * BLOCK)
    return out[:, :n, :n]


@dataclass
class Cells:
    """Where the kernel is evaluated for sets of one size: the cells of the lower triangle, or its distinct distances.

    Sets at regular positions have few distinct distances; ``share`` then names that of each cell.
    """

    n: int
    share: np.ndarray | None = None

    def __post_init__(self):
        self.cells, self.whole, self.same, self.weight = _triangle(self.n)
        if self.share is not None:
            order = np.argsort(self.share, kind="stable")
            self.borders = np.flatnonzero(np.diff(self.share[order], prepend=-1))
            self.cells, self.whole, self.weight = self.cells[order], self.share[self.whole], self.weight[order]
            self.same = np.append(1.0, np.zeros(len(self.borders) - 1))

    def sums(self, outer: np.ndarray) -> np.ndarray:
        """What the derivatives at each distance are multiplied with, from stacked symmetric matrices."""
        each = outer.reshape(len(outer), -1).take(self.cells, axis=1)
        each *= self.weight
        return each if self.share is None else np.add.reduceat(each, self.borders, axis=1)


def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Distances of the lower triangle of a set, or the distinct ones and the number of each cell's; the diagonal comes first."""
    n = len(x)
    d = distances(x, x)[np.tril_indices(n)]
    if x.shape[1] == 1:
        distinct, share = np.unique(np.where(_triangle(n)[2] > 0, -1.0, d), return_inverse=True)
        if 4 * len(distinct) <= len(d):
            return np.maximum(distinct, 0.0), share
    return d, None


def likelihoods(
    kernel, theta: np.ndarray, d: np.ndarray, y: np.ndarray, alpha: np.ndarray, at: Cells | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Log marginal likelihoods and gradients for the rows of ``theta, d, y, alpha``; ``d`` is the lower triangle of distances,
    or what ``at`` makes of it.

    The matrices of some rows are factorised together. Minus infinity where a matrix is not positive definite.
    """
    at = at or Cells(y.shape[1])
    value, gradient = np.empty(len(theta)), np.empty(theta.shape)
    step = max(1, CELLS // len(at.cells))
    for i in range(0, len(theta), step):
        some = slice(i, i + step)
        value[some], gradient[some] = _likelihoods(kernel, theta[some], d[some], y[some], alpha[some], at)
    return value, gradient


def _likelihoods(kernel, theta, d, y, alpha, at: Cells):
    count, n = y.shape
    k, derivatives = kernel_values(kernel, theta, d, at.same, True)
    full = k.take(at.whole, axis=1).reshape(count, n, n)
    full[:, np.arange(n), np.arange(n)] += alpha[:, None]
    try:
        low = np.linalg.cholesky(full)
    except np.linalg.LinAlgError:
        if count == 1:
            return np.full(1, -np.inf), np.zeros(theta.shape)
        h = count // 2
        parts = [_likelihoods(kernel, theta[s], d[s], y[s], alpha[s], at) for s in (slice(h), slice(h, None))]
        return tuple(np.concatenate(p) for p in zip(*parts))
    inverse = _inverse_lower(low)
    back = inverse.transpose(0, 2, 1)
    w = (back @ (inverse @ y[:, :, None]))[:, :, 0]
    logs = np.log(np.ascontiguousarray(low.reshape(count, -1)[:, :: n + 1])).sum(axis=1)
    value = -0.5 * (y * w).sum(axis=1) - logs - n / 2 * math.log(2 * math.pi)
    outer = w[:, :, None] * w[:, None, :]
    outer -= back @ inverse
    sums = at.sums(outer)
    return value, np.stack([0.5 * (sums * g).sum(axis=1) for g in derivatives], axis=1)


def log_likelihood(kernel, theta: np.ndarray, d: np.ndarray, y: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Log marginal likelihood and its gradient for one ``theta`` and a full matrix of distances."""
    value, gradient = likelihoods(kernel, theta[None], d[np.tril_indices(len(d))][None], y[None], np.array([alpha]))
    return float(value[0]), gradient[0]


def maximise(f, start: np.ndarray, bounds: np.ndarray, steps: int = STEPS, tolerance: float = 1e-5):
    """Projected BFGS ascent inside a box from every row of ``start``: points, values, and which of them converged.

    ``f(points, rows)`` gives values and gradients; rows go their own ways, but each turn looks at all that still move.
    """
    low, high = bounds[:, 0], bounds[:, 1]
    x = np.clip(start, low, high)
    value, g = f(x, np.arange(len(x)))
    h = np.tile(np.eye(x.shape[1]), (len(x), 1, 1))
    taken, converged = np.zeros(len(x), int), np.zeros(len(x), bool)
    direction, size = np.zeros(x.shape), np.ones(len(x))
    fresh, going = np.ones(len(x), bool), np.isfinite(value)
    while True:
        at = np.flatnonzero(going & fresh)
        if len(at):  # a new direction
            free = ~(((x[at] <= low) & (g[at] < 0)) | ((x[at] >= high) & (g[at] > 0)))
            slope = np.where(free, g[at], 0.0)
            flat = np.abs(slope).max(axis=1) < tolerance
            converged[at[flat]] = True
            going[at[flat | (taken[at] >= steps)]] = False
            move = np.where(free, np.einsum("rij,rj->ri", h[at], slope), 0.0)
            wrong = (move * g[at]).sum(axis=1) <= 0
            h[at[wrong]], move[wrong] = np.eye(x.shape[1]), slope[wrong]
            direction[at] = move * np.minimum(1.0, 3.0 / np.maximum(np.abs(move).max(axis=1, keepdims=True), 1e-300))
            size[at], fresh[at] = 1.0, False
        at = np.flatnonzero(going)
        if not len(at):
            return x, value, converged
        new = np.clip(x[at] + size[at, None] * direction[at], low, high)
        step = new - x[at]
        promised = (g[at] * step).sum(axis=1)
        new_value, new_g = f(new, at)
        better = new_value > value[at] + 1e-4 * promised
        worse = at[~better]
        below = promised[~better] - (new_value - value[at])[~better]
        top = promised[~better] / (2 * np.maximum(below, 1e-3 * np.abs(promised[~better]) + 1e-300))
        size[worse] *= np.clip(top, 0.1, 0.5)  # to where a parabola through both has its top
        # what a shorter step could gain is lost in rounding
        idle = (promised[~better] * 0.5 < 1e-10 * np.maximum(np.abs(value[worse]), 1.0)) | (size[worse] <= 1e-8)
        converged[worse[idle]], going[worse[idle]] = True, False
        ok = at[better]
        step, change = step[better], g[ok] - new_g[better]
        gained = new_value[better] - value[ok]
        x[ok], value[ok], g[ok] = new[better], new_value[better], new_g[better]
        taken[ok] += 1
        fresh[ok] = True
        curve = (step * change).sum(axis=1)
        bent = curve > 1e-10
        turn = ok[bent]
        first = taken[turn] == 1
        scale = curve[bent] / np.maximum((change[bent] ** 2).sum(axis=1), 1e-300)
        h[turn[first]] *= scale[first, None, None]
        s, yk, rho = step[bent], change[bent], 1.0 / curve[bent][:, None, None]
        left = np.eye(x.shape[1]) - rho * s[:, :, None] * yk[:, None, :]
        h[turn] = left @ h[turn] @ left.transpose(0, 2, 1) + rho * s[:, :, None] * s[:, None, :]
        settled = gained < 1e-9 * np.maximum(np.abs(value[ok]), 1.0)
        converged[ok[settled]], going[ok[settled]] = True, False


@dataclass
class Fit:
    """A fitted model without its matrices: they follow from the training set."""

    theta: np.ndarray
    likelihood: float
    converged: bool


def starts_of(kernel, period: int | None, restarts: int, seed: int = 42, theta0=None) -> np.ndarray:
    """The start values (or ``theta0``) and ``restarts`` random points within the bounds; more restarts begin with the same ones."""
    start, bounds = parameters(kernel, period)
    if theta0 is not None:
        start = np.asarray(theta0, dtype=float)
    rng = np.random.default_rng(seed)
    return np.stack([start, *(rng.uniform(bounds[:, 0], bounds[:, 1]) for _ in range(restarts))])


def fit_starts(kernel, sets: list[tuple[np.ndarray, np.ndarray]], owner, starts: np.ndarray, alpha, normalize_y, period=None) -> list[Fit]:
    """One ascent per row of ``starts``, with its own ``alpha`` and ``normalize_y``, on the training set number ``owner``.

    Each set has one matrix of distances; rows of sets of one size and pattern of distances are evaluated together.
    """
    owner, alpha, normal = np.asarray(owner), np.asarray(alpha, dtype=float), np.asarray(normalize_y).astype(int)
    members: dict[tuple, list[tuple[int, np.ndarray]]] = {}
    for i in np.unique(owner):
        d, share = places(sets[i][0])
        members.setdefault((len(sets[i][1]), None if share is None else share.tobytes()), []).append((i, d))
    groups, group, place = [], np.zeros(len(sets), int), np.zeros(len(sets), int)
    for (n, share), mine in members.items():
        for at, (i, _) in enumerate(mine):
            group[i], place[i] = len(groups), at
        cells = Cells(n, None if share is None else np.frombuffer(share, np.int64))
        groups.append((cells, np.stack([d for _, d in mine]), np.stack([[sets[i][1], _normalised(sets[i][1], True)[0]] for i, _ in mine])))

    def objective(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, gradient = np.empty(len(rows)), np.empty(points.shape)
        mine = group[owner[rows]]
        for g in np.unique(mine):
            cells, d, y = groups[g]
            some = np.flatnonzero(mine == g)
            own = place[owner[rows[some]]]
            value[some], gradient[some] = likelihoods(kernel, points[some], d[own], y[own, normal[rows[some]]], alpha[rows[some]], cells)
        return value, gradient

    theta, value, converged = maximise(objective, starts, parameters(kernel, period)[1])
    return [Fit(t, float(v), bool(c)) for t, v, c in zip(theta, value, converged)]


def fit(kernel, x: np.ndarray, y: np.ndarray, alpha: float, normalize_y: bool, theta0=None, period=None,
        restarts: int = 0, seed: int = 42) -> Fit:
    """Maximise the likelihood from the start values and from ``restarts`` random points within the bounds."""
    starts = starts_of(kernel, period, restarts, seed, theta0)
    fits = fit_starts(
        kernel, [(x, y)], np.zeros(len(starts), int), starts, np.full(len(starts), alpha), np.full(len(starts), normalize_y), period
    )
    best = max(fits, key=lambda f: f.likelihood)
    if not np.isfinite(best.likelihood):
        raise ValueError("kernel matrix is not positive definite")
    return best


def _normalised(y: np.ndarray, on: bool):
    if not on:
        return y, 0.0, 1.0
    mean, std = y.mean(), y.std()
    std = std if std > 0 else 1.0
    return (y - mean) / std, mean, std


class Posterior:
    """A model ready to predict: the factorised training matrix."""

    def __init__(self, kernel, theta, x: np.ndarray, y: np.ndarray, alpha: float, normalize_y: bool):
        self.kernel, self.theta, self.x = kernel, np.asarray(theta, dtype=float), x
        target, self.mean, self.std = _normalised(y, normalize_y)
        k = kernel_matrix(kernel, self.theta, distances(x, x), True)
        k[np.diag_indices_from(k)] += alpha
        self.inverse = np.linalg.inv(np.linalg.cholesky(k))
        self.weights = self.inverse.T @ (self.inverse @ target)
        # all base kernels are stationary, so the prior variance is the same everywhere
        self.prior = kernel_matrix(kernel, self.theta, np.zeros((1, 1)), True)[0, 0]

    def __call__(self, new: np.ndarray):
        """Mean and standard deviation at ``new``."""
        cross = kernel_matrix(self.kernel, self.theta, distances(new, self.x), False)
        part = self.inverse @ cross.T
        spread = np.sqrt(np.clip(self.prior - (part * part).sum(axis=0), 0, None))
        return cross @ self.weights * self.std + self.mean, spread * self.std


def predict(kernel, theta, x: np.ndarray, y: np.ndarray, alpha: float, normalize_y: bool, new: np.ndarray):
    """Mean and standard deviation at ``new``."""
    return Posterior(kernel, theta, x, y, alpha, normalize_y)(new)
