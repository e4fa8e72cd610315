"""Linear fits from moments, used inside walk-forward tasks.

A fit needs the rows of a split only through their count, mean and scatter matrix. Moments of
disjoint rows add up (by the pairwise update, which subtracts no large numbers), so an expanding
split adds its new rows to the moments of the split before. Each learner turns moments into a
function from rows to log predictions, with a convergence flag.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Moments:
    """Count, mean and centred cross products of rows."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        if not len(rows):
            return Moments(0, np.zeros(rows.shape[1]), np.zeros((rows.shape[1],) * 2))
        mean = rows.mean(axis=0)
        centred = rows - mean
        return Moments(len(rows), mean, centred.T @ centred)

    def plus(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.scatter + other.scatter
                       + np.outer(gap, gap) * (self.n * other.n / n))


Predictor = Callable[[np.ndarray], np.ndarray]


def _scales(mean: np.ndarray, scatter: np.ndarray, n: int) -> np.ndarray:
    """Population deviations; constant columns keep scale one."""
    scale = np.sqrt(np.maximum(np.diagonal(scatter), 0.0) / n)
    return np.where(scale > 10.0 * np.finfo(float).eps * np.abs(mean), scale, 1.0)


def _penalised(gram: np.ndarray, cross: np.ndarray, alpha: float, n: int) -> np.ndarray:
    if n > len(gram):
        return np.linalg.solve(gram + alpha * np.eye(len(gram)), cross)
    # fewer rows than columns: most eigenvalues are zero, and only the penalty bounds them
    values, vectors = np.linalg.eigh(gram)
    values = np.where(values > values[-1] * len(gram) * np.finfo(float).eps, values, 0.0)
    inner = vectors.T @ cross
    return vectors @ np.where(values[:, None] > 0.0, inner / (values + alpha)[:, None], 0.0)


def standardise(train: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zero mean, unit population deviation; constant columns keep scale one."""
    centre, scale = train.mean(axis=0), train.std(axis=0)
    scale = np.where(scale > 10.0 * np.finfo(float).eps * np.abs(centre), scale, 1.0)
    return (train - centre) / scale, (use - centre) / scale


def ridge_weights(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercept of |y - xw - b|^2 + alpha |w|^2, intercept unpenalised."""
    x_mean, y_mean = x.mean(axis=0), y.mean(axis=0)
    xc, yc = x - x_mean, y - y_mean
    if xc.shape[0] < xc.shape[1]:
        dual = np.linalg.solve(xc @ xc.T + alpha * np.eye(xc.shape[0]), yc)
        weights = xc.T @ dual
    else:
        weights = np.linalg.solve(xc.T @ xc + alpha * np.eye(xc.shape[1]), xc.T @ yc)
    return weights, y_mean - x_mean @ weights


def fit_ridge(m: Moments, width: int, n_cells: int, alpha: float = 1.0) -> tuple[Predictor, bool]:
    mean, scale = m.mean[:width], _scales(m.mean[:width], m.scatter[:width, :width], m.n)
    gram = m.scatter[:width, :width] / np.outer(scale, scale)
    weights = _penalised(gram, m.scatter[:width, width:] / scale[:, None], alpha, m.n)
    return lambda use: ((use - mean) / scale) @ weights + m.mean[width:], True


def fit_har_factor(m: Moments, width: int, n_cells: int, n_factors: int = 5,
                   alpha: float = 1.0) -> tuple[Predictor, bool]:
    """Principal factors of the log surface, regressed on the lagged surfaces' factors."""
    centre = m.mean[width:]
    axes = np.linalg.eigh(m.scatter[width:, width:])[1]
    basis = axes[:, ::-1][:, : int(n_factors)].T
    blocks = np.kron(np.eye(width // n_cells), basis.T)  # projects each lagged surface
    mean = (m.mean[:width] - np.tile(centre, width // n_cells)) @ blocks
    scatter = blocks.T @ m.scatter[:width, :width] @ blocks
    scale = _scales(mean, scatter, m.n)
    cross = blocks.T @ m.scatter[:width, width:] @ basis.T
    weights = _penalised(scatter / np.outer(scale, scale), cross / scale[:, None], alpha, m.n)

    def predict(use: np.ndarray) -> np.ndarray:
        factors = (use - np.tile(centre, width // n_cells)) @ blocks
        return (((factors - mean) / scale) @ weights) @ basis + centre

    return predict, True


def _gap(weights, gram, cross, energy, l1, l2):
    """Duality gap of the multi-task elastic net at the given weights."""
    dual = cross - gram @ weights - l2 * weights
    dual_norm = float(np.sqrt((dual * dual).sum(axis=1)).max(initial=0.0))
    agreement = float((weights * cross).sum())
    residual = energy - 2.0 * agreement + float((weights * (gram @ weights)).sum())
    if dual_norm > l1:
        shrink = l1 / dual_norm
        gap = 0.5 * residual * (1.0 + shrink * shrink)
    else:
        shrink, gap = 1.0, residual
    gap += l1 * float(np.sqrt((weights * weights).sum(axis=1)).sum())
    gap -= shrink * (energy - agreement)
    return gap + 0.5 * l2 * (1.0 + shrink * shrink) * float((weights * weights).sum())


def fit_elastic_net(m: Moments, width: int, n_cells: int, alpha: float = 0.01, l1_ratio: float = 0.1,
                    max_iter: int = 50000, tol: float = 1.0e-4) -> tuple[Predictor, bool]:
    """Multi-task elastic net by accelerated proximal gradient on the Gram matrix.

    Minimises |y - xw|^2 / 2n + alpha l1 sum_j |w_j|_2 + alpha (1 - l1) |w|^2 / 2 and has
    converged when the duality gap is at most tol |y|^2.
    """
    n, mean, y_mean = m.n, m.mean[:width], m.mean[width:]
    scale = _scales(mean, m.scatter[:width, :width], n)
    gram = m.scatter[:width, :width] / np.outer(scale, scale)
    cross = m.scatter[:width, width:] / scale[:, None]
    l1, l2 = alpha * l1_ratio * n, alpha * (1.0 - l1_ratio) * n

    def predict(weights: np.ndarray) -> Predictor:
        return lambda use: ((use - mean) / scale) @ weights + y_mean

    if l1 == 0.0:
        return predict(np.linalg.solve(gram + l2 * np.eye(len(gram)), cross)), True
    energy = float(np.trace(m.scatter[width:, width:]))
    steepest = float(np.linalg.eigvalsh(gram)[-1]) + l2
    root = np.sqrt(l2 / steepest)
    momentum = (1.0 - root) / (1.0 + root)
    weights = np.zeros_like(cross)
    ahead = weights
    for step in range(1, int(max_iter) + 1):
        moved = ahead + (cross - gram @ ahead - l2 * ahead) / steepest
        size = np.sqrt((moved * moved).sum(axis=1, keepdims=True))
        kept = np.maximum(1.0 - (l1 / steepest) / np.where(size > 0.0, size, np.inf), 0.0)
        previous, weights = weights, moved * kept
        ahead = weights + momentum * (weights - previous)
        if step % 10 == 0 and _gap(weights, gram, cross, energy, l1, l2) <= tol * energy:
            return predict(weights), True
    converged = _gap(weights, gram, cross, energy, l1, l2) <= tol * energy
    return predict(weights), bool(converged)


def _features(x: np.ndarray, lags: np.ndarray, n_cells: int) -> np.ndarray:
    return x


def _lagged_surfaces(x: np.ndarray, lags: np.ndarray, n_cells: int) -> np.ndarray:
    return lags[:, : 3 * n_cells]


#: What a fit reads of each row; learners of one kind share their moments.
DESIGNS = {"features": _features, "lagged_surfaces": _lagged_surfaces}
LINEAR_MODELS = {"ridge": ("features", fit_ridge), "elasticnet": ("features", fit_elastic_net),
                 "har_factor": ("lagged_surfaces", fit_har_factor)}


def _at_once(model: str):
    """Fit on whole arrays and predict others."""
    kind, fit = LINEAR_MODELS[model]

    def run(x, lags, y, x_use, lags_use, n_cells, *args, **params):
        design = DESIGNS[kind](x, lags, n_cells)
        predict, converged = fit(Moments.of(np.hstack([design, y])), design.shape[1], n_cells,
                                 *args, **params)
        return predict(DESIGNS[kind](x_use, lags_use, n_cells)), converged

    return run


ridge, elastic_net, har_factor = (_at_once(k) for k in ("ridge", "elasticnet", "har_factor"))
