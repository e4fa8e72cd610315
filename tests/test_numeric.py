"""Array-level kernels against brute force and known vectors; no Spark."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from optionlake.functions.grid import SurfaceGrid
from optionlake.operators import compare, learners
from optionlake.operators.completion import STATUS_NAMES, complete_batch

ORDER = ("maturity", "moneyness")


def complete(values, grid, mask=None, order=ORDER, cycles=2):
    values = np.asarray(values, dtype=float).reshape(1, -1)
    known = np.isfinite(values) if mask is None else np.asarray(mask, bool).reshape(1, -1)
    w, status = complete_batch(values, known, grid, order, cycles, 1e-8)
    return w[0], [STATUS_NAMES[s] for s in status[0]]


def test_line_vector():
    nan = math.nan
    grid = SurfaceGrid((30,), (-0.2, -0.1, 0.0, 0.1, 0.2))
    w, status = complete([nan, 0.02, nan, 0.04, nan], grid, order=("moneyness", "maturity"))
    assert w == pytest.approx([0.02, 0.02, 0.03, 0.04, 0.04])
    edge = "extrapolated_boundary_fill"
    assert status == [edge, "observed", "interpolated", "observed", edge]


def test_off_mask_value_is_ignored():
    grid = SurfaceGrid((30,), (-0.1, 0.0, 0.1))
    w, _ = complete([0.01, 999.0, 0.03], grid, [True, False, True])
    assert w == pytest.approx([0.01, 0.02, 0.03])


def test_empty_surface_fails():
    with pytest.raises(ValueError, match="without a value"):
        complete([math.nan] * 4, SurfaceGrid((30, 60), (0.0, 0.1)))


def hermite_line(x, y):
    """Monotone cubic fill of one line, written point by point."""
    xs = [a for a, b in zip(x, y) if np.isfinite(b)]
    ys = [b for b in y if np.isfinite(b)]
    n = len(xs)
    if n == 0:
        return list(y)
    if n == 1:
        return [ys[0]] * len(x)
    h = [b - a for a, b in zip(xs, xs[1:])]
    d = [(b - a) / g for a, b, g in zip(ys, ys[1:], h)]

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(s) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s

    if n == 2:
        slope = [d[0], d[0]]
    else:
        slope = [end(h[0], h[1], d[0], d[1])]
        for i in range(1, n - 1):
            a, b = d[i - 1], d[i]
            w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            slope.append(0.0 if a * b <= 0 else (w1 + w2) / (w1 / a + w2 / b))
        slope.append(end(h[-1], h[-2], d[-1], d[-2]))
    out = []
    for a, b in zip(x, y):
        if np.isfinite(b):
            out.append(b)
        elif a < xs[0]:
            out.append(ys[0])
        elif a > xs[-1]:
            out.append(ys[-1])
        else:
            i = max(j for j in range(n - 1) if xs[j] <= a)
            t = (a - xs[i]) / h[i]
            out.append((1 + 2 * t) * (1 - t) ** 2 * ys[i] + t * (1 - t) ** 2 * h[i] * slope[i]
                       + t * t * (3 - 2 * t) * ys[i + 1] + t * t * (t - 1) * h[i] * slope[i + 1])
    return out


cells = st.lists(st.one_of(st.none(), st.floats(1e-3, 1.0)), min_size=20, max_size=20).filter(
    lambda v: any(c is not None for c in v))


@settings(max_examples=150, deadline=None)
@given(cells, st.sampled_from([ORDER, ORDER[::-1]]))
def test_completion_equals_line_by_line(values, order):
    grid = SurfaceGrid((7, 30, 91, 364), (-0.3, -0.1, 0.0, 0.1, 0.3))
    surface = np.array([math.nan if v is None else v for v in values]).reshape(4, 5)
    got, status = complete(surface, grid, order=order)
    expected = surface.copy()
    for axis in order * 2:
        for i in range(5 if axis == "maturity" else 4):
            if axis == "maturity":
                expected[:, i] = hermite_line(grid.maturity_years, expected[:, i])
            else:
                expected[i] = hermite_line(grid.moneyness_points, expected[i])
    assert got == pytest.approx(expected.reshape(-1), rel=1e-12)
    observed = np.isfinite(surface.reshape(-1))
    assert (got[observed] == surface.reshape(-1)[observed]).all()
    assert [s == "observed" for s in status] == list(observed)


def data(n=60, p=6, k=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * rng.uniform(0.1, 5.0, p) + 2.0
    y = x @ rng.normal(size=(p, k)) * 0.1 + rng.normal(size=(n, k)) * 0.05 - 3.0
    return x, y


@pytest.mark.parametrize("shape", [(60, 6), (5, 12)])
def test_ridge_minimises_its_objective(shape):
    x, y = data(*shape)
    z, _ = learners.standardise(x, x)
    weights, intercept = learners.ridge_weights(z, y, 2.0)

    def objective(w, b):
        r = y - z @ w - b
        return (r * r).sum() + 2.0 * (w * w).sum()

    best = objective(weights, intercept)
    rng = np.random.default_rng(1)
    for _ in range(20):
        assert objective(weights + 1e-3 * rng.normal(size=weights.shape), intercept) > best
    assert intercept == pytest.approx(y.mean(axis=0))


def test_ridge_without_penalty_recovers_a_linear_map():
    x, _ = data()
    y = x @ np.arange(24.0).reshape(6, 4) + 1.0
    predicted, ok = learners.ridge(x, None, y, x[:5], None, 4, alpha=1e-10)
    assert ok and predicted == pytest.approx(y[:5], rel=1e-6)


def test_constant_features_do_not_break_scaling():
    x, y = data()
    x[:, 2] = 7.0
    predicted, _ = learners.ridge(x, None, y, x, None, 4)
    assert np.isfinite(predicted).all()


def test_elastic_net_zero_when_penalty_is_large_and_ridge_like_when_small():
    x, y = data()
    predicted, ok = learners.elastic_net(x, None, y, x, None, 4, alpha=100.0, l1_ratio=0.9)
    assert ok and predicted == pytest.approx(np.tile(y.mean(axis=0), (60, 1)))
    n = x.shape[0]
    net, ok = learners.elastic_net(x, None, y, x, None, 4, alpha=0.05, l1_ratio=0.0, tol=1e-12)
    same, _ = learners.ridge(x, None, y, x, None, 4, alpha=0.05 * n)
    assert ok and net == pytest.approx(same, abs=1e-5)


def test_elastic_net_satisfies_the_optimality_conditions():
    x, y = data(seed=3)
    z, _ = learners.standardise(x, x)
    target = y - y.mean(axis=0)
    alpha, ratio, n = 0.02, 0.5, x.shape[0]
    fitted, ok = learners.elastic_net(x, None, y, x, None, 4, alpha, ratio, tol=1e-9)
    weights = np.linalg.lstsq(z, fitted - y.mean(axis=0), rcond=None)[0]
    gradient = z.T @ (target - z @ weights) / n - alpha * (1 - ratio) * weights
    norms = np.sqrt((gradient * gradient).sum(axis=1))
    assert ok and (norms <= alpha * ratio * 1.01).all()


def test_har_factor_with_all_factors_is_ridge_on_lag_factors():
    rng = np.random.default_rng(5)
    lags, y = rng.normal(size=(80, 12)), rng.normal(size=(80, 4))
    full, _ = learners.har_factor(None, lags, y, None, lags, 4, n_factors=4, alpha=1e-9)
    design = np.column_stack([lags, np.ones(80)])
    ols = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert full == pytest.approx(ols, abs=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 40), st.integers(1, 7), st.integers(0, 1000))
def test_replication_means_equal_explicit_samples(n, block, seed):
    losses = np.random.default_rng(seed).normal(size=(3, n))
    blocks = -(-n // block)
    for source in compare.INDEX_SOURCES.values():
        starts = source(n, blocks, 5, seed)
        assert starts.shape == (5, blocks) and starts.min() >= 0 and starts.max() < n
        got = compare.replication_means(losses, starts, block)
        for r in range(5):
            index = np.concatenate([(s + np.arange(block)) % n for s in starts[r]])[:n]
            assert got[:, r] == pytest.approx(losses[:, index].mean(axis=1))


@pytest.mark.parametrize("rows", [12, 60])
@pytest.mark.parametrize("model, params", [
    ("ridge", {"alpha": 2.0}), ("har_factor", {"n_factors": 2, "alpha": 1.0}),
    ("elasticnet", {"alpha": 0.02, "l1_ratio": 0.3, "tol": 1e-10})])
def test_fits_from_added_moments_equal_fits_of_all_rows(model, params, rows):
    rng = np.random.default_rng(rows)
    x = 1e4 + rng.normal(size=(rows, 15)) * np.geomspace(1e-3, 10.0, 15)
    lags, y = rng.normal(size=(rows, 12)), rng.normal(size=(rows, 4))
    x[:, 3] = 7.0                                                   # a constant column
    kind, fit = learners.LINEAR_MODELS[model]
    design = learners.DESIGNS[kind](x, lags, 4)
    joined = np.hstack([design, y])
    known = learners.Moments.of(joined[:0])
    for part in np.split(joined, [1, 5, 5, rows - 2]):
        known = known.plus(learners.Moments.of(part))
    predict, _ = fit(known, design.shape[1], 4, **params)
    direct = {"ridge": learners.ridge, "har_factor": learners.har_factor,
              "elasticnet": learners.elastic_net}[model]
    np.testing.assert_allclose(predict(design), direct(x, lags, y, x, lags, 4, **params)[0],
                               rtol=1e-6, atol=1e-8)


def test_ridge_from_moments_solves_the_normal_equations():
    rng = np.random.default_rng(8)
    for n in (9, 80):
        x, y = 50.0 + rng.normal(size=(n, 12)), rng.normal(size=(n, 4))
        z, use = learners.standardise(x, rng.normal(size=(3, 12)) + 50.0)
        weights, intercept = learners.ridge_weights(z, y, 0.7)
        fresh = use * x.std(axis=0) + x.mean(axis=0)
        got, _ = learners.ridge(x, None, y, fresh, None, 4, 0.7)
        np.testing.assert_allclose(got, use @ weights + intercept, rtol=1e-7, atol=1e-9)
