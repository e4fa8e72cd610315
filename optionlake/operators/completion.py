"""Deterministic completion of partly observed surfaces.

Each row holds one whole surface (a bounded array), so completion is a narrow, shuffle-free
Arrow UDF. Inside a batch every line of every surface is filled at once with NumPy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.grid import SurfaceGrid

STATUS_NAMES = (N.MISSING, N.OBSERVED, N.INTERPOLATED, N.EXTRAPOLATED)
_MISSING, _OBSERVED, _INTERPOLATED, _EXTRAPOLATED = range(4)


def _end_slope(h0, h1, d0, d1):
    """One-sided three-point slope, limited so the curve keeps the data's monotonicity."""
    slope = ((2.0 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    overshoot = (np.sign(d0) != np.sign(d1)) & (np.abs(slope) > 3.0 * np.abs(d0))
    slope = np.where(overshoot, 3.0 * d0, slope)
    return np.where(np.sign(slope) != np.sign(d0), 0.0, slope)


def _knot_slopes(h, d, knots):
    """Fritsch-Carlson slopes of lines whose first `knots` points are the data."""
    n, last = h.shape[0], h.shape[1]
    slopes = np.zeros((n, last + 1))
    h_left, h_right, d_left, d_right = h[:, :-1], h[:, 1:], d[:, :-1], d[:, 1:]
    w_left, w_right = 2.0 * h_right + h_left, h_right + 2.0 * h_left
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = (w_left + w_right) / (w_left / d_left + w_right / d_right)
    flat = (np.sign(d_left) != np.sign(d_right)) | (d_left == 0.0) | (d_right == 0.0)
    slopes[:, 1:-1] = np.where(flat, 0.0, inner)

    rows = np.arange(n)
    two = knots == 2
    end = knots - 1
    second = np.minimum(1, last - 1)
    first_slope = _end_slope(h[:, 0], h[:, second], d[:, 0], d[:, second])
    last_slope = _end_slope(h[rows, end - 1], h[rows, np.maximum(end - 2, 0)],
                            d[rows, end - 1], d[rows, np.maximum(end - 2, 0)])
    slopes[:, 0] = np.where(two, d[:, 0], first_slope)
    slopes[rows, end] = np.where(two, d[:, 0], last_slope)
    return slopes


def _fill_lines(x, values, status):
    """Fill the gaps of (lines, points) arrays in place along the points axis."""
    known = np.isfinite(values)
    knots = known.sum(axis=1)
    single = np.flatnonzero((knots == 1) & (values.shape[1] > 1))
    if single.size:
        only = values[single, known[single].argmax(axis=1)]
        gaps = ~known[single]
        values[single] = np.where(gaps, only[:, None], values[single])
        status[single] = np.where(gaps, _EXTRAPOLATED, status[single])

    lines = np.flatnonzero((knots >= 2) & (knots < values.shape[1]))
    if not lines.size:
        return
    y, seen, k = values[lines], known[lines], knots[lines]
    order = np.argsort(~seen, axis=1, kind="stable")
    xs, ys = x[order], np.take_along_axis(y, order, axis=1)
    spare = np.arange(x.size - 1)[None, :] >= (k - 1)[:, None]
    h = np.where(spare, 1.0, np.diff(xs, axis=1))
    d = np.where(spare, 0.0, np.diff(ys, axis=1) / h)
    slopes = _knot_slopes(h, d, k)

    rows = np.arange(lines.size)[:, None]
    left = np.clip(np.cumsum(seen, axis=1) - 1, 0, (k - 2)[:, None])
    step, secant = h[rows, left], d[rows, left]
    s0, s1 = slopes[rows, left], slopes[rows, left + 1]
    u = x[None, :] - xs[rows, left]
    curve = ys[rows, left] + u * (
        s0 + u * ((3.0 * secant - 2.0 * s0 - s1) / step
                  + u * ((s0 + s1 - 2.0 * secant) / (step * step))))
    last_x, last_y = xs[rows, (k - 1)[:, None]], ys[rows, (k - 1)[:, None]]
    below, above = x[None, :] < xs[:, :1], x[None, :] > last_x
    filled = np.where(below, ys[:, :1], np.where(above, last_y, curve))
    values[lines] = np.where(seen, y, filled)
    kind = np.where(below | above, _EXTRAPOLATED, _INTERPOLATED)
    status[lines] = np.where(seen, status[lines], kind)


def complete_batch(observed, mask, grid: SurfaceGrid, order, cycles, floor):
    """Complete a (surfaces, cells) batch; returns values and status codes."""
    shape = (observed.shape[0], grid.n_maturities, grid.n_moneyness)
    values = np.where(mask, observed, np.nan).reshape(shape)
    status = np.where(mask, _OBSERVED, _MISSING).astype(np.int8).reshape(shape)
    axes = {"maturity": np.asarray(grid.maturity_years),
            "moneyness": np.asarray(grid.moneyness_points)}
    for axis in tuple(order) * cycles:
        swap = axis == "maturity"
        lines = np.ascontiguousarray(values.swapaxes(1, 2) if swap else values)
        states = np.ascontiguousarray(status.swapaxes(1, 2) if swap else status)
        flat = (lines.shape[0] * lines.shape[1], lines.shape[2])
        _fill_lines(axes[axis], lines.reshape(flat), states.reshape(flat))
        values = lines.swapaxes(1, 2) if swap else lines
        status = states.swapaxes(1, 2) if swap else states
    if not np.isfinite(values).all():
        raise ValueError("surface completion left cells without a value")
    flat = (shape[0], grid.n_cells)
    return np.maximum(values, floor).reshape(flat), status.reshape(flat)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat).reshape(len(column), width)


def _rows(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def complete(observed: Column, mask: Column, grid: SurfaceGrid, order: tuple[str, ...],
             cycles: int, floor: float) -> Column:
    """Struct of completed total variances and status codes for each surface array.

    Lines of cells are filled along each axis of `order`, `cycles` times: monotone cubic
    between known cells, flat beyond them. The first fill decides a cell's status.
    """
    width = grid.n_cells

    @F.arrow_udf("struct<total_variance:array<double>,status:array<tinyint>>")
    def fill(values: pa.Array, seen: pa.Array) -> pa.Array:
        if len(values) == 0:
            empty = np.empty((0, width))
            parts = [_rows(empty), _rows(empty.astype(np.int8))]
        else:
            known = _matrix(seen, width).astype(bool)
            observed_values = _matrix(values, width).astype(np.float64)
            parts = [_rows(m) for m in complete_batch(observed_values, known, grid, order,
                                                      cycles, floor)]
        return pa.StructArray.from_arrays(parts, ["total_variance", "status"])

    return fill(F.transform(observed, lambda v: F.coalesce(v, F.lit(float("nan")))), mask)


def status_names(codes: Column) -> Column:
    names = F.array(*[F.lit(name) for name in STATUS_NAMES])
    return F.transform(codes, lambda code: F.element_at(names, code.cast("int") + 1))
