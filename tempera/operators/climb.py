"""Multi-start quasi-Newton minimisation, all starts of a batch advancing together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tempera.plans.sizing import spread

WALL = 1.0e300  # objective value of an infeasible point
_BAD_GRADIENT = 1.0e15
_MAX_CURVATURE = 1.0e12

CONVERGED, STUCK, OUT_OF_ITERATIONS = 0, 1, 6


def numeric_gradient(f, x: np.ndarray, fx: np.ndarray, step: float) -> np.ndarray:
    """Central differences; one-sided next to a wall; absurd slopes count as zero."""
    g = np.zeros_like(x)
    for j in range(x.shape[1]):
        h = step * np.maximum(1.0, np.abs(x[:, j]))
        up, down = x.copy(), x.copy()
        up[:, j] += h
        down[:, j] -= h
        fu, fd = f(up), f(down)
        slope = np.where(
            fu >= WALL, (fx - fd) / h, np.where(fd >= WALL, (fu - fx) / h, (fu - fd) / (2.0 * h))
        )
        slope = np.where((fu >= WALL) & (fd >= WALL), 0.0, slope)
        g[:, j] = np.where(np.abs(slope) > _BAD_GRADIENT, 0.0, slope)
    return g


def minimise_batch(
    f: Callable[[np.ndarray], np.ndarray],
    x: np.ndarray,
    h0: float,
    crit: float,
    max_iter: int,
    step: float = 1e-6,
    box: tuple[float, float] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimise f from every row of x; returns (x, f, iterations, code)."""
    n, d = x.shape

    def project(y: np.ndarray) -> np.ndarray:
        return y if box is None else np.clip(y, *box)

    def gradient(at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Slope of f; a coordinate held at its bound by the slope does not count."""
        slope = numeric_gradient(f, at, value, step)
        if box is not None:
            slope[((at <= box[0]) & (slope > 0)) | ((at >= box[1]) & (slope < 0))] = 0.0
        return slope

    x = project(x.astype(float))
    fx = f(x)
    g = gradient(x, fx)
    inv = np.repeat(h0 * np.eye(d)[None], n, axis=0)
    iters = np.zeros(n, dtype=int)
    code = np.full(n, OUT_OF_ITERATIONS)
    live = fx < WALL
    code[~live] = STUCK
    for _ in range(max_iter):
        if not live.any():
            break
        iters[live] += 1
        p = -np.einsum("nij,nj->ni", inv, g)
        if box is not None:
            p[g == 0.0] = 0.0
        slope = np.einsum("ni,ni->n", p, g)
        uphill = slope >= 0
        p[uphill], slope[uphill] = -g[uphill], -np.einsum("ni,ni->n", g[uphill], g[uphill])
        # Line search by trial lengths, keeping each row's best.
        best_x, best_f = x.copy(), fx.copy()
        for length in (1.0, 3.0, 9.0, *(1.0 / 3.0**k for k in range(1, 25))):
            open_rows = live & (best_f > fx + 1e-4 * length * slope) if length < 1 else live
            if not open_rows.any():
                break
            y = project(x + length * p)
            fy = np.where(open_rows, f(y), WALL)
            better = fy < best_f
            best_x[better], best_f[better] = y[better], fy[better]
        gain = fx - best_f
        new_g = gradient(best_x, best_f)
        dx, dg = best_x - x, new_g - g
        curvature = np.einsum("ni,ni->n", dx, dg)
        good = curvature > 1.0 / _MAX_CURVATURE
        rho = np.where(good, 1.0 / np.where(good, curvature, 1.0), 0.0)
        left = np.eye(d)[None] - rho[:, None, None] * dx[:, :, None] * dg[:, None, :]
        update = left @ inv @ left.transpose(0, 2, 1) + rho[:, None, None] * dx[:, :, None] * dx[:, None, :]
        reset = np.repeat(h0 * np.eye(d)[None], n, axis=0)
        was_reset = np.abs(inv - reset).max(axis=(1, 2)) == 0
        inv = np.where(good[:, None, None], update, reset)
        x, fx, g = best_x, best_f, new_g
        done = live & (gain < crit)
        # A stall counts only from a fresh inverse Hessian; otherwise try once more from there.
        retry = done & ~was_reset
        inv[retry] = reset[retry]
        code[done & ~retry] = CONVERGED
        live &= ~(done & ~retry)
    return x, fx, iters, code


def hill_climb(
    starts: DataFrame,
    objective: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray],
    h0: float = 1.0,
    crit: float = 1.0e-3,
    max_iter: int = 50,
    box: tuple[float, float] | None = None,
) -> DataFrame:
    """One minimisation per row (id, start, parameters...); infeasible results are kept out."""
    extra = [c for c in starts.columns if c not in ("id", "start")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf.empty:
                continue
            params = {c: np.stack(pdf[c].to_numpy()) if pdf[c].dtype == object else pdf[c].to_numpy() for c in extra}

            def f(x: np.ndarray) -> np.ndarray:
                return np.minimum(np.nan_to_num(objective(x, params), nan=WALL, posinf=WALL), WALL)

            x0 = np.stack(pdf["start"].to_numpy()).astype(float)
            x, fx, iters, code = minimise_batch(f, x0, h0, crit, max_iter, box=box)
            out = pd.DataFrame({"id": pdf["id"], "data": list(x), "objective": fx, "iterations": iters, "code": code})
            yield out[fx < WALL]

    return spread(starts, "id").mapInPandas(run, "id long, data array<double>, objective double, iterations int, code int")
