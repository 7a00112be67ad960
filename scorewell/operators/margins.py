"""E5: squared-hinge classifiers and their sigmoids by Newton steps on sums over the rows.

One pass over the rows serves every class of every calibration fold: it adds up each
problem's loss, gradient and Hessian at its current point, and the driver takes a Newton
step (halved while the loss would rise).  The squared hinge is piecewise quadratic, so
a few passes reach the minimum; numbers per pass are problems x (d + 1)^2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from scorewell.operators.summed import tree_sum

MAX_PASSES = 200
#: Numbers a pass may hand over at once; more problems go in several passes.
NUMBERS = 1 << 22


@dataclass
class Problem:
    """Class ``cls`` against the rest on the rows outside ``fold``, with the rows' costs by side."""

    fold: int
    cls: int
    cost_in: float
    cost_out: float


def _rows(batch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
    fold, cls = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
    return fold, cls, np.hstack([x, np.ones((len(x), 1))])


def _newton(sums, start: np.ndarray, own_loss, own_gradient, own_hessian, tol: float) -> np.ndarray:
    """Minimize each row of ``start``; ``sums(points)`` gives (loss, gradient, Hessian) over the data."""
    at, size = start.copy(), start.shape[1]
    step = np.zeros_like(at)
    loss = np.full(len(at), np.inf)
    done = np.zeros(len(at), bool)
    first = None
    for _ in range(MAX_PASSES):
        trial = at + step
        todo = np.flatnonzero(~done)
        data = sums(trial[todo], todo)
        g = np.zeros_like(at)
        for k, (f, grad, hess) in zip(todo, data):
            f = f + own_loss(trial[k])
            g[k] = grad + own_gradient(trial[k])
            if f > loss[k] + 1e-12 * max(abs(loss[k]), 1.0) and np.abs(step[k]).max() > 1e-14:
                step[k] /= 2
                continue
            at[k], loss[k] = trial[k], f
            step[k] = -np.linalg.solve(hess + own_hessian(size), g[k])
            norm = np.linalg.norm(g[k])
            if first is None:
                first = np.full(len(at), -1.0)
            if first[k] < 0:
                first[k] = max(norm, 1e-300)
            # a gradient of 0, or a step too small to change the point
            done[k] = norm <= tol * first[k] or np.abs(step[k]).max() <= 1e-14 * max(np.abs(at[k]).max(), 1e-300)
        if done.all():
            return at
    raise RuntimeError(f"no convergence in {MAX_PASSES} passes")


def squared_hinge(rows: DataFrame, width: int, problems: list[Problem], tol: float = 1e-8) -> np.ndarray:
    """(problems, width + 1) weights, the intercept last (penalized like a weight).

    Minimum of |w|^2 / 2 + sum of cost * max(0, 1 - y w.x)^2 over ``rows`` (fold, cls, x).
    """
    out = np.zeros((len(problems), width + 1))
    at_once = max(1, NUMBERS // (width + 1) ** 2)
    for a in range(0, len(problems), at_once):
        some = problems[a : a + at_once]

        def sums(points, which, some=some):
            mine = [some[k] for k in which]
            fold, cls = (np.array([getattr(p, c) for p in mine]) for c in ("fold", "cls"))
            cost = np.array([(p.cost_out, p.cost_in) for p in mine])
            d, k = width + 1, len(mine)

            def partial(batch):
                of, is_, x = _rows(batch, width)
                side = is_[:, None] == cls
                y = np.where(side, 1.0, -1.0)
                slack = 1.0 - y * (x @ points.T)
                c = np.where(side, cost[:, 1], cost[:, 0]) * ((slack > 0) & (of[:, None] != fold))
                hess = np.empty((k, d, d))
                for j in range(k):
                    on = np.flatnonzero(c[:, j])
                    hess[j] = 2 * (x[on] * c[on, j : j + 1]).T @ x[on]
                return np.concatenate([(c * slack * slack).sum(axis=0), (-2 * x.T @ (c * y * slack)).T.ravel(), hess.ravel()])

            return _unpacked(tree_sum(rows, partial, k * (1 + d + d * d)), k, d)

        out[a : a + len(some)] = _newton(
            sums, out[a : a + len(some)], lambda w: w @ w / 2, lambda w: w, np.eye, tol
        )
    return out


def _unpacked(flat: np.ndarray, k: int, d: int) -> list[tuple]:
    return list(zip(flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d :].reshape(k, d, d)))


def sigmoids(rows: DataFrame, width: int, problems: list[Problem], weights: np.ndarray, counts: dict) -> np.ndarray:
    """(a, b) of each problem: p = 1 / (1 + exp(-(a m + b))) fitted on the margins of its held-out fold.

    ``counts[(fold, cls)]`` are rows.  Targets are (N+ + 1) / (N+ + 2) and 1 / (N- + 2).
    """
    targets = []
    for p in problems:
        n_in = counts.get((p.fold, p.cls), 0)
        n_out = sum(n for (f, _), n in counts.items() if f == p.fold) - n_in
        targets.append((1.0 / (n_out + 2.0), (n_in + 1.0) / (n_in + 2.0)))
    targets = np.array(targets)

    def sums(points, which):
        mine = [problems[k] for k in which]
        fold, cls = (np.array([getattr(p, c) for p in mine]) for c in ("fold", "cls"))
        w, t, k = weights[which], targets[which], len(mine)

        def partial(batch):
            of, is_, x = _rows(batch, width)
            m = x @ w.T
            held = of[:, None] == fold
            goal = np.where(is_[:, None] == cls, t[:, 1], t[:, 0])
            z = m * points[:, 0] + points[:, 1]
            loss = np.logaddexp(0.0, z) - goal * z
            p = 0.5 * (1.0 + np.tanh(0.5 * z))
            r, v = (p - goal) * held, p * (1 - p) * held
            grad = np.stack([(r * m).sum(axis=0), r.sum(axis=0)], axis=1)
            cross = (v * m).sum(axis=0)
            hess = np.stack([(v * m * m).sum(axis=0), cross, cross, v.sum(axis=0)], axis=1)
            return np.concatenate([(loss * held).sum(axis=0), grad.ravel(), hess.ravel()])

        return _unpacked(tree_sum(rows, partial, k * 7), k, 2)

    start = np.zeros((len(problems), 2))
    tiny = 1e-10
    return _newton(sums, start, lambda q: tiny * (q @ q) / 2, lambda q: tiny * q, lambda n: tiny * np.eye(n), 1e-9)
