"""E5: squared hinge and sigmoids against plain numpy."""

import numpy as np
import pytest

from scorewell.operators.margins import Problem, sigmoids, squared_hinge


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, size=120)
    x = np.eye(3, 4)[y] * 2 + rng.normal(size=(120, 4))
    rows = [(int(i % 3), int(y[i]), [float(v) for v in x[i]]) for i in range(120)]
    return spark.createDataFrame(rows, "fold int, cls int, x array<double>").repartition(4), x, y, np.arange(120) % 3


def test_gradients_are_zero(data):
    df, x, y, fold = data
    problems = [Problem(f, c, 2.0 + c, 0.5) for f in range(3) for c in range(3)]
    w = squared_hinge(df, 4, problems)
    x1 = np.hstack([x, np.ones((120, 1))])
    for p, v in zip(problems, w):
        side = np.where(y == p.cls, 1.0, -1.0)
        slack = np.maximum(1 - side * (x1 @ v), 0) * (fold != p.fold)
        cost = np.where(y == p.cls, p.cost_in, p.cost_out)
        assert np.abs(v - 2 * x1.T @ (cost * side * slack)).max() < 1e-6


def test_sigmoids_fit_held_out_margins(data):
    df, x, y, fold = data
    problems = [Problem(f, c, 1.0, 1.0) for f in range(3) for c in range(3)]
    w = squared_hinge(df, 4, problems)
    counts = {(f, c): int(((fold == f) & (y == c)).sum()) for f in range(3) for c in range(3)}
    ab = sigmoids(df, 4, problems, w, counts)
    for p, v, (a, b) in zip(problems, w, ab):
        held = fold == p.fold
        m = np.hstack([x, np.ones((120, 1))])[held] @ v
        pos = y[held] == p.cls
        t = np.where(pos, (pos.sum() + 1) / (pos.sum() + 2), 1 / ((~pos).sum() + 2))
        r = 1 / (1 + np.exp(-(a * m + b))) - t
        assert abs(r.sum()) < 1e-6 and abs((r * m).sum()) < 1e-6 and a > 0
