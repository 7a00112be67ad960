"""Linear models from moments: one pass over the rows serves every split and every penalty.

A pass adds up, for each fold, n, the sums of x and y, and the products X'X, X'y and
y'y.  The training rows of a split are all rows less its fold, so their moments are
total minus fold, and each penalty is solved from those: ridge from one
eigendecomposition a split, the elastic net by coordinate descent on X'X.  A second
pass gives every row's predictions by every fitted model of its fold.

Sums are taken about an origin (one row of the data), so columns far from zero keep
their precision.  X'X is d x d on the driver and in a task, so this way is for at
most GRAM_COLUMNS columns; ``scorewell.operators.wide`` is for wider data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.operators.summed import tree_sum
from scorewell.session import map_arrow

#: Most columns (or rows) whose products are held as one matrix: 32 MB.
GRAM_COLUMNS = 2048
#: Rows of a dense block.
BLOCK_ROWS = 1024
#: Penalties up to which each is solved by itself.
FEW_PENALTIES = 3
#: Sweeps of coordinate descent before the closed form of its signs is tried.
SWEEPS_AT_ONCE = 50
#: A variance below this share of the mean square is rounding: the column is constant.
CONSTANT = 1e-13


@dataclass
class Moments:
    """Sums over some rows, taken about ``origin``."""

    n: float
    y: float
    yy: float
    x: np.ndarray
    xy: np.ndarray
    xx: np.ndarray
    origin: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(
            self.n - other.n, self.y - other.y, self.yy - other.yy, self.x - other.x, self.xy - other.xy,
            self.xx - other.xx, self.origin,
        )

    def columns(self, keep: np.ndarray) -> Moments:
        """The moments of some of the columns."""
        return Moments(self.n, self.y, self.yy, self.x[keep], self.xy[keep], self.xx[np.ix_(keep, keep)], self.origin[keep])


@dataclass
class Standardized:
    """What the solvers need: centred products of columns divided by their population std."""

    n: float
    mean: np.ndarray
    std: np.ndarray  # 1 for a constant column, whose products are 0
    y_mean: float
    y_std: float
    gram: np.ndarray
    xy: np.ndarray


@dataclass
class Linear:
    """``weights`` are for columns divided by ``std`` (not centred); ``intercept`` goes with them."""

    weights: np.ndarray
    intercept: float
    std: np.ndarray
    mean: np.ndarray
    y_mean: float

    @property
    def raw(self) -> np.ndarray:
        return self.weights / self.std


def standardized(m: Moments) -> Standardized:
    n = max(m.n, 1.0)
    shift = m.x / n
    cov = m.xx - n * np.outer(shift, shift)
    var = np.diag(cov) / n
    live = var > CONSTANT * np.maximum(np.diag(m.xx) / n, 1e-300)
    std = np.where(live, np.sqrt(np.where(live, var, 1.0)), 1.0)
    scale = np.where(live, 1.0 / std, 0.0)
    y_mean = m.y / n
    xy = (m.xy - m.x * y_mean) * scale
    return Standardized(
        m.n, shift + m.origin, std, y_mean, float(np.sqrt(max(m.yy / n - y_mean**2, 0.0))), cov * np.outer(scale, scale), xy
    )


def _model(s: Standardized, w: np.ndarray) -> Linear:
    return Linear(w, float(s.y_mean - w @ (s.mean / s.std)), s.std, s.mean, s.y_mean)


def ridge(m: Moments, alphas: list[float]) -> list[Linear]:
    """The ridge solution (intercept not penalized) of each penalty; many come from one eigendecomposition."""
    s = standardized(m)
    if len(alphas) <= FEW_PENALTIES and min(alphas, default=0) > 0:
        one = np.eye(len(s.xy))
        return [_model(s, np.linalg.solve(s.gram + a * one, s.xy)) for a in alphas]
    values, vectors = np.linalg.eigh(s.gram)
    along = vectors.T @ s.xy
    values = np.maximum(values, 0.0)
    return [_model(s, vectors @ (along / (values + a)) if a > 0 else np.linalg.pinv(s.gram) @ s.xy) for a in alphas]


def descend(gram: np.ndarray, xy: np.ndarray, n: float, a1: float, a2: float, w: np.ndarray, scale: float, sweeps: int) -> np.ndarray:
    """Coordinate descent for |y - Xw|^2 / 2n + a1 |w|_1 + a2 |w|^2 / 2 from the products; ``w`` is the start.

    Works on the coordinates that break the optimality conditions by more than 1e-8 of
    ``scale`` (the label's deviation) until none does; ``sweeps`` bounds the passes in all.
    """
    slack, diag = 1e-8 * scale, np.diag(gram) / n
    active = np.flatnonzero(w)
    while sweeps > 0:
        g = (xy - gram @ w) / n
        off = np.where(w != 0, np.abs(g - a2 * w - a1 * np.sign(w)), np.abs(g) - a1) > slack
        wrong = np.flatnonzero(off & (diag > 0))
        if not len(wrong):
            break
        active = np.union1d(np.union1d(active, np.flatnonzero(w)), wrong)
        c, here, part = gram[np.ix_(active, active)] / n, g[active], w[active].tolist()
        own = diag[active].tolist()
        for _ in range(min(sweeps, SWEEPS_AT_ONCE)):
            sweeps -= 1
            moved = 0.0
            for k, old in enumerate(part):
                rho = here[k] + own[k] * old
                new = (rho - a1 if rho > a1 else rho + a1 if rho < -a1 else 0.0) / (own[k] + a2)
                if new != old:
                    here -= c[k] * (new - old)
                    part[k] = float(new)
                    moved = max(moved, abs(new - old))
            if moved <= 0.01 * slack:
                break
        w[active] = part
        # (nearly) equal columns move slowly against each other; with these signs the weights have a closed form
        live = np.flatnonzero(w)
        if a2 > 0 and len(live) <= GRAM_COLUMNS:
            signs = np.sign(w[live])
            exact = np.linalg.solve(gram[np.ix_(live, live)] / n + a2 * np.eye(len(live)), xy[live] / n - a1 * signs)
            if np.array_equal(np.sign(exact), signs):
                w[live] = exact
    return w


def elastic_net(m: Moments, alpha: float, l1_ratio: float, sweeps: int = 5000) -> Linear:
    """Minimum of |y - Xw|^2 / 2n + alpha (l1 |w|_1 + (1 - l1) |w|^2 / 2) on the scaled columns."""
    s = standardized(m)
    w = descend(s.gram, s.xy, s.n, alpha * l1_ratio, alpha * (1 - l1_ratio), np.zeros(len(s.xy)), max(s.y_std, 1e-300), sweeps)
    return _model(s, w)


def fold_moments(rows: DataFrame, matrix, width: int, folds: int, origin: np.ndarray) -> list[Moments]:
    """Moments of the rows of each fold 0 .. folds - 1, and of the rows of none, which come last.

    ``rows`` has the columns fold (null: none), y and those that ``matrix(batch)`` turns
    into a (rows, width) array.  Rows without a label take no part.
    """
    size = 3 + 2 * width + width * width

    def partial(batch):
        out = np.zeros((folds + 1, size))
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            some = batch.slice(at, BLOCK_ROWS)
            fold = some.column(0).fill_null(folds).to_numpy(zero_copy_only=False)
            y = some.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)
            x = matrix(some) - origin
            for f in np.unique(fold):
                mine = (fold == f) & ~np.isnan(y)
                xf, yf = x[mine], y[mine]
                out[f, :3] += len(yf), yf.sum(), yf @ yf
                out[f, 3 : 3 + width] += xf.sum(axis=0)
                out[f, 3 + width : 3 + 2 * width] += xf.T @ yf
                out[f, 3 + 2 * width :] += (xf.T @ xf).ravel()
        return out.ravel()

    flat = tree_sum(rows, partial, (folds + 1) * size).reshape(folds + 1, size)
    return [
        Moments(r[0], r[1], r[2], r[3 : 3 + width], r[3 + width : 3 + 2 * width], r[3 + 2 * width :].reshape(width, width), origin)
        for r in flat
    ]


def total(parts: list[Moments]) -> Moments:
    add = lambda name: sum(getattr(p, name) for p in parts)
    return Moments(add("n"), add("y"), add("yy"), add("x"), add("xy"), add("xx"), parts[0].origin)


def fold_predictions(rows: DataFrame, matrix, models: list[list[tuple[np.ndarray, float]]], id_col: str) -> DataFrame:
    """(split, id, y, trial, p): every row of a fold by each of that fold's models.

    ``rows`` as in ``fold_moments`` with the id as its last column; ``models[fold]`` lists
    (weights on the raw columns, intercept).
    """
    stacked = [(np.stack([w for w, _ in m], axis=1), np.array([b for _, b in m])) for m in models]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                some = some.filter(some.column(0).is_valid())
                if not some.num_rows:
                    continue
                fold = some.column(0).to_numpy(zero_copy_only=False)
                x = matrix(some)
                p = np.empty((some.num_rows, len(models[0])))
                for f in np.unique(fold):
                    w, b = stacked[f]
                    p[fold == f] = x[fold == f] @ w + b
                offsets = np.arange(some.num_rows + 1, dtype=np.int32) * p.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(batch.num_columns - 1), some.column(1),
                     pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))],
                    ["split", id_col, "y", "ps"],
                )

    kind = rows.schema[id_col].dataType.simpleString()
    made = map_arrow(rows, run, f"split int, `{id_col}` {kind}, y double, ps array<double>")
    return made.select("split", id_col, "y", F.posexplode("ps").alias("trial", "p"))
