"""C11: principal components of a vector column, one method for every width.

``ml.feature.PCA`` forms the d x d covariance on the driver (19,264 genes -> about
3 GB).  This block Krylov method never does: with the centred rows C'C = (X -
mu)'(X - mu), each pass multiplies one block of l = min(n, d, 2k + 10) directions
by C'C, adds the result to an orthonormal basis, and solves the small projected
eigenproblem (Rayleigh-Ritz).  It ends when the residual |C'C v - lambda v| of all
k vectors is below TOLERANCE of the largest lambda, so the result is the same
(to that tolerance) whatever the width, and a pass more costs one scan.

A pass is one Arrow batch function: every task emits one d x l partial sum, these
are added in groups of about the square root of their number, and the driver adds
the groups' sums.  The driver holds d x (BLOCKS * l) numbers, the broadcast is d x
l.  The input is written once before the passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.operators.summed import tree_sum
from scorewell.session import materialize

TOLERANCE = 1e-10
BLOCKS = 8  # blocks in the basis before it is restarted from its best vectors
MAX_PASSES = 500


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _tree_sum(x: DataFrame, partial, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all row blocks of ``partial(block)``, added in two levels."""
    return tree_sum(x, lambda batch: partial(_rows(batch)).ravel(), shape[0] * shape[1]).reshape(shape)


def _orthonormal(block: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Orthonormal columns that span what ``block`` adds to ``basis``."""
    start = np.linalg.norm(block, axis=0).max()
    for _ in range(2):
        if basis is not None:
            block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    q = u[:, s > 1e-12 * max(start, 1e-300)]
    if basis is not None:
        q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def principal_components(
    df: DataFrame, in_col: str, k: int, seed: int = 42
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components d x k, explained variance k, mean d) of the vector column.

    ``k`` is at most the number of rows and of columns.  Components are unit
    vectors whose largest entry is positive.
    """
    spark = df.sparkSession
    x = materialize(df.select(vector_to_array(in_col).alias("_x")), "pca-rows")
    head = x.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_x")).alias("d")).first()
    n, d = int(head["n"]), int(head["d"] or 0)
    if not n or not d:
        raise ValueError("PCA needs at least one row and one column")
    k = max(1, min(k, n, d))
    width = min(n, d, 2 * k + 10)
    mean = _tree_sum(x, lambda m: m.sum(axis=0, keepdims=True), (1, d))[0] / n
    shared = spark.sparkContext.broadcast(mean)

    def times(block: np.ndarray) -> np.ndarray:
        """(X - mu)'(X - mu) block: one pass over the rows."""
        sent = spark.sparkContext.broadcast(block)

        def partial(m):
            c = m - shared.value
            return c.T @ (c @ sent.value)

        out = _tree_sum(x, partial, block.shape)
        sent.destroy()
        return out

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    image = times(basis)
    for _ in range(MAX_PASSES):
        t = basis.T @ image
        values, vectors = np.linalg.eigh((t + t.T) / 2)
        best = np.argsort(-values)
        values, vectors = values[best], vectors[:, best]
        ritz, moved = basis @ vectors, image @ vectors
        residual = np.linalg.norm(moved[:, :k] - ritz[:, :k] * values[:k], axis=0)
        if residual.max() <= TOLERANCE * max(values[0], 1e-300):
            break
        if basis.shape[1] + width > BLOCKS * width:
            basis, image = ritz[:, :width], moved[:, :width]
        # the residuals of the leading vectors point out of the basis
        more = _orthonormal((moved - ritz * values)[:, :width], basis)
        if not more.shape[1]:
            break
        basis, image = np.hstack([basis, more]), np.hstack([image, times(more)])
    else:
        raise RuntimeError(f"PCA did not converge in {MAX_PASSES} passes")
    shared.destroy()
    comps = ritz[:, :k]
    comps = comps * np.sign(comps[np.abs(comps).argmax(axis=0), np.arange(k)])
    return comps, np.maximum(values[:k], 0) / max(n - 1, 1), mean
