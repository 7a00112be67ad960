"""Linear models on far more columns than rows' products can hold: column blocks and row-space solvers.

The entries (row, name, value) are dealt to column blocks by a hash of the column's
name: a task packs its entries for each block (names, rows and counts as arrays) before they
are shuffled, so no entry is stored or moved as a row, and each block is put together once; a block has every row of its columns, so a
column's mean and standard deviation over a split's training rows are known inside
it, and stored with it once.  There is no vocabulary anywhere: a column's weight is made in its block and goes
to a table (name, weight).  The driver holds row-space vectors only (labels, folds and
one vector per model; at most MOST_ROWS rows).

Ridge is solved in the row space: with Z the centred, scaled columns, (ZZ' + alpha) a = y
gives the weights Z'a.

* up to GRAM_COLUMNS rows, ZZ' is added up in one pass, and every penalty is solved
  from its eigenvectors;
* beyond, conjugate gradients with the diagonal of ZZ' as preconditioner: one pass a
  step for all splits and penalties together, until the residual of each is below
  TOLERANCE of its right side.

The elastic net keeps a set of active columns: a pass computes every column's gradient
and hands over those that break the optimality conditions most; coordinate descent
solves the active ones; it ends when no column breaks the conditions, so the result is
the minimum over all columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.operators.linear import GRAM_COLUMNS, descend
from scorewell.operators.summed import tree_sum
from scorewell.session import map_arrow, materialize

MOST_ROWS = 1 << 24
#: Entries of a column block (a column is never cut, so a block may have a column's rows more).
BLOCK_ENTRIES = 1 << 19
#: Entries a task packs at once for all blocks.
PACKED_AT_ONCE = 1 << 21
#: Columns made dense at once.
DENSE_COLUMNS = 512
TOLERANCE = 1e-9
MAX_STEPS = 2000
#: Columns that join the active set at once; numbers (rows x active columns) the driver may hold.
JOINING = 512
ACTIVE_NUMBERS = 1 << 26


class TooLarge(ValueError):
    """The rows or active columns don't fit the driver; take another solver."""


@dataclass
class System:
    """One model: the split it is for and its penalty."""

    split: int
    alpha: float


def _narrow(v: np.ndarray) -> np.ndarray:
    """The same numbers in one, two or eight bytes each."""
    if len(v) and v.min() >= 0 and v.max() < 1 << 16 and (v == np.floor(v)).all():
        return v.astype("u1" if v.max() < 1 << 8 else "<u2")
    return v.astype("<f8")


def _read(data, n: int) -> np.ndarray:
    """What ``_narrow`` made of ``n`` numbers."""
    return np.frombuffer(data, {1: "u1", 2: "<u2", 8: "<f8"}[len(data) // max(n, 1)] if n else "<f8").astype(np.float64)


class Block:
    """A column block's arrays: entry k is (row[k], column[k], value[k]), columns in order."""

    def __init__(self, batch: pa.RecordBatch, at: int) -> None:
        size = np.frombuffer(batch.column(2)[at].as_buffer(), "<i4")
        self.row = np.frombuffer(batch.column(1)[at].as_buffer(), "<i4").astype(np.intp)
        self.size, self.value = size, _read(batch.column(3)[at].as_buffer(), len(self.row))
        self.names, self.at = batch.column(0), at
        self.width = len(size)
        self.first = np.cumsum(size, dtype=np.intp) - size
        self.scales = np.frombuffer(batch.column(4)[at].as_buffer(), "<f8").reshape(-1, 2, self.width)

    @cached_property
    def column(self) -> np.ndarray:
        return np.repeat(np.arange(self.width), self.size)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sum of each column's entries (every column has one at least)."""
        return np.add.reduceat(x, self.first)

    def along(self, v: np.ndarray, split: int) -> np.ndarray:
        """Each scaled (not centred) column times ``v``."""
        return self.sums(self.value * v[self.row]) * self.scales[split, 1]

    def across(self, w: np.ndarray, split: int, n: int) -> np.ndarray:
        """The centred, scaled columns times ``w``, for the ``n`` rows."""
        mean, inv = self.scales[split]
        w = w * inv
        return np.bincount(self.row, self.value * np.repeat(w, self.size), n) - mean @ w

    def scaled(self, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean, 1 / std or 0, entries times that) of the columns over the split's training rows."""
        mean, inv = self.scales[split]
        return mean, inv, self.value * np.repeat(inv, self.size)


def _scale(row: np.ndarray, value: np.ndarray, size: np.ndarray, train: np.ndarray) -> np.ndarray:
    """(mean, 1 / std or 0) of columns over the training rows, entries in the columns' order."""
    first = np.cumsum(size, dtype=np.intp) - size
    n = max(int(train.sum()), 1)
    inside = train[row].astype(np.float64)
    mean = np.add.reduceat(value * inside, first) / n
    # two passes: zeros' share of the squares is mean^2 each
    off = value - np.repeat(mean, size)
    off *= off
    met = np.add.reduceat(inside, first)
    var = (np.add.reduceat(off * inside, first) + (n - met) * mean * mean) / n
    live = var > 1e-13 * np.maximum(mean * mean, 1e-300)
    return np.stack([mean, np.where(live, 1.0 / np.sqrt(np.where(live, var, 1.0)), 0.0)])


def _blocks(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield Block(batch, i)


def _pack(block: np.ndarray, names: pa.StringArray, place: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """One row per block: names, how many entries each has, their rows and values."""
    names = names.dictionary_encode()
    idx, unique = names.indices.to_numpy(), names.dictionary
    of = np.zeros(len(unique), np.int64)
    of[idx] = block  # a name's block
    by_block = np.argsort(of, kind="stable")
    rank = np.empty(len(of), np.int64)
    rank[by_block] = np.arange(len(of))
    key = rank[idx]
    order = np.argsort(key, kind="stable")
    size = np.bincount(key, minlength=len(of)).astype("<i4")
    of = of[by_block]
    cut = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]  # each block's first name
    ends = np.r_[0, np.cumsum(size, dtype=np.int64)][cut]

    def binary(x, at):
        x = np.ascontiguousarray(x)
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * x.itemsize).astype(np.int64)), pa.py_buffer(x.tobytes())]
        ).cast(pa.binary())

    return pa.RecordBatch.from_arrays(
        [
            pa.array(of[cut[:-1]], pa.int32()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), unique.take(pa.array(by_block))),
            binary(size, cut), binary(place[order].astype("<i4"), ends), binary(_narrow(value[order]), ends),
        ],
        ["block", "names", "size", "row", "value"],
    )


def packed(entries: DataFrame, rows: np.ndarray, size: int | None = None, train: list[np.ndarray] | None = None) -> DataFrame:
    """One row per column block: names, rows, entries a column, values and scales (as binary), from (r, name, v).

    ``size``: about how many entries there are, where the caller knows it.  ``train``: the training
    rows of each split, over which a column's mean and deviation are taken.
    """
    spark = entries.sparkSession
    n = max(1, -(-(entries.count() if size is None else size) // BLOCK_ENTRIES))
    sent = spark.sparkContext.broadcast((rows, train or []))  # 8 bytes a row, and 1 a split; MOST_ROWS at most

    def pack(batches):
        held, many = [], 0

        def close():
            t = pa.Table.from_batches(held).combine_chunks()
            block, r, name, v = (c.chunk(0) for c in t.columns)
            return _pack(block.to_numpy(), name, np.searchsorted(sent.value[0], r.to_numpy()), v.to_numpy())

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                many += batch.num_rows
            if many >= PACKED_AT_ONCE:
                yield close()
                held, many = [], 0
        if held:
            yield close()

    def join(batches):
        held, now = [], None

        def close():
            every = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
            size = np.concatenate([np.frombuffer(h[1].as_buffer(), "<i4") for h in held])
            place = np.concatenate([np.frombuffer(h[2].as_buffer(), "<i4") for h in held])
            value = np.concatenate([_read(h[3].as_buffer(), len(h[2].as_buffer()) // 4) for h in held])
            column = np.repeat(every.indices.to_numpy(), size)
            order = np.argsort(column, kind="stable")
            place, value, size = place[order], value[order], np.bincount(column).astype("<i4")
            scales = b"".join(_scale(place, value, size, t).tobytes() for t in sent.value[1])
            return pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), every.dictionary),
                    *[pa.array([x], pa.binary()) for x in (place.tobytes(), size.tobytes(), _narrow(value).tobytes(), scales)],
                ],
                ["names", "row", "size", "value", "scales"],
            )

        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                if held and block != now:
                    yield close()
                    held = []
                now = block
                held.append((batch.column(1)[i].values, *(batch.column(c)[i] for c in (2, 3, 4))))
        if held:
            yield close()

    dealt = entries.select(F.pmod(F.xxhash64("name"), F.lit(n)).cast("int").alias("block"), "r", "name", F.col("v").cast("double"))
    dealt = map_arrow(dealt, pack, "block int, names array<string>, size binary, row binary, value binary")
    dealt = dealt.repartition(n, "block").sortWithinPartitions("block")
    return materialize(map_arrow(dealt, join, "names array<string>, row binary, size binary, value binary, scales binary"), "column-blocks")


class Columns:
    """Packed columns of ``rows`` (r, y, fold) with entries (r, name, v); fold is null for rows of none.

    ``splits`` training sets: split s trains on the rows outside fold s; with 0 splits
    there is one, of all rows.  ``size``: see ``packed``.
    """

    def __init__(self, rows: DataFrame, entries: DataFrame, splits: int, size: int | None = None) -> None:
        n = rows.count()
        if n > MOST_ROWS:
            raise TooLarge(f"{n} rows; the row-space solvers hold {MOST_ROWS} at most")
        got = rows.select("r", F.col("y").cast("double").alias("y"), F.coalesce("fold", F.lit(-1)).alias("fold")).toPandas().sort_values("r")
        self.r, self.y, self.fold = (got[c].to_numpy() for c in ("r", "y", "fold"))
        known = ~np.isnan(self.y)
        self.train = [known & (self.fold != s) for s in range(splits)] if splits else [known]
        self.table = packed(entries, self.r, size, self.train)
        self.spark = rows.sparkSession
        self.rows = rows

    def centred(self, split: int) -> np.ndarray:
        t = self.train[split]
        return np.where(t, self.y - self.y[t].mean(), 0.0)

    # -- ridge
    def ridge(self, systems: list[System]) -> np.ndarray:
        """The row-space solution of each system: (rows, systems)."""
        if len(self.y) <= GRAM_COLUMNS:
            return self._from_products(systems)
        return self._by_gradients(systems)

    def _from_products(self, systems: list[System]) -> np.ndarray:
        n, train = len(self.y), self.train
        splits = len(train)

        def partial(batch):
            out = np.zeros((splits, n, n))
            for b in _blocks(batch):
                for s in range(splits):
                    mean, inv, z = b.scaled(s)
                    shift = mean * inv
                    for at in range(0, b.width, DENSE_COLUMNS):
                        lo, hi = np.searchsorted(b.column, [at, at + DENSE_COLUMNS])
                        width = min(DENSE_COLUMNS, b.width - at)
                        m = np.zeros((n, width))
                        m[b.row[lo:hi], b.column[lo:hi] - at] = z[lo:hi]
                        m -= shift[at : at + width]
                        out[s] += m @ m.T
            return out.ravel()

        products = tree_sum(self.table, partial, len(train) * n * n).reshape(len(train), n, n)
        out = np.zeros((n, len(systems)))
        for s, t in enumerate(train):
            mine = [k for k, x in enumerate(systems) if x.split == s]
            if not mine:
                continue
            values, vectors = np.linalg.eigh(products[s][np.ix_(t, t)])
            along = vectors.T @ self.centred(s)[t]
            values = np.maximum(values, 0.0)
            for k in mine:
                out[t, k] = vectors @ (along / (values + systems[k].alpha))
        return out

    def _by_gradients(self, systems: list[System]) -> np.ndarray:
        split = np.array([x.split for x in systems])
        alpha = np.array([x.alpha for x in systems])
        mask = np.stack([self.train[s] for s in split], axis=1)
        inside = mask.sum(axis=0)
        centre = lambda v: np.where(mask, v - np.where(mask, v, 0.0).sum(axis=0) / inside, 0.0)
        b = np.stack([self.centred(s) for s in split], axis=1)
        step_size = 1.0 / (self._diagonal()[:, split] + alpha)
        x, r = np.zeros_like(b), b.copy()
        z = centre(r * step_size)
        p, rz = z.copy(), (r * z).sum(axis=0)
        goal = TOLERANCE * np.linalg.norm(b, axis=0)
        for _ in range(MAX_STEPS):
            open_ = np.flatnonzero(np.linalg.norm(r, axis=0) > goal)
            if not len(open_):
                return x
            q = np.zeros_like(p)
            q[:, open_] = self.times(p[:, open_], split[open_])
            q = centre(q) + alpha * p
            along = (p * q).sum(axis=0)
            a = np.divide(rz, along, out=np.zeros_like(rz), where=along > 0)
            a[np.setdiff1d(np.arange(len(a)), open_)] = 0.0
            x += a * p
            r -= a * q
            z = centre(r * step_size)
            new = (r * z).sum(axis=0)
            p = z + np.divide(new, rz, out=np.zeros_like(rz), where=rz > 0) * p
            rz = new
        raise RuntimeError(f"ridge did not converge in {MAX_STEPS} steps")

    def _diagonal(self) -> np.ndarray:
        """The diagonal of ZZ' for each split: (rows, splits)."""
        n, splits = len(self.y), len(self.train)

        def partial(batch):
            out = np.zeros((n, splits))
            for b in _blocks(batch):
                for s in range(splits):
                    mean, inv, z = b.scaled(s)
                    shift = mean * inv
                    out[:, s] += np.bincount(b.row, z * (z - 2 * shift[b.column]), n) + shift @ shift
            return out.ravel()

        return tree_sum(self.table, partial, n * len(self.train)).reshape(n, -1)

    def times(self, vectors: np.ndarray, split: np.ndarray) -> np.ndarray:
        """ZZ'v for each vector (centred over its split's training rows), for all rows."""
        n, k = vectors.shape
        sent = self.spark.sparkContext.broadcast((np.ascontiguousarray(vectors.T), split))

        def partial(batch):
            v, of = sent.value
            out = np.zeros((k, n))
            for b in _blocks(batch):
                for j, s in enumerate(of):
                    out[j] += b.across(b.along(v[j], s), s, n)
            return out.T.ravel()

        out = tree_sum(self.table, partial, n * k).reshape(n, k)
        sent.destroy()
        return out

    def predictions(self, duals: np.ndarray, systems: list[System]) -> np.ndarray:
        """Every row's prediction by every system: (rows, systems)."""
        split = np.array([x.split for x in systems])
        means = np.array([self.y[t].mean() for t in self.train])
        return self.times(duals, split) + means[split]

    def ridge_weights(self, dual: np.ndarray, split: int = 0) -> tuple[DataFrame, float]:
        """((name, weight on the raw column, mean over the training rows), the label's mean) of one system."""
        train = self.train[split]
        sent = self.spark.sparkContext.broadcast(dual)

        def run(batches):
            for batch in batches:
                for b in _blocks(batch):
                    mean, inv = b.scales[split]
                    w = b.along(sent.value, split) * inv
                    names = b.names[b.at].values
                    yield pa.RecordBatch.from_arrays([names, pa.array(w), pa.array(mean)], ["name", "weight", "mean"])

        table = materialize(map_arrow(self.table, run, "name string, weight double, mean double"), "column-weights")
        return table, float(self.y[train].mean())

    # -- elastic net
    def elastic_net(self, alpha: float, l1_ratio: float, split: int = 0) -> tuple[list[tuple[str, float, float]], np.ndarray, float]:
        """([(name, weight on the raw column, mean)] of the columns with a weight, all rows' predictions, label's mean)."""
        a1, a2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
        train, y = self.train[split], self.centred(split)
        n, size = int(train.sum()), len(self.y)
        y_mean = float(self.y[train].mean())
        scale = max(float(np.sqrt(y @ y / max(n, 1))), 1e-300)
        names, means, stds = [], [], []
        z = np.zeros((size, 0))
        w, gram, xy = np.zeros(0), np.zeros((0, 0)), np.zeros(0)
        fitted = np.zeros(size)
        while True:
            found = self._violators(np.where(train, y - fitted, 0.0), a1 + 1e-7 * scale, n, split, set(names))
            if not found:
                break
            if size * (len(names) + len(found)) > ACTIVE_NUMBERS:
                raise TooLarge(f"{len(names) + len(found)} active columns of {size} rows; take a larger penalty")
            dense = np.zeros((size, len(found)))
            for k, (name, mean, std, row, value) in enumerate(found):
                names.append(name)
                means.append(mean)
                stds.append(std)
                dense[row, k] = value / std
                dense[:, k] -= mean / std
            z = np.hstack([z, dense])
            inside = z[train]
            cross = inside.T @ dense[train]
            gram = np.block([[gram, cross[: len(w)]], [cross[: len(w)].T, cross[len(w) :]]])
            xy = np.concatenate([xy, dense[train].T @ y[train]])
            w = descend(gram, xy, n, a1, a2, np.concatenate([w, np.zeros(len(found))]), scale, 5000)
            fitted = z @ w
        kept = [(names[k], float(w[k] / stds[k]), means[k]) for k in np.flatnonzero(w)]
        return kept, fitted + y_mean, y_mean

    def _violators(self, residual: np.ndarray, limit: float, n: int, split: int, have: set[str]) -> list[tuple]:
        """The columns not yet active whose gradient is beyond ``limit``, JOINING at most, the largest first."""
        sent = self.spark.sparkContext.broadcast((residual, have))

        def run(batches):
            res, old = sent.value
            for batch in batches:
                for b in _blocks(batch):
                    mean, inv = b.scales[split]
                    g = np.abs(b.along(res, split) - mean * inv * res.sum()) / n
                    over = np.flatnonzero(g > limit)
                    over = over[np.argsort(-g[over], kind="stable")]
                    rows = {c: [] for c in ("name", "g", "mean", "std", "row", "value")}
                    for j in over:
                        name = b.names[b.at].values[int(j)].as_py()
                        if name in old:
                            continue
                        lo, hi = b.first[j], b.first[j] + b.size[j]
                        for c, v in zip(rows, (name, g[j], mean[j], 1.0 / inv[j], b.row[lo:hi].astype("<i4").tobytes(), b.value[lo:hi].tobytes())):
                            rows[c].append(v)
                        if len(rows["name"]) == JOINING:
                            break
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows["name"], pa.string()), *[pa.array(rows[c], pa.float64()) for c in ("g", "mean", "std")],
                         *[pa.array(rows[c], pa.binary()) for c in ("row", "value")]], list(rows),
                    )

        found = map_arrow(self.table, run, "name string, g double, mean double, std double, row binary, value binary")
        top = found.orderBy(F.desc("g"), "name").limit(JOINING).collect()
        sent.destroy()
        return [(r.name, r["mean"], r["std"], np.frombuffer(r["row"], "<i4"), np.frombuffer(r["value"], "<f8")) for r in top]
