"""Histogram gradient boosting with an L2 leaf penalty.

Columns are binned once (at most ``BINS`` bins of values and one of missing values)
and stored as blocks of bytes with the labels.  A pass adds up, for every open node of
every class's tree, (rows, gradients, Hessians) per bin; only the smaller child of a
split is added up, its sibling is the parent minus it.  The driver reads the best
splits off these sums, whose size depends on bins and nodes, not on rows.

Trees grow best first to ``leaves`` leaves.  A node's best split doesn't depend on other
nodes, so a pass takes all nodes that best-first growth over the splits known so far
would reach; growth ends when it reaches no unknown node, and equals one at a time.

Loss: squared error, or log loss (one tree a step for two classes, one a class beyond).
A split's gain is GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2), a leaf's value -rate*G/(H+l2).
Gains that agree to 1e-9 are ties: the first column, then the first bin wins.  Missing
values go to the side with the larger gain, and to the larger child where a node has none.

Where many fits of different settings read the same rows and a task can hold them binned
(``TASK_BYTES``), each fit is a task of its own (``fit_side_by_side``): the same growth, with sums
over the task's rows instead of passes.

Empty tables raise ValueError.  Rows with a null label or weight are not taken.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param as MLParam
from pyspark.ml.param import Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.operators.summed import tree_sum
from scorewell.session import drop_table, map_arrow, materialize, ship_package, written

#: Bins of values a column may have; one more holds missing values, so a bin is a byte.
BINS = 255
#: Columns beyond which a dense block row is too wide.
COLUMNS = 4096
#: Sums (rows, gradient, Hessian) of all bins and open nodes the driver may hold.
NUMBERS = 1 << 25
BLOCK_BYTES = 1 << 22
#: Steps after which the rows' scores are written at the latest, so a pass applies few trees.
REWRITE = 16
#: What decides on an earlier writing (execution only): passes of a step, seconds a row and tree
#: (a column its splits use), seconds a stored byte, seconds of a writing of few rows.
PASSES, TREE_SECONDS, BYTE_SECONDS, JOB_SECONDS = 6, 1e-8, 4e-9, 0.5
#: Most rows of a block, and leaves up to which a tree is applied by leaf masks.
BLOCK_ROWS, MASK_LEAVES = 1 << 16, 64
#: Tasks up to which their sums go to the driver without a second level.
DIRECT = 64
#: Bytes of binned rows, for all splits together, that a task may hold for fits side by side.
TASK_BYTES = 1 << 26
#: Values a task should have before its rows are dealt to idle cores.
CELLS = 1 << 18
GAIN_TIE = 1e-9
SCHEMA = "n int, x binary, y binary, w binary, held binary, raw binary"


@dataclass
class Settings:
    steps: int = 200
    rate: float = 0.1
    depth: int | None = 6
    leaves: int = 31
    min_leaf: int = 20
    l2: float = 0.0
    min_hessian: float = 1e-3
    patience: int = 10  # steps without a better held-back loss before the end
    tolerance: float = 1e-7


@dataclass
class Split:
    gain: float
    column: int
    bin: int
    missing_left: bool
    left: np.ndarray  # rows, gradient, Hessian
    right: np.ndarray


@dataclass
class Node:
    depth: int
    total: np.ndarray | None = None
    sums: np.ndarray | None = None  # (bins, 3), until the tree is done
    split: Split | None = None
    known: bool = False
    children: tuple[int, int] | None = None
    parent: int = -1


@dataclass
class Binning:
    """Upper edges of each column's value bins; ``start[c] + bin`` numbers all bins."""

    edges: list[np.ndarray]
    start: np.ndarray = field(init=False)
    places: tuple = field(init=False)

    def __post_init__(self):
        self.missing = np.array([len(e) + 1 for e in self.edges])
        self.start = np.concatenate([[0], np.cumsum(self.missing + 1)])
        start = self.start[:-1]
        of = np.repeat(np.arange(len(start)), self.missing + 1)
        place = np.arange(self.size) - start[of]
        # each column's first bin; of each bin its column and place in it, whether it is a value bin with one
        # after it, whether it is the last one (all values left, missing ones right)
        self.places = start, of, place, place < self.missing[of] - 1, place == self.missing[of] - 1

    @property
    def size(self) -> int:
        return int(self.start[-1])

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for c, e in enumerate(self.edges):
            out[:, c] = np.where(np.isnan(x[:, c]), len(e) + 1, np.searchsorted(e, x[:, c], side="left"))
        return out


def binning(rows: DataFrame, width: int, bins: int = BINS) -> Binning:
    """Edges of the columns of ``rows.x``: half way between values, or quantiles beyond ``bins`` values."""

    def few(batches):
        seen = [np.empty(0)] * width
        for batch in batches:
            x = _matrix(batch.column(0), batch.num_rows, width)
            for c in range(width):
                if len(seen[c]) <= bins:
                    seen[c] = np.union1d(seen[c], x[:, c][~np.isnan(x[:, c])])[: bins + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(width, dtype=np.int32), [len(s) for s in seen])), pa.array(np.concatenate(seen))],
            ["c", "v"],
        )

    # a column with more than ``bins`` values shows that many in some task or over all of them
    values = materialize(map_arrow(rows.select("x"), few, "c int, v double").distinct(), "bin-values")
    small = values.groupBy("c").count().where(F.col("count") <= bins).select("c")
    found: dict[int, list[float]] = {}
    for r in values.join(F.broadcast(small), "c").collect():  # at most ``bins`` a column
        found.setdefault(r["c"], []).append(r["v"])
    many = [r["c"] for r in values.select("c").distinct().join(F.broadcast(small), "c", "left_anti").collect()]
    edges = [np.empty(0)] * width
    for c, v in found.items():
        v = np.sort(np.array(v))
        edges[c] = v[:-1] + (v[1:] - v[:-1]) / 2
    shares = [i / bins for i in range(1, bins)]
    for a in range(0, len(many), 64):
        some = many[a : a + 64]
        value = lambda c: F.when(~F.isnan(F.get("x", F.lit(c))), F.get("x", F.lit(c)))
        r = rows.agg(*[F.percentile_approx(value(c), shares, 100_000).alias(f"q{c}") for c in some]).first()
        for c in some:
            edges[c] = np.unique(np.array(r[f"q{c}"], float))
    return Binning(edges)


def _matrix(column, n: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, width)


@dataclass
class Trees:
    """Grown trees as flat arrays; ``roots[step][class]`` is a tree's first node."""

    baseline: np.ndarray
    roots: list[list[int]] = field(default_factory=list)
    column: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def arrays(self) -> "Flat":
        return Flat(
            self.roots, *[np.array(a, t) for a, t in (
                (self.column, np.int32), (self.bin, np.int32), (self.threshold, float), (self.missing_left, bool),
                (self.left, np.int32), (self.right, np.int32), (self.value, float),
            )]
        )


@dataclass
class Flat:
    roots: list
    column: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def reach(self, x: np.ndarray, root: int, edge: np.ndarray, missing) -> np.ndarray:
        """The last node of every row of ``x`` below ``root``; ``missing(values, columns)`` marks missing ones."""
        at = np.full(len(x), root, np.int32)
        rows = np.arange(len(x))
        while True:
            rows = rows[self.left[at[rows]] >= 0]
            if not len(rows):
                return at
            node = at[rows]
            c = self.column[node]
            v = x[rows, c]
            gone = missing(v, c)
            go = np.where(gone, self.missing_left[node], v <= edge[node])
            at[rows] = np.where(go, self.left[node], self.right[node])

    def masks(self, root: int, missing: np.ndarray) -> "Masks | None":
        """The tree below ``root`` for binned columns; None where it has too many leaves."""
        order, spans = [], []  # leaves from left to right; (node, its first leaf, the right side's, the end)

        def walk(node: int) -> None:
            first = len(order)
            if self.left[node] < 0:
                order.append(node)
                return
            walk(self.left[node])
            middle = len(order)
            walk(self.right[node])
            spans.append((node, first, middle, len(order)))

        walk(root)
        if len(order) > MASK_LEAVES:
            return None
        tables: dict[int, np.ndarray] = {}
        bins = np.arange(256)
        bits = lambda a, b: np.uint64(((1 << b) - 1) ^ ((1 << a) - 1))
        for node, first, middle, end in spans:
            c = int(self.column[node])
            go = np.where(bins == missing[c], self.missing_left[node], bins <= self.bin[node])
            out = np.where(go, bits(middle, end), bits(first, middle))  # leaves a row can't reach
            tables[c] = tables.get(c, np.full(256, np.iinfo(np.uint64).max, np.uint64)) & ~out
        return Masks(np.array(order, np.int32), sorted(tables.items()))

    def add(self, raw: np.ndarray, x: np.ndarray, edge: np.ndarray, missing, since: int = 0) -> np.ndarray:
        for step in self.roots[since:]:
            for k, root in enumerate(step):
                raw[:, k] += self.value[self.reach(x, root, edge, missing)]
        return raw


@dataclass
class Masks:
    """A tree on binned columns: a row's leaf is the first that no column's bin rules out."""

    leaves: np.ndarray  # the nodes, from left to right
    tables: list[tuple[int, np.ndarray]]  # column, the leaves each bin leaves over as bits

    def reach(self, x: np.ndarray) -> np.ndarray:
        """The last node of every row of ``x``."""
        if not self.tables:
            return np.full(len(x), self.leaves[0], np.int32)
        left = None
        for c, table in self.tables:
            mine = table[x[:, c]]
            left = mine if left is None else np.bitwise_and(left, mine, out=left)
        first = (left & (~left + np.uint64(1))).astype(np.float64)  # a power of two
        return self.leaves[(first.view(np.int64) >> 52) - 1023]


def binned_reach(flat: Flat, root: int, missing: np.ndarray):
    """``reach`` of one tree for binned columns."""
    masks = flat.masks(root, missing)
    if masks is not None:
        return masks.reach
    return lambda x: flat.reach(x, root, flat.bin, lambda v, c: v == missing[c])


def binned_add(flat: Flat, missing: np.ndarray, since: int):
    """A function that adds the trees from step ``since`` on to the scores of binned rows."""
    steps = [[(k, binned_reach(flat, root, missing)) for k, root in enumerate(step)] for step in flat.roots[since:]]

    def add(raw: np.ndarray, x: np.ndarray) -> np.ndarray:
        for step in steps:
            for k, reach in step:
                raw[:, k] += flat.value[reach(x)]
        return raw

    return add


def gradients(loss: str, raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, Hessian) per row and tree, and every row's loss."""
    w1 = w[:, None]
    if loss == "squared":
        d = raw - y[:, None]
        return w1 * d, np.broadcast_to(w1, d.shape), w * d[:, 0] ** 2 / 2
    if raw.shape[1] == 1:
        p = 0.5 * (1.0 + np.tanh(0.5 * raw))
        lost = np.logaddexp(0.0, raw[:, 0]) - y * raw[:, 0]
        return w1 * (p - y[:, None]), w1 * p * (1 - p), w * lost
    z = raw - raw.max(axis=1, keepdims=True)
    e = np.exp(z)
    p = e / e.sum(axis=1, keepdims=True)
    own = y.astype(int)[:, None] == np.arange(raw.shape[1])
    return w1 * (p - own), w1 * p * (1 - p), w * (np.log(e.sum(axis=1)) - z[own])


def _blocks(batch, width: int, trees: int):
    for i in range(batch.num_rows):
        n = batch.column(0)[i].as_py()
        x, y, w, held, raw = (batch.column(c)[i].as_buffer() for c in range(1, 6))
        yield (
            np.frombuffer(x, np.uint8).reshape(n, width), np.frombuffer(y), np.frombuffer(w),
            np.frombuffer(held, bool), np.frombuffer(raw).reshape(n, trees),
        )


def _block_table(rows: DataFrame, b: Binning, baseline: np.ndarray) -> DataFrame:
    width, per = len(b.edges), max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(len(b.edges), 1)))

    def block(batches):
        held, size = [], 0

        def made():
            parts = [[part.column(c) for part in held] for c in range(4)]
            x = np.concatenate([b.bins(_matrix(v, len(v), width)) for v in parts[0]])
            y, w, back = (np.concatenate([v.to_numpy(zero_copy_only=False) for v in parts[c]]) for c in (1, 2, 3))
            arrays = [
                x.tobytes(), y.astype("<f8").tobytes(), w.astype("<f8").tobytes(),
                back.astype(bool).tobytes(), np.tile(baseline, (size, 1)).astype("<f8").tobytes(),
            ]
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32())] + [pa.array([v], pa.binary()) for v in arrays],
                                              ["n", "x", "y", "w", "held", "raw"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, per - size))
                at += held[-1].num_rows
                size += held[-1].num_rows
                if size == per:
                    yield made()
                    held, size = [], 0
        if size:
            yield made()

    return map_arrow(rows.select("x", "y", "w", "held"), block, SCHEMA)


def _dealt(rows: DataFrame, width: int) -> DataFrame:
    """``rows``, moved only where fewer tasks than cores hold more than CELLS values each."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().orderBy(F.desc("count")).limit(cores).collect()]
    want = min(cores, sum(sizes) * width // CELLS + 1)
    return rows.repartition(want) if len(sizes) < want else rows


def best_split(sums: np.ndarray, total: np.ndarray, b: Binning, s: Settings) -> Split | None:
    """The best split of a node with (bins, 3) ``sums``, or None where none is allowed or gains."""
    start, of, place, inner, last = b.places
    sums = np.ascontiguousarray(sums.T)
    run = np.cumsum(sums, axis=1)
    before = np.where(start > 0, run[:, np.maximum(start - 1, 0)], 0.0)
    left = run - np.repeat(before, b.missing + 1, axis=1)
    gone = sums[:, start + b.missing]
    has_gone = gone[0] > 0
    score = lambda t: t[1] ** 2 / np.maximum(t[2] + s.l2, 1e-300)
    own = total[1] ** 2 / max(total[2] + s.l2, 1e-300)
    sides = [(False, left, inner | (last & has_gone[of]))]
    if has_gone.any():
        sides.insert(0, (True, left + np.repeat(gone, b.missing + 1, axis=1), inner & has_gone[of]))
    best = None
    gains = []
    for missing_left, side, ok in sides:
        other = total[:, None] - side
        ok = ok & (side[0] >= s.min_leaf) & (other[0] >= s.min_leaf)
        ok &= (side[2] >= s.min_hessian) & (other[2] >= s.min_hessian)
        two = score(side) + score(other)
        gain = np.where(ok & (two - own > 1e-12 * two), two - own, -1.0)
        gains.append((missing_left, side, other, gain))
    top = max(g[3].max(initial=-1.0) for g in gains)
    if top <= 0:
        return None
    for missing_left, side, other, gain in gains:
        at = np.flatnonzero(gain >= top * (1 - GAIN_TIE))
        if len(at) and (best is None or at[0] < best[0]):
            best = (at[0], missing_left, side[:, at[0]].copy(), other[:, at[0]].copy(), gain[at[0]])
    i, missing_left, side, other, gain = best
    if not has_gone[of[i]]:
        missing_left = bool(side[0] > other[0])
    return Split(float(gain), int(of[i]), int(place[i]), missing_left, side, other)


def _reached(nodes: list[Node], s: Settings) -> list[int]:
    """Nodes that best-first growth splits, as far as splits are known."""
    out, open_, count = [], [0], 1
    while open_ and count < s.leaves:
        can = [i for i in open_ if nodes[i].split is not None]
        if not can:
            break
        i = max(can, key=lambda j: (nodes[j].split.gain, -j))
        open_.remove(i)
        out.append(i)
        count += 1
        if nodes[i].children:
            open_ += nodes[i].children
    return out


class Boosting:
    """A fit in progress: the binned blocks, the trees so far and the passes over them."""

    def __init__(self, rows: DataFrame, width: int, loss: str, classes: int, settings: Settings):
        """``rows``: x array<double>, y double (a class index for loss 'log'), w double, held boolean."""
        self.loss, self.s, self.width = loss, settings, width
        self.trees_a_step = 1 if loss == "squared" or classes <= 2 else classes
        rows = rows.where("y is not null and w is not null")
        self.baseline = self._baseline(rows, classes)
        self.binning = binning(rows, width)
        self.model = Trees(self.baseline)
        rows = _dealt(rows, width)
        self.path, self.blocks = written(_block_table(rows, self.binning, self.baseline), "boosting-blocks")
        self.written_steps = 0
        found = self.blocks.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
        self.tasks, self.rows = found[0], found[1] or 0
        self.cores = max(1, rows.sparkSession.sparkContext.defaultParallelism)
        self.edge = self.gone = None

    def _baseline(self, rows, classes):
        kept = rows.where("not held")
        if self.loss == "squared":
            r = kept.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m")).first()
            if r["m"] is None:
                raise ValueError("no rows to fit")
            return np.array([r["m"]])
        by = {int(r["y"]): r["w"] for r in kept.groupBy("y").agg(F.sum("w").alias("w")).collect()}
        if not by:
            raise ValueError("no rows to fit")
        p = np.array([by.get(k, 0.0) for k in range(max(classes, 2))]) / sum(by.values())
        p = np.clip(p, 1e-15, 1 - 1e-15)
        return np.array([math.log(p[1] / p[0])]) if self.trees_a_step == 1 else np.log(p)

    def _sums(self, growing: list[list[Node]], todo: list[list[int]], with_loss: bool) -> tuple[np.ndarray, np.ndarray]:
        """((node, bins, 3) in the order of ``todo``, held-back (loss, weight)) in one pass."""
        k_, size, width, loss = self.trees_a_step, self.binning.size, self.width, self.loss
        start, missing = self.binning.start[:-1], self.binning.missing
        since, done = self.written_steps, self.model.arrays()
        routes, slots, n_slots = [], [], 0
        for nodes, wanted in zip(growing, todo):
            routes.append(_route(nodes))
            slot = np.full(len(nodes), -1)
            for i in wanted:
                slot[i] = n_slots
                n_slots += 1
            slots.append(slot)
        asked = [k for k in range(k_) if (slots[k] >= 0).any()]

        def partial(batch):
            sums, totals, held_out = np.zeros((3, n_slots * size)), np.zeros((3, n_slots)), np.zeros(2)
            add = binned_add(done, missing, since)
            ways = {k: binned_reach(routes[k], 0, missing) for k in asked}
            for x, y, w, held, raw in _blocks(batch, width, k_):
                at = {}
                for k in asked:
                    at[k] = slots[k][ways[k](x)]
                    at[k][held] = -1
                if not with_loss:  # only rows of some node asked for count
                    some = np.flatnonzero(np.any([v >= 0 for v in at.values()], axis=0))
                    x, y, w, raw = x[some], y[some], w[some], raw[some]
                    at = {k: v[some] for k, v in at.items()}
                g, h, lost = gradients(loss, add(raw.copy(), x), y, w)
                if with_loss:
                    held_out += lost[held].sum(), w[held].sum()
                dense = np.count_nonzero(x) * 4 > x.size
                if not dense:
                    row, column = np.nonzero(x)  # a column's first bin is what the others leave
                    cell = start[column] + x[row, column]
                for k, slot in at.items():
                    rows_on = np.flatnonzero(slot >= 0)
                    if dense:
                        place = (x[rows_on] + (slot[rows_on, None] * size + start)).ravel()
                        spread = lambda v: np.repeat(v[rows_on], width)  # noqa: B023, E731
                    else:
                        on = np.flatnonzero(slot[row] >= 0)
                        of = row[on]
                        place = slot[of] * size + cell[on]
                        spread = lambda v: v[of]  # noqa: B023, E731
                    sums[0] += np.bincount(place, minlength=n_slots * size)
                    totals[0] += np.bincount(slot[rows_on], minlength=n_slots)
                    for j, v in ((1, g[:, k]), (2, h[:, k])):
                        totals[j] += np.bincount(slot[rows_on], v[rows_on], n_slots)
                        sums[j] += np.bincount(place, spread(v), n_slots * size)
            sums.reshape(3, n_slots, size)[:, :, start] = 0.0
            return np.concatenate([sums.ravel(), totals.ravel(), held_out])

        a, c = n_slots * size * 3, n_slots * 3
        flat = tree_sum(self.blocks, partial, a + c + 2, direct=self.tasks <= DIRECT)
        sums = flat[:a].reshape(3, n_slots, size)
        sums[:, :, start] = flat[a : a + c].reshape(3, n_slots, 1) - np.add.reduceat(sums, start, axis=2)
        return np.ascontiguousarray(np.moveaxis(sums, 0, 2)), flat[-2:]

    def step(self) -> float | None:
        """Grow one tree a class; the held-back loss before it (None without held-back rows)."""
        growing = [[Node(0)] for _ in range(self.trees_a_step)]
        held_loss, first = None, True
        while True:
            todo, pairs = [], []
            for k, nodes in enumerate(growing):
                todo.append([0] if first else self._open(nodes, pairs, k))
            if not any(todo):
                break
            sums, held = self._sums(growing, todo, first)
            if first and held[1] > 0:
                held_loss = held[0] / held[1]
            it = iter(sums)
            for nodes, wanted in zip(growing, todo):
                for i in wanted:
                    self._know(nodes[i], next(it))
            for k, parent, small, large in pairs:
                nodes = growing[k]
                self._know(nodes[large], nodes[parent].sums - nodes[small].sums)
            first = False
        self.model.roots.append([self._keep(nodes) for nodes in growing])
        if self._rewriting_pays():
            self._rewrite()
        return held_loss

    def _know(self, node: Node, sums: np.ndarray) -> None:
        node.sums, node.known = sums, True
        if node.total is None:  # every row is in one bin of the first column
            node.total = sums[: self.binning.start[1]].sum(axis=0)
        node.split = best_split(sums, node.total, self.binning, self.s)

    def _open(self, nodes: list[Node], pairs: list, k: int) -> list[int]:
        """Unknown nodes that growth reaches; larger siblings go to ``pairs`` instead."""
        out = []
        for i in _reached(nodes, self.s):
            n = nodes[i]
            if n.children is None:
                n.children = (len(nodes), len(nodes) + 1)
                for total in (n.split.left, n.split.right):
                    child = Node(n.depth + 1, total=total, parent=i)
                    if (self.s.depth and child.depth >= self.s.depth) or total[0] < 2 * self.s.min_leaf:
                        child.known = True  # a leaf
                    nodes.append(child)
            a, b = sorted(n.children, key=lambda j: (nodes[j].total[0], j))
            if nodes[a].known and nodes[b].known:
                continue
            if nodes[b].known or nodes[a].sums is not None:
                continue
            out.append(a)
            pairs.append((k, i, a, b))
        return out

    def _keep(self, nodes: list[Node]) -> int:
        split = set(_reached(nodes, self.s))
        m, s = self.model, self.s
        base = len(m.column)

        def put(i: int) -> int:
            at, n = len(m.column), nodes[i]
            inner = i in split
            value = -s.rate * n.total[1] / max(n.total[2] + s.l2, 1e-300) if n.total[0] else 0.0
            c, bin_ = (n.split.column, n.split.bin) if inner else (0, 0)
            edges = self.binning.edges[c]
            m.column.append(c)
            m.bin.append(bin_)
            m.threshold.append((float(edges[bin_]) if bin_ < len(edges) else math.inf) if inner else 0.0)
            m.missing_left.append(bool(inner and n.split.missing_left))
            m.value.append(float(value))
            m.left.append(-1)
            m.right.append(-1)
            if inner:
                m.left[at] = put(n.children[0])
                m.right[at] = put(n.children[1])
            return at

        put(0)
        return base

    def _rewriting_pays(self) -> bool:
        """Whether the trees since the last writing cost a step's passes more than writing the scores."""
        steps = len(self.model.roots) - self.written_steps
        if steps >= REWRITE:
            return True
        apply = PASSES * steps * self.trees_a_step * min(self.width, self.s.leaves) * TREE_SECONDS * self.rows
        write = (self.width + 17 + 8 * self.trees_a_step) * BYTE_SECONDS * self.rows + JOB_SECONDS * self.cores
        return apply > write

    def _rewrite(self) -> None:
        width, k, since, model = self.width, self.trees_a_step, self.written_steps, self.model.arrays()
        missing = self.binning.missing

        def update(batches):
            add = binned_add(model, missing, since)
            for batch in batches:
                raws = [add(raw.copy(), x).tobytes() for x, _, _, _, raw in _blocks(batch, width, k)]
                yield pa.RecordBatch.from_arrays(batch.columns[:5] + [pa.array(raws, pa.binary())], ["n", "x", "y", "w", "held", "raw"])

        old = self.path
        self.path, self.blocks = written(map_arrow(self.blocks, update, SCHEMA), "boosting-blocks")
        self.written_steps = len(self.model.roots)
        drop_table(self.blocks.sparkSession, old)

    def run(self) -> Trees:
        """All steps, or fewer where the held-back loss stops getting better."""
        losses: list[float] = []
        for _ in range(self.s.steps):
            held = self.step()
            if held is None:
                continue
            losses.append(held)
            last = losses[-self.s.patience :]
            if len(losses) > self.s.patience and min(last) >= losses[-self.s.patience - 1] - self.s.tolerance:
                break
        self.close()
        return self.model

    def close(self) -> None:
        drop_table(self.blocks.sparkSession, self.path)


class TaskBoosting(Boosting):
    """A squared-loss fit on binned rows that a task holds; sums and scores are its own, the growth is the same."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, binning: Binning, baseline: np.ndarray, settings: Settings):
        self.loss, self.s, self.width, self.trees_a_step = "squared", settings, len(binning.edges), 1
        self.binning, self.baseline, self.model = binning, baseline, Trees(baseline)
        self.x, self.y, self.held = x, y, held
        self.raw = np.full((len(y), 1), baseline[0])
        self.mine = np.flatnonzero(~held)
        # the number of each row's bin among all columns', a column at a time
        self.cells = [x[:, c].astype(np.intp) + binning.start[c] for c in range(self.width)]
        self.at: dict[int, np.ndarray] = {}

    def _sums(self, growing, todo, with_loss):
        (nodes,), (wanted,) = growing, todo
        lost = np.zeros(2)
        if with_loss:
            self.off = self.raw[:, 0] - self.y
            self.at = {0: self.mine}
            back = self.off[self.held]
            lost[:] = (back @ back) / 2, len(back)
        out = np.empty((len(wanted), self.binning.size, 3))
        for sums, i in zip(out, wanted):
            rows = self._rows(nodes, i)
            off = self.off[rows]
            sums[:, 0] = sums[:, 1] = 0.0
            for c, cell in enumerate(self.cells):
                a, b = self.binning.start[c : c + 2]
                place = cell[rows] - a
                sums[a:b, 0] = np.bincount(place, minlength=b - a)
                sums[a:b, 1] = np.bincount(place, off, b - a)
            sums[:, 2] = sums[:, 0]
        return out, lost

    def _rows(self, nodes: list[Node], i: int) -> np.ndarray:
        """The rows of a node, those of its parent dealt by the split."""
        if i not in self.at:
            up = nodes[i].parent
            rows, split = self._rows(nodes, up), nodes[up].split
            v = self.x[rows, split.column]
            left = np.where(v == self.binning.missing[split.column], split.missing_left, v <= split.bin)
            self.at[nodes[up].children[0]], self.at[nodes[up].children[1]] = rows[left], rows[~left]
        return self.at[i]

    def _rewriting_pays(self) -> bool:
        return True

    def _rewrite(self) -> None:
        self.raw[:, 0] += self._last_tree(self.x)

    def _last_tree(self, x: np.ndarray) -> np.ndarray:
        return _tree_values(self.model, self.model.roots[-1][0], len(self.model.column), self.binning.missing)(x)

    def close(self) -> None:
        pass


def _tree_values(model: Trees, root: int, end: int, missing: np.ndarray):
    """A function that gives the values of binned rows by the tree whose nodes are ``root`` .. ``end`` - 1."""
    part = slice(root, end)
    below = lambda side: [i - root if i >= 0 else -1 for i in side[part]]
    one = Trees(
        model.baseline, [[0]], model.column[part], model.bin[part], model.threshold[part], model.missing_left[part],
        below(model.left), below(model.right), model.value[part],
    ).arrays()
    reach = binned_reach(one, 0, missing)
    return lambda x: one.value[reach(x)]


def fit_side_by_side(rows: DataFrame, width: int, splits: int, settings: list[Settings]) -> DataFrame | None:
    """(trial, split, r, p): each split's rows predicted by every setting's squared-loss fit on the others.

    ``rows`` (stored): r long (unique), x array<double>, y double, fold int (the split a
    row validates, or null), back boolean (a tenth, held back where a split trains on more than
    HOLD_BACK_FROM rows).  None where the binned rows are more than a task may hold.
    """
    spark = rows.sparkSession
    if rows.count() * (splits * width + 24) > TASK_BYTES:
        return None
    known, starts = [], []
    for s in range(splits):
        others = rows.where(~F.col("fold").eqNullSafe(F.lit(s)))
        many = others.count() > HOLD_BACK_FROM
        others = others.where("y is not null").withColumn("held", F.col("back") & F.lit(many))
        baseline = others.where("not held").agg((F.sum("y") / F.count("y")).alias("m")).first()["m"]
        if baseline is None:
            raise ValueError("no rows to fit")
        known.append((binning(others, width), many))
        starts.append(np.array([baseline]))

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), batch.num_rows, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([np.concatenate([b.bins(x).ravel() for b, _ in known]).tobytes()], pa.binary()),
                     *[pa.array([batch.column(c).to_pylist()], t) for c, t in ((1, pa.list_(pa.float64())), (2, pa.list_(pa.int32())), (3, pa.list_(pa.bool_())), (4, pa.list_(pa.int64())))]],
                    ["x", "y", "fold", "back", "r"],
                )

    got = map_arrow(rows.select("x", "y", "fold", "back", "r"), binned, "x binary, y array<double>, fold array<int>, back array<boolean>, r array<long>").toArrow()
    take = lambda c, none: pa.concat_arrays([x.flatten() for x in got.column(c).chunks]).fill_null(none).to_numpy(zero_copy_only=False)
    blocks = [np.frombuffer(v.as_buffer(), np.uint8).reshape(splits, -1, width) for v in got.column("x")]
    sent = spark.sparkContext.broadcast(  # TASK_BYTES at most
        (np.concatenate(blocks, axis=1), take("y", np.nan), take("fold", -1), take("back", False), take("r", 0))
    )

    def run(batches):
        x, y, fold, back, r = sent.value
        for batch in batches:
            for trial, s in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                (b, many), mine = known[s], fold == s
                learn = ~mine & ~np.isnan(y)
                held = back[learn] if many else np.zeros(int(learn.sum()), bool)
                model = TaskBoosting(x[s][learn], y[learn], held, b, starts[s], settings[trial]).run()
                p, rows_ = np.full(int(mine.sum()), starts[s][0]), x[s][mine]
                ends = [*[root for (root,) in model.roots[1:]], len(model.column)]
                for (root,), end in zip(model.roots, ends):
                    p += _tree_values(model, root, end, b.missing)(rows_)
                n = len(p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, trial, np.int32)), pa.array(np.full(n, s, np.int32)), pa.array(r[mine]), pa.array(p)],
                    ["trial", "split", "r", "p"],
                )

    # the longest fits begin first, each as a task
    pairs = sorted(((t, s) for t in range(len(settings)) for s in range(splits)), key=lambda p: -settings[p[0]].steps)
    todo = spark.createDataFrame(spark.sparkContext.parallelize(pairs, len(pairs)), "trial int, split int")
    return map_arrow(todo, run, "trial int, split int, r long, p double")


def _route(nodes: list[Node]) -> Flat:
    inner = [n.children is not None for n in nodes]
    take = lambda f, d: np.array([f(n) if i else d for n, i in zip(nodes, inner)])
    return Flat(
        [[0]], take(lambda n: n.split.column, 0), take(lambda n: n.split.bin, 0), np.zeros(len(nodes)),
        take(lambda n: n.split.missing_left, False).astype(bool),
        take(lambda n: n.children[0], -1), take(lambda n: n.children[1], -1), np.zeros(len(nodes)),
    )


def fits(width: int, classes: int) -> bool:
    """Whether sums of the widest binning of ``width`` columns can be held; else take another learner."""
    return width <= COLUMNS and 3 * min(width * (BINS + 1), NUMBERS) * max(classes, 1) <= NUMBERS


class BoostedTrees(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Scores of boosted trees on a vector column, in Arrow batches.

    ``outputCol`` is the value (loss 'squared'), the class index with the largest score
    ('log') or every tree's score ('scores').
    """

    trees = MLParam(Params._dummy(), "trees", "JSON of the trees", TypeConverters.toString)
    inputCol = MLParam(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = MLParam(Params._dummy(), "outputCol", "result", TypeConverters.toString)

    def __init__(self, model: Trees | None = None, loss: str = "squared", inputCol: str = "_raw", outputCol: str = "prediction"):
        super().__init__()
        if model is not None:
            self._set(trees=json.dumps({**vars(model), "baseline": list(map(float, model.baseline)), "loss": loss}),
                      inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        d = json.loads(self.getOrDefault(self.trees))
        loss = d.pop("loss")
        model = Trees(**{**d, "baseline": np.array(d["baseline"])})
        flat, baseline = model.arrays(), model.baseline

        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="object" if loss == "scores" else "float64")
            x = np.stack(x.to_numpy())
            raw = np.tile(baseline, (len(x), 1))
            raw = flat.add(raw, x, flat.threshold, lambda v, c: np.isnan(v))
            if loss == "scores":
                return pd.Series(list(raw))
            if loss == "squared":
                return pd.Series(raw[:, 0])
            return pd.Series((raw[:, 0] > 0 if raw.shape[1] == 1 else raw.argmax(axis=1)).astype(float))

        result = F.pandas_udf(score, "array<double>" if loss == "scores" else "double")(vector_to_array(self.getOrDefault(self.inputCol)))
        return dataset.withColumn(self.getOrDefault(self.outputCol), result)


#: Rows beyond which a tenth is held back to end the steps early.
HOLD_BACK_FROM = 10_000


def kept_back(id_col: str):
    """A tenth of the rows, by a hash of the id."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(10)) == 0


def training_rows(df: DataFrame, vector: str, label, weight, id_col: str) -> DataFrame:
    """The rows a fit takes, written; a tenth by a hash of the id is held back from HOLD_BACK_FROM rows on."""
    rows = materialize(df.select(
        vector_to_array(vector).alias("x"), label.cast("double").alias("y"), weight.cast("double").alias("w"),
        kept_back(id_col).alias("held"),
    ), "boosting-rows")
    return rows if rows.count() > HOLD_BACK_FROM else rows.withColumn("held", F.lit(False))


def fit(rows: DataFrame, width: int, loss: str, classes: int, settings: Settings) -> Trees:
    return Boosting(rows, width, loss, classes, settings).run()
