"""E11 on many rows: a random forest grown until leaves are pure, in tasks of bounded size.

Columns are binned as in Spark's forest (``BINS`` bins of values, missing ones last) and
equal rows become one cell with a count m.  A tree's bag holds a cell Poisson(m) times,
which is the sum of the m rows' Poisson(1) draws.  A pass adds up, for the nodes with more
than ``CELLS`` cells, the bagged rows per bin and class of the node's own random columns.
The cells of smaller nodes go to one task for some nodes, which grows them to the end and
stores them, so neither the driver nor a task holds a tree, and sums are of bounded size.

As in Spark's forest: Gini impurity with class weights, ceil(sqrt(columns)) columns a node,
no split without gain, equal predictions of two leaves merged (among nodes grown together),
and a prediction is the class with the largest sum of the trees' leaf shares.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param as MLParam
from pyspark.ml.param import Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.operators.boosting import COLUMNS, Binning, _matrix, binning
from scorewell.operators.features import spread_join
from scorewell.operators.summed import tree_sum
from scorewell.session import map_arrow, materialize, ship_package

#: Bins of values a column has at most (Spark's forest has as many).
BINS = 32
#: Bagged cells up to which a node is grown to the end in one task, and those of a task's nodes together.
CELLS = 1 << 16
#: Cells (fewer where they are wide) and bytes of a stored block.
BLOCK_CELLS, BLOCK_BYTES = 1 << 14, 1 << 22
#: Sums (bins and classes of open nodes) of one pass, of nodes split together in a task, and most of one node.
NUMBERS, AT_ONCE, NODE = 1 << 21, 1 << 17, 1 << 20
#: Trees whose cells are sent together by a task.
TREES = 8
#: Part of its impurity a split must take away.
GAIN = 1e-12
PIECE = "bucket long, root binary, count binary, x binary, y binary, c binary"
GROWN = "bucket long, column binary, bin binary, left binary, shares binary"
ASKED = "part long, bucket long, cells binary, root binary, x binary, votes binary"
ANSWER = "part long, bucket long, cells binary, code binary, shares binary"


@dataclass
class Settings:
    trees: int = 200
    depth: int = 30
    seed: int = 42


def fits(width: int, classes: int) -> bool:
    """Whether one node's sums can be held; else take another learner."""
    return 1 <= width <= COLUMNS and chosen(width) * (BINS + 1) * classes <= NODE and classes < 1 << 15


def chosen(width: int) -> int:
    """Columns a node may split."""
    return math.ceil(math.sqrt(width))


def binned(rows: DataFrame, b: Binning) -> DataFrame:
    """(x, y) of ``rows`` with the bins of x as bytes."""
    width = len(b.edges)

    def bins(batches):
        for batch in batches:
            x = b.bins(_matrix(batch.column(0), batch.num_rows, width))
            yield pa.RecordBatch.from_arrays([_cut(x), batch.column(1)], ["x", "y"])

    return map_arrow(rows.select("x", F.col("y").cast("int").alias("y")), bins, "x binary, y int")


def cell_blocks(rows: DataFrame, width: int, name: str) -> DataFrame:
    """(part, n, x, y, m) stored: the different ``rows`` (x, y) in blocks, with their counts."""
    cells = materialize(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m")), f"{name}-cells")
    parts = cells.count() // max(1, min(BLOCK_CELLS, BLOCK_BYTES // max(width, 1))) + 1
    # a part's cells are the same in every run, so its bags are
    dealt = cells.repartition(parts, "x", "y").sortWithinPartitions("x", "y").withColumn("part", F.spark_partition_id().cast("long"))

    def block(batches):
        held = [batch for batch in batches if batch.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            x = b"".join(t.column(0).to_pylist())
            y, m = (t.column(c).to_numpy() for c in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [t.column(3).chunk(0)[:1], pa.array([len(y)], pa.int32()), *[pa.array([v], pa.binary()) for v in (x, y.astype("<i4").tobytes(), m.astype("<i8").tobytes())]],
                ["part", "n", "x", "y", "m"],
            )

    return materialize(map_arrow(dealt, block, "part long, n int, x binary, y binary, m binary"), f"{name}-blocks")


def _cut(x: np.ndarray) -> pa.Array:
    """Every row of a byte matrix as a binary value."""
    n, width = x.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])


def _read(batch, width: int):
    """(part, x, y, m) of every block of a batch."""
    part, n, x, y, m = (batch.column(c) for c in range(5))
    for i in range(batch.num_rows):
        yield (
            part[i].as_py(), np.frombuffer(x[i].as_buffer(), np.uint8).reshape(n[i].as_py(), width),
            np.frombuffer(y[i].as_buffer(), "<i4"), np.frombuffer(m[i].as_buffer(), "<i8"),
        )


def bag(seed: int, tree: int, part: int, m: np.ndarray) -> np.ndarray:
    """How often a tree's bag holds each cell of a block, the same in every pass."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, tree, part]))).poisson(m)


def best_splits(hist: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, slot, bin) of the best split of every node with (classes, nodes, slots, bins) rows; gain 0: none."""
    total = hist[:, :, 0].sum(axis=2) * weights[:, None]  # every row is in one bin of the first column
    wl, wr, l2, r2 = (np.zeros((*hist.shape[1:3], hist.shape[3] - 1)) for _ in range(4))
    for k, w in enumerate(weights):
        left = np.cumsum(hist[k, :, :, :-1], axis=2)
        left *= w
        right = total[k][:, None, None] - left
        wl += left
        wr += right
        left *= left
        l2 += left
        right *= right
        r2 += right
    weight = total.sum(axis=0)
    least = (GAIN * weight)[:, None, None]
    ok = (wl > least) & (wr > least)
    l2 /= np.where(ok, wl, 1.0)
    r2 /= np.where(ok, wr, 1.0)
    l2 += r2
    l2[~ok] = -1.0
    flat = l2.reshape(len(l2), -1)
    best = flat.argmax(axis=1)
    gain = flat[np.arange(len(flat)), best] / weight - ((total / weight) ** 2).sum(axis=0)
    return np.where(gain > GAIN, gain, 0.0), best // l2.shape[2], best % l2.shape[2]


def columns_of(rng: np.random.Generator, nodes: int, width: int) -> np.ndarray:
    """(nodes, slots) random columns, in order."""
    s = chosen(width)
    return np.sort(rng.random((nodes, width)).argpartition(s - 1, axis=1)[:, :s], axis=1) if s < width else np.tile(np.arange(width), (nodes, 1))


@dataclass
class Nodes:
    """Flat nodes: ``left`` is a split's left child (the right one follows it), or a leaf's row of ``shares``."""

    column: np.ndarray  # int16, -1: a leaf
    bin: np.ndarray  # uint8, values up to it go left
    left: np.ndarray  # int32
    shares: np.ndarray  # (leaves that differ, classes)

    def leaf(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The last nodes of rows that are at the nodes ``at``."""
        at = at.copy()
        rows = np.flatnonzero(self.column[at] >= 0)
        while len(rows):
            node = at[rows]
            at[rows] = self.left[node] + (x[rows, self.column[node]] > self.bin[node])
            rows = rows[self.column[at[rows]] >= 0]
        return at

    def binary(self) -> list[bytes]:
        return [self.column.astype("<i2").tobytes(), self.bin.tobytes(), self.left.astype("<i4").tobytes(), self.shares.astype("<f8").tobytes()]

    @classmethod
    def of(cls, column, bin, left, shares, classes: int) -> "Nodes":
        return cls(np.frombuffer(column, "<i2"), np.frombuffer(bin, np.uint8), np.frombuffer(left, "<i4"),
                   np.frombuffer(shares, "<f8").reshape(-1, classes))


def _finish(levels: list[tuple]) -> Nodes:
    """Nodes with leaves' shares: children of one prediction that are both leaves are merged, the deepest first."""
    column, bin_, left, total = (np.concatenate([level[k] for level in levels]) for k in range(4))
    guess, end = total.argmax(axis=1), len(column)
    for level in reversed(levels):
        split = np.flatnonzero(column[end - len(level[0]) : end] >= 0) + end - len(level[0])
        a = left[split]
        column[split[(column[a] < 0) & (column[a + 1] < 0) & (guess[a] == guess[a + 1])]] = -1
        end -= len(level[0])
    leaves, k = np.flatnonzero(column < 0), total.shape[1]
    pure = (total[leaves] > 0).sum(axis=1) == 1
    mixed = total[leaves[~pure]]
    weight = mixed.sum(axis=1, keepdims=True)
    left[leaves[pure]] = guess[leaves[pure]]
    left[leaves[~pure]] = k + np.arange(len(mixed))
    return Nodes(column, bin_, left, np.concatenate([np.eye(k), mixed / np.where(weight > 0, weight, 1.0)]))


def grow(x: np.ndarray, y: np.ndarray, c: np.ndarray, root: np.ndarray, depths: np.ndarray, weights: np.ndarray, depth: int, bins: int, rng) -> Nodes:
    """Trees grown to the end on rows that belong to the root nodes 0, 1, ... (all of one level together).

    ``root`` is sorted; ``depths`` are the roots' own depths.  Counts ``c`` are added before they
    are weighted, so sums don't depend on the order of rows.
    """
    width, s, classes = x.shape[1], chosen(x.shape[1]), len(weights)
    some = max(1, AT_ONCE // (s * bins * classes))
    levels, base, at, nodes = [], 0, root.astype(np.int64), len(depths)
    while nodes:
        total = np.bincount(at * classes + y, c, nodes * classes).reshape(nodes, classes) * weights
        column, bin_, left = np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8), np.zeros(nodes, np.int64)
        levels.append((column, bin_, left, total))
        open_ = ((total > 0).sum(axis=1) > 1) & (depths < depth)
        # rows of open nodes only, which are numbered anew
        ids = np.flatnonzero(open_)
        new = np.cumsum(open_) - 1
        keep = open_[at]
        x, y, c, at = x[keep], y[keep], c[keep], new[at[keep]]
        ends = np.searchsorted(at, np.arange(0, len(ids) + some, some))
        for k, a in enumerate(range(0, len(ids), some)):
            mine = slice(ends[k], ends[k + 1])
            n = min(some, len(ids) - a)
            mx, my, mat = x[mine], y[mine].astype(np.int64), at[mine] - a
            cols, every = columns_of(rng, n, width), np.arange(len(mat))
            start = (my * n + mat) * (s * bins)
            place = np.concatenate([start + (j * bins + mx[every, cols[mat, j]]) for j in range(s)])
            hist = np.bincount(place, np.tile(c[mine], s), classes * n * s * bins).reshape(classes, n, s, bins)
            gain, slot, cut = best_splits(hist, weights)
            good = np.flatnonzero(gain > 0)
            column[ids[a + good]] = cols[good, slot[good]]
            bin_[ids[a + good]] = cut[good]
        split = np.flatnonzero(column >= 0)
        left[split] = base + nodes + 2 * np.arange(len(split))
        # rows to the children, which keep the order of nodes
        is_split = column[ids] >= 0
        keep = is_split[at]
        x, y, c, at = x[keep], y[keep], c[keep], (np.cumsum(is_split) - 1)[at[keep]]
        side = x[np.arange(len(at)), column[split][at]] > bin_[split][at]
        order = _parted(at, side, len(split))
        x, y, c, at = x[order], y[order], c[order], (2 * at + side)[order]
        base += nodes
        depths = np.repeat(depths[split] + 1, 2)
        nodes = 2 * len(split)
    return _finish(levels)


def _parted(at: np.ndarray, side: np.ndarray, nodes: int) -> np.ndarray:
    """The order of rows sorted by ``at`` that puts each node's left rows before its right ones."""
    if not len(at):
        return np.empty(0, np.int64)
    counts = np.bincount(at, minlength=nodes)
    rights = np.bincount(at, side, nodes).astype(np.int64)
    start = np.cumsum(counts) - counts
    before = np.cumsum(side) - side  # right rows before this one
    before_in = before - (np.cumsum(rights) - rights)[at]
    i = np.arange(len(at))
    to = np.where(side, (start + counts - rights)[at] + before_in, i - before_in)
    order = np.empty(len(at), np.int64)
    order[to] = i
    return order


class _Top:
    """One tree's nodes with more than CELLS cells, and what is below them: leaves, or roots grown in tasks."""

    def __init__(self):
        self.column, self.bin, self.left, self.total, self.depth, self.cells = [], [], [], [], [], []

    def add(self, total, depth: int, cells: int) -> int:
        for values, v in ((self.column, -1), (self.bin, 0), (self.left, 0), (self.total, total), (self.depth, depth), (self.cells, cells)):
            values.append(v)
        return len(self.column) - 1

    def route(self) -> Nodes:
        return Nodes(np.array(self.column, np.int16), np.array(self.bin, np.uint8), np.array(self.left, np.int32), np.empty((0, 1)))


class Forest:
    """A fit in progress."""

    def __init__(self, rows: DataFrame, width: int, weights: list[float], settings: Settings):
        """``rows``: x array<double>, y double (a class index, of weight ``weights[y]``)."""
        self.s, self.width, self.classes = settings, width, len(weights)
        self.weights = np.array(weights, float)
        rows = rows.where("y is not null")
        self.binning = binning(rows, width, BINS)
        self.bins = int(self.binning.missing.max()) + 1 if width else 1
        self.blocks = cell_blocks(binned(rows, self.binning), width, "forest")
        self.spark = rows.sparkSession
        self.tops = [_Top() for _ in range(settings.trees)]

    def _counts(self, todo: list[tuple[int, int]], cols: np.ndarray | None) -> np.ndarray:
        """For nodes (tree, node): (cells, rows per class), or these per bin of their columns ``cols``, in one pass."""
        width, bins, seed, k = self.width, self.bins, self.s.seed, self.classes + 1
        s = 1 if cols is None else cols.shape[1]
        per = s * (1 if cols is None else bins) * k
        trees: dict[int, tuple[Nodes, np.ndarray]] = {}
        for slot, (t, node) in enumerate(todo):
            if t not in trees:
                trees[t] = self.tops[t].route(), np.full(len(self.tops[t].column), -1)
            trees[t][1][node] = slot

        def partial(batch):
            out = np.zeros(len(todo) * per)
            for part, x, y, m in _read(batch, width):
                for t, (top, slots) in trees.items():
                    c = bag(seed, t, part, m)
                    slot = slots[top.leaf(x, np.zeros(len(x), np.int32))]
                    on = np.flatnonzero((c > 0) & (slot >= 0))
                    if not len(on):
                        continue
                    first, own, slot, c = slot[on].min(), y[on], slot[on], c[on]
                    size = (int(slot.max()) - int(first) + 1) * per
                    for j in range(s):
                        where = (slot - first) * s + j
                        if cols is not None:
                            where = where * bins + x[on, cols[slot, j]]
                        out[first * per : first * per + size] += np.bincount(
                            np.concatenate([where * k, where * k + 1 + own]), np.concatenate([np.ones(len(on)), c]), size)
            return out

        return tree_sum(self.blocks, partial, len(todo) * per).reshape(len(todo), s, -1, k)

    def _tops(self) -> None:
        """Grow all nodes of more than CELLS cells, a level at a time."""
        every = [(t, 0) for t in range(self.s.trees)]
        for top in self.tops:
            top.add(np.zeros(self.classes), 0, 0)
        some = max(1, NUMBERS // (self.classes + 1))
        for a in range(0, len(every), some):
            for (t, _), got in zip(every[a : a + some], self._counts(every[a : a + some], None)[:, 0, 0]):
                self.tops[t].cells[0], self.tops[t].total[0] = int(got[0]), got[1:]
        some = max(1, NUMBERS // (chosen(self.width) * self.bins * (self.classes + 1)))
        new = every
        while new:
            todo = [(t, i) for t, i in new if self._large(self.tops[t], i)]
            new = []
            for a in range(0, len(todo), some):
                mine = todo[a : a + some]
                cols = np.concatenate([columns_of(np.random.default_rng([self.s.seed, 1, t, i]), 1, self.width) for t, i in mine])
                sums = self._counts(mine, cols)
                gain, slot, cut = best_splits(np.moveaxis(sums[..., 1:], 3, 0), self.weights)
                for k, (t, i) in enumerate(mine):
                    if gain[k] <= 0:
                        continue
                    top, run = self.tops[t], sums[k, slot[k]]
                    top.column[i], top.bin[i] = int(cols[k, slot[k]]), int(cut[k])
                    for at, side in enumerate((run[: cut[k] + 1].sum(axis=0), run[cut[k] + 1 :].sum(axis=0))):
                        child = top.add(side[1:], top.depth[i] + 1, int(side[0]))
                        if at == 0:
                            top.left[i] = child
                        new.append((t, child))

    def _large(self, top: _Top, i: int) -> bool:
        return top.cells[i] > CELLS and top.depth[i] < self.s.depth and np.count_nonzero(top.total[i]) > 1

    def run(self) -> tuple[dict, DataFrame]:
        """(settings of the model with the top nodes, stored table of the nodes grown in tasks)."""
        self._tops()
        # a top node without children is a leaf, or a root to grow; roots share a bucket up to CELLS cells
        tops, roots, depths = [], [[]], [[]]
        held = 0
        for t, top in enumerate(self.tops):
            column, left = np.array(top.column, np.int16), np.array(top.left, np.int64)
            total = np.array(top.total) * self.weights
            place = np.full((len(column), 2), -1)
            for i in np.flatnonzero(column < 0):
                if top.cells[i] > CELLS or np.count_nonzero(top.total[i]) < 2 or top.depth[i] >= self.s.depth:
                    continue
                if held + top.cells[i] > CELLS and roots[-1]:
                    roots.append([])
                    depths.append([])
                    held = 0
                place[i] = len(roots) - 1, len(roots[-1])
                roots[-1].append((t, int(i)))
                depths[-1].append(top.depth[i])
                held += top.cells[i]
            weight = total.sum(axis=1, keepdims=True)
            tops.append({"column": column.tolist(), "bin": top.bin, "left": left.tolist(), "bucket": place[:, 0].tolist(),
                         "root": place[:, 1].tolist(), "shares": (total / np.where(weight > 0, weight, 1.0)).tolist()})
        model = {"edges": [list(map(float, e)) for e in self.binning.edges], "classes": self.classes, "tops": tops}
        return model, self._grown(tops, depths)

    def _grown(self, tops: list[dict], depths: list[list[int]]) -> DataFrame:
        width, bins, s, weights = self.width, self.bins, self.s, self.weights
        flat = [_flat(t) for t in tops]

        def pieces(batches):
            for batch in batches:
                for part, x, y, m in _read(batch, width):
                    for a in range(0, len(flat), TREES):
                        found = []
                        for t in range(a, min(a + TREES, len(flat))):
                            top, bucket, root, _ = flat[t]
                            c = bag(s.seed, t, part, m)
                            rows = np.flatnonzero(c)
                            at = top.leaf(x[rows], np.zeros(len(rows), np.int32))
                            rows, at = rows[bucket[at] >= 0], at[bucket[at] >= 0]
                            found.append((bucket[at], root[at], rows, c[rows]))
                        bucket, root, rows, c = (np.concatenate(v) for v in zip(*found))
                        order = np.lexsort((root, bucket))
                        bucket, root, rows, c = bucket[order], root[order], rows[order], c[order]
                        made = [(b, *[v.astype("<i4").tobytes() for v in np.unique(root[e], return_counts=True)], x[rows[e]].tobytes(),
                                 y[rows[e]].astype("<u2").tobytes(), c[e].astype("<u4").tobytes()) for b, e in _runs(bucket)]
                        if made:
                            yield _batch(made, PIECE)

        def finish(key, table):
            bucket = key[0].as_py()
            get = lambda c, t: np.concatenate([np.frombuffer(v.as_buffer(), t) for v in table.column(c)])
            root, y, c = np.repeat(get("root", "<i4"), get("count", "<i4")), get("y", "<u2").astype(np.int64), get("c", "<u4")
            x = get("x", np.uint8).reshape(len(y), width)
            order = np.argsort(root, kind="stable")
            nodes = grow(x[order], y[order], c[order].astype(float), root[order], np.array(depths[bucket]), weights, s.depth, bins,
                         np.random.default_rng([s.seed, 2, bucket]))
            return pa.table([pa.array([bucket], pa.int64()), *[pa.array([v], pa.binary()) for v in nodes.binary()]], names=_names(GROWN))

        sent = map_arrow(self.blocks, pieces, PIECE)
        per = self.spark.sparkContext.defaultParallelism
        n = max(1, min(len(depths), max(4 * per, len(depths) // 16)))
        return materialize(sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(finish, GROWN), "forest-nodes")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _runs(key: np.ndarray):
    """(key, slice) of each run of equal keys."""
    cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
    return [(int(key[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:])]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = [pa.int64() if c.endswith(" long") else pa.binary() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], _names(schema))


def _flat(top: dict) -> tuple[Nodes, np.ndarray, np.ndarray, np.ndarray]:
    nodes = Nodes(np.array(top["column"], np.int16), np.array(top["bin"], np.uint8), np.array(top["left"], np.int32), np.empty((0, 1)))
    return nodes, np.array(top["bucket"]), np.array(top["root"]), np.array(top["shares"], float)


class ForestModel(Transformer, MLReadable, MLWritable):
    """Classes by the trees' summed leaf shares; the nodes grown in tasks are a stored table.

    The different binned rows are sent to the buckets their trees' roots lie in, so neither
    the driver nor a task holds a tree.  Saved as the settings and the table.
    """

    settings = MLParam(Params._dummy(), "settings", "JSON of edges, classes, top nodes and columns", TypeConverters.toString)

    def __init__(self, model: dict | None = None, table: DataFrame | None = None, inputCol: str = "_raw", outputCol: str = "_pred_idx"):
        super().__init__()
        self.table = table
        if model is not None:
            self._set(settings=json.dumps({**model, "inputCol": inputCol, "outputCol": outputCol}))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        d = json.loads(self.getOrDefault(self.settings))
        b, classes, flat = Binning([np.array(e, float) for e in d["edges"]]), d["classes"], [_flat(t) for t in d["tops"]]
        width, trees = len(b.edges), len(flat)
        ship_package(dataset.sparkSession)

        @F.pandas_udf("binary")
        def cell(x):
            import pandas as pd

            return pd.Series([r.tobytes() for r in b.bins(np.stack(x.to_numpy()))] if len(x) else [], dtype=object)

        kept = materialize(dataset.withColumn("_cell", cell(vector_to_array(d["inputCol"]))), "forest-rows")
        blocks = cell_blocks(kept.select(F.col("_cell").alias("x"), F.lit(0).alias("y")), width, "forest-asked")

        def ask(batches):
            for batch in batches:
                for part, x, _, _ in _read(batch, width):
                    for a in range(0, trees, TREES):
                        found, votes = [], np.zeros((len(x), classes))
                        for top, bucket, root, shares in flat[a : a + TREES]:
                            at = top.leaf(x, np.zeros(len(x), np.int32))
                            on, ends = np.flatnonzero(bucket[at] >= 0), np.flatnonzero(bucket[at] < 0)
                            votes[ends] += shares[at[ends]]
                            found.append((bucket[at[on]], root[at[on]], on))
                        bucket, root, on = (np.concatenate(v) for v in zip(*found))
                        order = np.argsort(bucket, kind="stable")
                        bucket, root, on = bucket[order], root[order], on[order]
                        made = [(b, on[e].astype("<i4").tobytes(), root[e].astype("<i4").tobytes(), x[on[e]].tobytes(), None) for b, e in _runs(bucket)]
                        if votes.any():
                            made.append((-1 - a, None, None, None, votes.astype("<f8").tobytes()))
                        if made:
                            yield _batch([(part, *v) for v in made], ASKED)

        asked = materialize(map_arrow(blocks, ask, ASKED), "forest-requests")
        ready = asked.where("bucket < 0").selectExpr("part", "bucket", "cells", "votes as code", "cast(null as binary) as shares")
        model = self.table.selectExpr("bucket", "cast(-1 as long) as part", "cast(null as binary) as cells", "cast(null as binary) as root",
                                      "cast(null as binary) as x", "column", "bin", "left", "shares")
        wanted = asked.where("bucket >= 0").select("bucket", "part", "cells", "root", "x", *[F.lit(None).cast("binary").alias(c) for c in ("column", "bin", "left", "shares")])
        n = max(1, min(self.table.count(), max(4 * dataset.sparkSession.sparkContext.defaultParallelism, self.table.count() // 16)))
        # a bucket's nodes come first, then what is asked of them, one record after the other
        sent = wanted.unionByName(model).repartition(n, "bucket").sortWithinPartitions("bucket", "part")

        def answer(batches):
            nodes, own = None, None
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    if r["part"] < 0:
                        nodes, own = Nodes.of(r["column"], r["bin"], r["left"], r["shares"], classes), r["bucket"]
                        continue
                    if own != r["bucket"]:
                        raise RuntimeError("a bucket without nodes")
                    root = np.frombuffer(r["root"], "<i4")
                    at = nodes.leaf(np.frombuffer(r["x"], np.uint8).reshape(len(root), width), root)
                    used, code = np.unique(nodes.left[at], return_inverse=True)
                    out.append((r["part"], r["bucket"], r["cells"], code.ravel().astype("<i4").tobytes(), nodes.shares[used].astype("<f8").tobytes()))
                if out:
                    yield _batch(out, ANSWER)

        answers = map_arrow(sent, answer, ANSWER).unionByName(ready)

        def vote(key, table):
            (x,) = {v for v in table.column("x").to_pylist() if v is not None}
            cells = np.frombuffer(x, np.uint8).reshape(-1, width)
            votes = np.zeros((len(cells), classes))
            found = [r for r in table.select(["bucket", "cells", "code", "shares"]).to_pylist() if r["bucket"] is not None]
            for r in sorted(found, key=lambda r: (r["bucket"], r["cells"] or b"")):  # sums are added in one order
                if r["cells"] is None:
                    votes += np.frombuffer(r["code"], "<f8").reshape(-1, classes)
                    continue
                at = np.frombuffer(r["cells"], "<i4")
                got = np.frombuffer(r["shares"], "<f8").reshape(-1, classes)[np.frombuffer(r["code"], "<i4")]
                for j in range(classes):
                    votes[:, j] += np.bincount(at, got[:, j], len(cells))
            return pa.table([_cut(cells), pa.array(votes.argmax(axis=1).astype(float))], names=["_cell", "p"])

        own = blocks.selectExpr("part", "cast(null as long) as bucket", "cast(null as binary) as cells", "cast(null as binary) as code", "cast(null as binary) as shares", "x")
        every = answers.withColumn("x", F.lit(None).cast("binary")).unionByName(own)
        got = materialize(every.groupBy("part").applyInArrow(vote, "_cell binary, p double"), "forest-votes")
        return spread_join(kept, got.withColumnRenamed("p", d["outputCol"]), "_cell").drop("_cell")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)


class _ForestWriter(MLWriter):
    def __init__(self, instance: ForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/nodes")


class _ForestReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls()
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        out.table = self.sparkSession.read.parquet(f"{path}/nodes")
        return out


def fit(rows: DataFrame, width: int, weights: list[float], settings: Settings, inputCol: str, outputCol: str) -> ForestModel:
    """Rows (x array<double>, y double); ``weights`` of the classes 0, 1, ..."""
    model, table = Forest(rows, width, weights, settings).run()
    return ForestModel(model, table, inputCol, outputCol)
