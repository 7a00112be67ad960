"""E11 on many rows: the forest grown in tasks against its definition, bounds of what tasks hold, round trip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewell.operators import forest as FO
from scorewell.operators.boosting import Binning
from scorewell.plans import cv as CV
from scorewell.plans import estimators as E

ROLES = E.Roles("row_id", "label", feature_cols=["a", "b", "c"])


def _table(spark, n, seed=0, copies=1, missing=0.03):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(3)
    x[rng.random(n) < missing, 1] = np.nan
    lab = np.where(x[:, 0] + 0.4 * rng.normal(size=n) > 0.7, "hi", np.where(x[:, 2] < -0.5, "lo", "mid"))
    rows = [(i, *map(float, x[i]), str(lab[i])) for i in range(n)] * copies
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, label string").repartition(4)


def _bounds(monkeypatch, cells):
    monkeypatch.setattr(E, "FOREST_ROWS", 0)
    monkeypatch.setattr(E, "FOREST_SUMS", 0)
    monkeypatch.setattr(FO, "CELLS", cells)
    monkeypatch.setattr(FO, "BLOCK_CELLS", 150)


def _predictions(spec, fitted, df):
    return sorted((r["row_id"], r["prediction"]) for r in spec.predict(fitted, df).collect())


@pytest.mark.parametrize("cells", [1 << 16, 60])
def test_many_rows_are_grown_in_tasks(spark, monkeypatch, tmp_path, cells):
    """No learner that holds trees on the driver; learns, saves, and is the same in every run."""
    df, spec = _table(spark, 900), E.get_spec("tabular_rf")
    train, test = df.where("row_id < 600"), df.where("row_id >= 600")
    _bounds(monkeypatch, cells)
    monkeypatch.setattr(E.TabularForest, "make", lambda *a: pytest.fail("Spark's learner holds all trees on the driver"))
    fitted = spec.fit(train, {"n_estimators": 12}, ROLES)
    got = _predictions(spec, fitted, test)
    assert [i for i, _ in got] == list(range(600, 900))
    labels = {r.row_id: r.label for r in test.collect()}
    assert np.mean([labels[i] == p for i, p in got]) > 0.75
    CV.save_model(fitted, str(tmp_path / "m"))
    assert _predictions(spec, CV.load_model(str(tmp_path / "m"), "row_id"), test) == got
    again = spec.fit(train.repartition(3), {"n_estimators": 12}, ROLES)
    assert _predictions(spec, again, test.repartition(2)) == got


def test_few_and_many_rows_agree(spark, monkeypatch):
    """The forest grown in tasks predicts as well as Spark's, row by row mostly the same class."""
    df, spec = _table(spark, 1500, 4, missing=0.0), E.get_spec("tabular_rf")
    train, test = df.where("row_id < 1000"), df.where("row_id >= 1000")
    a = _predictions(spec, spec.fit(train, {"n_estimators": 60}, ROLES), test)
    _bounds(monkeypatch, 100)
    b = _predictions(spec, spec.fit(train, {"n_estimators": 60}, ROLES), test)
    assert np.mean([p == q for p, q in zip(a, b)]) > 0.92
    labels = {r.row_id: r.label for r in test.collect()}
    good = [np.mean([labels[i] == p for i, p in got]) for got in (a, b)]
    assert abs(good[0] - good[1]) < 0.03


def _plain(x, y, c, weights, depth, columns, at=0):
    """One node after the other: (column, bin, left, right) or the leaf's shares."""
    total = np.bincount(y, c, len(weights)) * weights
    best = (1e-12, None)
    if depth and (total > 0).sum() > 1:
        for j in columns:
            for cut in np.unique(x[:, j])[:-1]:
                go = x[:, j] <= cut
                left, right = (np.bincount(y[m], c[m], len(weights)) * weights for m in (go, ~go))
                gain = (left @ left / left.sum() + right @ right / right.sum() - total @ total / total.sum()) / total.sum()
                if gain > best[0] + 1e-15:
                    best = (gain, (j, cut))
    if best[1] is None:
        return total / total.sum(), total
    j, cut = best[1]
    go = x[:, j] <= cut
    sides = [_plain(x[m], y[m], c[m], weights, depth - 1, columns) for m in (go, ~go)]
    if all(len(s) == 2 for s in sides) and sides[0][1].argmax() == sides[1][1].argmax():
        return total / total.sum(), total
    return j, cut, *sides


def _shares(node, row):
    while len(node) == 4:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node[0]


@pytest.mark.parametrize("depth", [30, 3])
def test_grown_nodes_equal_plain_recursion(monkeypatch, depth):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 6, size=(400, 1)).astype(np.uint8)
    x = np.concatenate([x, rng.integers(0, 9, size=(400, 2)).astype(np.uint8)], axis=1)
    y, c = rng.integers(0, 3, 400), rng.integers(1, 4, 400).astype(float)
    root, weights = np.sort(rng.integers(0, 3, 400)), np.array([1.0, 0.7, 2.5])
    monkeypatch.setattr(FO, "chosen", lambda width: width)
    monkeypatch.setattr(FO, "AT_ONCE", 300)
    nodes = FO.grow(x, y, c, root, np.zeros(3, int), weights, depth, 10, rng)
    got = nodes.shares[nodes.left[nodes.leaf(x, root)]]
    trees = [_plain(x[root == r], y[root == r], c[root == r], weights, depth, range(3)) for r in range(3)]
    assert np.allclose(got, [_shares(trees[r], row) for r, row in zip(root, x)])


def test_no_group_or_pass_holds_more_than_its_bound(spark, monkeypatch):
    """Groups have up to CELLS cells, every bagged cell is in one of them or in a leaf, and equal rows are one cell."""
    _bounds(monkeypatch, 60)
    df = _table(spark, 500, 2, copies=5)
    rows = df.select(F.array("a", "b", "c").alias("x"), F.when(F.col("label") == "hi", 0.0).when(F.col("label") == "lo", 1.0).otherwise(2.0).alias("y"))
    fit = FO.Forest(rows, 3, [1.0, 1.0, 1.0], FO.Settings(trees=5))
    held = fit.blocks.collect()
    assert len(held) > 2 and sum(np.frombuffer(r.m, "<i8").sum() for r in held) == 2500
    assert sum(r.n for r in held) <= 500
    monkeypatch.setattr(FO, "NUMBERS", 2000)  # some nodes a pass
    model, table = fit.run()
    for t, top in enumerate(fit.tops):
        bagged = sum(np.count_nonzero(FO.bag(42, t, r.part, np.frombuffer(r.m, "<i8"))) for r in held)
        leaves = [i for i, col in enumerate(top.column) if col < 0]
        assert top.cells[0] == bagged == sum(top.cells[i] for i in leaves)
        assert all(top.cells[i] <= 60 or np.count_nonzero(top.total[i]) < 2 for i in leaves)
    buckets = {}
    for t, d in enumerate(model["tops"]):
        for i, b in enumerate(d["bucket"]):
            if b >= 0:
                buckets[b] = buckets.get(b, 0) + fit.tops[t].cells[i]
    assert max(buckets.values()) <= 60 and table.count() == len(buckets)


def test_parts_are_kept_in_order():
    rng = np.random.default_rng(1)
    at, side = np.sort(rng.integers(0, 7, 50)), rng.random(50) < 0.4
    order = FO._parted(at, side, 7)
    assert order.tolist() == sorted(range(50), key=lambda i: (at[i], side[i], i))
    assert Binning([np.array([0.5])]).bins(np.array([[np.nan], [0.5], [2.0]])).ravel().tolist() == [2, 0, 1]
