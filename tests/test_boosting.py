"""Histogram boosting against a plain one-node-at-a-time version."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewell.operators import boosting as B


def _plain_tree(x, g, h, edges, s):
    """Best-first growth on raw arrays; a list of (column, threshold) in order of splitting, and leaf values by row."""

    def best(rows):
        top = None
        G, H = g[rows].sum(), h[rows].sum()
        for c, e in enumerate(edges):
            gone = np.isnan(x[rows, c])
            for j, t in enumerate(list(e) + [np.inf]):
                for missing_left in (True, False):
                    if t == np.inf and (missing_left or not gone.any()):
                        continue
                    if missing_left and not gone.any():
                        continue
                    go = np.where(gone, missing_left, x[rows, c] <= t)
                    n = go.sum()
                    if min(n, len(rows) - n) < s.min_leaf or min(h[rows][go].sum(), h[rows][~go].sum()) < s.min_hessian:
                        continue
                    two = sum(g[rows][m].sum() ** 2 / (h[rows][m].sum() + s.l2) for m in (go, ~go))
                    gain = two - G**2 / (H + s.l2)
                    if gain > 1e-12 * two and (top is None or gain > top[0] * (1 + 1e-9)):
                        top = (gain, c, t, rows[go], rows[~go])
        return top

    values, order, heap, n, leaves = np.zeros(len(x)), [], [], 0, 1

    def leaf_or_queue(rows, depth):
        nonlocal n
        values[rows] = -s.rate * g[rows].sum() / (h[rows].sum() + s.l2)
        found = best(rows) if depth < s.depth else None
        if found:
            heapq.heappush(heap, (-found[0], n, found, depth))
            n += 1

    leaf_or_queue(np.arange(len(x)), 0)
    while heap and leaves < s.leaves:
        _, _, (_, c, t, left, right), depth = heapq.heappop(heap)
        order.append((c, t))
        leaves += 1
        leaf_or_queue(left, depth + 1)
        leaf_or_queue(right, depth + 1)
    return order, values


def _rows(spark, x, y, w=None, parts=3):
    w = np.ones(len(y)) if w is None else w
    data = [([float(v) for v in a], float(b), float(c), False) for a, b, c in zip(x, y, w)]
    return spark.createDataFrame(data, "x array<double>, y double, w double, held boolean").repartition(parts)


def _data(n=260, seed=5):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.normal(size=n).round(1)], axis=1)
    x[rng.random(n) < 0.15, 2] = np.nan
    y = np.sin(2 * x[:, 0]) + x[:, 1] * 0.4 + np.where(np.isnan(x[:, 2]), 1.3, x[:, 2] * 0.2) + rng.normal(size=n) * 0.1
    return x, y


def _edges(x):
    out = []
    for c in range(x.shape[1]):
        v = np.unique(x[:, c][~np.isnan(x[:, c])])
        out.append(v[:-1] + (v[1:] - v[:-1]) / 2)
    return out


def _raw(model, x, steps=None):
    flat = model.arrays()
    flat.roots = flat.roots[:steps]
    return flat.add(np.tile(model.baseline, (len(x), 1)), x, flat.threshold, lambda v, c: np.isnan(v))


@pytest.mark.parametrize("leaves,depth,l2", [(6, 4, 0.5), (31, 3, 0.0), (4, 8, 10.0)])
def test_regression_trees_equal_plain_growth(spark, leaves, depth, l2):
    x, y = _data(240)
    s = B.Settings(steps=3, rate=0.3, depth=depth, leaves=leaves, min_leaf=8, l2=l2)
    model = B.fit(_rows(spark, x, y), 3, "squared", 1, s)
    raw = np.full(len(y), y.mean())
    for step in range(3):
        order, values = _plain_tree(x, raw - y, np.ones(len(y)), _edges(x), s)
        raw += values
        assert len(order) == sum(model.arrays().left[model.roots[step][0]:(model.roots + [[len(model.left)]])[step + 1][0]] >= 0)
        assert np.allclose(_raw(model, x, step + 1)[:, 0], raw, atol=1e-9)


def test_class_trees_equal_plain_growth_with_weights(spark):
    x, y = _data(240, 6)
    y = np.digitize(y, [0.2, 1.0]).astype(float)
    w = np.array([1.0, 0.7, 2.0])[y.astype(int)]
    s = B.Settings(steps=2, rate=0.2, depth=3, leaves=5, min_leaf=10)
    model = B.fit(_rows(spark, x, y, w), 3, "log", 3, s)
    share = np.array([w[y == k].sum() for k in range(3)]) / w.sum()
    raw = np.tile(np.log(share), (len(y), 1))
    for step in range(2):
        p = np.exp(raw) / np.exp(raw).sum(axis=1, keepdims=True)
        own = y.astype(int)[:, None] == np.arange(3)
        raw = raw + np.stack([_plain_tree(x, w * (p - own)[:, k], w * (p * (1 - p))[:, k], _edges(x), s)[1] for k in range(3)], axis=1)
        assert np.allclose(_raw(model, x, step + 1), raw, atol=1e-9)


def test_two_classes_take_one_tree_a_step(spark):
    x, y = _data(200, 7)
    y = (y > 0.5).astype(float)
    s = B.Settings(steps=2, rate=0.5, depth=3, min_leaf=10)
    model = B.fit(_rows(spark, x, y), 3, "log", 2, s)
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(2):
        p = 1 / (1 + np.exp(-raw))
        raw = raw + _plain_tree(x, p - y, p * (1 - p), _edges(x), s)[1]
    assert [len(r) for r in model.roots] == [1, 1]
    assert np.allclose(_raw(model, x)[:, 0], raw, atol=1e-9)


def test_scores_written_between_steps_change_nothing(spark, monkeypatch):
    x, y = _data(200, 8)
    s = B.Settings(steps=5, depth=3, min_leaf=10)
    once = B.fit(_rows(spark, x, y), 3, "squared", 1, s)
    monkeypatch.setattr(B, "REWRITE", 2)
    again = B.fit(_rows(spark, x, y, parts=7), 3, "squared", 1, s)
    assert once.column == again.column and np.allclose(once.value, again.value, atol=1e-12)


def test_a_column_with_many_values_gets_quantile_bins(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=3000)
    rows = _rows(spark, np.stack([v, np.full(3000, np.nan), rng.integers(0, 3, 3000)], axis=1), v)
    b = B.binning(rows, 3)
    assert 200 < len(b.edges[0]) < B.BINS and len(b.edges[1]) == 0 and list(b.edges[2]) == [0.5, 1.5]
    counts = np.bincount(b.bins(np.stack([v, v * np.nan, v * 0], axis=1))[:, 0])
    assert counts.max() < 3000 / B.BINS * 2


def test_held_back_rows_end_the_steps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = rng.normal(size=400)  # nothing to learn
    rows = _rows(spark, x, y).withColumn("held", F.get("x", F.lit(0)) > 0.8)
    model = B.fit(rows, 2, "squared", 1, B.Settings(steps=60, rate=0.3, min_leaf=5, patience=4))
    assert 4 < len(model.roots) < 60
    kept = x[:, 0] <= 0.8
    assert model.baseline[0] == pytest.approx(y[kept].mean())


def test_empty_constant_and_null_rows(spark):
    with pytest.raises(ValueError):
        B.fit(_rows(spark, np.empty((0, 1)), []), 1, "squared", 1, B.Settings(steps=1))
    rows = _rows(spark, np.full((50, 1), 2.0), np.arange(50)).union(
        spark.createDataFrame([([2.0], None, 1.0, False)], "x array<double>, y double, w double, held boolean"))
    model = B.fit(rows, 1, "squared", 1, B.Settings(steps=2))
    assert _raw(model, np.array([[2.0], [np.nan], [9.0]]))[:, 0] == pytest.approx([24.5] * 3)


def test_saved_trees_predict_the_same(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from scorewell.plans import estimators as E

    x, y = _data(200, 9)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "row_id long, a double, b double, c double, target double")
    roles, spec = E.Roles("row_id", "target", feature_cols=["a", "b", "c"]), E.get_spec("tabular_hgbr")
    fitted = spec.fit(df, {"max_iter": 4}, roles)
    fitted.model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(df)
    a = {r["row_id"]: r["prediction"] for r in spec.predict(fitted, df).collect()}
    assert {r["row_id"]: r["prediction"] for r in again.collect()} == a and len(a) == 200


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_leaf_masks_reach_the_same_leaves(depth):
    """Trees are applied by masks of leaves; a tree with too many leaves is walked as before."""
    rng = np.random.default_rng(depth)
    missing = np.array([4, 250, 9])
    t = B.Trees(np.zeros(1))

    def put(d):
        at, c = len(t.column), int(rng.integers(3))
        inner = d < depth and (d < 2 or rng.random() < 0.8)
        for a, v in ((t.column, c), (t.bin, int(rng.integers(missing[c]))), (t.threshold, 0.0), (t.missing_left, bool(rng.random() < 0.5)),
                     (t.value, float(at)), (t.left, -1), (t.right, -1)):
            a.append(v)
        if inner:
            t.left[at], t.right[at] = put(d + 1), put(d + 1)
        return at

    t.roots.append([put(0)])
    flat = t.arrays()
    x = np.stack([rng.integers(0, m + 1, 500) for m in missing], axis=1).astype(np.uint8)
    want = flat.reach(x, 0, flat.bin, lambda v, c: v == missing[c])
    assert (flat.masks(0, missing).reach(x) == want).all()
    assert (B.binned_add(flat, missing, 0)(np.zeros((500, 1)), x)[:, 0] == want).all()


def test_masks_are_for_small_trees():
    t = B.Trees(np.zeros(1))
    for i in range(2 * B.MASK_LEAVES + 1):  # a chain with MASK_LEAVES + 1 leaves
        for a, v in ((t.column, 0), (t.bin, i // 2), (t.threshold, 0.0), (t.missing_left, False), (t.value, 0.0),
                     (t.left, i + 1 if i % 2 == 0 and i < 2 * B.MASK_LEAVES else -1), (t.right, i + 2 if i % 2 == 0 and i < 2 * B.MASK_LEAVES else -1)):
            a.append(v)
    flat, x = t.arrays(), np.arange(256, dtype=np.uint8)[:, None]
    assert flat.masks(0, np.array([255])) is None
    want = flat.reach(x, 0, flat.bin, lambda v, c: v == 255)
    assert (B.binned_reach(flat, 0, np.array([255]))(x) == want).all()


def test_scores_are_written_earlier_where_rows_are_many(spark):
    """Applying the trees of up to 16 steps in each of a step's passes took most of a large fit's time."""
    x, y = _data(200, 8)
    fit = B.Boosting(_rows(spark, x, y), 3, "squared", 1, B.Settings(steps=1, depth=1, min_leaf=10))
    fit.step()
    assert fit.rows == 200 and not fit._rewriting_pays()
    fit.rows = 10**9
    assert fit._rewriting_pays()
    fit.close()


@pytest.mark.parametrize("patience", [10, 2])
def test_fits_side_by_side_equal_fits_by_passes(spark, monkeypatch, patience):
    """Each split and setting fitted in a task of its own predicts what a fit by passes over the rows does."""
    from scorewell.plans import cv as CV
    from scorewell.plans import estimators as E

    x, y = _data(400, 9)
    rows = [(1000 + i, *[None if np.isnan(v) else float(v) for v in a], float(b), i % 4) for i, (a, b) in enumerate(zip(x, y))]
    rows += [(5000, 0.1, 1.0, 0.5, None, 1), (5001, 0.1, 1.0, 0.5, None, 3), (None, 0.2, 2.0, None, 1.5, 0), (1003, 0.3, 0.0, 0.5, 0.5, 2)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, target double, fold_id int").repartition(3)
    monkeypatch.setattr(B, "HOLD_BACK_FROM", 100)  # so that steps end early
    monkeypatch.setattr(B.Settings, "patience", patience)
    roles = E.Roles("row_id", "target", feature_cols=["a", "b", "c"])
    spec, splits = E.get_spec("tabular_hgbr"), CV.Splits(df, "fold_id", [0, 1, 2])
    configs = [{"max_iter": 6, "max_depth": 3}, {"max_iter": 4, "max_depth": 8, "learning_rate": 0.3}]
    made = CV.trial_predictions(spec, splits, roles, configs).collect()
    assert len(made) == 2 * sum(r[-1] < 3 for r in rows)
    want = {}
    for t, c in enumerate(configs):
        for s in (0, 1, 2):
            fitted = spec.fit(df.where(F.col("fold_id") != s), c, roles)
            for r in fitted.model.transform(df.where(F.col("fold_id") == s)).collect():
                want[(t, s, r.row_id, r.target)] = r.prediction
    got = {(r.trial, r.split, r.row_id, r.y): r.p for r in made}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-9)


def test_rows_beyond_a_task_are_fitted_by_passes(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i)], float(i), i % 3, False) for i in range(30)], "r long, x array<double>, y double, fold int, back boolean")
    assert B.fit_side_by_side(rows, 1, 3, [B.Settings(steps=1)]).count() == 30
    monkeypatch.setattr(B, "TASK_BYTES", 100)
    assert B.fit_side_by_side(rows, 1, 3, [B.Settings(steps=1)]) is None
