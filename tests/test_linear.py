"""Shared moments and column blocks against closed forms and against refitting split by split."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorewell.operators import linear as LIN
from scorewell.operators import metrics as M
from scorewell.operators import wide as W
from scorewell.plans import cv as CV
from scorewell.plans import estimators as E
from scorewell.plans import linear_models as LM


def _moments(x, y, origin):
    a = x - origin
    return LIN.Moments(len(y), y.sum(), y @ y, a.sum(axis=0), a.T @ y, a.T @ a, origin)


def _ridge(x, y, alpha):
    z, yc = x - x.mean(axis=0), y - y.mean()
    std = x.std(axis=0)
    z = z / np.where(std > 0, std, 1)
    return z @ np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ yc) + y.mean()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.01, 100), st.sampled_from([0.0, 1e9]))
def test_ridge_from_moments(seed, alpha, far):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, 4)) + far
    x[:, 2] = far  # a constant column
    y = rng.normal(size=30)
    (m,) = LIN.ridge(_moments(x, y, x[0]), [alpha])
    assert np.allclose((x - m.mean) @ m.raw + m.y_mean, _ridge(x - far, y, alpha), atol=1e-6)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.01, 1), st.floats(0.05, 0.95))
def test_elastic_net_conditions(seed, alpha, l1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 8))
    x[:, 5] = x[:, 4]  # equal columns
    y = x[:, 0] * 2 - x[:, 4] + rng.normal(size=40)
    m = LIN.elastic_net(_moments(x, y, np.zeros(8)), alpha, l1)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    g = z.T @ (y - y.mean() - z @ m.weights) / 40 - alpha * (1 - l1) * m.weights
    w = m.weights
    off = np.where(w != 0, np.abs(g - alpha * l1 * np.sign(w)), np.abs(g) - alpha * l1)
    assert off.max() < 1e-6
    assert abs(w[4] - w[5]) < 1e-5


def _texts(n, seed=4, size=40):
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("ACGT "), size=rng.integers(3, size))) for _ in range(n)]
    return texts, np.array([t.count("G") - t.count("AC") + rng.normal() * 0.3 for t in texts])


def _frame(spark, texts, y):
    rows = [(100 + i, t, float(v), i % 5) for i, (t, v) in enumerate(zip(texts, y))]
    return spark.createDataFrame(rows, "row_id long, sequence string, labels double, fold_id int").repartition(3)


ROLES = E.Roles("row_id", "labels", seq_col="sequence")


def _table(preds):
    return {(r.trial, r.split, r.row_id): r.p for r in preds.collect()}


@pytest.mark.parametrize("name,configs", [
    ("kmer_ridge", [{"ngram_lo": 2, "ngram_hi": 3, "alpha": 0.5}, {"ngram_lo": 1, "ngram_hi": 2, "alpha": 20.0, "use_engineered": False}]),
    ("kmer_elasticnet", [{"ngram_lo": 2, "ngram_hi": 3, "alpha": 0.2, "l1_ratio": 0.6}]),
])
def test_narrow_wide_and_refitted_agree(spark, monkeypatch, name, configs):
    """Shared moments, column blocks (both solvers) and a fit per split and config give the same predictions."""
    df = _frame(spark, *_texts(60))
    spec, splits = E.get_spec(name), CV.Splits(df, "fold_id", [0, 1])
    shared = _table(CV.trial_predictions(spec, splits, ROLES, configs))
    assert len(shared) == len(configs) * 24
    refit = {}
    for t, c in enumerate(configs):
        for s in (0, 1):
            fitted = spec.fit(df.where(F.col("fold_id") != s), c, ROLES)
            for r in spec.predict(fitted, df.where(F.col("fold_id") == s)).collect():
                refit[(t, s, r.row_id)] = r.prediction
    agree = lambda a, b: a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a], atol=1e-5)
    assert agree(shared, refit)
    monkeypatch.setattr(LM, "small_vocabulary", lambda *a: None)  # as if there were too many k-mers
    monkeypatch.setattr(W, "BLOCK_ENTRIES", 500)
    assert agree(shared, _table(CV.trial_predictions(spec, splits, ROLES, configs)))
    if name == "kmer_ridge":
        monkeypatch.setattr(W, "GRAM_COLUMNS", 8)  # conjugate gradients
        assert agree(shared, _table(CV.trial_predictions(spec, splits, ROLES, configs)))


def test_a_wide_model_is_a_table(spark, tmp_path, monkeypatch):
    texts, y = _texts(50, 7)
    texts[3] = None
    df = _frame(spark, texts, y)
    spec = E.get_spec("kmer_ridge")
    cfg = {"ngram_lo": 2, "ngram_hi": 4, "alpha": 3.0}
    narrow = {r.row_id: r.prediction for r in spec.predict(spec.fit(df.where("sequence is not null"), cfg, ROLES), df.where("sequence is not null")).collect()}
    monkeypatch.setattr(LM, "small_vocabulary", lambda *a: None)
    fitted = spec.fit(df.where("sequence is not null"), cfg, ROLES)
    CV.save_model(fitted, str(tmp_path / "m"))
    again = CV.load_model(str(tmp_path / "m"), "row_id", "kmer_ridge")
    out = again.model.transform(df.where("sequence is not null"))
    assert set(out.columns) == {*df.columns, "prediction"}
    got = {r.row_id: r.prediction for r in out.collect()}
    assert got.keys() == narrow.keys() and np.allclose([got[k] for k in got], [narrow[k] for k in got], atol=1e-6)


def test_too_many_rows_go_to_iterations(spark, monkeypatch):
    texts, y = _texts(40, 9)
    df = _frame(spark, texts, y)
    spec, cfg = E.get_spec("kmer_ridge"), {"ngram_lo": 1, "ngram_hi": 2, "alpha": 2.0}
    want = {r.row_id: r.prediction for r in spec.predict(spec.fit(df, cfg, ROLES), df).collect()}
    monkeypatch.setattr(LM, "small_vocabulary", lambda *a: None)
    monkeypatch.setattr(W, "MOST_ROWS", 10)
    got = {r.row_id: r.prediction for r in spec.predict(spec.fit(df, cfg, ROLES), df).collect()}
    assert np.allclose([got[k] for k in want], list(want.values()), atol=1e-2)


def test_spread_join_with_a_hot_key(spark):
    from scorewell.operators.features import spread_join

    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)], "i long, k string")
    table = spark.createDataFrame([("hot", 1), *[(f"k{j}", j) for j in range(40)], ("none", 0)], "k string, v int")
    rows = lambda df: Counter(map(tuple, df.select("i", "k", "v").collect()))
    assert rows(spread_join(facts, table, "k")) == rows(facts.join(table, "k"))


def test_equal_rankings_have_equal_scores(spark):
    """Spearman depends on the ranking alone, to the last bit, under any partitioning."""
    rng = np.random.default_rng(1)
    y = rng.normal(size=400).round(1)
    rows = [(float(v), float(v * 0.3 + rng.normal())) for v in y]
    scores = set()
    for parts, f in [(1, lambda p: p), (7, lambda p: 1000 * p + 3), (16, lambda p: np.exp(p))]:
        df = spark.createDataFrame([(a, float(f(b))) for a, b in rows], "y double, p double").repartition(parts)
        scores.add(M.regression_metrics(df).first()["spearman"])
    assert len(scores) == 1
    a, b = (np.array(c) for c in zip(*rows))
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert scores.pop() == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1], abs=1e-12)


def test_trials_that_run_side_by_side(spark):
    """Trials of a pipeline without a shared way share no cache: repeated runs agree."""
    texts, y = _texts(60, 3)
    df = spark.createDataFrame([(i, float(len(t)), float(t.count("G")), float(v)) for i, (t, v) in enumerate(zip(texts, y))],
                               "row_id long, a double, b double, target double").repartition(4)
    roles = E.Roles("row_id", "target", feature_cols=["a", "b"])
    splits = CV.make_splits(df, roles, "regression")
    configs = [{"max_iter": 2, "max_depth": d} for d in (2, 3, 2)]
    runs = [_table(CV.trial_predictions(E.get_spec("tabular_hgbr"), splits, roles, configs)) for _ in range(2)]
    assert runs[0].keys() == runs[1].keys() and len(runs[0]) == 180
    assert all(runs[0][(0, s, i)] == runs[0][(2, s, i)] for t, s, i in runs[0] if t == 0)


def test_entries_are_packed_before_they_move(spark, monkeypatch):
    """Blocks hold every entry once, whatever its value's size; the entries are neither stored nor shuffled as rows."""
    rng = np.random.default_rng(4)
    want = {(int(r), f"c{c}é"): float(v) for (r, c), v in zip({(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2))}, rng.choice([1, 2, 300, 70_000, 0.25, -3], 900))}
    entries = spark.createDataFrame([(100 + r, n, v) for (r, n), v in want.items()], "r long, name string, v double").repartition(4)
    monkeypatch.setattr(W, "BLOCK_ENTRIES", 150)
    got, names = {}, []
    for batch in W.packed(entries, np.arange(100, 160)).toArrow().to_batches():
        for i in range(batch.num_rows):
            b = W.Block(batch, i)
            here = batch.column(0)[i].as_py()
            names += here
            got.update({(int(r), here[c]): v for r, c, v in zip(b.row, b.column, b.value)})
            assert np.allclose(b.sums(b.value), np.bincount(b.column, b.value, b.width))
    assert got == want and len(names) == len(set(names)) == len({n for _, n in want})

    stored = []
    keep = LM.materialize
    monkeypatch.setattr(LM, "materialize", lambda df, name: stored.append(name) or keep(df, name))
    texts, y = _texts(30, 5)
    columns = LM.wide_columns(_frame(spark, texts, y), "sequence", "labels", F.lit(None), 0, 1, 2, True)
    assert stored == ["wide-rows"]
    assert all(f.dataType.typeName() in ("array", "binary") for f in columns.table.schema)


def test_scales_of_columns_are_stored_with_their_block(spark, monkeypatch):
    """A column's mean and deviation over each split's training rows are taken once, not in every pass."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (40, 30)) * rng.integers(0, 2, (40, 30))
    entries = spark.createDataFrame([(int(r), f"c{c}", float(x[r, c])) for r, c in zip(*np.nonzero(x))], "r long, name string, v double").repartition(3)
    rows = spark.createDataFrame([(i, float(x[i] @ np.arange(30) + 0.1 * i), i % 4 if i % 3 else None) for i in range(40)], "r long, y double, fold int")
    monkeypatch.setattr(W, "BLOCK_ENTRIES", 60)
    columns = W.Columns(rows, entries, 2)
    for batch in columns.table.toArrow().to_batches():
        for i in range(batch.num_rows):
            b, names = W.Block(batch, i), batch.column(0)[i].as_py()
            mine = x[:, [int(n[1:]) for n in names]]
            for s in (0, 1):
                part = mine[columns.train[s]]
                std = part.std(axis=0)
                inv = np.divide(1.0, std, out=np.zeros(len(std)), where=std > 0)
                assert np.allclose(b.scales[s], [part.mean(axis=0), inv])
                z, v = (mine - part.mean(axis=0)) * inv, rng.normal(size=40)
                v -= v.mean()
                assert np.allclose(b.along(v, s), z.T @ v) and np.allclose(b.across(inv, s, 40), z @ inv)


def test_documents_are_dealt_before_their_kmers_are_counted(spark):
    """A table in one small file is not one task's work."""
    from scorewell.plans import q_models as Q

    docs = Q.doc_seq(spark, "/root/testdata/sf0.001")
    assert docs.rdd.getNumPartitions() > 1 or spark.conf.get("spark.sql.shuffle.partitions") == "1"
    assert docs.count() == docs.select("row_id").distinct().count() == 200
