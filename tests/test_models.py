"""E1/E7 against closed forms, the others by thresholds, A9 round trips, the whole run, G1-G3, G5, G8, D2-D4."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewell.operators import folds as FO
from scorewell.operators import leaderboard as L
from scorewell.operators import selection as SE
from scorewell.plans import cv as CV
from scorewell.plans import estimators as E
from scorewell.plans import experiment as X
from scorewell.plans import planning as PL
from scorewell.sources import submissions as S
from scorewell.sources.tables import fold_split


def _char_ngrams(text, lo, hi):
    t = re.sub(r"\s\s+", " ", text.lower())
    out = []
    for n in range(lo, min(hi + 1, len(t) + 1)):
        out += [t[i : i + n] for i in range(len(t) - n + 1)]
    return out


def _ridge(X, y, alpha):
    xm, ym = X.mean(0), y.mean()
    w = np.linalg.solve((X - xm).T @ (X - xm) + alpha * np.eye(X.shape[1]), (X - xm).T @ (y - ym))
    return lambda Z: (Z - xm) @ w + ym


def test_kmer_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    seqs = ["".join(rng.choice(list("ACGT"), size=rng.integers(8, 20))) for _ in range(60)]
    y = np.array([s.count("G") * 1.5 - s.count("AT") + rng.normal() for s in seqs])
    df = spark.createDataFrame([(i, s, float(v)) for i, (s, v) in enumerate(zip(seqs, y))], "row_id long, sequence string, labels double")
    roles = E.Roles("row_id", "labels", seq_col="sequence")
    spec = E.get_spec("kmer_ridge")
    cfg = {"ngram_lo": 2, "ngram_hi": 3, "alpha": 2.0}
    fitted = spec.fit(df, cfg, roles)
    got = {r["row_id"]: r["prediction"] for r in spec.predict(fitted, df).collect()}
    # numpy: counts + GC + length, divide by population std (0 -> 1), ridge with intercept
    counts = [Counter(_char_ngrams(s, 2, 3)) for s in seqs]
    vocab = sorted(set().union(*counts))
    gc = [(s.upper().count("G") + s.upper().count("C")) / max(len(s), 1) for s in seqs]
    X = np.array([[c[k] for k in vocab] + [g, len(s)] for c, g, s in zip(counts, gc, seqs)], dtype=float)
    sd = X.std(axis=0)
    Xs = X / np.where(sd > 0, sd, 1.0)
    exp = _ridge(Xs, y, 2.0)(Xs)
    assert np.allclose([got[i] for i in range(len(seqs))], exp, atol=1e-6)


def test_tabular_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(80, 3)) * np.array([1.0, 5.0, 0.1])
    y = X @ np.array([2.0, -1.0, 30.0]) + rng.normal(size=80)
    rows = [(i, *map(float, X[i]), float(y[i])) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, target double")
    roles = E.Roles("row_id", "target", feature_cols=["a", "b", "c"])
    spec = E.get_spec("tabular_ridge")
    fitted = spec.fit(df, {"alpha": 5.0}, roles)
    got = {r["row_id"]: r["prediction"] for r in spec.predict(fitted, df).collect()}
    Xs = (X - X.mean(0)) / X.std(0)
    exp = _ridge(Xs, y, 5.0)(Xs)
    assert np.allclose([got[i] for i in range(80)], exp, atol=1e-6)


def test_logreg_learns_planted_signal_and_roundtrips(spark, tmp_path):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(300, 2))
    lab = np.where(X[:, 0] + 0.2 * X[:, 1] > 0.3, "hi", np.where(X[:, 0] < -0.8, "lo", "mid"))
    df = spark.createDataFrame([(i, float(X[i, 0]), float(X[i, 1]), str(lab[i])) for i in range(300)], "row_id long, a double, b double, label string")
    roles = E.Roles("row_id", "label", feature_cols=["a", "b"])
    spec = E.get_spec("tabular_logreg")
    fitted = spec.fit(df, None, roles)
    pred = spec.predict(fitted, df).join(df, "row_id")
    acc = pred.select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    majority = Counter(lab).most_common(1)[0][1] / len(lab)
    assert acc > majority + 0.1
    CV.save_model(fitted, str(tmp_path / "m"))
    again = CV.load_model(str(tmp_path / "m"), "row_id")
    a = sorted(spec.predict(fitted, df).collect())
    b = sorted(spec.predict(again, df).collect())
    assert a == b


def test_mean_predictor(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0)], "row_id long, labels double")
    spec = E.get_spec("mean_predictor")
    f = spec.fit(df, None, E.Roles("row_id", "labels"))
    assert {r["prediction"] for r in spec.predict(f, df).collect()} == {2.0}


def test_seeded_search():
    assert CV.uniform(7, "alpha", 42) == pytest.approx(0.07094025798141956)
    spec = E.get_spec("kmer_ridge")
    a, b = CV.sample_trials(spec, 5, 42), CV.sample_trials(spec, 5, 42)
    assert a == b
    for c in a:
        assert 2 <= c["ngram_lo"] <= 4 and 5 <= c["ngram_hi"] <= 8 and 1e-3 <= c["alpha"] <= 1e3


def test_candidates_and_plan_rows(spark):
    names = lambda d, t: [r.pipeline for r in PL.candidates(spark, d, t).orderBy("place").collect()]
    assert names("dataframe_sequence", "regression") == ["kmer_ridge", "kmer_elasticnet", "kmer_hgbr"]
    assert names("anndata", "regression") == ["tabular_ridge", "tabular_hgbr"]
    assert names("dataframe_sequence", "classification") == []
    fast = PL.plan_steps(spark, "dataframe_sequence", "regression", "fast").collect()
    assert [(r.step, r.experiment, r.trials) for r in fast] == [
        (0, "baseline_kmer_ridge", 0), (1, "tuned_kmer_ridge", 10), (2, "tuned_kmer_elasticnet", 10)
    ]
    thorough = PL.plan_steps(spark, "dataframe_tabular", "classification", "thorough").collect()
    assert len(thorough) == 5 and thorough[-1].experiment == "ensemble" and thorough[-1].pipeline is None


@pytest.mark.parametrize("smallest,expected", [(1, 2), (2, 2), (7, 3)])
def test_adaptive_splits(spark, smallest, expected):
    rows = [(i, "a") for i in range(smallest)] + [(100 + i, "b") for i in range(10)]
    assert FO.adaptive_splits(spark.createDataFrame(rows, "id long, y string"), "y") == expected


def test_folds_disjoint_and_balanced(spark):
    df = spark.createDataFrame([(i, "a" if i % 7 else "b") for i in range(500)], "id long, y string")
    k = FO.kfold(df, "id", 3, 42).groupBy("cv_fold").count().collect()
    sizes = sorted(r["count"] for r in k)
    assert sum(sizes) == 500 and sizes[-1] - sizes[0] <= 1
    s = FO.stratified_kfold(df, "id", "y", 3, 42).groupBy("y", "cv_fold").count().collect()
    for cls in ("a", "b"):
        c = sorted(r["count"] for r in s if r["y"] == cls)
        assert c[-1] - c[0] <= 1


def test_select_best_and_vote(spark):
    ex = spark.createDataFrame([("a", 0, 0.7), ("b", 1, 0.9), ("c", 2, 0.9)], "experiment string, ordinal int, value double")
    assert SE.select_best(ex).first()["experiment"] == "b"
    assert [r["experiment"] for r in SE.top_k_experiments(ex, 2).collect()] == ["b", "c"]
    votes = spark.createDataFrame(
        [(1, "1"), (1, "2"), (2, "2"), (2, "2"), (3, "0"), (3, "0"), (3, "1")], "id long, p string"
    )
    assert {r["id"]: r["p"] for r in SE.ensemble_vote(votes).collect()} == {1: "1", 2: "2", 3: "0"}


def test_expr_svm_calibrated_beats_majority_and_saves(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    centers = np.array([[3.0, 0, 0, 0], [0, 3.0, 0, 0], [0, 0, 3.0, 0]])
    y = rng.integers(0, 3, size=90)
    X = centers[y] + rng.normal(size=(90, 4))
    df = spark.createDataFrame([(i, Vectors.dense(X[i]), int(y[i])) for i in range(90)], ["cell_id", "features", "label"])
    spec = E.get_spec("expr_svm")
    fitted = spec.fit(df, {"n_components": 3}, E.Roles("cell_id", "label", vector_col="features"))
    pred = spec.predict(fitted, df).join(df, "cell_id")
    acc = pred.select(F.avg((F.col("prediction") == F.col("label").cast("string")).cast("double"))).first()[0]
    assert acc > 0.8
    CV.save_model(fitted, str(tmp_path / "svm"))
    again = CV.load_model(str(tmp_path / "svm"), "cell_id")
    assert sorted(spec.predict(fitted, df).collect()) == sorted(spec.predict(again, df).collect())


def _seq_frame(spark, n=90, seed=4):
    rng = np.random.default_rng(seed)
    seqs = ["".join(rng.choice(list("ACGT"), size=12)) for _ in range(n)]
    rows = [(i, s, float(s.count("G") + rng.normal() * 0.1), i % 10) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "row_id long, sequence string, labels double, fold_id int")


def test_run_with_an_ensemble_end_to_end(spark, tmp_path):
    """Every step of a standard run on quick pipelines: plan, trials, ensemble, refit, board row."""
    import json

    rng = np.random.default_rng(12)
    x = rng.normal(size=(90, 2))
    rows = [(i, *map(float, x[i]), float(x[i, 0] * 2 + rng.normal() * 0.2), i % 10) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, target double, fold_id int")
    roles = E.Roles("row_id", "target", feature_cols=["a", "b"])
    X.register_dataset(X.Dataset(
        "toy-tab", lambda s, fold: fold_split(df, int(fold)), X.default_evaluate("regression"), roles, "dataframe_tabular", "regression"
    ))
    results, preds = X.run_experiments(
        spark, "toy-tab", "0", "me", str(tmp_path / "store"), str(tmp_path / "models"), "2024-01-01T00:00:00",
        "standard", trials=1, registry=[E.get_spec("tabular_ridge"), E.get_spec("mean_predictor")],
    )
    rows = results.orderBy("step").collect()
    assert [r.experiment for r in rows] == ["baseline_tabular_ridge", "tuned_tabular_ridge", "tuned_mean_predictor", "ensemble"]
    assert rows[0].value > 0.9 and rows[2].value == 0 and rows[3].value > 0.9
    assert preds.count() == 9
    board = L.leaderboard(S.load_submissions(spark, str(tmp_path / "store"), "toy_tab", "0")).collect()
    assert [(r.user, r["rank"]) for r in board] == [("me", 1)] and board[0].score > 0.8
    # the ensemble refits and saves both members, and predicts their mean
    best = {"config": rows[-1].config, "pipeline": None}
    assert len(json.loads(best["config"])["members"]) == 2
    again = X.refit(best, df, roles, "regression", str(tmp_path / "ens"))(df)
    loaded = [CV.load_model(str(tmp_path / f"ens/member-{i}"), "row_id") for i in range(2)]
    ridge = E.get_spec("tabular_ridge")
    mean = np.mean([[r.prediction for r in ridge.predict(f, df).orderBy("row_id").collect()] for f in loaded], axis=0)
    assert np.allclose([r.p for r in again.orderBy("row_id").collect()], mean)


def test_an_incomplete_submission_is_refused(spark):
    df = _seq_frame(spark, 20)
    data = X.Dataset("x", None, X.default_evaluate("regression"), E.Roles("row_id", "labels"), "dataframe_sequence", "regression")
    preds = df.select("row_id", F.col("labels").alias("p"))
    assert X.evaluate_submission(data, preds, df)["spearman"] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="missing"):
        X.evaluate_submission(data, preds.limit(5), df)


def test_ridge_wider_than_four_thousand_columns(spark):
    rng = np.random.default_rng(6)
    seqs = ["".join(rng.choice(list("ACGT"), size=60)) for _ in range(100)]
    y = np.array([s.count("G") + rng.normal() for s in seqs])
    df = spark.createDataFrame([(i, s, float(v)) for i, (s, v) in enumerate(zip(seqs, y))], "row_id long, sequence string, labels double")
    roles = E.Roles("row_id", "labels", seq_col="sequence")
    spec = E.get_spec("kmer_ridge")
    fitted = spec.fit(df, {"ngram_lo": 3, "ngram_hi": 8, "use_engineered": False}, roles)
    got = {r["row_id"]: r["prediction"] for r in spec.predict(fitted, df).collect()}
    counts = [Counter(_char_ngrams(s, 3, 8)) for s in seqs]
    vocab = sorted(set().union(*counts))
    assert len(vocab) > 4096
    X_ = np.array([[c[k] for k in vocab] for c in counts], dtype=float)
    sd = X_.std(axis=0)
    Z = X_ / np.where(sd > 0, sd, 1.0)
    Zc, yc = Z - Z.mean(0), y - y.mean()
    exp = Zc @ (Zc.T @ np.linalg.solve(Zc @ Zc.T + np.eye(len(y)), yc)) + y.mean()
    assert np.allclose([got[i] for i in range(len(seqs))], exp, atol=1e-6)


def test_extracting_once_changes_nothing(spark):
    df, roles, spec = _seq_frame(spark, 40), E.Roles("row_id", "labels", seq_col="sequence"), E.get_spec("kmer_ridge")
    ready_df, ready = spec.prepare(df, None, roles)
    a = sorted(spec.predict(spec.fit(df, None, roles), df).collect())
    b = sorted(ready.predict(ready.fit(ready_df, None, roles), ready_df).collect())
    assert np.allclose([r.prediction for r in a], [r.prediction for r in b], atol=1e-9)


def _blobs(spark, n=150, seed=3):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(seed)
    centers = np.array([[3.0, 0, 0, 0], [0, 3.0, 0, 0], [0, 0, 3.0, 0]])
    y = rng.integers(0, 3, size=n)
    X_ = centers[y] + rng.normal(size=(n, 4))
    rows = [(i, Vectors.dense(X_[i]), *map(float, X_[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, ["cell_id", "features", "a", "b", "c", "d", "label"])


@pytest.mark.parametrize("name,config", [
    ("expr_mlp", {"n_components": 3, "hidden1": 8, "hidden2": 6, "max_iter": 80}),
    ("tabular_hgbc", {"max_iter": 8}),
    ("tabular_rf", {"n_estimators": 20, "max_depth": 6}),
])
def test_classifiers_beat_the_majority(spark, name, config):
    df = _blobs(spark)
    vector = name.startswith("expr")
    roles = E.Roles("cell_id", "label", feature_cols=[] if vector else ["a", "b", "c", "d"], vector_col="features" if vector else None)
    spec = E.get_spec(name)
    pred = spec.predict(spec.fit(df.where("cell_id < 100"), config, roles), df.where("cell_id >= 100")).join(df, "cell_id")
    assert pred.select(F.avg((F.col("prediction") == F.col("label").cast("string")).cast("double"))).first()[0] > 0.75


def test_boosted_regressions_learn(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(-2, 2, size=(300, 2))
    y = np.sin(x[:, 0]) * 3 + (x[:, 1] > 0)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(300)], "row_id long, a double, b double, target double")
    roles, spec = E.Roles("row_id", "target", feature_cols=["a", "b"]), E.get_spec("tabular_hgbr")
    pred = spec.predict(spec.fit(df.where("row_id < 220"), {"max_iter": 25}, roles), df.where("row_id >= 220")).join(df, "row_id")
    err = pred.select(F.avg((F.col("prediction") - F.col("target")) ** 2)).first()[0]
    assert err < 0.35 * np.var(y)
    seq = _seq_frame(spark, 160, 5)
    roles, spec = E.Roles("row_id", "labels", seq_col="sequence"), E.get_spec("kmer_hgbr")
    cfg = {"ngram_lo": 1, "ngram_hi": 2, "max_iter": 15, "max_depth": 4}
    pred = spec.predict(spec.fit(seq.where("row_id < 120"), cfg, roles), seq.where("row_id >= 120")).join(seq, "row_id")
    assert pred.corr("prediction", "labels") > 0.6


def test_settings_without_effect_warn():
    with pytest.warns(UserWarning, match="alpha"):
        E.get_spec("expr_mlp").config({"alpha": 0.1})


def test_a_wide_matrix_is_laid_out_in_seconds(spark):
    import time

    from scorewell.sources.expression import assemble_cells

    genes = spark.range(19_264).selectExpr("concat('g', id) as gene", "cast(id as int) as gidx")
    coo = spark.range(40).withColumnRenamed("id", "cell_id").crossJoin(genes.select("gene", "gidx")).selectExpr(
        "cell_id", "gene", "cast((cell_id * 7 + gidx) % 5 as double) as value"
    )
    began = time.time()
    rows = assemble_cells(coo, genes, 19_264).collect()
    assert time.time() - began < 40 and len(rows) == 40
    for r in rows[:3]:
        assert np.allclose(r.features.toArray(), (r.cell_id * 7 + np.arange(19_264)) % 5)


def test_expression_model_roundtrip_and_batch_predict(spark, tmp_path):
    from scorewell.sources.expression import read_expression

    rng = np.random.default_rng(9)
    rows, obs = [], []
    for cell in range(40):
        lab = cell % 2
        obs.append((cell, lab))
        for g in range(6):
            base = 20.0 if (g < 3) == (lab == 0) else 2.0
            rows.append((cell, f"g{g}", float(base + rng.integers(0, 3))))
    coo = spark.createDataFrame(rows, "cell_id long, gene string, value double")
    obs_df = spark.createDataFrame(obs, "cell_id long, label int")
    cells, genes = read_expression(spark, coo, obs_df)
    spec = E.get_spec("expr_logreg")
    fitted = spec.fit(cells, {"n_components": 3}, E.Roles("cell_id", "label", vector_col="features"))
    CV.save_expression_model(fitted, genes, str(tmp_path / "expr"))
    again, genes2 = CV.load_expression_model(spark, str(tmp_path / "expr"))
    # new cells arrive with an extra unknown gene and without their labels
    new = coo.where("cell_id < 10").unionByName(spark.createDataFrame([(0, "zz", 5.0)], "cell_id long, gene string, value double"))
    out = CV.batch_predict_expression(spark, again, genes2, new, obs_df.where("cell_id < 10").select("cell_id"))
    got = {r["cell_id"]: r["predictions"] for r in out.collect()}
    assert len(got) == 10
    assert sum(got[c] == str(c % 2) for c in got) >= 9


def test_equal_trials_are_fitted_once_and_all_scored(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 7), i % 3) for i in range(60)], "id long, y double, fold_id int")
    roles = E.Roles("id", "y")
    asked, made = [], CV.trial_predictions
    monkeypatch.setattr(CV, "trial_predictions", lambda s, p, r, configs: asked.append(len(configs)) or made(s, p, r, configs))
    rows = CV.trial_scores(E.get_spec("mean_predictor"), CV.make_splits(df, roles, "regression"), roles, "regression", 6).collect()
    assert asked == [1]
    assert sorted((r.trial, r.score) for r in rows) == [(t, 0.0) for t in range(6)]


def test_perceptron_parts_are_no_more_than_cores(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(E._Classifier, "fit_model", lambda self, slim, c, labels, roles: seen.append(slim.rdd.getNumPartitions()))
    cores = spark.sparkContext.defaultParallelism
    E.get_spec("expr_mlp").fit_model(spark.range(1000).repartition(3 * cores), {}, [], None)
    E.get_spec("expr_mlp").fit_model(spark.range(10).repartition(1), {}, [], None)
    assert seen == [cores, 1]


def test_the_standard_run_offers_every_pipeline(spark, monkeypatch):
    """No pipeline that learns numbers from a table is left out, and none gets fewer trials than the tier has."""
    from scorewell.plans import q_models as Q

    seen = {}

    def planned(spark, name, fold, user, store, models, timestamp, budget, seed=42, trials=None, registry=None):
        seen.update(budget=budget, trials=trials, steps=X.plan_steps(spark, "dataframe_tabular", "regression", budget, registry).collect())
        raise StopIteration

    monkeypatch.setattr(Q.X, "run_experiments", planned)
    with pytest.raises(StopIteration):
        Q.experiment_run_standard(spark, "/root/testdata/sf0.001")
    assert seen["budget"] == "standard" and seen["trials"] is None
    assert [(r.experiment, r.trials) for r in seen["steps"]] == [
        ("baseline_tabular_ridge", 0), ("tuned_tabular_ridge", 30), ("tuned_tabular_hgbr", 30), ("tuned_mean_predictor", 30), ("ensemble", 0),
    ]
