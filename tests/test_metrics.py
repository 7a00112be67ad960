"""F1-F11, M1 against the hand-computed fixtures (FIXTURES.md §3)."""

import math

import pytest

from scorewell.operators import metrics as M


def _reg(spark, p, y, groups=None):
    rows = [(i, float(a), float(b), (groups[i] if groups else 0)) for i, (a, b) in enumerate(zip(p, y))]
    return spark.createDataFrame(rows, "id long, p double, y double, g int")


def test_regression_fixture(spark):
    df = _reg(spark, [1, 2, 2, 4], [1, 3, 2, 4])
    r = M.regression_metrics(df).first()
    assert r["n"] == 4
    assert r["mse"] == pytest.approx(0.25)
    assert r["mae"] == pytest.approx(0.25)
    assert r["rmse"] == pytest.approx(0.5)
    assert r["r2"] == pytest.approx(0.8)
    assert r["pearson"] == pytest.approx(0.923381, abs=1e-6)
    assert r["spearman"] == pytest.approx(0.948683, abs=1e-6)


def test_spearman_constant_is_zero(spark):
    df = _reg(spark, [2, 2, 2, 2], [1, 3, 2, 4])
    r = M.regression_metrics(df).first()
    assert r["spearman"] == 0.0
    assert math.isnan(r["pearson"])


def test_regression_grouped_matches_ungrouped(spark):
    p = [1, 2, 2, 4, 5, 1, 0, 3]
    y = [1, 3, 2, 4, 1, 1, 2, 2]
    g = [0, 0, 0, 0, 1, 1, 1, 1]
    grouped = {r["g"]: r for r in M.regression_metrics(_reg(spark, p, y, g), group_cols=["g"]).collect()}
    alone = M.regression_metrics(_reg(spark, p[:4], y[:4])).first()
    assert grouped[0]["spearman"] == pytest.approx(alone["spearman"])


def _cls(spark, y, p):
    return spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(zip(y, p))], "id long, y string, p string")


def test_classification_fixture(spark):
    r = M.classification_metrics(_cls(spark, [0, 0, 1, 1, 2], [0, 1, 1, 1, 3])).first()
    assert r["f1_macro"] == pytest.approx(0.366667, abs=1e-6)
    assert r["f1_weighted"] == pytest.approx(0.586667, abs=1e-6)
    assert r["accuracy"] == pytest.approx(0.6)
    assert r["precision_macro"] == pytest.approx(0.416667, abs=1e-6)
    assert r["recall_macro"] == pytest.approx(0.375)


def test_per_class_includes_predicted_only_class(spark):
    per = M.per_class_prf(M.confusion_counts(_cls(spark, [0, 0, 1, 1, 2], [0, 1, 1, 1, 3])))
    classes = {r["cls"]: r for r in per.collect()}
    assert set(classes) == {"0", "1", "2", "3"}
    assert classes["3"]["support"] == 0 and classes["3"]["f1"] == 0.0


def test_cv_scores_nan_counts_as_zero(spark):
    df = spark.createDataFrame([(0, 0.5), (1, float("nan")), (2, 0.7)], "split int, s double")
    r = M.cv_scores(df, "s").first()
    assert r["cv_score"] == pytest.approx(0.4)


def test_validate_predictions_fixture(spark):
    t = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    p = spark.createDataFrame([(1, 1.0), (3, 1.0), (3, 2.0), (4, 1.0)], "id long, p double")
    r = M.validate_predictions(t, p).first()
    assert (r["missing"], r["extra"], r["duplicate"], r["valid"]) == (1, 1, 1, False)
    bad = {(x["id"], x["problem"]) for x in M.offending_ids(t, p).collect()}
    assert bad == {(2, "missing"), (4, "extra"), (3, "duplicate")}


def test_incomplete_submissions_have_no_metrics(spark):
    from scorewell.operators import metrics as M

    t = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, y double")
    three = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 2.0), (3, None)], "id int, p double")
    r = M.evaluate_regression(t, three).first()
    assert not r.valid and r.n == 10 and r.missing == 6 and r.null_predictions == 1 and r.spearman is None
    whole = t.withColumnRenamed("y", "p")
    r = M.evaluate_regression(t, whole).first()
    assert r.valid and r.spearman == 1.0 and r.r2 == 1.0
    r = M.evaluate_regression(t, whole.union(whole.where("id = 4"))).first()
    assert not r.valid and r.duplicate == 1 and r.mse is None
    r = M.evaluate_regression(t, whole.union(spark.createDataFrame([(99, 1.0)], "id int, p double"))).first()
    assert not r.valid and r.extra == 1
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, y string")
    p = c.withColumnRenamed("y", "p")
    assert M.evaluate_classification(c, p).first().f1_macro == 1.0
    assert M.evaluate_classification(c, p.where("id < 3")).first().f1_macro is None
    nothing = M.evaluate_regression(t.where("false"), whole.where("false")).first()
    assert not nothing.valid and nothing.n == 0


def test_rows_without_a_fold_are_training_rows(spark):
    from scorewell.sources.tables import fold_split

    df = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id int, fold_id int")
    train, test = fold_split(df, 0)
    assert sorted(r.id for r in train.collect()) == [2, 3] and [r.id for r in test.collect()] == [1]


def test_trial_spearman_is_the_metric_of_each_trial_and_split(spark):
    import random

    rng = random.Random(5)
    label = {i: rng.choice([0.0, 1.5, 1.5, rng.random(), -2.0]) for i in range(300)}
    rows = []
    for trial in (0, 1, 2, 4):
        for i, y in label.items():
            p = {0: rng.random(), 1: 7.0, 2: rng.choice([0.0, -0.0, float("nan"), y]), 4: None if i == 4 else -y}[trial]
            rows.append((trial, i % 3, y, p))
    preds = spark.createDataFrame(rows, "trial int, split int, y double, p double").repartition(5)
    got = {(r.trial, r.split): r.score for r in M.trial_spearman(preds, 3).collect()}
    every = M.regression_metrics(preds, "p", "y", ["trial", "split"]).collect()
    assert got == {(r.trial, r.split): r.spearman for r in every}  # to the last bit
    assert len(got) == 12 and got[4, 1] is None and got[1, 0] == 0.0


def test_rank_sums_over_many_parts(spark):
    """One value in most rows, and pieces of one group in several tasks."""
    from collections import Counter

    from scorewell.operators.rank import rank_sums

    values = [(g, float(v % 40 if v % 3 else 7)) for g in (1, 2) for v in range(500 * g)]
    counts = Counter(values)
    df = spark.createDataFrame([(g, v, n, n * int(v)) for (g, v), n in counts.items()], "g int, v double, n long, o long")
    got = {r.g: (r.n, r.valued, int(r.xx), int(r.xy)) for r in rank_sums(df, "g", "v", "n", "o").collect()}
    for g in (1, 2):
        run, xx, xy = 0, 0, 0
        for v in sorted(v for h, v in counts if h == g):
            n = counts[g, v]
            rank2 = 2 * run + n + 1
            run, xx, xy = run + n, xx + n * rank2**2, xy + rank2 * n * int(v)
        assert got[g] == (run, run, xx, xy)
