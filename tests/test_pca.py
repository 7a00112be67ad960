"""C11: distributed principal components against numpy's exact SVD, for narrow and wide inputs."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from scorewell.operators.pca import principal_components
from scorewell.plans.estimators import pca_model, pca_stage


@pytest.mark.parametrize("n,d,k", [(300, 40, 5), (60, 400, 50), (120, 5000, 10), (40, 25, 50)])
def test_components_match_svd(spark, n, d, k):
    rng = np.random.default_rng(n + d)
    X = rng.normal(size=(n, d)) * (1 + 3 / (1 + np.arange(d))) + 3.0
    df = spark.createDataFrame([(i, Vectors.dense(X[i])) for i in range(n)], ["id", "x"]).repartition(4)
    comps, var, mean = principal_components(df, "x", k)
    k = min(k, n, d)
    _, s, vt = np.linalg.svd(X - X.mean(0), full_matrices=False)
    assert comps.shape == (d, k) and np.allclose(mean, X.mean(0))
    assert np.allclose(var, s[:k] ** 2 / (n - 1), rtol=1e-8, atol=1e-10)
    assert np.allclose(comps.T @ comps, np.eye(k), atol=1e-10)
    few = min(5, k)
    assert np.allclose(np.abs(comps[:, :few].T @ vt[:few].T), np.eye(few), atol=1e-5)


def test_few_rows_of_low_rank(spark):
    X = np.outer(np.arange(6.0), [1, 2, 0, 0])
    df = spark.createDataFrame([(Vectors.dense(r),) for r in X], ["x"])
    comps, var, _ = principal_components(df, "x", 3)
    assert np.allclose(var, [5 * 3.5, 0, 0], atol=1e-9) and np.allclose(np.abs(comps[:2, 0]), np.array([1, 2]) / 5**0.5)


def test_components_as_jvm_model(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rng = np.random.default_rng(5)
    X = rng.normal(size=(50, 12))
    df = spark.createDataFrame([(Vectors.dense(r),) for r in X], ["x"])
    comps, var, _ = principal_components(df, "x", 4)
    model = PipelineModel([pca_model(spark, "x", "p", comps, var)])
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    got = np.array([r["p"].toArray() for r in again.transform(df).collect()])
    assert np.allclose(got, X @ comps, atol=1e-12)
    assert pca_stage(df, "x", "p", 99).pc.numCols == 12
