"""K1-K3 extension hooks."""

import pytest
from pyspark.sql import functions as F

from scorewell.functions.row_features import FEATURES, register_feature
from scorewell.functions.sequence import gc_content
from scorewell.plans import estimators as E
from scorewell.plans import experiment as X
from scorewell.plans import planning as PL


def test_lifted_row_function_equals_native(spark):
    register_feature("gc_py", lambda s: (s.upper().count("G") + s.upper().count("C")) / max(len(s), 1))
    df = spark.createDataFrame([("ACGT",), ("",), ("ggcc",), ("AUGN",)], "s string")
    rows = df.select(gc_content("s").alias("a"), FEATURES["gc_py"](F.col("s")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_register_pipeline_and_dataset(spark):
    class Constant(E.MeanPredictor):
        name = "constant_test"
        data_types = ("custom",)
        task_types = ("regression",)

    E.register_pipeline(Constant())
    try:
        assert [r.pipeline for r in PL.candidates(spark, "custom", "regression").collect()] == ["constant_test"]
    finally:
        E.REGISTRY.pop()
    frames = (spark.range(3), spark.range(2))
    X.register_dataset(X.Dataset("my-set", lambda spark, fold: frames, X.default_evaluate("regression"), E.Roles("id", "y"), "custom", "regression"))
    assert X.dataset_named("my-set").load(spark, "0") == frames and X.dataset_named("my_set").primary == "spearman"
    with pytest.raises(KeyError, match="other"):
        X.dataset_named("other")
