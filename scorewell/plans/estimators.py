"""E1-E12 (+C6-C8, C11 stages, C13/C14 wiring, K2 registry).

Each pipeline spec turns a training DataFrame and a config into a fitted
``PipelineModel``, so fitting and prediction run in executors and every model
saves and loads with ``PipelineModel.write``.  All stages are JVM stages but E5's
calibrated margins (Column arithmetic with its weights as a saved parameter).

Objective mapping to the reference's models (see SURVEY §2 E):
* ridge / elastic net: solved from moments or on column blocks
  (``scorewell.plans.linear_models``).  Beyond the sizes of both, by L-BFGS / OWL-QN
  passes to a relative change of 1e-9: Spark's penalty depends on the label's std, so
  the label is divided by its sample std s and predictions multiplied back; ridge
  regParam = alpha / n, elastic net a1 = alpha*l1/s, a2 = alpha*(1-l1),
  regParam = a1 + a2, elasticNetParam = a1 / (a1 + a2).
* logistic: regParam = 1 / (C * sum of weights) with 'balanced' weights.
* SVM: squared hinge and sigmoids by Newton steps (``scorewell.operators.margins``).
* boosting: histograms with an L2 leaf penalty (``scorewell.operators.boosting``).
Documented gap (no Spark equivalent): the MLP uses sigmoid units without L2, step size
or early stopping.  Settings that so have
no effect are not in the search spaces; a config that names one gets a warning.
"""

from __future__ import annotations

import copy
import json
import math
import uuid
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.common import _py2java
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
    IndexToString,
    PCAModel,
    SQLTransformer,
    StandardScalerModel,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.param import Param as MLParam
from pyspark.ml.param import Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.functions.sequence import sequence_sql
from scorewell.operators import boosting, forest
from scorewell.operators.boosting import Settings
from scorewell.operators.features import class_weights
from scorewell.operators.linear import GRAM_COLUMNS, Linear, elastic_net, ridge
from scorewell.operators.margins import Problem, sigmoids, squared_hinge
from scorewell.operators.pca import principal_components
from scorewell.operators.wide import System, TooLarge
from scorewell.plans import linear_models as LM
from scorewell.session import materialize

FEATURES = "_features"  # internal model input column (inputs may carry "features")
PREDICTION = "prediction"
#: Most training k-mers a linear model may have as columns.  The vocabulary and the
#: coefficients live on the driver and in every task, so more raises an error.
MAX_VOCAB = 1 << 23


# --------------------------------------------------------------------------
# featurization stages
# --------------------------------------------------------------------------

def kmer_stages(seq_col: str, lo: int, hi: int, engineered: bool) -> list:
    """C3 (per-row k-mer array), C4/C5 (CountVectorizer), C1/C2, C6 (assembler)."""
    sql = sequence_sql(seq_col, lo, hi)
    chars = SQLTransformer(statement=f"SELECT *, {sql['chars']} AS _chars FROM __THIS__")
    kmers = SQLTransformer(
        statement=f"SELECT *, {sql['kmers']} AS _kmers, {sql['gc']} AS _gc, {sql['length']} AS _len FROM __THIS__"
    )
    cv = _Vocabulary(inputCol="_kmers", outputCol="_kvec", minDF=1.0, vocabSize=MAX_VOCAB)
    cols = ["_kvec", "_gc", "_len"] if engineered else ["_kvec"]
    assemble = VectorAssembler(inputCols=cols, outputCol="_raw", handleInvalid="keep")
    return [chars, kmers, cv, assemble]


class _Vocabulary(CountVectorizer):
    """CountVectorizer that never drops a term: a vocabulary at the limit is an error."""

    def fit(self, dataset, params=None):
        model = super().fit(dataset, params)
        if len(model.vocabulary) >= self.getVocabSize():
            raise ValueError(f"more than {self.getVocabSize()} different k-mers; take a shorter k range")
        return model


def fit_stages(stages: list, df: DataFrame) -> tuple[list, DataFrame]:
    """Fit stages in order on ``df``; return fitted transformers and the transformed frame."""
    fitted = []
    cur = df
    for st in stages:
        model = st.fit(cur) if isinstance(st, Estimator) else st
        cur = model.transform(cur)
        fitted.append(model)
    return fitted, cur


def _jvm(spark, name: str, *args):
    cls = spark._jvm
    for part in f"org.apache.spark.ml.feature.{name}".split("."):
        cls = getattr(cls, part)
    uid = f"{name}_{uuid.uuid4().hex[:12]}"
    return cls(uid, *[_py2java(spark.sparkContext, a) for a in args])


def population_scale(df: DataFrame, in_col: str, out_col: str, center: bool) -> list:
    """C7 (center=False) / C8 (center=True): divide by the *population* std.

    Mean and variance come from one pass.  C7: ElementwiseProduct with 1/std,
    zero-variance columns scale 1 (sparsity kept).  C8: a scaler model with that
    mean and std; a column without variance becomes 0, as (x - mean) / 1 is.
    Returns fitted transformers.
    """
    stats = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(in_col)).alias("s")).first()["s"]
    var, n = stats["variance"].toArray(), int(stats["count"])
    std = [math.sqrt(v * (n - 1) / n) if n > 0 else 0.0 for v in var]
    if center:
        model = StandardScalerModel(
            _jvm(df.sparkSession, "StandardScalerModel", Vectors.dense(std), Vectors.dense(stats["mean"].toArray()))
        )
        return [model._set(inputCol=in_col, outputCol=out_col, withMean=True, withStd=True)]
    scale = [1.0 / s if s > 0 else 1.0 for s in std]
    return [ElementwiseProduct(inputCol=in_col, outputCol=out_col, scalingVec=Vectors.dense(scale))]


def pca_model(spark, in_col: str, out_col: str, components, explained_variance) -> PCAModel:
    """A JVM ``PCAModel`` (transforms, saves, loads) with these components (d x k)."""
    d, k = components.shape
    pc = DenseMatrix(d, k, components.flatten(order="F").tolist())
    model = PCAModel(_jvm(spark, "PCAModel", pc, Vectors.dense(explained_variance)))
    return model._set(inputCol=in_col, outputCol=out_col, k=k)


def pca_stage(df: DataFrame, in_col: str, out_col: str, k: int) -> PCAModel:
    """C11: projection on the first k principal components, k at most the rows and columns.

    The same method for every width (``scorewell.operators.pca``).
    """
    comps, var, _ = principal_components(df, in_col, k)
    return pca_model(df.sparkSession, in_col, out_col, comps, var)


# --------------------------------------------------------------------------
# pipeline specs
# --------------------------------------------------------------------------


@dataclass
class Param:
    """One search-space entry."""

    name: str
    kind: str  # int | float | log | choice | fixed
    low: float | None = None
    high: float | None = None
    choices: list = field(default_factory=list)


@dataclass
class Fitted:
    model: PipelineModel
    id_col: str
    spec: str


class Spec:
    name = ""
    data_types: tuple = ()
    task_types: tuple = ()
    defaults: dict = {}
    space: list = []

    ignored: tuple = ()  # settings of the reference that have no effect here

    def config(self, overrides: dict | None = None) -> dict:
        unused = [k for k in overrides or {} if k in self.ignored]
        if unused:
            warnings.warn(f"{self.name}: {', '.join(unused)} has no effect in Spark's learner", stacklevel=2)
        return {**self.defaults, **(overrides or {})}

    def fit(self, train: DataFrame, config: dict | None, roles: "Roles") -> Fitted:
        raise NotImplementedError

    def prepare(self, df: DataFrame, config: dict | None, roles: "Roles") -> tuple[DataFrame, "Spec"]:
        """(``df`` with what a row gives whatever is learned, a pipeline that starts from there)."""
        return df, self

    def cv_predictions(self, df: DataFrame, roles: "Roles", fold, folds: int, configs: list) -> DataFrame | None:
        """(split, id, y, trial, p) of all configs at once, where the pipeline has a way; else None.

        ``fold`` is a column: the split a row validates, or null.
        """
        return None

    def predict(self, fitted: Fitted, df: DataFrame) -> DataFrame:
        out = fitted.model.transform(df)
        return out.select(fitted.id_col, F.col(PREDICTION).alias(PREDICTION))


@dataclass
class Roles:
    """Column roles of a frame (from B1-B4)."""

    id_col: str
    label_col: str
    seq_col: str | None = None
    feature_cols: list = field(default_factory=list)
    vector_col: str | None = None


def _feature_stages(roles: Roles) -> list:
    if roles.vector_col:
        return [SQLTransformer(statement=f"SELECT *, {roles.vector_col} AS _raw FROM __THIS__")]
    return [VectorAssembler(inputCols=roles.feature_cols, outputCol="_raw", handleInvalid="keep")]


def vector_size(df: DataFrame, col: str) -> int:
    """Width of a vector column from its ML attribute metadata (no job), else one row."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    return len(df.select(col).first()[0])


def _iterated_linear(train: DataFrame, pre: list, roles: Roles, penalty, center: bool) -> PipelineModel:
    """Featurizer, population scaler and a LinearRegression on y / std(y), by passes over the rows.

    For data too large for products of columns or rows.  ``penalty(n, s)`` gives
    (regParam, elasticNetParam).
    """
    y = F.col(roles.label_col).cast("double")
    fitted, cur = fit_stages(pre, train)
    slim = materialize(cur.select(y.alias("_label"), "_raw"), "linear-rows")
    r = slim.agg(F.stddev_samp("_label").alias("s"), F.count(F.lit(1)).alias("n")).first()
    s = float(r["s"]) if r["s"] and r["s"] > 0 else 1.0
    scale = population_scale(slim, "_raw", FEATURES, center)
    fitted += scale
    for t in scale:
        slim = t.transform(slim)
    reg, l1 = penalty(int(r["n"]), s)
    lr = LinearRegression(
        featuresCol=FEATURES, labelCol="_y", predictionCol="_pred", solver="l-bfgs",
        regParam=reg, elasticNetParam=l1, standardization=False, maxIter=LINEAR_ITERATIONS, tol=1e-9,
    ).fit(slim.withColumn("_y", F.col("_label") / F.lit(s)))
    back = SQLTransformer(statement=f"SELECT *, _pred * {s!r} AS {PREDICTION} FROM __THIS__")
    return PipelineModel(fitted + [lr, back])


def _linear_stages(spark, model: Linear, center: bool) -> list:
    """A scaler and a linear model as JVM stages, from solved numbers."""
    if center:
        scaler = StandardScalerModel(_jvm(spark, "StandardScalerModel", Vectors.dense(model.std), Vectors.dense(model.mean)))
        scaler = scaler._set(inputCol="_raw", outputCol=FEATURES, withMean=True, withStd=True)
        intercept = model.y_mean
    else:
        scaler = ElementwiseProduct(inputCol="_raw", outputCol=FEATURES, scalingVec=Vectors.dense(1.0 / model.std))
        intercept = model.intercept
    uid = f"LinearRegressionModel_{uuid.uuid4().hex[:12]}"
    java = spark._jvm.org.apache.spark.ml.regression.LinearRegressionModel(
        uid, _py2java(spark.sparkContext, Vectors.dense(model.weights)), float(intercept)
    )
    return [scaler, LinearRegressionModel(java)._set(featuresCol=FEATURES, predictionCol=PREDICTION)]


# Fixed value: iterations the reference allows its linear solvers.
LINEAR_ITERATIONS = 5000

# Execution knobs for tree learners (results unchanged): more node statistics per
# pass means fewer passes over the data.
TREE_EXEC = {"maxMemoryInMB": 1024}
# Bins and smallest leaf of the reference's boosting library.
BOOSTING = {"maxBins": 255, **TREE_EXEC}
MIN_LEAF = 20
FOREST_EXEC = {**TREE_EXEC, "cacheNodeIds": True}  # deep trees: node ids cached between levels
# Up to so many rows times trees, or bytes of a level's sums, a forest is fitted by Spark's
# learner, which holds the trees on the driver and a GB of sums in every task.
FOREST_ROWS, FOREST_SUMS = 1 << 23, 1 << 28


def _fit_slim(est, cur: DataFrame, label_col: str):
    """Fit on a written (features, label) slice, so fits that run side by side share no cache."""
    return est.fit(materialize(cur.select("_raw", F.col(label_col).cast("double").alias("_label")), "training-rows"))


def _boosting_settings(c: dict) -> Settings:
    return Settings(
        steps=int(c["max_iter"]), rate=float(c["learning_rate"]), depth=int(c["max_depth"]) if c["max_depth"] else None,
        min_leaf=int(c.get("min_samples_leaf", MIN_LEAF)), l2=float(c.get("l2_regularization", 0.0)),
    )


def _boosted_regression(cur: DataFrame, c: dict, roles: "Roles"):
    """Trees on ``_raw``: by histograms, or Spark's learner (without an L2 leaf penalty) beyond their width."""
    width = vector_size(cur, "_raw")
    if not boosting.fits(width, 1):
        gbt = GBTRegressor(
            featuresCol="_raw", labelCol="_label", predictionCol=PREDICTION, seed=42,
            maxIter=int(c["max_iter"]), stepSize=float(c["learning_rate"]), maxDepth=int(c["max_depth"]),
            minInstancesPerNode=int(c.get("min_samples_leaf", MIN_LEAF)), **BOOSTING,
        )
        return _fit_slim(gbt, cur, roles.label_col)
    rows = boosting.training_rows(cur, "_raw", F.col(roles.label_col), F.lit(1.0), roles.id_col)
    trees = boosting.fit(rows, width, "squared", 1, _boosting_settings(c))
    return boosting.BoostedTrees(trees, "squared", "_raw", PREDICTION)


def _one_vs_rest(clf, n_classes: int) -> OneVsRest:
    """Multiclass from a binary learner; the per-class fits run concurrently."""
    return OneVsRest(
        classifier=clf, featuresCol=FEATURES, labelCol="_label_idx", weightCol="_w",
        predictionCol="_pred_idx", parallelism=max(1, min(n_classes, 8)),
    )


class _Kmers(Spec):
    """Pipelines on a text's k-mers; ``prepared`` ones find them extracted already."""

    data_types = ("dataframe_sequence",)
    task_types = ("regression",)
    prepared = False

    def stages(self, c: dict, roles: Roles) -> list:
        every = kmer_stages(roles.seq_col, int(c["ngram_lo"]), int(c["ngram_hi"]), bool(c.get("use_engineered", True)))
        return every[2:] if self.prepared else every

    def prepare(self, df, config, roles):
        c = self.config(config)
        for stage in kmer_stages(roles.seq_col, int(c["ngram_lo"]), int(c["ngram_hi"]), True)[:2]:
            df = stage.transform(df)
        ready = copy.copy(self)
        ready.prepared = True
        return df.drop("_chars"), ready


class _KmerLinear(_Kmers):
    """Linear models on k-mers: moments up to GRAM_COLUMNS features, column blocks beyond."""

    def prepare(self, df, config, roles):
        return df, self

    def solve(self, m, configs: list[dict]) -> list[Linear]:
        """The models of these configs from moments."""
        raise NotImplementedError

    def wide(self, columns, configs: list[dict], splits: int) -> list[tuple[int, int, "np.ndarray"]]:
        """(config, split, all rows' predictions) of these configs for each split."""
        raise NotImplementedError

    def wide_table(self, columns, config: dict) -> tuple[DataFrame, float]:
        raise NotImplementedError

    def penalty(self, c: dict):
        raise NotImplementedError

    def keep(self, names: list[str], c: dict) -> "np.ndarray":
        """The columns of a design that a config uses."""
        lo, hi = int(c["ngram_lo"]), int(c["ngram_hi"])
        own = bool(c.get("use_engineered", True))
        return np.array([i for i, n in enumerate(names) if (own if n in (LM.GC, LM.LENGTH) else lo <= len(n) <= hi)], int)

    def fit(self, train, config, roles):
        c = self.config(config)
        lo, hi, own = int(c["ngram_lo"]), int(c["ngram_hi"]), bool(c.get("use_engineered", True))
        vocabulary = LM.small_vocabulary(train, roles.seq_col, lo, hi)
        if vocabulary is not None:
            design = LM.kmer_design(roles.seq_col, vocabulary, lo, hi)
            (m,) = LM.all_moments(train, design, roles.label_col, F.lit(None), 0)
            (model,) = self.solve(m.columns(self.keep(design.names, c)), [c])
            stages = kmer_stages(roles.seq_col, lo, hi, own)
            if vocabulary:
                stages[2] = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_kmers", outputCol="_kvec", minTF=1.0)
            else:  # no k-mer at all
                stages[2] = SQLTransformer(statement="SELECT * FROM __THIS__")
                stages[3].setInputCols(stages[3].getInputCols()[1:])
            return Fitted(PipelineModel(stages + _linear_stages(train.sparkSession, model, False)), roles.id_col, self.name)
        try:
            columns = LM.wide_columns(train, roles.seq_col, roles.label_col, F.lit(None), 0, lo, hi, own)
            table, y_mean = self.wide_table(columns, c)
            return Fitted(PipelineModel([LM.weights_model(table, y_mean, roles.seq_col, lo, hi)]), roles.id_col, self.name)
        except TooLarge:
            return Fitted(_iterated_linear(train, self.stages(c, roles), roles, self.penalty(c), center=False), roles.id_col, self.name)

    def cv_predictions(self, df, roles, fold, folds, configs):
        every = [self.config(c) for c in configs]
        lo, hi = min(int(c["ngram_lo"]) for c in every), max(int(c["ngram_hi"]) for c in every)
        vocabulary = LM.small_vocabulary(df, roles.seq_col, lo, hi)
        if vocabulary is not None:
            design = LM.kmer_design(roles.seq_col, vocabulary, lo, hi)
            keeps = [self.keep(design.names, c) for c in every]

            def solve(m):
                out = [None] * len(every)
                for same in _alike(every, ("ngram_lo", "ngram_hi", "use_engineered")):
                    keep = keeps[same[0]]
                    for k, model in zip(same, self.solve(m.columns(keep), [every[k] for k in same])):
                        out[k] = LM.on_all_columns(model, keep, len(design.names))
                return out

            return LM.narrow_cv(df, design, roles.id_col, roles.label_col, fold, folds, solve)
        parts = []
        try:
            for same in _alike(every, ("ngram_lo", "ngram_hi", "use_engineered")):
                c = every[same[0]]
                columns = LM.wide_columns(
                    df, roles.seq_col, roles.label_col, fold, folds, int(c["ngram_lo"]), int(c["ngram_hi"]),
                    bool(c.get("use_engineered", True)), roles.id_col,
                )
                made = self.wide(columns, [every[k] for k in same], folds)
                parts.append(LM.wide_predictions(columns, [(same[t], s, p) for t, s, p in made], roles.id_col))
        except TooLarge:
            return None
        return LM.union_all(parts)


def _alike(configs: list[dict], names: tuple) -> list[list[int]]:
    """Positions of configs that agree in these settings."""
    groups: dict[tuple, list[int]] = {}
    for k, c in enumerate(configs):
        groups.setdefault(tuple(c.get(n) for n in names), []).append(k)
    return list(groups.values())


class KmerRidge(_KmerLinear):
    """K-mers (+GC, length) -> no-centre population scaling -> ridge."""

    name = "kmer_ridge"
    defaults = {"ngram_lo": 3, "ngram_hi": 6, "alpha": 1.0, "use_engineered": True}
    space = [
        Param("ngram_lo", "int", 2, 4),
        Param("ngram_hi", "int", 5, 8),
        Param("alpha", "log", 1e-3, 1e3),
        Param("use_engineered", "choice", choices=[True, False]),
    ]

    def penalty(self, c):
        return lambda n, s: (float(c["alpha"]) / n, 0.0)

    def solve(self, m, configs):
        return ridge(m, [float(c["alpha"]) for c in configs])

    def wide(self, columns, configs, splits):
        systems = [System(s, float(c["alpha"])) for c in configs for s in range(splits)]
        p = columns.predictions(columns.ridge(systems), systems)
        return [(k // splits, x.split, p[:, k]) for k, x in enumerate(systems)]

    def wide_table(self, columns, config):
        return columns.ridge_weights(columns.ridge([System(0, float(config["alpha"]))])[:, 0])


class KmerElasticNet(_KmerLinear):
    """K-mers + GC + length -> no-centre scaling -> elastic net."""

    name = "kmer_elasticnet"
    defaults = {"ngram_lo": 3, "ngram_hi": 6, "alpha": 0.1, "l1_ratio": 0.5}
    space = [
        Param("ngram_lo", "int", 2, 4),
        Param("ngram_hi", "int", 5, 8),
        Param("alpha", "log", 1e-4, 10.0),
        Param("l1_ratio", "float", 0.01, 0.99),
    ]

    def penalty(self, c):
        alpha, l1 = float(c["alpha"]), float(c["l1_ratio"])

        def of(n, s):
            a1, a2 = alpha * l1 / s, alpha * (1 - l1)
            return a1 + a2, a1 / (a1 + a2) if a1 + a2 > 0 else 0.0

        return of

    def solve(self, m, configs):
        return [elastic_net(m, float(c["alpha"]), float(c["l1_ratio"]), LINEAR_ITERATIONS) for c in configs]

    def wide(self, columns, configs, splits):
        return [
            (k, s, columns.elastic_net(float(c["alpha"]), float(c["l1_ratio"]), s)[1])
            for k, c in enumerate(configs) for s in range(splits)
        ]

    def wide_table(self, columns, config):
        kept, _, y_mean = columns.elastic_net(float(config["alpha"]), float(config["l1_ratio"]))
        return columns.spark.createDataFrame(kept, "name string, weight double, mean double"), y_mean


class KmerBoosting(_Kmers):
    """K-mers + GC + length -> histogram gradient boosting with an L2 leaf penalty."""

    name = "kmer_hgbr"
    defaults = {
        "ngram_lo": 3, "ngram_hi": 6, "max_iter": 200, "learning_rate": 0.1,
        "max_depth": 6, "min_samples_leaf": 10, "l2_regularization": 0.1, "seed": 42,
    }
    space = [
        Param("ngram_lo", "int", 2, 4),
        Param("ngram_hi", "int", 5, 8),
        Param("max_iter", "int", 100, 500),
        Param("learning_rate", "log", 0.01, 0.3),
        Param("max_depth", "int", 3, 10),
        Param("min_samples_leaf", "int", 5, 50),
    ]

    def fit(self, train, config, roles):
        c = self.config(config)
        fitted, cur = fit_stages(self.stages(c, roles), train)
        return Fitted(PipelineModel(fitted + [_boosted_regression(cur, c, roles)]), roles.id_col, self.name)


class TabularRidge(Spec):
    """Centred population scaling -> ridge."""

    name = "tabular_ridge"
    data_types = ("dataframe_tabular",)
    task_types = ("regression",)
    defaults = {"alpha": 1.0}
    space = [Param("alpha", "log", 1e-3, 1e3)]

    def design(self, df, roles):
        width = vector_size(df, roles.vector_col) if roles.vector_col else len(roles.feature_cols)
        return LM.dense_design(roles.feature_cols, roles.vector_col, width)

    def fit(self, train, config, roles):
        c = self.config(config)
        design = self.design(train, roles)
        if len(design.names) > GRAM_COLUMNS:
            penalty = lambda n, s: (float(c["alpha"]) / n, 0.0)
            return Fitted(_iterated_linear(train, _feature_stages(roles), roles, penalty, center=True), roles.id_col, self.name)
        (m,) = LM.all_moments(train, design, roles.label_col, F.lit(None), 0)
        (model,) = ridge(m, [float(c["alpha"])])
        return Fitted(PipelineModel(_feature_stages(roles) + _linear_stages(train.sparkSession, model, True)), roles.id_col, self.name)

    def cv_predictions(self, df, roles, fold, folds, configs):
        design = self.design(df, roles)
        if len(design.names) > GRAM_COLUMNS:
            return None
        alphas = [float(self.config(c)["alpha"]) for c in configs]
        solve = lambda m: [(x.raw, x.intercept) for x in ridge(m, alphas)]
        return LM.narrow_cv(df, design, roles.id_col, roles.label_col, fold, folds, solve)


class TabularBoosting(Spec):
    """Histogram gradient boosting, no scaling."""

    name = "tabular_hgbr"
    data_types = ("dataframe_tabular",)
    task_types = ("regression",)
    defaults = {"max_iter": 200, "learning_rate": 0.1, "max_depth": 6}
    space = [Param("max_iter", "int", 100, 500), Param("learning_rate", "log", 0.01, 0.3), Param("max_depth", "int", 3, 10)]

    def fit(self, train, config, roles):
        c = self.config(config)
        fitted, cur = fit_stages(_feature_stages(roles), train)
        return Fitted(PipelineModel(fitted + [_boosted_regression(cur, c, roles)]), roles.id_col, self.name)

    def cv_predictions(self, df, roles, fold, folds, configs):
        _, cur = fit_stages(_feature_stages(roles), df)
        width = vector_size(cur, "_raw")
        if not boosting.fits(width, 1):
            return None
        rows = materialize(cur.select(
            F.monotonically_increasing_id().alias("r"), F.col(roles.id_col), vector_to_array("_raw").alias("x"),
            F.col(roles.label_col).cast("double").alias("y"), fold.cast("int").alias("fold"), boosting.kept_back(roles.id_col).alias("back"),
        ), "boosting-cv-rows")
        made = boosting.fit_side_by_side(rows, width, folds, [_boosting_settings(self.config(c)) for c in configs])
        if made is None:  # passes over the rows, a fit at a time
            return None
        return made.join(rows.select("r", roles.id_col, "y"), "r").select("split", roles.id_col, "y", "trial", "p")


# ----------------------------- classification ------------------------------


def with_weights(df: DataFrame, label: str, out: str) -> DataFrame:
    """C13 balanced weights per row: the class table (one row per class) as a literal map, so no row moves."""
    rows = class_weights(df, label).collect()
    table = F.create_map(*[F.lit(x) for r in rows for x in (r[label], float(r["weight"]))]) if rows else None
    return df.withColumn(out, F.element_at(table, F.col(label)) if rows else F.lit(1.0))


def _indexed_weighted(train: DataFrame, label: str):
    """C14 label index (sorted labels) + C13 balanced weights per row."""
    named = train.withColumn(label, F.col(label).cast("string"))
    indexer = StringIndexer(inputCol=label, outputCol="_label_idx", stringOrderType="alphabetAsc").fit(named)
    return indexer.labels, with_weights(indexer.transform(named), "_label_idx", "_w")


def _classifier_model(fitted: list, model, labels: list) -> PipelineModel:
    back = IndexToString(inputCol="_pred_idx", outputCol=PREDICTION, labels=labels)
    return PipelineModel(fitted + [model, back])


class _Classifier(Spec):
    center = True
    pca = False

    def make(self, c: dict, n_classes: int, n_features: int, sum_w: float):
        raise NotImplementedError

    def preprocess(self, roles: Roles) -> list:
        return _feature_stages(roles)

    def fit_model(self, slim: DataFrame, c: dict, labels: list, roles: Roles):
        """Fit the estimator on (features, _label_idx, _w); returns a transformer to ``_pred_idx``."""
        sum_w = slim.agg(F.sum("_w")).first()[0]
        est = self.make(c, len(labels), vector_size(slim, FEATURES), float(sum_w))
        return est.fit(slim)

    def fit(self, train, config, roles):
        c = self.config(config)
        labels, t = _indexed_weighted(train, roles.label_col)
        fitted, cur = fit_stages(self.preprocess(roles), t)
        in_col = "_raw"
        if self.center is not None:
            scale = population_scale(cur, "_raw", "_scaled", self.center)
            for s in scale:
                cur = s.transform(cur)
            fitted += scale
            in_col = "_scaled"
        if self.pca:
            p = pca_stage(cur, in_col, "_pca", int(c["n_components"]))
            cur = p.transform(cur)
            fitted.append(p)
            in_col = "_pca"
        # iterative learners pass over (features, label, weight) many times: keep only that slice
        slim = materialize(cur.select(roles.id_col, F.col(in_col).alias(FEATURES), "_label_idx", "_w"), "training-rows")
        model = self.fit_model(slim, c, labels, roles)
        return Fitted(_classifier_model(fitted + [SQLTransformer(statement=f"SELECT *, {in_col} AS {FEATURES} FROM __THIS__")], model, labels), roles.id_col, self.name)


def _logreg(c: dict, sum_w: float):
    return LogisticRegression(
        featuresCol=FEATURES, labelCol="_label_idx", weightCol="_w", predictionCol="_pred_idx",
        family="multinomial", regParam=1.0 / (float(c["C"]) * sum_w), elasticNetParam=0.0,
        standardization=False, maxIter=int(c.get("max_iter", 2000)), tol=1e-6,
    )


class TabularLogReg(_Classifier):
    """Centred scaling -> balanced multinomial logistic regression."""

    name = "tabular_logreg"
    data_types = ("dataframe_tabular",)
    task_types = ("classification",)
    defaults = {"C": 1.0}
    space = [Param("C", "log", 1e-3, 1e2)]

    def make(self, c, n_classes, n_features, sum_w):
        return _logreg({**c, "max_iter": 2000}, sum_w)


class TabularBoostingClassifier(_Classifier):
    """Balanced histogram boosting on the log loss, one tree a class and step (one for two classes)."""

    name = "tabular_hgbc"
    data_types = ("dataframe_tabular",)
    task_types = ("classification",)
    center = None
    defaults = {"max_iter": 200, "learning_rate": 0.1, "max_depth": 6}
    space = [Param("max_iter", "int", 100, 500), Param("learning_rate", "log", 0.01, 0.3), Param("max_depth", "int", 3, 10)]

    def fit_model(self, slim, c, labels, roles):
        width = vector_size(slim, FEATURES)
        if not boosting.fits(width, len(labels)):
            return super().fit_model(slim, c, labels, roles)
        rows = boosting.training_rows(slim, FEATURES, F.col("_label_idx"), F.col("_w"), roles.id_col)
        trees = boosting.fit(rows, width, "log", len(labels), _boosting_settings(c))
        return boosting.BoostedTrees(trees, "log", FEATURES, "_pred_idx")

    def make(self, c, n_classes, n_features, sum_w):
        gbt = GBTClassifier(
            featuresCol=FEATURES, labelCol="_label_idx", weightCol="_w", maxIter=int(c["max_iter"]),
            stepSize=float(c["learning_rate"]), maxDepth=int(c["max_depth"]), seed=42,
            minInstancesPerNode=MIN_LEAF, **BOOSTING,
        )
        if n_classes <= 2:
            return gbt.setPredictionCol("_pred_idx")
        return _one_vs_rest(gbt, n_classes)


class TabularForest(_Classifier):
    """Balanced random forest (unlimited depth -> Spark's maximum, 30); on many rows grown in tasks."""

    name = "tabular_rf"
    data_types = ("dataframe_tabular",)
    task_types = ("classification",)
    center = None
    defaults = {"n_estimators": 200, "max_depth": None}
    space = [Param("n_estimators", "int", 50, 500), Param("max_depth", "int", 3, 20)]

    def depth(self, c):
        return 30 if c.get("max_depth") is None else min(30, int(c["max_depth"]))

    def fit_model(self, slim, c, labels, roles):
        width, trees, k, n = vector_size(slim, FEATURES), int(c["n_estimators"]), len(labels), slim.count()
        level = trees * min(2 ** (self.depth(c) - 1), n // 2) * forest.chosen(width) * forest.BINS * (k + 1) * 8
        if trees * n <= FOREST_ROWS or level <= FOREST_SUMS or not forest.fits(width, k):
            return super().fit_model(slim, c, labels, roles)
        by = {int(r["_label_idx"]): float(r["w"]) for r in slim.groupBy("_label_idx").agg(F.first("_w").alias("w")).collect()}
        rows = slim.select(vector_to_array(FEATURES).alias("x"), F.col("_label_idx").alias("y"))
        return forest.fit(rows, width, [by.get(i, 0.0) for i in range(k)], forest.Settings(trees, self.depth(c)), FEATURES, "_pred_idx")

    def make(self, c, n_classes, n_features, sum_w):
        return RandomForestClassifier(
            featuresCol=FEATURES, labelCol="_label_idx", weightCol="_w", predictionCol="_pred_idx",
            numTrees=int(c["n_estimators"]), maxDepth=self.depth(c), seed=42, **FOREST_EXEC,
        )


class ExprLogReg(_Classifier):
    """(normalized, log1p'd input) -> centred scaling -> PCA(k) -> balanced logistic."""

    name = "expr_logreg"
    data_types = ("anndata",)
    task_types = ("classification",)
    pca = True
    defaults = {"n_components": 50, "C": 1.0, "max_iter": 2000, "target_sum": 1e4}
    space = [Param("n_components", "int", 20, 200), Param("C", "log", 1e-3, 1e2),
             Param("max_iter", "fixed", choices=[2000]), Param("target_sum", "fixed", choices=[1e4])]

    def make(self, c, n_classes, n_features, sum_w):
        return _logreg(c, sum_w)


class CalibratedOneVsRest(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Cross-fitted sigmoid-calibrated one-vs-rest margins (E5's probability model).

    Each calibration fold has a linear margin per class (weights and intercept)
    and its sigmoid parameters (a, b).  For a row: p_c = 1 / (1 + exp(-(a_c * m_c
    + b_c))), normalized over classes (uniform when all are 0), averaged over
    folds; the prediction is the arg-max class index.  All of it is Column
    arithmetic; the numbers are one JSON parameter, so the stage saves and loads.
    """

    folds = MLParam(Params._dummy(), "folds", "JSON of the folds' margins and sigmoids", TypeConverters.toString)

    def __init__(self, folds: list | None = None):
        super().__init__()
        if folds is not None:
            self._set(folds=json.dumps(folds))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        folds = json.loads(self.getOrDefault(self.folds))
        k = len(folds[0])
        cur = dataset.withColumn("_x", vector_to_array(FEATURES))
        probs = []
        for f in folds:
            p = []
            for c in f:
                weights = F.split(F.lit(",".join(map(repr, c["w"]))), ",").cast("array<double>")  # one literal
                m = F.aggregate(F.zip_with("_x", weights, lambda x, w: x * w), F.lit(c["m"]), lambda s, v: s + v)
                p.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(c["a"]) * m + F.lit(c["b"])))))
            name = f"_cal_{len(probs)}"
            cur = cur.withColumn(name, F.array(*p))
            total = F.aggregate(name, F.lit(0.0), lambda s, v: s + v)
            probs.append((name, total))
        avg = [
            sum(F.when(total > 0, F.get(F.col(n), c) / total).otherwise(1.0 / k) for n, total in probs) / len(probs)
            for c in range(k)
        ]
        cur = cur.withColumn("_cal_prob", F.array(*avg))
        pred = (F.array_position("_cal_prob", F.array_max("_cal_prob")) - 1).cast("double")
        return cur.withColumn("_pred_idx", pred).drop("_x", *[n for n, _ in probs])


class ExprSVM(_Classifier):
    """E5: same preparation -> balanced linear SVM with squared hinge, one class against the
    rest, with cross-fitted sigmoid probability calibration (folds = min(3, smallest class), or 2).

    As in the reference's solver the intercept is penalized, and with more than two
    classes the balanced weight goes to a problem's own class, the rest having weight 1.
    """

    name = "expr_svm"
    data_types = ("anndata",)
    task_types = ("classification",)
    pca = True
    defaults = {"n_components": 50, "C": 1.0, "target_sum": 1e4}
    space = [Param("n_components", "int", 20, 200), Param("C", "log", 1e-3, 1e2), Param("target_sum", "fixed", choices=[1e4])]

    def fit_model(self, slim, c, labels, roles):
        from scorewell.operators.folds import adaptive_splits, stratified_kfold

        k, cost = len(labels), float(c["C"])
        n_splits = adaptive_splits(slim, "_label_idx")
        tagged = stratified_kfold(slim, roles.id_col, "_label_idx", n_splits, 42, "_cal_fold")
        rows = materialize(
            tagged.select("_cal_fold", F.col("_label_idx").cast("int").alias("_cls"), vector_to_array(FEATURES).alias("_x")), "margin-rows"
        )
        width = vector_size(slim, FEATURES)
        counts = {(r["_cal_fold"], r["_cls"]): r["count"] for r in rows.groupBy("_cal_fold", "_cls").count().collect()}
        problems = []
        for f in range(n_splits):
            train = [sum(n for (g, j), n in counts.items() if g != f and j == cls) for cls in range(k)]
            balanced = [sum(train) / (k * n) if n else 0.0 for n in train]
            for cls in range(k):
                rest = balanced[1 - cls] if k == 2 else 1.0
                problems.append(Problem(f, cls, cost * balanced[cls], cost * rest))
        w = squared_hinge(rows, width, problems)
        ab = sigmoids(rows, width, problems, w, counts)
        folds = [[] for _ in range(n_splits)]
        for p, x, (a, b) in zip(problems, w, ab):
            folds[p.fold].append({"w": x[:-1].tolist(), "m": float(x[-1]), "a": float(a), "b": float(b)})
        return CalibratedOneVsRest(folds)


class ExprMLP(_Classifier):
    """Same preparation -> multilayer perceptron (h1, h2)."""

    name = "expr_mlp"
    data_types = ("anndata",)
    task_types = ("classification",)
    pca = True
    ignored = ("alpha", "lr")
    defaults = {"n_components": 50, "hidden1": 256, "hidden2": 128, "max_iter": 500, "target_sum": 1e4}
    space = [
        Param("n_components", "int", 20, 200),
        Param("hidden1", "choice", choices=[128, 256, 512]),
        Param("hidden2", "choice", choices=[64, 128, 256]),
        Param("max_iter", "fixed", choices=[500]),
        Param("target_sum", "fixed", choices=[1e4]),
    ]

    def fit_model(self, slim, c, labels, roles):
        # each step sends one gradient a part, of all weights, so parts are no more than cores
        return super().fit_model(slim.coalesce(slim.sparkSession.sparkContext.defaultParallelism), c, labels, roles)

    def make(self, c, n_classes, n_features, sum_w):
        return MultilayerPerceptronClassifier(
            featuresCol=FEATURES, labelCol="_label_idx", predictionCol="_pred_idx",
            layers=[n_features, int(c["hidden1"]), int(c["hidden2"]), n_classes],
            maxIter=int(c["max_iter"]), seed=42,
        )


class MeanPredictor(Spec):
    """The training mean for every row."""

    name = "mean_predictor"
    data_types = ("dataframe_sequence", "dataframe_tabular")
    task_types = ("regression",)

    def fit(self, train, config, roles):
        mean = train.agg(F.avg(F.col(roles.label_col).cast("double"))).first()[0]
        stage = SQLTransformer(statement=f"SELECT *, CAST({mean!r} AS DOUBLE) AS {PREDICTION} FROM __THIS__")
        return Fitted(PipelineModel([stage]), roles.id_col, self.name)

    def cv_predictions(self, df, roles, fold, folds, configs):
        rows = df.select(fold.cast("int").alias("split"), roles.id_col, F.col(roles.label_col).cast("double").alias("y"))
        sums = {r["split"]: (r["s"] or 0.0, r["n"]) for r in rows.groupBy("split").agg(F.sum("y").alias("s"), F.count("y").alias("n")).collect()}
        s, n = (sum(v[k] for v in sums.values()) for k in (0, 1))
        mean = F.lit(None).cast("double")
        for f in range(folds):  # the training rows of a split: all less its fold
            sf, nf = sums.get(f, (0.0, 0))
            if n > nf:
                mean = F.when(F.col("split") == f, F.lit((s - sf) / (n - nf))).otherwise(mean)
        trials = F.explode(F.array(*[F.lit(t) for t in range(len(configs))]))
        return rows.where("split is not null").select("split", roles.id_col, "y", trials.alias("trial"), mean.alias("p"))


# K2 registry, in registration order (the planner keeps this order).
REGISTRY: list[Spec] = [
    KmerRidge(),
    KmerElasticNet(),
    KmerBoosting(),
    ExprLogReg(),
    ExprSVM(),
    ExprMLP(),
    TabularRidge(),
    TabularBoosting(),
    TabularLogReg(),
    TabularBoostingClassifier(),
    TabularForest(),
]
EXTRA = [MeanPredictor()]


def register_pipeline(spec: Spec) -> Spec:
    """K2: add a pipeline factory; it becomes a planner candidate for its types."""
    REGISTRY.append(spec)
    return spec


def get_spec(name: str) -> Spec:
    for s in REGISTRY + EXTRA:
        if s.name == name:
            return s
    raise KeyError(f"no pipeline is registered as {name!r}")
