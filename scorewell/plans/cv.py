"""D5 cross_validate, G3 search, G4 tune, G9 ensemble_cv, A8/A9 model I/O.

The driver holds only the loop over splits and trials; every fit and every score
is a Spark job.  The predictions of all splits are written once as one narrow
table (split, id, p, y), which the metrics of all splits read in ONE grouped
aggregate and an ensemble reads again.
"""

from __future__ import annotations

import hashlib
import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewell.operators import metrics as M
from scorewell.operators import selection as SE
from scorewell.operators.folds import (
    MAX_SPLITS,
    adaptive_splits,
    inner_folds_by_column,
    kfold,
    stratified_kfold,
)
from scorewell.plans.estimators import Fitted, Param, Roles, Spec
from scorewell.plans.linear_models import fold_codes
from scorewell.session import materialize
from scorewell.sources.tables import fold_split

MAX_CONCURRENT_FITS = 3  # one per CV split
MAX_CONCURRENT_TRIALS = 2  # tuning trials in flight at once


@dataclass
class Splits:
    """Split definition: validate where ``col`` == value, train on the rest (null-safe)."""

    frame: DataFrame  # input rows with the split column attached
    col: str
    values: list
    stored: bool = False  # the frame is a written table with enough parts for all cores


def stored(splits: Splits) -> Splits:
    """The splits with their rows written once, for callers that work through them several times."""
    frame = splits.frame
    cores = frame.sparkSession.sparkContext.defaultParallelism
    # a small file is one task's work otherwise
    frame = materialize(frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame, "split-rows")
    return Splits(frame, splits.col, splits.values, True)


def make_splits(df: DataFrame, roles: Roles, task: str, seed: int = 42) -> Splits:
    """fold_id with >= 3 values -> first three folds (D1); classification ->
    stratified with adaptive k (D3/D4); regression -> shuffled 3-fold (D2)."""
    if "fold_id" in df.columns:
        vals = inner_folds_by_column(df, "fold_id")
        if vals:
            return Splits(df, "fold_id", vals)
    if task == "classification":
        k = adaptive_splits(df, roles.label_col)
        return Splits(stratified_kfold(df, roles.id_col, roles.label_col, k, seed), "cv_fold", list(range(k)))
    return Splits(kfold(df, roles.id_col, MAX_SPLITS, seed), "cv_fold", list(range(MAX_SPLITS)))


def primary_metric(task: str) -> str:
    return M.REGRESSION_PRIMARY if task == "regression" else M.CLASSIFICATION_PRIMARY


def score_splits(preds: DataFrame, task: str) -> DataFrame:
    """Per-split primary metric from (split, p, y) rows; null where a row has no prediction."""
    if task == "regression":
        m = M.regression_metrics(preds, "p", "y", ["split"])
    else:
        text = preds.withColumn("y", F.col("y").cast("string")).withColumn("p", F.col("p").cast("string"))
        m = M.classification_metrics(text, "p", "y", ["split"])
    return m.select("split", F.col(primary_metric(task)).alias("score"))


def trial_predictions(spec: Spec, splits: Splits, roles: Roles, configs: list[dict | None]) -> DataFrame:
    """(trial, split, id, p, y) of every config: fitted on each split's train rows, written once.

    Pipelines that can solve all splits and configs from shared passes do so
    (``Spec.cv_predictions``).  Others are fitted one by one: what a row contributes
    whatever the split (k-mers of a text) is written once for all splits of a trial, and
    the fits are independent Spark jobs, submitted from small thread pools.  No cache
    is shared between them.
    """
    out = ["trial", "split", roles.id_col, "p", "y"]
    k = len(splits.values)
    if len(configs) * k > 1 and not splits.stored:
        splits = stored(splits)
    frame = splits.frame
    shared = spec.cv_predictions(frame, roles, fold_codes(splits.col, splits.values), k, configs)
    if shared is not None:
        return materialize(shared.select(*out), "split-predictions")

    def one(trial: int, whole: DataFrame, ready: Spec, i: int) -> DataFrame:
        train, val = fold_split(whole, splits.values[i], splits.col)
        p = ready.predict(ready.fit(train, configs[trial], roles), val).withColumnRenamed("prediction", "p")
        y = val.select(roles.id_col, F.col(roles.label_col).alias("y"))
        named = y.join(p, roles.id_col, "left").withColumn("trial", F.lit(trial)).withColumn("split", F.lit(i))
        return named.select(*out)

    def of_trial(trial: int) -> DataFrame:
        whole, ready = spec.prepare(frame, configs[trial], roles)
        if whole is not frame:
            whole = materialize(whole, "prepared-rows")
        with ThreadPoolExecutor(max_workers=max(1, min(k, MAX_CONCURRENT_FITS))) as pool:
            parts = list(pool.map(lambda i: one(trial, whole, ready, i), range(k)))
        return materialize(reduce(DataFrame.unionByName, parts), "split-predictions")

    with ThreadPoolExecutor(max_workers=max(1, min(len(configs), MAX_CONCURRENT_TRIALS))) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(of_trial, range(len(configs)))))


def split_predictions(spec: Spec, splits: Splits, roles: Roles, config: dict | None) -> DataFrame:
    """(split, id, p, y) of one config, written once."""
    return trial_predictions(spec, splits, roles, [config]).drop("trial")


def mean_score(preds: DataFrame, task: str) -> float:
    """F11 on split predictions: mean primary metric over splits (NaN or not scorable -> 0)."""
    return float(M.cv_scores(score_splits(preds, task), "score").first()["cv_score"])


def cross_validate(spec: Spec, splits: Splits, roles: Roles, task: str, config: dict | None = None) -> float:
    """D5."""
    return mean_score(split_predictions(spec, splits, roles, config), task)


# --------------------------------------------------------------------------
# G3 seeded random search (replaces the reference's unseeded adaptive sampler)
# --------------------------------------------------------------------------


def uniform(trial: int, param: str, seed: int) -> float:
    """u in [0, 1): first 32 bits of md5('trial|param|seed') / 2^32 (same in SQL)."""
    h = hashlib.md5(f"{trial}|{param}|{seed}".encode()).hexdigest()
    return int(h[:8], 16) / 4294967296.0


def sample_config(space: list[Param], trial: int, seed: int) -> dict:
    out = {}
    for p in space:
        u = uniform(trial, p.name, seed)
        if p.kind == "int":
            out[p.name] = int(math.floor(p.low + u * (p.high - p.low + 1)))
        elif p.kind == "float":
            out[p.name] = p.low + u * (p.high - p.low)
        elif p.kind == "log":
            out[p.name] = math.exp(math.log(p.low) + u * (math.log(p.high) - math.log(p.low)))
        elif p.kind == "choice":
            out[p.name] = p.choices[min(int(u * len(p.choices)), len(p.choices) - 1)]
        else:  # fixed
            out[p.name] = p.choices[0]
    return out


def sample_trials(spec: Spec, n: int, seed: int = 42) -> list[dict]:
    """N configs for a pipeline (defaults overlaid by the sampled values)."""
    return [spec.config(sample_config(spec.space, t, seed)) for t in range(n)]


def trial_scores(spec: Spec, splits: Splits, roles: Roles, task: str, n_trials: int, seed: int = 42) -> DataFrame:
    """G4 as a table: (trial, config, score), the score from the trials' split predictions.

    All trials are scored together in one grouped aggregate.
    """
    configs = sample_trials(spec, n_trials, seed)
    texts = [json.dumps(c, sort_keys=True) for c in configs]
    # trials of one config are the same fits: they are made once and share the score
    alike = sorted(set(texts), key=texts.index)
    preds = trial_predictions(spec, splits, roles, [configs[texts.index(t)] for t in alike])
    k = len(splits.values)
    if task == "regression":
        scored = M.trial_spearman(preds, k)
    else:
        # a split of a trial is a group of its own
        scored = score_splits(preds.withColumn("split", F.col("trial") * k + F.col("split")), task)
        scored = scored.withColumn("trial", F.expr(f"split div {k}").cast("int"))
    scores = M.cv_scores(scored, "score", ["trial"]).select(F.col("trial").alias("_made"), F.col("cv_score").alias("score"))
    spark = preds.sparkSession
    named = spark.createDataFrame([(t, c, alike.index(c)) for t, c in enumerate(texts)], "trial int, config string, _made int")
    return scores.join(named, "_made").select("trial", "score", "config")


def tune(spec: Spec, splits: Splits, roles: Roles, task: str, n_trials: int, seed: int = 42) -> tuple[dict, float]:
    """G4 + G5: the config with the highest score (the first wins ties) and that score."""
    trials = trial_scores(spec, splits, roles, task, n_trials, seed)
    best = SE.select_best(trials.select(F.col("trial").alias("ordinal"), F.col("score").alias("value"), "config")).first()
    return json.loads(best["config"]), float(best["value"])


# --------------------------------------------------------------------------
# G9 ensemble
# --------------------------------------------------------------------------


def combined(preds: DataFrame, keys: list[str], task: str) -> DataFrame:
    """G7 / G8 on rows (keys, p[, y]) of several members: mean or majority, one row per key."""
    carry = [F.max("y").alias("y")] if "y" in preds.columns else []
    if task == "regression":
        # a member without a prediction leaves the row without one
        p = F.when(F.count("p") == F.count(F.lit(1)), F.avg("p"))
        return preds.groupBy(*keys).agg(p.alias("p"), *carry)
    votes = preds.groupBy(*keys, F.col("p").cast("string").alias("p")).agg(F.count(F.lit(1)).alias("_n"), *carry)
    first = F.struct((-F.col("_n")).alias("neg"), F.col("p"))
    return votes.groupBy(*keys).agg(F.min_by("p", first).alias("p"), *carry)


def ensemble_predictions(members: list[tuple[Spec, dict | None]], splits: Splits, roles: Roles, task: str) -> DataFrame:
    """Refit every member per split and combine: (split, id, p, y)."""
    parts = [split_predictions(spec, splits, roles, cfg) for spec, cfg in members]
    return combined(reduce(DataFrame.unionByName, parts), ["split", roles.id_col], task)


def ensemble_cv(members: list[tuple[Spec, dict | None]], splits: Splits, roles: Roles, task: str) -> float:
    return mean_score(ensemble_predictions(members, splits, roles, task), task)


# --------------------------------------------------------------------------
# A8 / A9
# --------------------------------------------------------------------------


def save_model(fitted: Fitted, path: str) -> None:
    """Persist the fitted pipeline."""
    fitted.model.write().overwrite().save(path)


def load_model(path: str, id_col: str, spec: str = "") -> Fitted:
    return Fitted(PipelineModel.load(path), id_col, spec)


def batch_predict(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Apply a saved model to new rows; input keeps its columns plus ``predictions``."""
    out = fitted.model.transform(df)
    return out.select(*df.columns, F.col("prediction").alias("predictions"))


def save_expression_model(fitted: Fitted, genes: DataFrame, path: str) -> None:
    """A9 for matrix data: the pipeline plus the training gene index (column order)."""
    save_model(fitted, f"{path.rstrip('/')}/pipeline")
    genes.write.mode("overwrite").parquet(f"{path.rstrip('/')}/genes")


def load_expression_model(spark: SparkSession, path: str, id_col: str = "cell_id") -> tuple[Fitted, DataFrame]:
    base = path.rstrip("/")
    return load_model(f"{base}/pipeline", id_col), spark.read.parquet(f"{base}/genes")


def batch_predict_expression(spark: SparkSession, fitted: Fitted, genes: DataFrame, coo: DataFrame, obs: DataFrame) -> DataFrame:
    """A8 for matrix input: total-count normalize (fixed 1e4) + log1p the new cells'
    COO rows, lay them out in the *training* gene order (unknown genes dropped,
    absent genes 0), then apply the saved pipeline."""
    from scorewell.sources.expression import read_expression

    cells, _ = read_expression(spark, coo, obs, normalize=True, genes=genes)
    return batch_predict(fitted, cells)

