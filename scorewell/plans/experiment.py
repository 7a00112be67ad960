"""K1 datasets and the whole run: plan, cross-validate, refit, predict, evaluate, submit.

A registered dataset brings a loader and an evaluator.  ``run_experiments`` works
through the plan's rows: each experiment gets its cross-validated score, the best
one is refitted on every training row (an ensemble refits its two members) and
saved, its test predictions are evaluated (an incomplete submission is refused),
and the record is appended to the submission store, from which the leaderboard
reads.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewell.operators import metrics as M
from scorewell.operators import selection as SE
from scorewell.plans import cv as CV
from scorewell.plans.estimators import Roles, get_spec
from scorewell.plans.planning import plan_steps
from scorewell.session import materialize
from scorewell.sources import submissions as S

METRICS = {"regression": M.REGRESSION_METRICS, "classification": M.CLASSIFICATION_METRICS}


@dataclass
class Dataset:
    """``load(spark, fold)`` gives (train, test); ``evaluate(targets, preds)`` one row with ``valid`` and metrics.

    Targets and predictions are frames (id, y) and (id, p).
    """

    name: str
    load: Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]
    evaluate: Callable[[DataFrame, DataFrame], DataFrame]
    roles: Roles
    data_type: str
    task: str

    @property
    def primary(self) -> str:
        return CV.primary_metric(self.task)


DATASETS: dict[str, Dataset] = {}


def register_dataset(dataset: Dataset) -> Dataset:
    """K1: add a dataset; its name is stored in the normalized form (H7)."""
    DATASETS[dataset.name.replace("-", "_")] = dataset
    return dataset


def dataset_named(name: str) -> Dataset:
    try:
        return DATASETS[name.replace("-", "_")]
    except KeyError:
        raise KeyError(f"no dataset is registered as {name!r}; known: {sorted(DATASETS)}") from None


def default_evaluate(task: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return M.evaluate_regression if task == "regression" else M.evaluate_classification


RESULTS = "step int, experiment string, pipeline string, config string, metric string, value double, seconds double"


def run_steps(
    steps: DataFrame, train: DataFrame, roles: Roles, task: str, seed: int = 42, trials: int | None = None
) -> DataFrame:
    """The experiments table of a plan.  ``trials`` replaces the plan's count (for tests)."""
    spark = train.sparkSession
    splits = CV.stored(CV.make_splits(train, roles, task, seed))
    done: list[tuple] = []
    for row in steps.collect():  # as many rows as experiments
        began = time.time()
        if row["pipeline"] is None:
            best = top_two(spark.createDataFrame(done, RESULTS))
            config = {"members": [{"pipeline": r["pipeline"], "config": json.loads(r["config"])} for r in best]}
            members = [(get_spec(m["pipeline"]), m["config"]) for m in config["members"]]
            value = CV.ensemble_cv(members, splits, roles, task)
        elif row["trials"]:
            config, value = CV.tune(get_spec(row["pipeline"]), splits, roles, task, trials or row["trials"], seed)
        else:
            config = get_spec(row["pipeline"]).config()
            value = CV.cross_validate(get_spec(row["pipeline"]), splits, roles, task, config)
        done.append((
            row["step"], row["experiment"], row["pipeline"], json.dumps(config, sort_keys=True),
            CV.primary_metric(task), value, time.time() - began,
        ))
    return spark.createDataFrame(done, RESULTS)


def top_two(results: DataFrame) -> list:
    ranked = results.select(F.col("step").alias("ordinal"), "value", "experiment", "pipeline", "config")
    return SE.top_k_experiments(ranked, 2).collect()


def refit(best, train: DataFrame, roles: Roles, task: str, path: str) -> Callable[[DataFrame], DataFrame]:
    """Fit the chosen experiment on all training rows, save it, and return its predictor from the saved models."""
    config = json.loads(best["config"])
    members = config.get("members") or [{"pipeline": best["pipeline"], "config": config}]
    loaded = []
    for i, m in enumerate(members):
        spec = get_spec(m["pipeline"])
        at = f"{path.rstrip('/')}/member-{i}"
        CV.save_model(spec.fit(train, m["config"], roles), at)
        loaded.append((spec, CV.load_model(at, roles.id_col, spec.name)))

    def predict(df: DataFrame) -> DataFrame:
        parts = [spec.predict(f, df).withColumnRenamed("prediction", "p") for spec, f in loaded]
        if len(parts) == 1:
            return parts[0]
        return CV.combined(reduce(DataFrame.unionByName, parts), [roles.id_col], task)

    return predict


def evaluate_submission(dataset: Dataset, preds: DataFrame, targets: DataFrame) -> dict:
    """The evaluator's row; an incomplete submission is refused."""
    id_col, label = dataset.roles.id_col, dataset.roles.label_col
    row = dataset.evaluate(
        targets.select(F.col(id_col).alias("id"), F.col(label).alias("y")),
        preds.select(F.col(id_col).alias("id"), "p"),
    ).first().asDict()
    if not row.get("valid", True):
        raise ValueError(f"predictions don't match the targets: { {k: row[k] for k in M.PROBLEMS} }")
    return row


def submit(
    dataset: Dataset, fold: str, user: str, store: str, metrics: dict, timestamp: str,
    name: str | None = None, description: str | None = None, spark: SparkSession | None = None,
) -> None:
    """A4 for one evaluated submission."""
    spark = spark or SparkSession.active()
    values = {m: float(metrics[m]) for m in METRICS[dataset.task]}
    record = spark.createDataFrame(
        [(timestamp, user, dataset.name, str(fold), dataset.primary, values, name, description)],
        "timestamp string, user string, dataset string, fold string, primary_metric string, "
        "metrics map<string,double>, name string, description string",
    )
    S.append_submissions(record, store)


def run_experiments(
    spark: SparkSession, name: str, fold: str, user: str, store: str, models: str, timestamp: str,
    budget: str = "fast", seed: int = 42, trials: int | None = None, registry: list | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(experiments table, test predictions) of a whole run; its record is in ``store`` afterwards."""
    dataset = dataset_named(name)
    # every step reads these rows, so whatever is behind them runs once
    train, test = (materialize(rows, name) for rows, name in zip(dataset.load(spark, fold), ("train-rows", "test-rows")))
    steps = plan_steps(spark, dataset.data_type, dataset.task, budget, registry)
    results = run_steps(steps, train, dataset.roles, dataset.task, seed, trials)
    if results.isEmpty():
        raise ValueError(f"nothing registered learns {dataset.task} from {dataset.data_type} data")
    best = top_two(results)[0]
    predict = refit(best, train, dataset.roles, dataset.task, models)
    preds = materialize(predict(test.drop(dataset.roles.label_col)), "test-predictions")
    metrics = evaluate_submission(dataset, preds, test)
    submit(dataset, fold, user, store, metrics, timestamp, name=best["experiment"], spark=spark)
    return results, preds
