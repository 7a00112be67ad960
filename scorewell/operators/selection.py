"""Experiment selection and ensembling.

Experiments table columns: ``experiment`` (name), ``ordinal`` (run order),
``value`` (primary metric, higher is better), optionally ``trial``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_trial(trials: DataFrame, group_cols: Sequence[str] = ("experiment",)) -> DataFrame:
    """G5 per group: arg-max of value, the first trial (lowest ordinal) wins ties.

    ``min_by`` over (−value, ordinal) is a hash aggregate with map-side partials.
    """
    key = F.struct((-F.col("value")).alias("neg"), F.col("ordinal"))
    return trials.groupBy(*group_cols).agg(
        F.min_by(F.struct("ordinal", "value"), key).alias("_b"), F.count(F.lit(1)).alias("n_trials")
    ).select(*group_cols, F.col("_b.ordinal").alias("ordinal"), F.col("_b.value").alias("value"), "n_trials")


def select_best(experiments: DataFrame) -> DataFrame:
    """G5 over the whole table: one row, first wins ties."""
    key = F.struct((-F.col("value")).alias("neg"), F.col("ordinal"))
    return experiments.agg(F.min_by(F.struct(*experiments.columns), key).alias("_b")).select("_b.*")


def top_k_experiments(experiments: DataFrame, k: int = 2) -> DataFrame:
    """The k best by value, stable on ties (TakeOrderedAndProject, no full sort)."""
    return experiments.orderBy(F.desc("value"), F.asc("ordinal")).limit(k)


def experiments_table(experiments: DataFrame) -> DataFrame:
    """Every run in run order."""
    return experiments.orderBy("ordinal")


def beats_baseline(experiments: DataFrame, baseline_ordinal: int | None = None) -> DataFrame:
    """Each experiment vs the baseline (lowest ordinal unless given): strictly better?"""
    if baseline_ordinal is None:
        base = experiments.agg(F.min_by("value", "ordinal").alias("b")).first()["b"]
    else:
        base = experiments.where(F.col("ordinal") == baseline_ordinal).agg(F.first("value").alias("b")).first()["b"]
    # one scalar read back; compared as a literal
    out = experiments.withColumn("baseline_value", F.lit(base).cast("double"))
    return out.withColumn("beats_baseline", F.coalesce(F.col("value") > F.col("baseline_value"), F.lit(False)))


def ensemble_mean(member_preds: DataFrame, id_col: str = "id", pred_col: str = "p") -> DataFrame:
    """Average of member predictions per row id (partial aggregation per task)."""
    return member_preds.groupBy(id_col).agg(
        F.avg(pred_col).alias(pred_col), F.count(F.lit(1)).alias("n_members")
    )


def ensemble_vote(member_preds: DataFrame, id_col: str = "id", pred_col: str = "p") -> DataFrame:
    """Majority vote per row id; ties go to the smallest label."""
    votes = member_preds.groupBy(id_col, pred_col).agg(F.count(F.lit(1)).alias("_n"))
    key = F.struct((-F.col("_n")).alias("neg"), F.col(pred_col))
    return votes.groupBy(id_col).agg(F.min_by(pred_col, key).alias(pred_col), F.sum("_n").alias("n_members"))
