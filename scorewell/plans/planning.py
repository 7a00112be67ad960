"""G1 candidate pipelines and G2 experiment plan, as small tables.

The registry and the budget tiers are tables; which pipelines fit a dataset and
which experiments a run makes are joins and filters on them.  ``plan_steps``
returns rows, and the runner (``experiment.py``) works through them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewell.plans.estimators import REGISTRY, Spec

# Per tier the tuned models, trials for each, and whether the best two are combined.
BUDGETS = [("fast", 2, 10, False), ("standard", 3, 30, True), ("thorough", 5, 60, True)]
TABULAR = "dataframe_tabular"
TEXT = "dataframe_sequence"


def pipeline_table(spark: SparkSession, registry: list[Spec] | None = None) -> DataFrame:
    """(position, pipeline, data_type, task): one row per kind of data and task a pipeline can learn."""
    rows = [
        (i, s.name, d, t)
        for i, s in enumerate(REGISTRY if registry is None else registry)
        for d in s.data_types
        for t in s.task_types
    ]
    return spark.createDataFrame(rows, "position int, pipeline string, data_type string, task string")


def budget_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUDGETS, "budget string, models int, trials int, combine boolean")


def candidates(spark: SparkSession, data_type: str, task: str, registry: list[Spec] | None = None) -> DataFrame:
    """G1: (place, pipeline) in registration order.

    Pipelines of the data type come first in preference; a data type without its
    own takes the tabular ones of the task.  Text has no such stand-in, as
    tabular pipelines read numbers only.
    """
    fits = pipeline_table(spark, registry).where(F.col("task") == task)
    tier = F.when(F.col("data_type") == data_type, 0)
    if data_type != TEXT:
        tier = tier.when(F.col("data_type") == TABULAR, 1)
    ranked = fits.withColumn("tier", tier).where("tier is not null")
    # the table has a row per registered pipeline
    best = ranked.withColumn("first_tier", F.min("tier").over(Window.partitionBy()))
    kept = best.where("tier = first_tier").groupBy("pipeline").agg(F.min("position").alias("position"))
    place = F.row_number().over(Window.orderBy("position")) - 1
    return kept.select(place.alias("place"), "pipeline")


def plan_steps(
    spark: SparkSession, data_type: str, task: str, budget: str = "fast", registry: list[Spec] | None = None
) -> DataFrame:
    """(step, experiment, pipeline, trials), in order.

    The first candidate runs once as it is, then each candidate the tier has room
    for is tuned, and a tier that combines ends with the ensemble (no pipeline of
    its own).
    """
    found = candidates(spark, data_type, task, registry)
    tier = budget_table(spark).where(F.col("budget") == budget)
    tuned = found.join(tier, F.col("place") < F.col("models")).select(
        (F.col("place") + 1).alias("step"), F.concat(F.lit("tuned_"), "pipeline").alias("experiment"), "pipeline", "trials"
    )
    plain = found.where("place = 0").select(
        F.lit(0).alias("step"), F.concat(F.lit("baseline_"), "pipeline").alias("experiment"), "pipeline", F.lit(0).alias("trials")
    )
    last = tier.where("combine").select(
        (F.col("models") + 1).alias("step"), F.lit("ensemble").alias("experiment"),
        F.lit(None).cast("string").alias("pipeline"), F.lit(0).alias("trials"),
    )
    return plain.union(tuned).union(last).orderBy("step")
