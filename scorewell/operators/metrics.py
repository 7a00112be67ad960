"""F1-F11 scoring metrics and M1 prediction validation.

Predictions and targets are matched by an explicit id (Spark has no row
order).  ``evaluate_regression`` and ``evaluate_classification`` score a
submission: they keep every target, count what is missing, extra, repeated or
null, and give metrics only where each target has exactly one prediction.
Every metric is an aggregate; ratios use ``try_divide`` because ANSI mode raises
on a zero denominator even inside ``CASE``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.operators.rank import doubled_ranks, rank_sums
from scorewell.session import materialize

REGRESSION_PRIMARY = "spearman"
CLASSIFICATION_PRIMARY = "f1_macro"
REGRESSION_METRICS = ["spearman", "pearson", "mse", "mae", "rmse", "r2"]
CLASSIFICATION_METRICS = ["f1_macro", "f1_weighted", "accuracy", "precision_macro", "recall_macro"]


PROBLEMS = ["missing", "extra", "duplicate", "null_predictions"]


def matched(targets: DataFrame, preds: DataFrame, id_col: str = "id", pred_col: str = "p") -> DataFrame:
    """Targets and predictions side by side, nothing dropped (full outer join on the id).

    Predictions are combined by id first, so a hot id collapses map-side.  Adds
    ``_t`` (1 for a target row), ``_np`` (predictions of the id, null if none),
    ``_nn`` (those that aren't null) and the prediction itself, which is null
    unless it is the id's only one.
    """
    per_id = preds.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_np"), F.count(F.col(pred_col)).alias("_nn"), F.max(pred_col).alias("_p")
    )
    rows = targets.withColumn("_t", F.lit(1)).join(per_id, id_col, "full_outer")
    return rows.withColumn(pred_col, F.when(F.col("_np") == 1, F.col("_p"))).drop("_p")


def _problem_counts() -> list[Column]:
    return [
        F.count(F.when(F.col("_np").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("_t").isNull(), 1)).alias("extra"),
        F.count(F.when(F.col("_np") > 1, 1)).alias("duplicate"),
        F.coalesce(F.sum(F.col("_np") - F.col("_nn")), F.lit(0)).cast("long").alias("null_predictions"),
    ]


def _none_of(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.col(c) == 0)
    return out


def evaluate_regression(
    targets: DataFrame, preds: DataFrame, group_cols: Sequence[str] = (),
    id_col: str = "id", pred_col: str = "p", label_col: str = "y",
) -> DataFrame:
    """F10 for a submission: M1's counts, ``valid`` and the regression metrics of each group.

    Extra predictions belong to no target, so with groups they form a row of their
    own whose group is null.  The matched rows are written once; counts and metrics
    come from one aggregate.
    """
    groups = list(group_cols)
    keep = targets.select(id_col, label_col, *groups)
    rows = materialize(matched(keep, preds.select(id_col, pred_col), id_col, pred_col), "matched-predictions")
    made = _regression_stats(rows, rows.where("_t = 1"), pred_col, label_col, groups, _problem_counts(), F.count("_t"))
    return _where_valid(made, groups, REGRESSION_METRICS)


def evaluate_classification(
    targets: DataFrame, preds: DataFrame, group_cols: Sequence[str] = (),
    id_col: str = "id", pred_col: str = "p", label_col: str = "y",
) -> DataFrame:
    """F10 for a submission: M1's counts, ``valid`` and the classification metrics of each group.

    One pass: the counts of problems travel with the confusion counts.
    """
    groups = list(group_cols)
    keep = targets.select(id_col, label_col, *groups)
    rows = matched(keep, preds.select(id_col, pred_col), id_col, pred_col)
    confusion = rows.groupBy(*groups, F.col(label_col).alias("y"), F.col(pred_col).alias("p")).agg(
        F.count("_t").alias("n"), *_problem_counts()
    )
    return _where_valid(_classification_stats(confusion, groups, PROBLEMS), groups, CLASSIFICATION_METRICS)


def _where_valid(made: DataFrame, groups: list[str], names: Sequence[str]) -> DataFrame:
    """``valid`` per group, with the metrics where valid (null elsewhere)."""
    made = made.withColumn("valid", (F.col("n") > 0) & _none_of(PROBLEMS))
    return made.select(*groups, "valid", "n", *PROBLEMS, *[F.when(F.col("valid"), F.col(m)).alias(m) for m in names])


def _ratio(num: Column, den: Column, default: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), default)


def regression_metrics(
    df: DataFrame,
    pred_col: str = "p",
    label_col: str = "y",
    group_cols: Sequence[str] = (),
    materialize_input: bool = True,
) -> DataFrame:
    """One row per group with n, spearman, pearson, mse, mae, rmse, r2.

    Spearman = Pearson of average-tie ranks (P1); constant input gives 0.  It comes
    from whole-number sums of doubled ranks, so equal rankings have equal scores to
    the last bit, whatever the order of the rows or the number of partitions.
    Pearson on constant input is NaN.  Every row counts in n; a group in which a
    prediction or label is null has null metrics, as it can't be scored whole.
    """
    groups = list(group_cols)
    base = df.select(*groups, F.col(pred_col).cast("double").alias(pred_col), F.col(label_col).cast("double").alias(label_col))
    if materialize_input:
        # base feeds the rank table and the final join
        base = materialize(base, "aligned-predictions")
    made = _regression_stats(base, base, pred_col, label_col, groups, [], F.count(F.lit(1)))
    return made.select(*groups, "n", *REGRESSION_METRICS)


def trial_spearman(preds: DataFrame, k: int) -> DataFrame:
    """F3 of every trial and split at once: (trial, split, score), as ``regression_metrics`` gives it.

    ``preds`` (stored) has trial, split (below ``k``), y and p; a split's labels are the
    same in each of its trials, so they are ranked once, and a prediction's rank meets
    only the sum of the label ranks of its equals.
    """
    rows = preds.select("trial", "split", F.col("y").cast("double").alias("y"), F.col("p").cast("double").alias("p"))
    first = rows.agg(F.min("trial")).first()[0]
    labels = doubled_ranks(rows.where(F.col("trial") == F.lit(first)), ["y"], ["split"]).select(
        F.col("split").alias("_s"), F.col("value").alias("_v"), F.col("rank2").alias("_ry")
    )
    known = rows.join(labels, (F.col("split") == F.col("_s")) & F.col("y").eqNullSafe(F.col("_v")))
    equals = known.groupBy((F.col("trial") * k + F.col("split")).cast("int").alias("g"), "p").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("_ry").alias("ry")
    )
    own = known.where(F.col("trial") == F.lit(first)).groupBy("split").agg(
        F.sum(F.col("_ry").cast("decimal(19,0)") * F.col("_ry").cast("decimal(19,0)")).alias("yy"), F.count("y").alias("labelled")
    )
    sums = rank_sums(equals, "g", "p", "cnt", "ry").withColumn("split", F.expr(f"g % {k}").cast("int")).join(F.broadcast(own), "split")
    centre = F.col("n").cast("decimal(12,0)") * (F.col("n") + 1).cast("decimal(13,0)") * (F.col("n") + 1).cast("decimal(13,0)")
    about = lambda c: (F.col(c).cast("decimal(38,0)") - centre).cast("double")
    score = _ratio(about("xy"), F.sqrt(about("xx") * about("yy")), F.lit(0.0))
    whole = (F.col("valued") == F.col("n")) & (F.col("labelled") == F.col("n"))
    return sums.select(F.expr(f"g div {k}").cast("int").alias("trial"), "split", F.when(whole, score).alias("score"))


def _regression_stats(
    rows: DataFrame, ranked_rows: DataFrame, pred_col: str, label_col: str, groups: list[str], more: list[Column], n: Column
) -> DataFrame:
    """n, ``more`` and the regression metrics per group of ``rows``; ranks are those among ``ranked_rows``."""
    as_double = lambda d: d.withColumn("_p", F.col(pred_col).cast("double")).withColumn("_y", F.col(label_col).cast("double"))
    cur = as_double(rows)
    ranks = doubled_ranks(as_double(ranked_rows), ["_y", "_p"], groups)
    for column, (c, r) in enumerate((("_y", "_ry"), ("_p", "_rp"))):
        one = ranks.where(F.col("column") == column).select(
            *[F.col(g).alias(f"_k_{g}") for g in groups], F.col("value").alias(f"_k_{c}"), F.col("rank2").cast("decimal(19,0)").alias(r)
        )
        on = F.lit(True)
        for x in (*groups, c):
            on = on & cur[x].eqNullSafe(one[f"_k_{x}"])
        cur = cur.join(one, on, "left").drop(*[f"_k_{x}" for x in (*groups, c)])
    err = F.col("_p") - F.col("_y")
    stats = cur.groupBy(*groups).agg(
        n.alias("n"),
        *more,
        F.count(F.when(F.col("_p").isNotNull() & F.col("_y").isNotNull(), 1)).alias("_whole"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_ss_res"),
        F.var_pop("_y").alias("_var_y"),
        F.covar_pop("_p", "_y").alias("_cov"),
        F.stddev_pop("_p").alias("_sp"),
        F.stddev_pop("_y").alias("_sy"),
        F.sum(F.col("_rp") * F.col("_ry")).alias("_r_py"),
        F.sum(F.col("_rp") * F.col("_rp")).alias("_r_pp"),
        F.sum(F.col("_ry") * F.col("_ry")).alias("_r_yy"),
    )
    # doubled ranks have the mean n + 1; whole numbers below 10^38 up to 10^12 rows a group
    whole_n, next_n = F.col("n").cast("decimal(12,0)"), (F.col("n") + 1).cast("decimal(13,0)")
    centre = whole_n * next_n * next_n
    about = lambda c: (F.col(c) - centre).cast("double")
    nan = F.lit(float("nan"))
    made = {
        "spearman": _ratio(about("_r_py"), F.sqrt(about("_r_pp") * about("_r_yy")), F.lit(0.0)),
        "pearson": _ratio(F.col("_cov"), F.col("_sp") * F.col("_sy"), nan),
        "mse": F.col("mse"),
        "mae": F.col("mae"),
        "rmse": F.sqrt("mse"),
        "r2": F.lit(1.0) - _ratio(F.col("_ss_res"), F.col("_var_y") * F.col("n"), nan),
    }
    whole = (F.col("_whole") == F.col("n")) & (F.col("n") > 0)
    kept = [c for c in stats.columns if not c.startswith("_") and c not in made]
    return stats.select(*kept, *[F.when(whole, v).alias(k) for k, v in made.items()])


def confusion_counts(df: DataFrame, pred_col: str = "p", label_col: str = "y", group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., y, p) -> n.  Partial aggregation makes a hot class cheap."""
    return df.groupBy(*group_cols, F.col(label_col).alias("y"), F.col(pred_col).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _per_class(confusion: DataFrame, groups: list[str], carry: Sequence[str]) -> DataFrame:
    """Support, predicted and tp of each class in one pass; ``carry`` columns are added up too."""
    zero = F.lit(0).cast("long")
    as_truth = F.struct(
        F.col("y").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"),
        F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero).alias("tp"), *[F.col(c).alias(c) for c in carry],
    )
    as_pred = F.struct(
        F.col("p").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp"),
        *[zero.alias(c) for c in carry],
    )
    names = ["support", "predicted", "tp", *carry]
    return confusion.select(*groups, F.inline(F.array(as_truth, as_pred))).groupBy(*groups, "cls").agg(
        *[F.sum(c).alias(c) for c in names]
    )


def per_class_prf(confusion: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """per class in the union of true and predicted labels: support, predicted, tp, P, R, F1."""
    groups = list(group_cols)
    per = _per_class(confusion, groups, [])
    zero = F.lit(0.0)
    return per.select(
        *groups,
        "cls",
        "support",
        "predicted",
        "tp",
        _ratio(F.col("tp"), F.col("predicted"), zero).alias("precision"),
        _ratio(F.col("tp"), F.col("support"), zero).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"), zero).alias("f1"),
    )


def classification_metrics(
    df: DataFrame, pred_col: str = "p", label_col: str = "y", group_cols: Sequence[str] = ()
) -> DataFrame:
    """One row per group: n, f1_macro, f1_weighted, accuracy, precision_macro, recall_macro.

    A group with a null label or prediction has null metrics.
    """
    groups = list(group_cols)
    made = _classification_stats(confusion_counts(df, pred_col, label_col, groups), groups, [])
    return made.select(*groups, "n", *CLASSIFICATION_METRICS)


def _classification_stats(confusion: DataFrame, groups: list[str], carry: Sequence[str]) -> DataFrame:
    zero = F.lit(0.0)
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    f1 = _ratio(2 * tp, support + predicted, zero)
    agg = _per_class(confusion, groups, carry).groupBy(*groups).agg(
        F.sum("support").alias("n"),
        *[F.sum(c).alias(c) for c in carry],
        F.count(F.when(F.col("cls").isNull(), 1)).alias("_nulls"),
        F.avg(f1).alias("f1_macro"),
        F.sum(f1 * support).alias("_f1w"),
        F.sum("tp").alias("_tp"),
        F.avg(_ratio(tp, predicted, zero)).alias("precision_macro"),
        F.avg(_ratio(tp, support, zero)).alias("recall_macro"),
    )
    made = {
        "f1_macro": F.col("f1_macro"),
        "f1_weighted": _ratio(F.col("_f1w"), F.col("n"), zero),
        "accuracy": _ratio(F.col("_tp"), F.col("n"), zero),
        "precision_macro": F.col("precision_macro"),
        "recall_macro": F.col("recall_macro"),
    }
    whole = F.col("_nulls") == 0
    return agg.select(*groups, "n", *carry, *[F.when(whole, v).alias(k) for k, v in made.items()])


def cv_scores(split_metrics: DataFrame, metric: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """mean of the primary metric over splits (NaN counted as 0, as in CV)."""
    v = F.when(F.isnan(F.col(metric)) | F.col(metric).isNull(), F.lit(0.0)).otherwise(F.col(metric))
    return split_metrics.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_splits"), F.avg(v).alias("cv_score")
    )


def validate_predictions(targets: DataFrame, preds: DataFrame, id_col: str = "id", pred_col: str = "p") -> DataFrame:
    """M1: one row of alignment counts; ``valid`` when every target has exactly one non-null prediction."""
    rows = matched(targets.select(id_col), preds.select(id_col, pred_col), id_col, pred_col)
    out = rows.agg(
        F.count("_t").alias("n_targets"),
        F.coalesce(F.sum("_np"), F.lit(0)).cast("long").alias("n_predictions"),
        *_problem_counts(),
    )
    return out.withColumn("valid", _none_of(PROBLEMS))


def offending_ids(targets: DataFrame, preds: DataFrame, id_col: str = "id") -> DataFrame:
    """M1 detail: ids that are missing, extra or duplicated (anti-joins + count>1)."""
    t_ids = targets.select(id_col)
    p_counts = preds.groupBy(id_col).agg(F.count(F.lit(1)).alias("_np"))
    missing = t_ids.join(p_counts, id_col, "left_anti").withColumn("problem", F.lit("missing"))
    extra = p_counts.select(id_col).join(t_ids, id_col, "left_anti").withColumn("problem", F.lit("extra"))
    dup = p_counts.where(F.col("_np") > 1).select(id_col).withColumn("problem", F.lit("duplicate"))
    return missing.unionByName(extra).unionByName(dup)
