"""Queries for scoring: F1-F11, P1, M1."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewell.operators import metrics as M
from scorewell.operators.rank import avg_rank
from scorewell.plans import views as V
from scorewell.plans.catalog import register
from scorewell.sources.tables import read_table

R6 = 6


def _reg_joined(spark, sf_dir):
    return M.matched(V.reg_targets(spark, sf_dir), V.reg_predictions(spark, sf_dir)).where("_t = 1")


def _cls_joined(spark, sf_dir):
    return M.matched(V.cls_targets(spark, sf_dir), V.cls_predictions(spark, sf_dir)).where("_t = 1")


def _round_reg(df, keys):
    return df.select(
        *keys,
        F.col("n").cast("long").alias("n"),
        F.round("spearman", R6).alias("spearman"),
        F.round("pearson", R6).alias("pearson"),
        F.round("mse", 2).alias("mse"),
        F.round("mae", 4).alias("mae"),
        F.round("rmse", 4).alias("rmse"),
        F.round("r2", R6).alias("r2"),
    )


REG_SQL_BODY = """
, j as (select t.fold, t.id, t.y, p.p from reg_targets t join reg_predictions p on t.id = p.id)
, r as (
  select fold, y, p,
         rank() over (partition by fold order by y) + (count(*) over (partition by fold, y) - 1) / 2.0 as ry,
         rank() over (partition by fold order by p) + (count(*) over (partition by fold, p) - 1) / 2.0 as rp
  from j)
, s as (
  select fold, count(*) as n, avg((p - y) * (p - y)) as mse, avg(abs(p - y)) as mae,
         sum((p - y) * (p - y)) as ss_res, var_pop(y) as var_y,
         covar_pop(p, y) as cov, stddev_pop(p) as sp, stddev_pop(y) as sy,
         covar_pop(rp, ry) as rcov, stddev_pop(rp) as srp, stddev_pop(ry) as sry
  from r group by fold)
select fold, cast(n as bigint) as n,
       round(case when srp * sry = 0 then 0.0 else rcov / (srp * sry) end, 6) as spearman,
       round(case when sp * sy = 0 then 'nan'::double else cov / (sp * sy) end, 6) as pearson,
       round(mse, 2) as mse, round(mae, 4) as mae, round(sqrt(mse), 4) as rmse,
       round(1 - ss_res / (var_y * n), 6) as r2
from s
"""


@register("evaluate_regression", V.with_views("reg_targets", "reg_predictions").rstrip() + REG_SQL_BODY)
def evaluate_regression(spark, sf_dir):
    """F10 per fold: id join with M1's counts -> P1 ranks -> one aggregate row per fold."""
    return _round_reg(M.evaluate_regression(V.reg_targets(spark, sf_dir), V.reg_predictions(spark, sf_dir), ["fold"]), ["fold"])


INCOMPLETE_SQL = (
    V.with_views("reg_targets", "reg_predictions").rstrip()
    + """
, cut as (select id, case when id % 1000 = 3 then null else p end as p from reg_predictions
          where not (id % 5 = 1 and id % 7 = 0)
          union all select id, p from reg_predictions where id % 5 = 2 and id % 11 = 0
          union all select -id, p from reg_predictions where id % 500 = 4)
, pc as (select id, count(*) as np, count(p) as nn from cut group by id)
, j as (select t.id as tid, t.fold, pc.* from reg_targets t full outer join pc on t.id = pc.id)
, c as (select fold, count(tid) as n, count(case when np is null then 1 end) as missing,
               count(case when tid is null then 1 end) as extra, count(case when np > 1 then 1 end) as duplicate,
               coalesce(sum(np - nn), 0) as null_predictions from j group by fold)
, m as (select fold, round(avg(abs(p - y)), 4) as mae from reg_targets join cut using (id) group by fold)
select c.fold, n > 0 and missing + extra + duplicate + null_predictions = 0 as valid, cast(n as bigint) as n,
       cast(missing as bigint) as missing, cast(extra as bigint) as extra, cast(duplicate as bigint) as duplicate,
       cast(null_predictions as bigint) as null_predictions,
       case when n > 0 and missing + extra + duplicate + null_predictions = 0 then mae end as mae,
       n > 0 and missing + extra + duplicate + null_predictions = 0 as has_rank
from c left join m using (fold)
"""
)


@register("evaluate_incomplete", INCOMPLETE_SQL)
def evaluate_incomplete(spark, sf_dir):
    """F10 on a submission with missing, null, repeated and extra predictions: only whole folds have metrics."""
    p, k = V.reg_predictions(spark, sf_dir), F.col("id")
    kept = p.where(~((k % 5 == 1) & (k % 7 == 0))).withColumn("p", F.when(k % 1000 != 3, F.col("p")))
    cut = kept.union(p.where((k % 5 == 2) & (k % 11 == 0))).union(p.where(k % 500 == 4).withColumn("id", -k))
    m = M.evaluate_regression(V.reg_targets(spark, sf_dir), cut, ["fold"])
    return m.select(
        "fold", "valid", *[F.col(c).cast("long").alias(c) for c in ("n", *M.PROBLEMS)],
        F.round("mae", 4).alias("mae"), F.col("spearman").isNotNull().alias("has_rank"),
    )


@register(
    "regression_error_metrics",
    V.with_views("reg_targets", "reg_predictions")
    + """
select round(avg((p - y) * (p - y)), 2) as mse, round(avg(abs(p - y)), 4) as mae,
       round(sqrt(avg((p - y) * (p - y))), 4) as rmse,
       round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) as r2,
       round(corr(p, y), 6) as pearson
from reg_targets t join reg_predictions using (id)
""",
)
def regression_error_metrics(spark, sf_dir):
    """F1, F2, F4 over the whole table (no grouping)."""
    j = _reg_joined(spark, sf_dir)
    err = F.col("p") - F.col("y")
    s = j.agg(
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("ss"),
        F.var_pop("y").alias("vy"),
        F.count(F.lit(1)).alias("n"),
        F.covar_pop("p", "y").alias("c"),
        F.stddev_pop("p").alias("sp"),
        F.stddev_pop("y").alias("sy"),
    )
    return s.select(
        F.round("mse", 2).alias("mse"),
        F.round("mae", 4).alias("mae"),
        F.round(F.sqrt("mse"), 4).alias("rmse"),
        F.round(F.lit(1.0) - F.try_divide(F.col("ss"), F.col("vy") * F.col("n")), R6).alias("r2"),
        F.round(F.try_divide(F.col("c"), F.col("sp") * F.col("sy")), R6).alias("pearson"),
    )


@register(
    "spearman",
    V.with_views("reg_targets", "reg_predictions")
    + """
, j as (select y, p from reg_targets join reg_predictions using (id))
, r as (select rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry,
               rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rp from j)
select round(case when stddev_pop(rp) * stddev_pop(ry) = 0 then 0.0 else corr(rp, ry) end, 6) as spearman from r
""",
)
def spearman(spark, sf_dir):
    """F3 over the whole table."""
    m = M.regression_metrics(_reg_joined(spark, sf_dir))
    return m.select(F.round("spearman", R6).alias("spearman"))


@register(
    "avg_rank",
    """
select event_type, cast(sum(r * event_id) as double) as rank_dot_id, cast(count(*) as bigint) as n,
       cast(sum(r) as double) as rank_sum
from (select event_type, event_id,
             rank() over (partition by event_type order by value)
             + (count(*) over (partition by event_type, value) - 1) / 2.0 as r from events) t
group by event_type
""",
)
def avg_rank_query(spark, sf_dir):
    """P1 grouped: rank of events.value within event_type, summarised per group."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type", "value"])
    ranks = avg_rank(ev, "value", ["event_type"], "r").drop("cnt")
    j = ev.join(ranks, ["event_type", "value"])
    return j.groupBy("event_type").agg(
        F.sum(F.col("r") * F.col("event_id")).cast("double").alias("rank_dot_id"),
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sum("r").cast("double").alias("rank_sum"),
    )


@register(
    "avg_rank_global",
    """
select value, cast(count(*) as bigint) as cnt, cast(min(r) as double) as rank from (
  select value, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as r from events) x
group by value
""",
)
def avg_rank_global(spark, sf_dir):
    """P1 ungrouped: one row per distinct events.value with its average-tie rank."""
    ev = read_table(spark, sf_dir, "events", ["value"])
    return avg_rank(ev, "value", (), "rank").select(
        "value", F.col("cnt").cast("long").alias("cnt"), F.col("rank").cast("double").alias("rank")
    )


CLS_SQL_BODY = """
, j as (select t.fold, t.y, p.p from cls_targets t join cls_predictions p on t.id = p.id)
, conf as (select fold, y, p, count(*) as n from j group by fold, y, p)
, per as (
  select fold, cls, sum(support) as support, sum(predicted) as predicted, sum(tp) as tp from (
    select fold, y as cls, n as support, 0 as predicted, case when y = p then n else 0 end as tp from conf
    union all
    select fold, p as cls, 0 as support, n as predicted, 0 as tp from conf) u
  group by fold, cls)
, prf as (
  select fold, cls, support, predicted, tp,
         coalesce(tp / nullif(predicted, 0), 0) as prec,
         coalesce(tp / nullif(support, 0), 0) as rec,
         coalesce(2 * tp / nullif(support + predicted, 0), 0) as f1
  from per)
"""


@register(
    "evaluate_classification",
    V.with_views("cls_targets", "cls_predictions").rstrip()
    + CLS_SQL_BODY
    + """
select fold, cast(sum(support) as bigint) as n, round(avg(f1), 6) as f1_macro,
       round(sum(f1 * support) / sum(support), 6) as f1_weighted,
       round(sum(tp) / sum(support), 6) as accuracy,
       round(avg(prec), 6) as precision_macro, round(avg(rec), 6) as recall_macro
from prf group by fold
""",
)
def evaluate_classification(spark, sf_dir):
    """F7-F10 per fold on the id-joined class predictions."""
    m = M.evaluate_classification(V.cls_targets(spark, sf_dir), V.cls_predictions(spark, sf_dir), ["fold"])
    return m.select(
        "fold",
        F.col("n").cast("long").alias("n"),
        *[F.round(c, R6).alias(c) for c in M.CLASSIFICATION_METRICS],
    )


@register(
    "confusion_counts",
    V.with_views("cls_targets", "cls_predictions")
    + """
select t.y, p.p, cast(count(*) as bigint) as n from cls_targets t join cls_predictions p on t.id = p.id group by t.y, p.p
""",
)
def confusion_counts(spark, sf_dir):
    """F5."""
    return M.confusion_counts(_cls_joined(spark, sf_dir)).select("y", "p", F.col("n").cast("long").alias("n"))


@register(
    "per_class_prf",
    V.with_views("cls_targets", "cls_predictions").rstrip()
    + CLS_SQL_BODY.replace("t.fold, ", "0 as fold, ")
    + """
select cls, cast(support as bigint) as support, cast(predicted as bigint) as predicted, cast(tp as bigint) as tp,
       round(prec, 6) as precision, round(rec, 6) as recall, round(f1, 6) as f1 from prf
""",
)
def per_class_prf(spark, sf_dir):
    """F6 over the union of true and predicted classes (the unseen class included)."""
    per = M.per_class_prf(M.confusion_counts(_cls_joined(spark, sf_dir)))
    return per.select(
        "cls",
        F.col("support").cast("long").alias("support"),
        F.col("predicted").cast("long").alias("predicted"),
        F.col("tp").cast("long").alias("tp"),
        F.round("precision", R6).alias("precision"),
        F.round("recall", R6).alias("recall"),
        F.round("f1", R6).alias("f1"),
    )


@register(
    "cv_scores",
    V.with_views("reg_targets", "reg_predictions").rstrip()
    + REG_SQL_BODY.replace("select fold, cast(n as bigint) as n,", ", m as (select fold, cast(n as bigint) as n,")
    .rstrip()
    + ")\nselect cast(count(*) as bigint) as n_splits, round(avg(case when isnan(spearman) then 0 else spearman end), 6) as cv_score from m",
)
def cv_scores(spark, sf_dir):
    """mean primary metric over the folds (the splits)."""
    per_fold = M.regression_metrics(_reg_joined(spark, sf_dir), group_cols=["fold"])
    per_fold = per_fold.select("fold", F.round("spearman", R6).alias("spearman"))
    out = M.cv_scores(per_fold, "spearman")
    return out.select(F.col("n_splits").cast("long").alias("n_splits"), F.round("cv_score", R6).alias("cv_score"))


@register(
    "validate_predictions",
    """
with t as (select o_orderkey as id from orders),
p as (select l_orderkey as id, l_extendedprice as p from lineitem),
pc as (select id, count(*) as np, count(p) as nn from p group by id),
j as (select t.id as tid, pc.* from t full outer join pc on t.id = pc.id)
select cast(count(tid) as bigint) as n_targets, cast(coalesce(sum(np), 0) as bigint) as n_predictions,
       cast(count(case when np is null then 1 end) as bigint) as missing,
       cast(count(case when tid is null then 1 end) as bigint) as extra,
       cast(count(case when np > 1 then 1 end) as bigint) as duplicate,
       cast(coalesce(sum(np - nn), 0) as bigint) as null_predictions,
       count(case when np is null then 1 end) = 0 and count(case when tid is null then 1 end) = 0
         and count(case when np > 1 then 1 end) = 0 and coalesce(sum(np - nn), 0) = 0 as valid
from j
""",
)
def validate_predictions(spark, sf_dir):
    """M1: orders as targets, line items as (duplicated, partly missing) predictions."""
    t = read_table(spark, sf_dir, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("id"))
    p = (
        read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice"])
        .select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("p"))
    )
    return M.validate_predictions(t, p)
