"""Queries for folds (D1-D4), selection (G5, G6, G10, G11) and ensembling."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewell.operators import folds as FO
from scorewell.operators import selection as SE
from scorewell.plans import views as V
from scorewell.plans.catalog import register
from scorewell.sources.tables import read_table

SEQ = V.with_views("seq")
HASH = "md5(concat_ws('|', cast({id} as varchar), '42'))"


@register(
    "kfold",
    SEQ
    + f"select row_id, cast((row_number() over (order by {HASH.format(id='row_id')}, row_id) - 1) % 3 as integer) as cv_fold from seq",
)
def kfold_query(spark, sf_dir):
    """3 shuffled folds (seed 42) over every sequence row."""
    return FO.kfold(V.seq(spark, sf_dir).select("row_id"), "row_id", 3, 42)


@register(
    "stratified_kfold",
    f"""
select doc_id, quality,
       cast((row_number() over (partition by quality order by {HASH.format(id='doc_id')}, doc_id) - 1) % 3 as integer) as cv_fold
from labels
""",
)
def stratified_kfold_query(spark, sf_dir):
    """D3: per-class 3 folds (seed 42) of the quality label."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    return FO.stratified_kfold(lab, "doc_id", "quality", 3, 42)


@register(
    "adaptive_splits",
    V.with_views("cells", "tab")
    + """
, m as (select 'cells' as dataset, min(c) as mc from (select label, count(*) as c from cells group by label) x
        union all select 'tab', min(c) from (select label, count(*) as c from tab group by label) y)
select dataset, cast(mc as bigint) as min_class_count,
       cast(case when mc >= 2 then least(3, mc) else 2 end as integer) as n_splits from m
""",
)
def adaptive_splits_query(spark, sf_dir):
    """D4 on two class labels."""
    a = FO.adaptive_splits_frame(V.cells(spark, sf_dir), "label").select(F.lit("cells").alias("dataset"), "*")
    b = FO.adaptive_splits_frame(V.tab(spark, sf_dir), "label").select(F.lit("tab").alias("dataset"), "*")
    out = a.unionByName(b)
    return out.select("dataset", F.col("min_class_count").cast("long").alias("min_class_count"), "n_splits")


@register(
    "inner_folds_by_column",
    SEQ
    + """
, v as (select fold_id as v, cast(row_number() over (order by fold_id) - 1 as integer) as split
        from (select distinct fold_id from seq) d order by fold_id limit 3)
select split, case when fold_id = v then 'val' else 'train' end as role,
       cast(count(*) as bigint) as n, cast(sum(row_id) as bigint) as id_sum
from seq, v group by split, role
""",
)
def inner_folds_by_column_query(spark, sf_dir):
    """Three splits validating on each of the first three fold ids."""
    s = V.seq(spark, sf_dir)
    vals = FO.inner_folds_by_column(s, "fold_id")
    roles = FO.split_roles(s, "fold_id", vals)
    return roles.groupBy("split", "role").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.sum("row_id").cast("long").alias("id_sum")
    )


def _trials(spark, sf_dir):
    """Trials: experiment = event type, run order = event id, score = value."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type", "value"])
    return ev.select(
        F.col("event_type").alias("experiment"), F.col("event_id").alias("ordinal"), F.col("value").alias("value")
    )


def _experiments(spark, sf_dir):
    """Experiments: first run ordinal, mean score over its trials."""
    return _trials(spark, sf_dir).groupBy("experiment").agg(
        F.min("ordinal").alias("ordinal"), F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("n")
    )


EXP_SQL = """
with exps as (select event_type as experiment, min(event_id) as ordinal, round(avg(value), 6) as value, count(*) as n
              from events group by event_type)
"""


@register(
    "best_trial",
    """
select experiment, ordinal, value, cast(n_trials as bigint) as n_trials from (
  select event_type as experiment, event_id as ordinal, value,
         row_number() over (partition by event_type order by value desc, event_id) as rn,
         count(*) over (partition by event_type) as n_trials from events) t where rn = 1
""",
)
def best_trial_query(spark, sf_dir):
    """G5 per experiment: best trial, first wins ties."""
    b = SE.best_trial(_trials(spark, sf_dir))
    return b.withColumn("n_trials", F.col("n_trials").cast("long"))


@register(
    "select_best",
    EXP_SQL + "select experiment, ordinal, value from exps order by value desc, ordinal limit 1",
)
def select_best_query(spark, sf_dir):
    """G5 over experiments."""
    return SE.select_best(_experiments(spark, sf_dir)).select("experiment", "ordinal", "value")


@register(
    "top_k_experiments",
    EXP_SQL + "select experiment, ordinal, value from exps order by value desc, ordinal limit 2",
)
def top_k_experiments_query(spark, sf_dir):
    """The two best experiments."""
    return SE.top_k_experiments(_experiments(spark, sf_dir), 2).select("experiment", "ordinal", "value")


@register(
    "experiments_table",
    EXP_SQL + "select experiment, ordinal, value, cast(n as bigint) as n from exps order by ordinal",
)
def experiments_table_query(spark, sf_dir):
    """G10."""
    return SE.experiments_table(_experiments(spark, sf_dir)).withColumn("n", F.col("n").cast("long"))


@register(
    "beats_baseline",
    EXP_SQL
    + """
select experiment, ordinal, value, (select value from exps order by ordinal limit 1) as baseline_value,
       value > (select value from exps order by ordinal limit 1) as beats_baseline
from exps
""",
)
def beats_baseline_query(spark, sf_dir):
    """Every experiment against the first-run baseline."""
    b = SE.beats_baseline(_experiments(spark, sf_dir))
    return b.select("experiment", "ordinal", "value", "baseline_value", "beats_baseline")


@register(
    "ensemble_mean",
    """
with m as (select o_orderkey as id, o_totalprice * 0.9 + (o_orderkey % 97) * 100 as p from orders
           union all select o_orderkey, o_totalprice * 1.1 - (o_orderkey % 89) * 50 from orders)
select id, round(avg(p), 4) as p, cast(count(*) as bigint) as n_members from m group by id
""",
)
def ensemble_mean_query(spark, sf_dir):
    """Mean of two regression members per order."""
    a = V.reg_predictions(spark, sf_dir)
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])
    b = o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") * F.lit(1.1) - (F.col("o_orderkey") % 89) * 50).alias("p"),
    )
    e = SE.ensemble_mean(a.unionByName(b))
    return e.select("id", F.round("p", 4).alias("p"), F.col("n_members").cast("long").alias("n_members"))


@register(
    "ensemble_vote",
    V.with_views("cls_predictions")
    + """
, m as (select id, p from cls_predictions
        union all select o_orderkey, case when o_orderkey % 2 = 0 then o_orderpriority else '2-HIGH' end from orders)
, v as (select id, p, count(*) as n from m group by id, p)
select id, p, cast(n_members as bigint) as n_members from (
  select id, p, sum(n) over (partition by id) as n_members,
         row_number() over (partition by id order by n desc, p) as rn from v) t where rn = 1
""",
)
def ensemble_vote_query(spark, sf_dir):
    """Majority of two class members per order (ties -> smallest label)."""
    a = V.cls_predictions(spark, sf_dir)
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"])
    b = o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lit("2-HIGH")).alias("p"),
    )
    e = SE.ensemble_vote(a.unionByName(b))
    return e.select("id", "p", F.col("n_members").cast("long").alias("n_members"))
