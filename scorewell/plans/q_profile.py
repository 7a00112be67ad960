"""Queries for sources, splits, role inference and profiling: A1, A3, A7, B2-B10."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from scorewell.operators import profile as P
from scorewell.plans import views as V
from scorewell.plans.catalog import register
from scorewell.sources.tables import drop_label_export, fold_split, matrix_features, read_table

SEQ = V.with_views("seq")
TAB = V.with_views("tab")


@register("read_table", SEQ + "select * from seq")
def read_table_query(spark, sf_dir):
    """A1: the sequence table (projection pushed into the scan)."""
    return V.seq(spark, sf_dir)


@register(
    "fold_split",
    SEQ
    + """
select case when fold_id = 0 then 'test' else 'train' end as role, cast(count(*) as bigint) as n,
       cast(sum(row_id) as bigint) as id_sum
from seq group by 1
""",
)
def fold_split_query(spark, sf_dir):
    """A3 with k = 0: test = fold 0, train = the rest (both sides counted)."""
    train, test = fold_split(V.seq(spark, sf_dir), 0)
    side = lambda df, role: df.agg(
        F.lit(role).alias("role"), F.count(F.lit(1)).cast("long").alias("n"), F.sum("row_id").cast("long").alias("id_sum")
    )
    return side(train, "train").unionByName(side(test, "test"))


@register("drop_label_export", SEQ + "select row_id, sequence, fold_id from seq where fold_id = 0")
def drop_label_export_query(spark, sf_dir):
    """Test rows of fold 0 without the label column."""
    _, test = fold_split(V.seq(spark, sf_dir), 0)
    return drop_label_export(test, "labels")


@register(
    "detect_obs_label_col",
    """
select 's_suppkey' as column_name, false as categorical, count(distinct s_suppkey) < 50 as below_limit from supplier
union all select 's_name', true, count(distinct s_name) < 50 from supplier
union all select 's_nationkey', false, count(distinct s_nationkey) < 50 from supplier
union all select 's_acctbal', false, count(distinct s_acctbal) < 50 from supplier
""",
)
def detect_obs_label_col_query(spark, sf_dir):
    """B2 fallback on an obs-like table without label-named columns."""
    return P.obs_distinct_flags(read_table(spark, sf_dir, "supplier"))


def _task(df, name, label):
    return P.task_type_stats(df, label).select(
        F.lit(name).alias("dataset"),
        F.col("n_distinct_non_nan").cast("long").alias("n_distinct_non_nan"),
        F.col("n_distinct").cast("long").alias("n_distinct"),
        "task_type",
    )


@register(
    "infer_task_type",
    V.with_views("seq", "tab", "cells")
    + """
select 'seq' as dataset, cast(count(distinct labels) filter (where not isnan(labels)) as bigint) as n_distinct_non_nan,
       cast(count(distinct labels) as bigint) as n_distinct,
       case when count(distinct labels) filter (where not isnan(labels)) > 20 then 'regression'
            when count(distinct labels) <= 30 then 'classification' else 'regression' end as task_type from seq
union all
select 'tab_label', count(distinct label), count(distinct label),
       case when count(distinct label) <= 30 then 'classification' else 'regression' end from tab
union all
select 'tab_nlines', count(distinct n_lines), count(distinct n_lines),
       case when count(distinct n_lines) > 20 then 'regression'
            when count(distinct n_lines) <= 30 then 'classification' else 'regression' end from tab
union all
select 'cells', count(distinct label), count(distinct label),
       case when count(distinct label) <= 30 then 'classification' else 'regression' end from cells
""",
)
def infer_task_type_query(spark, sf_dir):
    """B5 on four labels: float many-valued, string, float few-valued, int."""
    t = V.tab(spark, sf_dir)
    parts = [
        _task(V.seq(spark, sf_dir), "seq", "labels"),
        _task(t, "tab_label", "label"),
        _task(t, "tab_nlines", "n_lines"),
        _task(V.cells(spark, sf_dir), "cells", "label"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register(
    "class_distribution",
    TAB + "select label, cast(count(*) as bigint) as count from tab group by label",
)
def class_distribution_query(spark, sf_dir):
    """B6 on the tabular classification label."""
    d = P.class_distribution(V.tab(spark, sf_dir), "label")
    return d.select("label", F.col("count").cast("long").alias("count"))


@register(
    "label_stats",
    SEQ
    + """
select round(avg(labels), 6) as mean, round(stddev_pop(labels), 6) as std, min(labels) as min, max(labels) as max
from seq where fold_id <> 0 and not isnan(labels)
""",
)
def label_stats_query(spark, sf_dir):
    """B7 on the training side of the sequence table."""
    train, _ = fold_split(V.seq(spark, sf_dir), 0)
    s = P.label_stats(train, "labels")
    return s.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@register(
    "seq_len_stats",
    SEQ
    + """
select cast(min(length(sequence)) as bigint) as seq_len_min, cast(max(length(sequence)) as bigint) as seq_len_max,
       round(avg(length(sequence)), 6) as seq_len_mean from seq where fold_id <> 0
""",
)
def seq_len_stats_query(spark, sf_dir):
    """B8 on the training side."""
    train, _ = fold_split(V.seq(spark, sf_dir), 0)
    s = P.seq_len_stats(train, "sequence")
    return s.withColumn("seq_len_mean", F.round("seq_len_mean", 6))


PROFILE_COLS = [
    "data_type",
    "task_type",
    "train_samples",
    "test_samples",
    "n_features",
    "n_classes",
    "label_column",
    "sequence_column",
    "label_mean",
    "label_std",
    "label_min",
    "label_max",
    "seq_len_min",
    "seq_len_max",
    "seq_len_mean",
]


@register(
    "profile_dataset",
    V.with_views("seq", "tab")
    + """
select 'dataframe_sequence' as data_type, 'regression' as task_type,
       cast(count(*) filter (where fold_id <> 0) as bigint) as train_samples,
       cast(count(*) filter (where fold_id = 0) as bigint) as test_samples,
       cast(null as bigint) as n_features, cast(null as bigint) as n_classes,
       'labels' as label_column, 'sequence' as sequence_column,
       round(avg(labels) filter (where fold_id <> 0), 6) as label_mean,
       round(stddev_pop(labels) filter (where fold_id <> 0), 6) as label_std,
       min(labels) filter (where fold_id <> 0) as label_min, max(labels) filter (where fold_id <> 0) as label_max,
       cast(min(length(sequence)) filter (where fold_id <> 0) as bigint) as seq_len_min,
       cast(max(length(sequence)) filter (where fold_id <> 0) as bigint) as seq_len_max,
       round(avg(length(sequence)) filter (where fold_id <> 0), 6) as seq_len_mean
from seq
union all
select 'dataframe_tabular', 'classification',
       cast(count(*) filter (where fold_id <> 0) as bigint), cast(count(*) filter (where fold_id = 0) as bigint),
       cast(5 as bigint), cast(count(distinct label) filter (where fold_id <> 0) as bigint),
       'label', null, null, null, null, null, null, null, null
from tab
""",
)
def profile_dataset_query(spark, sf_dir):
    """B9 for the sequence table and the tabular table (classification label; train = fold != 0)."""
    seq_tr, seq_te = fold_split(V.seq(spark, sf_dir), 0)
    tab_tr, tab_te = fold_split(V.tab(spark, sf_dir).drop("target"), 0)

    def shape(df):
        return df.select(
            *[F.round(c, 6).alias(c) if c in ("label_mean", "label_std", "seq_len_mean") else F.col(c) for c in PROFILE_COLS]
        )

    seq_p = P.profile_dataset(seq_tr, seq_te, id_cols=("row_id",))
    tab_p = P.profile_dataset(tab_tr, tab_te, id_cols=("row_id",))
    return shape(seq_p).unionByName(shape(tab_p))


@register(
    "label_histogram",
    SEQ
    + """
, r as (select min(labels) as lo, max(labels) as hi from seq where not isnan(labels))
, b as (select cast(least(floor((labels - lo) / ((hi - lo) / 10)), 9) as integer) as bin, lo, (hi - lo) / 10 as w
        from seq, r where not isnan(labels))
select bin, round(min(lo) + bin * min(w), 6) as bin_start, cast(count(*) as bigint) as count from b group by bin
""",
)
def label_histogram_query(spark, sf_dir):
    """Ten equal-width label bins of the sequence table."""
    h = P.label_histogram(V.seq(spark, sf_dir), "labels", 10)
    return h.select("bin", F.round("bin_start", 6).alias("bin_start"), F.col("count").cast("long").alias("count"))


MATRIX_VIEWS = V.with_views("expr_coo", "cells")


@register(
    "profile_matrix",
    MATRIX_VIEWS
    + """
, tr as (select * from cells where cell_id % 10 <> 0)
, d as (select cast(label as varchar) as label, count(*) as n from tr group by 1)
select 'anndata' as data_type, 'classification' as task_type, (select cast(count(*) as bigint) from tr) as train_samples,
       (select cast(count(*) as bigint) from cells where cell_id % 10 = 0) as test_samples,
       (select cast(count(distinct gene) as bigint) from expr_coo) as n_features, cast(count(*) as bigint) as n_classes,
       'label' as label_column, string_agg(label || '=' || n, ',' order by label) as classes from d
""",
)
def profile_matrix_query(spark, sf_dir):
    """B9 for cell-by-gene data; the class map as text."""
    cells = V.cells(spark, sf_dir)
    train, test = cells.where(F.col("cell_id") % 10 != 0), cells.where(F.col("cell_id") % 10 == 0)
    row = P.profile_matrix(train, test, V.expr_coo(spark, sf_dir).select("gene").distinct())
    entries = F.sort_array(F.map_entries("class_distribution"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return row.select(
        "data_type", "task_type", *[F.col(c).cast("long").alias(c) for c in ("train_samples", "test_samples", "n_features", "n_classes")],
        "label_column", text.alias("classes"),
    )


@register(
    "drop_label_matrix",
    MATRIX_VIEWS + "select cell_id, gene, round(value, 4) as value from expr_coo join cells using (cell_id) where cell_id % 10 = 0",
)
def drop_label_matrix(spark, sf_dir):
    """A7 for cell-by-gene data: the test cells' counts without any observation column."""
    labelled = V.expr_coo(spark, sf_dir).join(V.cells(spark, sf_dir), "cell_id").where(F.col("cell_id") % 10 == 0)
    return matrix_features(labelled).withColumn("value", F.round("value", 4))
