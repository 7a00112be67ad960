"""Stand-in datasets derived from the given tables.

Each function returns a lazily-defined DataFrame over ``sf_dir``; the same
definitions exist as SQL text (``SQL_VIEWS``) so the DuckDB oracle can rebuild
them.  Fixed definitions (column choice, modulo fold ids, prediction formula)
follow FIXTURES.md §2.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewell.sources.tables import dealt, read_table


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence-regression table: short text, float label, fold 0-9."""
    return dealt(read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_retailprice"])).select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("sequence"),
        F.col("p_retailprice").alias("labels"),
        (F.col("p_partkey") % 10).cast("int").alias("fold_id"),
    )


def expr_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell x gene counts in long (COO) form: supplier x brand quantity."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_partkey", "l_quantity"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy(F.col("l_suppkey").alias("cell_id"), F.col("p_brand").alias("gene"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell observations with a class label."""
    return read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"]).select(
        F.col("s_suppkey").alias("cell_id"),
        (F.col("s_nationkey") % 3).cast("int").alias("label"),
    )


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense embedding vectors with a 10-class label."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        array_to_vector(F.col("embedding")).alias("features"),
        F.col("label").cast("int").alias("label"),
        (F.col("vec_id") % 10).cast("int").alias("fold_id"),
    )


TAB_FEATURES = ["n_lines", "sum_qty", "avg_price", "avg_disc", "avg_tax"]


def tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic tabular frame: one row per order, numeric features, two labels."""
    li = read_table(
        spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    )
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.sum("l_quantity").alias("sum_qty"),
        F.avg("l_extendedprice").alias("avg_price"),
        F.avg("l_discount").alias("avg_disc"),
        F.avg("l_tax").alias("avg_tax"),
    )
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return orders.join(per_order, orders.o_orderkey == per_order.l_orderkey).select(
        F.col("o_orderkey").alias("row_id"),
        *TAB_FEATURES,
        F.col("o_orderstatus").alias("label"),
        F.col("o_totalprice").alias("target"),
        (F.col("o_orderkey") % 10).cast("int").alias("fold_id"),
    )


def reg_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("y"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"),
    )


def reg_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]).select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") * F.lit(0.9) + (F.col("o_orderkey") % 97) * 100).alias("p"),
    )


def cls_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"]).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("y"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"),
    )


def cls_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    return read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"]).select(
        F.col("o_orderkey").alias("id"),
        F.when(k == 0, F.col("o_orderpriority"))
        .when(k == 1, F.lit("3-MEDIUM"))
        .otherwise(F.lit("9-UNSEEN"))
        .alias("p"),
    )


def iso_timestamp(c: str):
    """ISO-8601 text (microseconds) of a TIMESTAMP_NTZ column, built from its fields so
    the session time zone never enters (no DST gap or overlap shifts)."""
    ts = F.col(c)
    micros = (F.date_part(F.lit("SECOND"), ts) * 1000000).cast("long") % 1000000
    return F.format_string(
        "%04d-%02d-%02dT%02d:%02d:%02d.%06d",
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts), micros,
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission records: one per event; metrics = spearman (primary) and mse."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        iso_timestamp("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("user"),
        F.col("event_type").alias("dataset"),
        (F.col("user_id") % 3).cast("string").alias("fold"),
        F.lit("spearman").alias("primary_metric"),
        F.create_map(
            F.lit("spearman"),
            F.col("value"),
            F.lit("mse"),
            F.get_json_object("props", "$.k").cast("double"),
        ).alias("metrics"),
        F.col("event_id").cast("string").alias("name"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("description"),
    )


# --- the same views as DuckDB SQL (CTE bodies) -----------------------------

SQL_VIEWS = {
    "seq": "select p_partkey as row_id, p_name as sequence, p_retailprice as labels, "
    "cast(p_partkey % 10 as integer) as fold_id from part",
    "expr_coo": "select l_suppkey as cell_id, p_brand as gene, sum(l_quantity) as value "
    "from lineitem join part on l_partkey = p_partkey group by l_suppkey, p_brand",
    "cells": "select s_suppkey as cell_id, cast(s_nationkey % 3 as integer) as label from supplier",
    "tab": "select o_orderkey as row_id, n_lines, sum_qty, avg_price, avg_disc, avg_tax, "
    "o_orderstatus as label, o_totalprice as target, cast(o_orderkey % 10 as integer) as fold_id "
    "from orders join (select l_orderkey, cast(count(*) as double) as n_lines, sum(l_quantity) as sum_qty, "
    "avg(l_extendedprice) as avg_price, avg(l_discount) as avg_disc, avg(l_tax) as avg_tax "
    "from lineitem group by l_orderkey) li on o_orderkey = l_orderkey",
    "reg_targets": "select o_orderkey as id, o_totalprice as y, cast(o_orderkey % 5 as integer) as fold from orders",
    "reg_predictions": "select o_orderkey as id, o_totalprice * 0.9 + (o_orderkey % 97) * 100 as p from orders",
    "cls_targets": "select o_orderkey as id, o_orderpriority as y, cast(o_orderkey % 5 as integer) as fold from orders",
    "cls_predictions": "select o_orderkey as id, case when o_orderkey % 3 = 0 then o_orderpriority "
    "when o_orderkey % 3 = 1 then '3-MEDIUM' else '9-UNSEEN' end as p from orders",
    "submissions": "select strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as timestamp, cast(user_id as varchar) as \"user\", "
    "event_type as dataset, cast(user_id % 3 as varchar) as fold, 'spearman' as primary_metric, "
    "value as m_spearman, cast(json_extract_string(props, '$.k') as double) as m_mse, "
    "cast(event_id as varchar) as name, 'event ' || cast(event_id as varchar) as description from events",
}


def with_views(*names: str) -> str:
    """``WITH`` prefix defining the named stand-in views for an oracle query."""
    return "with " + ",\n".join(f"{n} as ({SQL_VIEWS[n]})" for n in names) + "\n"
