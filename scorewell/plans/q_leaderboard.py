"""Queries for submissions and leaderboards: A4-A6, H1-H7."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorewell.operators import leaderboard as L
from scorewell.plans import views as V
from scorewell.plans.catalog import register
from scorewell.session import scratch_path
from scorewell.sources import submissions as S

SUBS = V.with_views("submissions")

# the primary metric of a group and the record's score under it (SQL side)
PM_SQL = """
, pm as (select dataset, fold, first(primary_metric order by timestamp, name) as board_metric
         from submissions group by dataset, fold)
, s as (select submissions.*, pm.board_metric,
               case pm.board_metric when 'spearman' then m_spearman when 'mse' then m_mse end as score
        from submissions join pm using (dataset, fold))
"""

BEST_SQL = (
    SUBS.rstrip()
    + PM_SQL
    + """
, r as (select *, row_number() over (partition by dataset, fold, "user" order by score desc, timestamp, name) as rn,
               min(timestamp) over (partition by dataset, fold, "user") as first_timestamp,
               count(*) over (partition by dataset, fold, "user") as n_submissions
        from s where score is not null)
, best as (select dataset, fold, "user", timestamp, name, score, board_metric as primary_metric,
                  first_timestamp, cast(n_submissions as bigint) as n_submissions from r where rn = 1)
"""
)


@register("best_per_user", BEST_SQL + "select * replace (round(score, 6) as score) from best")
def best_per_user(spark, sf_dir):
    """H1 (+H3): best record per user of each dataset+fold, earliest on ties."""
    b = L.best_per_user(V.submissions(spark, sf_dir))
    return b.withColumn("score", F.round("score", 6)).withColumn("n_submissions", F.col("n_submissions").cast("long"))


@register(
    "leaderboard",
    BEST_SQL
    + """
select dataset, fold,
       cast(row_number() over (partition by dataset, fold order by score desc, first_timestamp, "user") as bigint) as rank,
       "user", coalesce(name, 'Unnamed') as name, round(score, 6) as score, substr(timestamp, 1, 19) as timestamp,
       primary_metric
from best
""",
)
def leaderboard(spark, sf_dir):
    """H2: ranked board per dataset+fold."""
    return L.leaderboard(V.submissions(spark, sf_dir)).withColumn("score", F.round("score", 6))


HIST_PM_SQL = """
, pm as (select dataset, fold, "user", first(primary_metric order by timestamp, name) as board_metric
         from submissions group by dataset, fold, "user")
, s as (select submissions.*, pm.board_metric,
               case pm.board_metric when 'spearman' then m_spearman when 'mse' then m_mse end as score,
               case pm.board_metric when 'spearman' then printf('mse=%.4f', m_mse)
                                    else printf('spearman=%.4f', m_spearman) end as other_metrics
        from submissions join pm using (dataset, fold, "user"))
"""


@register(
    "user_history",
    SUBS.rstrip()
    + HIST_PM_SQL
    + """
, h as (select *, row_number() over w as idx, score - lag(score) over w as chg from s where score is not null
        window w as (partition by dataset, fold, "user" order by timestamp, name))
select dataset, fold, "user", cast(idx as bigint) as idx, coalesce(name, 'Unnamed') as name,
       substr(timestamp, 1, 19) as timestamp, round(score, 6) as score,
       round(case when chg <> 0 then chg end, 6) as change, other_metrics, board_metric as primary_metric
from h
""",
)
def user_history(spark, sf_dir):
    """H4 + H5 for every user of every dataset+fold."""
    h = L.user_history(V.submissions(spark, sf_dir))
    return h.withColumn("score", F.round("score", 6)).withColumn("change", F.round("change", 6))


@register(
    "other_metrics",
    SUBS
    + """
select cast(event_count as bigint) as n, other_metrics from (
  select printf('mse=%.4f', m_mse) as other_metrics, count(*) as event_count from submissions group by 1) t
""",
)
def other_metrics_query(spark, sf_dir):
    """H5 on every record (primary = spearman), counted per distinct text."""
    s = V.submissions(spark, sf_dir)
    t = s.select(L.other_metrics(F.col("metrics"), F.col("primary_metric")).alias("other_metrics"))
    return t.groupBy("other_metrics").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register(
    "history_summary",
    SUBS.rstrip()
    + HIST_PM_SQL
    + """
select dataset, fold, "user", cast(count(*) as bigint) as n_submissions,
       round(first(score order by timestamp, name), 6) as first_score,
       round(max(score), 6) as best_score,
       round(first(score order by timestamp desc, name desc), 6) as latest_score,
       round(first(score order by timestamp desc, name desc) - first(score order by timestamp, name), 6) as total_improvement
from s where score is not null group by dataset, fold, "user" having count(*) > 1
""",
)
def history_summary(spark, sf_dir):
    """H6 for every user with more than one record."""
    h = L.history_summary(V.submissions(spark, sf_dir))
    return h.select(
        "dataset",
        "fold",
        "user",
        F.col("n_submissions").cast("long").alias("n_submissions"),
        *[F.round(c, 6).alias(c) for c in ["first_score", "best_score", "latest_score", "total_improvement"]],
    )


@register(
    "primary_metric_of",
    SUBS.rstrip() + PM_SQL + "select dataset, fold, board_metric from pm",
)
def primary_metric_of(spark, sf_dir):
    """H3."""
    return L.primary_metric_of(V.submissions(spark, sf_dir))


@register(
    "normalize_dataset_name",
    SUBS
    + """
select replace(dataset || '-v1', '-', '_') as dataset, cast(count(*) as bigint) as n from submissions group by 1
""",
)
def normalize_dataset_name(spark, sf_dir):
    """H7: hyphenated names (dataset + '-v1') map to the stored underscore form."""
    s = V.submissions(spark, sf_dir)
    return (
        s.select(S.normalize_dataset_name(F.concat(F.col("dataset"), F.lit("-v1"))).alias("dataset"))
        .groupBy("dataset")
        .agg(F.count(F.lit(1)).cast("long").alias("n"))
    )


FLAT_SQL = (
    SUBS
    + """
select dataset, fold, "user", timestamp, name, description, primary_metric as metric_primary_metric,
       m_mse as metric_mse, m_spearman as metric_spearman from submissions
"""
)


@register("export_submissions", FLAT_SQL)
def export_submissions(spark, sf_dir):
    """A6 projection: one metric_<key> column per key seen anywhere."""
    return S.flatten_submissions(V.submissions(spark, sf_dir))


@register("submission_roundtrip", FLAT_SQL)
def submission_roundtrip(spark, sf_dir):
    """A4 then A5: append every record to a fresh partitioned store, load it back, flatten."""
    path = scratch_path(spark, f"submissions-{uuid.uuid4().hex}")
    S.append_submissions(V.submissions(spark, sf_dir), path)
    return S.flatten_submissions(S.load_submissions(spark, path))


@register(
    "export_submissions_csv",
    SUBS
    + """
select dataset, fold, "user", timestamp, name, description, primary_metric as metric_primary_metric,
       round(m_mse, 6) as metric_mse, round(m_spearman, 6) as metric_spearman,
       cast(row_number() over (order by timestamp, name) as bigint) as place from submissions
""",
)
def export_submissions_csv(spark, sf_dir):
    """Write the sorted CSV, read it back, and number its rows in file order."""
    path = S.export_submissions(V.submissions(spark, sf_dir), scratch_path(spark, f"export-{uuid.uuid4().hex}"))
    back = spark.read.option("header", "true").csv(path).withColumn("_file", F.input_file_name())
    # rows keep their order inside a file; files are numbered in sort order
    placed = back.withColumn("_at", F.monotonically_increasing_id())
    start = placed.groupBy("_file").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    start = start.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = placed.join(start, "_file")
    return out.select(
        "dataset", "fold", "user", "timestamp", "name", "description", "metric_primary_metric",
        F.round(F.col("metric_mse").cast("double"), 6).alias("metric_mse"),
        F.round(F.col("metric_spearman").cast("double"), 6).alias("metric_spearman"),
        (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long").alias("place"),
    )
