"""Queries over Structured Streaming: J1 (= batch H1) and J2 (= batch A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewell.plans import estimators as E
from scorewell.plans import views as V
from scorewell.plans.catalog import register
from scorewell.plans.q_leaderboard import SUBS
from scorewell.plans.q_models import ONE_P, ONE_ROLES, ONE_SQL, TAB_REG_ROLES, TWO_P, TWO_ROLES, TWO_SQL, _one, _two
from scorewell.sources.submissions import append_submissions
from scorewell.sources.tables import fold_split
from scorewell.streaming.leaderboard import fresh_dir, run_leaderboard_stream, run_predict_stream


@register(
    "streaming_leaderboard",
    SUBS
    + """
select dataset, fold, "user", timestamp, name, round(score, 6) as score, primary_metric, cast(n as bigint) as n_submissions
from (select *, m_spearman as score,
             row_number() over (partition by dataset, fold, "user" order by m_spearman desc, timestamp, name) as rn,
             count(*) over (partition by dataset, fold, "user") as n
      from submissions) t where rn = 1
""",
)
def streaming_leaderboard(spark, sf_dir):
    """Submissions land as files (one folder per dataset+fold); the stream keeps the best per user."""
    src = fresh_dir(spark, "stream-submissions")
    append_submissions(V.submissions(spark, sf_dir), src)
    return _board(run_leaderboard_stream(spark, src, fresh_dir(spark, "stream-board")))


def _board(board):
    return board.select(
        "dataset", "fold", "user", "timestamp", "name", F.round("score", 6).alias("score"), "primary_metric",
        F.col("n_submissions").cast("long").alias("n_submissions"),
    )


TWO_METRICS_SQL = (
    SUBS.rstrip()
    + """
, named as (select *, case when cast(name as bigint) % 3 = 0 then 'mse' else 'spearman' end as named from submissions)
, pm as (select dataset, fold, first(named order by timestamp, name) as board_metric from named group by dataset, fold)
, s as (select named.*, board_metric, case board_metric when 'spearman' then m_spearman else m_mse end as score
        from named join pm using (dataset, fold))
select dataset, fold, "user", timestamp, name, round(score, 6) as score, board_metric as primary_metric,
       cast(n as bigint) as n_submissions
from (select *, row_number() over (partition by dataset, fold, "user" order by score desc, timestamp, name) as rn,
             count(*) over (partition by dataset, fold, "user") as n from s where score is not null) t where rn = 1
"""
)


@register("streaming_leaderboard_two_metrics", TWO_METRICS_SQL)
def streaming_leaderboard_two_metrics(spark, sf_dir):
    """J1 = H1 where records of one board name different primary metrics: the earliest record's counts."""
    src = fresh_dir(spark, "stream-submissions")
    named = F.when(F.col("name").cast("long") % 3 == 0, "mse").otherwise("spearman")
    append_submissions(V.submissions(spark, sf_dir).withColumn("primary_metric", named), src)
    return _board(run_leaderboard_stream(spark, src, fresh_dir(spark, "stream-board"), files_per_trigger=4))


@register("streaming_predict", ONE_SQL + f"\nselect row_id, round({ONE_P.format(alpha=1)}, 2) as predictions from tab, a_fit where fold_id = 0")
def streaming_predict(spark, sf_dir):
    """A fitted ridge on one feature applied to test rows arriving as parquet files."""
    train, test = fold_split(_one(spark, sf_dir), 0)
    return _streamed(spark, E.get_spec("tabular_ridge").fit(train, None, ONE_ROLES), test)


def _streamed(spark, fitted, test):
    src = fresh_dir(spark, "stream-rows")
    rows = test.drop("target")
    rows.repartition(4).write.parquet(src)
    out = run_predict_stream(spark, fitted.model, src, rows.schema, fresh_dir(spark, "stream-preds"), files_per_trigger=2)
    return out.select("row_id", F.round("predictions", 2).alias("predictions"))


@register("streaming_predict_two", TWO_SQL + f"select row_id, round({TWO_P.format(alpha=1)}, 2) as predictions from tab, fit where fold_id = 0")
def streaming_predict_two(spark, sf_dir):
    """J2 on two features."""
    train, test = fold_split(_two(spark, sf_dir), 0)
    return _streamed(spark, E.get_spec("tabular_ridge").fit(train, None, TWO_ROLES), test)


@register("streaming_predict_all")
def streaming_predict_all(spark, sf_dir):
    """J2 with every feature of the table."""
    train, test = fold_split(V.tab(spark, sf_dir).drop("label"), 0)
    return _streamed(spark, E.get_spec("tabular_ridge").fit(train, None, TAB_REG_ROLES), test)
