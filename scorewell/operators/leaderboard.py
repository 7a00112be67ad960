"""H1-H7 leaderboard queries over submission records.

Input: the frame of ``load_submissions`` (timestamp ISO string, user, dataset,
fold, primary_metric, metrics map<string,double>, name, description).

Tie rules (fixed by the reference's loops):
* H1: a later submission replaces the best only when strictly better, so the
  earliest submission wins a tie.
* H2: equal scores keep the order in which each user first submitted.
* H3: the primary metric is the one named by the earliest record of the
  dataset+fold (of the user for history).
Exact-time ties are broken by ``name`` in every query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.operators.rank import ordered_positions
from scorewell.session import materialize

KEYS = ["dataset", "fold"]
# Fixed value: shown when a record has no name.
UNNAMED = "Unnamed"


def primary_metric_of(subs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """H3: primary metric named by the earliest record of each key group."""
    return subs.groupBy(*keys).agg(
        F.min_by("primary_metric", F.struct("timestamp", "name")).alias("board_metric")
    )


#: Most groups whose metric name is sent to every task; beyond that the join moves rows.
METRIC_NAMES = 10_000


def scored(subs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Records with ``score`` = value of the group's primary metric; records lacking it are dropped.

    The table of metric names has a row per group.  For boards it is written, and
    broadcast if it is within METRIC_NAMES rows, so a few large boards don't pull
    all records into a few tasks.
    """
    pm = primary_metric_of(subs, keys)
    if keys == KEYS:
        pm = materialize(pm, "board-metrics")
        if pm.limit(METRIC_NAMES + 1).count() <= METRIC_NAMES:
            pm = F.broadcast(pm)
    j = subs.join(pm, keys)
    return j.withColumn("score", F.try_element_at(F.col("metrics"), F.col("board_metric"))).where(
        F.col("score").isNotNull()
    )


def user_metrics(records: DataFrame) -> DataFrame:
    """Per (dataset, fold, user, metric) the best record, its count and first, and the user's first record at all.

    A row per metric a user ever reported, so whichever metric the board turns out to
    use (H3: the one its earliest record names), the best record by it is at hand.
    ``min_by`` over (-score, timestamp, name) is a hash aggregate with map-side
    partials, so a user with a third of all rows costs one partial row per task.
    Works on a stream as well (its state is this table).
    """
    each = records.select(
        *KEYS, "user", "timestamp", "name", "primary_metric", "description",
        F.explode_outer(F.map_filter("metrics", lambda k, v: v.isNotNull())).alias("metric", "score"),
    )
    rec = F.struct("timestamp", "name", "score", "description")
    key = F.struct((-F.col("score")).alias("neg"), F.col("timestamp"), F.col("name"))
    return each.groupBy(*KEYS, "user", "metric").agg(
        F.min_by(rec, key).alias("best"),
        F.count("score").alias("n_submissions"),
        F.min(F.when(F.col("score").isNotNull(), F.struct("timestamp", "name"))).getField("timestamp").alias("first_timestamp"),
        F.min(F.struct("timestamp", "name", "primary_metric")).alias("first"),
    )


def board_of(state: DataFrame) -> DataFrame:
    """H1 from ``user_metrics`` (stored, as it is read twice): rows of the metric that the board's earliest record names."""
    names = state.groupBy(*KEYS).agg(F.min("first").getField("primary_metric").alias("board_metric"))
    rows = state.join(names, KEYS).where((F.col("metric") == F.col("board_metric")) & (F.col("n_submissions") > 0))
    return rows.select(
        *KEYS,
        "user",
        F.col("best.timestamp").alias("timestamp"),
        F.col("best.name").alias("name"),
        F.col("best.score").alias("score"),
        F.col("board_metric").alias("primary_metric"),
        "first_timestamp",
        "n_submissions",
    )


def best_per_user(subs: DataFrame) -> DataFrame:
    """H1: one row per (dataset, fold, user): highest score, earliest on ties.

    The records are read once; the table per user and metric is written.
    """
    return board_of(materialize(user_metrics(subs), "user-metrics"))


def leaderboard(subs: DataFrame) -> DataFrame:
    """H2: best per user ranked by score desc; ties keep first-submission order.

    The rank is a distributed row number, so neither a board with very many
    users nor very many tied scores sit in one task.
    """
    best = best_per_user(subs).withColumn("_neg", -F.col("score"))
    ranked = ordered_positions(best, ["_neg", "first_timestamp", "user"], KEYS, "rank")
    return ranked.select(
        *KEYS,
        F.col("rank").cast("long").alias("rank"),
        "user",
        F.coalesce(F.col("name"), F.lit(UNNAMED)).alias("name"),
        "score",
        F.substring("timestamp", 1, 19).alias("timestamp"),
        "primary_metric",
    )


def user_history(subs: DataFrame) -> DataFrame:
    """H4: per (dataset, fold, user) in time order: index 1..n, score, change vs previous.

    Change is null on the first record and when it is exactly 0.  The
    primary metric comes from the user's earliest record.  Index and previous
    score come from the distributed row number, so a user with a third of all
    rows is spread over many tasks.  The records are read once and written
    slim; everything after reads that table.
    """
    keys = [*KEYS, "user"]
    slim = materialize(subs.select(*keys, "timestamp", "name", "primary_metric", "metrics"), "history-records")
    s = scored(slim, keys)
    pos = ordered_positions(s, ["timestamp", "name"], keys, "idx", lag_cols=["score"])
    change = F.col("score") - F.col("prev_score")
    return pos.select(
        *keys,
        F.col("idx").cast("long").alias("idx"),
        F.coalesce(F.col("name"), F.lit(UNNAMED)).alias("name"),
        F.substring("timestamp", 1, 19).alias("timestamp"),
        "score",
        F.when(change != 0, change).alias("change"),
        other_metrics(F.col("metrics"), F.col("board_metric")).alias("other_metrics"),
        F.col("board_metric").alias("primary_metric"),
    )


def other_metrics(metrics: Column, primary: Column) -> Column:
    """H5: ``k=v`` list (4 decimals, comma-separated) of the non-primary metrics, in map order."""
    entries = F.map_entries(F.map_filter(metrics, lambda k, v: k != primary))
    return F.array_join(F.transform(entries, lambda e: F.format_string("%s=%.4f", e["key"], e["value"])), ", ")


def history_summary(subs: DataFrame) -> DataFrame:
    """H6: first, best, latest score and latest − first, only for users with >1 record."""
    keys = [*KEYS, "user"]
    s = scored(subs, keys)
    order = F.struct("timestamp", "name")
    agg = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_submissions"),
        F.min_by("score", order).alias("first_score"),
        F.max("score").alias("best_score"),
        F.max_by("score", order).alias("latest_score"),
    )
    return agg.where(F.col("n_submissions") > 1).withColumn(
        "total_improvement", F.col("latest_score") - F.col("first_score")
    )
