"""P1 average-tie rank, and ordered row numbers, without a one-task window.

Both rest on one layout (``laid_out``): rows are range-partitioned on the whole
order key (groups, value, ties), sorted inside their partition and written once
with that partition's number and their place in it.  Then

* a running window per (partition, group) numbers the rows of each piece;
* one row per (partition, group) holds its total, and a window over those rows
  (as many as partitions and groups) gives the rows before it;
* an equi-join on (group, partition) adds that offset.

Range bounds only steer balance.  A row costs a binary search among the bounds
(inside Spark's range partitioner) and two exchanges, whatever the number of
partitions.  Ties take part in the bounds, so a million equal scores, one busy
second or names with a long common prefix spread like any other rows.  Because
the layout is written, both branches read the same partition numbers even if an
executor is lost; ``drop_scratch`` or the application's end deletes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewell.session import map_arrow, materialize

PART, PLACE = "_part", "_place"


def laid_out(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], name: str) -> DataFrame:
    """``df`` range-partitioned and sorted by (groups, order), written with PART and PLACE.

    Nulls come first.  Every partition holds one range of the order, so partition
    numbers grow with it.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group_cols, *order_cols)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # this id is partition * 2^33 + place in the partition
    spot = F.monotonically_increasing_id()
    placed = ranged.withColumn(PLACE, spot)
    return materialize(placed, name).withColumn(PART, F.shiftright(PLACE, 33))


def _before(pieces: DataFrame, groups: Sequence[str], total: str, out: str) -> DataFrame:
    """Per piece: the sum of ``total`` over the group's earlier partitions."""
    w = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn(out, F.coalesce(F.sum(total).over(w), F.lit(0)))


def avg_rank(df: DataFrame, value_col: str, group_cols: Sequence[str] = (), rank_col: str = "rank") -> DataFrame:
    """Distinct (group..., value) with the 1-based average-tie rank within group.

    Equal values collapse in a grouped count first (map-side for a hot value),
    so the layout has one row per distinct value.  Output columns:
    ``*group_cols, value_col, cnt, rank_col``; join it back on the first ones.
    """
    groups = list(group_cols)
    counts = df.groupBy(*groups, value_col).agg(F.count(F.lit(1)).alias("cnt"))
    rows = laid_out(counts, groups, [value_col], "rank-layout")
    w = Window.partitionBy(*groups, PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumn("_run", F.sum("cnt").over(w))
    pieces = rows.groupBy(*groups, PART).agg(F.sum("cnt").alias("_total"))
    offsets = _before(pieces, groups, "_total", "_off").drop("_total")
    joined = running.join(offsets, _null_safe(running, offsets, [*groups, PART]))
    return joined.select(
        *[running[c] for c in (*groups, value_col, "cnt")],
        (offsets["_off"] + running["_run"] - (running["cnt"] - 1) / 2.0).alias(rank_col),
    )


def doubled_ranks(df: DataFrame, value_cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Twice the average-tie rank, a whole number, of each distinct (group..., column, value).

    Columns: the groups, ``column`` (position in ``value_cols``), ``value``, ``rank2``.
    All value columns share one layout (the column is part of the order key), so
    ranking two costs one sample and one write.
    """
    groups = [*group_cols, "column"]
    each = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).alias("value")) for i, c in enumerate(value_cols)])
    long = df.select(*group_cols, F.inline(each))
    rows = laid_out(long.groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("cnt")), groups, ["value"], "rank-layout")
    w = Window.partitionBy(*groups, PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumn("_run", F.sum("cnt").over(w))
    offsets = _before(rows.groupBy(*groups, PART).agg(F.sum("cnt").alias("_total")), groups, "_total", "_off").drop("_total")
    joined = running.join(offsets, _null_safe(running, offsets, [*groups, PART]))
    return joined.select(
        *[running[c] for c in (*groups, "value")],
        (2 * (offsets["_off"] + running["_run"]) - running["cnt"] + 1).alias("rank2"),
    )


def rank_sums(counts: DataFrame, group: str, value: str, cnt: str, other: str) -> DataFrame:
    """Sums over doubled average-tie ranks, without the ranks as a table.

    ``counts`` has one row per (group, value): ``cnt`` equal rows, the whole-number sum
    ``other`` over them.  Rows are range-partitioned on (group, value) and sorted; a task
    gives one row of sums for each of its groups, with ranks that start at its own rows,
    and the rows before it are put in afterwards.  All sums are exact.  Columns: the
    group, n, valued (rows with a value), xx (rank squared) and xy (rank times ``other``).
    """
    import itertools

    n_parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = [F.col(group).asc_nulls_first(), F.col(value).asc_nulls_first()]
    ranged = counts.select(group, value, cnt, other).repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    names = ["n", "valued", "x", "xx", "y", "xy"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        now, held = None, None

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), *[pa.array([str(v)]) for v in held]], [group, *names]
            )

        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                if held is not None and int(g[a]) != now:
                    yield close()
                    held = None
                now = int(g[a])
                held = held or [0] * len(names)
                part = batch.slice(a, b - a)
                c = part.column(2).to_numpy()
                some = c.tolist()
                ranks = (2 * (held[0] + np.cumsum(c)) - c + 1).tolist()
                y = part.column(3).to_pylist()
                weighed = [n * r for n, r in zip(some, ranks)]
                got = [
                    sum(some), int(c[part.column(1).is_valid().to_numpy(zero_copy_only=False)].sum()), sum(weighed),
                    sum(w * r for w, r in zip(weighed, ranks)), sum(y), sum(r * v for r, v in zip(ranks, y)),
                ]
                held = [h + v for h, v in zip(held, got)]
        if held is not None:
            yield close()

    made = map_arrow(ranged, run, ", ".join([f"`{group}` int", *[f"`{c}` string" for c in names]]))
    pieces = materialize(made.withColumn(PART, F.spark_partition_id()), "rank-sums")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    before = _before(pieces.withColumn("n", F.col("n").cast("long")), [group], "n", "_off")
    # a rank is 2 * off more than the piece's own: few digits a factor, so products stay exact
    off = (F.col("_off") * 2).cast("decimal(13,0)")
    short = lambda c, d: F.col(c).cast(f"decimal({d},0)")
    xx = whole("xx") + (2 * off * short("x", 22)).cast("decimal(38,0)") + (off * off * short("n", 12)).cast("decimal(38,0)")
    xy = whole("xy") + (off * short("y", 24)).cast("decimal(38,0)")
    return before.withColumn("_xx", xx).withColumn("_xy", xy).groupBy(group).agg(
        F.sum("n").alias("n"), F.sum(F.col("valued").cast("long")).alias("valued"),
        F.sum("_xx").cast("decimal(38,0)").alias("xx"), F.sum("_xy").cast("decimal(38,0)").alias("xy"),
    )


def _null_safe(a: DataFrame, b: DataFrame, cols: Sequence[str]):
    cond = None
    for c in cols:
        eq = a[c].eqNullSafe(b[c])
        cond = eq if cond is None else cond & eq
    return cond


def with_avg_rank(
    df: DataFrame, value_col: str, group_cols: Sequence[str] = (), rank_col: str = "rank"
) -> DataFrame:
    """``df`` plus its average-tie rank column (equi-join back on group + value)."""
    return df.join(avg_rank(df, value_col, group_cols, rank_col).drop("cnt"), [*group_cols, value_col])


def ordered_positions(
    df: DataFrame,
    order_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    pos_col: str = "pos",
    lag_cols: Sequence[str] = (),
) -> DataFrame:
    """``row_number()`` (and ``lag`` of ``lag_cols``) within ``group_cols`` ordered by
    ``order_cols`` (ascending, nulls first), without sending a whole group to one task.

    ``order_cols`` may be of any sortable type.  The last row of the group's
    previous piece supplies the lag of a piece's first row.  Adds ``pos_col``
    (1-based) and ``prev_<c>`` for each lag column.
    """
    groups = list(group_cols)
    rows = laid_out(df, groups, order_cols, "position-layout")
    w = Window.partitionBy(*groups, PART).orderBy(PLACE)
    numbered = rows.withColumn("_rn", F.row_number().over(w))
    for c in lag_cols:
        numbered = numbered.withColumn(f"_lag_{c}", F.lag(c).over(w))
    aggs = [F.count(F.lit(1)).alias("_total"), *[F.max_by(c, PLACE).alias(f"_last_{c}") for c in lag_cols]]
    pieces = rows.groupBy(*groups, PART).agg(*aggs)
    offsets = _before(pieces, groups, "_total", "_off")
    w_pieces = Window.partitionBy(*groups).orderBy(PART)
    for c in lag_cols:
        offsets = offsets.withColumn(f"_carry_{c}", F.lag(f"_last_{c}").over(w_pieces))
    offsets = offsets.select(*groups, PART, "_off", *[f"_carry_{c}" for c in lag_cols])
    joined = numbered.join(offsets, _null_safe(numbered, offsets, [*groups, PART]))
    return joined.select(
        *[numbered[c] for c in df.columns],
        (offsets["_off"] + numbered["_rn"]).alias(pos_col),
        *[
            F.when(numbered["_rn"] == 1, offsets[f"_carry_{c}"]).otherwise(numbered[f"_lag_{c}"]).alias(f"prev_{c}")
            for c in lag_cols
        ],
    )
