"""Fold assignment for cross-validation.

Pseudo-random order is ``md5(concat_ws('|', id, seed))`` (identical in any SQL
engine).  Positions come from the distributed row number in ``rank.py``, so a
class holding a third of all rows is numbered by many tasks, not one.
The reference's shuffles cannot be reproduced bit-for-bit; the contract is:
disjoint folds covering every row, sizes within one of each other (per class
for the stratified form), deterministic for a seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.operators.rank import ordered_positions

MAX_SPLITS = 3  # Fixed value: the reference never uses more than three CV splits


def shuffle_key(id_col: str, seed: int):
    """The seeded shuffle's order: a hash of id and seed, as text."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def _dealt(df: DataFrame, id_col: str, groups: list, k: int, seed: int, fold_col: str) -> DataFrame:
    pos = ordered_positions(df.withColumn("_h", shuffle_key(id_col, seed)), ["_h", id_col], groups, "_pos")
    return pos.withColumn(fold_col, ((F.col("_pos") - 1) % k).cast("int")).drop("_h", "_pos")


def kfold(df: DataFrame, id_col: str, k: int = MAX_SPLITS, seed: int = 42, fold_col: str = "cv_fold") -> DataFrame:
    """Shuffled k-fold; fold = position in hash order mod k."""
    return _dealt(df, id_col, [], k, seed, fold_col)


def stratified_kfold(
    df: DataFrame, id_col: str, label_col: str, k: int, seed: int = 42, fold_col: str = "cv_fold"
) -> DataFrame:
    """D3: per class, position in hash order mod k (class sizes split within one)."""
    return _dealt(df, id_col, [label_col], k, seed, fold_col)


def adaptive_splits_frame(df: DataFrame, label_col: str) -> DataFrame:
    """D4 as one row: smallest class size and the number of splits it allows."""
    smallest = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_c")).agg(F.min("_c").alias("min_class_count"))
    m = F.col("min_class_count")
    return smallest.withColumn(
        "n_splits", F.when(m >= 2, F.least(F.lit(MAX_SPLITS), m)).otherwise(F.lit(2)).cast("int")
    )


def adaptive_splits(df: DataFrame, label_col: str) -> int:
    return int(adaptive_splits_frame(df, label_col).first()["n_splits"])


def first_fold_values(df: DataFrame, fold_col: str = "fold_id", n: int = MAX_SPLITS) -> list:
    """The n smallest distinct fold ids (a top-n over the distinct values)."""
    rows = df.select(fold_col).distinct().orderBy(fold_col).limit(n).collect()
    return [r[0] for r in rows]


def inner_folds_by_column(df: DataFrame, fold_col: str = "fold_id") -> list | None:
    """Validation fold values when the column has at least three of them, else None."""
    vals = first_fold_values(df, fold_col)
    return vals if len(vals) >= MAX_SPLITS else None


def split_roles(df: DataFrame, fold_col: str, val_values: list) -> DataFrame:
    """D1 as rows: every row once per split with role 'val' or 'train'.

    Built by exploding a literal array of split values per row (no join).
    """
    splits = F.array(*[F.struct(F.lit(i).alias("split"), F.lit(v).alias("v")) for i, v in enumerate(val_values)])
    ex = df.withColumn("_s", F.explode(splits))
    return ex.select(
        *df.columns,
        F.col("_s.split").cast("int").alias("split"),
        F.when(F.col(fold_col) == F.col("_s.v"), "val").otherwise("train").alias("role"),
    )
