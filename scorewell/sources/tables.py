"""A1 read_table, A3 fold_split, A7 drop_label_export.

All reads are plain ``spark.read.parquet`` scans so Catalyst pushes the fold
predicate and the column list into the scan (``PushedFilters`` /
``ReadSchema`` in ``explain``).  Nothing here collects rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A1: load one table; optional projection is pushed into the parquet scan."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return df


def read_csv_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A1 for CSV input: explicit schema, no inference pass over the data."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly, whatever their ids; a table in one small file is one task's work otherwise."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def fold_split(df: DataFrame, fold: int | str, fold_col: str = "fold_id") -> tuple[DataFrame, DataFrame]:
    """A3: (train, test) where test is ``fold_col == fold`` and train the rest.

    Null-safe: a row without a fold is a training row.  Both sides are
    predicates on the scan; with data written ``partitionBy(fold_col)`` they
    become partition pruning.
    """
    is_test = F.col(fold_col).eqNullSafe(F.lit(fold))
    return df.where(~is_test), df.where(is_test)


def drop_label_export(df: DataFrame, label_col: str) -> DataFrame:
    """Features without the label (leakage guard)."""
    return df.drop(label_col)


def matrix_features(coo: DataFrame, cell_col: str = "cell_id", gene_col: str = "gene", value_col: str = "value") -> DataFrame:
    """A7 for cell-by-gene data: the counts alone; no observation column goes along (leakage guard)."""
    return coo.select(cell_col, gene_col, value_col)
