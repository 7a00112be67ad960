"""Exact dedup: a tree merge of sorted digest runs.

Each scan partition is a run: its rows are combined by digest (the best row and
the group's size so far).  Runs then merge ``FAN_IN`` at a time in binomial
rounds, runs r with the same r div FAN_IN^k meeting in round k, until one run is
left.  A round is one grouped aggregate, so copies inside a task collapse before
they move and a hot digest never travels as more than one row per run; each
round's runs are written sorted by digest to the shared folder, from which a lost
executor's work restarts.  The digest is part of every key, so the last round is
spread over all tasks too.

"Verified": rows merge only if the SHA-256 digest, a second 64-bit digest and the
length of the normalised text all agree, at every level.

Defined results: null text counts as empty, and all texts of white space only
are equal to it; of equal texts the one with the most code points stays, then the
smallest id (null ids last), then the first in the table; repeated rows count as
copies of each other, of which one stays; an empty table gives an empty result.
The input must be a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.llm.common import SPACE_CHARS, private, stored, table, text_or_empty

FAN_IN = 16
ROUNDS = 2


def normalised(text: Column) -> Column:
    """The text without white space (byte-wise ``replace``, one pass per character)."""
    for c in SPACE_CHARS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


KEY = ["sha", "check", "n"]


def digests(df: DataFrame, id_col: str, text_col: str, row: str) -> DataFrame:
    norm = F.col("_norm")
    return (
        df.select(
            F.col(row).alias("row"),
            F.col(id_col).alias("id"),
            F.char_length(text_or_empty(text_col)).alias("chars"),
            normalised(text_or_empty(text_col)).alias("_norm"),
        )
        .select(
            "row", "id", "chars",
            F.sha2(norm.cast("binary"), 256).alias("sha"),
            F.xxhash64(norm).alias("check"),
            F.octet_length(norm).alias("n"),
            F.pmod(F.spark_partition_id(), F.lit(FAN_IN**ROUNDS)).alias("run"),
        )
    )


def merge_runs(runs: DataFrame, name: str) -> DataFrame:
    """Merge each FAN_IN neighbouring runs: the best row and the size of every digest."""
    merged = runs.groupBy(F.expr(f"run div {FAN_IN}").alias("run"), *KEY).agg(
        F.min("best").alias("best"), F.sum("size").alias("size")
    )
    return stored(merged.sortWithinPartitions("run", "sha"), name)


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of ``df``: row, id, keep_id, group_size, kept, sha.

    ``row`` names a column that numbers the rows; without it their position is taken.
    """
    if row is None:
        (row,) = private(df, "row")
        df = df.withColumn(row, F.monotonically_increasing_id())
    rows = stored(digests(df, id_col, text_col, row), "digests")
    best = F.struct(
        (-F.col("chars")).alias("shorter"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row")
    )
    runs = rows.select("run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("size"))
    for k in range(ROUNDS):
        runs = merge_runs(runs, f"digest-runs-{k + 1}")
    winners = runs.select(*KEY, F.col("best.id").alias("keep_id"), F.col("best.row").alias("_first"),
                          F.col("size").alias("group_size"))
    return rows.join(winners, KEY).select(
        "row", "id", "keep_id", "group_size", (F.col("row") == F.col("_first")).alias("kept"), "sha"
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its columns."""
    (row,) = private(df, "row")
    tagged = df.withColumn(row, F.monotonically_increasing_id())
    gone = duplicates(tagged, id_col, text_col, row).where(~F.col("kept")).select(F.col("row").alias(row))
    return tagged.join(gone, row, "left_anti").drop(row)


def op7_exact_dedup(spark, sf_dir):
    found = duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT norm, count(*) AS group_size,
         min(struct_pack(a := -chars, b := doc_id)).b AS keep_id
  FROM n GROUP BY norm)
SELECT n.doc_id, r.keep_id, r.group_size, n.doc_id = r.keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN r USING (norm)
"""
