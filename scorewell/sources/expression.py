"""A2 read_expression: cells x genes counts kept in long (COO) form, plus obs labels.

Total-count normalization and log1p (C9, C10) run on the COO rows; only the
estimators need one vector per cell, assembled at the end.  The reference
densifies the matrix too, and centring (C8) makes it dense anyway, so each
cell becomes a dense vector scattered from its own entries in an Arrow batch
function — a per-cell group, bounded by the gene count.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewell.operators.features import TARGET_SUM, log1p_values, normalize_total
from scorewell.operators.rank import ordered_positions


def gene_index(coo: DataFrame, gene_col: str = "gene") -> DataFrame:
    """Gene -> 0-based column index in sorted gene order (distributed row number)."""
    genes = coo.select(F.col(gene_col).cast("string").alias("_g")).distinct()
    pos = ordered_positions(genes, ["_g"], (), "_pos")
    return pos.select(F.col("_g").alias(gene_col), (F.col("_pos") - 1).cast("int").alias("gidx"))


def preprocess(coo: DataFrame, target: float = TARGET_SUM) -> DataFrame:
    """C9 + C10 on the COO rows (same fixed target at fit and at predict time)."""
    return log1p_values(normalize_total(coo, "cell_id", "value", target))


#: Cells laid out at once in a task (each is a dense row of the gene count).
CELLS_AT_ONCE = 64


def assemble_cells(coo: DataFrame, genes: DataFrame, n_genes: int, out_col: str = "features") -> DataFrame:
    """(cell_id, gene, value) -> (cell_id, dense vector of n_genes); genes unknown to the index drop out.

    A cell's entries meet as (index, value) arrays, bounded by the gene count, and
    are scattered into its row in one step, so the cost is linear in entries and
    row length.
    """
    per_cell = coo.join(genes, "gene").groupBy("cell_id").agg(F.collect_list(F.struct("gidx", "value")).alias("_e"))
    entries = per_cell.select("cell_id", F.col("_e.gidx").alias("_i"), F.col("_e.value").cast("array<double>").alias("_v"))

    def scatter(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, CELLS_AT_ONCE):
                part = batch.slice(at, CELLS_AT_ONCE)
                dense = np.zeros((part.num_rows, n_genes))
                lists = part.column(1)
                rows = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                np.add.at(dense, (rows, lists.flatten().to_numpy(zero_copy_only=False)),
                          np.nan_to_num(part.column(2).flatten().to_numpy(zero_copy_only=False)))
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * n_genes
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, dense.ravel())], ["cell_id", "_x"]
                )

    kind = coo.schema["cell_id"].dataType.simpleString()
    wide = entries.mapInArrow(scatter, f"cell_id {kind}, _x array<double>")
    return wide.select("cell_id", array_to_vector("_x").alias(out_col))


def read_expression(
    spark: SparkSession, coo: DataFrame, obs: DataFrame, normalize: bool = True, genes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """A2: (cells with features + label, gene index).  Cells absent from the
    counts keep an all-zero vector (left join from obs)."""
    genes = gene_index(coo) if genes is None else genes
    n_genes = genes.count()
    rows = preprocess(coo) if normalize else coo
    vec = assemble_cells(rows, genes, n_genes)
    zero = array_to_vector(F.array_repeat(F.lit(0.0), n_genes))
    cells = obs.join(vec, "cell_id", "left").withColumn("features", F.coalesce(F.col("features"), zero))
    return cells, genes
