"""E1, E2 and E7 on shared moments: designs, fits, and cross-validation of many configs at once.

A design says which columns of a frame a task turns into its feature matrix.  Up to
``GRAM_COLUMNS`` features, one pass over the rows gives the moments of all folds, from
which every split and penalty is solved, and one more pass gives all predictions
(``scorewell.operators.linear``).  Wider k-mer models are solved on column blocks
without a vocabulary (``scorewell.operators.wide``); such a model is a stored table of
weights.  What is too large for either goes to iterations over the rows (``TooLarge``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param as MLParam
from pyspark.ml.param import Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.functions.sequence import gc_content, normalize_text, seq_length
from scorewell.operators.features import kmer_counts, kmers_of, spread_join, text_chunks
from scorewell.operators.linear import GRAM_COLUMNS, Linear, Moments, fold_moments, fold_predictions, total
from scorewell.operators.wide import Columns
from scorewell.session import map_arrow, materialize

PREDICTION = "prediction"
#: Weights of a stored model that are sent to the tasks as they are.
FEW_WEIGHTS = 1 << 16
# names of the engineered features among k-mers: longer than any k-mer may be
GC, LENGTH = "gc content of the text", "length of the text in characters"


@dataclass
class Design:
    """``columns`` follow (fold, y) in a task's batch; ``matrix(batch)`` is (rows, width)."""

    columns: list[Column]
    matrix: object
    names: list[str]
    sparse: bool = False

    def rows(self, df: DataFrame, fold: Column, y: Column, *more: Column) -> DataFrame:
        return df.select(fold.cast("int").alias("fold"), y.cast("double").alias("y"), *self.columns, *more)

    def origin(self, rows: DataFrame) -> np.ndarray:
        """A point to take sums about: 0 where counts are sparse, else a row of the data."""
        first = [] if self.sparse else rows.limit(1).toArrow().to_batches()
        if not first or not first[0].num_rows:
            return np.zeros(len(self.names))
        return np.nan_to_num(self.matrix(first[0])[0])


def dense_design(feature_cols: list[str], vector_col: str | None, width: int) -> Design:
    """Numeric columns or a vector column as they are."""
    x = vector_to_array(vector_col) if vector_col else F.array(*[F.col(c).cast("double") for c in feature_cols])

    def matrix(batch):
        return batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)

    names = feature_cols or [str(i) for i in range(width)]
    return Design([x.alias("x")], matrix, list(names))


def kmer_design(seq_col: str, vocabulary: list[str], lo: int, hi: int) -> Design:
    """Counts of these k-mers, GC content and length."""
    known = pa.array(vocabulary, pa.string())

    def matrix(batch):
        out = np.zeros((batch.num_rows, len(known) + 2))
        for rows, kmers, n in kmers_of(batch.column(2), lo, hi):
            at = pc.index_in(kmers, known)
            have = at.is_valid().to_numpy(zero_copy_only=False)
            out[rows[have], at.drop_null().to_numpy()] = n[have]
        for k in (3, 4):
            out[:, len(known) + k - 3] = batch.column(k).fill_null(0.0).to_numpy(zero_copy_only=False)
        return out

    columns = [normalize_text(seq_col).alias("t"), gc_content(seq_col).alias("gc"), seq_length(seq_col).alias("len")]
    return Design(columns, matrix, [*vocabulary, GC, LENGTH], sparse=True)


def small_vocabulary(df: DataFrame, seq_col: str, lo: int, hi: int, most: int = GRAM_COLUMNS) -> list[str] | None:
    """The k-mers of all texts in order, or None if there are more than ``most``."""

    def run(batches):
        seen: set[str] = set()
        for batch in batches:
            texts = batch.column(0)
            for at, size in text_chunks(texts):
                for _, kmers, _ in kmers_of(texts.slice(at, size), lo, hi):
                    seen.update(kmers.unique().to_pylist())
                if len(seen) > most:  # enough to know
                    break
            if len(seen) > most:
                break
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["kmer"])

    found = map_arrow(df.select(normalize_text(seq_col).alias("t")), run, "kmer string").distinct().limit(most + 1).collect()
    return None if len(found) > most else sorted(r.kmer for r in found)


def fold_codes(col: str, values: list) -> Column:
    """The place of a row's split value among ``values``; null for rows that always train."""
    out = F.lit(None).cast("int")
    for i, v in enumerate(values):
        out = F.when(F.col(col).eqNullSafe(F.lit(v)), F.lit(i)).otherwise(out)
    return out


def all_moments(df: DataFrame, design: Design, label: str, fold: Column, folds: int) -> list[Moments]:
    rows = design.rows(df, fold, F.col(label))
    return fold_moments(rows, design.matrix, len(design.names), folds, design.origin(rows))


def narrow_cv(df: DataFrame, design: Design, id_col: str, label: str, fold: Column, folds: int, solve) -> DataFrame:
    """(split, id, y, trial, p) of every config; ``solve(moments)`` lists (raw weights, intercept) per config.

    Two passes over the rows, whatever the numbers of splits and configs.
    """
    parts = all_moments(df, design, label, fold, folds)
    every = total(parts)
    models = [solve(every - parts[f]) for f in range(folds)]
    rows = design.rows(df, fold, F.col(label), F.col(id_col))
    return fold_predictions(rows, design.matrix, models, id_col)


def on_all_columns(model: Linear, keep: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """(raw weights, intercept) over a design of which the model has the columns ``keep``."""
    w = np.zeros(width)
    w[keep] = model.raw
    return w, model.intercept


# --- wide ------------------------------------------------------------------------------


def wide_columns(df: DataFrame, seq_col: str, label: str, fold: Column, folds: int, lo: int, hi: int, engineered: bool, *more: str) -> Columns:
    """Column blocks of the k-mer counts (and GC content and length) of a frame's texts."""
    rows = materialize(
        df.select(
            F.monotonically_increasing_id().alias("r"), F.col(label).cast("double").alias("y"), fold.cast("int").alias("fold"),
            F.col(seq_col).alias("_text"), gc_content(seq_col).alias("_gc"), seq_length(seq_col).alias("_len"), *more,
        ),
        "wide-rows",
    )
    entries = kmer_counts(rows, "r", "_text", lo, hi).select("r", F.col("kmer").alias("name"), F.col("n").cast("double").alias("v"))
    if engineered:
        own = F.array(F.struct(F.lit(GC).alias("name"), F.col("_gc").alias("v")), F.struct(F.lit(LENGTH).alias("name"), F.col("_len").alias("v")))
        entries = entries.unionByName(rows.select("r", F.inline(own)).where("v <> 0"))
    # up to so many windows are different in their text; about half are in prose
    windows = rows.agg(F.sum(F.length(normalize_text("_text")))).first()[0] or 0
    return Columns(rows, entries, folds, int(windows) * (hi - lo + 1) // 2)


def wide_predictions(columns: Columns, made: list[tuple[int, int, np.ndarray]], id_col: str) -> DataFrame:
    """(split, id, y, trial, p) from each (trial, split, all rows' predictions)."""
    spark = columns.spark
    import pandas as pd

    parts = []
    for trial, split, p in made:
        mine = columns.fold == split
        parts.append(pd.DataFrame({"r": columns.r[mine], "p": p[mine], "trial": np.int32(trial), "split": np.int32(split)}))
    got = spark.createDataFrame(pd.concat(parts), "r long, p double, trial int, split int")
    return got.join(columns.rows.select("r", id_col, "y"), "r").select("split", id_col, "y", "trial", "p")


class KmerWeights(Transformer, MLReadable, MLWritable):
    """A linear model whose weights are a stored table (name, weight, mean), however many k-mers there are.

    Scores come from a keyed join of a text's k-mers with the table, so neither the
    driver nor a task holds the table.  Saved as the settings and the table.
    """

    settings = MLParam(Params._dummy(), "settings", "JSON of the text column, k-mer range, base and feature weights", TypeConverters.toString)

    def __init__(self, settings: dict | None = None, table: DataFrame | None = None):
        super().__init__()
        self.table = table
        if settings is not None:
            self._set(settings=json.dumps(settings))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        c = json.loads(self.getOrDefault(self.settings))
        kept = materialize(dataset.withColumn("_row", F.monotonically_increasing_id()), "scored-rows")
        counts = kmer_counts(kept, "_row", c["seq_col"], c["lo"], c["hi"])
        weights = self.table.select(F.col("name").alias("kmer"), "weight")
        if weights.limit(FEW_WEIGHTS + 1).count() <= FEW_WEIGHTS:  # nothing of the texts' k-mers needs storing
            known = counts.join(F.broadcast(weights), "kmer")
        else:
            known = spread_join(materialize(counts, "scored-kmers"), weights, "kmer")
        sums = known.groupBy("_row").agg(F.sum(F.col("n") * F.col("weight")).alias("_sum"))
        own = gc_content(c["seq_col"]) * c["gc"] + seq_length(c["seq_col"]) * c["length"]
        out = kept.join(sums, "_row", "left")
        return out.withColumn(PREDICTION, F.lit(c["base"]) + F.coalesce("_sum", F.lit(0.0)) + own).drop("_row", "_sum")

    def write(self) -> MLWriter:
        return _WeightsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _WeightsReader(cls)


class _WeightsWriter(MLWriter):
    def __init__(self, instance: KmerWeights):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/weights")


class _WeightsReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> KmerWeights:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls()
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        out.table = self.sparkSession.read.parquet(f"{path}/weights")
        return out


def weights_model(table: DataFrame, y_mean: float, seq_col: str, lo: int, hi: int) -> KmerWeights:
    """From (name, weight, mean): predictions are y_mean + sum of weight * (count - mean)."""
    base = y_mean - (table.agg(F.sum(F.col("weight") * F.col("mean"))).first()[0] or 0.0)
    own = {r.name: r.weight for r in table.where(F.col("name").isin(GC, LENGTH)).collect()}
    settings = {"seq_col": seq_col, "lo": lo, "hi": hi, "base": base, "gc": own.get(GC, 0.0), "length": own.get(LENGTH, 0.0)}
    return KmerWeights(settings, table)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

