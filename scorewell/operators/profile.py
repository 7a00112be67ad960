"""Column-role inference (B1-B5) and profiling aggregates.

Role detection is a scan of ``df.schema`` (no data read), except the last
fallback of B2, which needs distinct counts: one approximate pass for every
column, then exact counts only for columns whose estimate is near the
threshold.  Task type (B5) and the statistics are single aggregate passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Candidate names and excluded columns used by the reference.
LABEL_CANDIDATES = ["labels", "label", "target", "y"]
SEQUENCE_CANDIDATES = ["sequence", "sequences", "seq", "dna", "rna", "protein"]
EXCLUDE_COLS = {"fold_id", "fold", "split", "index"}
OBS_LABEL_CANDIDATES = ["cell_type_label", "cell_type", "label", "labels", "celltype"]
OBS_DISTINCT_LIMIT = 50
REGRESSION_MIN_FLOAT_DISTINCT = 20  # a float label with more distinct values is regression
CLASSIFICATION_MAX_DISTINCT = 30  # otherwise at most this many distinct values is classification

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def _first_hit(rules, facts, what: str):
    """The first column that any rule names, rules in order; each rule maps column facts to a list of names."""
    for rule in rules:
        named = rule(facts)
        if named:
            return named[0]
    raise ValueError(f"no {what} column can be told from {[f.name for f in facts]}; name it explicitly")


def _named(names):
    """Rule: columns with one of these names, in the names' order."""
    return lambda facts: [n for n in names if any(f.name == n for f in facts)]


def _sole(keep):
    """Rule: the column that ``keep`` accepts, if it is the only one."""

    def rule(facts):
        left = [f.name for f in facts if keep(f)]
        return left if len(left) == 1 else []

    return rule


def detect_label_col(schema: T.StructType) -> str:
    """B1: a candidate name, else the only column that isn't a split or an index."""
    return _first_hit([_named(LABEL_CANDIDATES), _sole(lambda f: f.name not in EXCLUDE_COLS)], schema.fields, "label")


def detect_sequence_col(schema: T.StructType) -> str | None:
    """The first candidate name that holds text."""
    text = [f for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return next(iter(_named(SEQUENCE_CANDIDATES)(text)), None)


def feature_cols(schema: T.StructType, label_col: str) -> list[str]:
    """Numeric (and boolean) columns except the label and excluded names."""
    return [
        f.name
        for f in schema.fields
        if f.name != label_col and f.name not in EXCLUDE_COLS and isinstance(f.dataType, NUMERIC)
    ]


def obs_distinct_flags(obs: DataFrame) -> DataFrame:
    """Per column: is it categorical (string) or below the distinct limit?

    One ``approx_count_distinct`` pass for all columns; exact distinct counts
    only where the estimate is within a factor of two of the limit.
    Output: (column_name, categorical, below_limit), one row per column.
    """
    cols = obs.columns
    approx = obs.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in cols]).first()
    near = [c for c in cols if OBS_DISTINCT_LIMIT // 2 <= approx[c] <= OBS_DISTINCT_LIMIT * 2]
    exact = obs.agg(*[F.count_distinct(c).alias(c) for c in near]).first() if near else {}
    types = {f.name: f.dataType for f in obs.schema.fields}
    rows = []
    for c in cols:
        n = exact[c] if c in near else approx[c]
        rows.append((c, isinstance(types[c], T.StringType), bool(n < OBS_DISTINCT_LIMIT)))
    # the per-column facts are the result of the two aggregate passes above
    spark = obs.sparkSession
    return spark.createDataFrame(rows, "column_name string, categorical boolean, below_limit boolean")


def detect_obs_label_col(obs: DataFrame) -> str:
    """B2: a candidate name, a name with "label" in it, else the only column with few values.

    The data is read only if the names don't tell.
    """

    def few_values(facts):
        flags = obs_distinct_flags(obs).where("categorical or below_limit").collect()
        return [r["column_name"] for r in flags] if len(flags) == 1 else []

    spelled = lambda facts: [f.name for f in facts if "label" in f.name.lower()]
    return _first_hit([_named(OBS_LABEL_CANDIDATES), spelled, few_values], obs.schema.fields, "label")


def _is_float(df: DataFrame, label_col: str) -> bool:
    return isinstance(df.schema[label_col].dataType, (T.FloatType, T.DoubleType))


def task_type_stats(df: DataFrame, label_col: str) -> DataFrame:
    """B5 as one aggregate row: distinct counts and the resulting task type.

    For float labels NULL is read as NaN (the reference's float arrays have no
    NULL); ``count(distinct)`` counts NaN once, as numpy's unique does.
    """
    y = F.col(label_col)
    if _is_float(df, label_col):
        y = F.coalesce(y.cast("double"), F.lit(float("nan")))
        non_nan = F.count_distinct(F.when(~F.isnan(y), y))
        is_float = True
    else:
        non_nan = F.count_distinct(y)
        is_float = False
    stats = df.agg(non_nan.alias("n_distinct_non_nan"), F.count_distinct(y).alias("n_distinct"))
    task = (
        F.when(F.lit(is_float) & (F.col("n_distinct_non_nan") > REGRESSION_MIN_FLOAT_DISTINCT), "regression")
        .when(F.col("n_distinct") <= CLASSIFICATION_MAX_DISTINCT, "classification")
        .otherwise("regression")
    )
    return stats.withColumn("is_float", F.lit(is_float)).withColumn("task_type", task)


def infer_task_type(df: DataFrame, label_col: str) -> str:
    """One approximate count decides far from the limits; near them the exact counts do."""
    about = df.agg(F.approx_count_distinct(F.col(label_col), 0.02).alias("n")).first()["n"]
    if about > 2 * CLASSIFICATION_MAX_DISTINCT:
        return "regression"
    if about < REGRESSION_MIN_FLOAT_DISTINCT // 2:
        return "classification"
    return task_type_stats(df, label_col).first()["task_type"]


def class_distribution(df: DataFrame, label_col: str) -> DataFrame:
    """Label -> count, count descending (ties by label)."""
    return (
        df.groupBy(F.col(label_col).cast("string").alias("label"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "label")
    )


def _non_nan(c: str) -> Column:
    y = F.col(c).cast("double")
    return F.when(~F.isnan(y), y)


def label_stats(df: DataFrame, label_col: str) -> DataFrame:
    """NaN-ignoring mean, population std, min, max."""
    y = _non_nan(label_col)
    return df.agg(
        F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max")
    )


def seq_len_stats(df: DataFrame, seq_col: str) -> DataFrame:
    """Min / max / mean sequence length."""
    n = F.length(seq_col)
    return df.agg(
        F.min(n).cast("long").alias("seq_len_min"),
        F.max(n).cast("long").alias("seq_len_max"),
        F.avg(n).alias("seq_len_mean"),
    )


def label_histogram(df: DataFrame, label_col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the label min and max, count per bin.

    min/max are one aggregate row read back as two literals; the max falls
    into the last bin.
    """
    y = _non_nan(label_col)
    rng = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    lo, hi = rng["lo"], rng["hi"]
    vals = df.select(y.alias("_y")).where(F.col("_y").isNotNull())
    if lo is None:
        return vals.select(F.lit(0).alias("bin"), F.lit(0.0).alias("bin_start"), F.lit(0).cast("long").alias("count")).limit(0)
    width = (hi - lo) / bins
    if width == 0:
        b = F.lit(0)
    else:
        b = F.least(F.floor((F.col("_y") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    out = vals.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return out.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"), "count")


def profile_dataset(
    train: DataFrame, test: DataFrame, data_type: str | None = None, id_cols: tuple[str, ...] = ()
) -> DataFrame:
    """One profile row for a (train, test) pair of a sequence or tabular frame.

    Roles come from the schema; the task type from B5; the rest from one
    aggregate per side.  Class distribution is a map only for classification.
    ``id_cols`` (the row id this engine carries for joins) are not features.
    """
    label = detect_label_col(train.schema)
    seq = detect_sequence_col(train.schema)
    feats = [] if seq else [c for c in feature_cols(train.schema, label) if c not in id_cols]
    dtype = data_type or ("dataframe_sequence" if seq else "dataframe_tabular")
    task = infer_task_type(train, label)

    y = _non_nan(label)
    aggs = [F.count(F.lit(1)).alias("train_samples")]
    if task == "regression":
        aggs += [F.avg(y).alias("label_mean"), F.stddev_pop(y).alias("label_std"), F.min(y).alias("label_min"), F.max(y).alias("label_max")]
        aggs += [F.lit(None).cast("long").alias("n_classes")]
    else:
        aggs += [F.lit(None).cast("double").alias(c) for c in ("label_mean", "label_std", "label_min", "label_max")]
        aggs += [F.count_distinct(F.col(label)).alias("n_classes")]
    if seq:
        n = F.length(seq)
        aggs += [F.min(n).cast("long").alias("seq_len_min"), F.max(n).cast("long").alias("seq_len_max"), F.avg(n).alias("seq_len_mean")]
    else:
        aggs += [F.lit(None).cast("long").alias("seq_len_min"), F.lit(None).cast("long").alias("seq_len_max"), F.lit(None).cast("double").alias("seq_len_mean")]
    n_test = test.count()
    return train.agg(*aggs).withColumn("test_samples", F.lit(n_test)).select(
        F.lit(dtype).alias("data_type"),
        F.lit(task).alias("task_type"),
        F.col("train_samples").cast("long").alias("train_samples"),
        F.col("test_samples").cast("long").alias("test_samples"),
        (F.lit(len(feats)) if feats else F.lit(None)).cast("long").alias("n_features"),
        F.col("n_classes").cast("long").alias("n_classes"),
        F.lit(label).alias("label_column"),
        F.lit(seq).cast("string").alias("sequence_column"),
        F.array(*[F.lit(c) for c in feats]).cast("array<string>").alias("feature_columns"),
        "label_mean",
        "label_std",
        "label_min",
        "label_max",
        "seq_len_min",
        "seq_len_max",
        "seq_len_mean",
    )


def profile_matrix(train: DataFrame, test: DataFrame, genes: DataFrame, label_col: str | None = None) -> DataFrame:
    """B9 for cell-by-gene data: one row from the observations of both sides and the gene index.

    The task is always classification; classes are a label -> count map (as many
    entries as classes).
    """
    label = label_col or detect_obs_label_col(train)
    classes = class_distribution(train, label)
    side = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    found = classes.agg(
        F.count("label").alias("n_classes"), F.coalesce(F.sum("count"), F.lit(0)).alias("train_samples"),
        F.map_from_entries(F.collect_list(F.struct("label", "count"))).alias("class_distribution"),
    )
    one = F.lit(1).alias("_one")
    joined = found.select("*", one).join(side(test, "test_samples").select("*", one), "_one")
    joined = joined.join(side(genes, "n_genes").select("*", one), "_one")
    return joined.select(
        F.lit("anndata").alias("data_type"), F.lit("classification").alias("task_type"), "train_samples", "test_samples",
        F.col("n_genes").alias("n_features"), "n_classes", F.lit(label).alias("label_column"), "class_distribution", "n_genes",
    )


__all__ = [
    "class_distribution",
    "detect_label_col",
    "detect_obs_label_col",
    "detect_sequence_col",
    "feature_cols",
    "infer_task_type",
    "label_histogram",
    "label_stats",
    "obs_distinct_flags",
    "profile_dataset",
    "profile_matrix",
    "seq_len_stats",
    "task_type_stats",
]


def profile_record(train: DataFrame, test: DataFrame, data_type: str | None = None, id_cols: tuple[str, ...] = ()) -> dict:
    """B9 as the reference's profile record (JSON-ready dict).

    Built from the one-row aggregate of ``profile_dataset`` and, for
    classification, the class counts (at most 30 rows by the B5 rule).
    """
    row = profile_dataset(train, test, data_type, id_cols).first().asDict()
    task, label = row["task_type"], row["label_column"]
    rec = {k: row[k] for k in ("data_type", "task_type", "train_samples", "test_samples", "n_features", "n_classes",
                               "label_column", "sequence_column")}
    rec["feature_columns"] = list(row["feature_columns"] or [])
    rec["class_distribution"] = None
    rec["label_stats"] = None
    if task == "classification":
        counts = class_distribution(train, label).collect()
        rec["class_distribution"] = {r["label"]: int(r["count"]) for r in counts}
    else:
        rec["label_stats"] = {k: row[f"label_{k}"] for k in ("mean", "std", "min", "max")}
    rec["extra"] = {}
    if row["sequence_column"]:
        rec["extra"] = {"seq_len_min": row["seq_len_min"], "seq_len_max": row["seq_len_max"], "seq_len_mean": row["seq_len_mean"]}
    return rec
