"""Queries that fit and apply models: E1-E12, C6-C8, C11, A2, A8/A9, D5, G4, G9, K1.

Train = fold_id != 0, test = fold 0 of each stand-in table.  Ridge on one
feature has a closed form, so the queries about the machinery around a model
(cross-validation, tuning, ensembles, saving, streaming, the whole run) use it
and are compared with SQL.  For the iterative solvers, queries ending in
``_optimal`` check the optimality conditions of what was fitted; trees and the
perceptron are rows-only here and tested by thresholds.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from scorewell.operators import leaderboard as L
from scorewell.operators.features import kmer_counts
from scorewell.operators.margins import Problem, squared_hinge
from scorewell.plans import cv as CV
from scorewell.plans import estimators as E
from scorewell.plans import experiment as X
from scorewell.plans import views as V
from scorewell.plans.catalog import register
from scorewell.session import materialize, scratch_path
from scorewell.sources import submissions as S
from scorewell.sources.expression import read_expression
from scorewell.sources.tables import dealt, fold_split, read_table

SEQ_ROLES = E.Roles("row_id", "labels", seq_col="sequence")
TAB_REG_ROLES = E.Roles("row_id", "target", feature_cols=V.TAB_FEATURES)
TAB_CLS_ROLES = E.Roles("row_id", "label", feature_cols=V.TAB_FEATURES)
ONE_ROLES = E.Roles("row_id", "target", feature_cols=["sum_qty"])
EXPR_ROLES = E.Roles("cell_id", "label", vector_col="features")


def expression_cells(spark, sf_dir):
    """A2 on the stand-in: COO counts + obs labels -> normalized cell vectors, fold = cell_id % 10."""
    obs = V.cells(spark, sf_dir).withColumn("fold_id", (F.col("cell_id") % 10).cast("int"))
    # the counts and the cells are read by every step of a fit, so the joins behind them run once
    cells, _ = read_expression(spark, materialize(V.expr_coo(spark, sf_dir), "expression-counts"), obs)
    return materialize(cells, "expression-cells")


def _fit_predict(spec_name, frame, roles, config=None):
    train, test = fold_split(frame, 0)
    spec = E.get_spec(spec_name)
    fitted = spec.fit(train, config, roles)
    return spec.predict(fitted, test)


def _reg_out(df, id_col):
    return df.select(id_col, F.round("prediction", 4).alias("prediction"))


@register(
    "mean_predictor",
    V.with_views("seq")
    + "select row_id, round((select avg(labels) from seq where fold_id <> 0), 4) as prediction from seq where fold_id = 0",
)
def mean_predictor(spark, sf_dir):
    """Training mean predicted for every test row."""
    return _reg_out(_fit_predict("mean_predictor", V.seq(spark, sf_dir), SEQ_ROLES), "row_id")


@register("kmer_ridge")
def kmer_ridge(spark, sf_dir):
    """E1 (defaults: k 3-6, alpha 1, engineered features)."""
    return _reg_out(_fit_predict("kmer_ridge", V.seq(spark, sf_dir), SEQ_ROLES), "row_id")


@register("kmer_elasticnet")
def kmer_elasticnet(spark, sf_dir):
    """E2 (defaults: alpha .1, l1_ratio .5)."""
    return _reg_out(_fit_predict("kmer_elasticnet", V.seq(spark, sf_dir), SEQ_ROLES), "row_id")


@register("kmer_hgbr")
def kmer_hgbr(spark, sf_dir):
    """E3 (defaults: 200 trees, depth 6, lr .1, min leaf 10)."""
    return _reg_out(_fit_predict("kmer_hgbr", V.seq(spark, sf_dir), SEQ_ROLES), "row_id")


@register("tabular_ridge")
def tabular_ridge(spark, sf_dir):
    """E7 on the order table, target = total price."""
    return _reg_out(_fit_predict("tabular_ridge", V.tab(spark, sf_dir).drop("label"), TAB_REG_ROLES), "row_id")


@register("tabular_hgbr")
def tabular_hgbr(spark, sf_dir):
    """E8."""
    return _reg_out(_fit_predict("tabular_hgbr", V.tab(spark, sf_dir).drop("label"), TAB_REG_ROLES), "row_id")


@register("tabular_logreg")
def tabular_logreg(spark, sf_dir):
    """E9 on the order table, label = order status."""
    return _fit_predict("tabular_logreg", V.tab(spark, sf_dir).drop("target"), TAB_CLS_ROLES)


@register("tabular_hgbc")
def tabular_hgbc(spark, sf_dir):
    """E10 (three classes -> one-vs-rest boosting)."""
    return _fit_predict("tabular_hgbc", V.tab(spark, sf_dir).drop("target"), TAB_CLS_ROLES)


@register("tabular_rf")
def tabular_rf(spark, sf_dir):
    """E11 (200 trees, depth up to 30)."""
    return _fit_predict("tabular_rf", V.tab(spark, sf_dir).drop("target"), TAB_CLS_ROLES)


def _expr(spark, sf_dir, name, config=None):
    return _fit_predict(name, expression_cells(spark, sf_dir), EXPR_ROLES, config)


@register("expr_logreg")
def expr_logreg(spark, sf_dir):
    """Normalize -> log1p -> centred scaling -> PCA -> balanced logistic."""
    return _expr(spark, sf_dir, "expr_logreg")


@register("expr_svm")
def expr_svm(spark, sf_dir):
    """E5."""
    return _expr(spark, sf_dir, "expr_svm")


@register("expr_mlp")
def expr_mlp(spark, sf_dir):
    """E6."""
    return _expr(spark, sf_dir, "expr_mlp")


@register(
    "read_expression",
    V.with_views("expr_coo", "cells")
    + """
, t as (select cell_id, sum(abs(value)) as total from expr_coo group by cell_id)
, n as (select cell_id, ln(1 + coalesce(value / nullif(total, 0), 0) * 10000.0) as v from expr_coo join t using (cell_id))
, per as (select cell_id, count(*) filter (where v <> 0) as nnz, sum(v) as s from n group by cell_id)
select cells.cell_id, cells.label, cast(coalesce(nnz, 0) as integer) as nnz, round(coalesce(s, 0), 4) as total,
       cast((select count(distinct gene) from expr_coo) as integer) as n_genes
from cells left join per using (cell_id)
""",
)
def read_expression_query(spark, sf_dir):
    """A2 (+C9, C10): one normalized vector per cell; per-cell nnz, sum and width."""
    cells = expression_cells(spark, sf_dir)
    arr = vector_to_array("features")
    return cells.select(
        "cell_id",
        "label",
        F.size(F.filter(arr, lambda v: v != 0)).cast("int").alias("nnz"),
        F.round(F.aggregate(arr, F.lit(0.0), lambda a, v: a + v), 4).alias("total"),
        F.size(arr).cast("int").alias("n_genes"),
    )


@register(
    "feature_union",
    V.with_views("seq")
    + """
, kx as (select row_id as id, regexp_replace(lower(sequence), '\\s\\s+', ' ', 'g') as t, fold_id,
                (2 * length(upper(sequence)) - length(replace(upper(sequence), 'G', '')) - length(replace(upper(sequence), 'C', '')))
                / greatest(length(upper(sequence)), 1) as gc, cast(length(sequence) as double) as len from seq)
, km as (select id, substr(t, s, n) as kmer, fold_id
         from (select id, t, n, fold_id, unnest(range(1, length(t) - n + 2)) as s
               from kx, (select unnest(range(3, 7)) as n) ns where length(t) >= n) x)
, vocab as (select distinct kmer from km where fold_id <> 0)
, per as (select id, count(distinct kmer) as nnz, count(*) as total from km join vocab using (kmer) group by id)
select kx.id as row_id,
       cast(coalesce(nnz, 0) + (case when gc <> 0 then 1 else 0 end) + (case when len <> 0 then 1 else 0 end) as integer) as nnz,
       round(coalesce(total, 0) + gc + len, 6) as total
from kx left join per using (id)
""",
)
def feature_union(spark, sf_dir):
    """K-mer counts (vocabulary of train rows) + GC + length in one vector per row."""
    s = V.seq(spark, sf_dir)
    train, _ = fold_split(s, 0)
    fitted, _ = E.fit_stages(E.kmer_stages("sequence", 3, 6, True), train)
    out = s
    for st in fitted:
        out = st.transform(out)
    arr = vector_to_array("_raw")
    return out.select(
        "row_id",
        F.size(F.filter(arr, lambda v: v != 0)).cast("int").alias("nnz"),
        F.round(F.aggregate(arr, F.lit(0.0), lambda a, v: a + v), 6).alias("total"),
    )


def _scaled_tab(spark, sf_dir, center: bool):
    t = V.tab(spark, sf_dir)
    train, _ = fold_split(t, 0)
    assemble = E._feature_stages(TAB_CLS_ROLES)
    fitted, cur = E.fit_stages(assemble, train)
    scale = E.population_scale(cur, "_raw", "_scaled", center)
    out = t
    for st in fitted + scale:
        out = st.transform(out)
    arr = vector_to_array("_scaled")
    return out.select("row_id", *[F.round(arr[i], 6).alias(c) for i, c in enumerate(V.TAB_FEATURES)])


def _scale_sql(center: bool) -> str:
    cols = V.TAB_FEATURES
    stats = ", ".join(
        f"avg({c}) filter (where fold_id <> 0) as m_{c}, stddev_pop({c}) filter (where fold_id <> 0) as s_{c}" for c in cols
    )
    if center:
        exprs = ", ".join(
            f"round(case when s_{c} = 0 then 0.0 else ({c} - m_{c}) / s_{c} end, 6) as {c}" for c in cols
        )
    else:
        exprs = ", ".join(f"round({c} / case when s_{c} = 0 then 1.0 else s_{c} end, 6) as {c}" for c in cols)
    return V.with_views("tab") + f", st as (select {stats} from tab)\nselect row_id, {exprs} from tab, st"


@register("scale_nocenter", _scale_sql(False))
def scale_nocenter(spark, sf_dir):
    """Divide by the population std of the train rows (zero variance -> 1)."""
    return _scaled_tab(spark, sf_dir, False)


@register("scale_center", _scale_sql(True))
def scale_center(spark, sf_dir):
    """(x - mean) / population std of the train rows."""
    return _scaled_tab(spark, sf_dir, True)


# --- optimality of the fitted linear models --------------------------------


def _weighted_sum(df, weight):
    """Sum of weight * features over all rows (positive and negative weights apart, as the summarizer needs)."""
    w = F.col(weight)
    part = lambda sign: df.select(
        E.FEATURES, F.when(w * sign > 0, w * sign).otherwise(0.0).alias("_part")
    ).agg(Summarizer.metrics("sum").summary(F.col(E.FEATURES), F.col("_part")).alias("s")).first()["s"]["sum"].toArray()
    return part(1) - part(-1)


def _gradients(spark, sf_dir, spec_name):
    """One row per feature of a fitted k-mer model: g (sum of x * residual), w, n rows."""
    train, _ = fold_split(V.seq(spark, sf_dir), 0)
    fitted = E.get_spec(spec_name).fit(train, None, SEQ_ROLES)
    lr = next(s for s in fitted.model.stages if hasattr(s, "coefficients"))
    out = fitted.model.transform(train).withColumn("_r", F.col("labels") - F.col("prediction"))
    per = out.select("_r", F.posexplode(vector_to_array(E.FEATURES)).alias("j", "x")).groupBy("j").agg(
        F.sum(F.col("x") * F.col("_r")).alias("g"), F.count(F.lit(1)).alias("n_rows")
    )
    weights = spark.createDataFrame([(j, float(w)) for j, w in enumerate(lr.coefficients.toArray())], "j int, w double")
    return per.join(weights, "j")


KMER_WIDTH_SQL = (
    V.with_views("seq")
    + """
, kx as (select regexp_replace(lower(sequence), '\\s\\s+', ' ', 'g') as t from seq where fold_id <> 0)
, km as (select distinct substr(t, s, n) as kmer
         from (select t, n, unnest(range(1, length(t) - n + 2)) as s
               from kx, (select unnest(range(3, 7)) as n) ns where length(t) >= n) x)
select cast(count(*) + 2 as bigint) as n_features, cast(count(*) + 2 as bigint) as n_optimal,
       (select cast(count(*) as bigint) from kx) as n_rows from km
"""
)


def _ridge_optimal(g, w, largest, alpha):
    return F.abs(g - alpha * w) <= 1e-3 * F.greatest(largest, F.lit(1e-9))


def _net_optimal(g, w, n, alpha, l1):
    rest = g / n - alpha * (1 - l1) * w
    return F.when(w != 0, F.abs(rest - alpha * l1 * F.signum(w))).otherwise(F.abs(rest) - alpha * l1) <= 1e-4


def _count_optimal(per, ok):
    return per.agg(
        F.count(F.lit(1)).alias("n_features"), F.count(F.when(ok, 1)).alias("n_optimal"), F.max("n_rows").alias("n_rows")
    )


@register("kmer_ridge_optimal", KMER_WIDTH_SQL)
def kmer_ridge_optimal(spark, sf_dir):
    """At the ridge solution X'(y - p) = alpha * w (alpha 1) in every feature, to 1e-3 of the largest weight."""
    per = _gradients(spark, sf_dir, "kmer_ridge")
    largest = per.agg(F.max(F.abs("w")).alias("largest"))
    return _count_optimal(per.join(F.broadcast(largest)), _ridge_optimal(F.col("g"), F.col("w"), F.col("largest"), 1.0))


@register("kmer_elasticnet_optimal", KMER_WIDTH_SQL)
def kmer_elasticnet_optimal(spark, sf_dir):
    """The elastic net's subgradient contains 0 in every feature (alpha 0.1, l1_ratio 0.5), to 1e-4."""
    per = _gradients(spark, sf_dir, "kmer_elasticnet")
    return _count_optimal(per, _net_optimal(F.col("g"), F.col("w"), F.col("n_rows"), 0.1, 0.5))


# --- the same over whole documents: a vocabulary of hundreds of thousands of k-mers ----

DOC_ROLES = E.Roles("row_id", "labels", seq_col="sequence")


def doc_seq(spark, sf_dir):
    """Whole documents as a sequence table; the label is the logarithm of the mean number of characters between spaces."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return dealt(read_table(spark, sf_dir, "documents", ["doc_id", "text"])).select(
        F.col("doc_id").alias("row_id"), text.alias("sequence"),
        F.log1p((F.length(text) - spaces) / (spaces + 1)).alias("labels"), (F.col("doc_id") % 10).cast("int").alias("fold_id"),
    )


DOC_WIDTH_SQL = """
with kx as (select regexp_replace(lower(coalesce(text, '')), '\\s\\s+', ' ', 'g') as t from documents where doc_id % 10 <> 0)
, km as (select distinct substr(t, s, n) as kmer
         from (select t, n, unnest(range(1, length(t) - n + 2)) as s
               from kx, (select unnest(range(3, 7)) as n) ns where length(t) >= n) x)
select cast(count(*) as bigint) as n_features, cast(count(*) as bigint) as n_optimal,
       (select cast(count(*) as bigint) from kx) as n_rows from km
"""


def _document_gradients(spark, sf_dir, spec_name):
    """One row per k-mer of the training documents: g and w on the scaled column, n_rows.

    Independent of the solver: predictions come from the saved form of the model, and
    each k-mer's mean, deviation and gradient from grouped sums.
    """
    train, _ = fold_split(doc_seq(spark, sf_dir), 0)
    train = materialize(train, "document-rows")
    fitted = E.get_spec(spec_name).fit(train, None, DOC_ROLES)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    CV.save_model(fitted, path)
    out = CV.load_model(path, "row_id", spec_name).model.transform(train)
    rest = materialize(out.select("row_id", (F.col("labels") - F.col("prediction")).alias("_r")), "document-residuals")
    n, total = rest.agg(F.count(F.lit(1)), F.sum("_r")).first()
    counts = kmer_counts(train, "row_id", "sequence", 3, 6).join(rest, "row_id")
    x = F.col("n").cast("double")
    per = counts.groupBy("kmer").agg(F.sum(x * F.col("_r")).alias("xr"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"))
    mean, var = F.col("s1") / n, F.col("s2") / n - (F.col("s1") / n) * (F.col("s1") / n)
    std = F.when(var > 1e-12 * F.col("s2") / n, F.sqrt(var)).otherwise(1.0)
    weights = fitted.model.stages[0].table.select(F.col("name").alias("kmer"), "weight")
    return per.join(weights, "kmer", "left").select(
        "kmer", ((F.col("xr") - mean * total) / std).alias("g"), (F.coalesce("weight", F.lit(0.0)) * std).alias("w"),
        F.lit(n).alias("n_rows"),
    )


@register("kmer_ridge_documents", DOC_WIDTH_SQL)
def kmer_ridge_documents(spark, sf_dir):
    """E1 + A9 + A8 over whole documents: every k-mer's optimality condition, to 1e-3 of the largest weight."""
    per = materialize(_document_gradients(spark, sf_dir, "kmer_ridge"), "document-gradients")
    largest = per.agg(F.max(F.abs("w")).alias("largest"))
    return _count_optimal(per.join(F.broadcast(largest)), _ridge_optimal(F.col("g"), F.col("w"), F.col("largest"), 1.0))


@register("kmer_elasticnet_documents", DOC_WIDTH_SQL)
def kmer_elasticnet_documents(spark, sf_dir):
    """E2 over whole documents: the subgradient contains 0 for every k-mer, to 1e-4."""
    per = _document_gradients(spark, sf_dir, "kmer_elasticnet")
    return _count_optimal(per, _net_optimal(F.col("g"), F.col("w"), F.col("n_rows"), 0.1, 0.5))


@register("cross_validate_documents")
def cross_validate_documents(spark, sf_dir):
    """D5 over whole documents: k-mer ridge, all splits solved together on the column blocks."""
    train, _ = fold_split(doc_seq(spark, sf_dir), 0)
    splits = CV.make_splits(train, DOC_ROLES, "regression")
    preds = CV.split_predictions(E.get_spec("kmer_ridge"), splits, DOC_ROLES, None)
    return CV.score_splits(preds, "regression").select("split", F.round("score", 6).alias("spearman"))


def _optimality(out, width, ok):
    return out.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(
        F.lit(width).cast("long").alias("n_features"), F.lit(bool(ok)).alias("optimal"), "n_rows"
    )


@register(
    "tabular_logreg_optimal",
    V.with_views("tab") + "select cast(5 as bigint) as n_features, true as optimal, cast(count(*) as bigint) as n_rows from tab where fold_id <> 0",
)
def tabular_logreg_optimal(spark, sf_dir):
    """The penalized, class-balanced log-likelihood has gradient 0 (C = 1), to 1e-3 of a row's share."""
    train, _ = fold_split(V.tab(spark, sf_dir).drop("target"), 0)
    fitted = E.get_spec("tabular_logreg").fit(train, None, TAB_CLS_ROLES)
    model = next(s for s in fitted.model.stages if hasattr(s, "coefficientMatrix"))
    labels = fitted.model.stages[-1].getLabels()
    out = fitted.model.transform(E.with_weights(train, "label", "_w")).persist()
    worst = 0.0
    for c, name in enumerate(labels):
        share = vector_to_array("probability")[c]
        err = out.withColumn("_e", F.col("_w") * (F.when(F.col("label") == name, 1.0).otherwise(0.0) - share))
        g = _weighted_sum(err, "_e") - model.coefficientMatrix.toArray()[c]
        worst = max(worst, abs(g).max())
    n = out.count()
    return _optimality(out, model.numFeatures, worst <= 1e-3 * n)


@register(
    "squared_hinge_optimal",
    "select cast(label as integer) as label, cast(65 as bigint) as n_weights, cast(65 as bigint) as n_optimal, "
    "(select cast(count(*) as bigint) from embeddings) as n_rows from (select distinct label from embeddings) t",
)
def squared_hinge_optimal(spark, sf_dir):
    """E5's learner on the embeddings, each label against the rest (C = 1): the gradient is 0 in every weight.

    w_j = 2 * sum of y * max(0, 1 - y w.x) * x_j, from grouped sums over the rows.
    """
    v = V.vec(spark, sf_dir)
    labels = sorted(r.label for r in v.select("label").distinct().collect())
    rows = materialize(v.select(F.lit(-1).alias("fold"), F.col("label").alias("cls"), vector_to_array("features").alias("x")), "margin-rows")
    width = E.vector_size(v, "features")
    w = squared_hinge(rows, width, [Problem(-2, c, 1.0, 1.0) for c in labels])
    models = spark.createDataFrame([(int(c), [float(z) for z in x]) for c, x in zip(labels, w)], "label int, w array<double>")
    x1 = F.concat("x", F.array(F.lit(1.0)))
    m = F.aggregate(F.zip_with("w", "x1", lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    y = F.when(F.col("cls") == F.col("label"), 1.0).otherwise(-1.0)
    # a row per label is sent to the rows
    each = rows.select("cls", x1.alias("x1")).join(F.broadcast(models)).withColumn("e", 2 * y * F.greatest(1 - y * m, F.lit(0.0)))
    per = each.select("label", "e", F.posexplode("x1").alias("j", "z")).groupBy("label", "j").agg(
        F.sum(F.col("e") * F.col("z")).alias("g"), F.count(F.lit(1)).alias("n_rows")
    )
    weights = models.select("label", F.posexplode("w").alias("j", "w"))
    return per.join(weights, ["label", "j"]).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_weights"), F.count(F.when(F.abs(F.col("g") - F.col("w")) <= 1e-5, 1)).alias("n_optimal"),
        F.max("n_rows").alias("n_rows"),
    )


# --- principal components ---------------------------------------------------


def _top_eigenvalue_sql(squarings: int = 14) -> str:
    """The largest eigenvalue of the scaled vectors' covariance: repeated squaring with the trace taken out."""
    steps, log = "", []
    for k in range(squarings):
        steps += f"""
, t{k} as (select sum(v) as t from m{k} where i = j)
, m{k + 1} as (select a.i, b.j, sum((a.v / t) * (b.v / t)) as v from m{k} a join m{k} b on a.j = b.i, t{k} group by a.i, b.j)"""
        log.append(f"ln((select t from t{k})) / {2**k}")
    last = f"ln((select sum(v) from m{squarings} where i = j)) / {2**squarings}"
    return f"""
with e as (select vec_id, generate_subscripts(embedding, 1) as j, cast(unnest(embedding) as double) as x
           from embeddings where vec_id % 10 <> 0)
, st as (select j, avg(x) as mu, stddev_pop(x) as sd from e group by j)
, z as (select vec_id, e.j, case when sd = 0 then 0 else (x - mu) / sd end as z from e join st on e.j = st.j)
, m0 as (select a.j as i, b.j as j, sum(a.z * b.z) / (select count(distinct vec_id) - 1 from e) as v
         from z a join z b using (vec_id) group by a.j, b.j){steps}
select cast(c as integer) as component, true as unit, true as eigenvector, true as falling,
       case when c = 0 then round(exp({" + ".join(log)} + {last}), 3) end as variance
from range(10) r(c)
"""


@register("pca", _top_eigenvalue_sql())
def pca(spark, sf_dir):
    """C11: 10 of 64 components of the scaled embeddings: each a unit eigenvector of the covariance, in falling order.

    cov(x, score_i) must equal variance_i * v_i in every column; the first variance is checked against SQL.
    """
    train, _ = fold_split(V.vec(spark, sf_dir), 0)
    (scale,) = E.population_scale(train, "features", "_scaled", True)
    cur = scale.transform(train)
    model = E.pca_stage(cur, "_scaled", "_pca", 10)
    pc = model.pc.toArray()
    v = spark.createDataFrame(
        [(i, j, float(pc[j, i])) for i in range(pc.shape[1]) for j in range(pc.shape[0])], "i int, j int, v double"
    )
    long = model.transform(cur).select(
        F.posexplode(vector_to_array("_scaled")).alias("j", "x"), vector_to_array("_pca").alias("s")
    ).select("j", "x", F.posexplode("s").alias("i", "s"))
    cov = long.groupBy("i", "j").agg(F.covar_samp("x", "s").alias("c"), F.var_samp("s").alias("variance"))
    per = cov.join(v, ["i", "j"]).groupBy("i").agg(
        F.sum(F.col("v") * F.col("v")).alias("norm"), F.max("variance").alias("variance"),
        F.max(F.abs(F.col("c") - F.col("variance") * F.col("v"))).alias("off"),
    )
    before = per.select((F.col("i") + 1).alias("i"), F.col("variance").alias("larger"))
    return per.join(before, "i", "left").select(
        F.col("i").cast("int").alias("component"),
        (F.abs(F.col("norm") - 1) < 1e-9).alias("unit"),
        (F.col("off") < 1e-6).alias("eigenvector"),
        F.coalesce(F.col("larger") >= F.col("variance") - 1e-9, F.lit(True)).alias("falling"),
        F.when(F.col("i") == 0, F.round("variance", 3)).alias("variance"),
    )


@register(
    "pca_wide",
    """
select cast(64 as bigint) as n_components, round(sum(v), 4) as total_variance from (
  select var_samp(cast(e as double)) as v from (select unnest(embedding) as e, generate_subscripts(embedding, 1) as j
                                                from embeddings) t group by j) s
""",
)
def pca_wide(spark, sf_dir):
    """C11, all 64 components of the raw embeddings: the projected rows keep the whole variance."""
    v = V.vec(spark, sf_dir)
    out = E.pca_stage(v, "features", "_pca", 64).transform(v)
    per = out.select(F.posexplode(vector_to_array("_pca")).alias("i", "s")).groupBy("i").agg(F.var_samp("s").alias("v"))
    return per.agg(F.count(F.lit(1)).alias("n_components"), F.round(F.sum("v"), 4).alias("total_variance"))


# --- ridge on one feature: exact in SQL ------------------------------------

#: Predictions of ridge (centred, population-scaled feature) fitted on a source's rows.
RIDGE = """
{name}_fit as (select {keys} count(*) as n, avg(sum_qty) as mx, stddev_pop(sum_qty) as sx, avg(target) as my,
                      covar_pop(sum_qty, target) as c from {train} {group})"""
ONE_P = "my + case when sx = 0 then 0 else (sum_qty - mx) / sx * (n * c / sx / (n + {alpha})) end"
ONE_SQL = V.with_views("tab").rstrip() + "\n," + RIDGE.format(name="a", keys="", train="tab where fold_id <> 0", group="")


def _one(spark, sf_dir):
    return V.tab(spark, sf_dir).select("row_id", "sum_qty", "target", "fold_id")


@register("tabular_ridge_one", ONE_SQL + f"\nselect row_id, round({ONE_P.format(alpha=1)}, 2) as prediction from tab, a_fit where fold_id = 0")
def tabular_ridge_one(spark, sf_dir):
    """E7 on one feature, against its closed form."""
    out = _fit_predict("tabular_ridge", _one(spark, sf_dir), ONE_ROLES)
    return out.select("row_id", F.round("prediction", 2).alias("prediction"))


@register("batch_predict", ONE_SQL + f"\nselect row_id, round({ONE_P.format(alpha=1)}, 2) as predictions from tab, a_fit where fold_id = 0")
def batch_predict(spark, sf_dir):
    """A9 + A8: fit ridge on one feature, save, load, predict the test rows from the saved model."""
    train, test = fold_split(_one(spark, sf_dir), 0)
    fitted = E.get_spec("tabular_ridge").fit(train, None, ONE_ROLES)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    CV.save_model(fitted, path)
    loaded = CV.load_model(path, "row_id", "tabular_ridge")
    out = CV.batch_predict(loaded, test.drop("target"))
    return out.select("row_id", F.round("predictions", 2).alias("predictions"))


#: Validation predictions of each of the first three folds, fitted on the other training folds.
ONE_CV = (
    V.with_views("tab").rstrip()
    + """
, tr as (select * from tab where fold_id <> 0)
, sp as (select cast(row_number() over (order by fold_id) - 1 as integer) as split, fold_id as v
         from (select distinct fold_id from tr) d order by fold_id limit 3)
, fit as (select split, v, count(*) as n, avg(sum_qty) as mx, stddev_pop(sum_qty) as sx, avg(target) as my,
                 covar_pop(sum_qty, target) as c from tr, sp where fold_id <> v group by split, v)
, val as (select split, row_id, target as y, {p} as p from tr join fit on fold_id = v)
, rk as (select split, rank() over (partition by split order by y) + (count(*) over (partition by split, y) - 1) / 2.0 as ry,
                rank() over (partition by split order by p) + (count(*) over (partition by split, p) - 1) / 2.0 as rp from val)
, sc as (select split, case when stddev_pop(rp) * stddev_pop(ry) = 0 then 0.0 else corr(rp, ry) end as score from rk group by split)
"""
)


def _one_splits(spark, sf_dir):
    train, _ = fold_split(_one(spark, sf_dir), 0)
    return CV.make_splits(train, ONE_ROLES, "regression")


@register("cross_validate_one", ONE_CV.format(p=ONE_P.format(alpha=1)) + "select split, round(score, 6) as spearman from sc")
def cross_validate_one(spark, sf_dir):
    """D5 (+D1, F3): ridge on one feature, per-split score against SQL."""
    preds = CV.split_predictions(E.get_spec("tabular_ridge"), _one_splits(spark, sf_dir), ONE_ROLES, None)
    return CV.score_splits(preds, "regression").select("split", F.round("score", 6).alias("spearman"))


@register("cross_validate")
def cross_validate(spark, sf_dir):
    """Default k-mer ridge (k 3-6) on the sequence train rows, splits from fold_id."""
    train, _ = fold_split(V.seq(spark, sf_dir), 0)
    splits = CV.make_splits(train, SEQ_ROLES, "regression")
    preds = CV.split_predictions(E.get_spec("kmer_ridge"), splits, SEQ_ROLES, None)
    return CV.score_splits(preds, "regression").select("split", F.round("score", 6).alias("spearman"))


TRIALS_SQL = """
, u as (select cast(t as integer) as trial, cast(('0x' || substr(md5(t || '|alpha|42'), 1, 8)) as bigint) / 4294967296.0 as u
        from range(10) r(t))
, tr_alpha as (select trial, exp(ln(0.001) + u * (ln(1000.0) - ln(0.001))) as alpha from u)
"""


def _trials(spark, sf_dir, splits, roles):
    t = CV.trial_scores(E.get_spec("tabular_ridge"), splits, roles, "regression", 10, 42)
    return t.select(
        "trial", F.round(F.get_json_object("config", "$.alpha").cast("double"), 6).alias("alpha"), F.round("score", 6).alias("score")
    )


@register(
    "tune_one",
    ONE_CV.format(p=ONE_P.format(alpha=1)) + TRIALS_SQL
    + "select trial, round(alpha, 6) as alpha, (select round(avg(score), 6) from sc) as score from tr_alpha",
)
def tune_one(spark, sf_dir):
    """G3 + G4 on one feature: every penalty ranks alike, so all trials tie exactly."""
    return _trials(spark, sf_dir, _one_splits(spark, sf_dir), ONE_ROLES)


TWO_ROLES = E.Roles("row_id", "target", feature_cols=["n_lines", "sum_qty"])

#: Ridge on two scaled features in closed form: the products are n * [[1, r], [r, 1]].
TWO_P = (
    "my + n * ((n + {alpha}) * c1 - n * r * c2) / ((n + {alpha}) * (n + {alpha}) - n * r * n * r) * (n_lines - m1) / s1"
    " + n * ((n + {alpha}) * c2 - n * r * c1) / ((n + {alpha}) * (n + {alpha}) - n * r * n * r) * (sum_qty - m2) / s2"
)
TWO_FIT = (
    "count(*) as n, avg(n_lines) as m1, avg(sum_qty) as m2, stddev_pop(n_lines) as s1, stddev_pop(sum_qty) as s2, avg(target) as my, "
    "corr(n_lines, sum_qty) as r, covar_pop(n_lines, target) / stddev_pop(n_lines) as c1, "
    "covar_pop(sum_qty, target) / stddev_pop(sum_qty) as c2"
)
#: Validation predictions p of each split (and of each row of {trials}), then scores.
TWO_CV = (
    V.with_views("tab").rstrip()
    + """
, tr as (select * from tab where fold_id <> 0)
, sp as (select cast(row_number() over (order by fold_id) - 1 as integer) as split, fold_id as v
         from (select distinct fold_id from tr) d order by fold_id limit 3)
, fit as (select split, v, """ + TWO_FIT + """ from tr, sp where fold_id <> v group by split, v)
"""
)
TWO_RANKS = """
, rk as (select trial, split, y, p, rank() over (partition by trial, split order by y) + (count(*) over (partition by trial, split, y) - 1) / 2.0 as ry,
                rank() over (partition by trial, split order by p) + (count(*) over (partition by trial, split, p) - 1) / 2.0 as rp from val)
, sc as (select trial, split, count(*) as n, avg(abs(p - y)) as mae,
                case when stddev_pop(rp) * stddev_pop(ry) = 0 then 0.0 else corr(rp, ry) end as score from rk group by trial, split)
"""


def _two(spark, sf_dir):
    return V.tab(spark, sf_dir).select("row_id", "n_lines", "sum_qty", "target", "fold_id")


def _two_splits(spark, sf_dir):
    train, _ = fold_split(_two(spark, sf_dir), 0)
    return CV.make_splits(train, TWO_ROLES, "regression")


@register(
    "tune",
    TWO_CV + TRIALS_SQL
    + ", val as (select trial, split, target as y, round(" + TWO_P.format(alpha="alpha") + ", 7) as p from tr join fit on fold_id = v, tr_alpha)"
    + TWO_RANKS + "select trial, round(max(alpha), 6) as alpha, round(avg(score), 6) as score from sc join tr_alpha using (trial) group by trial",
)
def tune(spark, sf_dir):
    """G3 + G4: the ten seeded trials of the smallest budget on two features, whose trials rank differently."""
    return _trials(spark, sf_dir, _two_splits(spark, sf_dir), TWO_ROLES)


@register("tune_kmers")
def tune_kmers(spark, sf_dir):
    """G3 + G4: ten trials of k-mer ridge; k-mer range, penalty and engineered features vary."""
    train, _ = fold_split(V.seq(spark, sf_dir), 0)
    t = CV.trial_scores(E.get_spec("kmer_ridge"), CV.make_splits(train, SEQ_ROLES, "regression"), SEQ_ROLES, "regression", 10, 42)
    return t.select("trial", "config", F.round("score", 6).alias("score"))


@register(
    "ensemble_cv_two",
    TWO_CV
    + ", val as (select 0 as trial, split, target as y, round(((" + TWO_P.format(alpha=1) + ") + (" + TWO_P.format(alpha=5000)
    + ")) / 2, 7) as p from tr join fit on fold_id = v)" + TWO_RANKS
    + "select split, round(score, 6) as spearman, cast(n as bigint) as n, round(mae, 2) as mae from sc",
)
def ensemble_cv_two(spark, sf_dir):
    """Two ridge members on two features, whose rankings differ, refitted per split."""
    ridge = E.get_spec("tabular_ridge")
    return _ensemble(spark, [(ridge, {"alpha": 1.0}), (ridge, {"alpha": 5000.0})], _two_splits(spark, sf_dir), TWO_ROLES)


@register("ensemble_cv_kmers")
def ensemble_cv_kmers(spark, sf_dir):
    """K-mer ridge and elastic net, mean of their predictions."""
    train, _ = fold_split(V.seq(spark, sf_dir), 0)
    members = [(E.get_spec("kmer_ridge"), None), (E.get_spec("kmer_elasticnet"), None)]
    return _ensemble(spark, members, CV.make_splits(train, SEQ_ROLES, "regression"), SEQ_ROLES)


def _ensemble(spark, members, splits, roles):
    preds = CV.ensemble_predictions(members, splits, roles, "regression")
    exact = preds.withColumn("p", F.round("p", 7))
    err = preds.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 2).alias("mae"))
    return CV.score_splits(exact, "regression").join(err, "split").select("split", F.round("score", 6).alias("spearman"), "n", "mae")


TWO_SQL = V.with_views("tab").rstrip() + "\n, fit as (select " + TWO_FIT + " from tab where fold_id <> 0)\n"


@register("batch_predict_two", TWO_SQL + f"select row_id, round({TWO_P.format(alpha=1)}, 2) as predictions from tab, fit where fold_id = 0")
def batch_predict_two(spark, sf_dir):
    """A9 + A8 on two features: fit, save, load, predict the test rows from the saved model."""
    train, test = fold_split(_two(spark, sf_dir), 0)
    return _saved_predictions(spark, train, test, TWO_ROLES)


@register("batch_predict_all")
def batch_predict_all(spark, sf_dir):
    """A9 + A8 with every feature of the table."""
    train, test = fold_split(V.tab(spark, sf_dir).drop("label"), 0)
    return _saved_predictions(spark, train, test, TAB_REG_ROLES)


def _saved_predictions(spark, train, test, roles):
    fitted = E.get_spec("tabular_ridge").fit(train, None, roles)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    CV.save_model(fitted, path)
    out = CV.batch_predict(CV.load_model(path, "row_id", "tabular_ridge"), test.drop("target"))
    return out.select("row_id", F.round("predictions", 2).alias("predictions"))


@register(
    "ensemble_cv",
    ONE_CV.format(p=f"({ONE_P.format(alpha=1)} + {ONE_P.format(alpha=5000)}) / 2")
    + ", m as (select split, count(*) as n, avg(abs(p - y)) as mae from val group by split)\n"
    "select split, round(score, 6) as spearman, cast(n as bigint) as n, round(mae, 2) as mae from sc join m using (split)",
)
def ensemble_cv(spark, sf_dir):
    """Two ridge members (alpha 1 and 5000) refitted per split, mean of their predictions."""
    ridge = E.get_spec("tabular_ridge")
    members = [(ridge, {"alpha": 1.0}), (ridge, {"alpha": 5000.0})]
    preds = CV.ensemble_predictions(members, _one_splits(spark, sf_dir), ONE_ROLES, "regression")
    err = preds.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 2).alias("mae"))
    return CV.score_splits(preds, "regression").join(err, "split").select("split", F.round("score", 6).alias("spearman"), "n", "mae")


RUN_SQL = (
    ONE_SQL
    + f"""
, val as (select target as y, {ONE_P.format(alpha=1)} as p from tab, a_fit where fold_id = 0)
, rk as (select y, p, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry,
                rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rp from val)
select 'order_totals' as dataset, '0' as fold, cast(1 as bigint) as rank, 'runner' as "user", 'baseline_tabular_ridge' as name,
       round(corr(rp, ry), 6) as score, 'spearman' as primary_metric, round(avg(abs(p - y)), 2) as mae from rk
"""
)


@register("experiment_run", RUN_SQL)
def experiment_run(spark, sf_dir):
    """Plan, cross-validate, tune, refit, save, predict, evaluate, submit, board.

    Only ridge is offered, on one feature: all trials score alike, so the untuned first experiment is refitted.
    """
    X.register_dataset(X.Dataset(
        "order-totals", lambda s, fold: fold_split(_one(s, sf_dir), int(fold)), X.default_evaluate("regression"),
        ONE_ROLES, "dataframe_tabular", "regression",
    ))
    store = scratch_path(spark, f"submissions-{uuid.uuid4().hex}")
    X.run_experiments(
        spark, "order-totals", "0", "runner", store, scratch_path(spark, f"models-{uuid.uuid4().hex}"),
        "2024-01-01T00:00:00", "fast", registry=[E.get_spec("tabular_ridge")],
    )
    records = S.load_submissions(spark, store, "order-totals", "0")
    board = L.leaderboard(records)
    mae = records.select("user", F.col("metrics").getItem("mae").alias("mae"))
    return board.join(mae, "user").select(
        "dataset", "fold", "rank", "user", "name", F.round("score", 6).alias("score"), "primary_metric", F.round("mae", 2).alias("mae")
    )


@register("experiment_run_standard")
def experiment_run_standard(spark, sf_dir):
    """The standard tier on all features: every registered pipeline that learns numbers from a table (ridge and
    boosting) and the mean, 30 trials each, and the ensemble of the best two."""
    X.register_dataset(X.Dataset(
        "order-totals-all", lambda s, fold: fold_split(V.tab(s, sf_dir).drop("label"), int(fold)), X.default_evaluate("regression"),
        TAB_REG_ROLES, "dataframe_tabular", "regression",
    ))
    results, _ = X.run_experiments(
        spark, "order-totals-all", "0", "runner", scratch_path(spark, f"submissions-{uuid.uuid4().hex}"),
        scratch_path(spark, f"models-{uuid.uuid4().hex}"), "2024-01-01T00:00:00", "standard",
        registry=[*E.REGISTRY, *E.EXTRA],
    )
    return results.select("step", "experiment", "pipeline", "metric", F.round("value", 6).alias("value"))
