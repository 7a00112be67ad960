"""Queries on grown trees (E3, E8, E10) that SQL can rebuild: coarse whole-number columns, two steps, depth 2."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from scorewell.operators import boosting as B
from scorewell.plans import estimators as E
from scorewell.plans import views as V
from scorewell.plans.catalog import register
from scorewell.sources.tables import fold_split

# the coarse columns, by the same expressions in Spark and DuckDB
COARSE = {
    "lines": "n_lines", "qty": "floor(sum_qty / 4)", "price": "floor(avg_price / 1000)",
    "disc": "round(avg_disc * n_lines * 100)", "tax": "round(avg_tax * n_lines * 100)",
}
STEPS, DEPTH, RATE, L2 = 2, 2, 0.3, 0.1


def _coarse(spark, sf_dir):
    return V.tab(spark, sf_dir).select(
        "row_id", "fold_id", "label", "target", *[F.expr(e).cast("double").alias(c) for c, e in COARSE.items()]
    )


def _trees_sql(classes: int, start: str, gradient: str, hessian: str, raw0: str) -> str:
    """Boosting as CTEs: rows (row_id, k, train, y, w, raw), one tree for each k and step.

    ``start`` gives the rows' label, weight and class number k; ``gradient`` and
    ``hessian`` are over raw, y, w, k and the softmax share p.
    """
    names = list(COARSE)
    ctes = [
        "co as (select row_id, fold_id <> 0 as train, label, target, "
        + ", ".join(f"cast({e} as double) as {c}" for c, e in COARSE.items()) + " from tab)",
        "long as (" + " union all ".join(f"select row_id, {i} as c, {c} as v from co" for i, c in enumerate(names)) + ")",
        "vals as (select distinct c, v from long join co using (row_id) where train)",
        "edges as (select c, v, row_number() over (partition by c order by v) as j, "
        "v + (lead(v) over (partition by c order by v) - v) / 2 as t from vals)",
        f"st as ({start})",
        f"r0 as (select row_id, k, train, y, w, cast({raw0} as double) as raw from st)",
    ]
    own = lambda n, g, h: f"power({g}, 2) / ({h} + {L2})"
    for s in range(STEPS):
        ctes.append(
            f"p{s} as (select *, exp(raw - max(raw) over (partition by row_id)) as ex from r{s})"
        ) if classes > 1 else ctes.append(f"p{s} as (select *, 1.0 as ex from r{s})")
        ctes.append(f"q{s} as (select *, ex / sum(ex) over (partition by row_id) as p from p{s})" if classes > 1
                    else f"q{s} as (select *, 1.0 as p from p{s})")
        ctes.append(f"n{s}_0 as (select *, {gradient} as g, {hessian} as h, '' as node from q{s})")
        for d in range(DEPTH):
            n = f"n{s}_{d}"
            ctes += [
                f"h{n} as (select k, node, c, j, t, count(*) as n, sum(g) as g, sum(h) as h from {n} join long using (row_id) "
                "join edges using (c, v) where train group by all)",
                f"c{n} as (select k, node, c, j, t, sum(n) over u as ln, sum(g) over u as lg, sum(h) over u as lh, "
                f"sum(n) over a as tn, sum(g) over a as tg, sum(h) over a as th from h{n} "
                "window u as (partition by k, node, c order by j), a as (partition by k, node, c))",
                f"g{n} as (select *, {own('l', 'lg', 'lh')} + {own('r', '(tg - lg)', '(th - lh)')} - {own('t', 'tg', 'th')} as gain "
                f"from c{n} where t is not null and ln >= {E.MIN_LEAF} and tn - ln >= {E.MIN_LEAF})",
                f"s{n} as (select * from g{n} where gain > 0 qualify row_number() over (partition by k, node order by gain desc, c, j) = 1)",
                f"n{s}_{d + 1} as (select m.* exclude (node), m.node || case when x.c is null then '' "
                f"when long.v <= x.t then 'l' else 'r' end as node from {n} m left join s{n} x using (k, node) "
                "left join long on long.row_id = m.row_id and long.c = x.c)",
            ]
        last = f"n{s}_{DEPTH}"
        ctes += [
            f"v{s} as (select k, node, -{RATE} * sum(g) / (sum(h) + {L2}) as value from {last} where train group by all)",
            f"r{s + 1} as (select row_id, k, train, y, w, raw + value as raw from {last} join v{s} using (k, node))",
        ]
    return V.with_views("tab").rstrip() + "\n, " + ",\n".join(ctes) + "\n"


REGRESSION_SQL = _trees_sql(
    1, "select row_id, 0 as k, train, target as y, 1.0 as w from co", "w * (raw - y)", "w",
    "(select avg(target) from co where train)",
) + f"select row_id, round(raw, 2) as prediction from r{STEPS} where not train"

CLASSES_SQL = _trees_sql(
    3,
    "select row_id, k, train, label = lab as y, w from co cross join (select row_number() over (order by lab) - 1 as k, lab "
    "from (select distinct label as lab from co where train)) join (select label, "
    "(select count(*) from co where train) / (3.0 * count(*)) as w from co where train group by label) using (label)",
    "w * (p - cast(y as integer))", "w * p * (1 - p)",
    "(select ln(sum(case when z.y then z.w end) / sum(z.w)) from st z where z.train and z.k = st.k)",
) + f"select row_id, k, round(raw, 6) as score from r{STEPS} where not train"


def _grown(spark, sf_dir, label, weight, loss, classes, frame):
    train, test = fold_split(frame, 0)
    vector = VectorAssembler(inputCols=list(COARSE), outputCol="_raw")
    rows = B.training_rows(vector.transform(train), "_raw", label, weight, "row_id").withColumn("held", F.lit(False))
    settings = B.Settings(steps=STEPS, rate=RATE, depth=DEPTH, min_leaf=E.MIN_LEAF, l2=L2)
    return B.fit(rows, len(COARSE), loss, classes, settings), vector.transform(test)


@register("boosted_trees_two", REGRESSION_SQL)
def boosted_trees_two(spark, sf_dir):
    """Test predictions after two regression trees with an L2 leaf penalty."""
    trees, test = _grown(spark, sf_dir, F.col("target"), F.lit(1.0), "squared", 1, _coarse(spark, sf_dir))
    out = B.BoostedTrees(trees, "squared").transform(test)
    return out.select("row_id", F.round("prediction", 2).alias("prediction"))


@register("boosted_classes_two", CLASSES_SQL)
def boosted_classes_two(spark, sf_dir):
    """Each class's score on the test rows after two steps of balanced softmax trees."""
    frame = _coarse(spark, sf_dir)
    labels, train = E._indexed_weighted(frame.where("fold_id <> 0"), "label")
    frame = frame.where("fold_id = 0").withColumns({"_label_idx": F.lit(0.0), "_w": F.lit(1.0)}).unionByName(
        train.select(*frame.columns, "_label_idx", "_w"))
    trees, test = _grown(spark, sf_dir, F.col("_label_idx"), F.col("_w"), "log", len(labels), frame)
    scores = B.BoostedTrees(trees, "scores", outputCol="scores").transform(test)
    return scores.select("row_id", F.posexplode("scores").alias("k", "raw")).select(
        "row_id", F.col("k").cast("long").alias("k"), F.round("raw", 6).alias("score"))
