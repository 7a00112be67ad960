"""Connected components of a stored edge table, by alternating star contractions.

Large star: each vertex links its larger neighbours to the smallest vertex it
sees.  Small star: each vertex links its smaller neighbours and itself to the
smallest of them.  Both are a grouped minimum joined back, so a vertex of any
degree is never collected; each round is written to the shared folder, and the
rounds end when the edges stop changing (a few for star-like graphs, O(log^2 n)
at worst).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    to_low = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return to_low.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, smallest vertex of its component) for every vertex of an edge."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    seen = None
    while True:
        now = stored(_small_star(_large_star(now)).distinct(), "components")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    heads = now.select("v").distinct()
    return now.union(heads.select("v", F.col("v").alias("w"))).toDF("vertex", "component")
