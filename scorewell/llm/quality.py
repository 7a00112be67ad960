r"""Quality rules: a hashed n-gram log-likelihood ratio beside plain text statistics.

Words and neighbouring word pairs of every document are hashed into BUCKETS
features.  Two multinomials over the features are counted, one over trusted
documents (all rows labelled good) and one over the whole raw corpus.  A document's score is the mean, over its features, of the logarithm of
trusted over raw probability: positive if it reads like the trusted ones.  It is
kept unless a base rule fails or its score is below the threshold, which is the
KEEP_SHARE quantile of the trusted documents' own scores, less MARGIN.  Weights
are whole millionths, so sums don't depend on their order and every document
gets the same verdict on every run.

Only column functions are used.  What reaches the driver is BUCKETS weights and
one threshold, which is an exact quantile of all trusted rows' scores; trusted ids
are broadcast up to SENT_IDS of them and meet the texts in a shuffled join beyond.

Defined results: null text counts as empty; a text without words has no
features, score 0, and fails the base rule; repeated rows are judged alike; an
empty table gives an empty result; without trusted rows the method keeps what
the base rules keep; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.llm.common import SPACE_PATTERN, WORD_PATTERN, private, stored, table, text_or_empty
from scorewell.llm.exact_dedup import normalised
from scorewell.operators.rank import ordered_positions

BUCKETS = 8192
#: Most trusted ids that are sent to the texts' tasks; beyond that, texts and ids meet in a shuffled join.
SENT_IDS = 1 << 20
KEEP_SHARE = 0.002
MARGIN = 0.05
SMOOTH = 0.5
UNIT = 1_000_000
SYMBOLS = "#*$%&|<>"


def _ints(expr: str) -> Column:
    return F.expr(f"cast(array() as array<{expr}>)")


def features(words: str) -> Column:
    """The feature numbers (1 to BUCKETS) of all words, then of all pairs."""
    number = lambda *c: (F.pmod(F.xxhash64(*c), F.lit(BUCKETS)) + 1).cast("int")
    pairs = F.transform(
        F.slice(F.col(words), F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: number(w, F.get(F.col(words), i + 1)),
    )
    return F.concat(F.transform(F.col(words), lambda w: number(w)), pairs)


def with_words(df: DataFrame, text_col: str, words: str) -> DataFrame:
    text = text_or_empty(text_col)
    return df.withColumn(words, F.filter(F.split(text, SPACE_PATTERN, -1), lambda w: w != ""))


def statistics(df: DataFrame, text_col: str = "text", words: str = "words") -> DataFrame:
    """Add the base statistics; ``df`` has the words of its texts already."""
    text = text_or_empty(text_col)
    windows, ranked, spots = private(df, "q_windows", "q_ranked", "q_spots")
    symbols = text
    for c in SYMBOLS:
        symbols = F.replace(symbols, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_PATTERN))
    w = F.col(words)
    out = df.withColumn(
        windows,
        F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)),
        ),
    )
    # sorted (hash, position): only where some window comes twice
    out = out.withColumn(
        ranked,
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)")),
    )
    r = F.col(ranked)
    same = lambda x, k: F.coalesce(x["h"] == F.get(r, k)["h"], F.lit(False))
    out = out.withColumn(
        spots,
        F.sort_array(F.transform(F.filter(r, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])),
    )
    s = F.col(spots)
    covered = F.aggregate(
        F.transform(s, lambda p, k: F.least(F.lit(3), F.get(s, k + 1) - p)), F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    n, bad = F.size(w).cast("long"), covered
    return out.select(
        "*",
        n.alias("n_words"),
        F.char_length(normalised(text)).cast("long").alias("word_chars"),
        (F.octet_length(text) - F.octet_length(symbols)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        bad.alias("n_repeat_words"),
    ).drop(windows, ranked, spots).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All ids labelled good, each once."""
    return labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.col(id_col)).distinct()


def weights(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> list[int]:
    """Log-likelihood ratio of each feature in millionths: one pass over the whole corpus."""
    marked = docs.select(id_col, text_col).join(trusted.select(id_col, F.lit(1).alias("_trusted")), id_col, "left")
    seen = with_words(marked, text_col, "_words").select(
        F.explode(features("_words")).alias("f"), F.coalesce("_trusted", F.lit(0)).alias("t")
    ).groupBy("f").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("good"))
    at = {x["f"]: x for x in seen.collect()}  # at most BUCKETS rows
    raw, good = sum(x["raw"] for x in at.values()), sum(x["good"] for x in at.values())
    if not good:
        return [0] * BUCKETS
    rate = lambda n, total: math.log((n + SMOOTH) / (total + SMOOTH * BUCKETS))
    return [
        round(UNIT * (rate(at[f]["good"], good) - rate(at[f]["raw"], raw))) if f in at else 0
        for f in range(1, BUCKETS + 1)
    ]


def with_score(df: DataFrame, model: list[int], words: str, score: str) -> DataFrame:
    """Mean weight of a document's features, in units of 1 (0 without features)."""
    table_ = F.split(F.lit(",".join(map(str, model))), ",").cast("array<bigint>")  # folds to one literal
    total = F.aggregate(features(words), F.lit(0).cast("long"), lambda acc, f: acc + F.get(table_, f - 1))
    count = F.greatest(2 * F.size(words) - 1, F.lit(1))
    return df.withColumn(score, total / count / F.lit(float(UNIT)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[int], float]:
    """(feature weights, score threshold)."""
    trusted = stored(trusted_ids(labels, id_col), "trusted-ids")
    if trusted.count() <= SENT_IDS:
        trusted = F.broadcast(trusted)
    model = weights(docs, trusted, id_col, text_col)
    good = docs.select(id_col, text_col).join(trusted, id_col, "left_semi")
    scored = with_score(with_words(good, text_col, "_words"), model, "_words", "_score")
    at = quantile(stored(scored.where(F.size("_words") > 0).select("_score"), "trusted-scores"), "_score", KEEP_SHARE)
    return model, -math.inf if at is None else at - MARGIN


def quantile(rows: DataFrame, col: str, share: float) -> float | None:
    """The exact quantile (between neighbours linear) of a stored column; two numbers reach the driver."""
    n = rows.count()
    if not n:
        return None
    spot = share * (n - 1)
    low = int(spot)
    near = ordered_positions(rows, [col], (), "_pos").where(F.col("_pos").isin(low + 1, low + 2))
    value = {r["_pos"]: r[col] for r in near.collect()}
    return value[low + 1] + (spot - low) * (value.get(low + 2, value[low + 1]) - value[low + 1])


def judged(df: DataFrame, model: list[int], threshold: float, text_col: str = "text") -> DataFrame:
    """``df`` with the statistics, ``score`` and ``kept``."""
    (words,) = private(df, "q_words")
    out = statistics(with_words(df, text_col, words), text_col, words)
    out = with_score(out, model, words, "score").drop(words)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model, threshold = fit(docs, table(spark, sf_dir, "labels"))
    return judged(docs.select("doc_id", "text"), model, threshold).drop("text")
