r"""Target-distribution importance resampling on hashed n-grams (CRC-32 by position tables).

Features of a text are all runs of one to three consecutive words, joined by a
space, with repeats.  A-Z is lowered; words are runs of 0-9, a-z and every character
beyond ASCII, so words are found on the UTF-8 bytes.  A batch of texts becomes one
array of words with a space after each; a feature is a span of it, and its CRC-32
is the XOR of byte contributions by distance from the span's end
(``scorewell.llm.crc_table``).

1. Corpus and target are counted per bucket: each task adds up its own rows (at most
   ``buckets`` rows leave a task), then an aggregate over tasks gives one number per bucket.
2. A bucket's gain is the log ratio of the smoothed shares; a text's weight is the sum
   of its features' gains.
3. score = weight + Gumbel noise from a hash of seed and id, so the highest scores
   are a draw without replacement.  Scored rows (no text) are written once, and
   positions come from the distributed row number, not from a sort in one task.

The draw takes floor(percent * N / 100) of the N rows with enough words.  Counts
and ranks cover every row; only ``buckets`` numbers reach the driver and the tasks.

Defined results: null and empty texts and texts without words have no features and
weight 0, and are never drawn; a null id counts as an empty one in the noise and
comes before others in ties; repeated rows count and are drawn each for itself;
equal scores go to the smaller id, then the smaller weight and feature count; long
texts are read whole, in windows of bounded size; an empty table gives an empty
result, and an empty target makes every gain that of no target feature; columns
besides id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm.common import map_arrow, stored, table
from scorewell.llm.crc_table import span_crcs
from scorewell.operators.rank import ordered_positions

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Features whose bytes are gathered at once.
SPANS_AT_ONCE = 1 << 14
#: Texts that are cut into words at once: this many bytes, or one longer text.
TEXTS_AT_ONCE = 1 << 22


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    in_word = np.zeros(256, bool)
    in_word[48:58] = in_word[97:123] = in_word[128:] = True
    return lower, in_word


LOWER, IN_WORD = _lookup()


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words with a space after each, starts and ends of words there, words per text).

    ``data`` holds the texts one after the other, text i at ``offsets[i]:offsets[i + 1]``.
    """
    low = LOWER[data]
    keep = IN_WORD[low]
    edge = np.zeros(len(keep) + 1, bool)
    inner = offsets[(offsets > 0) & (offsets < len(keep))]
    edge[inner] = True  # a word ends with its text
    begins = keep.copy()
    begins[1:] &= ~keep[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    stops = keep.copy()
    stops[:-1] &= ~keep[1:] | edge[1:-1]
    sizes = np.flatnonzero(stops) + 1 - starts
    per_text = np.diff(np.searchsorted(starts, offsets))
    new_starts = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    where = np.ones(len(joined), bool)
    where[new_starts + sizes] = False
    joined[where] = low[keep]
    return joined, new_starts, new_starts + sizes, per_text


def features(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, per_text: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every feature, in windows of at most SPANS_AT_ONCE words.

    A longer word makes a window of its own.
    """
    text = np.repeat(np.arange(len(per_text)), per_text)
    last = np.repeat(np.cumsum(per_text), per_text)  # the word after the text's last
    at, n = 0, len(starts)
    while at < n:
        # as many words as SPANS_AT_ONCE, or SPANS_AT_ONCE * 16 bytes, allow
        upto = min(at + SPANS_AT_ONCE, int(np.searchsorted(ends, starts[at] + 16 * SPANS_AT_ONCE, "right")))
        upto = max(upto, at + 1)
        word = np.arange(at, upto)
        for size in range(1, LONGEST + 1):
            have = word[word + size <= last[at:upto]]
            if len(have):
                yield text[have], span_crcs(joined, starts[have], ends[have + size - 1]) % np.uint32(buckets)
        at = upto


def grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a batch's texts, TEXTS_AT_ONCE bytes at a time; null counts as empty."""
    col = batch.column(1)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    n = batch.num_rows
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TEXTS_AT_ONCE, "right")) - 1)
        upto = min(upto, n)
        yield at, upto, raw[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def bucket_counts(df: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(bucket, n) over all texts; each task sends one row per bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in grouped(batch):
                for _, bucket in features(*words_of(data, offsets), buckets):
                    total += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    texts = df.select(F.lit(0).alias("i"), text_col)
    return map_arrow(texts, run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _collected(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed target share / smoothed corpus share)) of each bucket."""
    k = len(corpus)
    t_all, s_all = int(target.sum()) + k, int(corpus.sum()) + k
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for t, s in zip(target.tolist(), corpus.tolist())],
        np.int64,
    )


def weighed(df: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_words, n_features and weight."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            weight = np.zeros(batch.num_rows, np.int64)
            for at, upto, data, offsets in grouped(batch):
                parts = words_of(data, offsets)
                n_words[at:upto] = parts[3]
                for text, bucket in features(*parts, buckets):
                    cut = np.flatnonzero(np.r_[True, np.diff(text) != 0])
                    weight[at + text[cut]] += np.add.reduceat(gain[bucket], cut)
            n = sum(np.maximum(n_words - k, 0) for k in range(LONGEST))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n), pa.array(weight)], ["id", "n_words", "n_features", "weight"]
            )

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(id_col: str, seed: int):
    """floor(1000 * Gumbel) from the first 32 bits of sha256('seed:id')."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: id, n_features, weight, score and rank (null where not drawn)."""
    corpus = _collected(bucket_counts(docs, id_col, text_col, buckets), buckets)
    wanted = _collected(bucket_counts(target, id_col, target_text, buckets), buckets)
    rows = weighed(docs, gains(wanted, corpus), id_col, text_col)
    rows = stored(rows.withColumn("score", F.col("weight") + noise("id", seed)), "resampling-scores")
    fit = rows.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    placed = ordered_positions(fit.withColumn("_fall", -F.col("score")), ["_fall", "id", "weight", "n_features"], (), "_pos")
    out = ["id", "n_features", "weight", "score"]
    ranked = placed.select(*out, F.when(F.col("_pos") <= drawn, F.col("_pos")).cast("long").alias("rank"))
    return ranked.unionByName(rows.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_resampling(spark, sf_dir):
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampled(docs, target).withColumnRenamed("id", "doc_id")
