"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

Fit (on the driver, on a bounded sample of labelled rows):

1. Two thirds of the sample train the dictionaries.  The ordinary one is trained on
   windows of ordinary texts.  The toxic one holds the passages that set
   toxic texts apart: the words around byte grams (of 5, 7 and 9 bytes) that occur
   in many more toxic than ordinary texts, near copies counted once.  The long grams
   find words whose syllables are common in ordinary text.
2. A window is compressed twice, with the ordinary dictionary alone and with the
   toxic one before it.  What ordinary text needs is found at the same distance
   in both, so the lengths differ where the toxic dictionary helps: the bytes it
   saves are the window's distance.
3. The other third calibrates.  Histograms of the distance in toxic
   and ordinary texts give each window a likelihood ratio, a text's windows add
   up as a mixture (a toxic text has ordinary windows too), and a logistic curve
   on that sum, weighted to the labels' real shares and to MISS_COST, gives the score.

Score (in tasks): every window of the whole text, cut at spaces after WINDOW
bytes, so that each byte lies in one window.

Ids whose crc32 (of their decimal text) is divisible by HELD_OUT are never
learned from.  Labels, languages, sources and ids are no inputs of a score.

Defined results: null and empty texts are one empty window; texts of any length
are scored whole (of one longer than SAMPLE_BYTES, blocks from all over it are learned from); repeated rows are scored
each for itself, and one row of an id is learned from; several labels of one
id count as toxic if one does; with fewer than three toxic or
ordinary labelled rows every score is 0; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.llm.common import map_arrow, private, sample, table

#: Most labelled ids learned from, those with the smallest hash.
TOXIC_ROWS, ORDINARY_ROWS = 1500, 3000
HELD_OUT = 5
WINDOW, LEVEL = 96, 9
SEARCH_LOG = 9  # deep enough to reach the toxic dictionary behind the ordinary one's equal syllables
ORDINARY_BYTES, TOXIC_BYTES = 200_000, 8192
GRAMS, COPY_GRAM = (5, 7, 9), 24
#: ASCII other than letters and digits is a space in grams and passages.
SPACED = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
REACH = 16  # bytes that a passage takes of a word on either side of its grams
SEVERAL = 3  # a passage in so many toxic texts is kept beside others with the same grams
#: A gram is toxic if one in RARE toxic texts has it, and at ODDS times the rate of ordinary ones.
RARE, ODDS = 200, 60.0
MOST = 10  # larger distances count as this one
MISS_COST = 3.0  # ordinary texts that may be taken for toxic to catch one more toxic text
SHARE = 0.6  # of a toxic text's windows, in the mixture


def windows(text: bytes) -> list[bytes]:
    out, i, n = [], 0, len(text)
    while i < n:
        j = text.find(b" ", i + WINDOW)
        if j < 0 or n - j < WINDOW // 2:
            j = n
        out.append(text[i:j])
        i = j
    return out or [b""]


def _grams(text: bytes, size: int) -> np.ndarray:
    """Hashes of the text's grams of ``size`` bytes, one for each place."""
    a = np.frombuffer(b" " + text.translate(SPACED), np.uint8).astype(np.uint64)
    n = max(0, len(a) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size if n else 0):
        h = (h + a[j : n + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _place(grams: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each gram its place in the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(grams), -1)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    return np.where(known[at] == grams, at, -1)


def _distinct(texts: list[bytes]) -> list[bytes]:
    """Without near copies of earlier texts (half their sketch is known): those are no further evidence."""
    seen: set[int] = set()
    out = []
    for t in texts:
        sketch = np.unique(_grams(t, COPY_GRAM))[:8].tolist()
        if not sketch or 2 * sum(h in seen for h in sketch) < len(sketch):
            out.append(t)
        seen.update(sketch)
    return out


def _telling(toxic: list[bytes], ordinary: list[bytes], size: int, shorter: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The grams (sorted hashes) in many more toxic than ordinary texts that have no shorter such gram inside."""
    found = []
    for t in toxic:
        g = _grams(t, size)
        # a gram longer than the shortest lies within a word, with or without the spaces around it
        gaps = np.cumsum(np.r_[0, np.frombuffer(b" " + t.translate(SPACED), np.uint8) == 32])
        free = gaps[size - 1 : size - 1 + len(g)] == gaps[1 : 1 + len(g)] if shorter else np.ones(len(g), bool)
        for n, known in shorter:
            begun = np.zeros(len(t) + 2, np.int64)  # shorter grams that begin before each place
            hit = _place(_grams(t, n), known) >= 0
            begun[1 : len(hit) + 1] = np.cumsum(hit)
            free &= begun[size - n + 1 : size - n + 1 + len(g)] == begun[: len(g)]
        found.append(np.unique(g[free]))
    seen, bad = np.unique(np.concatenate(found), return_counts=True)
    often = bad >= max(4, len(toxic) // RARE)
    seen, bad = seen[often], bad[often]
    good = np.zeros(len(seen) + 1, np.int64)  # the last place takes all other grams
    for t in ordinary:
        good[np.unique(_place(_grams(t, size), seen))] += 1
    odds = (bad + 0.5) / (len(toxic) + 1) / ((good[:-1] + 0.5) / (len(ordinary) + 1))
    return seen[odds > min(ODDS, len(ordinary) / 2)]


def _runs(inside: np.ndarray) -> list[tuple[int, int]]:
    turns = np.flatnonzero(np.diff(np.r_[False, inside, False])).tolist()
    return list(zip(turns[::2], turns[1::2]))


def _passages(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """Words with grams that set toxic texts apart, and spans of such grams across words, those of most texts last."""
    toxic = _distinct(toxic)
    telling: list[tuple[int, np.ndarray]] = []
    for size in GRAMS:
        telling.append((size, _telling(toxic, ordinary, size, telling)))
    texts: Counter[bytes] = Counter()
    for t in toxic:
        t = b" " + t.translate(SPACED) + b" "
        gaps = np.cumsum(np.r_[0, np.frombuffer(t, np.uint8) == 32])
        spaces = np.flatnonzero(np.diff(gaps))
        edge = np.zeros((2, len(t) + 1), np.int64)  # grams within a word, grams across words
        for size, known in telling:
            at = np.flatnonzero(_place(_grams(t[1:], size), known) >= 0)
            across = (gaps[at + size - 1] > gaps[at + 1]).astype(int)
            edge[across, at] += 1
            edge[across, at + size] -= 1
        inside = np.cumsum(edge, axis=1)[:, :-1] > 0
        found = set()
        for i, j in _runs(inside[0]):
            left = int(spaces[np.searchsorted(spaces, i, "right") - 1])
            right = int(spaces[np.searchsorted(spaces, j - 1)]) + 1
            found.add(t[max(left, i - REACH) : min(right, j + REACH)])
        found.update(t[i:j] for i, j in _runs(inside[1]) if not inside[0, i:j].any())
        texts.update(found)
    out, held = b"", set()
    for p, n in sorted(texts.items(), key=lambda x: (-x[1], x[0])):
        new = {(size, g) for size, known in telling for g in _place(_grams(p, size), known).tolist() if g >= 0} - held
        if p not in out and (new or n >= SEVERAL) and len(out) + len(p) <= TOXIC_BYTES:
            out, held = p + out, held | new
    return out


def _dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary; too few samples are a dictionary themselves."""
    if sum(map(len, samples)) > size:
        try:
            return zstandard.train_dictionary(size, samples, k=k, d=d, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        compression_params=zstandard.ZstdCompressionParameters.from_level(
            LEVEL, search_log=SEARCH_LOG, write_checksum=False, write_content_size=False, write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        ),
    )


class Distance:
    """Bytes that the toxic dictionary saves, for each window of a text (0 to MOST)."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.plain, self.both = _compressor(ordinary), _compressor(toxic + ordinary)

    def __call__(self, text: bytes) -> np.ndarray:
        saved = [len(self.plain.compress(w)) - len(self.both.compress(w)) for w in windows(text.lower())]
        return np.clip(saved, 0, MOST)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    gains: list[float]  # log mixture ratio of a window by distance
    slope: float
    shift: float


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one variable (Newton steps, a little ridge)."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(w * (y - p) * x).sum() - 1e-2 * (a - 1), (w * (y - p)).sum() - 1e-3 * b])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-6), float(b)


def train(toxic: list[bytes], ordinary: list[bytes], shares: tuple[int, int]) -> Model | None:
    """``shares``: how many rows are labelled (toxic, ordinary) in all."""
    if len(toxic) < 3 or len(ordinary) < 3:
        return None
    toxic, ordinary = [t.lower() for t in toxic], [t.lower() for t in ordinary]
    learn = lambda part: [t for i, t in enumerate(part) if i % 3 < 2]
    bad = _passages(learn(toxic), learn(ordinary))
    pool = [w for t in learn(ordinary) for w in windows(t)]
    pick = np.random.default_rng(1).permutation(len(pool))[: ORDINARY_BYTES // 10]
    good = _dictionary([pool[i] for i in pick], ORDINARY_BYTES, 64, 8)
    far = Distance(good, bad)
    held = [[far(t) for t in part[2::3]] for part in (toxic, ordinary)]
    counts = [np.bincount(np.concatenate(x), minlength=MOST + 1) + 0.5 for x in held]
    ratio = np.maximum.accumulate((counts[0] / counts[0].sum()) / (counts[1] / counts[1].sum()))
    gains = np.log1p(SHARE * (ratio - 1))
    x = np.array([gains[d].sum() for part in held for d in part])
    y = np.r_[np.ones(len(held[0])), np.zeros(len(held[1]))]
    w = np.r_[np.full(len(held[0]), MISS_COST * shares[0] / len(held[0])), np.full(len(held[1]), shares[1] / len(held[1]))]
    slope, shift = _logistic(x, y, w * len(x) / w.sum())
    return Model(good, bad, gains.tolist(), slope, shift)


def held_out(id_col: str) -> Column:
    """Whether the id's crc32 is divisible by HELD_OUT (a null id counts as 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % HELD_OUT == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    )
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = lambda t, n: known.where(F.col("toxic") == t).orderBy(F.xxhash64(id_col), id_col).limit(n)
    chosen = pick(1, TOXIC_ROWS).union(pick(0, ORDINARY_ROWS))  # bounded, so it may be broadcast and collected
    rows = sample(docs, chosen, id_col, text_col).select("toxic", F.xxhash64("i").alias("h"), "t").collect()
    rows.sort(key=lambda r: (r["h"], r["t"]))
    of = lambda t: [bytes(r["t"]) for r in rows if r["toxic"] == t]
    return train(of(1), of(0), (shares.get(1, 0), shares.get(0, 0)))


def scored(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, score (0 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = Distance(model.ordinary, model.toxic) if model else None
        gains = np.array(model.gains) if model else None
        for batch in batches:
            scores = []
            for t in batch.column(1):
                if far is None:
                    scores.append(0.0)
                    continue
                x = float(gains[far(t.as_buffer().to_pybytes() if t.is_valid else b"")].sum())
                scores.append(1 / (1 + math.exp(-max(-40.0, min(40.0, model.slope * x + model.shift)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, score double")


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose score is below one half.

    Rows are found again by their position, so the input must be a stored table.
    """
    (row,) = private(df, "row")
    tagged = df.withColumn(row, F.monotonically_increasing_id())
    gone = scored(tagged, fit(df, labels, id_col, text_col), row, text_col).where("score >= 0.5")
    return tagged.join(gone.select(F.col("id").alias(row)), row, "left_anti").drop(row)


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    done = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return done.select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
