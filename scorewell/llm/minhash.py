r"""Near-duplicate documents: HyperMinHash sketches, banding, and exact confirmation.

Sketch.  A document's set of word shingles is hashed once per band.  The band's
hash space is cut into ROWS buckets and each bucket stores its smallest hash in
16 bits, as a HyperMinHash register: the count of leading zeros (6 bits) and the
10 bits after the leading one.  A band's ROWS registers together are its key.

Candidates.  Documents with the same set are one class; only one representative
of each is compared.  Two sets of similarity s meet in a band with a chance of
s^ROWS, so they miss every band with (1 - s^ROWS)^BANDS: 1.8e-8 at 0.8.  Buckets
are never expanded into all pairs:

1. every member of a bucket is compared with the bucket's smallest member;
2. the links found make components; a bucket whose members lie in one component
   is settled.  In the others, members of different components are compared,
   so a link is skipped only if both its ends are already connected, which
   changes no component.  Buckets of up to FEW members do this as pairs.  In
   larger ones the members outside the bucket's main component meet all members
   in cells of bounded size, where one matrix product counts what any two sets
   share; only links leave a cell.

Confirmation.  The similarity is first estimated from all registers, corrected
for registers that agree by accident; pairs whose estimate is six standard errors
below the threshold go.  The rest are confirmed on the full sets.

Everything moves as keyed joins and aggregates.  Row numbers are positions in
the scan, so the input must be a stored table.

Defined results: null and empty texts and texts without words have an empty set
and are linked with nothing; a text with fewer words than a shingle has one
shingle, its whole sequence; texts of any length are used whole; rows with a
repeated or null id are documents of their own (a component's id is its smallest
id that isn't null); an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm.common import map_arrow, private, stored, table
from scorewell.llm.components import components
from scorewell.llm.hashing import mix, segment_hashes

BANDS, ROWS = 45, 5
SHINGLE, PERCENT = 5, 80
#: Members up to which an open bucket is compared as pairs; above that, shingles and sets on one side of a cell.
FEW, CELL, CELL_SETS = 16, 400_000, 1000
COLUMNS = 4096  # shingles of a cell multiplied at once
CHUNK = 1 << 20
EMPTY = np.uint16(0xFFFF)
WIDTH = np.uint64(2**64 // ROWS)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_XOR = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat = b"\n".join(texts).translate(LOWER)
    raw = np.frombuffer(flat, np.uint8)
    if not len(raw):
        return [np.zeros(0, np.uint64) for _ in texts]
    inside = _WORD[raw]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = segment_hashes(_BYTE[raw], starts, ends)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    cut = np.r_[np.searchsorted(starts, begins), len(words)]
    if len(words) >= k:
        sh = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            sh = sh * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j]
        sh = mix(sh)
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a >= k:
            s = np.sort(sh[a : b - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for w in range(a, b):
                one = one * np.uint64(0xC2B2AE3D27D4EB4F) + words[w : w + 1]
            out.append(mix(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, BANDS * ROWS) 16-bit registers of non-empty sets."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat = np.concatenate(sets)
    low = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for j in range(BANDS):
        h = (flat ^ _XOR[j]) * _MUL[j]
        h ^= h >> np.uint64(32)
        h *= _MUL[BANDS - 1 - j]
        for q in range(ROWS):
            low[:, j * ROWS + q] = np.minimum.reduceat(h - np.uint64(q) * WIDTH, starts)
    none = low >= WIDTH
    bits = (low * np.uint64(ROWS)).astype(np.float64).view(np.uint64)
    exponent = (bits >> np.uint64(52)).astype(np.int64) - 1023
    zeros = np.clip(63 - exponent, 0, 62)
    out = ((zeros << 10) | ((bits >> np.uint64(42)) & np.uint64(1023)).astype(np.int64)).astype(np.uint16)
    out[none] = EMPTY
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about CHUNK bytes of text (column 1)."""
    for batch in batches:
        texts, first, size = [], 0, 0
        column = batch.column(1)
        for i in range(batch.num_rows):
            t = column[i]
            t = t.as_buffer().to_pybytes() if t.is_valid else b""
            if texts and size + len(t) > CHUNK:
                yield batch.slice(first, i - first), texts
                texts, first, size = [], i, 0
            texts.append(t)
            size += len(t)
        if texts:
            yield batch.slice(first), texts


def sketches(df: DataFrame, row: str, id_col: str, text_col: str, k: int) -> DataFrame:
    """One row per row: row, id, n (set size), two set digests, registers (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _chunks(batches):
            sets = shingle_sets(texts, k)
            full = [i for i, s in enumerate(sets) if len(s)]
            regs: list[bytes | None] = [None] * len(sets)
            if full:
                made = registers([sets[i] for i in full])
                for i, r in zip(full, made):
                    regs[i] = r.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                    pa.array([int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) for s in sets], pa.int64()),
                    pa.array(regs, pa.binary()),
                ],
                ["row", "id", "n", "h1", "h2", "regs"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(
        df.select(row, text_col, F.col(id_col).alias("_id")), run, f"row bigint, id {kind}, n bigint, h1 bigint, h2 bigint, regs binary"
    )


def set_table(df: DataFrame, row: str, text_col: str, k: int) -> DataFrame:
    """The full sets (row, set as an array of distinct hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _chunks(batches):
            sets = shingle_sets(texts, k)
            offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["row", "set"]
            )

    return map_arrow(df.select(row, text_col), run, "row bigint, set array<bigint>")


def plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs whose estimated similarity may reach the threshold; in: a, b, ra, rb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accident = 1 / 3 / 1024  # two independent minima: same count of zeros, same mantissa bits
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in (2, 3)
            )
            used = ((x != EMPTY) | (y != EMPTY)).sum(1)
            same = ((x == y) & (x != EMPTY)).sum(1)
            j = (same / used - accident) / (1 - accident)
            t = percent / 100
            ok = pa.array(j >= t - 6 * np.sqrt(t * (1 - t) / used))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return map_arrow(pairs.select("a", "b", "ra", "rb"), run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs whose full sets are similar enough; in: a, b, sa, sb (a row at a time, in the JVM)."""
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("both")).where(
        F.col("common") * 100 >= (F.col("both") - F.col("common")) * percent
    ).select("a", "b")


def _linked(pairs: DataFrame, inside: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The confirmed links among candidate pairs (a, b)."""
    r = inside.select("row", "regs")
    likely = plausible(pairs.join(r.toDF("a", "ra"), "a").join(r.toDF("b", "rb"), "b"), percent)
    full = likely.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return stored(confirmed(full, percent), name)


def _common(q: list[np.ndarray], t: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of ``q`` shares with each set of ``t``."""
    names = np.concatenate(q + t)
    owner = np.repeat(np.arange(len(q) + len(t)), [len(x) for x in q + t])
    _, column, n = np.unique(names, return_inverse=True, return_counts=True)
    left = owner < len(q)
    both = (np.bincount(column[left], minlength=len(n)) > 0) & (np.bincount(column[~left], minlength=len(n)) > 0)
    shared = both[column]
    column = (np.cumsum(both) - 1)[column[shared]]
    owner, out = owner[shared], np.zeros((len(q), len(t)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    cuts = np.searchsorted(column, np.arange(0, int(both.sum()) + COLUMNS, COLUMNS))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        m = np.zeros((len(q) + len(t), COLUMNS), np.float32)
        m[owner[a:b], column[a:b] - i * COLUMNS] = 1
        out += m[: len(q)] @ m[len(q) :].T
    return out.astype(np.int64)


def _cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside cells; in: key, qb, tb, query, row, part, set, a cell's rows one after the other."""

    def links(rows: list[tuple]) -> tuple[list[int], list[int]]:
        q, t = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if not q or not t:
            return [], []
        common = _common([r[3] for r in q], [r[3] for r in t])
        size = [np.array([len(r[3]) for r in x]) for x in (q, t)]
        row, part = ([np.array([r[k] for r in x]) for x in (q, t)] for k in (1, 2))
        hit = 100 * common >= percent * (size[0][:, None] + size[1] - common)
        hit &= part[0][:, None] != part[1]
        i, j = np.nonzero(hit)
        x, y = row[0][i], row[1][j]
        return np.minimum(x, y).tolist(), np.maximum(x, y).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            rest = [batch.column(c).to_pylist() for c in (3, 4, 5)]
            for i, key in enumerate(keys):
                if key != now:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(rows)], ["a", "b"])
                    now, rows = key, []
                rows.append((*(c[i] for c in rest), batch.column(6)[i].values.to_numpy().view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(rows)], ["a", "b"])

    return map_arrow(
        cells.select("key", "qb", "tb", "query", "row", "part", "set"), run, "a bigint, b bigint"
    ).distinct()


def _large_buckets(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside the open buckets of more than FEW members."""
    parts = left.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    main = parts.groupBy("key").agg(
        F.max(F.struct("c", "part", "s")).alias("main"), F.sum("s").alias("all_n"), F.sum("c").alias("all_c")
    )
    blocks = lambda n, c: F.ceil(F.greatest(n / CELL, c / CELL_SETS)).cast("int")
    main = main.select(
        "key", F.col("main.part").alias("main"),
        blocks(F.col("all_n") - F.col("main.s"), F.col("all_c") - F.col("main.c")).alias("nq"),
        blocks(F.col("all_n"), F.col("all_c")).alias("nt"),
    )
    rows = left.join(main, "key")
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    query = rows.where("part <> main").select(
        "key", block(1, "nq").alias("qb"), every("nt").alias("tb"), F.lit(True).alias("query"), "row", "part"
    )
    target = rows.select(
        "key", every("nq").alias("qb"), block(2, "nt").alias("tb"), F.lit(False).alias("query"), "row", "part"
    )
    cell = ["key", "qb", "tb"]
    cells = query.union(target).join(sets, "row").repartition(*cell).sortWithinPartitions(*cell)
    return _cell_links(cells, percent)


def classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT,
    row: str | None = None,
) -> DataFrame:
    """One row per row of ``df``: row, id, n, component (its smallest id), first (the row that has it)."""
    if row is None:
        (row,) = private(df, "row")
        df = df.withColumn(row, F.monotonically_increasing_id())
    docs = stored(sketches(df, row, id_col, text_col, k), "sketches")
    same = ["n", "h1", "h2"]
    # one representative for each different set
    reps = stored(
        docs.where("n > 0").groupBy(*same).agg(F.min("row").alias("row"), F.min("regs").alias("regs")), "sketch-reps"
    )
    width = 2 * ROWS
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda j: F.xxhash64(j, F.substring(F.col("regs"), j * width + 1, F.lit(width))),
    )
    bands = reps.select("row", "n", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.min("row").alias("hub"), F.max("row").alias("last")).where("hub < last")
    members = stored(bands.join(shared.select("key", "hub"), "key"), "band-members")
    # registers and sets of the documents that share a bucket with another one
    inside = stored(reps.join(members.select("row").distinct(), "row", "left_semi").select("row", "regs"), "band-sketches")
    texts = df.select(row, text_col).join(inside.select(F.col("row").alias(row)), row, "left_semi")
    sets = stored(set_table(texts, row, text_col, k), "shingle-sets")
    near = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    n_of = reps.select("row", "n")
    star = members.where("row <> hub").select(F.col("hub").alias("a"), F.col("row").alias("b"), F.col("n").alias("nb"))
    star = star.distinct().join(n_of.toDF("a", "na"), "a").where(near(F.col("na"), F.col("nb"))).select("a", "b")
    links = _linked(star, inside, sets, percent, "links-1")
    # buckets that hold more than one component
    parts = components(links, "a", "b")
    labelled = members.join(parts.toDF("row", "part"), "row", "left").withColumn("part", F.coalesce("part", "row"))
    open_ = labelled.groupBy("key").agg(
        F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("size")
    ).where("p < q")
    left = stored(
        labelled.join(open_.select("key", "size"), "key").select("key", "row", "n", "part", "hub", "size"), "open-buckets"
    )
    few = left.where(F.col("size") <= FEW)
    x = few.select("key", F.col("row").alias("a"), F.col("n").alias("na"), F.col("part").alias("pa"), "hub")
    y = few.select("key", F.col("row").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"))
    rest = (
        x.join(y, "key")
        .where((F.col("pa") != F.col("pb")) & (F.col("a") < F.col("b")) & (F.col("a") != F.col("hub"))
               & near(F.col("na"), F.col("nb")))
        .select("a", "b").distinct()
    )
    more = _linked(rest, inside, sets, percent, "links-2")
    most = stored(_large_buckets(left.where(F.col("size") > FEW), sets, percent), "links-3")
    parts = components(links.union(more).union(most), "a", "b")
    # back to all rows
    label = reps.join(parts.toDF("row", "part"), "row", "left").select(
        *same, F.coalesce("part", "row").alias("part")
    )
    of_row = docs.select("row", "id", *same).join(label, same, "left").withColumn(
        "part", F.coalesce("part", "row")
    )
    least = of_row.groupBy("part").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))).alias("best")
    )
    return of_row.join(least, "part").select(
        "row", "id", "n", F.col("best.id").alias("component"), F.col("best.row").alias("first")
    )


def drop_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``df`` that stay: of each component the row with the smallest id."""
    (row,) = private(df, "row")
    tagged = df.withColumn(row, F.monotonically_increasing_id())
    gone = classes(tagged, id_col, text_col, k, percent, row).where("row <> first").select(F.col("row").alias(row))
    return tagged.join(gone, row, "left_anti").drop(row)


def op5_minhash(spark, sf_dir):
    found = classes(table(spark, sf_dir, "documents"), k=2)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )
