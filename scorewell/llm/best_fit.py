"""Best-fit packing by minimum bin slack: whole documents in as few sequences as possible.

A document's tokens are its ids and the end id.  One of at most a sequence's length
stays whole; a longer one is cut into full sequences and a shorter first piece.
Pieces of one length are interchangeable, so the bins are chosen on the table of
lengths (at most ``capacity`` rows, however many documents there are):

1. the tokenizing pass writes one narrow row per piece, with its task's number and
   its place among the task's pieces of that length; no text is shuffled;
2. ``minimum_slack`` starts each bin with the longest piece left and finds the fullest
   feasible combination of the available lengths by a subset-sum over a bitset of
   reachable fills.  That combination is removed as often as the counts allow, as it
   stays the fullest one;
3. a piece's number among all of its length (tasks' counts added up) says which
   slot of which bin it takes, by a binary search in the table of slots.

So all documents are packed against each other, not in groups, and the driver's
work depends on ``capacity`` alone.  Padding is left only where the remaining
lengths have no better combination.  The piece table is written, so a lost task
finds the numbers that were given.

Defined results: null text counts as empty, so it gives the end id alone; long
texts are encoded whole; repeated rows (and a null id) are packed each for itself;
pieces of equal length take their slots in the order of tasks and rows; an empty
table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewell.llm.common import map_arrow, stored, table
from scorewell.llm.packing import SEQUENCE, default_paths, encoder

END_ID = 0
#: Pieces of a task that are handed over at once.
ROWS_AT_ONCE = 50_000


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the first may be shorter, where it is cut."""
    rest = n % capacity
    return ([rest] if rest else []) + [capacity] * (n // capacity)


def fullest(counts: dict[int, int], longest: list[int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the available lengths that fill ``room`` best.

    ``longest`` are the lengths in falling order.  Bit s of ``reach`` says that the
    lengths so far have a combination of sum s; a length enters in doubling
    multiples up to its count.  Of equal sums the one of longer pieces is taken.
    """
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for n in longest:
        if n > room:
            continue
        left, many = min(counts[n], room // n), 1
        while left:
            many = min(many, left)
            steps.append((n, many, reach))
            reach |= (reach << (n * many)) & mask
            left -= many
            many *= 2
            if reach & goal:
                break
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, Counter()
    for n, many, before in reversed(steps):
        if not before >> at & 1:
            out[n] += many
            at -= n * many
    return sorted(out.items(), reverse=True)


def minimum_slack(lengths: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for ``lengths`` (length -> count) as ([(length, how many), ...], bins like this)."""
    left = {n: c for n, c in lengths.items() if c}
    order = sorted(left, reverse=True)
    bins = []
    while order:
        seed = order[0]
        left[seed] -= 1
        chosen = Counter(dict(fullest(left, order, capacity - seed)))
        left[seed] += 1
        chosen[seed] += 1
        times = min(left[n] // many for n, many in chosen.items())
        for n, many in chosen.items():
            left[n] -= many * times
        bins.append((sorted(chosen.items(), reverse=True), times))
        order = [n for n in order if left[n]]
    return bins


class Slots:
    """Where the k-th piece of a length goes: sequence number and offset there."""

    def __init__(self, bins: list[tuple[list[tuple[int, int]], int]]) -> None:
        first, rows = 0, {}
        for content, times in bins:
            offset = 0
            for n, many in content:
                rows.setdefault(n, []).append((many * times, many, first, offset))
                offset += n * many
            first += times
        self.table = {}
        for n, r in rows.items():
            size, many, seq, off = (np.array(x, np.int64) for x in zip(*r))
            ends = np.cumsum(size)
            self.table[n] = ends - size, many, seq, off

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            n = int(length[at[0]])
            starts, many, first, offset = self.table[n]
            row = np.searchsorted(starts, number[at], "right") - 1
            k = number[at] - starts[row]
            seq[at] = first[row] + k // many[row]
            off[at] = offset[row] + k % many[row] * n
        return seq, off


def pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, paths: tuple[str, str], with_ids: bool) -> DataFrame:
    """One row per piece with its task and its place among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(*paths), np.array([END_ID], np.uint32)
        task, seen = TaskContext.get().partitionId(), Counter()
        labels = ["id", "piece", "start", "length", "ids_crc32", "task", "place"] + (["ids"] if with_ids else [])

        def frame(ids: pa.Array, at: list, rows: list, tokens: list) -> pa.RecordBatch:
            cols = [pa.array(x) for x in np.array(rows, np.int64).reshape(-1, 5).T]
            cols[0] = cols[0].cast(pa.int32())
            cols = [ids.take(pa.array(at, pa.int64())), *cols[:4], pa.array([task] * len(at), pa.int32()), cols[4]]
            if with_ids:
                cols.append(pa.array(tokens, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, labels)

        for batch in batches:
            at, rows, tokens = [], [], []
            for i in range(batch.num_rows):
                ids = np.concatenate([encode(batch.column(1)[i].as_py() or ""), end])
                start = 0
                for k, n in enumerate(piece_lengths(len(ids), capacity)):
                    part = ids[start : start + n]
                    rows.append((k, start, n, zlib.crc32(part.astype("<u4").tobytes()), seen[n]))
                    at.append(i)
                    if with_ids:
                        tokens.append(part.astype(np.int32))
                    seen[n] += 1
                    start += n
                if len(rows) >= ROWS_AT_ONCE:
                    yield frame(batch.column(0), at, rows, tokens)
                    at, rows, tokens = [], [], []
            if rows:
                yield frame(batch.column(0), at, rows, tokens)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, place bigint"
    return map_arrow(df.select(id_col, text_col), run, schema + (", ids array<int>" if with_ids else ""))


def packed(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = SEQUENCE,
    paths: tuple[str, str] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, checksum of its ids, sequence, offset
    there; with ``with_ids`` the ids too.
    """
    made = stored(pieces(df, id_col, text_col, capacity, paths or default_paths(), with_ids), "best-fit-pieces")
    per_task = stored(made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "best-fit-counts")
    # at most `capacity` rows
    lengths = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(minimum_slack(lengths, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = made.join(before, ["task", "length"]).withColumn("number", F.col("before") + F.col("place"))
    out = ["id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, off = slots.find(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            cols = [batch.column(c) for c in out] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(cols, [*out, "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return map_arrow(numbered.select(*out, "number"), run, schema + ", sequence_id bigint, offset bigint")


def op11_best_fit(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
