"""Packing: first-fit decreasing with a tournament tree, in randomised groups of documents.

Documents are scattered by a seeded hash and each task packs its rows in groups
of about GROUP_TOKENS tokens, one group in memory at a time.  A document's tokens
are its ids and the end id.  In a group:

1. a document of at least a sequence's length gives its full sequences first;
2. the rests go, longest first, into the first sequence with room; a tournament
   tree over the free capacities finds it in as many steps as the tree is high;
3. free room left over is filled with tokens cut from the emptiest sequences,
   until at most one sequence is not full; that one is cut into sequences whose
   lengths are powers of two, which need no padding.

So each group is packed without padding, and few documents are cut (other than
those longer than a sequence).  A group's sequences get ids from the task's
partition and a counter, and rows are sorted before they are grouped, so a lost
task makes the same sequences again.  The scatter depends on the id and the
row's position, so repeated ids don't gather; the input must be a stored table.

Ids come from ``tiktoken`` over the same byte-level vocabulary (several times as
fast as ``tokenizers``, with equal ids; tested).  Texts that spell a special token
of the vocabulary file go to ``tokenizers`` itself, which gives them that id.

Defined results: null text counts as empty, so it gives the end id alone; long
texts are encoded and packed whole; repeated rows are packed each for itself; an
empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm.common import map_arrow, table

SEQUENCE = 2048
GROUP_TOKENS = 1 << 21
END_ID = 1
SEED = 77
SCHEMA = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "sequence_length bigint"
)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str):
    """text -> array of ids, as ``tokenizers`` with ``vocabulary`` gives them without special tokens."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as f:
        by_rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_rank, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    return encode


class Tournament:
    """Free capacities of ``n`` bins; the first bin with enough room, from the left."""

    def __init__(self, n: int, capacity: int) -> None:
        self.size = 1 << max(0, (n - 1)).bit_length()
        self.best = [0] * (2 * self.size)
        for i in range(n):
            self.best[self.size + i] = capacity
        for i in range(self.size - 1, 0, -1):
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def take(self, need: int) -> int:
        best, i = self.best, 1
        while i < self.size:
            i *= 2
            if best[i] < need:
                i += 1
        best[i] -= need
        bin_ = i - self.size
        while i > 1:
            i //= 2
            new = max(best[2 * i], best[2 * i + 1])
            if best[i] == new:
                break
            best[i] = new
        return bin_


def pack(lengths: list[int], capacity: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length) for documents of these lengths."""
    full, rests = [], []
    for d, n in enumerate(lengths):
        cut = n - n % capacity
        full += [[(d, s, capacity)] for s in range(0, cut, capacity)]
        if n > cut:
            rests.append((n - cut, d, cut))
    rests.sort(key=lambda x: (-x[0], x[1]))
    bins: list[list[tuple[int, int, int]]] = []
    if rests:
        tree = Tournament(len(rests), capacity)
        for n, d, start in rests:
            at = tree.take(n)
            if at == len(bins):
                bins.append([])
            bins[at].append((d, start, n))
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: -fill[i])
    left, right = 0, len(order) - 1
    while left < right:
        to, give = order[left], order[right]
        room = capacity - fill[to]
        if not room:
            left += 1
        elif not bins[give]:
            right -= 1
        else:
            d, start, n = bins[give].pop()
            part = min(n, room)
            bins[to].append((d, start, part))
            fill[to] += part
            fill[give] -= part
            if part < n:
                bins[give].append((d, start + part, n - part))
    out = full + [b for b, f in zip(bins, fill) if f == capacity]
    for b, f in zip(bins, fill):
        if 0 < f < capacity:
            out += _powers(b, f)
    return out


def _powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces as sequences of lengths that are powers of two, largest first."""
    out, todo = [], pieces[::-1]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        seq = []
        while room:
            d, start, n = todo.pop()
            part = min(n, room)
            seq.append((d, start, part))
            room -= part
            if part < n:
                todo.append((d, start + part, n - part))
        out.append(seq)
    return out


def packed(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = SEQUENCE,
    group_tokens: int = GROUP_TOKENS,
    paths: tuple[str, str] | None = None,
    with_ids: bool = False,
    seed: int = SEED,
) -> DataFrame:
    """One row per piece: the document's id, start, length, checksum of its ids, the
    document's token count, sequence, offset there and the sequence's length; with
    ``with_ids`` the ids too.
    """
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(*paths), np.array([END_ID], np.uint32)
        part = TaskContext.get().partitionId()
        made, ids_type = 0, None
        names, docs, size = [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made, names, docs, size
            rows = []
            for seq in pack([len(x) for x in docs], capacity):
                at, whole = 0, sum(n for *_, n in seq)
                for d, start, n in seq:
                    rows.append((d, start, n, (part << 32) + made, at, whole))
                    at += n
                made += 1
            piece = [docs[r[0]][r[1] : r[1] + r[2]] for r in rows]
            cols = [
                pa.array(names, ids_type).take(pa.array([r[0] for r in rows], pa.int64())),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in piece], pa.int64()),
                pa.array([len(docs[r[0]]) for r in rows], pa.int64()),
                *[pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4, 5)],
            ]
            labels = ["id", *[x.split()[0] for x in SCHEMA.split(", ")]]
            if with_ids:
                cols.append(pa.array([x.astype(np.int32) for x in piece], pa.list_(pa.int32())))
                labels.append("ids")
            names, docs, size = [], [], 0
            yield pa.RecordBatch.from_arrays(cols, labels)

        for batch in batches:
            ids_type = batch.schema.field(0).type
            for i in range(batch.num_rows):
                ids = np.concatenate([encode(batch.column(1)[i].as_py() or ""), end])
                names.append(batch.column(0)[i])
                docs.append(ids)
                size += len(ids)
                if size >= group_tokens:
                    yield from close()
        if docs:
            yield from close()

    key = F.xxhash64(F.lit(seed), F.col(id_col), F.monotonically_increasing_id())
    mixed = df.select(F.col(id_col), F.col(text_col), key.alias("_key"))
    mixed = mixed.repartition("_key").sortWithinPartitions("_key", id_col).select(id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(mixed, run, f"id {kind}, {SCHEMA}" + (", ids array<int>" if with_ids else ""))


def op2_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
