"""SentencePiece encoding and decoding by vectorised merge rounds.

A batch of texts becomes one flat array of code points, cut into segments that
no piece can cross (before the word mark, and around characters that no longer
piece has).  Each different segment of a batch is encoded once.  All of them
merge together: in a round every segment finds its best pair (a segmented
minimum of pair ranks), merges that pair's occurrences from the left without
overlap, and the arrays are compacted; segments without a pair leave.  The
rounds end when none is left.

Merging all occurrences at once equals the library's one-by-one order unless the
merged piece can at once join a neighbour at the same or a better rank; for such
pieces (found from the vocabulary) a round merges the leftmost occurrence only.

Characters without a piece become byte pieces.  Decoding joins the pieces' bytes,
turns the word mark into a space and drops the one that encoding put in front;
bytes that aren't UTF-8 become U+FFFD.

Defined results: null and empty texts have no ids and decode to an empty text;
texts of any length are encoded whole (a batch works on about CHUNK code points,
a longer text alone); repeated rows give repeated rows; columns besides id and
text are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scorewell.llm.common import map_arrow, table
from scorewell.llm.hashing import mix, segment_hashes

CHUNK = 1_000_000
SPACE = 0x2581
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NONE = np.int32(2**31 - 1)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[i : i + n]
            i += n


class PairTable:
    """Piece pairs to (rank, merged piece): open addressing over whole arrays."""

    def __init__(self, left, right, rank, merged) -> None:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(10, int(len(key)).bit_length() + 2)
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        at, todo = self._slot(key), np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            spot = at[todo]
            free = self.keys[spot] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(spot, return_index=True)[1]] = True
            put = free & first
            self.keys[spot[put]], self.rank[spot[put]], self.merged[spot[put]] = (
                key[todo[put]], rank[todo[put]], merged[todo[put]],
            )
            todo = todo[~put]
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged) of each pair; NONE without one.  Negative symbols have no pair."""
        key = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(key)
        got = self.keys[at]
        rank, merged = np.where(got == key, self.rank[at], NONE), self.merged[at]
        empty = np.uint64(2**64 - 1)
        more = np.flatnonzero((got != key) & (got != empty))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            got = self.keys[at[more]]
            hit = got == key[more]
            rank[more[hit]], merged[more[hit]] = self.rank[at[more[hit]]], self.merged[at[more[hit]]]
            more = more[~hit & (got != empty)]
        return rank, merged


class PieceModel:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            message = f.read()
        texts, scores, kinds, norm = [], [], [], {}
        for field, value in _fields(message):
            if field == 1:
                piece = dict(_fields(value))
                texts.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif field == 3:
                norm = dict(_fields(value))
        if norm.get(1) != b"identity" or norm.get(4, 1) or not norm.get(3, 1) or set(kinds) - {1, 2, 3, 6}:
            raise ValueError("expected identity normalisation, a dummy prefix and no user-defined or unused pieces")
        kinds = np.array(kinds)
        self.texts, self.unknown = texts, int(np.flatnonzero(kinds == UNKNOWN)[0])
        normal = np.flatnonzero(kinds == NORMAL)
        ids = {texts[i]: int(i) for i in normal}
        ranks = np.full(len(texts), NONE, np.int32)
        ranks[normal] = np.unique(-np.array(scores)[normal], return_inverse=True)[1]
        self.single = np.full(0x110000, -1, np.int32)
        joins = np.zeros(0x110000, bool)  # characters of longer pieces
        pairs = []
        crosses = False
        for t, i in ids.items():
            if len(t) == 1:
                self.single[ord(t)] = i
                continue
            joins[[ord(c) for c in t]] = True
            crosses |= chr(SPACE) in t.lstrip(chr(SPACE))
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    pairs.append((a, b, ranks[i], i))
        self.joins, self.crosses = joins, crosses
        left, right, rank, merged = (np.array(x, np.int32) for x in zip(*pairs))
        self.table = PairTable(left, right, rank, merged)
        self.hasty = np.zeros(len(texts), bool)
        self.hasty[left[rank <= ranks[left]]] = True
        self.hasty[right[rank <= ranks[right]]] = True
        self.byte_id = np.full(256, self.unknown, np.int32)
        self.has_bytes = bool((kinds == BYTE).any())
        self.out = []
        for i, t in enumerate(texts):
            if kinds[i] == BYTE:
                self.byte_id[int(t[3:5], 16)] = i
                self.out.append(bytes([int(t[3:5], 16)]))
            else:
                self.out.append(b"" if kinds[i] == CONTROL else b" \xe2\x81\x87 " if kinds[i] == UNKNOWN
                                else t.replace(chr(SPACE), " ").encode())
        self.decimal = [b"%d," % i for i in range(len(texts))]

    # -- encoding
    def _merge(self, sym: np.ndarray, seg: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of ``n`` segments (numbered by ``seg``, in order) to final (symbols, counts)."""
        done_seg, done_sym = [], []
        rank, merged = self._pairs(sym, seg)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            live = best != NONE
            if not live.all():
                on = np.repeat(live, sizes)
                done_seg.append(seg[~on])
                done_sym.append(sym[~on])
                sym, seg, rank, merged = sym[on], seg[on], rank[on], merged[on]
                if not len(sym):
                    break
                best, sizes = best[live], sizes[live]
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            run = np.r_[True, hit[1:] != hit[:-1] + 1]
            from_run = hit - hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
            take = hit[from_run % 2 == 0]
            hasty = self.hasty[merged[take]]
            if hasty.any():
                first = np.r_[True, seg[take[1:]] != seg[take[:-1]]]
                take = take[first | ~np.isin(seg[take], seg[take[hasty]])]
            sym[take] = merged[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            place = np.cumsum(keep) - 1
            sym, seg, rank, merged = sym[keep], seg[keep], rank[keep], merged[keep]
            at = place[take]
            near = np.unique(np.r_[at, at[at > 0] - 1])
            rank[near], merged[near] = self._pairs(sym, seg, near)
        if not done_seg:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        segs, syms = np.concatenate(done_seg), np.concatenate(done_sym)
        order = np.argsort(segs, kind="stable")
        return syms[order], np.bincount(segs, minlength=n)

    def _pairs(self, sym, seg, at=None):
        at = np.arange(len(sym)) if at is None else at
        nxt = np.minimum(at + 1, len(sym) - 1)
        can = (nxt > at) & (seg[at] == seg[nxt]) & (sym[at] >= 0) & (sym[nxt] >= 0)
        rank, merged = np.full(len(at), NONE, np.int32), np.zeros(len(at), np.int32)
        rank[can], merged[can] = self.table.find(sym[at[can]], sym[nxt[can]])
        return rank, merged

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        group: list[str] = []
        size = 0
        for t in texts:
            if group and size + len(t) >= CHUNK:
                out += self._encode(group)
                group, size = [], 0
            group.append(t)
            size += len(t) + 1
        return out + (self._encode(group) if group else [])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        mark = chr(SPACE)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts])
        flat = "".join(mark + t if t else "" for t in texts)
        cps = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        if not len(cps):
            return [np.zeros(0, np.int32) for _ in texts]
        cps[cps == 32] = SPACE
        begin = np.zeros(len(cps), bool)
        begin[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        alone = ~self.joins[cps]
        begin |= alone
        begin[1:] |= alone[:-1]
        if not self.crosses:
            space = cps == SPACE
            begin[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(begin)
        ends = np.r_[starts[1:], len(cps)]
        size = ends - starts
        # each different segment once
        name = segment_hashes(mix(cps.astype(np.uint64) + np.uint64(1)), starts, ends)
        _, first, which = np.unique(name, return_index=True, return_inverse=True)
        # equal hashes share a result only where the segments are equal, too
        shift = np.repeat(starts[first][which] - starts, size)
        like = np.minimum(np.arange(len(cps)) + shift, len(cps) - 1)
        other = np.flatnonzero((size[first][which] != size) | np.logical_or.reduceat(cps != cps[like], starts))
        which[other] = len(first) + np.arange(len(other))
        first = np.r_[first, other]
        n = len(first)
        u_size = size[first]
        total = int(u_size.sum())
        seg = np.repeat(np.arange(n, dtype=np.int32), u_size)
        at = np.arange(total) + np.repeat(starts[first] - (np.cumsum(u_size) - u_size), u_size)
        chars = cps[at]
        known = self.single[chars]
        sym = np.where(known >= 0, known, -1 - chars).astype(np.int32)
        sym, count = self._merge(sym, seg, n)
        ids, count = self._spell(sym, count)
        # back to every occurrence
        u_start = np.cumsum(count) - count
        occ = count[which]
        flat_ids = ids[np.arange(int(occ.sum())) + np.repeat(u_start[which] - (np.cumsum(occ) - occ), occ)]
        tokens_before = np.r_[0, np.cumsum(occ)]
        seg_of_doc = np.searchsorted(starts, np.r_[0, np.cumsum(lengths)])
        cut = tokens_before[seg_of_doc]
        return [flat_ids[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def _spell(self, sym: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece as byte pieces."""
        odd = np.flatnonzero(sym < 0)
        if not len(odd):
            return sym, count
        raw = [chr(-1 - int(s)).encode("utf-8", "surrogatepass") for s in sym[odd]]
        if not self.has_bytes:
            sym = sym.copy()
            sym[odd] = self.unknown
            return sym, count
        extra = np.ones(len(sym), np.int64)
        extra[odd] = [len(x) for x in raw]
        ids = np.repeat(sym, extra)
        ids[np.repeat(sym < 0, extra)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(count)), count)
        return ids, np.bincount(owner, weights=extra, minlength=len(count)).astype(np.int64)

    # -- decoding
    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " and ids[0] != self.unknown else text


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row: id, ids (array of int), decoded text."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for ids, lists in _batches(m, batch):
                flat = np.concatenate([np.zeros(0, np.int32), *lists])
                offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.ListArray.from_arrays(offsets, flat), pa.array([m.decode(x.tolist()) for x in lists], pa.string())],
                    ["id", "ids", "decoded"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, ids array<int>, decoded string")


def _batches(m: PieceModel, batch: pa.RecordBatch, rows: int = 256) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        yield part.column(0), m.encode([t or "" for t in part.column(1).to_pylist()])


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row: id, n_tokens and the SHA-256 of ids and of the decoded text.

    The same encoding and decoding as ``encoded``; only the digests leave the task.
    """
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        sha = hashlib.sha256
        for batch in batches:
            for ids, lists in _batches(m, batch):
                lists = [x.tolist() for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([len(x) for x in lists], pa.int64()),
                        pa.array([sha(b"".join(map(m.decimal.__getitem__, x))[:-1]).hexdigest() for x in lists], pa.string()),
                        pa.array([sha(m.decode(x).encode()).hexdigest() for x in lists], pa.string()),
                    ],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(
        df.select(id_col, text_col), run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op6_sentencepiece(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
