"""K-mer counts, vocabulary, sparse rows, total-count
normalization, log1p, class weights, label index — all as DataFrame programs.

Vector-valued steps (C6-C8, C11) that feed Spark ML live in
``scorewell.plans.estimators``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewell.functions.sequence import normalize_text
from scorewell.operators.rank import ordered_positions
from scorewell.session import map_arrow, materialize, ship_package

# Fixed value: total count each cell is scaled to before log1p.
TARGET_SUM = 1e4


#: Characters of text counted at once (a longer text is counted by itself).
CHARS_AT_ONCE = 1 << 18


def text_chunks(texts, most: int = CHARS_AT_ONCE):
    """(start, rows) of runs of an Arrow string array with about ``most`` bytes of text each."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to - at
        at = to


def kmers_of(texts, lo: int, hi: int):
    """(row of ``texts``, k-mer, count) as arrays for each k, of an Arrow array of normalized texts.

    A window's code is built from its characters' places in the alphabet found here.  Where row
    and longest window fit 64 bits, the longest windows of all texts (cut at their text's end) are
    sorted once, and shorter ones are read off as their beginnings.  Else all windows of a length
    are sorted together, their codes made dense when they would pass 64 bits with the row before
    them, so equal codes are equal k-mers.
    """
    import numpy as np
    import pyarrow.compute as pc

    texts = texts.fill_null("")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = "".join(texts.to_pylist())
    points = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    if not len(points):
        return
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    place = np.cumsum(seen).astype(np.uint32) - 1
    letters = place[points].astype(np.uint64)
    ascii_only = len(seen) <= 128
    shown = points.astype(np.uint8) if ascii_only else points
    letter_bits = np.uint64(int(seen.sum() - 1).bit_length())
    row_bits = (len(texts) - 1).bit_length()
    longest = min(hi, int(lengths.max()))
    if longest < lo:
        return
    kinds = int(seen.sum())
    if row_bits + longest * kinds.bit_length() <= 64:
        yield from _kmers_by_prefix(letters, lengths, np.flatnonzero(seen), lo, longest)
        return
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters up to the text's end
    code, bits = letters, int(letter_bits)
    for k in range(1, longest + 1):
        if k > 1:
            if row_bits + bits + int(letter_bits) > 64:
                some, code = np.unique(code, return_inverse=True)
                code, bits = code.astype(np.uint64), (len(some) - 1).bit_length()
            # windows across a text's end are dropped below
            code = (code[:-1] << letter_bits) | letters[k - 1 :]
            bits += int(letter_bits)
        if k < lo:
            continue
        whole = np.flatnonzero(left[: len(code)] >= k)
        key = (row[whole] << np.uint64(min(bits, 63))) | code[whole]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        at = whole[order[first]]
        names = _names(np.lib.stride_tricks.sliding_window_view(shown, k)[at], ascii_only)
        yield row[at].astype(np.int64), names, np.diff(np.r_[first, len(key)])


def _names(chars, ascii_only: bool):
    """An Arrow array of the strings that the rows of ``chars`` (code points) spell."""
    import numpy as np
    import pyarrow as pa

    n, k = chars.shape
    if ascii_only:
        data, ends = chars.tobytes(), np.arange(n + 1) * k
    else:
        data = chars.astype("<u4").tobytes().decode("utf-32-le").encode()
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        ends = np.r_[0, np.cumsum(width.sum(axis=1))]
    if len(data) < 1 << 31:
        return pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
    # one enormous text
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))


def _kmers_by_prefix(letters, lengths, alphabet, lo: int, hi: int):
    """``kmers_of`` from one sort: letters are counted from 1, and 0 stands for what is beyond a text's end."""
    import numpy as np

    bits = len(alphabet).bit_length()
    letters = letters + np.uint64(1)
    row = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(letters))  # characters up to the text's end
    key = (row << np.uint64(bits)) | letters
    for j in range(1, hi):
        key <<= np.uint64(bits)
        key[:-j] |= np.where(left[:-j] > j, letters[j:], np.uint64(0))
    key = np.sort(key)
    ascii_only = int(alphabet[-1]) < 128
    shown = np.r_[0, alphabet].astype(np.uint8 if ascii_only else np.uint32)
    last = np.uint64((1 << bits) - 1)
    for k in range(lo, hi + 1):
        code = key >> np.uint64((hi - k) * bits)
        code = code[(code & last) != 0]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        n = np.diff(np.r_[first, len(code)])
        code = code[first]
        chars = np.empty((len(code), k), shown.dtype)
        for j in range(k):
            chars[:, j] = shown[(code >> np.uint64((k - 1 - j) * bits)) & last]
        whose = code >> np.uint64(k * bits) if k * bits < 64 else np.zeros(len(code), np.uint64)
        yield whose.astype(np.int64), _names(chars, ascii_only), n


#: Rows of (id, kmer, n) a task hands over at once.
COUNTS_AT_ONCE = 1 << 20


#: Rows of (id, kmer, n) added up at once where only sums per k-mer are wanted.
SUMMED_AT_ONCE = 1 << 22


def kmer_counts(df: DataFrame, id_col: str, seq_col: str, lo: int, hi: int, summed: bool = False, per_id: bool = False) -> DataFrame:
    """(id, kmer, n) for every k-mer of length lo..hi of each whole text (ids unique per row).

    A row's k-mers are counted where the row is, many rows at once.
    Nothing is shuffled here, and a later aggregate by k-mer combines map-side.
    With ``summed`` the counts of many rows are added up before they leave the task:
    (kmer, rows, n), a k-mer as often as there were such sums.  With ``per_id`` as well,
    only rows with the same id are added up: (id, kmer, rows, n).
    """
    if lo < 1 or hi < lo:
        raise ValueError(f"bad k-mer range {lo}..{hi}")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, size in text_chunks(batch.column(1)):
                some = batch.slice(at, size)
                for rows, kmers, n in kmers_of(some.column(1), lo, hi):
                    for i in range(0, len(n), COUNTS_AT_ONCE):
                        part = slice(i, i + COUNTS_AT_ONCE)
                        names = kmers[part].cast(pa.string())
                        yield pa.RecordBatch.from_arrays(
                            [some.column(0).take(pa.array(rows[part])), names, pa.array(n[part])], [id_col, "kmer", "n"]
                        )

    def run_summed(batches):
        import pyarrow as pa

        held, size = [], 0

        def added():
            sums = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([("n", "count"), ("n", "sum")])
            sums = sums.select([*keys, "n_count", "n_sum"]).rename_columns([*keys, "rows", "n"])
            return sums.to_batches(max_chunksize=COUNTS_AT_ONCE)

        for part in run(batches):
            held.append(part.select([*keys, "n"]))
            size += part.num_rows
            if size >= SUMMED_AT_ONCE:
                yield from added()
                held, size = [], 0
        if held:
            yield from added()

    texts = df.select(id_col, normalize_text(seq_col).alias("_t"))
    kind = df.schema[id_col].dataType.simpleString()
    keys = [id_col, "kmer"] if per_id else ["kmer"]
    if summed:
        own = f"`{id_col}` {kind}, " if per_id else ""
        return map_arrow(texts, run_summed, f"{own}kmer string, rows bigint, n bigint")
    return map_arrow(texts, run, f"`{id_col}` {kind}, kmer string, n bigint")


def kmer_vocabulary(counts: DataFrame) -> DataFrame:
    """C4: distinct k-mers, index = position in sorted order (0-based), distributed."""
    pos = ordered_positions(counts.select("kmer").distinct(), ["kmer"], (), "_pos")
    return pos.select("kmer", (F.col("_pos") - 1).cast("int").alias("idx"))


#: A key with more than one in this many rows is joined by broadcast.
HOT_SHARE = 4096


def spread_join(facts: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``facts.join(table, key)`` where frequent keys don't gather in one task.

    Keys with more than 1/HOT_SHARE of the rows are fewer than HOT_SHARE, so their part
    of ``table`` (unique keys) is broadcast; the others move as in any join.  ``facts``
    is read twice: give a stored table.
    """
    n = facts.count()
    often = materialize(
        facts.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HOT_SHARE > n).select(key), "hot-keys"
    )
    hot = table.join(F.broadcast(often), key)
    cold = facts.join(F.broadcast(often), key, "left_anti").join(table, key)
    return facts.join(F.broadcast(hot), key).unionByName(cold)


#: Bytes of text whose k-mers are looked up together, and counted at once while they are.
CHUNK_BYTES, CHUNK_CHARS = 1 << 22, 1 << 20
#: Vectors handed over at once.
VECTORS_AT_ONCE = 256


def text_chunk(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """``df`` with the chunk of about CHUNK_BYTES of text that a row's id falls into (``_chunk``), dealt by it.

    Rows with equal ids share a chunk; rows without an id, which have no vector, go by their text.
    """
    size = df.agg(F.sum(F.octet_length(seq_col))).first()[0] or 0
    # smaller chunks where there would be fewer than cores
    n = max(size // CHUNK_BYTES, min(2 * df.sparkSession.sparkContext.defaultParallelism, size // CHARS_AT_ONCE)) + 1
    place = F.when(F.col(id_col).isNull(), F.xxhash64(seq_col)).otherwise(F.xxhash64(id_col))
    return df.withColumn("_chunk", F.pmod(place, F.lit(n))).repartition("_chunk")


def kmer_vectorize(counts: DataFrame, vocab: DataFrame, ids: DataFrame, id_col: str, text: tuple[str, int, int] | None = None) -> DataFrame:
    """Per row a sparse (indices, values) pair over the vocabulary.

    Unseen k-mers drop out in the inner join; rows with no known k-mer are
    kept (left join from ``ids``) with empty arrays.  ``counts`` must be stored.

    With ``text`` (column, lo, hi), ``ids`` are the chunks of ``text_chunk`` and ``counts``
    their k-mers (_chunk, kmer), some perhaps more than once.  The vocabulary is looked up
    for a chunk's k-mers, and its rows are counted where their text is, so
    entries (row, k-mer, n) are neither stored nor moved.
    """
    if text is not None:
        return _vectorize_chunks(counts, vocab, ids, id_col, *text)
    known = spread_join(counts, vocab, "kmer")
    rows = known.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "n"))).alias("_e"))
    out = ids.select(id_col).join(rows, id_col, "left")
    e = F.coalesce(F.col("_e"), F.array().cast("array<struct<idx:int,n:bigint>>"))
    return out.select(
        id_col,
        F.transform(e, lambda s: s["idx"]).alias("indices"),
        F.transform(e, lambda s: s["n"].cast("double")).alias("values"),
    )


def _vectorize_chunks(kmers: DataFrame, vocab: DataFrame, chunks: DataFrame, id_col: str, seq_col: str, lo: int, hi: int) -> DataFrame:
    def vectors(rows, places):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = rows.combine_chunks()
        row_ids, texts = (rows.column(i).combine_chunks() for i in (1, 2))
        lengths = pc.utf8_length(places.column(1)).to_numpy()
        known = {}
        for k in range(lo, hi + 1):
            some = places.take(pa.array(np.flatnonzero(lengths == k))).combine_chunks()
            known[k] = some.column(1).combine_chunks(), some.column(2).to_numpy()
        # rows with one id share their entries
        coded = row_ids.dictionary_encode()
        own = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        group = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
        at_group, at_idx, at_n = [], [], []
        for at, size in text_chunks(texts, CHUNK_CHARS):
            for r, names, n in kmers_of(texts.slice(at, size), lo, hi):
                have_names, idx = known[len(names[0].as_py())]
                found = pc.index_in(names, have_names.cast(names.type))
                have = found.is_valid().to_numpy(zero_copy_only=False)
                at_group.append(group[at + r[have]].astype(np.int32))
                at_idx.append(idx[found.drop_null().to_numpy()].astype(np.int32))
                at_n.append(n[have].astype(np.float64))
        groups = int(group.max(initial=0)) + 1
        g, i, v = (np.concatenate(a) if a else np.zeros(0, t) for a, t in ((at_group, np.int32), (at_idx, np.int32), (at_n, np.float64)))
        order = np.lexsort((v, i, g))
        i, v = i[order], v[order]
        ends = np.searchsorted(g[order], np.arange(groups + 1))
        batches = []
        for a in range(0, len(row_ids), VECTORS_AT_ONCE):
            some = group[a : a + VECTORS_AT_ONCE]
            mine = own[a : a + VECTORS_AT_ONCE]
            sizes = np.where(mine, ends[some + 1] - ends[some], 0)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            take = np.repeat(ends[some] - offsets[:-1], sizes) + np.arange(offsets[-1])
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x[take])) for x in (i, v)]
            batches.append(pa.RecordBatch.from_arrays([row_ids.slice(a, VECTORS_AT_ONCE), *lists], [id_col, "indices", "values"]))
        kinds = pa.schema([(id_col, row_ids.type), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
        return pa.Table.from_batches(batches, kinds)

    ship_package(chunks.sparkSession)
    places = kmers.select("_chunk", "kmer").join(vocab.select("kmer", "idx"), "kmer").select("_chunk", "kmer", "idx")
    texts = chunks.select("_chunk", id_col, normalize_text(seq_col).alias("_t"))
    kind = chunks.schema[id_col].dataType.simpleString()
    return texts.groupBy("_chunk").cogroup(places.groupBy("_chunk")).applyInArrow(
        vectors, f"`{id_col}` {kind}, indices array<int>, values array<double>"
    )


def normalize_total(coo: DataFrame, cell_col: str = "cell_id", value_col: str = "value", target: float = TARGET_SUM) -> DataFrame:
    """Value / sum(|value|) of its cell * target; an all-zero cell stays zero.

    The per-cell total is an aggregate joined back (AQE broadcasts it when the
    cell count is small, otherwise a co-partitioned join on cell).
    """
    totals = coo.groupBy(cell_col).agg(F.sum(F.abs(value_col)).alias("_total"))
    j = coo.join(totals, cell_col)
    scaled = F.coalesce(F.try_divide(F.col(value_col), F.col("_total")), F.lit(0.0)) * F.lit(target)
    return j.withColumn(value_col, scaled.cast("double")).drop("_total")


def log1p_values(coo: DataFrame, value_col: str = "value") -> DataFrame:
    """ln(1 + x); zeros stay zero so the COO form stays sparse."""
    return coo.withColumn(value_col, F.log1p(value_col))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """C13 'balanced': n / (k * count_c) per class (one aggregate over #classes rows)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))
    # the window spans the class table only (one row per class)
    every = Window.partitionBy()
    n, k = F.sum("count").over(every), F.count(F.lit(1)).over(every)
    return counts.select(label_col, "count", (n / (k * F.col("count"))).alias("weight"))


def index_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """C14: label value -> class index in sorted label order (0-based)."""
    labels = df.select(F.col(label_col).cast("string").alias("_l")).distinct()
    pos = ordered_positions(labels, ["_l"], (), "_pos")
    return pos.select(F.col("_l").alias(label_col), (F.col("_pos") - 1).cast("int").alias("label_index"))
