"""Sharding: a two-pass external shuffle.

Pass 1 scatters every record into a memory-sized bucket by seeded hashes; the
bucket belongs to one shard.  Pass 2 holds one bucket at a time, orders it with
Spark's ``shuffle`` (a seeded Fisher-Yates pass over the bucket's array) and
writes it as a file of its shard.  Uniform buckets of which each is in uniform
order make a uniform order of the shard.

The law is ``key``: the shard follows from the id and the shard count alone.
Shard n takes an id when a hash of (id, n) is divisible by n + 1, and an id lives
in the last shard that took it, so each shard holds 1/N of the ids and one more
shard takes rows only into itself.  The bucket inside the shard also depends on
the row's position in the scan, so neither a hot id nor identical rows make a
large bucket.  The input must be a stored table (positions must not change when
a lost task runs again).

Defined results: a null id is an id of its own (all its rows in one shard, over
all its buckets); null and empty texts have size 1 and checksum 0; repeated rows
stay repeated; an empty table gives an empty result; other columns are carried
along unchanged (names that clash with ``shard``, ``bucket`` or ``place`` too:
the added column takes leading underscores).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewell.llm.common import private, table
from scorewell.session import scratch_table

N_SHARDS = 16
#: Text bytes a bucket holds on average; a task keeps one bucket in memory.
BUCKET_BYTES = 24 << 20
SEED = 20_251


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def shard_of(id_col: str, n_shards: int, seed: int = SEED) -> Column:
    """The last n below ``n_shards`` whose hash with the id is divisible by n + 1."""
    takes = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), n), n + 1) == 0
    return F.array_max(
        F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda n: F.when(takes(n), n).otherwise(0))
    ).cast("int")


@dataclass
class Shards:
    """``records``: the written rows with (shard, bucket, place); the names of these columns."""

    records: DataFrame
    shard: str
    bucket: str
    place: str

    def with_slots(self, *columns: Column | str, slot: str = "slot") -> DataFrame:
        """``columns`` of the rows (all by default) with shard and gapless slot: the rows
        of earlier buckets plus the place.

        The counts have one row per bucket; they are joined by key and Spark
        picks the join from their size.  Only ``columns`` go through the join.
        """
        counts = self.records.groupBy(self.shard, self.bucket).agg(F.count(F.lit(1)).alias("_rows"))
        before = Window.partitionBy(self.shard).orderBy(self.bucket).rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select(
            F.col(self.bucket), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
        )
        rows = self.records.select(*(columns or ["*"]), *[x for x in (self.shard, self.bucket, self.place) if columns])
        return rows.join(starts, self.bucket).withColumn(slot, F.col("_start") + F.col(self.place)).drop("_start")


def bucket_counts(df: DataFrame, n_shards: int, id_col: str, text_col: str, bucket_bytes: int, seed: int) -> list[int]:
    """How many buckets of ``bucket_bytes`` each shard's own rows need, at least one."""
    sums = df.groupBy(shard_of(id_col, n_shards, seed).alias("s")).agg(F.sum(size_of(text_col)).alias("b")).collect()
    sizes = {r["s"]: r["b"] for r in sums}
    return [max(1, -(-sizes.get(k, 0) // bucket_bytes)) for k in range(n_shards)]


def write_shards(
    df: DataFrame,
    path: str,
    n_shards: int = N_SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED,
) -> Shards:
    """Shuffle ``df`` into ``path``/shard=N, a file per bucket; the rows as read back."""
    shard, bucket, place, rows = private(df, "shard", "bucket", "place", "rows")
    needs = bucket_counts(df, n_shards, id_col, text_col, bucket_bytes, seed)
    firsts = [sum(needs[:k]) for k in range(n_shards)]
    home = F.get(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("first"), F.lit(n).alias("n"))
                           for k, (f, n) in enumerate(zip(firsts, needs))]), shard_of(id_col, n_shards, seed))
    inside = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.monotonically_increasing_id()), home["n"])
    scattered = df.withColumn(bucket, (home["first"] + inside).cast("int")).repartitionById(sum(needs), F.col(bucket))
    # sorted first, so that the order a bucket starts from doesn't depend on which map task answered first
    held = scattered.groupBy(bucket).agg(
        F.shuffle(F.sort_array(F.collect_list(F.struct(
            F.xxhash64(F.lit(seed), *[F.col(c) for c in (id_col, text_col)]).alias("_order"),
            F.struct(*[F.col(c) for c in df.columns]).alias("_row"),
        ))), seed).alias(rows)
    )
    out = held.select(bucket, F.posexplode(rows).alias(place, rows)).select(
        f"{rows}._row.*", bucket, place,
        (F.size(F.filter(F.array(*[F.lit(f) for f in firsts]), lambda f: f <= F.col(bucket))) - 1).alias(shard),
    )
    out.write.partitionBy(shard).parquet(path)
    return Shards(df.sparkSession.read.schema(out.schema).parquet(path), shard, bucket, place)


def op1_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    done = write_shards(docs, scratch_table(spark, "shards"))
    slots = done.with_slots(
        "doc_id",
        size_of("text").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col(done.shard).cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        shard_of("doc_id", N_SHARDS + 1).alias("grown_shard"),
    )
