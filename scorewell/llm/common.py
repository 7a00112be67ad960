"""Small helpers shared by the operators: input columns, run tags and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewell.session import materialize, ship_package

#: The white space of the word rules: space and U+0009 to U+000D (fixed value).
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"
#: Most bytes of one text that the driver learns from, in blocks of BLOCK_BYTES dealt by
#: hash over the whole text; scores read whole texts.
SAMPLE_BYTES, BLOCK_BYTES = 1 << 15, 1 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back (lineage ends there)."""
    return materialize(df, name)


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def dealt_blocks(whole: Column) -> Column:
    """A text (bytes) of at most SAMPLE_BYTES as it is; of a longer one the blocks with the
    smallest hashes of text and place, in their order, a space after each.  A block anywhere
    in the text is as likely as any other to be learned from."""
    step = BLOCK_BYTES - 1
    last = F.floor((F.octet_length(whole) - 1) / step).cast("int")
    ranked = F.sort_array(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.xxhash64(whole), i).alias("h"), i.alias("i"))
    ))
    places = F.sort_array(F.transform(F.slice(ranked, 1, SAMPLE_BYTES // BLOCK_BYTES), lambda x: x["i"]))
    cut = F.aggregate(
        places, F.lit(b""),
        lambda got, i: F.concat(got, F.substring(whole, i * step + 1, F.lit(step)), F.lit(b" ")),
    )
    return F.when(F.octet_length(whole) <= SAMPLE_BYTES, whole).otherwise(cut)


def sample(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """To learn from: one row for each id of ``chosen`` (few unique ones) that ``docs`` has.

    Columns: i (the id), t (its text, of several texts the one with the smallest hash; see
    ``dealt_blocks``) and the other columns of ``chosen``.
    """
    others = [c for c in chosen.columns if c != id_col]
    whole = text_or_empty(text_col).cast("binary")
    return (
        docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
        .select(F.col(id_col).alias("i"), *others, F.xxhash64(whole).alias("k"), dealt_blocks(whole).alias("t"))
        .groupBy("i", *others).agg(F.min_by("t", "k").alias("t"))
    )


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the tasks."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
