"""A training-corpus pipeline over ``documents``: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads again as the next stage's
``docs``.  The first four return the columns of ``documents``; the last one
returns the packed pieces.

1. toxicity: documents that the compression classifier takes for toxic go.
2. exact_dedup: of texts equal but for white space one row stays.
3. near_dedup: of documents connected by a similarity of 0.8 or more on five-word
   shingles one stays, the one with the smallest id.
4. pii: personal data is replaced by marks of its kind; no document goes.
5. packing: documents are cut and packed into sequences of 2048 tokens.

Nulls, empty tables, repeated rows and other columns: as the operators say;
columns besides those of ``documents`` pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewell.llm import exact_dedup, minhash, packing, pii, toxicity
from scorewell.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redacted(docs)
    if "n_chars" in docs.columns:  # follows the text
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained compression dictionaries and token packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
