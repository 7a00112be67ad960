"""Queries for featurization: C1-C5, C9, C10, C13, C14 (whole texts, whole tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewell.functions.row_features import register_feature, register_native
from scorewell.functions.sequence import gc_content, seq_length
from scorewell.operators import features as FT
from scorewell.plans import views as V
from scorewell.plans.catalog import register
from scorewell.session import materialize
from scorewell.sources.tables import dealt, fold_split, read_table

SEQ = V.with_views("seq")


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


@register(
    "gc_content",
    """
select doc_id, round((2 * length(u) - length(replace(u, 'G', '')) - length(replace(u, 'C', '')))
        / greatest(length(u), 1), 6) as gc
from (select doc_id, upper(replace(text, 'ß', 'SS')) as u from documents) d
""",
)
def gc_content_query(spark, sf_dir):
    """C1 on every whole document (length of the *uppercased* text, so 'ß' counts twice)."""
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.round(gc_content("text"), 6).alias("gc"))


@register("seq_length", "select doc_id, cast(length(text) as double) as seq_len from documents")
def seq_length_query(spark, sf_dir):
    """C2 on every whole document."""
    return _docs(spark, sf_dir).select("doc_id", seq_length("text").alias("seq_len"))


def _kmer_sql(source: str, id_col: str, text: str, lo: int, hi: int) -> str:
    return f"""
kx as (select {id_col} as id, regexp_replace(lower({text}), '\\s\\s+', ' ', 'g') as t from {source}),
km as (select id, substr(t, s, n) as kmer
       from (select id, t, n, unnest(range(1, length(t) - n + 2)) as s
             from kx, (select unnest(range({lo}, {hi + 1})) as n) ns where length(t) >= n) x)
"""


@register(
    "kmer_counts",
    SEQ.rstrip() + ",\n" + _kmer_sql("seq", "row_id", "sequence", 3, 6)
    + "select id as row_id, kmer, cast(count(*) as bigint) as n from km group by id, kmer",
)
def kmer_counts_query(spark, sf_dir):
    """k = 3..6 counts per row of the sequence table."""
    c = FT.kmer_counts(V.seq(spark, sf_dir), "row_id", "sequence", 3, 6)
    return c.select("row_id", "kmer", F.col("n").cast("long").alias("n"))


@register(
    "kmer_counts_documents",
    "with " + _kmer_sql("documents", "doc_id", "text", 3, 6)
    + """
, per as (select id, kmer, count(*) as n from km group by id, kmer)
select kmer, cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as total from per group by kmer
""",
)
def kmer_counts_documents_query(spark, sf_dir):
    """C3 at volume: k = 3..6 over every whole document, summarised per k-mer."""
    # the given file is one row group, so its rows are dealt out before the work on each text
    c = FT.kmer_counts(dealt(_docs(spark, sf_dir)), "doc_id", "text", 3, 6, summed=True)
    return c.groupBy("kmer").agg(F.sum("rows").cast("long").alias("n_docs"), F.sum("n").cast("long").alias("total"))


DOC_SEQ = "select doc_id as row_id, text as sequence, cast(doc_id % 10 as integer) as fold_id from documents"


def _doc_seq(spark, sf_dir):
    """Whole documents as the sequence table (row_id, sequence, fold_id)."""
    return dealt(_docs(spark, sf_dir)).select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("sequence"), (F.col("doc_id") % 10).cast("int").alias("fold_id")
    )


@register(
    "kmer_vocabulary",
    f"with seq as ({DOC_SEQ}),\n" + _kmer_sql("(select * from seq where fold_id <> 0)", "row_id", "sequence", 3, 6)
    + "select kmer, cast(row_number() over (order by kmer) - 1 as integer) as idx from (select distinct kmer from km) v",
)
def kmer_vocabulary_query(spark, sf_dir):
    """C4: sorted vocabulary of the training documents (k = 3..6, whole texts)."""
    train, _ = fold_split(_doc_seq(spark, sf_dir), 0)
    return FT.kmer_vocabulary(FT.kmer_counts(train, "row_id", "sequence", 3, 6, summed=True))


@register(
    "kmer_vectorize",
    f"with seq as ({DOC_SEQ}),\n" + _kmer_sql("seq", "row_id", "sequence", 3, 6)
    + """
, vocab as (select distinct kmer from km join seq on km.id = seq.row_id where seq.fold_id <> 0)
, vocab_i as (select kmer, row_number() over (order by kmer) - 1 as idx from vocab)
, per as (select id, kmer, count(*) as n from km group by id, kmer)
, known as (select id, count(*) as nnz, sum(n) as total, sum(idx) as idx_sum from per join vocab_i using (kmer) group by id)
select row_id, cast(coalesce(nnz, 0) as integer) as nnz, cast(coalesce(total, 0) as double) as total,
       cast(coalesce(idx_sum, 0) as bigint) as idx_sum
from seq left join known on seq.row_id = known.id
""",
)
def kmer_vectorize_query(spark, sf_dir):
    """Vocabulary fitted on train rows, every row vectorized (unseen k-mers ignored).

    The k-mers of a few MB of texts, counted together, give the vocabulary and are looked
    up in it; the rows are then counted again beside what was found.
    """
    chunks = FT.text_chunk(_doc_seq(spark, sf_dir), "row_id", "sequence")
    # a part of a chunk is the chunk's training rows, or its others
    parts = chunks.withColumn("_part", F.col("_chunk") * 2 + F.when(F.col("fold_id").eqNullSafe(F.lit(0)), 0).otherwise(1))
    counts = FT.kmer_counts(parts.sortWithinPartitions("_part"), "_part", "sequence", 3, 6, summed=True, per_id=True)
    counts = materialize(counts.select(F.shiftright("_part", 1).alias("_chunk"), "kmer", (F.col("_part") % 2).cast("int").alias("fold_id")), "kmer-counts")
    train, _ = fold_split(counts, 0)
    vec = FT.kmer_vectorize(counts, FT.kmer_vocabulary(train), chunks, "row_id", ("sequence", 3, 6))
    return vec.select(
        "row_id",
        F.size("indices").cast("int").alias("nnz"),
        F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("total"),
        F.aggregate("indices", F.lit(0).cast("long"), lambda a, i: a + i).alias("idx_sum"),
    )


EXPR = V.with_views("expr_coo")
NORM_SQL = """
, t as (select cell_id, sum(abs(value)) as total from expr_coo group by cell_id)
, nrm as (select cell_id, gene, coalesce(value / nullif(total, 0), 0) * 10000.0 as value
          from expr_coo join t using (cell_id))
"""


@register("normalize_total", EXPR.rstrip() + NORM_SQL + "select cell_id, gene, round(value, 6) as value from nrm")
def normalize_total_query(spark, sf_dir):
    """C9 on the cell x gene counts (target 1e4)."""
    n = FT.normalize_total(V.expr_coo(spark, sf_dir))
    return n.select("cell_id", "gene", F.round("value", 6).alias("value"))


@register("log1p", EXPR.rstrip() + NORM_SQL + "select cell_id, gene, round(ln(1 + value), 6) as value from nrm")
def log1p_query(spark, sf_dir):
    """C9 then C10."""
    n = FT.log1p_values(FT.normalize_total(V.expr_coo(spark, sf_dir)))
    return n.select("cell_id", "gene", F.round("value", 6).alias("value"))


@register(
    "class_weights",
    V.with_views("cells")
    + """
, c as (select label, count(*) as cnt from cells group by label)
select label, cast(cnt as bigint) as count, round((select sum(cnt) from c) / ((select count(*) from c) * cnt), 6) as weight
from c
""",
)
def class_weights_query(spark, sf_dir):
    """C13 'balanced' weights of the cell labels."""
    w = FT.class_weights(V.cells(spark, sf_dir), "label")
    return w.select("label", F.col("count").cast("long").alias("count"), F.round("weight", 6).alias("weight"))


@register(
    "index_labels",
    V.with_views("tab")
    + "select label, cast(row_number() over (order by label) - 1 as integer) as label_index from (select distinct label from tab) d",
)
def index_labels_query(spark, sf_dir):
    """C14: class index of the tabular label, sorted order."""
    return FT.index_labels(V.tab(spark, sf_dir), "label")


@register(
    "row_features_sql",
    V.with_views("seq")
    + """
select row_id, length(sequence) - length(replace(lower(sequence), 'e', '')) as n_e,
       cast(length(regexp_replace(lower(sequence), '[^aeiou]', '', 'g')) as double) / greatest(length(sequence), 1) as vowel_share
from seq
""",
)
def row_features_sql(spark, sf_dir):
    """K3 through ``spark.sql``: one feature as a Python row function, one in SQL that Catalyst inlines."""
    register_feature("feature_n_e", lambda s: s.lower().count("e"), "int", spark=spark)
    vowels = "length(regexp_replace(lower(t), '[^aeiou]', '')) / greatest(length(t), 1)"
    register_native(spark, "feature_vowel_share", "t", vowels)
    V.seq(spark, sf_dir).createOrReplaceTempView("feature_input")
    return spark.sql(
        "select row_id, cast(feature_n_e(sequence) as bigint) as n_e, feature_vowel_share(sequence) as vowel_share from feature_input"
    )
