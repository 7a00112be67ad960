"""C1-C14 and B* against the hand-computed fixtures."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from scorewell.functions.sequence import gc_content
from scorewell.operators import features as FT
from scorewell.operators import profile as P
from scorewell.plans import estimators as E
from scorewell.sources.expression import read_expression


def test_gc_content(spark):
    df = spark.createDataFrame([(1, "ACGT"), (2, ""), (3, "ggcc"), (4, "AUGN")], "id long, s string")
    got = {r["id"]: r["gc"] for r in df.select("id", gc_content("s").alias("gc")).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 1.0, 4: 0.25}


def test_kmer_counts(spark):
    df = spark.createDataFrame([(1, "ACGTA"), (2, "AAAA"), (3, "A")], "id long, s string")
    got = {(r["id"], r["kmer"]): r["n"] for r in FT.kmer_counts(df, "id", "s", 2, 3).collect()}
    exp = {(1, k): 1 for k in ["ac", "cg", "gt", "ta", "acg", "cgt", "gta"]}
    exp.update({(2, "aa"): 3, (2, "aaa"): 2})
    assert got == exp


def test_kmer_whitespace_collapse(spark):
    df = spark.createDataFrame([(1, "A  \t B")], "id long, s string")
    got = {r["kmer"] for r in FT.kmer_counts(df, "id", "s", 3, 3).collect()}
    assert got == {"a b"}


def test_kmer_vectorize_keeps_rows_without_known_kmers(spark):
    df = spark.createDataFrame([(1, "ACGTA"), (2, "AAAA"), (3, "A")], "id long, s string")
    counts = FT.kmer_counts(df, "id", "s", 2, 3)
    vocab = FT.kmer_vocabulary(counts.where("id = 1"))
    assert [r["kmer"] for r in vocab.orderBy("idx").collect()] == sorted(["ac", "cg", "gt", "ta", "acg", "cgt", "gta"])
    vec = {r["id"]: r for r in FT.kmer_vectorize(counts, vocab, df, "id").collect()}
    assert len(vec) == 3 and vec[3]["indices"] == [] and vec[2]["indices"] == []
    assert sum(vec[1]["values"]) == 7


def test_scale_nocenter_zero_variance_keeps_column(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 5.0]),), (Vectors.dense([3.0, 5.0]),)], ["x"])
    out = df
    for st in E.population_scale(df, "x", "y", center=False):
        out = st.transform(out)
    rows = [r[0] for r in out.select(vector_to_array("y")).collect()]
    assert sorted(rows) == [[1.0, 5.0], [3.0, 5.0]]


def test_scale_center_population_std(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 5.0]),), (Vectors.dense([3.0, 5.0]),)], ["x"])
    out = df
    for st in E.population_scale(df, "x", "y", center=True):
        out = st.transform(out)
    rows = sorted(r[0] for r in out.select(vector_to_array("y")).collect())
    assert rows[0] == pytest.approx([-1.0, 0.0]) and rows[1] == pytest.approx([1.0, 0.0])


def test_normalize_log1p(spark):
    coo = spark.createDataFrame([(1, "g1", 1.0), (1, "g2", 3.0), (2, "g1", 0.0), (2, "g2", 0.0)], "cell_id long, gene string, value double")
    out = {(r["cell_id"], r["gene"]): r["value"] for r in FT.log1p_values(FT.normalize_total(coo)).collect()}
    assert out[(1, "g1")] == pytest.approx(7.824446, abs=1e-6)
    assert out[(1, "g2")] == pytest.approx(8.922792, abs=1e-6)
    assert out[(2, "g1")] == 0.0 and out[(2, "g2")] == 0.0


def test_read_expression_dense_cells(spark):
    coo = spark.createDataFrame([(1, "g2", 3.0), (1, "g1", 1.0)], "cell_id long, gene string, value double")
    obs = spark.createDataFrame([(1, 0), (2, 1)], "cell_id long, label int")
    cells, genes = read_expression(spark, coo, obs)
    got = {r["cell_id"]: r["f"] for r in cells.select("cell_id", vector_to_array("features").alias("f")).collect()}
    assert got[1] == pytest.approx([7.824446, 8.922792], abs=1e-6)
    assert got[2] == [0.0, 0.0]


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (1,), (2,)], "label int")
    w = {r["label"]: r["weight"] for r in FT.class_weights(df, "label").collect()}
    assert w[0] == pytest.approx(0.833333, abs=1e-6) and w[1] == pytest.approx(0.833333, abs=1e-6)
    assert w[2] == pytest.approx(1.666667, abs=1e-6)


def test_index_labels_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "label string")
    assert {r["label"]: r["label_index"] for r in FT.index_labels(df).collect()} == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize(
    "values,dtype,expected",
    [
        ([float(i) + 0.5 for i in range(25)], "double", "regression"),
        (list(range(25)), "int", "classification"),
        (list(range(31)), "int", "regression"),
        ([float(i) + 0.5 for i in range(20)], "double", "classification"),
        ([f"s{i}" for i in range(25)], "string", "classification"),
    ],
)
def test_infer_task_type(spark, values, dtype, expected):
    df = spark.createDataFrame([(v,) for v in values], f"y {dtype}")
    assert P.infer_task_type(df, "y") == expected


def test_role_detection(spark):
    df = spark.createDataFrame([(1, "ACGT", 0.5, 0)], "row_id long, sequence string, labels double, fold_id int")
    assert P.detect_label_col(df.schema) == "labels"
    assert P.detect_sequence_col(df.schema) == "sequence"
    tab = spark.createDataFrame([(1.0, 2, "x", 0)], "a double, b int, c string, fold int")
    assert P.detect_label_col(spark.createDataFrame([(1.0, 0)], "v double, fold int").schema) == "v"
    assert P.feature_cols(tab.schema, "c") == ["a", "b"]
    # strings count as categorical (obs text columns are categories); numbers by distinct count
    obs = spark.createDataFrame([(i, i % 4, i * 0.5) for i in range(100)], "id long, kind int, score double")
    assert P.detect_obs_label_col(obs) == "kind"
    two = spark.createDataFrame([(i, i % 4, f"n{i}") for i in range(100)], "id long, kind int, name string")
    with pytest.raises(ValueError):
        P.detect_obs_label_col(two)


def test_profile_record(spark):
    import json

    seq = spark.createDataFrame(
        [(i, "ACGT" * (i % 3 + 1), float(i) + 0.5, i % 10) for i in range(60)], "row_id long, sequence string, labels double, fold_id int"
    )
    tr, te = seq.where("fold_id <> 0"), seq.where("fold_id = 0")
    rec = P.profile_record(tr, te, id_cols=("row_id",))
    assert rec["task_type"] == "regression" and rec["train_samples"] == 54 and rec["test_samples"] == 6
    assert rec["sequence_column"] == "sequence" and rec["class_distribution"] is None
    assert rec["label_stats"]["min"] == 1.5 and rec["extra"]["seq_len_max"] == 12
    tab = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2], i % 10) for i in range(40)], "row_id long, x double, label string, fold_id int")
    rec2 = P.profile_record(tab, tab.limit(0), id_cols=("row_id",))
    assert rec2["task_type"] == "classification" and rec2["class_distribution"] == {"a": 20, "b": 20}
    assert rec2["feature_columns"] == ["x"] and rec2["n_features"] == 1
    json.dumps(rec2)


def _windows(texts, lo, hi):
    from collections import Counter

    return Counter((r, t[i : i + k]) for r, t in enumerate(texts) for k in range(lo, hi + 1) for i in range(len(t) - k + 1))


@pytest.mark.parametrize("letters", ["ab", "acgt nu", "aé漢😀", "".join(map(chr, range(32, 5000)))])
def test_kmers_of_many_texts_at_once(letters):
    import random

    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 7, 60]))) for _ in range(80)]
    for lo, hi in ((1, 1), (3, 6), (2, 20)):  # long ones pass 64 bits and are made dense
        got = {}
        for rows, kmers, n in FT.kmers_of(pa.array(texts, pa.string()), lo, hi):
            part = dict(zip(zip(rows.tolist(), kmers.to_pylist()), n.tolist()))
            assert len(part) == len(n) and not part.keys() & got.keys()
            got.update(part)
        assert got == _windows(texts, lo, hi)


def test_text_chunks_cover_every_row():
    import pyarrow as pa

    texts = pa.array(["abc", None, "", "x" * 50, "yz", "q" * 9])
    for most in (1, 4, 12, 1000):
        runs = list(FT.text_chunks(texts, most))
        assert [i for at, n in runs for i in range(at, at + n)] == list(range(len(texts)))
        assert all(n == 1 or sum(len(t or "") for t in texts.slice(at, n).to_pylist()) <= most for at, n in runs)


def test_sequence_rows_are_dealt_to_all_tasks(spark, tmp_path):
    """A part table in one file was one task's work, and grew with it."""
    from scorewell.plans import views as V

    rows = [(i, f"text {i}", float(i)) for i in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    seq = V.seq(spark, str(tmp_path))
    assert seq.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.row_id, r.sequence, r.labels, r.fold_id) for r in seq.collect()) == [(i, t, y, i % 10) for i, t, y in rows]


def test_counts_summed_in_the_task(spark):
    texts = ["acgt acgt", "ACGT", None, "", "tt", "ünï acg"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string").coalesce(1)
    per_row = FT.kmer_counts(df, "id", "s", 2, 4).groupBy("kmer").agg(F.count("n").alias("rows"), F.sum("n").alias("n"))
    summed = FT.kmer_counts(df, "id", "s", 2, 4, summed=True)
    assert summed.count() == per_row.count()  # one task, one batch: a k-mer leaves it once
    assert {tuple(r) for r in summed.collect()} == {tuple(r) for r in per_row.collect()}


def test_vectors_from_chunks_of_texts(spark, monkeypatch):
    """Entries are counted where the text is: what is stored is a chunk's different k-mers, not a row's."""
    monkeypatch.setattr(FT, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(FT, "CHUNK_CHARS", 100)
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("abcß 𝄞"), 30))) for i in range(60)]
    rows += [(7, "abcabcabc"), (None, "never seen"), (90, None), (91, ""), (92, "zzzzzz")]  # one id twice, no id, no text
    df = spark.createDataFrame(rows, "id long, s string").repartition(3)
    chunks = FT.text_chunk(df, "id", "s")
    assert chunks.select("_chunk").distinct().count() > 2
    found = FT.kmer_counts(chunks.sortWithinPartitions("_chunk"), "_chunk", "s", 2, 4, summed=True, per_id=True)
    counts = FT.kmer_counts(df, "id", "s", 2, 4)
    assert found.count() < 0.7 * counts.count()
    vocab = FT.kmer_vocabulary(counts.where("kmer not like 'z%'"))
    want = FT.kmer_vectorize(counts, vocab, df, "id").collect()
    got = FT.kmer_vectorize(found, vocab, chunks, "id", ("s", 2, 4)).collect()
    show = lambda got: sorted((str(r["id"]), r["indices"], r["values"]) for r in got)
    assert show(got) == show(want)
    assert len(got) == len(rows)


def test_windows_are_sorted_once(monkeypatch):
    """Shorter k-mers are read off the longest ones' order; texts cut windows at their end."""
    import pyarrow as pa

    texts = ["abcab", "", "ab", "zé abcabcabc", "b"]
    calls, keep = [], np.sort
    monkeypatch.setattr(np, "sort", lambda *a, **k: calls.append("sort") or keep(*a, **k))
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append("argsort"))
    got = {(int(r), w): int(c) for rows, names, n in FT.kmers_of(pa.array(texts), 2, 6) for r, w, c in zip(rows, names.to_pylist(), n)}
    assert calls == ["sort"]
    want = {}
    for i, t in enumerate(texts):
        for k in range(2, 7):
            for j in range(len(t) - k + 1):
                want[(i, t[j : j + k])] = want.get((i, t[j : j + k]), 0) + 1
    assert got == want
