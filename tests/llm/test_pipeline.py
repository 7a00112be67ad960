"""The pipeline's stages on awkward rows, and the entry module without the subpackage."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline

from scorewell.llm.common import stored

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _run(spark, docs, labels, tmp_path, name):
    labels.write.parquet(str(tmp_path / f"{name}/labels.parquet"))
    sizes = {}
    for stage, f in corpus_pipeline.STAGES:
        new = stored(f(spark, docs, str(tmp_path / name)), "test-pipeline")
        if stage != "packing":
            assert new.columns == docs.columns
        docs = new
        sizes[stage] = docs.count()
    return docs, sizes


def test_stages_on_awkward_rows(spark, awkward, empty, tmp_path):
    df, rows = awkward
    labels = spark.createDataFrame([(20, 0), (21, 1)], "doc_id bigint, toxic int")
    out, sizes = _run(spark, df, labels, tmp_path, "a")
    assert sizes["toxicity"] == len(rows)  # too few labels: nothing goes
    assert sizes["exact_dedup"] > sizes["near_dedup"] == sizes["pii"]
    tokens = {(r.doc_id, r.doc_tokens) for r in out.select("doc_id", "doc_tokens").collect()}
    assert len(tokens) == sizes["pii"]
    out, sizes = _run(spark, empty, labels, tmp_path, "b")
    assert set(sizes.values()) == {0}


def test_run_is_the_stages_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(ids) < docs.count()
    assert {n for n, _ in corpus_pipeline.STAGES} == {"toxicity", "exact_dedup", "near_dedup", "pii", "packing"}


def test_entry_module_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "scorewell"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
