"""J1 streaming_leaderboard and J2 streaming_predict (Structured Streaming).

Submissions land as JSON files; the best record per (dataset, fold, user, metric)
is a stateful streaming aggregate (the same expressions as batch H1), of which each
batch emits the keys that changed.  State and progress live in a checkpoint under the
shared checkpoint folder, so a restarted query resumes where it stopped.  Scoring a
stream (J2) is ``PipelineModel.transform`` on the streaming frame, appended to a
parquet sink.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewell.operators.leaderboard import KEYS, board_of, user_metrics
from scorewell.session import _hadoop_path, scratch_path
from scorewell.sources.submissions import FILE_SCHEMA, _split_metrics


def submission_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming frame of submission records (explicit schema, no inference)."""
    r = spark.readStream.schema(FILE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return _split_metrics(r.json(path))


STATE_KEYS = [*KEYS, "user", "metric"]


def run_leaderboard_stream(
    spark: SparkSession, source: str, out_path: str, checkpoint: str | None = None, files_per_trigger: int = 16
) -> DataFrame:
    """Process every file available now; each micro-batch adds the rows of its epoch that changed.

    The state (``user_metrics``) runs in update mode, so a batch hands over only the keys
    it touched, and writes only those, as one run.  Runs are merged by size like the
    digits of a counter: a new run takes in the last one while that is less than twice
    its size, so a key is rewritten about log2(epochs) times and a reader meets that many
    runs.  A manifest per epoch names the runs that make up the state; it is written
    last, so a reader never sees half an epoch.
    """
    checkpoint = checkpoint or out_path + "_checkpoint"
    state = user_metrics(submission_stream(spark, source, max_files_per_trigger=files_per_trigger))

    def write(batch: DataFrame, epoch: int) -> None:
        runs = _manifest(spark, out_path, before=epoch)
        path = f"{out_path}/runs/epoch={epoch}"
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(path)
        size, first = _rows(spark, path), epoch
        while runs and runs[-1]["rows"] < 2 * size:
            last = runs.pop()
            merged = f"{out_path}/runs/{last['first']}-{epoch}"
            _latest(_read_runs(spark, [last["path"], path])).write.mode("overwrite").parquet(merged)
            path, size, first = merged, _rows(spark, merged), last["first"]
        if size:
            runs.append({"path": path, "rows": size, "first": first})
        _write_manifest(spark, out_path, epoch, runs)

    q = (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return read_board(spark, out_path)


def _latest(state: DataFrame) -> DataFrame:
    """The newest row of each key of the state."""
    row = F.struct(*[c for c in state.columns if c not in STATE_KEYS])
    return state.groupBy(*STATE_KEYS).agg(F.max_by(row, "epoch").alias("_s")).select(*STATE_KEYS, "_s.*")


def _rows(spark: SparkSession, path: str) -> int:
    return _read_runs(spark, [path]).count()


STATE_SCHEMA = (
    "dataset string, fold string, user string, metric string, "
    "best struct<timestamp: string, name: string, score: double, description: string>, n_submissions bigint, "
    "first_timestamp string, first struct<timestamp: string, name: string, primary_metric: string>, epoch int"
)


def _read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(*paths)


def _manifest(spark: SparkSession, out_path: str, before: int | None = None) -> list[dict]:
    """The runs of the last epoch (below ``before``) with a manifest; none without one."""
    fs, root = _hadoop_path(spark, f"{out_path}/manifest")
    if not fs.exists(root):
        return []
    epochs = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(root) if f.getPath().getName().startswith("epoch=")]
    epochs = [e for e in epochs if before is None or e < before]
    if not epochs:
        return []
    rows = spark.read.text(f"{out_path}/manifest/epoch={max(epochs)}").collect()  # one line
    return json.loads(rows[0][0])


def _write_manifest(spark: SparkSession, out_path: str, epoch: int, runs: list[dict]) -> None:
    """Appears whole: written aside, then renamed."""
    fs, target = _hadoop_path(spark, f"{out_path}/manifest/epoch={epoch}")
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{out_path}/manifest/_epoch={epoch}")
    fs.mkdirs(target.getParent())
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(runs).encode()))
    out.close()
    fs.delete(target, True)
    if not fs.rename(aside, target):
        raise OSError(f"could not write the manifest of epoch {epoch}")
    keep = {r["path"] for r in runs}
    # runs that neither this epoch nor the one before names have no reader left
    keep |= {r["path"] for r in _manifest(spark, out_path, before=epoch)}
    _, root = _hadoop_path(spark, f"{out_path}/runs")
    for f in fs.listStatus(root) if fs.exists(root) else []:
        if not any(f.getPath().toString().endswith(k[len(out_path):]) for k in keep):
            fs.delete(f.getPath(), True)


def read_board(spark: SparkSession, out_path: str) -> DataFrame:
    """H1 of all records up to the last complete epoch (empty before the first)."""
    runs = _manifest(spark, out_path)
    return board_of(_latest(_read_runs(spark, [r["path"] for r in runs])).drop("epoch"))


def run_predict_stream(
    spark: SparkSession, model, source: str, schema, out_path: str, checkpoint: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Apply a fitted PipelineModel to every new parquet file; append the predictions.

    ``files_per_trigger`` bounds a micro-batch; without it a batch takes all that is there.
    """
    checkpoint = checkpoint or out_path + "_checkpoint"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    stream = reader.parquet(source)
    scored = model.transform(stream)
    cols = [c for c in stream.columns] + [F.col("prediction").alias("predictions")]
    q = (
        scored.select(*cols)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", out_path)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(scored.select(*cols).schema).parquet(out_path)


def fresh_dir(spark: SparkSession, name: str) -> str:
    import uuid

    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
