"""Session helpers: a local session for tests/bench and the checkpoint folder rule.

On a cluster the session comes from the caller; nothing here overrides its
settings.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session
and only invents a folder when the master is local and nothing is set.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "scorewell") -> SparkSession:
    """Local session used by tests and bench.py (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SCOREWELL_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Order: the context's checkpoint dir, then ``spark.checkpoint.dir`` from the
    session conf.  Only a local master may fall back to a fresh temp folder;
    a cluster without a shared folder configured is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf and "://" not in conf and not sc.master.startswith("local"):
        default_fs = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if default_fs.startswith("file:"):
            raise RuntimeError(f"spark.checkpoint.dir {conf!r} names no file system and the default one is local")
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    d = tempfile.mkdtemp(prefix="scorewell-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def materialize(df, name: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Used where one derived frame feeds several branches of a plan (each branch
    would otherwise recompute it) and to cut lineage: a lost executor re-reads
    the table instead of replaying the whole upstream join.  The table goes when
    the application ends, or before that with ``drop_scratch``.
    """
    return written(df, name)[1]


def written(df, name: str) -> tuple[str, object]:
    """``materialize`` with the table's path, for ``drop_table``."""
    spark = df.sparkSession
    path = scratch_table(spark, name)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return path, spark.read.schema(schema).parquet(path)


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table; what is written there goes with the application or ``drop_scratch``."""
    import uuid

    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    fs, p = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    _scratch(spark).append(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table that nothing reads any more."""
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)
    if path in _scratch(spark):
        _scratch(spark).remove(path)


def _scratch(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_scorewell_scratch"):
        sc._scorewell_scratch = []
    return sc._scorewell_scratch


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; call it once results that read them are stored."""
    paths = _scratch(spark)
    n = len(paths)
    while paths:
        fs, p = _hadoop_path(spark, paths.pop())
        fs.delete(p, True)
    return n


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once per session), for functions that run in Python there."""
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_scorewell_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="scorewell-package-"), "scorewell_package")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(home), os.path.basename(home)))
    sc._scorewell_shipped = True


def map_arrow(df, run, schema: str):
    """``mapInArrow`` with this package at hand in the tasks."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
