"""Sums of numpy arrays over all rows of a table, added in two levels.

Every task adds up its own batches and emits one array; arrays are added in groups
of about the square root of their number, and the driver adds the groups' sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.session import map_arrow


def tree_sum(df: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], size: int, direct: bool = False) -> np.ndarray:
    """The sum of ``partial(batch)`` (float64 arrays of ``size`` numbers) over all batches.

    ``direct`` leaves the second level out, where the caller knows that tasks are few.
    """

    def per_task(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = partial(batch)
                total = np.array(part, np.float64) if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["m"])

    def add(batches):
        total = None
        for batch in batches:
            for m in batch.column(0):
                part = np.frombuffer(m.as_buffer(), "<f8")
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    groups = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))) + 1
    # keyed by the task, so a task that runs again sends its sum to the same group
    parts = map_arrow(df, per_task, "m binary").withColumn("_t", F.spark_partition_id())
    sums = parts.select("m") if direct else map_arrow(
        parts.repartition(groups, "_t").sortWithinPartitions("_t").select("m"), add, "m binary"
    )
    out = np.zeros(size)
    for r in sums.collect():  # at most ``groups`` rows, or the few tasks'
        out += np.frombuffer(r["m"], "<f8")
    return out
