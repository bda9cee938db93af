"""What a session needs before Python workers run our code."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Arrow batches by size rather than by rows: a worker's memory must not depend on how long texts are.
BATCH, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), str(2 << 20)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so their Python workers can import it, and bounds what they get at once."""
    if spark.conf.get(BATCH).rstrip("b") == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_tarnfold_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tarnfold-")) / "tarnfold_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._tarnfold_shipped = True


#: Bytes that are enough for a task of its own.
TASK_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is too small for its files to give each a task; a large one is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * TASK_BYTES else df
