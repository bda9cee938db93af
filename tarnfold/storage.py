"""Tables in the folder that driver and executors share. What is written there goes when the driver ends, or with its scratch() block."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tarnfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(made: list[tuple[SparkSession, str]]) -> None:
    for spark, path in made:
        try:
            found = spark._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(found, True)
        except Exception:  # noqa: BLE001, S110  a folder that stays does no harm, and the session may be gone
            pass


@contextmanager
def scratch():
    """Removes what is stored inside when the block ends."""
    before = len(_made)
    try:
        yield
    finally:
        inside = _made[before:]
        del _made[before:]
        removed(inside)


atexit.register(lambda: removed(_made))
