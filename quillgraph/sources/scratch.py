"""Tables that a job writes for itself: in the folder that driver and executors share, gone when the driver's Python ends."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; for a local master without one, a local folder.  Elsewhere its lack is an error."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {spark.sparkContext.master} share")
        there = f"file://{tempfile.mkdtemp(prefix='quillgraph-')}"
        spark.sparkContext.setCheckpointDir(there)
    return there


def path(spark: SparkSession, name: str) -> str:
    """A new path of that name, removed when the driver's Python ends."""
    if not _written:
        atexit.register(_clean)
    new = f"{folder(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    _written[new] = spark
    return new


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table read back: later steps re-read it instead of computing it again."""
    there = path(df.sparkSession, name)
    df.write.parquet(there)
    return df.sparkSession.read.schema(df.schema).parquet(there)


def _clean() -> None:
    for there, spark in _written.items():
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(there)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone already
            return
