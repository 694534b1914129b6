"""Durable intermediate tables: in the folder of spark.checkpoint.dir, so that jobs survive lost executors. They are
deleted when the process ends, or by :func:`release` once results have been written."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="peakloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _tables.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Delete the tables of this process; results that read them must have been written before."""
    while _tables:
        spark, path = _tables.pop()
        if spark.sparkContext._jsc is None:  # the session has ended
            continue
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        try:
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  so has its JVM
            continue
