"""New raw files as they arrive: the checkpoint of the stream remembers those already read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..params import Params
from ..plans import workflows


def watch(spark: SparkSession, data_dir: str, out: str, checkpoint: str, params: Params | None = None, files_a_batch: int = 100, once: bool = False) -> StreamingQuery:
    """Features of every new file below ``out``, by sample. A batch that is run again replaces its own samples."""
    params = params or Params()
    new = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_batch).load(data_dir).select("path")

    def take(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.collect()]  # at most files_a_batch
        if paths:
            features, _, errors = workflows.detect(spark, paths, params)
            features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").parquet(out)
            errors.withColumn("batch", F.lit(number)).write.mode("append").json(f"{out}_errors")

    writer = new.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def session_labels(events: DataFrame, gap: str, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Batches of acquisitions in a stream: sessions that end after ``gap`` without a run."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(*keys, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("n")).select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")
