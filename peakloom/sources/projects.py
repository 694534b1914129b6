"""Sample tables and project folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.statistics import batch_labels
from . import raw


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, is_qc, is_blank, group columns and align_order: QCs first, then samples, then blanks, by row of the
    file. A flag is set by ``yes`` in any case; an empty cell is no."""
    table = spark.read.csv(path, header=True)
    low = {c.lower(): c for c in table.columns[1:]}
    flag = lambda n: F.coalesce(F.lower(F.trim(F.col(low[n]))) == "yes", F.lit(False)) if n in low else F.lit(False)
    rest = [c for c in table.columns[1:] if c.lower() not in ("is_qc", "is_blank")]
    own = table.withColumn("_row", F.monotonically_increasing_id()).select(F.col(table.columns[0]).alias("sample_id"), flag("is_qc").alias("is_qc"), flag("is_blank").alias("is_blank"), *rest, "_row")
    place = F.when(F.col("is_qc"), 0).when(~F.col("is_blank"), 1).otherwise(2)
    from pyspark.sql import Window

    # one row a sample: a small window
    return own.withColumn("align_order", F.row_number().over(Window.orderBy(place, "_row")) - 1).drop("_row")


def sample_table(spark: SparkSession, data_dir: str) -> DataFrame:
    """An empty sample table for the raw files of a folder."""
    heads = raw.file_heads(spark, data_dir, 1)
    return heads.select(F.col("sample_id").alias("sample_name"), F.lit(None).cast("string").alias("is_qc"), F.lit(None).cast("string").alias("is_blank")).orderBy("sample_name")


def timestamps(spark: SparkSession, data_dir: str) -> DataFrame:
    return raw.probe(raw.file_heads(spark, data_dir)).select(F.col("sample_id").alias("file_name"), F.col("time").alias("acquisition_time")).orderBy("acquisition_time")


def prepare(spark: SparkSession, data_dir: str, samples: DataFrame | None = None) -> DataFrame:
    """The run table: samples with a file (is_valid), its probe, analytical order and batch."""
    probed = raw.probe(raw.file_heads(spark, data_dir))
    if samples is None:
        from pyspark.sql import Window

        samples = probed.select("sample_id", F.lit(False).alias("is_qc"), F.lit(False).alias("is_blank"), (F.row_number().over(Window.orderBy("sample_id")) - 1).alias("align_order"))
    own = samples.join(probed.withColumn("is_valid", F.lit(True)), "sample_id", "left").withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))
    timed = own.withColumn("_micros", F.unix_micros("time")).withColumn("_queue", F.lit(0))
    from ..operators.statistics import analytical_order

    labelled = batch_labels(timed, "_queue", "sample_id", "_micros")
    return analytical_order(labelled, "_queue", "sample_id", "_micros").drop("_queue", "_micros")
