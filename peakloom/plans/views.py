"""The driver's tables seen as chromatography data: once as DataFrames, once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as single peaks: sample_id, scan_id, rt (minutes), mz, intensity, peak_id."""
    micros = F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("sample_id"),
        F.floor(micros / F.lit(3.6e9)).cast("long").alias("scan_id"),
        (micros / F.lit(6e7)).alias("rt"),
        F.col("value").alias("mz"),
        (F.lit(1000) + (F.col("event_id") * 7919) % 100000).cast("double").alias("intensity"),
        F.col("event_id").alias("peak_id"),
    )


PEAKS = """peaks as (select event_type as sample_id, cast(floor((epoch_us(ts) - 1704067200000000) / 3.6e9) as bigint) as scan_id,
 (epoch_us(ts) - 1704067200000000) / 6e7 as rt, value as mz, cast(1000 + (event_id * 7919) % 100000 as double) as intensity, event_id as peak_id from events)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromatograms: per sample and m/z slice of width 20, the highest peak of each scan."""
    own = peaks(spark, sf_dir).withColumn("trace_id", F.floor(F.col("mz") / 20).cast("long"))
    return own.groupBy("sample_id", "trace_id", "scan_id").agg(F.min("rt").alias("rt"), F.max("intensity").alias("intensity"))


TRACES = PEAKS + """, traces as (select sample_id, cast(floor(mz / 20) as bigint) as trace_id, scan_id, min(rt) as rt, max(intensity) as intensity from peaks group by all)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as detected features; ``fid`` is a key of every row."""
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], *[F.round(F.col(c) * 100).cast("long").cast("string") for c in ("l_quantity", "l_extendedprice", "l_discount")])
    return table(spark, sf_dir, "lineitem").select(
        key.alias("fid"),
        (F.col("l_suppkey") % 20).alias("sample_id"),
        (F.col("l_extendedprice") / 100).alias("mz"),
        F.col("l_quantity").alias("rt"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("peak_height"),
        F.col("l_tax").alias("noise_score"),
        F.col("l_partkey").alias("part"),
    ).groupBy("fid").agg(*[F.min(c).alias(c) for c in ("sample_id", "mz", "rt", "peak_height", "noise_score", "part")])


FEATURES = """features as (select fid, min(sample_id) as sample_id, min(mz) as mz, min(rt) as rt, min(peak_height) as peak_height, min(noise_score) as noise_score, min(part) as part from (
 select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_quantity * 100) as bigint), cast(round(l_extendedprice * 100) as bigint), cast(round(l_discount * 100) as bigint)) as fid,
 l_suppkey % 20 as sample_id, l_extendedprice / 100 as mz, l_quantity as rt, l_extendedprice * (1 - l_discount) as peak_height, l_tax as noise_score, l_partkey as part from lineitem) group by fid)"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as spectra: m/z (place + 1) * 10, intensity the positive part * 1000."""
    intensity = lambda x: F.greatest(x.cast("double"), F.lit(0.0)) * 1000
    shown = F.transform("embedding", lambda x, i: F.struct(((i + 1) * 10).cast("double").alias("mz"), intensity(x).alias("intensity")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spectrum_id"), F.col("label").alias("group_id"), F.filter(shown, lambda p: p["intensity"] > 0).alias("peaks"))


SPECTRA = """spectrum_peaks as (select vec_id as spectrum_id, label as group_id, i * 10.0::double as mz, greatest(embedding[i]::double, 0) * 1000 as intensity
 from embeddings, (select unnest(range(1, 65)) as i) where embedding[i] > 0)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long intensity matrix: feature, sample, intensity."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("feature_id"), (F.col("l_suppkey") % 20).alias("sample_id"), F.col("l_quantity").alias("q"))
    return own.groupBy("feature_id", "sample_id").agg(F.sum("q").alias("intensity"))


def samples(spark: SparkSession) -> DataFrame:
    """The 20 samples of the matrix: every fifth is a QC, every seventh (6, 13) a blank."""
    own = spark.range(20).select(F.col("id").alias("sample_id"))
    qc = F.col("sample_id") % 5 == 0
    return own.select("sample_id", qc.alias("is_qc"), ((F.col("sample_id") % 7 == 6) & ~qc).alias("is_blank"), (F.col("sample_id") % 3).cast("int").alias("group_id"))


MATRIX = """matrix as (select l_partkey as feature_id, l_suppkey % 20 as sample_id, sum(l_quantity) as intensity from lineitem group by all),
samples as (select sample_id, sample_id % 5 = 0 as is_qc, sample_id % 7 = 6 and sample_id % 5 <> 0 as is_blank, cast(sample_id % 3 as int) as group_id from (select unnest(range(0, 20)) as sample_id))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as acquisitions: one queue a customer."""
    micros = F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, cast(o_orderdate as timestamp_ntz))")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("queue"), F.col("o_orderkey").alias("file_id"), micros.alias("time"))


RUNS = """runs as (select o_custkey as queue, o_orderkey as file_id, epoch_us(o_orderdate) - 1704067200000000 as time from orders)"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lib_id"), F.col("p_name").alias("name"), (F.col("p_retailprice") / 10).alias("lib_mz"), F.col("p_size").cast("double").alias("lib_rt"))


LIBRARY = """library as (select p_partkey as lib_id, p_name as name, p_retailprice / 10 as lib_mz, cast(p_size as double) as lib_rt from part)"""
