"""Relational parts of alignment: anchors, reference file, unique matches, merging, detection rates, gap cells, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import islands
from .rangejoin import range_join


def anchors(features: DataFrame, keys: Sequence[str], id_col: str, *, mz_tol: float = 0.01, noise: float = 0.1, num: int = 100) -> DataFrame:
    """Of each key's features, in order of m/z, inner ones further than ``mz_tol`` from both neighbours and with less
    noise than ``noise``; the ``num`` highest."""
    order = Window.partitionBy(*keys).orderBy("mz", id_col)
    lone = features.withColumn("_below", F.col("mz") - F.lag("mz").over(order)).withColumn("_above", F.lead("mz").over(order) - F.col("mz"))
    lone = lone.where((F.col("_below") > mz_tol) & (F.col("_above") > mz_tol) & (F.col("noise_score") < noise)).drop("_below", "_above")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("peak_height").desc(), id_col))
    return lone.withColumn("anchor_rank", rank.cast("long")).where(F.col("anchor_rank") <= num)


def reference_file(features: DataFrame) -> DataFrame:
    """The sample of middle rank (n div 2, from 0) by total height."""
    totals = features.groupBy("sample_id").agg(F.sum("peak_height").alias("total_height"))
    # one row a sample: a small window
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.round("total_height", 2), "sample_id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    return ranked.where(F.col("rank") == F.floor(F.col("n") / 2)).select("sample_id", "total_height")


def unique_matches(anchor: DataFrame, rows: DataFrame, *, mz_tol: float = 0.01, rt_tol: float = 0.5, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Anchors (anchor_id, anchor_mz, anchor_rt) with exactly one row of a sample within both tolerances, and that rt."""
    pairs = range_join(rows, anchor, "mz", "anchor_mz", mz_tol).where(F.abs(F.col("rt") - F.col("anchor_rt")) < rt_tol)
    one = pairs.groupBy("anchor_id", *keys).agg(F.count("*").alias("n"), F.min("rt").alias("rt"), F.min("anchor_rt").alias("anchor_rt"))
    return one.where("n = 1").drop("n")


def merge_features(features: DataFrame, keys: Sequence[str], id_col: str, *, mz_tol: float = 0.005, rt_tol: float = 0.03) -> DataFrame:
    """Islands in m/z, inside them islands in rt; each becomes its highest feature with the number of members. One of
    ``keys`` is one file: its features, some 100,000 at most, are sorted by one task. A table over all files, which has
    no such key, is merged by global islands (see ``plans.workflows.align``)."""
    by_mz = islands(features, keys, "mz", mz_tol, ties=(id_col,), name="mz_island")
    by_rt = islands(by_mz, [*keys, "mz_island"], "rt", rt_tol, ties=(id_col,), name="rt_island")
    best = F.min(F.struct((-F.col("peak_height")).alias("minus"), id_col, "mz", "rt"))
    out = by_rt.groupBy(*keys, "mz_island", "rt_island").agg(best.alias("b"), F.count("*").alias("members"))
    return out.select(*keys, F.col(f"b.{id_col}").alias(id_col), F.col("b.mz").alias("mz"), F.col("b.rt").alias("rt"), (-F.col("b.minus")).alias("peak_height"), "members")


def missing_cells(quant: DataFrame, samples: DataFrame) -> DataFrame:
    """feature_id and sample_id of the cells without a value. The few samples are gathered to one array, so each feature
    is one row until its missing cells are listed."""
    every = samples.agg(F.collect_set("sample_id").alias("every"))
    seen = quant.groupBy("feature_id").agg(F.collect_set("sample_id").alias("seen"))
    return seen.join(F.broadcast(every)).select("feature_id", F.explode(F.array_except("every", "seen")).alias("sample_id"))


def detection_rate(quant: DataFrame, samples: DataFrame, value: str = "intensity") -> DataFrame:
    """Per feature the share of samples, blanks left out, with a value above 0."""
    n = samples.where("not is_blank").count()
    kept = quant.join(samples.select("sample_id", "is_blank"), "sample_id")
    hits = F.sum(F.when(~F.col("is_blank") & (F.col(value) > 0), 1).otherwise(0))
    return kept.groupBy("feature_id").agg((hits / F.lit(float(max(n, 1)))).alias("detection_rate"), F.max(value).alias("highest"))


def wide(quant: DataFrame, names: Sequence, value: str = "intensity", prefix: str = "s") -> DataFrame:
    """One row a feature, one whole-number column a sample; 0 where missing. Names are given, so the plan has no extra job."""
    table = quant.groupBy("feature_id").pivot("sample_id", list(names)).agg(F.first(value))
    return table.select("feature_id", *[F.coalesce(F.col(str(n)).cast("long"), F.lit(0)).alias(f"{prefix}{n}") for n in names])


def assignable(candidates: DataFrame, left: str, right: str, *order: Column) -> DataFrame:
    """The best candidate a ``left`` by ``order``, ties by ``right``."""
    rank = F.row_number().over(Window.partitionBy(left).orderBy(*order, right))
    return candidates.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def passes_scores(gaussian: Column, noise: Column, gaussian_tol: float = 0.7, noise_tol: float = 2.0) -> Column:
    return (gaussian > gaussian_tol) & (noise < noise_tol)


def alignable(features: DataFrame, scan_cutoff: int = 5) -> DataFrame:
    """Features (ms2, total_scans) that alignment takes up: with a spectrum, or seen in more than ``scan_cutoff`` scans."""
    return features.where(F.col("ms2").isNotNull() | (F.col("total_scans") > scan_cutoff))


def finally_kept(features: DataFrame, *, gaussian_tol: float = 0.7, noise_tol: float = 2.0, rate: float = 0.1, ms1_tol: float = 1000.0) -> DataFrame:
    """Aligned features (has_ms2, gaussian, noise, detection_rate, highest) that stay: with a spectrum or good scores,
    and detected in more than ``rate`` of the samples or at least ten times ``ms1_tol`` high."""
    good = F.col("has_ms2") | passes_scores(F.col("gaussian"), F.col("noise"), gaussian_tol, noise_tol)
    return features.where(good & ((F.col("detection_rate") > rate) | (F.col("highest") >= 10 * ms1_tol)))


def reference_values(quant: DataFrame, value: str = "intensity") -> DataFrame:
    """Each feature's sample of highest value (of equal ones the smallest), that value and how many samples it is in."""
    best = F.min(F.struct((-F.col(value)).alias("minus"), "sample_id"))
    return quant.groupBy("feature_id").agg(best.alias("b"), F.count("*").alias("n_samples")).select("feature_id", F.col("b.sample_id").alias("reference"), (-F.col("b.minus")).alias("highest"), "n_samples")


def classifiable(features: DataFrame, *, gaussian: float = 0.6, rate: float = 0.5) -> DataFrame:
    """Features that a classifier is built on: annotated by identity, of good shape, neither fragments nor isotopes; the
    first of each annotation; of these the ones detected in more than ``rate`` of the samples."""
    own = features.where((F.col("search_mode") == "identity_search") & (F.col("gaussian_similarity") > gaussian) & ~F.col("is_in_source_fragment") & ~F.col("is_isotope"))
    rank = F.row_number().over(Window.partitionBy("annotation").orderBy("feature_id"))
    return own.withColumn("_rank", rank).where("_rank = 1").drop("_rank").where(F.col("detection_rate") > rate)
