"""Operators over peaks in long form and over scans: cleaning, centroids, chromatograms, nearest scans, MS2 choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from .islands import islands
from .rangejoin import nearest, range_join


def scan_filter(scans: DataFrame, levels: Sequence[int], rt_low: float, rt_high: float) -> DataFrame:
    """Scans of the levels with rt_low <= rt <= rt_high; scan ids stay those of the file."""
    return scans.where(F.col("level").isin(*levels) & F.col("rt").between(rt_low, rt_high))


def clean_scans(scans: DataFrame, *, mz_low: float = 0.0, mz_high: float = float("inf"), ms1_abs: float = 1000.0, ms2_abs: float = 500.0, ms2_rel: float = 0.01, offset: float = 2.0, centroid_tol: float | None = 0.005) -> DataFrame:
    """MS1 and MS2 cleaning, then centroids; arrays only, so the plan is one narrow stage."""
    ms1 = arrays.clean(F.col("peaks"), mz_low, mz_high, ms1_abs)
    ms2 = arrays.clean_ms2(arrays.clean(F.col("peaks"), mz_low, mz_high, float("-inf")), F.col("precursor_mz"), ms2_abs, ms2_rel, offset)
    cleaned = F.when(F.col("level") == 1, ms1).otherwise(ms2)
    if centroid_tol is not None:
        cleaned = arrays.centroid(cleaned, centroid_tol).cast("array<struct<mz:float,intensity:float>>")
    return scans.withColumn("peaks", cleaned)


def explode_scans(scans: DataFrame) -> DataFrame:
    return scans.select(*[c for c in scans.columns if c != "peaks"], F.explode("peaks").alias("_p")).select("*", F.col("_p.mz").cast("double").alias("mz"), F.col("_p.intensity").cast("double").alias("intensity")).drop("_p")


def base_peaks(peaks: DataFrame, keys: Sequence[str] = ("sample_id", "scan_id")) -> DataFrame:
    """Base-peak chromatogram: each scan's highest peak, of equal ones that of least m/z."""
    best = F.max(F.struct("intensity", (-F.col("mz")).alias("minus"), "rt"))
    return peaks.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.rt").alias("rt"), (-F.col("b.minus")).alias("mz"), F.col("b.intensity").alias("intensity"))


def centroid_long(peaks: DataFrame, tol: float, keys: Sequence[str] = ("sample_id", "scan_id")) -> DataFrame:
    """Centroids of peaks in long form: a step in m/z of ``tol`` or more begins a new one."""
    grouped = islands(peaks, keys, "mz", tol, ties=("intensity",))
    s = F.sum("intensity")
    return grouped.groupBy(*keys, "island").agg(F.try_divide(F.sum(F.col("mz") * F.col("intensity")), s).alias("mz"), s.alias("intensity"), F.count("*").alias("n_peaks")).drop("island")


def extract_ions(peaks: DataFrame, targets: DataFrame, *, mz_tol: float, rt_tol: float, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Ion chromatograms: for each target (target_id, target_mz, target_rt) every scan within rt_tol, with the highest
    peak within mz_tol (both inclusive), or null and 0. Targets are joined with scans by rt and with peaks by m/z, each
    a binned join; the scan list, not the peaks, carries the outer side."""
    scans = peaks.groupBy(*keys, "scan_id").agg(F.min("rt").alias("rt"))
    windows = range_join(scans, targets, "rt", "target_rt", rt_tol, strict=False)
    hits = range_join(peaks.drop("rt"), targets, "mz", "target_mz", mz_tol, strict=False)
    best = hits.groupBy("target_id", *keys, "scan_id").agg(F.max(F.struct("intensity", (-F.col("mz")).alias("minus"))).alias("b"))
    out = windows.join(best, ["target_id", *keys, "scan_id"], "left")
    return out.select("target_id", *keys, "scan_id", "rt", (-F.col("b.minus")).alias("mz"), F.coalesce("b.intensity", F.lit(0.0)).alias("intensity"))


def lookup(df: DataFrame, mz: float, mz_tol: float, rt: float | None = None, rt_tol: float | None = None, best: str | None = None) -> DataFrame:
    """Rows with |mz - m| < tol and, if given, |rt - t| < tol; with ``best`` the one row where that is largest."""
    out = df.where(F.abs(F.col("mz") - mz) < mz_tol)
    if rt is not None:
        out = out.where(F.abs(F.col("rt") - rt) < rt_tol)
    return out.orderBy(F.col(best).desc()).limit(1) if best else out


def nearest_scans(targets: DataFrame, scans: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Adds the scan_id of the scan nearest in time to each target (target_id, target_rt)."""
    return nearest(targets, scans, "target_id", "target_rt", "rt", "scan_id", equi=keys)


def allocate_ms2(features: DataFrame, ms2: DataFrame, mz_tol: float = 0.1, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Each MS2 scan (ms2_id, precursor_mz, ms2_rt) to one feature (feature_id, mz, rt_start, rt_end, peak_height): the
    highest of those within mz_tol whose span holds its time, both strict; of equal ones the smallest id."""
    pairs = range_join(ms2, features, "precursor_mz", "mz", mz_tol, equi=keys).where((F.col("rt_start") < F.col("ms2_rt")) & (F.col("ms2_rt") < F.col("rt_end")))
    best = F.min(F.struct((-F.col("peak_height")).alias("minus"), "feature_id"))
    return pairs.groupBy(*keys, "ms2_id").agg(best.alias("b")).select(*keys, "ms2_id", F.col("b.feature_id").alias("feature_id"))


def best_ms2(spectra: DataFrame, key: str, id_col: str, peaks: str = "peaks") -> DataFrame:
    """Of each ``key``'s spectra the one of most ions, of equal ones the smallest id; none if that is 0."""
    tic = arrays.total(F.transform(peaks, lambda p: p["intensity"]))
    best = spectra.select(key, tic.alias("tic"), id_col).groupBy(key).agg(F.min(F.struct((-F.col("tic")).alias("minus"), id_col)).alias("b"))
    return best.select(key, F.col(f"b.{id_col}").alias(id_col), (-F.col("b.minus")).alias("tic")).where("tic > 0")


def precursor_fraction(ms2: DataFrame, peaks: DataFrame, low: float, high: float, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Share of the precursor in its isolation window (mz - low, mz + high) in the nearest MS1 scan: the intensity of
    the peak nearest to the precursor over that of all in the window; 0 where any of it is missing."""
    scans = peaks.groupBy(*keys, "scan_id").agg(F.min("rt").alias("rt"))
    placed = nearest(ms2, scans, "ms2_id", "ms2_rt", "rt", "scan_id", equi=keys)
    inside = placed.join(peaks.drop("rt"), [*keys, "scan_id"]).where((F.col("mz") > F.col("precursor_mz") - low) & (F.col("mz") < F.col("precursor_mz") + high))
    near = F.min(F.struct(F.abs(F.col("mz") - F.col("precursor_mz")).alias("d"), "mz", "intensity"))
    share = inside.groupBy("ms2_id").agg(near.alias("b"), F.sum("intensity").alias("s")).select("ms2_id", F.try_divide("b.intensity", "s").alias("fraction"))
    return placed.join(share, "ms2_id", "left").select("ms2_id", *keys, F.coalesce("fraction", F.lit(0.0)).alias("fraction"))


def spectral_rate(scans: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Scans a second: 1 / (mean positive step * 60)."""
    step = F.col("rt") - F.lag("rt").over(Window.partitionBy(*keys).orderBy("scan_id"))
    return scans.withColumn("_step", step).groupBy(*keys).agg(F.try_divide(F.lit(1.0), F.avg(F.when(F.col("_step") > 0, F.col("_step"))) * 60).alias("rate_hz"))


def spread_errors(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Three population standard deviations of m/z and rt."""
    return df.groupBy(*keys).agg((3 * F.stddev_pop("mz")).alias("mz_error"), (3 * F.stddev_pop("rt")).alias("rt_error"))


def as_traces(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arrays rt and intensity in scan order for each key. A trace has at most one point a scan of one sample."""
    ordered = F.sort_array(F.collect_list(F.struct("scan_id", "rt", "intensity")))
    return points.groupBy(*keys).agg(ordered.alias("t")).select(*keys, F.col("t.rt").alias("x"), F.col("t.intensity").alias("y"))


def trace_scores(traces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All scores of traces (x, y) in one projection."""
    x, y = F.col("x"), F.col("y")
    return traces.select(
        *keys,
        F.size(y).cast("long").alias("n_points"),
        arrays.noise_score(y).alias("noise_score"),
        arrays.gaussian_similarity(x, y).alias("gaussian_similarity"),
        arrays.asymmetry(y).alias("asymmetry_factor"),
        arrays.trapezoid(x, y).alias("area"),
        arrays.top_average(y).alias("top_average"),
    )


def scan_correlation(points: DataFrame, keys: Sequence[str], pair: Sequence[str], least: int = 3) -> DataFrame:
    """Pearson correlation over scans where both intensities (columns ``pair``) are positive; 1 for fewer than ``least``."""
    a, b = pair
    both = points.where((F.col(a) > 0) & (F.col(b) > 0))
    return both.groupBy(*keys).agg(F.when(F.count("*") < least, F.lit(1.0)).otherwise(F.corr(a, b)).alias("correlation"), F.count("*").alias("n_common"))


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)
