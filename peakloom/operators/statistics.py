"""Normalisation and statistics on the long matrix (feature_id, sample_id, intensity) and the sample table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def with_samples(matrix: DataFrame, samples: DataFrame) -> DataFrame:
    return matrix.join(samples, "sample_id")  # one row a sample: the planner broadcasts it as long as it is small


def high_quality(matrix: DataFrame, samples: DataFrame, *, blank_ratio: float = 0.5, rsd: float = 0.25) -> DataFrame:
    """Features whose mean over blanks is below ``blank_ratio`` of that over samples and, with more than two QCs, whose
    relative deviation over QCs is below ``rsd``. Missing cells count as 0. A study without blanks passes the first."""
    n = {r.kind: r.n for r in samples.groupBy(F.when(F.col("is_blank"), "blank").when(F.col("is_qc"), "qc").otherwise("sample").alias("kind")).agg(F.count("*").alias("n")).collect()}
    n_blank, n_qc = n.get("blank", 0), n.get("qc", 0)
    n_rest = max(1, n.get("sample", 0) + n_qc)
    v, own = F.col("intensity"), with_samples(matrix, samples)
    part = lambda c, x: F.sum(F.when(c, x).otherwise(0.0))
    qc = F.col("is_qc") & ~F.col("is_blank")
    sums = own.groupBy("feature_id").agg(part(F.col("is_blank"), v).alias("b"), part(~F.col("is_blank"), v).alias("s"), part(qc, v).alias("q"), part(qc, v * v).alias("qq"))
    mean_s = F.col("s") / n_rest
    ratio = F.lit(0.0) if not n_blank else (F.col("b") / n_blank) / F.when(mean_s == 0, 1.0).otherwise(mean_s)
    mean_q = F.col("q") / max(n_qc, 1)
    deviation = F.sqrt(F.greatest(F.lit(0.0), (F.col("qq") - max(n_qc, 1) * mean_q * mean_q) / max(n_qc - 1, 1)))
    out = sums.select("feature_id", ratio.alias("blank_ratio"), F.when(mean_q == 0, 99.0).otherwise(F.try_divide(deviation, mean_q)).alias("qc_rsd"))
    return out.withColumn("is_high_quality", (F.col("blank_ratio") < blank_ratio) & ((F.col("qc_rsd") < rsd) if n_qc > 2 else F.lit(True)))


def reference_sample(matrix: DataFrame, method: str = "number") -> DataFrame:
    """The sample of most features (``number``), most total or highest median intensity; of equal ones the smallest id."""
    measure = {"number": F.sum(F.when(F.col("intensity") > 0, 1).otherwise(0)).cast("double"), "total_intensity": F.round(F.sum("intensity"), 6), "median_intensity": F.median("intensity")}[method]
    by = matrix.groupBy("sample_id").agg(measure.alias("measure"))
    best = by.agg(F.min(F.struct((-F.col("measure")).alias("minus"), "sample_id")).alias("b"))
    return best.select(F.col("b.sample_id").alias("sample_id"), (-F.col("b.minus")).alias("measure"))


def factors(matrix: DataFrame, reference: DataFrame, method: str = "pqn") -> DataFrame:
    """A factor a sample: the median ratio to the reference sample over features positive in both (``pqn``), or the
    sample's total or median over the reference's. ``reference`` has one row."""
    own = matrix.where("intensity > 0")
    chosen = matrix.join(F.broadcast(reference.select("sample_id").limit(1)), "sample_id").where("intensity > 0")
    if method == "pqn":
        ratios = own.join(chosen.select("feature_id", F.col("intensity").alias("r")), "feature_id")
        return ratios.groupBy("sample_id").agg(F.median(F.col("intensity") / F.col("r")).alias("factor"))
    measure = {"total_intensity": F.sum, "median_intensity": F.median}.get(method)
    if measure is None:
        raise NotImplementedError(f"no factors by {method}")
    base = chosen.agg(measure("intensity").alias("base"))
    return own.groupBy("sample_id").agg(measure("intensity").alias("m")).join(F.broadcast(base)).select("sample_id", (F.col("m") / F.col("base")).alias("factor"))


def apply_factors(matrix: DataFrame, by: DataFrame) -> DataFrame:
    """Intensities over their sample's factor (0 and none count as 1), cut to whole numbers."""
    from ..plans.tables import stored
    from .rangejoin import sized

    f = F.coalesce(F.nullif(F.col("factor"), F.lit(0.0)), F.lit(1.0))
    by = sized(stored(by, "factors"))  # one row a sample: counted once it is there, and the matrix needn't move
    return matrix.join(by, "sample_id", "left").select("feature_id", "sample_id", (F.col("intensity") / f).cast("long").alias("intensity"))


def group_moments(matrix: DataFrame, samples: DataFrame, groups: Sequence) -> DataFrame:
    """n, sum and sum of squares a feature and group; partial sums before the shuffle."""
    own = with_samples(matrix, samples).where(F.col("group_id").isin(*groups))
    v = F.col("intensity")
    return own.groupBy("feature_id", "group_id").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def t_statistic(matrix: DataFrame, samples: DataFrame, groups: Sequence) -> DataFrame:
    """Student's t of two groups with pooled variance, and its degrees of freedom."""
    a, b = groups
    m = group_moments(matrix, samples, groups).groupBy("feature_id").pivot("group_id", [a, b]).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("var").alias("var"))
    n1, n2 = F.col(f"{a}_n"), F.col(f"{b}_n")
    df = n1 + n2 - 2
    pooled = ((n1 - 1) * F.col(f"{a}_var") + (n2 - 1) * F.col(f"{b}_var")) / F.nullif(df, F.lit(0))
    t = F.try_divide(F.col(f"{a}_mean") - F.col(f"{b}_mean"), F.nullif(F.sqrt(pooled * (1 / n1 + 1 / n2)), F.lit(0.0)))
    return m.where((n1 > 1) & (n2 > 1)).select("feature_id", df.cast("long").alias("df"), t.alias("t"))


def anova(matrix: DataFrame, samples: DataFrame, groups: Sequence) -> DataFrame:
    """One-way F: between over within mean squares, with both degrees of freedom."""
    m = group_moments(matrix, samples, groups)
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    total = m.groupBy("feature_id").agg(n.alias("n"), (mean / n).alias("grand"), F.count("*").alias("k"))
    parts = m.join(total, "feature_id").select("feature_id", F.col(m.columns[1]).alias("g"), "k", total["n"].alias("all"), (m["n"] * F.pow(m["mean"] - F.col("grand"), F.lit(2.0))).alias("between"), ((m["n"] - 1) * F.coalesce(m["var"], F.lit(0.0))).alias("within"))
    out = parts.groupBy("feature_id").agg(F.sum("between").alias("ssb"), F.sum("within").alias("ssw"), F.max("k").alias("k"), F.max("all").alias("n")).where((F.col("k") > 1) & (F.col("n") > F.col("k")))
    f = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.nullif(F.col("ssw") / (F.col("n") - F.col("k")), F.lit(0.0)))
    return out.select("feature_id", (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"), f.alias("f"))


def impute_scale(matrix: DataFrame, n_samples: int, relative: bool = False) -> DataFrame:
    """Positive intensities to log10 and z-scores (population) a feature; missing cells count as 0.2 of its least.
    ``relative``: above the score of the feature's missing cells, which then are 0 and needn't be listed; differences of
    samples and products of centred samples stay what they are."""
    v = F.log10("intensity")
    own = matrix.where("intensity > 0").withColumn("v", v)
    s = own.groupBy("feature_id").agg(F.count("*").alias("n"), F.avg("v").alias("a"), F.var_pop("v").alias("var"), F.log10(F.min("intensity") * 0.2).alias("fill"))
    missing = F.lit(n_samples) - F.col("n")
    # moments of the cells there are and of equal missing ones, put together without a difference of large sums
    step = F.col("a") - F.col("fill")
    s = s.withColumn("mean", (F.col("n") * F.col("a") + missing * F.col("fill")) / n_samples)
    s = s.withColumn("sd", F.sqrt(F.col("n") * (F.col("var") + missing * step * step / n_samples) / n_samples))
    z = F.try_divide(F.col("v") - F.col("fill" if relative else "mean"), F.nullif(F.round("sd", 9), F.lit(0.0)))
    return own.join(s.select("feature_id", "mean", "sd", "fill"), "feature_id").select("feature_id", "sample_id", F.coalesce(z, F.lit(0.0)).alias("z"))


def best_k(scores: DataFrame, k: int, score: str = "f") -> DataFrame:
    """The k rows of highest score, ties by feature_id."""
    return scores.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), "feature_id").limit(k)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    from math import lgamma

    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    log = np.vectorize(lgamma, otypes=[float])
    front = np.exp(log(p + q) - log(p) - log(q) + p * np.log(np.maximum(z, 1e-300)) + q * np.log1p(-np.minimum(z, 1 - 1e-16))) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


@F.pandas_udf(DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; 1 where t is missing (a constant row)."""
    t, d = t.to_numpy(float), df.to_numpy(float)
    return pd.Series(np.where(np.isnan(t), 1.0, incomplete_beta(d / 2, 0.5, d / (d + np.nan_to_num(t) ** 2))))


@F.pandas_udf(DoubleType())
def f_test_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper p of F; 1 where F is missing."""
    f, a, b = f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)
    return pd.Series(np.where(np.isnan(f), 1.0, incomplete_beta(b / 2, a / 2, b / (b + a * np.nan_to_num(f)))))


def batch_labels(runs: DataFrame, queue: str = "queue", file_id: str = "file_id", time: str = "time", ratio: float = 10.0) -> DataFrame:
    """Batches of a queue: a step longer than ``ratio`` times its shortest begins a new one. All 0 if any time is
    missing."""
    order = Window.partitionBy(queue).orderBy(time, file_id)
    whole = Window.partitionBy(queue)
    steps = runs.withColumn("_step", F.col(time) - F.lag(time).over(order)).withColumn("_least", F.min("_step").over(whole)).withColumn("_none", F.max(F.col(time).isNull()).over(whole))
    begins = F.when(~F.col("_none") & (F.col("_step") > F.col("_least") * ratio), 1).otherwise(0)
    return steps.withColumn("_begins", begins).withColumn("batch_id", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_step", "_least", "_none", "_begins")


def analytical_order(runs: DataFrame, queue: str = "queue", file_id: str = "file_id", time: str = "time") -> DataFrame:
    """Place in time from 0; files without a time come last."""
    order = Window.partitionBy(queue).orderBy(F.col(time).asc_nulls_last(), file_id)
    return runs.withColumn("analytical_order", (F.row_number().over(order) - 1).cast("long"))


def outlier_files(features: DataFrame, samples: DataFrame) -> DataFrame:
    """Files other than blanks whose highest feature is below a third of the median of these."""
    tops = features.join(samples.where("not is_blank").select("sample_id"), "sample_id").groupBy("sample_id").agg(F.max("peak_height").alias("highest"))
    middle = tops.agg(F.median("highest").alias("median_highest"))
    return tops.join(F.broadcast(middle)).where(F.col("highest") < F.col("median_highest") / 3)


def qc_band(matrix: DataFrame, samples: DataFrame, width: float = 1.96) -> DataFrame:
    """What a plot of QC stability shows, a feature: number of QCs, median, relative deviation (sample) and the band of
    ``width`` population deviations around the median."""
    own = with_samples(matrix, samples).where("is_qc and intensity > 0")
    v = F.col("intensity")
    sums = own.groupBy("feature_id").agg(F.count("*").alias("n_qc"), F.median(v).alias("median"), F.try_divide(F.stddev_samp(v), F.avg(v)).alias("rsd"), F.stddev_pop(v).alias("_sd"))
    return sums.select("feature_id", "n_qc", "median", "rsd", (F.col("median") - width * F.col("_sd")).alias("low"), (F.col("median") + width * F.col("_sd")).alias("high"))


def ellipse(points: DataFrame, group: str, x: str, y: str, deviations: float = 2.0) -> DataFrame:
    """The covariance ellipse of each group's points: centre, radii along both axes of the standardised plane
    (sqrt(1 + rho), sqrt(1 - rho)) and scales of x and y."""
    a, b = F.col(x), F.col(y)
    own = points.groupBy(group).agg(F.count("*").alias("n"), F.avg(a).alias("centre_x"), F.avg(b).alias("centre_y"), F.stddev_samp(a).alias("_sx"), F.stddev_samp(b).alias("_sy"), F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias("_rho"))
    radius = lambda sign: F.sqrt(F.greatest(F.lit(0.0), 1 + sign * F.col("_rho")))
    return own.select(group, "n", "centre_x", "centre_y", radius(1).alias("radius_x"), radius(-1).alias("radius_y"), (F.col("_sx") * deviations).alias("scale_x"), (F.col("_sy") * deviations).alias("scale_y"))
