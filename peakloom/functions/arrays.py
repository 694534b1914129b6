"""Kernels over arrays of peaks or intensities as column expressions: they run in the JVM, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(peaks: Column, mz_low: float, mz_high: float, int_low: float, int_high: float = float("inf")) -> Column:
    """Peaks strictly within both ranges."""
    return F.filter(peaks, lambda p: (p["mz"] > mz_low) & (p["mz"] < mz_high) & (p["intensity"] > int_low) & (p["intensity"] < int_high))


def base_intensity(peaks: Column) -> Column:
    return F.array_max(F.transform(peaks, lambda p: p["intensity"]))


def clean_ms2(peaks: Column, precursor_mz: Column, abs_tol: float, rel_tol: float, offset: float) -> Column:
    """Peaks above max(absolute, relative to the base peak) and below precursor - offset (any, without a precursor)."""
    least = F.greatest(F.lit(float(abs_tol)), base_intensity(peaks) * rel_tol)
    return _let(F.struct(least.alias("i"), precursor_mz.alias("m")), lambda t: F.filter(peaks, lambda p: (p["intensity"] > t["i"]) & (t["m"].isNull() | (p["mz"] < t["m"] - offset))))


def centroid(peaks: Column, tol: float) -> Column:
    """Peaks in order of m/z, those less than ``tol`` apart joined: summed intensity, intensity-weighted m/z."""
    point = "struct<mz:double,intensity:double>"
    start = F.struct(F.array().cast(f"array<{point}>").alias("out"), F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    closed = lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(F.try_divide(acc["w"], acc["s"]).alias("mz"), acc["s"].alias("intensity")))))

    def step(acc: Column, p: Column) -> Column:
        mz, i = p["mz"].cast("double"), p["intensity"].cast("double")
        near = acc["last"].isNotNull() & (mz - acc["last"] < tol)
        return F.struct(
            F.when(near, acc["out"]).otherwise(closed(acc)).alias("out"),
            mz.alias("last"),
            F.when(near, acc["s"] + i).otherwise(i).alias("s"),
            F.when(near, acc["w"] + mz * i).otherwise(mz * i).alias("w"),
        )

    return F.aggregate(F.array_sort(peaks), start, step, closed)


def base_peak(peaks: Column) -> Column:
    """The highest peak, of equal ones that of least m/z."""
    best = F.array_max(F.transform(peaks, lambda p: F.struct(p["intensity"].alias("intensity"), (-p["mz"]).alias("minus_mz"))))
    return F.struct((-best["minus_mz"]).alias("mz"), best["intensity"].alias("intensity"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def noise_score(y: Column, least: float = 0.05, points: int = 5) -> Column:
    """Sum of steps of the values above ``least`` of the highest (0 at both ends), over twice that, less 1."""

    def of(t: Column) -> Column:
        def steps(k: Column) -> Column:
            inner = F.aggregate(F.sequence(F.lit(1), F.size(k) - 1), F.lit(0.0), lambda a, i: a + F.abs(F.get(k, i) - F.get(k, i - 1)))
            return F.when(F.size(k) < points, F.lit(0.0)).otherwise((F.get(k, F.lit(0)) + inner + F.element_at(k, -1)) / t / 2 - 1)

        return _let(F.filter(y, lambda v: v > t * least), steps)

    return _let(F.array_max(y), of)


def apex(y: Column) -> Column:
    """Place, from 0, of the first highest value."""
    return (F.array_position(y, F.array_max(y)) - 1).cast("int")


def _peak(y: Column) -> Column:
    return F.struct(F.array_max(y).alias("top"), apex(y).alias("at"))


def gaussian_similarity(x: Column, y: Column, points: int = 5) -> Column:
    """Pearson correlation of a trace with the Gaussian of its height, apex and width at half height; at least 0."""
    n = F.size(y)
    places = F.sequence(F.lit(0), n - 1)

    def shape(p: Column) -> Column:
        below = lambda i: F.get(y, i) < p["top"] / 2
        right = F.coalesce(F.get(x, F.array_min(F.filter(places, lambda i: (i >= p["at"]) & below(i)))), F.element_at(x, -1))
        left = F.coalesce(F.get(x, F.array_max(F.filter(places, lambda i: (i < p["at"]) & below(i)))), F.get(x, F.lit(0)))
        return F.struct(F.get(x, p["at"]).alias("b"), F.when(right == left, F.lit(1e-6)).otherwise((right - left) / 2.355).alias("c"), p["top"].alias("a"))

    def fit(s: Column) -> Column:
        return F.transform(x, lambda v: s["a"] * F.exp(F.lit(-0.5) * F.pow((v - s["b"]) / s["c"], F.lit(2.0))))

    def corr(f: Column) -> Column:
        def of(m: Column) -> Column:
            cov = total(F.zip_with(y, f, lambda p, q: (p - m["y"]) * (q - m["f"])))
            vy = total(F.transform(y, lambda p: (p - m["y"]) * (p - m["y"])))
            vf = total(F.transform(f, lambda q: (q - m["f"]) * (q - m["f"])))
            return F.greatest(F.lit(0.0), cov / (F.sqrt(vy * vf) + 1e-12))

        return _let(F.struct((total(y) / n).alias("y"), (total(f) / n).alias("f")), of)

    return F.when(n < points, F.lit(0.0)).otherwise(_let(_peak(y), lambda p: _let(shape(p), lambda s: _let(fit(s), corr))))


def asymmetry(y: Column, share: float = 0.1, points: int = 5) -> Column:
    """Points right of the apex over points left of it, down to ``share`` of the height. Infinite (null here) for fewer
    than ``points`` values, 99 if the apex is where the peak begins."""
    n = F.size(y)
    places = F.sequence(F.lit(0), n - 1)

    def sides(p: Column) -> Column:
        low = lambda i: F.get(y, i) < p["top"] * share
        right = F.coalesce(F.array_min(F.filter(places, lambda i: (i > p["at"]) & low(i))), n - 1)
        left = F.coalesce(F.array_max(F.filter(places, lambda i: (i < p["at"]) & low(i))), F.lit(0))
        return F.struct((right - p["at"]).cast("double").alias("r"), (p["at"] - left).alias("l"))

    return F.when(n < points, F.lit(None).cast("double")).otherwise(_let(_let(_peak(y), sides), lambda s: F.when(s["l"] == 0, F.lit(99.0)).otherwise(s["r"] / s["l"])))


def trapezoid(x: Column, y: Column) -> Column:
    """Area in seconds of a trace whose x is in minutes."""
    steps = F.sequence(F.lit(1), F.size(x) - 1)
    area = F.aggregate(steps, F.lit(0.0), lambda a, i: a + (F.get(x, i) - F.get(x, i - 1)) * (F.get(y, i) + F.get(y, i - 1)) / 2)
    return F.when(F.size(x) < 2, F.lit(0.0)).otherwise(area * 60)


def top_average(y: Column, k: int = 3) -> Column:
    best = F.slice(F.sort_array(y, asc=False), 1, k)
    return total(best) / F.greatest(F.lit(1), F.size(best))


def squared_error(observed: Column, fitted: Column) -> Column:
    """Sum of ((o - f) / max o) squared."""
    return _let(F.array_max(observed), lambda top: total(F.zip_with(observed, fitted, lambda o, f: F.pow((o - f) / top, F.lit(2.0)))))


def trimmed(y: Column) -> Column:
    """The values without zeros at either end."""
    places = F.filter(F.sequence(F.lit(1), F.size(y)), lambda i: F.element_at(y, i) != 0)
    return F.when(F.size(places) > 0, F.slice(y, F.array_min(places), F.array_max(places) - F.array_min(places) + 1)).otherwise(F.slice(y, 1, 0))


def isotope_signals(mz: Column, peaks: Column, tol: float, limit: float = 1.5, num: int = 5) -> Column:
    """Peaks near mz + 0 ... num - 1, lower than ``limit`` times the peak nearest to mz."""
    nearest = lambda m: F.array_min(F.transform(peaks, lambda p: F.struct(F.abs(p["mz"] - m).alias("d"), p["intensity"].alias("i"))))["i"]
    near = lambda p, m: F.exists(F.sequence(F.lit(0), F.lit(num - 1)), lambda k: F.abs(p["mz"] - m - k) < tol)
    return _let(mz, lambda m: _let(nearest(m), lambda i: F.filter(peaks, lambda p: near(p, m) & (p["intensity"] < i * limit))))


def encode_spectrum(peaks: Column) -> Column:
    """``mz;intensity|mz;intensity`` with four decimals."""
    return F.array_join(F.transform(peaks, lambda p: F.concat_ws(";", F.format_string("%.4f", F.bround(p["mz"].cast("double"), 4)), F.format_string("%.4f", F.bround(p["intensity"].cast("double"), 4)))), "|")


def decode_spectrum(text: Column) -> Column:
    """The peaks of such a string; raises if a number is missing."""
    pair = lambda s: F.split(s, ";")
    number = lambda s, i: F.when(F.size(pair(s)) == 2, F.element_at(pair(s), i).cast("double")).otherwise(F.raise_error(F.lit("a peak needs m/z and intensity")).cast("double"))
    return F.when(text.isNull() | (text == ""), F.array().cast("array<struct<mz:double,intensity:double>>")).otherwise(F.transform(F.split(text, r"\|"), lambda s: F.struct(number(s, 1).alias("mz"), number(s, 2).alias("intensity"))))


def add_signals(peaks: Column, more: Column) -> Column:
    """Both spectra's peaks in order of m/z, then intensity; null counts as none."""
    none = F.array().cast("array<struct<mz:double,intensity:double>>")
    plain = lambda p: F.transform(F.coalesce(p, none), lambda x: F.struct(x["mz"].cast("double").alias("mz"), x["intensity"].cast("double").alias("intensity")))
    return F.array_sort(F.concat(plain(peaks), plain(more)))


def subset(values: Column, start: int, end: int) -> Column:
    """The values at places from ``start`` on, before ``end``."""
    return F.slice(values, start + 1, max(0, end - start))


def gaussian(x: Column, a: Column, b: Column, c: Column) -> Column:
    return a * F.exp(F.lit(-0.5) * F.pow((x - b) / c, F.lit(2.0)))


def safe_float(text: Column) -> Column:
    """A number; a single comma without a dot counts as the decimal mark; null if it is none."""
    comma = (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) == 1) & ~F.contains(text, F.lit("."))
    return F.when(comma, F.replace(text, F.lit(","), F.lit("."))).otherwise(text).try_cast("double")


def interpolate(x: Column, knots: Column) -> Column:
    """Piecewise linear through ``knots`` (array of struct x, y, sorted by x), extended at both ends; x itself for fewer
    than two knots."""
    n = F.size(knots)
    above = F.size(F.filter(knots, lambda k: k["x"] <= x))
    i = F.greatest(F.lit(1), F.least(above, n - 1))
    a, b = F.get(knots, i - 1), F.get(knots, i)
    return F.when(n < 2, x).otherwise(a["y"] + (x - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"]))


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)
