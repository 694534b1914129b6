"""Registered queries of the engine, each an operator over a view of the driver's tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, chem
from ..operators import alignment, annotation, detection, islands, learning, rangejoin, spectra, statistics
from ..sources import sinks
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
R = spectra.rounded


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


def _r(name: str) -> str:
    return f"round({name}::double, 6) as {name.split('.')[-1]}"


# ---- spectra and chromatograms

@query(f"with {V.PEAKS} select sample_id, scan_id, rt, mz, intensity from (select *, row_number() over (partition by sample_id, scan_id order by intensity desc, mz, rt desc) as k from peaks) where k = 1")
def bpc(spark, sf):
    return spectra.base_peaks(V.peaks(spark, sf))


_TARGETS = [(1, 5.0, 2000.0), (2, 12.5, 9000.0), (3, 20.0, 20000.0), (4, 33.0, 30000.0), (5, 60.0, 40000.0), (6, 105.25, 12000.0)]


@query(f"""with {V.PEAKS}, targets(target_id, target_mz, target_rt) as (values {', '.join(f'({a}::bigint, {b}::double, {c}::double)' for a, b, c in _TARGETS)}),
scans as (select sample_id, scan_id, min(rt) as rt from peaks group by all),
hits as (select target_id, sample_id, scan_id, mz, intensity, row_number() over (partition by target_id, sample_id, scan_id order by intensity desc, mz) as k from peaks, targets where abs(mz - target_mz) <= 0.5)
select t.target_id, s.sample_id, s.scan_id, s.rt, h.mz, coalesce(h.intensity, 0.0)::double as intensity
from scans s join targets t on abs(s.rt - t.target_rt) <= 3000 left join hits h on h.k = 1 and h.target_id = t.target_id and h.sample_id = s.sample_id and h.scan_id = s.scan_id""")
def eic_targets(spark, sf):
    targets = spark.createDataFrame(_TARGETS, "target_id long, target_mz double, target_rt double")
    return spectra.extract_ions(V.peaks(spark, sf), targets, mz_tol=0.5, rt_tol=3000.0)


@query(f"with {V.PEAKS} select sample_id, scan_id, min(rt) as rt, count(*) as n_peaks from peaks where sample_id in ('click', 'view') and rt between 100 and 20000 group by sample_id, scan_id")
def scan_filter(spark, sf):
    own = V.peaks(spark, sf).withColumn("level", F.when(F.col("sample_id").isin("click", "view"), 1).otherwise(2))
    kept = spectra.scan_filter(own, [1], 100.0, 20000.0)
    return kept.groupBy("sample_id", "scan_id").agg(F.min("rt").alias("rt"), F.count("*").alias("n_peaks"))


def _scans(spark, sf) -> DataFrame:
    own = V.peaks(spark, sf)
    return own.groupBy("sample_id", "scan_id").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))


@query(f"with {V.PEAKS} select sample_id, scan_id, count(*) as n_peaks, sum(intensity)::double as tic, min(mz) as mz_low, max(mz) as mz_high from peaks where mz > 1 and mz < 80 and intensity > 20000 group by all")
def clean_ms1(spark, sf):
    cleaned = _scans(spark, sf).withColumn("peaks", arrays.clean(F.col("peaks"), 1.0, 80.0, 20000.0)).where(F.size("peaks") > 0)
    mz = F.transform("peaks", lambda p: p["mz"])
    return cleaned.select("sample_id", "scan_id", F.size("peaks").cast("long").alias("n_peaks"), arrays.total(F.transform("peaks", lambda p: p["intensity"])).alias("tic"), F.array_min(mz).alias("mz_low"), F.array_max(mz).alias("mz_high"))


@query(f"""with {V.PEAKS}, s as (select sample_id, scan_id, max(intensity) as base, max(mz) as precursor_mz from peaks group by all)
select p.sample_id, p.scan_id, count(*) as n_peaks, sum(intensity)::double as tic from peaks p join s using (sample_id, scan_id) where intensity > greatest(5000, base * 0.3) and mz < precursor_mz - 2 group by all""")
def clean_ms2(spark, sf):
    own = _scans(spark, sf).withColumn("precursor_mz", F.array_max(F.transform("peaks", lambda p: p["mz"])))
    own = own.withColumn("peaks", arrays.clean_ms2(F.col("peaks"), F.col("precursor_mz"), 5000.0, 0.3, 2.0)).where(F.size("peaks") > 0)
    return own.select("sample_id", "scan_id", F.size("peaks").cast("long").alias("n_peaks"), arrays.total(F.transform("peaks", lambda p: p["intensity"])).alias("tic"))


_ISLANDS = "select *, sum(case when mz - lag_mz >= {tol} then 1 else 0 end) over (partition by {keys} order by mz, intensity rows unbounded preceding) as island from (select *, lag(mz) over (partition by {keys} order by mz, intensity) as lag_mz from peaks)"


@query(f"with {V.PEAKS} select sample_id, round(sum(mz * intensity) / sum(intensity), 6) as mz, sum(intensity)::double as intensity, count(*) as n_peaks from ({_ISLANDS.format(tol=0.1, keys='sample_id')}) group by sample_id, island")
def centroid(spark, sf):
    return spectra.centroid_long(V.peaks(spark, sf), 0.1, keys=("sample_id",)).withColumn("mz", R(F.col("mz")))


@query(f"with {V.PEAKS} select sample_id, scan_id, round(sum(mz * intensity) / sum(intensity), 6) as mz, sum(intensity)::double as intensity from ({_ISLANDS.format(tol=0.5, keys='sample_id, scan_id')}) group by sample_id, scan_id, island")
def centroid_arrays(spark, sf):
    own = _scans(spark, sf).select("sample_id", "scan_id", F.explode(arrays.centroid(F.col("peaks"), 0.5)).alias("p"))
    return own.select("sample_id", "scan_id", R(F.col("p.mz")).alias("mz"), F.col("p.intensity").alias("intensity"))


@query(f"with {V.PEAKS}, b as (select floor(mz / 0.01)::bigint as bin, min(mz) as lo, max(mz) as hi from peaks group by 1), i as (select sum(case when prev is null or mz - prev >= 0.01 then 1 else 0 end) over (order by mz rows unbounded preceding) - 1 as island, mz from (select mz, lag(mz) over (order by mz) as prev from peaks)) select island::bigint as island, count(*) as n, min(mz) as mz_low, max(mz) as mz_high from i group by island")
def mz_islands(spark, sf):
    own = islands.global_islands(V.peaks(spark, sf), "mz", 0.01)
    return own.groupBy("island").agg(F.count("*").alias("n"), F.min("mz").alias("mz_low"), F.max("mz").alias("mz_high"))


@query(f"with {V.PEAKS} select peak_id, sample_id, mz, rt, intensity from peaks where abs(mz - 10) < 0.5 and abs(rt - 20000) < 5000")
def find_by_mzrt(spark, sf):
    found = spectra.lookup(V.peaks(spark, sf), 10.0, 0.5, 20000.0, 5000.0)
    return found.select("peak_id", "sample_id", "mz", "rt", "intensity")


_MS2 = "ms2 as (select peak_id as ms2_id, sample_id, mz as precursor_mz, rt as ms2_rt from peaks where intensity > 60000)"


def _ms2(own: DataFrame) -> DataFrame:
    return own.where("intensity > 60000").select(F.col("peak_id").alias("ms2_id"), "sample_id", F.col("mz").alias("precursor_mz"), F.col("rt").alias("ms2_rt"))


@query(f"""with {V.PEAKS}, {_MS2}, f as (select peak_id as feature_id, sample_id, mz, rt - 300 as rt_start, rt + 300 as rt_end, intensity as peak_height from peaks where intensity <= 60000)
select sample_id, ms2_id, feature_id from (select m.sample_id, ms2_id, feature_id, row_number() over (partition by ms2_id order by peak_height desc, feature_id) as k
from ms2 m join f on f.sample_id = m.sample_id and abs(precursor_mz - mz) < 0.1 and rt_start < ms2_rt and ms2_rt < rt_end) where k = 1""")
def ms2_allocate(spark, sf):
    own = V.peaks(spark, sf)
    feats = own.where("intensity <= 60000").select(F.col("peak_id").alias("feature_id"), "sample_id", "mz", (F.col("rt") - 300).alias("rt_start"), (F.col("rt") + 300).alias("rt_end"), F.col("intensity").alias("peak_height"))
    return spectra.allocate_ms2(feats, _ms2(own), 0.1)


@query(f"""with {V.PEAKS}, {_MS2}, s as (select sample_id, scan_id, min(rt) as rt from peaks where intensity <= 60000 group by all),
a as (select ms2_id, m.sample_id, ms2_rt, s.rt, s.scan_id from ms2 m asof left join s on s.sample_id = m.sample_id and s.rt <= m.ms2_rt),
b as (select ms2_id, s.rt, s.scan_id from ms2 m asof left join s on s.sample_id = m.sample_id and s.rt >= m.ms2_rt)
select ms2_id, a.sample_id, case when b.rt is null or ms2_rt - a.rt <= b.rt - ms2_rt then a.scan_id else b.scan_id end as scan_id from a join b using (ms2_id)""")
def nearest_ms1(spark, sf):
    own = V.peaks(spark, sf)
    scans = own.where("intensity <= 60000").groupBy("sample_id", "scan_id").agg(F.min("rt").alias("rt"))
    targets = _ms2(own).select(F.col("ms2_id").alias("target_id"), "sample_id", F.col("ms2_rt").alias("target_rt"))
    return spectra.nearest_scans(targets, scans).select(F.col("target_id").alias("ms2_id"), "sample_id", "scan_id")


@query(f"""with {V.PEAKS}, {_MS2}, p1 as (select * from peaks where intensity <= 60000), s as (select sample_id, scan_id, min(rt) as rt from p1 group by all),
a as (select ms2_id, m.sample_id, precursor_mz, ms2_rt, s.rt, s.scan_id from ms2 m asof left join s on s.sample_id = m.sample_id and s.rt <= m.ms2_rt),
b as (select ms2_id, s.rt, s.scan_id from ms2 m asof left join s on s.sample_id = m.sample_id and s.rt >= m.ms2_rt),
n as (select ms2_id, a.sample_id, precursor_mz, case when b.rt is null or ms2_rt - a.rt <= b.rt - ms2_rt then a.scan_id else b.scan_id end as scan_id from a join b using (ms2_id)),
w as (select ms2_id, p.intensity, sum(p.intensity) over (partition by ms2_id) as s, row_number() over (partition by ms2_id order by abs(mz - precursor_mz), mz, p.intensity) as k from n join p1 p using (sample_id, scan_id) where mz > precursor_mz - 3 and mz < precursor_mz + 3)
select n.ms2_id, n.sample_id, round(coalesce(w.intensity / w.s, 0.0), 6) as fraction from n left join w on w.ms2_id = n.ms2_id and w.k = 1""")
def pif(spark, sf):
    own = V.peaks(spark, sf)
    found = spectra.precursor_fraction(_ms2(own), own.where("intensity <= 60000"), 3.0, 3.0)
    return found.select("ms2_id", "sample_id", R(F.col("fraction")).alias("fraction"))


@query(f"with {V.SPECTRA} select group_id, spectrum_id, round(tic, 6) as tic from (select *, row_number() over (partition by group_id order by tic desc, spectrum_id) as k from (select group_id, spectrum_id, sum(intensity) as tic from spectrum_peaks group by group_id, spectrum_id)) where k = 1")
def best_ms2(spark, sf):
    return spectra.best_ms2(V.spectra(spark, sf), "group_id", "spectrum_id").select("group_id", "spectrum_id", R(F.col("tic")).alias("tic"))


# ---- traces

_KEYS = "sample_id, trace_id"
_PLACED = f"""{V.TRACES}, t as (select *, row_number() over (partition by {_KEYS} order by scan_id) - 1 as i, count(*) over (partition by {_KEYS}) as n, max(intensity) over (partition by {_KEYS}) as top from traces),
a as (select {_KEYS}, min(i) as apex, min(n) as n, min(top) as top from t where intensity = top group by all)"""


def _traces(spark, sf) -> DataFrame:
    return spectra.as_traces(V.traces(spark, sf), ["sample_id", "trace_id"])


@query(f"""with {_PLACED}, k as (select {_KEYS}, intensity, top, row_number() over (partition by {_KEYS} order by scan_id) as j, count(*) over (partition by {_KEYS}) as m,
 coalesce(lag(intensity) over (partition by {_KEYS} order by scan_id), 0) as prev from t where intensity > top * 0.05)
select {_KEYS}, round(case when min(m) < 5 then 0.0 else (sum(abs(intensity - prev)) + sum(case when j = m then intensity else 0 end)) / min(top) / 2 - 1 end, 6) as noise_score from k group by all""")
def noise_score(spark, sf):
    return _traces(spark, sf).select("sample_id", "trace_id", R(arrays.noise_score(F.col("y"))).alias("noise_score"))


@query(f"""with {_PLACED}, w as (select {_KEYS}, min(a.n) as n, min(a.top) as top, min(case when i = apex then rt end) as b,
 coalesce(min(case when i >= apex and intensity < a.top / 2 then rt end), max(rt)) as rx, coalesce(max(case when i < apex and intensity < a.top / 2 then rt end), min(rt)) as lx from t join a using ({_KEYS}) group by all),
f as (select {_KEYS}, w.n, intensity as y, w.top * exp(-0.5 * pow((rt - b) / (case when rx = lx then 1e-6 else (rx - lx) / 2.355 end), 2)) as g from t join w using ({_KEYS})),
m as (select {_KEYS}, avg(y) as my, avg(g) as mg from f group by all)
select {_KEYS}, round(case when min(n) < 5 then 0.0 else greatest(0.0, sum((y - my) * (g - mg)) / (sqrt(sum((y - my) * (y - my)) * sum((g - mg) * (g - mg))) + 1e-12)) end, 6) as gaussian_similarity from f join m using ({_KEYS}) group by all""")
def gaussian_similarity(spark, sf):
    return _traces(spark, sf).select("sample_id", "trace_id", R(arrays.gaussian_similarity(F.col("x"), F.col("y"))).alias("gaussian_similarity"))


@query(f"""with {_PLACED}, w as (select {_KEYS}, min(a.n) as n, min(apex) as apex, coalesce(min(case when i > apex and intensity < a.top * 0.1 then i end), min(a.n) - 1) as rx, coalesce(max(case when i < apex and intensity < a.top * 0.1 then i end), 0) as lx from t join a using ({_KEYS}) group by all)
select {_KEYS}, round(case when n < 5 then null when apex = lx then 99.0 else (rx - apex)::double / (apex - lx) end, 6) as asymmetry_factor from w""")
def asymmetry(spark, sf):
    return _traces(spark, sf).select("sample_id", "trace_id", R(arrays.asymmetry(F.col("y"))).alias("asymmetry_factor"))


@query(f"""with {V.TRACES} select {_KEYS}, round(coalesce(sum((rt - p) * (intensity + q) / 2), 0.0) * 60, 0) as area from (select *, lag(rt) over w as p, lag(intensity) over w as q from traces window w as (partition by {_KEYS} order by scan_id)) group by all""")
def trapz_area(spark, sf):
    return _traces(spark, sf).select("sample_id", "trace_id", R(arrays.trapezoid(F.col("x"), F.col("y")), 0).alias("area"))


@query(f"with {V.TRACES} select {_KEYS}, round(avg(intensity), 6) as top_average from (select *, row_number() over (partition by {_KEYS} order by intensity desc, scan_id) as k from traces) where k <= 3 group by all")
def top3_average(spark, sf):
    return _traces(spark, sf).select("sample_id", "trace_id", R(arrays.top_average(F.col("y"))).alias("top_average"))


@query(f"with {V.PEAKS}, s as (select sample_id, scan_id, min(rt) as rt from peaks group by all) select sample_id, round(1.0 / (avg(case when d > 0 then d end) * 60), 9) as rate_hz from (select sample_id, rt - lag(rt) over (partition by sample_id order by scan_id) as d from s) group by all")
def spectral_rate(spark, sf):
    scans = V.peaks(spark, sf).groupBy("sample_id", "scan_id").agg(F.min("rt").alias("rt"))
    return spectra.spectral_rate(scans).withColumn("rate_hz", R(F.col("rate_hz"), 9))


@query(f"with {V.PEAKS} select sample_id, floor(mz / 20)::bigint as trace_id, round(3 * stddev_pop(mz), 6) as mz_error, round(3 * stddev_pop(rt), 4) as rt_error from peaks group by all")
def mz_rt_error(spark, sf):
    own = V.peaks(spark, sf).withColumn("trace_id", F.floor(F.col("mz") / 20).cast("long"))
    return spectra.spread_errors(own, ["sample_id", "trace_id"]).withColumns({"mz_error": R(F.col("mz_error")), "rt_error": R(F.col("rt_error"), 4)})


@query(f"""with {V.PEAKS}, seed as (select sample_id, scan_id, min(mz) as m from peaks group by all), n as (select sample_id, scan_id, m, min(intensity) as i0 from peaks join seed using (sample_id, scan_id) where mz = m group by all)
select sample_id, scan_id, count(*) as n_signals, sum(intensity)::double as intensity from peaks join n using (sample_id, scan_id) where intensity < i0 * 1.5 and (abs(mz - m) < 0.25 or abs(mz - m - 1) < 0.25 or abs(mz - m - 2) < 0.25 or abs(mz - m - 3) < 0.25 or abs(mz - m - 4) < 0.25) group by all""")
def isotope_signals(spark, sf):
    own = _scans(spark, sf).withColumn("found", arrays.isotope_signals(F.array_min(F.transform("peaks", lambda p: p["mz"])), F.col("peaks"), 0.25))
    own = own.where(F.size("found") > 0)
    return own.select("sample_id", "scan_id", F.size("found").cast("long").alias("n_signals"), arrays.total(F.transform("found", lambda p: p["intensity"])).alias("intensity"))


@query(f"""with {V.TRACES}, j as (select a.sample_id, a.trace_id, a.intensity as x, b.intensity as y from traces a join traces b on a.sample_id = b.sample_id and a.scan_id = b.scan_id and b.trace_id = a.trace_id + 1)
select sample_id, trace_id, count(*) as n_common, round(case when count(*) < 3 then 1.0 else corr(x, y) end, 6) as correlation from j where x > 0 and y > 0 group by all""")
def scan_corr(spark, sf):
    own = V.traces(spark, sf).select("sample_id", "trace_id", "scan_id", F.col("intensity").alias("x"))
    up = own.select("sample_id", (F.col("trace_id") - 1).alias("trace_id"), "scan_id", F.col("x").alias("y"))
    both = own.join(up, ["sample_id", "trace_id", "scan_id"])
    found = spectra.scan_correlation(both, ["sample_id", "trace_id"], ["x", "y"])
    return found.select("sample_id", "trace_id", "n_common", R(F.when(F.isnan("correlation"), None).otherwise(F.col("correlation"))).alias("correlation"))


# ---- features across samples

@query(f"""with {V.FEATURES}, a as (select *, mz - lag(mz) over w as lo, lead(mz) over w - mz as hi from features window w as (partition by sample_id order by mz, fid)),
b as (select *, row_number() over (partition by sample_id order by peak_height desc, fid) as k from a where lo > 0.01 and hi > 0.01 and noise_score < 0.05) select sample_id, fid, mz, rt, {_r('peak_height')}, k as anchor_rank from b where k <= 100""")
def anchor_select(spark, sf):
    found = alignment.anchors(V.features(spark, sf), ["sample_id"], "fid", mz_tol=0.01, noise=0.05, num=100)
    return found.select("sample_id", "fid", "mz", "rt", R(F.col("peak_height")).alias("peak_height"), "anchor_rank")


@query(f"with {V.FEATURES}, s as (select sample_id, sum(peak_height) as h, row_number() over (order by round(sum(peak_height), 2), sample_id) - 1 as k, count(*) over () as n from features group by sample_id) select sample_id, round(h, 2) as total_height from s where k = floor(n / 2)")
def reference_file(spark, sf):
    return alignment.reference_file(V.features(spark, sf)).withColumn("total_height", R(F.col("total_height"), 2))


@query(f"""with {V.FEATURES}, a as (select *, mz - lag(mz) over w as lo, lead(mz) over w - mz as hi from features where sample_id = 0 window w as (order by mz, fid)),
anchor as (select * from (select fid as anchor_id, mz as anchor_mz, rt as anchor_rt, row_number() over (order by peak_height desc, fid) as place from a where lo > 0.5 and hi > 0.5 and noise_score < 0.1) where place <= 100)
select anchor_id, sample_id, min(rt) as rt, min(anchor_rt) as anchor_rt from features join anchor on abs(mz - anchor_mz) < 0.5 and abs(rt - anchor_rt) < 3 where sample_id > 0 group by anchor_id, sample_id having count(*) = 1""")
def anchor_match_unique(spark, sf):
    """The anchors of sample 0 in all other samples."""
    own = V.features(spark, sf)
    best = alignment.anchors(own.where("sample_id = 0"), ["sample_id"], "fid", mz_tol=0.5, noise=0.1, num=100)
    anchor = best.select(F.col("fid").alias("anchor_id"), F.col("mz").alias("anchor_mz"), F.col("rt").alias("anchor_rt"))
    return alignment.unique_matches(anchor, own.where("sample_id > 0"), mz_tol=0.5, rt_tol=3.0)


@query(f"""with {V.FEATURES}, n as (select sample_id, rt, rt + sample_id / 100 as x, row_number() over (partition by sample_id order by rt) - 1 as i from (select distinct sample_id, rt from features where rt % 5 = 0)),
k as (select sample_id, i, x, x * 1.01 + (i % 2) as y, lead(x) over w as x2, lead(x * 1.01 + (i % 2)) over w as y2, count(*) over (partition by sample_id) as m from n window w as (partition by sample_id order by i)),
q as (select fid, f.sample_id, f.rt, greatest(0, least((select count(*) from k where k.sample_id = f.sample_id and k.x <= f.rt), k0.m - 1) - 1) as j from features f join (select sample_id, min(m) as m from k group by all) k0 using (sample_id))
select q.fid, round(k.y + (q.rt - k.x) * (k.y2 - k.y) / (k.x2 - k.x), 6) as rt_corrected from q join k on k.sample_id = q.sample_id and k.i = q.j""")
def rt_interpolate(spark, sf):
    own = V.features(spark, sf)
    knots = own.where(F.col("rt") % 5 == 0).select("sample_id", "rt").distinct().groupBy("sample_id").agg(F.sort_array(F.collect_list("rt")).alias("rts"))
    x = lambda v: v + F.col("sample_id") / 100
    knots = knots.select("sample_id", F.transform("rts", lambda v, i: F.struct(x(v).alias("x"), (x(v) * 1.01 + i % 2).alias("y"))).alias("knots"))
    return own.join(rangejoin.sized(knots), "sample_id").select("fid", R(arrays.interpolate(F.col("rt"), F.col("knots"))).alias("rt_corrected"))


@query(f"""with {V.FEATURES}, a as (select *, sum(case when mz - p >= 0.02 then 1 else 0 end) over (partition by sample_id order by mz, fid rows unbounded preceding) as mi from (select *, lag(mz) over (partition by sample_id order by mz, fid) as p from features)),
b as (select *, sum(case when rt - q >= 2 then 1 else 0 end) over (partition by sample_id, mi order by rt, fid rows unbounded preceding) as ri from (select *, lag(rt) over (partition by sample_id, mi order by rt, fid) as q from a)),
c as (select *, row_number() over (partition by sample_id, mi, ri order by peak_height desc, fid) as k, count(*) over (partition by sample_id, mi, ri) as members from b) select sample_id, fid, mz, rt, {_r('peak_height')}, members from c where k = 1""")
def merge_features(spark, sf):
    found = alignment.merge_features(V.features(spark, sf), ["sample_id"], "fid", mz_tol=0.02, rt_tol=2.0)
    return found.select("sample_id", "fid", "mz", "rt", R(F.col("peak_height")).alias("peak_height"), "members")


@query(f"with {V.MATRIX} select f.feature_id, s.sample_id from (select distinct feature_id from matrix) f cross join samples s left join matrix m on m.feature_id = f.feature_id and m.sample_id = s.sample_id where m.sample_id is null")
def gap_fill_cells(spark, sf):
    return alignment.missing_cells(V.matrix(spark, sf), V.samples(spark))


@query(f"with {V.MATRIX} select feature_id, round(sum(case when not is_blank and intensity > 0 then 1 else 0 end) / (select count(*) from samples where not is_blank)::double, 6) as detection_rate, max(intensity) as highest from matrix join samples using (sample_id) group by all")
def detection_rate(spark, sf):
    return alignment.detection_rate(V.matrix(spark, sf), V.samples(spark)).withColumn("detection_rate", R(F.col("detection_rate")))


@query(f"with {V.MATRIX} select feature_id, {', '.join(f'coalesce(max(case when sample_id = {i} then trunc(intensity) end), 0)::bigint as s{i}' for i in range(20))} from matrix group by feature_id")
def pivot_table(spark, sf):
    return alignment.wide(V.matrix(spark, sf), range(20))


@query(f"with {V.SPECTRA} select spectrum_id, string_agg(printf('%.4f;%.4f', mz, intensity), '|' order by mz) as encoded, count(*) as n_peaks, round(sum(round(intensity, 4)), 3) as total from spectrum_peaks group by spectrum_id")
def spectrum_codec(spark, sf):
    own = V.spectra(spark, sf).select("spectrum_id", arrays.encode_spectrum(F.col("peaks")).alias("encoded")).withColumn("back", arrays.decode_spectrum(F.col("encoded")))
    return own.where("encoded <> ''").select("spectrum_id", "encoded", F.size("back").cast("long").alias("n_peaks"), R(arrays.total(F.transform("back", lambda p: p["intensity"])), 3).alias("total"))


# ---- runs and samples

@query(f"""with {V.RUNS}, a as (select *, time - lag(time) over (partition by queue order by time, file_id) as d from runs), b as (select *, min(d) over (partition by queue) as least from a)
select queue, file_id, time, sum(case when d > least * 10.0 then 1 else 0 end) over (partition by queue order by time, file_id rows unbounded preceding)::bigint as batch_id from b""")
def batch_label(spark, sf):
    return statistics.batch_labels(V.runs(spark, sf))


@query(f"with {V.RUNS} select queue, file_id, time, row_number() over (partition by queue order by time nulls last, file_id) - 1 as analytical_order from runs")
def analytical_order(spark, sf):
    return statistics.analytical_order(V.runs(spark, sf))


@query(f"""with {V.FEATURES}, t as (select part % 50 as sample_id, max(peak_height) * case when part % 50 < 3 then 0.1 else 1 end as highest from features group by part % 50), m as (select median(highest) as median_highest from t where sample_id % 7 <> 6)
select sample_id, round(highest, 6) as highest, round(median_highest, 6) as median_highest from t, m where sample_id % 7 <> 6 and highest < median_highest / 3""")
def outlier_files(spark, sf):
    own = V.features(spark, sf).withColumn("sample_id", F.col("part") % 50)
    own = own.withColumn("peak_height", F.col("peak_height") * F.when(F.col("sample_id") < 3, 0.1).otherwise(1.0))
    files = spark.range(50).select(F.col("id").alias("sample_id"), (F.col("id") % 7 == 6).alias("is_blank"))
    found = statistics.outlier_files(own, files)
    return found.select("sample_id", R(F.col("highest")).alias("highest"), R(F.col("median_highest")).alias("median_highest"))


@query("select o_orderkey as file_id from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def resume_antijoin(spark, sf):
    done = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"))
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id")).join(done, "file_id", "left_anti")


# ---- normalisation and statistics

@query(f"""with {V.MATRIX}, n as (select sum(case when is_blank then 1 else 0 end) as nb, sum(case when is_qc then 1 else 0 end) as nq, sum(case when is_blank then 0 else 1 end) as ns from samples),
s as (select feature_id, sum(case when is_blank then intensity else 0 end) as b, sum(case when not is_blank then intensity else 0 end) as s, sum(case when is_qc then intensity else 0 end) as q, sum(case when is_qc then intensity * intensity else 0 end) as qq from matrix join samples using (sample_id) group by all),
r as (select feature_id, (b / nb) / (case when s = 0 then 1.0 else s / ns end) as blank_ratio, case when q = 0 then 99.0 else sqrt(greatest(0.0, (qq - nq * (q / nq) * (q / nq)) / (nq - 1))) / (q / nq) end as qc_rsd from s, n)
select feature_id, round(blank_ratio, 6) as blank_ratio, round(qc_rsd, 6) as qc_rsd, blank_ratio < 0.5 and qc_rsd < 0.25 as is_high_quality from r""")
def hq_features(spark, sf):
    found = statistics.high_quality(V.matrix(spark, sf), V.samples(spark))
    return found.select("feature_id", R(F.col("blank_ratio")).alias("blank_ratio"), R(F.col("qc_rsd")).alias("qc_rsd"), "is_high_quality")


@query(f"with {V.MATRIX} select sample_id, n::double as measure from (select sample_id, count(*) as n from matrix where intensity > 0 group by all) order by n desc, sample_id limit 1")
def pqn_reference(spark, sf):
    return statistics.reference_sample(V.matrix(spark, sf))


_REF = "ref as (select sample_id as ref_id from (select sample_id, count(*) as n from matrix where intensity > 0 group by all) order by n desc, sample_id limit 1)"
_FACTORS = f"{V.MATRIX}, {_REF}, fac as (select m.sample_id, median(m.intensity / r.intensity) as factor from matrix m join (select feature_id, intensity from matrix, ref where sample_id = ref_id) r using (feature_id) where m.intensity > 0 and r.intensity > 0 group by all)"


@query(f"with {_FACTORS} select sample_id, round(factor, 6) as factor from fac")
def pqn_factors(spark, sf):
    own = V.matrix(spark, sf)
    return statistics.factors(own, statistics.reference_sample(own)).withColumn("factor", R(F.col("factor")))


@query(f"with {_FACTORS} select feature_id, sample_id, trunc(intensity / coalesce(nullif(factor, 0), 1))::bigint as intensity from matrix left join fac using (sample_id)")
def pqn_apply(spark, sf):
    own = V.matrix(spark, sf)
    return statistics.apply_factors(own, statistics.factors(own, statistics.reference_sample(own)))


_GROUPS = f"{V.MATRIX}, g as (select feature_id, group_id, count(*) as n, avg(intensity) as mean, var_samp(intensity) as var from matrix join samples using (sample_id) where group_id in ({{groups}}) group by all)"


@query(f"""with {_GROUPS.format(groups='0, 1')}, t as (select a.feature_id, a.n as n1, b.n as n2, a.mean as m1, b.mean as m2, a.var as v1, b.var as v2 from g a join g b on a.feature_id = b.feature_id and a.group_id = 0 and b.group_id = 1 where a.n > 1 and b.n > 1)
select feature_id, n1 + n2 - 2 as df, round((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 0), 6) as t from t""")
def ttest_stat(spark, sf):
    return statistics.t_statistic(V.matrix(spark, sf), V.samples(spark), [0, 1]).withColumn("t", R(F.col("t")))


_ANOVA = f"""{_GROUPS.format(groups='0, 1, 2')}, s as (select feature_id, sum(n) as n, sum(n * mean) / sum(n) as grand, count(*) as k from g group by all),
av as (select feature_id, min(s.k) - 1 as df_between, min(s.n) - min(s.k) as df_within, sum(g.n * pow(mean - grand, 2)) / (min(s.k) - 1) as msb, sum((g.n - 1) * coalesce(var, 0)) / nullif(min(s.n) - min(s.k), 0) as msw from g join s using (feature_id) group by all having min(s.k) > 1 and min(s.n) > min(s.k))"""


@query(f"with {_ANOVA} select feature_id, df_between::bigint as df_between, df_within::bigint as df_within, round(msb / nullif(msw, 0), 6) as f from av")
def anova_f(spark, sf):
    return statistics.anova(V.matrix(spark, sf), V.samples(spark), [0, 1, 2]).withColumn("f", R(F.col("f")))


@query(f"""with {V.MATRIX}, v as (select *, log10(intensity) as v from matrix where intensity > 0), s as (select feature_id, count(*) as n, sum(v) as s, sum(v * v) as ss, log10(min(intensity) * 0.2) as fill from v group by all),
m as (select feature_id, (s + (20 - n) * fill) / 20 as mean, sqrt(greatest(0.0, (ss + (20 - n) * fill * fill) / 20 - pow((s + (20 - n) * fill) / 20, 2))) as sd from s)
select feature_id, sample_id, round(coalesce((v - mean) / nullif(round(sd, 9), 0), 0.0), 4) as z from v join m using (feature_id)""")
def impute_log_zscore(spark, sf):
    return statistics.impute_scale(V.matrix(spark, sf), 20).withColumn("z", R(F.col("z"), 4))


@query(f"with {_ANOVA} select feature_id, f from (select feature_id, round(msb / nullif(msw, 0), 6) as f from av) where f is not null order by f desc, feature_id limit 20")
def select_k_best(spark, sf):
    scores = statistics.anova(V.matrix(spark, sf), V.samples(spark), [0, 1, 2]).select("feature_id", R(F.col("f")).alias("f"))
    return statistics.best_k(scores, 20)


# ---- annotation

_SIM = f"""{V.SPECTRA}, h as (select spectrum_id, group_id, mz, intensity / 2 / sum(intensity) over (partition by spectrum_id) as i from spectrum_peaks),
sim as (select a.spectrum_id as query_id, b.spectrum_id as match_id, sum((a.i + b.i) * log2(a.i + b.i) - a.i * log2(a.i) - b.i * log2(b.i)) as similarity, count(*) as n_matched from h a join h b on a.group_id = b.group_id and abs(a.mz - b.mz) < 0.5 and a.spectrum_id {{op}} b.spectrum_id group by all)"""


def _similar(spark, sf, **kind: bool) -> DataFrame:
    own = V.spectra(spark, sf).select(F.col("spectrum_id").alias("id"), "group_id", "peaks")
    return annotation.similarities(own, own, 0.5, ["group_id"], **kind)


@query(f"with {_SIM.format(op='<')} select query_id, match_id, round(similarity, 6) as similarity, n_matched from sim")
def entropy_similarity(spark, sf):
    return _similar(spark, sf, once=True).withColumn("similarity", R(F.col("similarity")))


@query(f"with {_SIM.format(op='<>')} select query_id, match_id, round(similarity, 6) as similarity, n_matched from (select *, row_number() over (partition by query_id order by round(similarity, 9) desc, match_id) as k from sim) where k = 1")
def library_top1(spark, sf):
    return annotation.top_match(_similar(spark, sf, best=True)).withColumn("similarity", R(F.col("similarity")))


@query(f"with {V.FEATURES}, {V.LIBRARY} select fid as feature_id, lib_id, mz, rt, lib_mz, lib_rt from features join library on abs(mz - lib_mz) < 0.005 and abs(rt - lib_rt) < 0.2")
def mzrt_candidates(spark, sf):
    own = V.features(spark, sf).withColumnRenamed("fid", "feature_id")
    return annotation.list_candidates(own, V.library(spark, sf), 0.005, 0.2).select("feature_id", "lib_id", "mz", "rt", "lib_mz", "lib_rt")


# Fixed values of the twins, written out here on their own, so that a wrong constant of the engine shows: ions of the
# positive mode (name, mass shift, charge, molecules), atom masses, and all adducts (name, charge, molecules, change in
# atoms of C, H, N, O and mass of other atoms).
_POSITIVE_IONS = """('[M+NH4]+', 18.03437413328, 1, 1), ('[M+Na]+', 22.989769282, 1, 1), ('[M+K]+', 38.963706493, 1, 1), ('[M+H-H2O]+', -17.00273965247, 1, 1),
 ('[M+H+CH3COOH]+', 61.02895440175, 1, 1), ('[M+H+HCOOH]+', 47.01330433721, 1, 1), ('[2M+H]+', 1.00782503227, 1, 2), ('[3M+H]+', 1.00782503227, 1, 3), ('[M+2H]2+', 2.01565006454, 2, 1), ('[M+3H]3+', 3.02347509681, 3, 1)"""
_ATOMS = "('C', 12.0), ('H', 1.00782503207), ('N', 14.0030740052), ('O', 15.9949146221)"
_CHANGES = """('[M+H]+', 1, 1, 0, 1, 0, 0, 0.0), ('[M+NH4]+', 1, 1, 0, 4, 1, 0, 0.0), ('[M]+', 1, 1, 0, 0, 0, 0, 0.0), ('[M+H+CH3OH]+', 1, 1, 1, 5, 0, 1, 0.0), ('[M+Na]+', 1, 1, 0, 0, 0, 0, 22.989769282),
 ('[M+K]+', 1, 1, 0, 0, 0, 0, 38.96370649), ('[M+H+CH3CN]+', 1, 1, 2, 4, 1, 0, 0.0), ('[M-H+2Na]+', 1, 1, 0, -1, 0, 0, 45.979538564), ('[M+H-H2O]+', 1, 1, 0, -1, 0, -1, 0.0), ('[M+H+CH3COOH]+', 1, 1, 2, 5, 0, 2, 0.0),
 ('[M+H+HCOOH]+', 1, 1, 1, 3, 0, 2, 0.0), ('[2M+H]+', 1, 2, 0, 1, 0, 0, 0.0), ('[2M+NH4]+', 1, 2, 0, 4, 1, 0, 0.0), ('[2M+Na]+', 1, 2, 0, 0, 0, 0, 22.989769282), ('[2M+H-H2O]+', 1, 2, 0, -1, 0, -1, 0.0),
 ('[3M+H]+', 1, 3, 0, 1, 0, 0, 0.0), ('[3M+H-H2O]+', 1, 3, 0, -1, 0, -1, 0.0), ('[M+2H]2+', 2, 1, 0, 2, 0, 0, 0.0), ('[M+3H]3+', 3, 1, 0, 3, 0, 0, 0.0), ('[M+Li]+', 1, 1, 0, 0, 0, 0, 7.016003443),
 ('[M+Ag]+', 1, 1, 0, 0, 0, 0, 106.905092), ('[M+Ca]2+', 2, 1, 0, 0, 0, 0, 39.96259098), ('[M+Fe]2+', 2, 1, 0, 0, 0, 0, 55.93493633),
 ('[M-H]-', -1, 1, 0, -1, 0, 0, 0.0), ('[M+Cl]-', -1, 1, 0, 0, 0, 0, 34.968852682), ('[M+HCOO]-', -1, 1, 1, 1, 0, 2, 0.0), ('[M+CH3COO]-', -1, 1, 2, 3, 0, 2, 0.0), ('[M-H-H2O]-', -1, 1, 0, -3, 0, -1, 0.0),
 ('[2M-H]-', -1, 2, 0, -1, 0, 0, 0.0), ('[3M-H]-', -1, 3, 0, -1, 0, 0, 0.0), ('[M-2H]2-', -2, 1, 0, -2, 0, 0, 0.0), ('[M-3H]3-', -3, 1, 0, -3, 0, 0, 0.0), ('[2M+Cl]-', -1, 2, 0, 0, 0, 0, 34.968852682),
 ('[2M+HCOO]-', -1, 2, 1, 1, 0, 2, 0.0), ('[2M+CH3COO]-', -1, 2, 2, 3, 0, 2, 0.0), ('[2M-H-H2O]-', -1, 2, 0, -3, 0, -1, 0.0)"""
_ELECTRON = "0.00054857990946"


@query(f"""with {V.FEATURES}, ad(ion, shift, z, n) as (values {_POSITIVE_IONS})
select fid as feature_id, ion, round(((mz - 1.00782503227::double) * n + shift::double) / z, 6) as ion_mz from features, ad
union all select fid, 'M+' || i, round(mz + 1 + (i - 1) * 1.003355, 6) from features, (select unnest([1, 2, 3]) as i)""")
def enumerate_ions(spark, sf):
    own = V.features(spark, sf).select(F.col("fid").alias("feature_id"), "mz")
    return annotation.source_ions(own, spark, "positive").withColumn("ion_mz", R(F.col("ion_mz")))


@query(f"with {V.SPECTRA} select spectrum_id, floor((mz + spectrum_id % 7) / 25)::bigint as bin, round(sum((mz + spectrum_id % 7) * intensity) / sum(intensity), 6) as mass, round(sum(intensity), 6) as abundance from spectrum_peaks group by all")
def isotope_bin(spark, sf):
    own = V.spectra(spark, sf).select("spectrum_id", F.explode("peaks").alias("p")).select("spectrum_id", (F.col("p.mz") + F.col("spectrum_id") % 7).alias("m"), F.col("p.intensity").alias("a"))
    return chem.bin_isotopes(own, ["spectrum_id"], "m", "a", 25).withColumns({"mass": R(F.col("mass")), "abundance": R(F.col("abundance"))})


_FORMULA = "concat('C', p_size + 1, 'H', 2 * p_size + p_partkey % 5 + 2, case when p_partkey % 3 = 0 then 'N' when p_partkey % 3 = 1 then 'N2O' else '' end, 'O', 1 + p_partkey % 7)"


@query(f"""with f as (select p_partkey, {_FORMULA} as formula from part), t as (select p_partkey, formula, unnest(regexp_extract_all(formula, '[A-Z][a-z]*[0-9]*')) as tok from f)
select p_partkey, formula, regexp_extract(tok, '[A-Z][a-z]*') as element, sum(coalesce(try_cast(nullif(regexp_extract(tok, '[0-9]+'), '') as bigint), 1))::bigint as n from t group by all""")
def formula_parse(spark, sf):
    own = V.table(spark, sf, "part").select("p_partkey", F.expr(_FORMULA).alias("formula"))
    return own.select("p_partkey", "formula", F.explode(chem.parse_column(F.col("formula"))).alias("element", "n")).withColumn("n", F.col("n").cast("long"))


@query(f"""with f as (select p_partkey, {_FORMULA} as formula from part), t as (select p_partkey, formula, unnest(regexp_extract_all(formula, '[A-Z][a-z]*[0-9]*')) as tok from f),
m(element, mass) as (values {_ATOMS})
select p_partkey, formula, round(sum(mass::double * coalesce(try_cast(nullif(regexp_extract(tok, '[0-9]+'), '') as bigint), 1)) + 1.00782503207 - {_ELECTRON}, 6) as mz from t join m on m.element = regexp_extract(tok, '[A-Z][a-z]*') group by all""")
def formula_mass(spark, sf):
    own = V.table(spark, sf, "part").select("p_partkey", F.expr(_FORMULA).alias("formula"))
    return own.select("p_partkey", "formula", R(chem.mass_column(chem.parse_column(F.col("formula"))) + chem.MASSES["H"] - chem.ELECTRON).alias("mz"))


_HEAD = "concat(p_name, case when p_partkey % 4 = 0 then ' Orbitrap' when p_partkey % 4 = 1 then ' TripleTOF 5600' when p_partkey % 4 = 2 then ' Agilent QTOF' else '' end)"


@query(f"select p_partkey, case when contains(lower({_HEAD}), 'orbitrap') or contains(lower({_HEAD}), 'q exactive') then 'orbitrap' when contains(lower({_HEAD}), 'tripletof') then 'tripletof' when contains(lower({_HEAD}), 'tof') then 'qtof' else 'unknown' end as instrument from part")
def instrument_probe(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", annotation.instrument(F.expr(_HEAD)).alias("instrument"))


@query(f"with {V.LIBRARY} select name, lib_id, lib_mz, lib_rt from (select *, row_number() over (partition by name order by lib_rt, lib_id) as k from library where lib_rt > 5) where k = 1")
def dedupe_first(spark, sf):
    own = V.library(spark, sf).where("lib_rt > 5")
    return annotation.first_per_annotation(own, "name", "lib_rt", "lib_id").select("name", "lib_id", "lib_mz", "lib_rt")


# ---- sequential steps: no SQL twin, tested against restatements

@query()
def roi_link(spark, sf):
    found = detection.link_traces(V.peaks(spark, sf), mz_tol=0.05, gap_tol=10)
    return found.select("sample_id", F.get("scans", F.lit(0)).alias("first_scan"), F.element_at("scans", -1).alias("last_scan"), F.get("mzs", F.lit(0)).alias("first_mz"), F.size("y").alias("n_scans"), F.array_max("y").alias("highest"))


@query()
def segment(spark, sf):
    found = detection.summarise(detection.segment(detection.link_traces(V.peaks(spark, sf), mz_tol=0.05, gap_tol=10)))
    return found.drop("trace")


def _aligned(spark, sf) -> DataFrame:
    own = V.features(spark, sf)
    rows = own.select("sample_id", "fid", "mz", "rt", F.col("peak_height").alias("height"), (1 - F.col("noise_score")).alias("gaussian"), F.col("noise_score").alias("noise"), (F.col("part") % 10 == 0).alias("has_ms2"))
    return detection.align_features(rows, spark.range(20).select(F.col("id").alias("sample_id"), F.col("id").alias("align_order")), mz_tol=0.01, rt_tol=0.5)


@query()
def align(spark, sf):
    return _aligned(spark, sf)


@query(f"""with recursive {V.FEATURES}, a as (select *, mz - lag(mz) over w as lo, lead(mz) over w - mz as hi from features where sample_id = 0 window w as (order by mz, fid)),
anchor as (select * from (select fid as anchor_id, mz as anchor_mz, rt as anchor_rt, row_number() over (order by peak_height desc, fid) as place from a where lo > 0.5 and hi > 0.5 and noise_score < 0.1) where place <= 100),
m as (select anchor_id, sample_id, min(rt) as rt, min(anchor_rt) as anchor_rt, min(place) as place from features join anchor on abs(mz - anchor_mz) < 0.5 and abs(rt - anchor_rt) < 3 where sample_id <> 0 and peak_height > 5000 group by anchor_id, sample_id having count(*) = 1),
s as (select sample_id, count(*) as n, avg(anchor_rt - rt) as mean, stddev_pop(anchor_rt - rt) as sd from m group by sample_id),
k as (select m.*, row_number() over (partition by sample_id order by place) as j, count(*) over (partition by sample_id) as kept from m join s using (sample_id) where n >= 5 and (sd = 0 or abs(anchor_rt - rt - mean) < sd)),
walk(sample_id, j, last, x, y, took) as (select distinct sample_id, 0::bigint, 0.0::double, 0.0::double, 0.0::double, true from k where kept >= 5
 union all select k.sample_id, k.j, case when k.rt > w.last + 0.1 then k.rt else w.last end, k.rt, k.anchor_rt, k.rt > w.last + 0.1 from walk w join k on k.sample_id = w.sample_id and k.j = w.j + 1),
knots as (select sample_id, x, y, lead(x) over o as x2, lead(y) over o as y2, row_number() over o as i, count(*) over (partition by sample_id) as c from walk where took window o as (partition by sample_id order by x)),
f as (select sample_id, fid, rt, (select greatest(1, least(count(*), max(c) - 1)) from knots where knots.sample_id = features.sample_id and x <= rt) as i from features)
select f.sample_id, fid, rt, round(coalesce(y + (rt - x) * (y2 - y) / (x2 - x), rt), 6) as rt_corrected from f left join knots on knots.sample_id = f.sample_id and knots.i = f.i and c > 1""")
def rt_correction(spark, sf):
    """Times on those of sample 0, through its anchors."""
    return detection.correct_times(V.features(spark, sf), 0, mz_tol=0.5, rt_tol=3.0).select("sample_id", "fid", "rt", R(F.col("rt_corrected")).alias("rt_corrected"))


@query()
def group(spark, sf):
    return detection.group_ions(V.features(spark, sf).withColumnRenamed("peak_height", "height").drop("noise_score", "part"))


_FIT = """list_transform(range(1, n + 1), lambda i: list_transform([list_transform(x, lambda v: abs(v - x[i]))], lambda d: list_transform([list_sort(d)[k]], lambda h: list_transform([list_transform(range(1, n + 1),
 lambda j: w[j] * case when h > 0 then pow(greatest(0, 1 - pow(d[j] / h, 3)), 3) when d[j] = 0 then 1 else 0 end)], lambda u: case when list_sum(u) <= 0 then fit[i] else list_transform([struct_pack(mx := list_dot_product(u, x) / list_sum(u), my := list_dot_product(u, y) / list_sum(u))],
 lambda m: list_transform([list_sum(list_transform(range(1, n + 1), lambda j: u[j] * pow(x[j] - m.mx, 2)))], lambda sxx: m.my + case when sxx > 1e-12 then list_sum(list_transform(range(1, n + 1), lambda j: u[j] * (x[j] - m.mx) * (y[j] - m.my))) / sxx * (x[i] - m.mx) else 0 end)[1])[1] end)[1])[1])[1])"""


@query(f"""with recursive {V.MATRIX}, q as (select feature_id, list(sample_id::double order by sample_id) as x, list(intensity::double order by sample_id) as y, count(*) as n from matrix join samples using (sample_id) where is_qc and intensity > 0 group by feature_id having count(*) >= 3),
l(feature_id, x, y, n, k, it, w, fit, spread) as (select feature_id, x, y, n, greatest(2, floor(least(0.8, 8.0 / n) * n + 1e-10))::bigint, 0, list_transform(x, lambda v: 1.0::double), y, 1.0::double from q
 union all select feature_id, x, y, n, k, it + 1, case when s > 0 then list_transform(range(1, n + 1), lambda j: pow(greatest(0, 1 - pow((y[j] - f[j]) / (6 * s), 2)), 2)) else w end, f, s
 from (select *, list_median(list_transform(range(1, n + 1), lambda j: abs(y[j] - f[j]))) as s from (select feature_id, x, y, n, k, it, w, {_FIT} as f from l where it < 4 and spread > 0))),
c as (select feature_id, x, n, fit from (select *, row_number() over (partition by feature_id order by it desc) as r from l) where r = 1),
p as (select feature_id, s as sample_id, greatest(1.0, case when s <= x[1] then fit[1] when s >= x[n] then fit[n] else list_transform([len(list_filter(x, lambda v: v <= s))], lambda i: fit[i] + (s - x[i]) * (fit[i + 1] - fit[i]) / (x[i + 1] - x[i]))[1] end) as curve from c, (select unnest(range(0, 20)) as s)),
d as (select feature_id, sample_id, curve, max(curve) over (partition by feature_id) as top from p)
select * from (select feature_id, sample_id, trunc(round(case when curve is null then intensity else intensity / curve * top end, 6))::bigint as intensity from matrix left join d using (feature_id, sample_id)) where intensity <> 0""")
def lowess(spark, sf):
    return detection.correct_drift(V.matrix(spark, sf), V.samples(spark).withColumn("analytical_order", F.col("sample_id")))


def _leading(gram: str, out: str) -> str:
    """CTEs of the leading eigenvector of a symmetric matrix (n, g: its rows one after the other): squared until one
    direction is left, with a trace of 1. ``out``: n, g, v, value."""
    row = lambda i: f"a[({i}) * n + 1:({i}) * n + n]"
    trace = lambda a: f"list_sum(list_transform(range(0, n), lambda i: {a}[i * n + i + 1]))"
    return f"""{out}_p(k, n, g, a) as (select 0, n, g, list_transform(g, lambda x: x / {trace('g')}) from {gram}
 union all select k + 1, n, g, list_transform(b, lambda x: x / {trace('b')}) from (select k, n, g, list_transform(range(0, n * n), lambda x: list_dot_product({row('x // n')}, {row('x % n')})) as b from {out}_p where k < 20)),
{out}_c as (select n, g, a, list_position(list_transform(range(0, n), lambda i: a[i * n + i + 1]), list_max(list_transform(range(0, n), lambda i: a[i * n + i + 1]))) - 1 as j from {out}_p where k = 20),
{out}_v as (select n, g, list_transform({row('j')}, lambda x: x / sqrt(a[j * n + j + 1])) as v from {out}_c),
{out} as (select n, g, v, list_sum(list_transform(range(0, n * n), lambda x: v[x // n + 1] * g[x + 1] * v[x % n + 1])) as value from {out}_v)"""


@query(f"""with recursive {V.MATRIX}, f as (select feature_id, log10(min(intensity) * 0.2) as fill from matrix where intensity > 0 group by all),
c as (select f.feature_id, s.sample_id, coalesce(log10(nullif(m.intensity, 0)), fill) as v from f cross join samples s left join matrix m on m.feature_id = f.feature_id and m.sample_id = s.sample_id),
z as (select feature_id, sample_id, coalesce((v - avg(v) over w) / nullif(round(stddev_pop(v) over w, 9), 0), 0) as z from c window w as (partition by feature_id)),
y as (select feature_id, sample_id, z - avg(z) over (partition by feature_id) as y from z where sample_id in (select sample_id from matrix)),
e as (select a.sample_id as i, b.sample_id as j, sum(a.y * b.y) as g from y a join y b using (feature_id) group by all),
gram as (select count(distinct i)::bigint as n, list(g order by i, j) as g, list(distinct i order by i) as ids from e),
{_leading('gram', 'one')}, rest as (select n, list_transform(range(0, n * n), lambda x: g[x + 1] - value * v[x // n + 1] * v[x % n + 1]) as g from one), {_leading('rest', 'two')}
select unnest(ids) as sample_id, round(abs(unnest(one.v)) * sqrt(one.value), 4) as pc1, round(abs(unnest(two.v)) * sqrt(two.value), 4) as pc2,
 round(one.value / list_sum(list_transform(range(0, gram.n), lambda i: gram.g[i * gram.n + i + 1])), 6) as share1, round(two.value / list_sum(list_transform(range(0, gram.n), lambda i: gram.g[i * gram.n + i + 1])), 6) as share2 from gram, one, two""")
def pca(spark, sf):
    found = learning.sample_components(statistics.impute_scale(V.matrix(spark, sf), 20, relative=True))
    return found.select("sample_id", R(F.abs("pc1"), 4).alias("pc1"), R(F.abs("pc2"), 4).alias("pc2"), R(F.col("share1")).alias("share1"), R(F.col("share2")).alias("share2"))


@query()
def rf_cv(spark, sf):
    from pyspark.ml.functions import array_to_vector

    rows = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"))
    return learning.cross_validate(rows, 64, k=32, trees=20)


_T = f"""{_GROUPS.format(groups='0, 1')}, t as (select a.feature_id, a.n + b.n - 2 as df, (a.mean - b.mean) / nullif(sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 0) as t
 from g a join g b on a.feature_id = b.feature_id and a.group_id = 0 and b.group_id = 1 where a.n > 1 and b.n > 1)"""


def _t_tail(t: str, df: str) -> str:
    """SQL of the two-sided p of Student's t for whole degrees of freedom, by the finite sums in sines and cosines."""
    angle = f"atan({t} / sqrt({df}))"
    even = f"list_sum(list_transform(range(0, ({df} // 2)::bigint), lambda j: exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4)) * pow(cos({angle}), 2 * j)))"
    odd = f"coalesce(list_sum(list_transform(range(0, (({df} - 1) // 2)::bigint), lambda j: exp(j * ln(4) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * pow(cos({angle}), 2 * j + 1))), 0)"
    return f"1 - case when {df} % 2 = 0 then sin({angle}) * {even} else 2 / pi() * ({angle} + sin({angle}) * {odd}) end"


@query(f"with {_T} select feature_id, round(case when t is null then 1.0 else {_t_tail('abs(t)', 'df')} end, 6) as p from t")
def ttest_p(spark, sf):
    own = statistics.t_statistic(V.matrix(spark, sf), V.samples(spark), [0, 1])
    return own.withColumn("p", statistics.t_test_p("t", F.col("df").cast("double"))).select("feature_id", R(F.col("p")).alias("p"))


# two degrees of freedom above have a closed form, one is t squared
@query(f"with {_ANOVA}, f as (select feature_id, df_between, df_within::bigint as d, msb / nullif(msw, 0) as f from av) select feature_id, round(case when f is null then 1.0 when df_between = 2 then pow(d / (d + 2 * f), d / 2.0) else {_t_tail('sqrt(f)', 'd')} end, 6) as p from f")
def anova_p(spark, sf):
    own = statistics.anova(V.matrix(spark, sf), V.samples(spark), [0, 1, 2])
    p = statistics.f_test_p("f", F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    return own.withColumn("p", p).select("feature_id", R(F.col("p")).alias("p"))


@query(f"""with recursive {V.FEATURES}, {V.LIBRARY}, pairs as (select lib_id, list(fid order by peak_height desc, fid) as wanted from features join library on abs(mz - lib_mz) < 0.005 and abs(rt - lib_rt) < 0.2 group by lib_id),
numbered as (select *, row_number() over (order by lib_id) as k from pairs),
step(k, lib_id, got, taken) as (select 0::bigint, null::bigint, null::varchar, []::varchar[]
 union all select n.k, n.lib_id, list_filter(n.wanted, lambda x: not list_contains(s.taken, x))[1], list_concat(s.taken, list_filter(n.wanted, lambda x: not list_contains(s.taken, x))[1:1]) from step s join numbered n on n.k = s.k + 1)
select lib_id, got as feature_id from step where got is not null""")
def mzrt_annotate(spark, sf):
    own = V.features(spark, sf).withColumnRenamed("fid", "feature_id")
    return annotation.annotate_by_list(own, V.library(spark, sf), 0.005, 0.2)


@query(f"""with {V.MATRIX}, f as (select feature_id, log10(min(intensity) * 0.2) as fill from matrix where intensity > 0 group by all),
c as (select f.feature_id, s.sample_id, coalesce(log10(nullif(m.intensity, 0)), fill) as v from f cross join samples s left join matrix m on m.feature_id = f.feature_id and m.sample_id = s.sample_id),
z as (select feature_id, sample_id, coalesce((v - avg(v) over w) / nullif(round(stddev_pop(v) over w, 9), 0), 0) as z from c window w as (partition by feature_id)),
d as (select a.sample_id, b.sample_id as other_id, sqrt(sum(pow(a.z - b.z, 2))) as distance from z a join z b on a.feature_id = b.feature_id and a.sample_id <> b.sample_id where a.sample_id in (select sample_id from matrix) and b.sample_id in (select sample_id from matrix) group by all),
k as (select *, row_number() over (partition by sample_id order by round(distance, 9), other_id) as rank from d) select sample_id, other_id, round(distance, 4) as distance, rank from k where rank <= 5""")
def sample_neighbours(spark, sf):
    return learning.neighbours(statistics.impute_scale(V.matrix(spark, sf), 20, relative=True), 5).withColumn("distance", R(F.col("distance"), 4))


# ---- filters of the workflow

_FLAGGED = "flagged as (select fid, sample_id, mz, rt, peak_height, noise_score, part, 1 - noise_score * 5 as gaussian, part % 10 = 0 as has_ms2 from features)"


def _flagged(spark, sf) -> DataFrame:
    own = V.features(spark, sf)
    return own.withColumns({"gaussian": 1 - F.col("noise_score") * 5, "has_ms2": F.col("part") % 10 == 0})


@query(f"with {V.FEATURES}, {_FLAGGED} select fid, sample_id, rt from flagged where has_ms2 or rt > 25")
def alignment_filter(spark, sf):
    own = _flagged(spark, sf).withColumns({"ms2": F.when(F.col("has_ms2"), F.lit("x")), "total_scans": F.col("rt")})
    return alignment.alignable(own, 25).select("fid", "sample_id", "rt")


@query(f"with {V.FEATURES}, {_FLAGGED} select fid, sample_id, round(gaussian, 6) as gaussian, has_ms2 from flagged where (has_ms2 or (gaussian > 0.7 and noise_score < 0.04)) and (sample_id / 20.0 > 0.1 or peak_height >= 40000)")
def final_filter(spark, sf):
    own = _flagged(spark, sf).withColumns({"noise": F.col("noise_score"), "detection_rate": F.col("sample_id") / 20, "highest": F.col("peak_height")})
    return alignment.finally_kept(own, noise_tol=0.04, rate=0.1, ms1_tol=4000.0).select("fid", "sample_id", R(F.col("gaussian")).alias("gaussian"), "has_ms2")


@query(f"""with {V.FEATURES}, {_FLAGGED}, k as (select *, row_number() over (partition by part order by fid) as k from flagged where part % 3 = 0 and gaussian > 0.6 and not (part % 7 = 0) and not (part % 5 = 0))
select fid, part as annotation, sample_id from k where k = 1 and sample_id / 20.0 > 0.5""")
def classifier_filter(spark, sf):
    part = F.col("part")
    own = _flagged(spark, sf).withColumns({
        "feature_id": F.col("fid"), "annotation": part, "search_mode": F.when(part % 3 == 0, "identity_search"), "gaussian_similarity": F.col("gaussian"),
        "is_in_source_fragment": part % 7 == 0, "is_isotope": part % 5 == 0, "detection_rate": F.col("sample_id") / 20,
    })
    return alignment.classifiable(own).select("fid", "annotation", "sample_id")


@query(f"""with {V.FEATURES}, {_FLAGGED} select fid as feature_id, case when part % 3 = 0 then 'identity_' || fid || '_' || part when part % 3 = 1 then 'hybrid_' || fid end as node
from flagged where has_ms2 and part % 3 < 2 and gaussian > 0.7""")
def network_subset(spark, sf):
    part = F.col("part")
    own = _flagged(spark, sf).withColumns({"feature_id": F.col("fid"), "annotation": part.cast("string"), "search_mode": F.when(part % 3 == 0, "identity_search").when(part % 3 == 1, "fuzzy_search"), "quality": F.when(F.col("gaussian") > 0.7, "good").otherwise("bad peak shape")})
    return annotation.network_nodes(own, quality="good").select("feature_id", "node")


@query(f"with {_SIM.format(op='<>')}, best as (select *, row_number() over (partition by query_id order by round(similarity, 9) desc, match_id) as k from sim where similarity > 0.6) select least(query_id, match_id) as src, greatest(query_id, match_id) as dst, round(max(similarity), 6) as similarity from best where k = 1 group by 1, 2")
def network_edges(spark, sf):
    return annotation.network_edges(_similar(spark, sf, best=True), 0.6).withColumn("similarity", R(F.col("similarity")))


@query(f"with {V.MATRIX}, k as (select *, row_number() over (partition by feature_id order by intensity desc, sample_id) as k, count(*) over (partition by feature_id) as n_samples from matrix) select feature_id, sample_id as reference, intensity as highest, n_samples from k where k = 1")
def reference_values(spark, sf):
    return alignment.reference_values(V.matrix(spark, sf))


@query(f"""with {V.PEAKS}, s as (select sample_id, scan_id, min(rt) as rt from peaks group by all), o as (select *, row_number() over (partition by sample_id order by scan_id) as k from s)
select p.sample_id, p.scan_id, mz, intensity from peaks p join o using (sample_id, scan_id) where k = 10 and mz > 5 and mz < 60""")
def scan_slice(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("scan_id"))
    own = _scans(spark, sf).withColumn("k", place).where("k = 10").withColumn("peaks", arrays.clean(F.col("peaks"), 5.0, 60.0, float("-inf")))
    return own.select("sample_id", "scan_id", F.explode("peaks").alias("p")).select("sample_id", "scan_id", "p.mz", "p.intensity")


_NUMBER = "case when p_partkey % 4 = 0 then concat(p_size, ',', p_partkey % 100) when p_partkey % 4 = 1 then concat(p_size, '.', p_partkey % 100) when p_partkey % 4 = 2 then concat(p_size, ',', p_partkey % 10, '.5') else p_name end"


@query(f"with t as (select p_partkey, {_NUMBER} as t from part) select p_partkey, round(try_cast(case when length(t) - length(replace(t, ',', '')) = 1 and not contains(t, '.') then replace(t, ',', '.') else t end as double), 6) as number from t")
def safe_number(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", R(arrays.safe_float(F.expr(_NUMBER))).alias("number"))


# ---- more kernels

@query(f"with {_PLACED} select {_KEYS}, round(sum(pow((intensity - (intensity * 0.9 + 5)) / top, 2)), 9) as error from t group by all")
def squared_error(spark, sf):
    fitted = F.transform("y", lambda v: v * 0.9 + 5)
    return _traces(spark, sf).select("sample_id", "trace_id", R(arrays.squared_error(F.col("y"), fitted), 9).alias("error"))


@query(f"with {_PLACED} select {_KEYS}, coalesce(max(case when intensity > 60000 then i end) - min(case when intensity > 60000 then i end) + 1, 0)::bigint as n_points from t group by all")
def trim_trace(spark, sf):
    cut = F.transform("y", lambda v: F.when(v > 60000, v).otherwise(F.lit(0.0)))
    return _traces(spark, sf).select("sample_id", "trace_id", F.size(arrays.trimmed(cut)).cast("long").alias("n_points"))


@query(f"""with {V.PEAKS}, joined as (select sample_id, scan_id, mz, intensity from peaks union all select sample_id, scan_id - 1, mz, intensity from peaks p where exists (select 1 from peaks o where o.sample_id = p.sample_id and o.scan_id = p.scan_id - 1))
select sample_id, scan_id, row_number() over (partition by sample_id, scan_id order by mz, intensity) - 1 as place, mz, intensity from joined""")
def add_signals(spark, sf):
    """Each scan with the peaks of the next one of its sample added."""
    own = _scans(spark, sf)
    after = own.select("sample_id", (F.col("scan_id") - 1).alias("scan_id"), F.col("peaks").alias("more"))
    both = own.join(after, ["sample_id", "scan_id"], "left").select("sample_id", "scan_id", F.posexplode(arrays.add_signals(F.col("peaks"), F.col("more"))).alias("place", "p"))
    return both.select("sample_id", "scan_id", F.col("place").cast("long").alias("place"), "p.mz", "p.intensity")


@query(f"with {_PLACED} select {_KEYS}, i as place, rt, intensity from t where i >= 2 and i < 6")
def trace_subset(spark, sf):
    """Places 2 to 5 of each trace."""
    own = _traces(spark, sf).select("sample_id", "trace_id", F.posexplode(arrays.subset(F.arrays_zip(F.col("x").alias("rt"), F.col("y").alias("intensity")), 2, 6)).alias("place", "p"))
    return own.select("sample_id", "trace_id", (F.col("place") + 2).cast("long").alias("place"), "p.rt", "p.intensity")


@query(f"with {_PLACED}, b as (select {_KEYS}, min(a.top) as top, min(case when i = apex then rt end) as b from t join a using ({_KEYS}) group by all) select {_KEYS}, i as place, round(b.top * exp(-0.5 * pow((rt - b) / 300, 2)), 6) as fitted from t join b using ({_KEYS})")
def gaussian_curve(spark, sf):
    """A Gaussian of 300 minutes around the apex of each trace."""
    own = _traces(spark, sf).withColumn("at", arrays.apex(F.col("y")))
    curve = F.transform("x", lambda x: arrays.gaussian(x, F.array_max("y"), F.get("x", F.col("at")), F.lit(300.0)))
    made = own.select("sample_id", "trace_id", F.posexplode(curve).alias("place", "fitted"))
    return made.select("sample_id", "trace_id", F.col("place").cast("long").alias("place"), R(F.col("fitted")).alias("fitted"))


_CELLS = [(1, 5.0, 2000.0), (2, 12.5, 9000.0), (3, 20.0, 20000.0), (4, 33.0, 30000.0), (5, 60.0, 40000.0)]


@query(f"""with {V.PEAKS}, f(feature_id, m, t) as (values {', '.join(f'({a}::bigint, {b}::double, {c}::double)' for a, b, c in _CELLS)}),
h as (select feature_id, sample_id, scan_id, min(rt) as rt, max(intensity) as i from peaks join f on abs(mz - m) <= 0.5 and abs(rt - t) <= 3000 where sample_id in ('click', 'view') group by all),
a as (select *, (rt - lag(rt) over w) * (i + lag(i) over w) / 2 as area, row_number() over (partition by feature_id, sample_id order by i desc, scan_id) as k from h window w as (partition by feature_id, sample_id order by scan_id))
select feature_id, sample_id, max(i)::bigint as peak_height, trunc(round(coalesce(sum(area), 0.0) * 60, 3))::bigint as peak_area, trunc(avg(case when k <= 3 then i end))::bigint as top_average from a group by all""")
def gap_fill_values(spark, sf):
    targets = spark.createDataFrame(_CELLS, "feature_id long, consensus_mz double, consensus_rt double")
    cells = targets.select("feature_id", F.explode(F.array(F.lit("click"), F.lit("view"))).alias("sample_id"))
    return detection.fill_gaps(cells, targets, V.peaks(spark, sf), mz_tol=0.5, rt_window=3000.0).drop("is_gap_filled")


@query()
def gap_fill_matrix(spark, sf):
    """Values of all missing cells of the matrix, over all samples: each feature at the place of its highest peak, and the
    feature view as each sample's peaks. A cell that has no peak around it stays without a value."""
    own = V.features(spark, sf)
    best = own.groupBy(F.col("part").alias("feature_id")).agg(F.max(F.struct("peak_height", "fid", "mz", "rt")).alias("b"))
    targets = best.select("feature_id", F.col("b.mz").alias("consensus_mz"), F.col("b.rt").alias("consensus_rt"))
    cells = alignment.missing_cells(V.matrix(spark, sf), V.samples(spark))
    peaks = own.select("sample_id", F.col("rt").cast("long").alias("scan_id"), "rt", "mz", F.col("peak_height").alias("intensity"))
    return detection.fill_gaps(cells, targets, peaks, mz_tol=0.5, rt_window=5.0).drop("is_gap_filled")


@query(f"""with f as (select p_partkey, {_FORMULA} as formula from part), t as (select p_partkey, formula, unnest(regexp_extract_all(formula, '[A-Z][a-z]*[0-9]*')) as tok from f),
m(element, mass) as (values {_ATOMS}), ad(adduct, z, n, c, h, nn, o, other) as (values {_CHANGES}),
w as (select p_partkey, formula, sum(mass::double * coalesce(try_cast(nullif(regexp_extract(tok, '[0-9]+'), '') as bigint), 1)) as mass from t join m on m.element = regexp_extract(tok, '[A-Z][a-z]*') group by all)
select p_partkey, adduct, round((mass * n + c * 12.0::double + h * 1.00782503207::double + nn * 14.0030740052::double + o * 15.9949146221::double + other::double - z * {_ELECTRON}::double) / abs(z), 6) as mz from w, ad""")
def formula_ions(spark, sf):
    own = V.table(spark, sf, "part").select("p_partkey", F.expr(_FORMULA).alias("formula"))
    return annotation.formula_ions(own, spark).select("p_partkey", "adduct", R(F.col("mz")).alias("mz"))


# ---- more normalisation and plot data

@query(f"with {V.MATRIX} select sample_id, round(v, 6) as measure from (select sample_id, sum(intensity) as v from matrix group by all) order by v desc, sample_id limit 1")
def reference_by_total(spark, sf):
    return statistics.reference_sample(V.matrix(spark, sf), "total_intensity").withColumn("measure", R(F.col("measure")))


@query(f"with {V.MATRIX} select sample_id, round(v, 6) as measure from (select sample_id, median(intensity) as v from matrix group by all) order by v desc, sample_id limit 1")
def reference_by_median(spark, sf):
    return statistics.reference_sample(V.matrix(spark, sf), "median_intensity").withColumn("measure", R(F.col("measure")))


def _scaled_by(measure: str) -> str:
    return f"with {V.MATRIX}, t as (select sample_id, {measure}(intensity) as v from matrix where intensity > 0 group by all), r as (select v as base from t order by v desc, sample_id limit 1) select sample_id, round(v / base, 6) as factor from t, r"


@query(_scaled_by("sum"))
def factors_by_total(spark, sf):
    own = V.matrix(spark, sf)
    return statistics.factors(own, statistics.reference_sample(own, "total_intensity"), "total_intensity").withColumn("factor", R(F.col("factor")))


@query(_scaled_by("median"))
def factors_by_median(spark, sf):
    own = V.matrix(spark, sf)
    return statistics.factors(own, statistics.reference_sample(own, "median_intensity"), "median_intensity").withColumn("factor", R(F.col("factor")))


@query(f"""with {V.MATRIX}, q as (select feature_id, count(*) as n_qc, median(intensity) as median, stddev_samp(intensity) / avg(intensity) as rsd, stddev_pop(intensity) as sd from matrix join samples using (sample_id) where is_qc and intensity > 0 group by all)
select feature_id, n_qc, round(median, 6) as median, round(rsd, 6) as rsd, round(median - 1.96 * sd, 6) as low, round(median + 1.96 * sd, 6) as high from q""")
def qc_band(spark, sf):
    found = statistics.qc_band(V.matrix(spark, sf), V.samples(spark))
    return found.select("feature_id", "n_qc", *[R(F.col(c)).alias(c) for c in ("median", "rsd", "low", "high")])


@query("""with e as (select label, embedding[1]::double as x, embedding[2]::double as y from embeddings), g as (select label, count(*) as n, avg(x) as cx, avg(y) as cy, stddev_samp(x) as sx, stddev_samp(y) as sy, corr(x, y) as r from e group by all)
select label, n, round(cx, 6) as centre_x, round(cy, 6) as centre_y, round(sqrt(greatest(0.0, 1 + r)), 6) as radius_x, round(sqrt(greatest(0.0, 1 - r)), 6) as radius_y, round(2 * sx, 6) as scale_x, round(2 * sy, 6) as scale_y from g""")
def confidence_ellipse(spark, sf):
    own = V.table(spark, sf, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    found = statistics.ellipse(own, "label", "x", "y")
    return found.select("label", "n", *[R(F.col(c)).alias(c) for c in ("centre_x", "centre_y", "radius_x", "radius_y", "scale_x", "scale_y")])


@query(f"""with {V.SPECTRA}, s as (select *, max(intensity) over (partition by spectrum_id) as top from spectrum_peaks)
select q.spectrum_id, mz, round(intensity / top, 6) as intensity from s q union all select r.spectrum_id - 1, mz, round(-intensity / top, 6) from s r where exists (select 1 from embeddings where vec_id = r.spectrum_id - 1)""")
def mirror_data(spark, sf):
    own = V.spectra(spark, sf).select("spectrum_id", "peaks")
    up = own.select((F.col("spectrum_id") - 1).alias("spectrum_id"), F.col("peaks").alias("other"))
    both = own.join(up, "spectrum_id", "left").select("spectrum_id", F.explode(sinks.mirror(F.col("peaks"), F.coalesce("other", F.array().cast("array<struct<mz:double,intensity:double>>")))).alias("p"))
    return both.select("spectrum_id", "p.mz", R(F.col("p.intensity")).alias("intensity"))


@query(f"""with {V.SPECTRA}, p as (select spectrum_id, count(*) as n, string_agg(printf('%.4f', mz) || chr(9) || printf('%.4f', intensity), chr(10) order by mz) as body from spectrum_peaks group by all)
select 'NAME: Unknown' || chr(10) || 'ID: ' || vec_id || chr(10) || 'PRECURSORMZ: ' || printf('%.4f', vec_id * 1.5) || chr(10) || 'PRECURSORTYPE: ' || chr(10) || 'RETENTIONTIME: ' || printf('%.3f', label::double) || chr(10)
 || 'FORMULA: ' || chr(10) || 'SMILES: ' || chr(10) || 'INCHIKEY: ' || chr(10) || 'Num Peaks: ' || coalesce(n, 0) || coalesce(chr(10) || body, '') as value from embeddings left join p on vec_id = spectrum_id""")
def msp_export(spark, sf):
    own = V.spectra(spark, sf).select(F.col("spectrum_id").alias("feature_id"), (F.col("spectrum_id") * 1.5).cast("double").alias("mz"), F.col("group_id").cast("double").alias("rt"), F.col("peaks").alias("ms2"))
    return sinks.msp_entries(own)


@query(f"""with {V.SPECTRA}, b as (select *, max(intensity) over (partition by spectrum_id) as top from spectrum_peaks), c as (select spectrum_id, mz, intensity / 2 / sum(intensity) over (partition by spectrum_id) as i from b where intensity >= top * 0.01),
q as (select spectrum_id as fid, (spectrum_id % 50) * 10.0 as pm, group_id_of as rt, mz, i from c join (select vec_id, label::double as group_id_of from embeddings) on vec_id = spectrum_id),
l as (select spectrum_id as lib, (spectrum_id % 50) * 10.0 as lm, g as lt, mz, i from c join (select vec_id, label::double as g from embeddings) on vec_id = spectrum_id),
d as (select fid, lib, q.mz as qm, l.mz as lmz, q.i as a, l.i as b, true as direct, pm, lm, q.rt as rt, lt from q join l on abs(q.mz - l.mz) < 0.015 and fid <> lib
 union all select fid, lib, q.mz, l.mz, q.i, l.i, false, pm, lm, q.rt, lt from q join l on abs((pm - q.mz) - (lm - l.mz)) < 0.015 and fid <> lib),
s as (select *, max(direct::int) over (partition by fid, lib, qm) + max(direct::int) over (partition by fid, lib, lmz) as seen, (a + b) * log2(a + b) - a * log2(a) - b * log2(b) as v from d),
g as (select fid, lib, min(pm) as pm, min(lm) as lm, min(rt) as rt, min(lt) as lt, sum(case when direct then v end) as own, sum(v) as hybrid, sum(direct::int)::bigint as n from s where direct or seen = 0 group by all),
m as (select *, case when abs(pm - lm) < 0.01 and abs(rt - lt) < 0.2 and own > 0.55 then 0 when abs(pm - lm) < 0.01 and own > 0.55 then 1 when hybrid > 0.55 then 2 end as mode from g),
k as (select *, case when mode < 2 then own else hybrid end as sim, row_number() over (partition by fid order by mode, round(case when mode < 2 then own else hybrid end, 9) desc, lib) as k from m where mode is not null)
select fid as feature_id, lib as lib_id, ['identity_search_with_rt', 'identity_search', 'fuzzy_search'][mode + 1] as search_mode, round(sim, 6) as similarity, n as n_matched from k where k = 1""")
def library_search(spark, sf):
    """Every spectrum against all others."""
    own = V.spectra(spark, sf).withColumns({"precursor_mz": (F.col("spectrum_id") % 50) * F.lit(10.0), "rt": F.col("group_id").cast("double")})
    library = own.withColumnsRenamed({"spectrum_id": "lib_id", "rt": "retention_time"})
    found = annotation.search_library(own.withColumn("feature_id", F.col("spectrum_id")), library, least=0.55, itself=False)
    return found.select("feature_id", "lib_id", "search_mode", R(F.col("similarity")).alias("similarity"), "n_matched")


@query("with a as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as b from events window w as (partition by user_id order by ts)), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as g from a) select user_id, min(ts) as start, max(ts) + interval 6 hour as \"end\", count(*) as n from s group by user_id, g")
def session_labels(spark, sf):
    from ..streaming.ingest import session_labels as labelled

    return labelled(V.table(spark, sf, "events"), "6 hours", ["user_id"])


@query()
def isotope_distribution(spark, sf):
    """The isotope pattern of each distinct formula."""

    def patterns(frames):
        import pandas as pd

        for frame in frames:
            rows = [(f, i, mz, share) for f in frame.formula for i, (mz, share) in enumerate(chem.isotope_distribution(f, "[M+H]+"))]
            yield pd.DataFrame(rows, columns=["formula", "place", "mz", "share"])

    own = V.table(spark, sf, "part").select(F.expr(_FORMULA).alias("formula")).distinct()
    return own.mapInPandas(patterns, "formula string, place long, mz double, share double").select("formula", "place", R(F.col("mz"), 4).alias("mz"), R(F.col("share"), 6).alias("share"))
