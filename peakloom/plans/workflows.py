"""Whole runs: one folder of raw files to features, and to the aligned, annotated, grouped and normalised table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import alignment, annotation, detection, learning, spectra, statistics
from ..operators.rangejoin import sized
from ..params import ORBITRAP, Params
from ..sources import libraries, projects, raw, sinks
from .tables import stored

#: Spectra of a feature that are searched in a library.
MS2_SPECTRA = 5


def detect(spark: SparkSession, path: str | list[str], params: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, cleaned scans, errors) of all raw files at a path. Three writes: decoded scans, cleaned scans, features."""
    scans, errors = raw.read_scans(spark, path, params.scan_levels, params.rt_lower, params.rt_upper)
    ms1 = max(params.ms1_abs_int_tol, ORBITRAP[0]) if params.ms_type == "orbitrap" else params.ms1_abs_int_tol
    ms2 = max(params.ms2_abs_int_tol, ORBITRAP[1]) if params.ms_type == "orbitrap" else params.ms2_abs_int_tol
    cleaned = spectra.clean_scans(scans, mz_low=params.mz_lower, mz_high=params.mz_upper, ms1_abs=ms1, ms2_abs=ms2, ms2_rel=params.ms2_rel_int_tol, offset=params.precursor_mz_offset, centroid_tol=params.centroid_mz_tol)
    cleaned = stored(cleaned, "cleaned")
    peaks = spectra.explode_scans(cleaned.where("level = 1")).select("sample_id", "scan_id", "rt", "mz", "intensity")
    traces = detection.link_traces(peaks, mz_tol=params.mz_tol_ms1, gap_tol=params.feature_gap_tol, splits=2)
    features = stored(detection.summarise(traces), "features")
    return attach_ms2(features, cleaned, peaks), cleaned, errors


def attach_ms2(features: DataFrame, scans: DataFrame, peaks: DataFrame) -> DataFrame:
    """Adds the best MS2 scan of each feature: ms2_scan_id, ms2, precursor_ion_fraction."""
    own = scans.where("level = 2 and precursor_mz is not null").select("sample_id", F.col("scan_id").alias("ms2_id"), "precursor_mz", F.col("rt").alias("ms2_rt"), F.col("peaks").alias("ms2"), "iso_lo")
    to = spectra.allocate_ms2(features, own.select("sample_id", "ms2_id", "precursor_mz", "ms2_rt"))
    tic = arrays.total(F.transform("ms2", lambda p: p["intensity"]))
    best = F.max(F.struct(tic.alias("tic"), (-F.col("ms2_id")).alias("minus"), "ms2", "precursor_mz", "ms2_rt"))
    chosen = to.join(own, ["sample_id", "ms2_id"]).groupBy("sample_id", "feature_id").agg(best.alias("b")).where("b.tic > 0")
    chosen = chosen.select("sample_id", "feature_id", (-F.col("b.minus")).alias("ms2_scan_id"), F.col("b.ms2").alias("ms2"), F.col("b.precursor_mz").alias("precursor_mz"), F.col("b.ms2_rt").alias("ms2_rt"))
    keyed = chosen.select("sample_id", F.concat_ws("/", "sample_id", "ms2_scan_id").alias("ms2_id"), "precursor_mz", "ms2_rt").distinct()
    share = spectra.precursor_fraction(keyed, peaks, 1.5, 1.5).select("ms2_id", F.col("fraction").alias("precursor_ion_fraction"))
    chosen = chosen.withColumn("ms2_id", F.concat_ws("/", "sample_id", "ms2_scan_id")).join(share, "ms2_id", "left").drop("ms2_id", "ms2_rt", "precursor_mz")
    return features.join(chosen, ["sample_id", "feature_id"], "left")


def process_single_file(spark: SparkSession, path: str, params: Params | None = None) -> DataFrame:
    """Features of one file, annotated by the library of MS2 spectra where there is one, and grouped."""
    params = params or Params()
    features, _, errors = detect(spark, path, params)
    if failed := errors.limit(1).collect():
        raise ValueError(f"{failed[0].sample_id}: {failed[0].message}")
    known = [c for c in ("adduct",) if params.ms2_library_path]
    if params.ms2_library_path:
        features = stored(annotate_single(spark, features, params), "annotated")
    rows = features.select("sample_id", F.col("feature_id").alias("fid"), "mz", "rt", F.col("peak_height").alias("height"), "trace", *known, F.transform(F.coalesce("ms2", F.array().cast("array<struct<mz:float,intensity:float>>")), lambda p: p["mz"]).alias("ms2_mz"))
    groups = detection.group_ions(rows, params.ion_mode, mz_tol=params.mz_tol_feature_grouping, rt_tol=params.rt_tol_feature_grouping, cor_tol=params.scan_scan_cor_tol)
    if known:
        groups = groups.withColumnRenamed("adduct", "group_adduct")
    return features.join(groups.withColumnRenamed("fid", "feature_id"), ["sample_id", "feature_id"], "left")


def batch_file_processing(spark: SparkSession, path: str, out: str, params: Params | None = None) -> DataFrame:
    """Features of all files of a folder as Parquet, by sample. Files of samples that are there already aren't read.
    -> errors."""
    params = params or Params()
    done = None
    try:
        done = spark.read.parquet(out).select("sample_id").distinct()
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
    files = raw.raw_files(spark, path, done)
    if not files:
        return spark.createDataFrame([], "sample_id string, step string, message string")
    features, _, errors = detect(spark, files, params)
    features.write.mode("append").partitionBy("sample_id").parquet(out)
    return errors


def align(spark: SparkSession, features: DataFrame, samples: DataFrame, params: Params, peaks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(aligned features, quantities) of per-file features: times corrected, matched in the order of the samples,
    filtered by scores and detection rate, merged, gaps filled from ``peaks`` (MS1, long form)."""
    use = features.withColumn("fid", F.concat_ws("/", "sample_id", "feature_id"))
    use = alignment.alignable(use, params.scan_number_cutoff)
    # exported values are rounded and alignment reads these
    use = use.withColumns({"mz": F.bround("mz", 4), "rt": F.bround("rt", 3), "gaussian_similarity": F.bround("gaussian_similarity", 2), "noise_score": F.bround("noise_score", 2)})
    if params.correct_rt:
        reference = alignment.reference_file(use).first()
        if reference is not None:
            use = detection.correct_times(use, reference.sample_id, mz_tol=params.mz_tol_alignment, rt_tol=params.rt_tol_rt_correction, height=5 * params.ms1_abs_int_tol).drop("rt").withColumnRenamed("rt_corrected", "rt")
    use = stored(use, "corrected")
    rows = use.select("sample_id", "fid", "mz", "rt", F.col("peak_height").cast("double").alias("height"), F.col("gaussian_similarity").alias("gaussian"), F.col("noise_score").alias("noise"), F.col("ms2").isNotNull().alias("has_ms2"))
    found = detection.align_features(rows, samples.select("sample_id", "align_order"), mz_tol=params.mz_tol_alignment, rt_tol=params.rt_tol_alignment, noise_tol=params.noise_tol, gaussian_tol=params.gaussian_similarity_tol, ms1_tol=params.ms1_abs_int_tol)
    found = stored(found.join(use.select("fid", "peak_height", "peak_area", "top_average"), "fid"), "matched")

    blanks = samples.select("sample_id", F.coalesce("is_blank", F.lit(False)).alias("is_blank"))
    n = max(1, blanks.where("not is_blank").count())
    rates = found.join(sized(blanks), "sample_id").groupBy("feature_id").agg((F.sum(F.when(~F.col("is_blank"), 1).otherwise(0)) / n).alias("detection_rate"))
    features_ = found.groupBy("feature_id").agg(*[F.first(c).alias(c) for c in ("consensus_mz", "consensus_rt", "reference", "highest")]).join(rates, "feature_id")
    features_ = features_.where((F.col("detection_rate") > params.detection_rate_cutoff) | (F.col("highest") >= 10 * params.ms1_abs_int_tol))
    spectrum = F.struct(arrays.total(F.transform("ms2", lambda p: p["intensity"])).alias("tic"), "ms2", F.col("sample_id").alias("ms2_reference_file"), "ms2_scan_id", "precursor_ion_fraction")
    own = found.select("feature_id", "fid").join(use.where("ms2 is not null").select("fid", "sample_id", "ms2", "ms2_scan_id", "precursor_ion_fraction"), "fid").select("feature_id", spectrum.alias("b"))
    # the MS2_SPECTRA of highest total intensity, best first
    rank = F.row_number().over(Window.partitionBy("feature_id").orderBy(F.col("b.tic").desc(), F.col("b.ms2_reference_file"), F.col("b.ms2_scan_id")))
    ms2 = own.withColumn("_rank", rank).where(F.col("_rank") <= MS2_SPECTRA).groupBy("feature_id").agg(F.sort_array(F.collect_list(F.struct("_rank", "b"))).alias("_ms2"))
    ms2 = ms2.select("feature_id", F.transform("_ms2", lambda x: x["b"]).alias("ms2_spectra"))
    ms2 = ms2.select("feature_id", "ms2_spectra", *[F.col("ms2_spectra")[0][c].alias(c) for c in ("ms2", "ms2_reference_file", "ms2_scan_id", "precursor_ion_fraction")])
    quant = found.select("feature_id", "sample_id", "mz", "rt", "peak_height", "peak_area", "top_average", F.lit(False).alias("is_gap_filled"))
    if params.merge_features:
        flat = features_.select(F.lit(0).alias("all"), "feature_id", F.col("consensus_mz").alias("mz"), F.col("consensus_rt").alias("rt"), F.col("highest").alias("peak_height"))
        from ..operators.islands import global_islands, islands

        near = islands(global_islands(flat, "mz", params.mz_tol_merge_features, "mz_island"), ["mz_island"], "rt", params.rt_tol_merge_features, ties=("feature_id",), name="rt_island")
        keep = near.groupBy("mz_island", "rt_island").agg(F.min(F.struct((-F.col("peak_height")).alias("m"), "feature_id"))["feature_id"].alias("kept"))
        to = near.join(keep, ["mz_island", "rt_island"]).select("feature_id", "kept")
        features_ = features_.join(to, "feature_id").where("feature_id = kept").drop("kept")
        merged = quant.join(to, "feature_id").groupBy(F.col("kept").alias("feature_id"), "sample_id")
        quant = merged.agg(*[F.max_by(c, F.struct("peak_height", "rt")).alias(c) for c in ("mz", "rt")], *[F.max(c).alias(c) for c in ("peak_height", "peak_area", "top_average")], F.lit(False).alias("is_gap_filled"))
    features_ = stored(features_, "aligned")
    quant = quant.join(features_.select("feature_id"), "feature_id", "left_semi")
    if params.fill_gaps and peaks is not None:
        cells = alignment.missing_cells(quant, samples)
        filled = detection.fill_gaps(cells, features_, peaks, mz_tol=params.mz_tol_alignment, rt_window=params.gap_filling_rt_window)
        places = features_.select("feature_id", F.col("consensus_mz").alias("mz"), F.col("consensus_rt").alias("rt"))
        quant = quant.unionByName(filled.join(places, "feature_id").select(quant.columns))
    quant = stored(quant, "quant")
    again = quant.where("peak_height > 0").join(sized(blanks), "sample_id").groupBy("feature_id").agg((F.sum(F.when(~F.col("is_blank"), 1).otherwise(0)) / n).alias("detection_rate_gap_filled"))
    out = features_.join(again, "feature_id", "left").join(ms2, "feature_id", "left")
    return out.withColumnRenamed("consensus_mz", "mz").withColumnRenamed("consensus_rt", "rt").withColumnRenamed("reference", "alignment_reference_file"), quant


def _library_hits(spark: SparkSession, own: DataFrame, params: Params, fuzzy: bool) -> DataFrame:
    """What a library knows of spectra (feature_id, spectrum_id, precursor_mz, rt, peaks): feature_id, spectrum_id,
    search_mode, similarity, matched_peak_number, annotation, adduct, formula, smiles, inchikey. Peaks near the
    precursor don't count."""
    library = libraries.load_library(spark, params.ms2_library_path)
    own = own.withColumn("peaks", F.filter("peaks", lambda p: p["mz"] <= F.col("precursor_mz") - params.precursor_mz_offset)).where(F.size("peaks") > 0)
    hits = annotation.search_library(own, library, mz_tol_ms1=params.mz_tol_ms1, mz_tol_ms2=params.mz_tol_ms2, rt_tol=params.rt_tol_annotation if params.consider_rt else None, least=params.ms2_sim_tol, ion_mode=params.ion_mode, fuzzy=fuzzy)
    names = library.select("lib_id", F.col("name").alias("annotation"), F.col("precursor_type").alias("adduct"), "formula", "smiles", "inchikey")
    hits = hits.join(names, "lib_id").withColumn("adduct", F.when(F.col("search_mode") == "identity_search", F.col("adduct")))
    return hits.dropDuplicates(["feature_id"]).drop("lib_id").withColumnRenamed("n_matched", "matched_peak_number")


def annotate_single(spark: SparkSession, features: DataFrame, params: Params) -> DataFrame:
    """Features of single files (sample_id, feature_id, mz, rt, ms2) with what the library of MS2 spectra knows."""
    key = F.concat_ws("/", "sample_id", "feature_id")
    own = features.where("ms2 is not null").select(key.alias("feature_id"), F.lit(0).alias("spectrum_id"), F.col("mz").alias("precursor_mz"), "rt", F.col("ms2").alias("peaks"))
    hits = _library_hits(spark, own, params, fuzzy=True).drop("spectrum_id").withColumnRenamed("feature_id", "_key")
    return features.withColumn("_key", key).join(hits, "_key", "left").drop("_key")


def annotate(spark: SparkSession, aligned: DataFrame, params: Params) -> DataFrame:
    """Adds search_mode, annotation and what the library knows; a list of m/z and time overrides spectra. Up to
    MS2_SPECTRA spectra of a feature are searched, and the one that matches becomes its spectrum; fuzzily the first."""
    out = aligned
    empty = [(c, F.lit(None).cast("string")) for c in ("search_mode", "annotation", "formula", "smiles", "inchikey")]
    if params.ms2_library_path:
        each = aligned.where("ms2 is not null").select("feature_id", F.col("mz").alias("precursor_mz"), "rt", F.posexplode("ms2_spectra").alias("spectrum_id", "s"))
        hits = _library_hits(spark, each.select("feature_id", "spectrum_id", "precursor_mz", "rt", F.col("s.ms2").alias("peaks")), params, params.fuzzy_search)
        out = out.join(hits, "feature_id", "left")
        found = F.get("ms2_spectra", F.coalesce("spectrum_id", F.lit(0)))
        out = out.withColumns({c: found[c] for c in ("ms2", "ms2_reference_file", "ms2_scan_id", "precursor_ion_fraction")}).drop("spectrum_id")
    else:
        out = out.withColumns(dict(empty))
    out = out.drop("ms2_spectra")
    if params.mzrt_list_path:
        wanted = libraries.read_mzrt(spark, params.mzrt_list_path)
        rows = aligned.select("feature_id", "mz", "rt", F.col("highest").alias("peak_height"))
        taken = annotation.annotate_by_list(rows, wanted, params.mz_tol_alignment, params.rt_tol_alignment).join(sized(wanted), "lib_id")
        taken = taken.select("feature_id", *[F.col(c).alias(f"l_{c}") for c in ("name", "formula", "smiles", "inchikey")])
        out = out.join(taken, "feature_id", "left")
        listed = F.col("l_name").isNotNull()
        out = out.withColumns({"search_mode": F.when(listed, "mzrt_search").otherwise(F.col("search_mode")), "annotation": F.when(listed, F.col("l_name")).otherwise(F.col("annotation")), **{c: F.when(listed, F.col(f"l_{c}")).otherwise(F.col(c)) for c in ("formula", "smiles", "inchikey")}})
        out = out.drop("l_name", "l_formula", "l_smiles", "l_inchikey")
    return out


def untargeted(spark: SparkSession, data_dir: str, out: str, params: Params | None = None, sample_csv: str | None = None) -> dict[str, DataFrame]:
    """The whole workflow; writes aligned TSV and MSP below ``out`` and returns the tables."""
    params = params or Params()
    runs = stored(projects.prepare(spark, data_dir, projects.read_samples(spark, sample_csv) if sample_csv else None), "runs").where("is_valid")
    features, scans, errors = detect(spark, data_dir, params)
    runs = runs.join(errors.select("sample_id"), "sample_id", "left_anti")
    peaks = spectra.explode_scans(scans.where("level = 1")).select("sample_id", "scan_id", "rt", "mz", "intensity")
    features = stored(features, "with_ms2")
    aligned, quant = align(spark, features, runs, params, peaks)
    aligned = stored(annotate(spark, stored(aligned, "aligned_ms2"), params), "annotated")
    located = aligned.withColumnRenamed("alignment_reference_file", "reference")
    fragments = F.transform(F.coalesce("ms2", F.array().cast("array<struct<mz:float,intensity:float>>")), lambda p: p["mz"])
    rows = located.select(F.lit(0).alias("sample_id"), F.col("feature_id").alias("fid"), "mz", "rt", "reference", F.col("highest").alias("height"), fragments.alias("ms2_mz"), *[c for c in ("adduct",) if c in aligned.columns])
    rows = detection.pair_correlations(rows, peaks, params.ion_mode, rt_tol=params.rt_tol_feature_grouping)
    located = detection.feature_isotopes(located, scans.where("level = 1 and size(peaks) > 0"), mz_tol=params.mz_tol_feature_grouping)
    aligned = located.withColumnRenamed("reference", "alignment_reference_file")
    groups = detection.group_ions(rows, params.ion_mode, mz_tol=params.mz_tol_feature_grouping, rt_tol=params.rt_tol_feature_grouping, cor_tol=params.scan_scan_cor_tol).drop("sample_id").withColumnRenamed("fid", "feature_id")
    if "adduct" in aligned.columns:
        groups = groups.withColumnRenamed("adduct", "group_adduct")
    aligned = stored(aligned.join(groups, "feature_id", "left"), "grouped")
    matrix = quant.select("feature_id", "sample_id", F.col(params.quant_method).cast("double").alias("intensity"))
    if params.signal_normalization:
        matrix = detection.correct_drift(matrix, runs)
    if params.sample_normalization:
        chosen = statistics.high_quality(matrix, runs).where("is_high_quality").select("feature_id")
        kept = matrix.join(chosen, "feature_id", "left_semi")
        matrix = statistics.apply_factors(matrix, statistics.factors(kept, statistics.reference_sample(kept)))
    tests = analyse(matrix, runs, params) if params.run_statistics else {}
    if "univariate" in tests:
        aligned = aligned.join(tests["univariate"].select("feature_id", "p_value"), "feature_id", "left")
    names = [r.sample_id for r in runs.orderBy("align_order").select("sample_id").collect()]  # one row a file
    sinks.aligned_tsv(aligned, quant, names, f"{out}/aligned_feature_table", params.quant_method)
    sinks.msp(aligned, f"{out}/features.msp")
    sinks.run_record(runs, errors, params.to_json(), f"{out}/run_record")
    return {"features": features, "aligned": aligned, "quant": quant, "matrix": matrix, "runs": runs, "errors": errors, **tests}


def analyse(matrix: DataFrame, samples: DataFrame, params: Params) -> dict[str, DataFrame]:
    """Statistics of the quantities of samples that are neither QC nor blank: components (the first two principal ones a
    sample), neighbours (what a map of samples shows), and, where ``by_group_name`` is a column of the sample table with
    two groups or more, univariate (feature_id, statistic, p_value): Student's t for two groups, ANOVA for more."""
    own = samples.where(~F.coalesce("is_qc", F.lit(False)) & ~F.coalesce("is_blank", F.lit(False)))
    kept = stored(matrix.join(sized(own.select("sample_id")), "sample_id").where("intensity > 0"), "analysed")
    n = own.count()
    scaled = stored(statistics.impute_scale(kept, n, relative=True), "scaled")
    out = {"components": learning.sample_components(scaled), "neighbours": learning.neighbours(scaled, min(15, max(1, n - 1)))}
    if params.by_group_name and params.by_group_name in samples.columns:
        grouped = own.select("sample_id", F.col(params.by_group_name).cast("string").alias("group_id")).where("group_id is not null")
        groups = sorted(r.group_id for r in grouped.select("group_id").distinct().collect())  # a few groups
        if len(groups) == 2:
            t = statistics.t_statistic(kept, grouped, groups)
            out["univariate"] = t.select("feature_id", F.col("t").alias("statistic"), statistics.t_test_p("t", F.col("df").cast("double")).alias("p_value"))
        elif len(groups) > 2:
            f = statistics.anova(kept, grouped, groups)
            out["univariate"] = f.select("feature_id", F.col("f").alias("statistic"), statistics.f_test_p("f", F.col("df_between").cast("double"), F.col("df_within").cast("double")).alias("p_value"))
    return out


def run_evaluation(features: DataFrame, samples: DataFrame) -> DataFrame:
    return statistics.outlier_files(features, samples)


def build_classifier(matrix: DataFrame, labels: DataFrame, k: int | None = None, features: DataFrame | None = None, *, gaussian: float = 0.6, rate: float = 0.9):
    """(model, columns, rows) of a long matrix and labels (sample_id, label double). ``features``: the aligned features,
    of which those of good shape that are annotated by identity are taken (:func:`alignment.classifiable`); without it
    all features of the matrix are. ``columns`` (known_id, place, fill) are the model's inputs: missing cells are half
    the feature's least value. A tenth of the features, five at least, are chosen by ANOVA F inside the model."""
    if features is not None:
        matrix = matrix.join(sized(alignment.classifiable(features, gaussian=gaussian, rate=rate).select("feature_id")), "feature_id")
    least = {r.feature_id: r.least / 2 for r in matrix.where("intensity > 0").groupBy("feature_id").agg(F.min("intensity").alias("least")).collect()}  # as many as the model has columns
    columns = [(f, place, float(least[f])) for place, f in enumerate(sorted(least))]
    kind = dict(matrix.dtypes)["feature_id"]
    table = matrix.sparkSession.createDataFrame(columns, f"known_id {kind}, place int, fill double")
    rows = _model_rows(matrix.withColumnRenamed("feature_id", "known_id"), table).join(labels, "sample_id")
    return learning.classifier(len(columns), k).fit(rows), table, rows


def assess_classifier(rows: DataFrame, k: int | None = None, folds: int = 5, held_share: float = 0.2) -> dict[str, DataFrame]:
    """What tells how good a classifier on such rows (sample_id, features, label) is: folds (accuracy of each), and, for
    two classes, roc (fpr, tpr) and auc of a model whose hold-out of about ``held_share`` it has not seen."""
    rows = stored(rows.select("sample_id", "features", "label"), "rows")
    first = rows.first()
    width = len(first.features) if first else 0
    out = {"folds": learning.cross_validate(rows, width, folds, key="sample_id", k=k)}
    if rows.select("label").distinct().limit(3).count() == 2:
        held = F.pmod(F.xxhash64("sample_id", F.lit(11)), F.lit(1000)) < int(1000 * held_share)
        model = learning.classifier(width, k).fit(rows.where(~held))
        scored = model.transform(rows.where(held))
        out["roc"] = learning.roc_curve(scored)
        out["auc"] = learning.area_under(out["roc"])
    return out


def _model_rows(matrix: DataFrame, columns: DataFrame) -> DataFrame:
    """sample_id and the vector of its values at the ``columns`` (known_id, place, fill), by name. The columns are
    data and not part of the plan, so there may be many."""
    from pyspark.ml.functions import array_to_vector

    cells = matrix.join(sized(columns), "known_id").select("sample_id", "place", F.coalesce(F.nullif(F.col("intensity").cast("double"), F.lit(0.0)), F.col("fill")).alias("v"))
    wide = cells.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("m"))
    fills = columns.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "fill"))), lambda x: x["fill"]).alias("fills"))
    values = F.transform("fills", lambda fill, place: F.coalesce(F.try_element_at("m", place), fill))
    return wide.join(F.broadcast(fills)).select("sample_id", array_to_vector(values).alias("features"))  # one row, a number a column


def predict_samples(model, columns: DataFrame, known: DataFrame, features: DataFrame, matrix: DataFrame, *, mz_tol: float = 0.01, rt_tol: float = 0.3) -> DataFrame:
    """Predicted class of each sample of another study: its features (feature_id, mz, rt) are matched to the model's
    (``known``: known_id, known_mz, known_rt) by m/z and time; those without a match count as missing."""
    first = columns.orderBy("place").first()
    matched = learning.match_to_model(features, known, mz_tol, rt_tol).where("feature_id is not null").select("known_id", "feature_id")
    own = matrix.join(sized(matched), "feature_id").select("sample_id", "known_id", "intensity")
    # samples without any match stay, with all values missing
    own = matrix.select("sample_id").distinct().join(own, "sample_id", "left").withColumn("known_id", F.coalesce("known_id", F.lit(first.known_id))).withColumn("intensity", F.coalesce("intensity", F.lit(0.0)))
    best = own.groupBy("sample_id", "known_id").agg(F.max("intensity").alias("intensity"))
    return model.transform(_model_rows(best, columns)).select("sample_id", "prediction", "probability")
