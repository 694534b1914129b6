"""Tables and libraries written for other tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import decode_spectrum, encode_spectrum
from ..schema import EXPORTED_ALIGNED_COLUMNS, EXPORTED_FEATURE_COLUMNS

_DIGITS = {"m/z": 4, "RT": 3, "RT_start": 3, "RT_end": 3, "Gaussian_similarity": 2, "noise_score": 2, "asymmetry_factor": 2, "similarity": 4, "scan_scan_cor": 3, "detection_rate": 2, "detection_rate_gap_filled": 2, "precursor_ion_fraction": 2}
_NAMES = {"group_ID": "group_id", "feature_ID": "feature_id", "m/z": "mz", "RT": "rt", "scan_idx": "scan_id", "Gaussian_similarity": "gaussian_similarity", "RT_start": "rt_start", "RT_end": "rt_end", "adduct": "adduct", "MS2": "ms2", "SMILES": "smiles", "InChIKey": "inchikey", "MS2_scan_id": "ms2_scan_id"}


def exported(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of an exported table, rounded half to even; those that ``df`` lacks are empty."""
    def one(name: str) -> Column:
        own = next((c for c in (name, _NAMES.get(name, name), name.lower()) if c in df.columns), None)
        if own is None:
            return F.lit(1 if name == "charge" else None).cast("int" if name == "charge" else "string").alias(name)
        kind = dict(df.dtypes)[own]
        value = F.col(f"`{own}`")
        if kind.startswith("array<struct"):
            value = encode_spectrum(value)
        return (F.bround(value, _DIGITS[name]) if name in _DIGITS and kind in ("double", "float") else value).alias(name)

    return df.select(*map(one, columns))


def features_tsv(features: DataFrame, path: str) -> None:
    exported(features.withColumn("peak_shape", peak_shape(F.col("trace"), F.col("rt"))) if "trace" in features.columns else features, EXPORTED_FEATURE_COLUMNS).write.mode("overwrite").csv(path, sep="\t", header=True)


def peak_shape(trace: Column, rt: Column) -> Column:
    """``time;intensity|`` of the trace within a minute of the apex."""
    near = F.filter(trace, lambda p: F.abs(p["rt"] - rt) <= 1)
    return F.concat_ws("", F.transform(near, lambda p: F.concat(F.format_string("%.3f;%.0f", p["rt"], p["intensity"]), F.lit("|"))))


def aligned_tsv(aligned: DataFrame, quant: DataFrame, names: Sequence[str], path: str, method: str = "peak_height") -> None:
    """One row a feature, with a column of whole numbers a sample."""
    wide = quant.groupBy("feature_id").pivot("sample_id", list(names)).agg(F.first(method).cast("long"))
    wide = wide.select(F.col("feature_id").alias("_id"), *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names])
    table = exported(aligned, EXPORTED_ALIGNED_COLUMNS)
    table.join(wide, table["feature_ID"] == wide["_id"], "left").drop("_id").write.mode("overwrite").csv(path, sep="\t", header=True)


def msp_entries(features: DataFrame, with_id: bool = True, keep_empty: bool = True) -> DataFrame:
    """MSP text of features (feature_id, mz, rt, ms2 and optional adduct, annotation, smiles, inchikey, formula)."""
    get = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in features.columns else F.lit("")
    number = lambda v: F.format_string("%.4f", F.bround(v.cast("double"), 4))
    n = F.coalesce(F.size("ms2"), F.lit(0))
    lines = F.transform("ms2", lambda p: F.concat(number(p["mz"]), F.lit("\t"), number(p["intensity"])))
    head = [F.concat(F.lit("ID: "), get("feature_id"))] * with_id
    parts = [F.concat(F.lit("NAME: "), F.coalesce(F.nullif(get("annotation"), F.lit("")), F.lit("Unknown"))), *head, F.concat(F.lit("PRECURSORMZ: "), F.format_string("%.4f", F.col("mz"))), F.concat(F.lit("PRECURSORTYPE: "), get("adduct")), F.concat(F.lit("RETENTIONTIME: "), F.format_string("%.3f", F.col("rt"))), *[F.concat(F.lit(f"{k.upper()}: "), get(k)) for k in ("formula", "smiles", "inchikey")], F.concat(F.lit("Num Peaks: "), F.greatest(n, F.lit(0)).cast("string"))]
    rows = features if keep_empty else features.where(n > 0)
    return rows.select(F.concat_ws("\n", *parts, F.when(n > 0, F.array_join(lines, "\n"))).alias("value"))


def msp(features: DataFrame, path: str, **options: bool) -> None:
    if not path.lower().rstrip("/").endswith(".msp"):
        raise ValueError("an MSP path ends in .msp")
    msp_entries(features, **options).write.mode("overwrite").text(path, lineSep="\n\n")


def scans_parquet(scans: DataFrame, path: str, codec: str = "zstd") -> None:
    """The cache of cleaned scans, partitioned by sample so that one sample is one folder."""
    scans.repartition("sample_id").write.mode("overwrite").option("compression", codec).partitionBy("sample_id").parquet(path)


def mirror(query: Column, reference: Column) -> Column:
    """Data of a mirror plot: intensities over the highest, the reference's below zero."""
    top = lambda p: F.array_max(F.transform(p, lambda x: x["intensity"]))
    scaled = lambda p, sign: F.transform(p, lambda x: F.struct(x["mz"].alias("mz"), (x["intensity"] / top(p) * sign).alias("intensity")))
    return F.concat(scaled(query, 1.0), scaled(reference, -1.0))


def read_features_tsv(spark: SparkSession, path: str) -> DataFrame:
    """An exported table with the engine's own names and types: numbers where all but text columns are concerned, and
    spectra as arrays of peaks."""
    raw = spark.read.csv(path, sep="\t", header=True)
    text = {"adduct", "search_mode", "annotation", "formula", "SMILES", "InChIKey", "database", "peak_shape", "alignment_reference_file", "MS2_reference_file", "group_ID", "feature_ID", "isotope_state"}
    flags, spectra = {"is_isotope", "is_in_source_fragment"}, {"MS2", "isotopes", "matched_MS2"}

    def one(name: str) -> Column:
        value, as_name = F.col(f"`{name}`"), _NAMES.get(name, name).lower()
        if name in spectra:
            return F.when(value.isNotNull(), decode_spectrum(value)).alias(as_name)
        if name in flags:
            return (F.lower(value) == "true").alias(as_name)
        return value.alias(as_name) if name in text else value.try_cast("double").alias(as_name)

    return raw.select(*[one(c) for c in raw.columns])


def run_record(runs: DataFrame, errors: DataFrame, parameters: str, path: str) -> None:
    """What a run was made with and how it went, as JSON: a line for the parameters and one for each file."""
    files = runs.join(errors.select("sample_id", "step", "message"), "sample_id", "full_outer")
    state = files.select(F.to_json(F.struct(*files.columns, F.when(F.col("message").isNull(), "done").otherwise("failed").alias("status"))).alias("value"))
    head = runs.sparkSession.createDataFrame([(parameters.replace("\n", ""),)], "value string")
    head.unionByName(state).write.mode("overwrite").text(path)
