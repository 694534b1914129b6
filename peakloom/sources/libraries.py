"""Spectral libraries (MSP, JSON, Parquet) and lists of m/z and retention time (CSV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import safe_float

_ALIASES = {"precursortype": "precursor_type", "ionmode": "ion_mode", "retentiontime": "retention_time", "rt": "retention_time"}
_TEXT = ("name", "precursor_type", "ion_mode", "formula", "smiles", "inchikey", "database")
_PEAKS = "array<struct<mz:double,intensity:double>>"


def _named(key: Column) -> Column:
    low = F.lower(F.trim(key))
    out = F.when(low.like("%prec%mz%"), "precursor_mz")
    for old, new in _ALIASES.items():
        out = out.when(low == old, new)
    return out.otherwise(low)


def _shaped(rows: DataFrame) -> DataFrame:
    """Rows (source, fields map, peaks) to the library schema; entries without a precursor go. The id is a hash of the
    entry, so it doesn't depend on how the input was split."""
    get = lambda k: F.try_element_at("fields", F.lit(k))
    known = [*_TEXT, "precursor_mz", "retention_time", "num peaks", "peaks"]
    out = rows.select(
        F.xxhash64(F.map_entries("fields").cast("string"), F.col("peaks").cast("string")).alias("lib_id"),
        *[get(k).alias(k) for k in _TEXT],
        safe_float(get("precursor_mz")).alias("precursor_mz"),
        safe_float(get("retention_time")).alias("retention_time"),
        "peaks",
        F.map_filter("fields", lambda k, v: ~k.isin(*known)).alias("extra"),
    ).where("precursor_mz is not null")
    return out.select("lib_id", "name", "precursor_mz", "precursor_type", "ion_mode", "retention_time", "formula", "smiles", "inchikey", "database", "peaks", "extra")


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """Entries stand between empty lines: ``KEY: value`` lines, then peak lines of m/z and intensity."""
    text = spark.read.text(path, lineSep="\n\n").where(F.length(F.trim("value")) > 0)
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda s: F.trim(F.regexp_replace(s, "\r", ""))), lambda s: s != "")
    number = r"^[-+0-9.,eE]+[\s;:]+[-+0-9.,eE]+"
    fields = F.filter(lines, lambda s: F.contains(s, F.lit(":")) & ~s.rlike(number))
    pairs = F.transform(fields, lambda s: F.struct(_named(F.regexp_extract(s, "^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(s, "^[^:]*:(.*)$", 1)).alias("v")))
    # the first of repeated keys counts
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    first = F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(pairs, lambda p: p["k"] == n), 1)["v"])))
    values = F.transform(F.filter(lines, lambda s: s.rlike(number)), lambda s: F.split(s, r"[\s;:]+"))
    peaks = F.transform(values, lambda v: F.struct(safe_float(F.element_at(v, 1)).alias("mz"), safe_float(F.element_at(v, 2)).alias("intensity")))
    return _shaped(text.select(first.alias("fields"), peaks.cast(_PEAKS).alias("peaks")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects; peaks as pairs of numbers or strings, or as ``mz;intensity|...``."""
    entry = "array<map<string,string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", entry)).alias("raw"))
    fields = F.map_from_entries(F.transform(F.map_entries("raw"), lambda e: F.struct(_named(e["key"]), e["value"])))
    rows = rows.select(fields.alias("fields"))
    text = F.try_element_at("fields", F.lit("peaks"))
    pairs = F.from_json(text, "array<array<string>>")
    coded = F.transform(F.split(text, r"\|"), lambda s: F.split(s, ";"))
    values = F.when(text.startswith("["), pairs).otherwise(coded)
    peaks = F.transform(values, lambda v: F.struct(safe_float(F.get(v, 0)).alias("mz"), safe_float(F.get(v, 1)).alias("intensity")))
    return _shaped(rows.select("fields", F.coalesce(peaks.cast(_PEAKS), F.array().cast(_PEAKS)).alias("peaks")))


def load_library(spark: SparkSession, path: str) -> DataFrame:
    """By extension; pickles are refused, they can run code."""
    low = path.lower()
    if low.endswith(".msp"):
        return read_msp(spark, path)
    if low.endswith(".json"):
        return read_json(spark, path)
    if low.endswith((".parquet", "/")):
        return spark.read.parquet(path)
    raise ValueError(f"libraries are read from .msp, .json or .parquet, not {path}")


def index_library(library: DataFrame, path: str, width: float = 1.0) -> None:
    """The library as Parquet, clustered by precursor so that row groups can be skipped."""
    library.withColumn("mz_bin", F.floor(F.col("precursor_mz") / width)).repartitionByRange("mz_bin").sortWithinPartitions("mz_bin", "precursor_mz").write.mode("overwrite").parquet(path)


def read_mzrt(spark: SparkSession, path: str) -> DataFrame:
    """Name, m/z and retention time by place, further columns by name; rows keep the order of the file."""
    raw = spark.read.csv(path, header=True)
    a, b, c = raw.columns[:3]
    more = {n.lower(): n for n in raw.columns[3:]}
    own = raw.withColumn("lib_id", F.monotonically_increasing_id())
    return own.select("lib_id", F.col(a).alias("name"), safe_float(F.col(b)).alias("lib_mz"), safe_float(F.col(c)).alias("lib_rt"), *[(F.col(more[k]) if k in more else F.lit(None).cast("string")).alias(k) for k in ("adduct", "inchikey", "formula", "smiles")])
