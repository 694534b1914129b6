"""Licence scans by canonical digest: entire texts, normalised, are looked up among known licence texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .licence_texts import KNOWN, known_texts

#: Spellings that mean the same, as words of the normalised text.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"), ("noninfringement", "non infringement"), ("whilst", "while"), ("modelled", "modeled"), ("http", "https"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """Lines that hold a copyright notice or ``all rights reserved`` go; ASCII letters become small, all but ASCII
    letters, digits and code points from 128 on become single spaces, and equivalent spellings become one."""
    out = F.translate(text, _UPPER, _LOWER)
    out = F.regexp_replace(out, r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*", "$1")
    out = F.concat(F.lit(" "), F.regexp_replace(out, "[\\x00-/:-`{-\\x7f]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, f" {old} ", f" {new} ")
    return F.trim(F.regexp_replace(out, " +", " "))


#: A notice as words: copyright with a sign or a year (or their placeholders), or a sign with a year.
_YEAR = "(?:years?|yyyy|[0-9]{2}[0-9xy]{2})"
_MARK = f" (?:copyright(?: ?(?:c|©|{_YEAR}))+|© ?(?:copyright)?(?: ?{_YEAR})*|c (?:copyright )?{_YEAR}(?: {_YEAR})*)(?= )"
#: First words of what follows a notice in licences and their own notices.
_OPENERS = ("permission (?:is hereby granted|is granted|to use)", "redistribution and use", "this (?:software|program|library|file|work|license|document) (?:is|was|may|comes)", "everyone is permitted", "licensed under", "you may not use", "gnomovision comes", "the (?:mit|isc|zlib) license", "(?:mit|isc|zlib|apache|bsd) license")
_NOTICE = f"(?s){_MARK}.{{0,200}}?(?=(?: (?:{'|'.join(_OPENERS)}) )|{_MARK}| *$)"
#: Without any of these in the text, canonical and flowed texts are the same.
_MAY_HOLD = r"(?i)copyright|©|\(c\)|all[^a-z]+rights[^a-z]+reserved|c[^A-Za-z0-9]+[0-9]"


def flowed(text: Column) -> Column:
    """The canonical text with no regard to lines: only real notices go, wherever they stand, each up to the next one,
    the first words of a licence or the end of the text, 200 characters at most (else it stays)."""
    out = F.concat(F.lit(" "), F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[\\x00-/:-`{-\\x7f]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, f" {old} ", f" {new} ")
    out = F.regexp_replace(out, " (?:all rights reserved )+", " ")
    out = F.regexp_replace(out, _NOTICE, "")
    return F.trim(F.regexp_replace(out, " +", " "))


def _flow_digest(flow: Column) -> Column:
    """Digests of flowed texts can't be taken for those of canonical ones."""
    return F.when(flow != "", F.sha2(F.concat(F.lit("flowed "), flow), 256))


def canonical_sql(text: str) -> str:
    """The same as DuckDB SQL."""
    out = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    out = f"regexp_replace({out}, '(^|\\n)[ \\t#*/;-]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*', '\\1', 'g')"
    out = f"' ' || regexp_replace({out}, '[\\x00-/:-`{{-\\x7f]+', ' ', 'g') || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"


def known_licences(spark: SparkSession) -> DataFrame:
    """license_id and digest of the built-in texts, canonical and flowed; one row a digest."""
    texts = spark.createDataFrame(known_texts(), "license_id string, body string")
    digests = F.array(F.sha2(canonical(F.col("body")), 256), _flow_digest(flowed(F.col("body"))))
    return texts.select("license_id", F.explode(digests).alias("digest")).where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, digest (SHA-256 of the canonical text) and license_id (null where the entire text is none of
    ``known``: license_id, digest). A text is looked up by its canonical digest, and if that is unknown by that of its
    flowed form, which no wrapping of lines changes. A null text is empty and no licence; a text without letters or
    digits is none. Only digests are joined: texts don't move. Rows that repeat stay, further columns are ignored; if a
    digest has several names the smallest counts. A list of known texts of up to common.SMALL_ROWS digests is broadcast,
    a longer one is hash-joined."""
    names = common.small(known.where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), canonical(text).alias("body"))
    flow = F.when(F.col("text").rlike(_MAY_HOLD), flowed(F.col("text"))).otherwise(F.col("body"))
    rows = rows.select("doc_id", F.sha2("body", 256).alias("digest"), (F.col("body") == "").alias("empty"), _flow_digest(flow).alias("flow"))
    joined = rows.join(names, "digest", "left").join(names.select(F.col("digest").alias("flow"), F.col("license_id").alias("flow_id")), "flow", "left")
    return joined.select("doc_id", "digest", F.coalesce(F.when(~F.col("empty"), F.col("license_id")), F.col("flow_id")).alias("license_id"))


def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the built-in licence texts; see :func:`scan`."""
    return scan(common.corpus(spark, sf_dir), known_licences(spark))


def oracle() -> str:
    quoted = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in sorted(KNOWN.items()))
    return f"""
with known as (select min(license_id) as license_id, digest from (select license_id, sha256({canonical_sql("body")}) as digest from (values {quoted}) as t(license_id, body)) group by digest),
docs as (select doc_id, {canonical_sql("coalesce(text, '')")} as body from documents)
select doc_id, sha256(body) as digest, case when body <> '' then license_id end as license_id
from docs left join known on sha256(body) = digest"""
