"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, packing.

Each stage is written as Parquet and read again as the next one's documents. Stages 1 to 4 return the columns of
documents, whatever these are. In all stages a null text counts as an empty one and stays null, rows without an id are
treated like others, and no row gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakloom.llm import common, decontaminate, nearduplicates, packing, pii, quality


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; it is trained on this stage's own rows. Null and empty texts are
    scored as texts without any character; rows that repeat go or stay alike; without labelled rows all stay."""
    return quality.keep_good(docs, quality.fit(docs, common.corpus(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more. Of rows that repeat one
    stays; null and empty texts, and texts without words, are in no group and all stay."""
    common.small_batches(spark)
    return nearduplicates.keep_one(docs, words=5)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of eight words (or a whole shorter item) of a benchmark item. Null and empty texts
    stay, items without words or an id take nothing out, rows that repeat go or stay alike."""
    return decontaminate.without_occurrences(docs, common.corpus(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data, plain or disguised, replaced by the name of its kind. Null and empty texts stay
    as they are, and so do rows that repeat."""
    common.small_batches(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 ids, with the ids. A null or empty text is its end id alone; rows that
    repeat are packed each."""
    common.small_batches(spark)
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", no_benchmark), ("personal_data", no_personal_data), ("packing", packed)]

#: A trained classifier, near-duplicate components and a tokenizer are beyond SQL; the stages are tested by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.corpus(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
