"""Bottom-k sketches of word shingles: resemblance, containment and distinct counts from a short string."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

WORDS, K = 5, 128
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of all shingles of ``words`` words (ASCII letters lower-cased, split at ASCII white space), with
    repeats. A text of fewer words, but not none, is one shingle."""
    own = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not own:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    n = min(words, len(own))
    total = np.full(len(own) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total = (total ^ hashes[i : len(own) - n + 1 + i]) * (_ODD[i % len(_ODD)] + np.uint64(2 * (i // len(_ODD))))
    return _mixed(total)


class Sketch:
    """The ``k`` smallest distinct hashes; ``whole`` if there are no others."""

    __slots__ = ("hashes", "k", "whole")

    def __init__(self, hashes: np.ndarray, k: int = K, whole: bool = True):
        least = np.unique(hashes)
        self.hashes, self.k, self.whole = least[:k], k, whole and len(least) <= k

    @classmethod
    def of(cls, text: str | None, k: int = K) -> Sketch:
        return cls(shingle_hashes(text), k)

    def __str__(self) -> str:
        return f"bk{self.k}{'=' if self.whole else '+'}{base64.b64encode(self.hashes.astype('<u8').tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Sketch:
        k, sign, body = re.fullmatch(r"bk(\d+)([=+])(.*)", text).groups()
        return cls(np.frombuffer(base64.b64decode(body), dtype="<u8"), int(k), sign == "=")

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both parts' shingles together."""
        return Sketch(np.concatenate([self.hashes, other.hashes]), min(self.k, other.k), self.whole and other.whole)

    def distinct(self) -> float:
        """About how many distinct shingles there are; exact while the sketch holds all."""
        return float(len(self.hashes)) if self.whole else (self.k - 1) / (float(self.hashes[-1]) / 2.0**64)

    def resemblance(self, other: Sketch) -> float:
        """About |A and B| / |A or B|. Two empty sketches are alike, an empty and another are not."""
        both = self.merge(other)
        if not len(both.hashes):
            return 1.0
        shared = np.intersect1d(self.hashes, other.hashes, assume_unique=True)
        return float(np.isin(both.hashes, shared, assume_unique=True).sum() / len(both.hashes))

    def containment(self, other: Sketch) -> float:
        """About the share of this sketch's shingles that the other has too."""
        if not len(self.hashes):
            return 1.0
        return min(1.0, self.resemblance(other) * self.merge(other).distinct() / self.distinct())


def merged(sketches: DataFrame, by: list[str], sketch_col: str = "fingerprint", held: int = 20_000) -> DataFrame:
    """One sketch a group from the sketches of its parts. Tasks merge what they have first, ``held`` groups at a time, so
    a hot group costs few sketches a task; then a group's rows come together and in a row, and one group is merged at a
    time, however many there are. A null sketch is a part without shingles; a null key is a group of its own; no row
    gives no row."""
    schema = sketches.select(*by, sketch_col).schema
    names = [*by, sketch_col]

    def pairs(batches):
        for *key, text in common.rows_of(batches, *names):
            yield tuple(key), None if text is None else Sketch.parse(text)

    def joined(a: Sketch | None, b: Sketch | None) -> Sketch | None:
        return a if b is None else b if a is None else a.merge(b)

    def partly(batches):
        arrow = to_arrow_schema(schema)
        own: dict[tuple, Sketch | None] = {}
        for key, sketch in pairs(batches):
            own[key] = joined(own.get(key), sketch)
            if len(own) >= held:
                yield from _batch(own.items(), arrow)
                own = {}
        yield from _batch(own.items(), arrow)

    def wholly(batches):
        arrow = to_arrow_schema(schema)
        done: list[tuple] = []
        last: tuple | None = None
        sketch = None
        for key, part in pairs(batches):
            if key != last:
                if last is not None:
                    done.append((last, sketch or Sketch.of(None)))
                    if len(done) >= 2000:
                        yield from _batch(done, arrow)
                        done = []
                last, sketch = key, None
            sketch = joined(sketch, part)
        if last is not None:
            done.append((last, sketch or Sketch.of(None)))
        yield from _batch(done, arrow)

    part = sketches.select(*names).mapInArrow(partly, schema)
    return part.repartition(*by).sortWithinPartitions(*by).mapInArrow(wholly, schema)


def _batch(rows, schema: pa.Schema):
    columns = list(zip(*[(*key, None if s is None else str(s)) for key, s in rows], strict=True))
    if columns:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def with_next(docs: DataFrame, each_bytes: int = 32 << 20, most_parts: int = 100_000) -> DataFrame:
    """ctx, doc_id and text rows in ranges of (doc_id, hash of the text), the highest doc_id first, so that each row's
    successor is the next row of its own partition. The first row of each range is also put, marked ``ctx``, at the end
    of the range before it (that of the first range after the last one). Borders are those of a sample of rows, so an id
    (or null) that many texts share is parted too; only equal rows stay together. One shuffle of the texts. Ranges hold
    about ``each_bytes``, and more where there would be over ``most_parts``: they are sorted with spilling and gone
    through row by row, so memory doesn't grow with them. The driver holds a key a range and its sample, 400,000 keys or
    three a range."""
    spark = docs.sparkSession
    key = [F.bitwise_not("doc_id").alias("down"), F.xxhash64("text").alias("hash")]
    size = docs.agg(F.sum(F.length("text") + 64).alias("bytes"), F.count("*").alias("rows")).first()
    n = min(most_parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), common.pieces_for(size.bytes or 0, each_bytes)))
    share = min(1.0, n * max(3, min(20, 400_000 // n)) / max(1, size.rows))
    sample = sorted((r.down, r.hash) for r in docs.sample(share, seed=5).select(*key).collect())
    edges = sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []

    def ranges(down: pd.Series, hashes: pd.Series) -> list[int]:
        return [bisect.bisect_right(edges, x) for x in zip(down.tolist(), hashes.tolist(), strict=True)]

    @F.pandas_udf("int")
    def range_of(down: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(ranges(down, hashes), dtype="int32")

    firsts = docs.select(*key).withColumn("part", range_of("down", "hash")).groupBy("part").agg(F.min(F.struct("down", "hash")).alias("head"))
    heads = sorted((r.part, (r.head.down, r.head.hash)) for r in firsts.collect())
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def parts_of(down: pd.Series, hashes: pd.Series) -> pd.Series:
        own = zip(ranges(down, hashes), zip(down.tolist(), hashes.tolist(), strict=True), strict=True)
        return pd.Series([[p, -1 - before[x]] if x in before else [p] for p, x in own])

    dealt = docs.select("doc_id", "text", *key).withColumn("to", F.explode(parts_of("down", "hash")))
    dealt = dealt.select(F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("part"), (F.col("to") < 0).alias("ctx"), "doc_id", "text", "hash")
    return dealt.repartitionById(max(1, len(edges) + 1), F.col("part")).sortWithinPartitions(F.col("ctx"), F.col("doc_id").desc(), F.col("hash")).drop("hash", "part")


def compare_edited(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_shingles
    (the sketch's own estimate). The edited text has its last floor(n_chars/2) code points replaced by the first as many
    (or all) of the next row's text, from the highest doc_id down, after the last the first; rows with one doc_id follow
    each other in an order that depends on their texts alone. A null text is empty; a null doc_id comes last, as the
    lowest; one row alone is its own next. Further columns are ignored."""
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_shingles", pa.float64())]
    schema = pa.schema(fields)
    lowest = -(1 << 63)

    def run(batches):
        out, last = common.Rows(schema), None
        for ctx, doc_id, text in common.rows_of(batches, "ctx", "doc_id", "text"):
            sketch = Sketch.of(text, k)
            if last is not None and not last[0]:
                half = len(last[2]) // 2
                edited = last[2][: len(last[2]) - half] + text[:half]
                changed = Sketch.of(edited, k)
                row = (None if last[1] == lowest else last[1], len(last[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(last[3]), str(changed), last[3].resemblance(changed), last[3].resemblance(sketch), last[3].distinct())
                yield from out.add(row, 3000)
            last = (ctx, doc_id, text, sketch)
        yield from out.rest()

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"
    return with_next(rows).mapInArrow(run, ddl)


def op5_bottomk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts; see :func:`compare_edited`."""
    return compare_edited(common.corpus(spark, sf_dir))
