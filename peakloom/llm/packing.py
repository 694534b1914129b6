"""Concatenate and cut: one endless id stream, cut into windows of a fixed length."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

WINDOW, END_ID = 4096, 2


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass, without a shuffle: each row's ids with the end id, and their place in the task's own id stream.
    Columns: part, at, part_start, doc_id, n_tokens, ids. A null text has the end id alone; repeated rows are kept;
    no row gives no row; further columns are ignored."""
    schema = pa.schema([("part", pa.int32()), ("part_start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    last = end_id.to_bytes(4, "little")

    def run(batches):
        part, at, out = TaskContext.get().partitionId(), 0, common.Rows(schema)
        for doc_id, ids in tokens.encoded(batches, path):
            ids += last
            yield from out.add((part, at, doc_id, len(ids) // 4, ids), len(ids))
            at += len(ids) // 4
        yield from out.rest()

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "part int, part_start long, doc_id long, n_tokens long, ids binary")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``window``-long sequences over all rows of ``docs``. The stream is cut freely, so only the very last
    sequence has padding. Two passes: the ids and each task's total are written once, the totals (one row per task) are
    summed up to global offsets, then every row is cut at the multiples of ``window``; its pieces are the boundary
    records. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids (binary,
    unsigned 32-bit little-endian). Empty and null texts fill one place (their end id)."""
    made = common.stored(tokenised(docs, path or tokens.default_path(), end_id, id_col, text_col), "ids")
    totals = made.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = common.small(common.running_offsets(totals, ["part"], "n"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def cut(_, row):
        doc_id, ids, first = row
        n, at = len(ids) // 4, 0
        while at < n:
            sequence, offset = divmod(first + at, window)
            length = min(window - offset, n - at)
            piece = ids[4 * at : 4 * (at + length)]
            yield (doc_id, at, length, zlib.crc32(piece), n, sequence, offset, *[piece] * with_ids), 64 + len(piece) * with_ids
            at += length

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    placed = made.join(offsets, "part").select("doc_id", "ids", (F.col("before") + F.col("part_start")).alias("first"))
    return common.mapped(placed, cut, ["doc_id", "ids", "first"], schema, ddl)


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids; see :func:`pack`."""
    return pack(common.corpus(spark, sf_dir), with_ids=False)
