"""Shared plumbing: reading the corpus, durable intermediate tables, bounded Arrow output and global offsets."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a per-partition table that may be broadcast; beyond it a shuffled join is used.
SMALL_ROWS = 500_000
#: Bytes of output that a Python kernel gathers before it hands a batch on.
FLUSH_BYTES = 8 << 20

_tables: list[tuple[SparkSession, str]] = []


#: Bytes of rows that cross to a Python worker at a time: a batch is held by the JVM, on the wire and by the worker.
ARROW_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower this session's limit of Arrow batches, which Spark has at 64 MB, to ARROW_BYTES. Long texts fill a batch
    long before its limit of 10,000 rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name, "67108864b")).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(name, f"{ARROW_BYTES}b")


def corpus(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """The named input table; every row of it."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset (tests, one machine) a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="peakloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: later stages survive lost executors and
    see one fixed version of values that depend on the partitioning. A table at a given ``path`` is the caller's."""
    spark = df.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _tables.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Delete the intermediate tables of this process. Call it once the results have been written."""
    while _tables:
        spark, path = _tables.pop()
        try:
            if spark.sparkContext._jsc is None:
                continue
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended
            continue


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches, a few hundred at a time as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


class Rows:
    """Gathers rows for a schema; ``add`` returns a batch when enough bytes have come together, ``rest`` the others."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 64) -> list[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        return self.rest() if self.bytes >= FLUSH_BYTES or len(self.rows) >= 20_000 else []

    def rest(self) -> list[pa.RecordBatch]:
        if not self.rows:
            return []
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
        self.rows, self.bytes = [], 0
        return [pa.RecordBatch.from_arrays(columns, schema=self.schema)]


def mapped(df: DataFrame, kernel: Callable[[tuple], Sequence[tuple[tuple, int]]], names: Sequence[str], schema: pa.Schema, ddl: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """Rows that ``kernel(state, row)`` makes of each row; ``setup`` makes the state once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state = Rows(schema), setup() if setup else None
        for row in rows_of(batches, *names):
            for made, size in kernel(state, row):
                yield from out.add(made, size)
        yield from out.rest()

    return df.select(*names).mapInArrow(run, ddl)


def running_offsets(totals: DataFrame, key: Sequence[str], value: str, within: Sequence[str] = ()) -> DataFrame:
    """Second pass of a distributed prefix sum: for the totals of each partition (one row per task, so bounded by the
    number of tasks and not by the data) the sum of those before it. Columns: key..., ``before``."""
    spark = totals.sparkSession
    seen: dict[tuple, int] = {}
    out = []
    for row in sorted(totals.select(*within, *[k for k in key if k not in within], value).collect(), key=lambda r: tuple(r[k] for k in [*within, *key])):
        group = tuple(row[k] for k in within)
        out.append((*[row[k] for k in key], seen.get(group, 0)))
        seen[group] = seen.get(group, 0) + row[value]
    kinds = dict(totals.dtypes)
    return spark.createDataFrame(out, ", ".join(f"{k} {kinds[k]}" for k in key) + ", before long")


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint for a local table of at most ``limit`` rows; beyond that the planner shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def pieces_for(total_bytes: float, each: int = 32 << 20, least: int = 1) -> int:
    return max(least, math.ceil(total_bytes / each))
