"""Joins on tolerances, as equi-joins on bins with an exact residual condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the smaller side up to which it may be broadcast.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def range_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, tol: float, *, equi: Sequence[str] = (), strict: bool = True, how: str = "inner") -> DataFrame:
    """Pairs with |left_on - right_on| < tol (<= if not ``strict``) and equal ``equi`` columns. Bins are 2 * tol wide; a
    right row is put into its bin and both neighbours, a left row into its own, so a pair meets in one bin only. Skewed
    bins are split at runtime by adaptive execution."""
    width = 2 * tol if tol > 0 else 1.0
    own = left.withColumn("_bin", F.floor(F.col(left_on) / F.lit(width)))
    near = right.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(right_on) / F.lit(width)) + d)))
    step = F.abs(F.col(left_on) - F.col(right_on))
    condition = (step < tol) if strict else (step <= tol)
    keyed = own["_bin"] == near["_bin"]
    for c in equi:
        keyed = keyed & (own[c] == near[c])
    joined = own.join(near, keyed & condition, how)
    for c in ("_bin", *equi):
        joined = joined.drop(near[c])
    return joined.drop("_bin")


def nearest(left: DataFrame, right: DataFrame, left_id: str, left_on: str, right_on: str, right_id: str, *, equi: Sequence[str] = ()) -> DataFrame:
    """As-of nearest: adds the ``right_id`` of the row whose ``right_on`` is nearest (the earlier one, then the smaller
    id, on a tie); null where there is none. Both sides go into one stream by ``equi`` that is looked through once each
    way, so no pairs are made. ``left_id`` is a key of the left side."""
    hit = "struct<at:double,id:long>"
    a = left.select(*equi, F.col(left_on).cast("double").alias("_at"), F.col(left_id).alias("_key"), F.lit(None).cast(hit).alias("_hit"))
    b = right.select(*equi, F.col(right_on).cast("double").alias("_at"), F.struct(F.col(right_on).cast("double").alias("at"), F.col(right_id).cast("long").alias("id")).alias("_hit"))
    b = b.groupBy(*equi, "_at").agg(F.min("_hit").alias("_hit")).withColumn("_key", F.lit(None).cast(dict(left.dtypes)[left_id]))
    # both windows grow from their start: a frame that ends at the partition's end would be gone through again by each row
    before = lambda at: F.last("_hit", True).over(Window.partitionBy(*equi).orderBy(at, F.col("_hit").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    back, ahead = before(F.col("_at")), before(F.col("_at").desc())
    found = a.unionByName(b).withColumn("_back", back).withColumn("_ahead", ahead).where("_key is not null")
    pick = F.when(F.col("_ahead").isNull() | (F.col("_at") - F.col("_back.at") <= F.col("_ahead.at") - F.col("_at")), F.col("_back")).otherwise(F.col("_ahead"))
    hits = found.select(F.col("_key").alias(left_id), pick["id"].alias(right_id))
    return left.join(hits, left_id, "left")
