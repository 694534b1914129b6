"""Minimax contiguous partition of ordered atomic groups: the smallest capacity that the greedy check can meet."""

from __future__ import annotations

import bisect
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS = 8


class Stretches:
    """Sizes of groups in the order of their keys, as stretches of the order: (first key or its beginning, bytes, largest
    group, groups). What a cut may fall into is parted by ``refine``, the rest stays one number, so few stretches are
    held whatever the number of groups."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self._set(rows)

    def _set(self, rows: list[tuple[str, int, int, int]]) -> None:
        self.rows = sorted(rows)
        self.starts = [0, *accumulate(r[1] for r in self.rows)]
        self.total = self.starts[-1]

    def refine(self, wanted: set[int]) -> None:
        raise NotImplementedError

    def at(self, place: int) -> int:
        """The stretch that holds a place before the end."""
        return bisect.bisect_right(self.starts, place) - 1

    def reach(self, place: int, best: bool) -> int:
        """The last border between groups at or before ``place``: exact in a stretch of one group, else no later than
        ``place`` (``best``) and no earlier than the stretch."""
        if place >= self.total:
            return self.total
        i = self.at(place)
        return place if best and self.rows[i][3] > 1 else self.starts[i]


class Listed(Stretches):
    """A list of (key, size) in order; for small inputs and tests."""

    def __init__(self, groups: list[tuple[str, int]]):
        super().__init__([(k, s, s, 1) for k, s in groups])


class Ordered(Stretches):
    """Groups (key, bytes) of a table, whose keys are hexadecimal digests, by the first digits of these. A refinement is
    one job, which reads the parts of the table that hold the stretches in question, and adds two digits to them."""

    def __init__(self, groups: DataFrame, digits: int = 3):
        self.groups = groups
        super().__init__(self._sums(groups, digits))

    @staticmethod
    def _sums(groups: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
        sums = groups.groupBy(F.substring("key", 1, digits).alias("first")).agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"), F.count("*").alias("n"))
        return [(r["first"], r["bytes"], r["most"], r["n"]) for r in sums.collect()]

    def refine(self, wanted: set[int]) -> None:
        kept = [r for i, r in enumerate(self.rows) if i not in wanted]
        by_length: dict[int, list[str]] = {}
        for i in wanted:
            by_length.setdefault(len(self.rows[i][0]), []).append(self.rows[i][0])
        for digits, firsts in by_length.items():
            own = self.groups.where(F.substring("key", 1, digits).isin(firsts))
            # statistics of a table in the order of keys tell which parts of it to read
            own = own.where((F.col("key") >= min(firsts)) & (F.col("key") < max(firsts) + "g"))
            kept += self._sums(own, digits + 2)
        self._set(kept)


def greedy(sizes: Stretches, capacity: int, shards: int, start: int, end: int, best: bool) -> list[int] | None:
    """Places of the cuts between shards that each take groups while they fit; None if ``shards`` of them don't reach
    the end. ``best``: with every border that there might be; else with those alone that are known."""
    at, cuts = start, []
    for _ in range(shards):
        if at + capacity >= end:
            return cuts
        place = sizes.reach(at + capacity, best)
        if place <= at:
            return None
        cuts.append(place)
        at = place
    return None


def _least(sizes: Stretches, shards: int, start: int, end: int, best: bool) -> int:
    """The smallest capacity that the greedy check meets, by binary search from the mean and the largest group."""
    most = max(r[2] for r in sizes.rows[sizes.at(start) : sizes.at(end - 1) + 1])
    low, high = max(-(-(end - start) // shards), most) - 1, end - start
    while low + 1 < high:
        middle = (low + high) // 2
        if greedy(sizes, middle, shards, start, end, best) is None:
            low = middle
        else:
            high = middle
    return high


def minimax(sizes: Stretches, shards: int, start: int = 0, end: int | None = None) -> tuple[int, list[int]]:
    """(smallest capacity, places of the cuts) for the groups from ``start`` to ``end``, both borders between groups.
    The capacity is searched twice, with the borders that there might be and with those that are known; stretches that
    hold a cut of either, or of any capacity between, are refined until both agree."""
    end = sizes.total if end is None else end
    if end <= start:
        return 0, []
    while True:
        low, high = _least(sizes, shards, start, end, True), _least(sizes, shards, start, end, False)
        wanted: set[int] = set()
        early = late = start
        for _ in range(shards - 1):
            early = max(early, sizes.reach(min(early + low, end), False))
            late = sizes.reach(min(late + high, end), True)
            if early < end:
                wanted |= {i for i in range(sizes.at(early), sizes.at(min(late, end - 1)) + 1) if sizes.rows[i][3] > 1}
        if not wanted:
            return high, greedy(sizes, high, shards, start, end, False)
        # large ones first: what they hide can keep the known borders from getting on, and would make all others wanted
        large = {i for i in wanted if sizes.rows[i][1] > low / 64}
        sizes.refine(large or wanted)


def _cuts(sizes: Stretches, shards: int, start: int, end: int) -> list[int]:
    capacity, cuts = minimax(sizes, shards, start, end)
    borders = [start, *cuts, end]
    for a, b in zip(borders, borders[1:], strict=False):
        # the group that sets the capacity, if one does, ends the shard that it is in or is all of it
        i = sizes.at(b - 1)
        if shards < 2 or sizes.rows[i][3] > 1 or sizes.rows[i][1] < capacity:
            continue
        first, left, right = sizes.starts[i], sizes.starts[i] - start, end - b
        mean = lambda n: max(left / n if n else left * shards, right / (shards - 1 - n) if shards - 1 - n else right * shards)  # noqa: B023, E731
        n = min(range(shards), key=mean)
        if (left and not n) or (right and n == shards - 1):
            continue
        if left and minimax(sizes, n, start, first)[0] > capacity or right and minimax(sizes, shards - 1 - n, b, end)[0] > capacity:
            continue
        out = [*_cuts(sizes, n, start, first), first] if left else []
        return out + ([b, *_cuts(sizes, shards - 1 - n, b, end)] if right else [])
    return cuts


def balanced(sizes: Stretches, shards: int) -> list[str]:
    """Keys that shards begin with, of a partition whose largest shard is as small as can be. Where that is one group by
    itself, the groups before and after it are cut again among the other shards, by the same rule, as long as none of
    these gets larger than that; so a hot group leaves the rest even."""
    if not sizes.total:
        return []
    return [sizes.rows[sizes.at(place)][0] for place in _cuts(sizes, shards, 0, sizes.total)]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes and 1), text_crc32, law ``bytes``, shard, slot (gapless in its shard) and
    grown_shard (null). Equal texts are one group, null and empty texts too; groups are in the order of the MD5 of
    their text, and each shard is a stretch of that order. Sizes are summed up by group before the shuffle, so a hot
    group costs a row a task. Slots come from two passes: each row's place among its task's rows of the shard, and the
    sums of the tasks before. Texts are read twice and never shuffled."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("key"))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = common.stored(groups.repartitionByRange("key").sortWithinPartitions("key"), "groups")
    cuts = balanced(Ordered(groups), shards)
    number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    fields = [("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("shard", pa.int32())]
    schema = pa.schema(fields)

    def run(batches):
        part, seen, out = TaskContext.get().partitionId(), {}, common.Rows(schema)
        for doc_id, size, crc, own in common.rows_of(batches, "doc_id", "size", "text_crc32", "shard"):
            place = seen.get(own, 0)
            seen[own] = place + 1
            yield from out.add((part, place, doc_id, size, crc, own), 48)
        yield from out.rest()

    dealt = rows.select("doc_id", "size", "text_crc32", number.cast("int").alias("shard"))
    dealt = common.stored(dealt.mapInArrow(run, "part int, place long, doc_id long, size long, text_crc32 long, shard int"), "dealt")
    totals = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offsets = common.small(common.running_offsets(totals, ["shard", "part"], "n", within=["shard"]))
    placed = dealt.join(offsets, ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes; see :func:`shard`."""
    return shard(common.corpus(spark, sf_dir))
