"""Near duplicates by min-max hashing: both ends of each permutation are kept, banded, and confirmed on full sets.

1. Every text's set of word shingles is reduced to a digest of the set and to band keys. Texts of one set are one class.
2. Classes that share a band key are candidates. Each first tries the most central of its partners (the one with the
   largest buckets), which is one comparison a class and joins most of a group of copies.
3. Where a bucket still holds several components, those outside its largest one are compared with all others of the
   bucket. Buckets with the same largest component mostly hold the same classes, so they are taken together where that
   is less work, and each class is sent once. Chunks of bounded size are dealt out over tasks.
So every pair of different texts that shares a band key is joined directly or through others whenever its sets are that
alike. Joins on keys that a large share of rows may have (buckets, centres, sets, components) are salted. Sets, links and
components stay distributed throughout; the driver sees counts only.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .fingerprints import _mixed, shingle_hashes

#: A band is the smallest and largest value under each of ROWS permutations. Two large sets of similarity 0.8 share none
#: of BANDS bands with probability (1 - 0.8 ** (2 * ROWS)) ** BANDS, five in a million. Both ends are drawn without
#: replacement, so small sets miss more often: 9 in a million with 20 shingles together, 16 with 10. Sets of up to
#: FEW_SHINGLES have keys of all their subsets without one shingle too, which finds all pairs of up to nine together.
WORDS, PERCENT, ROWS, BANDS, FEW_SHINGLES = 2, 80, 3, 40, 10
#: A chunk that a single task compares: shingles of eight bytes, and what a row counts beside its shingles.
CHUNK, ROW_WEIGHT = 32_000, 100
#: Rows of one join key from which it is salted; more where there would be over 10,000 such keys.
HOT_ROWS = 2000


def _multipliers(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_keys(hashes: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """``bands`` 64-bit keys of a non-empty set of distinct hashes."""
    a = _multipliers(2 * rows * bands).reshape(2, -1, 1)
    low, high = np.full(rows * bands, np.iinfo(np.uint64).max), np.zeros(rows * bands, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = (hashes[None, at : at + 2048] ^ a[1]) * a[0]
        low, high = np.minimum(low, part.min(axis=1)), np.maximum(high, part.max(axis=1))
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for values in (low, high):
        for column in values.reshape(bands, rows).T:
            key = _mixed(key ^ column) * np.uint64(0x9E3779B97F4A7C15)
    if len(hashes) <= FEW_SHINGLES:
        own = _mixed(hashes ^ np.uint64(0xD6E8FEB86659FD93))
        whole = own.sum(dtype=np.uint64)
        key = np.concatenate([key, np.unique(_mixed(np.concatenate([[whole], whole - own])))])
    return key.view(np.int64)


def alike(shared: int | np.ndarray, n_a: int | np.ndarray, n_b: int | np.ndarray, percent: int = PERCENT):
    return 100 * shared >= percent * (n_a + n_b - shared)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int = WORDS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, text_key, n (size of the set), set_key (digest of the set; null if empty) and bands. Narrow."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        out = common.Rows(schema)
        for doc_id, text_key, text in common.rows_of(batches, "doc_id", "text_key", "text"):
            own = np.unique(shingle_hashes(text, words))
            if len(own):
                yield from out.add((doc_id, text_key, len(own), _digest(own), band_keys(own, rows, bands)), 400)
            else:
                yield from out.add((doc_id, text_key, 0, None, None))
        yield from out.rest()

    return docs.mapInArrow(run, "doc_id long, text_key long, n long, set_key binary, bands array<long>")


def set_table(docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """node, n and set (the sorted hashes as bytes) of ``nodes`` (node, doc_id, text_key: a text of the class). Up to
    common.SMALL_ROWS nodes are broadcast; beyond that texts are shuffled."""
    chosen = common.small(nodes.select("node", F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")))
    found = docs.join(chosen, (F.col("text_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("node", "text")
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("set", pa.binary())])

    def run(batches):
        out = common.Rows(schema)
        for node, text in common.rows_of(batches, "node", "text"):
            own = np.unique(shingle_hashes(text, words))
            yield from out.add((node, len(own), own.tobytes()), own.nbytes)
        yield from out.rest()

    return found.mapInArrow(run, "node long, n long, set binary")


def spread(left: DataFrame, right: DataFrame, key: str, salt: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key``, of which ``right`` has one row each. Keys of over HOT_ROWS rows on the left (``counts``: key,
    rows) are parted by the hash of ``salt``, and their row on the right is repeated for each part. There are at most
    10,000 such keys, so their list may be broadcast."""
    counts = left.groupBy(key).agg(F.count("*").alias("rows")) if counts is None else counts.select(key, "rows")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    each = max(HOT_ROWS, total // 10_000)
    heavy = counts.where(F.col("rows") > each)
    if not heavy.limit(1).count():
        return left.join(right, key)
    heavy = F.broadcast(heavy.select(key, F.ceil(F.col("rows") / each).cast("int").alias("_copies")))
    copies = F.coalesce("_copies", F.lit(1))
    own = left.join(heavy, key, "left").withColumn("_turn", F.pmod(F.xxhash64(salt), copies).cast("int")).drop("_copies")
    other = right.join(heavy, key, "left").withColumn("_turn", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return own.join(other, [key, "_turn"]).drop("_turn")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are alike. ``b`` may be the same for many pairs."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("set").alias("set_a")), "a")
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("set_b"))
    both = spread(left, right, "b", "a", pairs.groupBy("b").agg(F.count("*").alias("rows")))
    both = both.where((100 * F.least("n_a", "n_b")) >= percent * F.greatest("n_a", "n_b")).select("a", "b", "set_a", "set_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        out = common.Rows(schema)
        for a, b, set_a, set_b in common.rows_of(batches, "a", "b", "set_a", "set_b"):
            x, y = np.frombuffer(set_a, np.uint64), np.frombuffer(set_b, np.uint64)
            if alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                yield from out.add((a, b), 16)
        yield from out.rest()

    return both.mapInArrow(run, "a long, b long")


class _Union(dict):
    def find(self, x):
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root:
            self[x] = root
            x = up
        return root


def links_within(rows: list[tuple[int, int, bool, bytes]], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between rows (node, label, main, set) of different labels, as far as they join labels not joined yet.
    Rows that are ``main`` aren't compared with each other. Exact: shared shingles are counted by an inverted index."""
    nodes = {r[0]: r for r in rows}
    rows = [nodes[k] for k in sorted(nodes)]
    if len({r[1] for r in rows}) < 2:
        return []
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(rows)), sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    posting = owner[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes))])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    labels, joined, out = [r[1] for r in rows], _Union(), []
    for i, row in enumerate(rows):
        if row[2]:
            continue
        own = codes[begins[i] : begins[i + 1]]
        lengths = starts[own + 1] - starts[own]
        places = np.repeat(starts[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        shared = np.bincount(posting[places], minlength=len(rows))
        for j in np.flatnonzero(alike(shared, sizes[i], sizes, percent)).tolist():
            x, y = joined.find(labels[i]), joined.find(labels[j])
            if x != y:
                joined[max(x, y)] = min(x, y)
                out.append((row[0], rows[j][0]))
    return out


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: the smallest node that ``links`` (a, b) lead to. Labels spread along links and then jump to their
    own labels, so a chain of n links takes about log n rounds; each round is written to the shared folder."""
    links = links.where("a <> b")
    links = common.stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = common.stored(nodes.select("node", F.col("node").alias("label")).join(links.select(F.col("a").alias("node")).distinct(), "node", "left_semi"), "labels")
    total = None
    while True:
        spread = links.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        least = labels.unionByName(spread).groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = common.stored(least.join(up, "label", "left").select("node", F.least("label", "further").alias("label")), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now


def _pieces(total: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / CHUNK)).cast("int")


def _weighed(rows: DataFrame, key: str) -> DataFrame:
    """Per key: n_main and n_rest, the chunks of its main rows and of the others, and the weight of all rows sent."""
    own = F.col("n") + ROW_WEIGHT
    sums = rows.groupBy(key).agg(F.sum(F.when(F.col("is_main"), own).otherwise(0)).alias("main_size"), F.sum(F.when(F.col("is_main"), 0).otherwise(own)).alias("rest_size"))
    sums = sums.withColumns({"n_main": _pieces(F.col("main_size")), "n_rest": _pieces(F.col("rest_size"))})
    sent = F.col("main_size") * F.col("n_rest") + F.col("rest_size") * (F.col("n_main") + F.col("n_rest"))
    return sums.select(key, "n_main", "n_rest", sent.cast("double").alias("sent"))


def unresolved(members: DataFrame, sets: DataFrame, several: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that members (key, node, n, label) of one bucket have across labels. ``several``: the rows of each
    bucket."""
    shares = members.groupBy("key", "label").agg(F.count("*").alias("rows"))
    mains = shares.groupBy("key").agg(F.max(F.struct("rows", "label"))["label"].alias("main"), F.count("*").alias("labels")).where("labels > 1").select("key", "main")
    torn = spread(members, mains, "key", "node", several).withColumn("is_main", F.col("label") == F.col("main"))
    torn = common.stored(torn, "torn")
    # a bucket by itself, or all buckets of one main component together: whichever sends less
    alone, joint = _weighed(torn, "key"), _weighed(torn.dropDuplicates(["main", "node"]), "main")
    by_main = mains.join(alone, "key").groupBy("main").agg(F.sum("sent").alias("alone")).join(joint, "main")
    by_main = by_main.select("main", F.when(F.col("sent") <= F.col("alone"), F.struct("n_main", "n_rest")).alias("joint"))
    by_main = common.stored(by_main, "by_main")
    kept = mains.join(alone, "key")
    plan = kept.join(F.broadcast(by_main), "main") if by_main.limit(common.SMALL_ROWS + 1).count() <= common.SMALL_ROWS else spread(kept, by_main, "main", "key")
    plan = common.stored(plan.select("key", F.col("joint").isNotNull().alias("together"), F.coalesce("joint", F.struct("n_main", "n_rest")).alias("parts")), "plan")
    rows = spread(torn, plan, "key", "node", several)
    # labels and keys are different numbers, so the pair names the group
    rows = rows.select(F.when(F.col("together"), F.col("main")).otherwise(F.col("key")).alias("group"), "together", "node", "label", "is_main", "parts.*").dropDuplicates(["group", "together", "node"])
    turn = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    last = lambda n: F.sequence(F.lit(0), n - 1)
    own_rest, own_main = turn(F.col("n_rest")), turn(F.col("n_main"))
    to_main = F.transform(last(F.col("n_rest")), lambda i: place(0, i, own_main))
    to_rest = F.concat(
        F.transform(last(F.col("n_main")), lambda j: place(0, own_rest, j)),
        F.when(F.col("n_rest") > 1, F.transform(last(F.col("n_rest")), lambda j: place(1, F.least(own_rest, j), F.greatest(own_rest, j)))).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int>>")),
    )
    dealt = rows.select("group", "together", "node", "label", "is_main", F.explode(F.when(F.col("is_main"), to_main).otherwise(to_rest)).alias("to"))
    dealt = dealt.select("node", "label", "is_main", F.xxhash64("group", "together", "to").alias("task")).join(sets.select("node", "set"), "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        out, task, own = common.Rows(schema), None, []
        for key, *row in common.rows_of(batches, "task", "node", "label", "is_main", "set"):
            if key != task:
                for link in links_within(own, percent):
                    yield from out.add(link, 16)
                task, own = key, []
            own.append(tuple(row))
        for link in links_within(own, percent):
            yield from out.add(link, 16)
        yield from out.rest()

    # a task's rows come together and in a row; each task holds two chunks at most
    ordered = dealt.repartition("task").sortWithinPartitions("task")
    return ordered.select("task", "node", "label", "is_main", "set").mapInArrow(run, "a long, b long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))


def grouped(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, text_key): doc_id, text_key, n, component_id (the smallest doc_id of its
    component) and chosen (whether the row is the one that stands for the component: that with the smallest doc_id, then
    text_key; nulls last). Rows that repeat one another are chosen together."""
    signed = common.stored(signatures(docs, words, rows, bands), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key"))
    classes = signed.where("n > 0").groupBy("set_key").agg(first.alias("own"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    classes = common.stored(classes.select("set_key", "own", "n", "bands", "rows", F.monotonically_increasing_id().alias("node")), "classes")
    keys = classes.select(F.explode("bands").alias("key"), "node", "n")
    several = common.stored(keys.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "several")
    members = common.stored(spread(keys, several, "key", "node", several).dropDuplicates(["key", "node"]), "members")
    nodes = common.stored(members.select("node").distinct().join(classes.select("node", "own.doc_id", "own.text_key"), "node"), "nodes")
    sets = common.stored(set_table(docs, nodes, words).dropDuplicates(["node"]), "sets")

    central = members.groupBy("node").agg(F.sum("rows").alias("weight"))
    weighted = members.select("key", "node").join(central, "node")
    centres = weighted.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("centre"))
    tries = spread(weighted.select("key", "node"), centres, "key", "node", several).groupBy("node").agg(F.max("centre").alias("centre"))
    tries = tries.select(F.col("node").alias("a"), (-F.col("centre.minus")).alias("b")).where("a <> b")
    first = common.stored(confirmed(common.stored(tries, "tries"), sets, percent), "first")
    labels = components(nodes, first)

    placed = common.stored(members.select("key", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    more = unresolved(placed, sets, several, percent)
    labels = components(nodes, first.unionByName(common.stored(more, "more")))

    named = common.stored(classes.select("set_key", "node", "own", "rows").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    least = named.groupBy("label").agg(F.min("own").alias("least"))
    named = common.stored(spread(named, least, "label", "node").select("set_key", "rows", "least"), "least")
    lone = signed.where("set_key is null").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("chosen"))
    # a row of a set that many rows share is salted by its id and text
    own = signed.where("set_key is not null").withColumn("salt", F.xxhash64("doc_id", "text_key"))
    linked = spread(own.select("doc_id", "text_key", "n", "set_key", "salt"), named.select("set_key", "least"), "set_key", "salt", named)
    chosen = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    return lone.unionByName(linked.select("doc_id", "text_key", "n", F.col("least.doc_id").alias("component_id"), chosen.alias("chosen")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_shingles (distinct word shingles of the lower-cased text; a shorter text is one), component_id
    (the smallest doc_id reachable over links of sets with 100 * shared >= ``percent`` * joint) and kept (doc_id is that
    id). Texts without words and null texts have no shingle and no link. Rows of equal sets are one class; rows that
    share a doc_id but differ in their texts are classes of their own. A null doc_id takes part like others, but names no
    component: with others' ids it isn't kept; a component without ids is null, and one of its texts is kept. Rows that
    repeat stay, further columns are ignored, and no row gives no row. ``options``: words, percent, rows, bands."""
    out = grouped(_keyed(docs, id_col, text_col), **options)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.when(F.col("component_id").isNull(), F.col("chosen")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component: that with the smallest doc_id (nulls last). Of
    rows that repeat it, text and id, one stays. Rows without words, null and empty texts too, all stay."""
    found = common.stored(grouped(_keyed(docs, "doc_id", "text"), **options), "found")
    ids = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n", "chosen")
    dropped = common.small(ids.where(~F.col("chosen")).select("_id", "_key").distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_key"))
    out = docs.join(dropped, same, "left_anti").select(docs.columns)
    repeated = ids.where("chosen and n > 0").groupBy("_id", "_key").count().where("count > 1").select("_id", "_key")
    if repeated.limit(1).count():
        again = common.small(repeated)
        once = out.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(again, same, "left_anti").unionByName(once).select(docs.columns)
    return out


def op9_minmax_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents; see :func:`near_duplicates`."""
    return near_duplicates(common.corpus(spark, sf_dir))


def brute_force(docs: list[tuple[int, str | None]], words: int = WORDS, percent: int = PERCENT) -> dict[int, tuple[int, int, bool]]:
    """doc_id -> (n_shingles, component_id, kept), from all pairs; for tests."""
    sets = {}
    for doc_id, text in docs:
        own = text.encode().lower().split() if text else []
        sets[doc_id] = {tuple(own[i : i + words]) for i in range(len(own) - words + 1)} or ({tuple(own)} if own else set())
    by_shingle = defaultdict(list)
    union = _Union()
    for i in sorted(sets):
        counts: dict[int, int] = defaultdict(int)
        for s in sets[i]:
            for j in by_shingle[s]:
                counts[j] += 1
            by_shingle[s].append(i)
        for j, shared in counts.items():
            if alike(shared, len(sets[i]), len(sets[j]), percent):
                x, y = union.find(i), union.find(j)
                union[max(x, y)] = min(x, y)
    return {i: (len(s), union.find(i), union.find(i) == i) for i, s in sets.items()}
