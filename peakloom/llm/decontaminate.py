"""Wu-Manber search of many word windows: shifts by word blocks skip places where no window can end."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words in a window, bytes of item text that one set of tables is made of, and windows in a piece of a long item.
WINDOW, BLOCK_BYTES, PIECE_WORDS = 8, 4 << 20, 5000
_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_TABLE = bytes(i if i in _WORD else 32 for i in bytes(range(256)).lower())


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words (ASCII letters, digits and all code points from 128 on) of UTF-8 text."""
    return text.translate(_TABLE).split() if text else []


class Tables:
    """Windows of one length: block -> shift, and of the blocks that end a window, those windows by their first words."""

    def __init__(self, length: int):
        self.m, self.b = length, min(3, length)
        self.shift: dict[tuple, int] = {}
        self.ends: dict[tuple, dict[tuple, dict[tuple, set]]] = {}

    def add(self, window: tuple, item) -> None:
        for q in range(self.b - 1, self.m):
            block = window[q - self.b + 1 : q + 1]
            self.shift[block] = min(self.shift.get(block, self.m), self.m - 1 - q)
        self.ends.setdefault(window[-self.b :], {}).setdefault(window[: self.b], {}).setdefault(window, set()).add(item)

    def search(self, words: list[bytes]):
        """(place, items) of each occurrence, by place."""
        m, b, shift, ends, skip, n = self.m, self.b, self.shift.get, self.ends, self.m - self.b + 1, len(words)
        i = m - 1
        while i < n:
            block = (words[i - 2], words[i - 1], words[i]) if b == 3 else tuple(words[i - b + 1 : i + 1])
            step = shift(block, skip)
            if step:
                i += step
                continue
            at = i - m + 1
            if bucket := ends[block].get(tuple(words[at : at + b])):
                if items := bucket.get(tuple(words[at : i + 1])):
                    yield at, items
            i += 1


def tables_of(items: list[tuple[object, bytes | None]], window: int = WINDOW) -> list[Tables]:
    """Tables by window length: ``window`` words, or all words of a shorter item. An item without words has none."""
    by_length: dict[int, Tables] = {}
    for item, text in items:
        words = words_of(text)
        if words:
            m = min(window, len(words))
            table = by_length.setdefault(m, Tables(m))
            for at in range(len(words) - m + 1):
                table.add(tuple(words[at : at + m]), item)
    return list(by_length.values())


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """item and body rows: the items' words, those of a long item in pieces of PIECE_WORDS that overlap by all but one
    word of a window, so that each window is in one piece. An item without an id or without words has none."""
    schema = pa.schema([("item", pa.int64()), ("body", pa.binary())])

    def run(batches):
        out = common.Rows(schema)
        for item, body in common.rows_of(batches, "item", "body"):
            words = words_of(body)
            for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                piece = b" ".join(words[at : at + PIECE_WORDS + window - 1])
                yield from out.add((item, piece), len(piece))
        yield from out.rest()

    named = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("body")).where("item is not null")
    return named.mapInArrow(run, "item long, body binary")


class _Blocks:
    """Item texts in blocks of about BLOCK_BYTES, dealt by hash. The bytes are counted first; the driver holds, and
    broadcasts, one block at a time, whatever the size of ``items`` or of one item."""

    def __init__(self, items: DataFrame, window: int, item_col: str, text_col: str):
        self.pieces = _pieces(items, window, item_col, text_col)
        total = self.pieces.agg(F.sum(F.length("body"))).first()[0] or 0
        self.n = common.pieces_for(total, BLOCK_BYTES)
        if self.n > 1:
            dealt = self.pieces.withColumn("block", F.pmod(F.xxhash64("item", "body"), F.lit(self.n)))
            self.pieces = common.stored(dealt.repartition("block").sortWithinPartitions("block"), "items")

    def __iter__(self):
        for block in range(self.n):
            chosen = self.pieces.where(F.col("block") == block) if self.n > 1 else self.pieces
            held = self.pieces.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.item, bytes(r.body)) for r in chosen.select("item", "body").collect()]))
            yield held
            held.unpersist()


_made: dict[tuple, list[Tables]] = {}


def _tables(block, window: int) -> list[Tables]:
    """The tables of a broadcast block; a worker process makes them once and keeps those of one block."""
    name, items = block.value
    if (name, window) not in _made:
        _made.clear()
        _made[name, window] = tables_of(items, window)
    return _made[name, window]


def _joined(batches):
    """Rows whose spans, those of several blocks one after the other, are put in order and merged."""
    for batch in batches:
        k = batch.schema.get_field_index("spans")
        spans = [[{"s": a, "e": b} for a, b in _merged([(x["s"], x["e"]) for x in own])] for own in batch.column(k).to_pylist()]
        yield batch.set_column(k, batch.schema.field(k), pa.array(spans, batch.column(k).type))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans (array of [from, to) word places inside any occurrence, merged) and
    items (those with an occurrence, sorted as numbers). One block of item texts is searched at a time; with more than
    one, each block's hits are written before the next one is taken up, and put together by row. Null texts have no
    words; rows that repeat, and null ids, stay as rows of their own; further columns are ignored; no row gives no row,
    and without items every row has no occurrence."""
    blocks = _Blocks(items, window, item_col, item_text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    if blocks.n > 1:
        source = common.stored(source.withColumn("row", F.monotonically_increasing_id()), "numbered")
    span = pa.struct([("s", pa.int32()), ("e", pa.int32())])
    found = [("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.int64()))]
    head = ", ".join(f"{f.name} long" for f in source.schema if f.name != "body")
    out = None
    for block in blocks:

        def run(batches, block=block):
            tables = _tables(block, window)
            for big in batches:
                for at in range(0, big.num_rows, 1024):
                    batch = big.slice(at, 1024)
                    counts, spans, hits = [], [], []
                    for body in batch.column(batch.schema.get_field_index("body")):
                        words = words_of(body.as_py())
                        own, which = [], set()
                        for table in tables:
                            for place, got in table.search(words):
                                which |= got
                                own.append((place, place + table.m))
                        counts.append(len(words))
                        spans.append([{"s": a, "e": b} for a, b in _merged(own)])
                        hits.append(sorted(which))
                    rest = [i for i, n in enumerate(batch.schema.names) if n != "body"]
                    made = [pa.array(c, t) for c, (_, t) in zip((counts, spans, hits), found, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + made, names=[batch.schema.names[i] for i in rest] + [n for n, _ in found])

        made = source.mapInArrow(run, f"{head}, n_words long, spans array<struct<s:int,e:int>>, items array<long>")
        if blocks.n > 1:  # every row from the first block, from others those with a hit
            made = common.stored(made if out is None else made.where(F.size("items") > 0), "hits")
        out = made if out is None else out.unionByName(made)
    if blocks.n > 1:
        firsts = [F.first(c).alias(c) for c in ("doc_id", "n_words")]
        out = out.groupBy("row").agg(*firsts, F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = out.mapInArrow(_joined, out.schema)
    return out.select("doc_id", "n_words", "spans", "items")


def without_occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of any item occurs. A block of item texts after
    the other takes its rows out; texts cross to Python once a block. Null and empty texts stay, as do rows that repeat
    and null ids; without items all rows stay."""
    at = docs.columns.index(text_col)
    blocks = _Blocks(items, window, item_col, item_text_col)
    for number, block in enumerate(blocks, 1):

        def run(batches, block=block):
            tables = _tables(block, window)
            for big in batches:
                for first in range(0, big.num_rows, 1024):
                    batch = big.slice(first, 1024)
                    free = []
                    for text in batch.column(at):
                        text = text.as_py()
                        words = words_of(text.encode("utf-8", "surrogatepass") if text else None)
                        free.append(not any(True for table in tables for _ in table.search(words)))
                    yield batch.filter(pa.array(free, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if number < blocks.n:
            docs = common.stored(docs, "left")
    return docs


def contamination(docs: DataFrame, items: DataFrame, least_items: int = 2, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (n_items >= ``least_items``)."""
    found = occurrences(docs, items, **options)
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x.e - x.s)).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents; see :func:`contamination`."""
    return contamination(common.corpus(spark, sf_dir), common.corpus(spark, sf_dir, "benchmark"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same result by comparing each window with each place; for tests."""
    out = []
    texts = {i: words_of(t.encode()) for i, t in items if i is not None and t}
    for doc_id, text in docs:
        words, hit, which = words_of(text.encode() if text else None), set(), set()
        for item, own in texts.items():
            m = min(window, len(own))
            for k in range(len(own) - m + 1 if own else 0):
                for at in range(len(words) - m + 1):
                    if words[at : at + m] == own[k : k + m]:
                        hit.update(range(at, at + m))
                        which.add(item)
        listed = ",".join(sorted(map(str, which)))
        out.append((doc_id, len(words), len(hit), len(which), hashlib.sha256(listed.encode()).hexdigest(), len(which) >= 2))
    return out
