"""Re-Pair grammar compression of token ids, one grammar a shard, with expansion lengths for random access.

File format of a shard, little-endian, one blob:
  magic ``RPG1``; unsigned 32-bit: number of base symbols B, rules R, documents D, sequence symbols N, symbol width W
  (2 or 4); B base ids (u32); 2R rule symbols (W); R expansion lengths (u32); D sequence offsets (u32) and D token
  counts (u32); N sequence symbols (W).
Symbols below B stand for ids; B + r stands for rule r. No rule crosses the end of a document, so document d is the
sequence from its offset to the next one, and an id inside it is found by expansion lengths without expanding others.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

END_ID, SHARD_TOKENS, MAGIC = 1, 1 << 20, b"RPG1"


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each start, ``lengths`` many."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def _stretches(rules: np.ndarray, base: int):
    """(first, end) of stretches of rules, in turn, that refer only to symbols before their stretch."""
    reach = np.maximum.accumulate(rules.max(axis=1)) if len(rules) else np.zeros(0, np.int64)
    at = 0
    while at < len(rules):
        end = int(np.searchsorted(reach, base + at))
        if end <= at:
            raise ValueError("a rule refers to a later one")
        yield at, end
        at = end


def repair(seq: np.ndarray, last: np.ndarray, base: int, least: int = 5, a_round: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds: count all adjacent pairs, give each of the ``a_round`` most frequent a nonterminal, replace
    their occurrences from left to right, and again on the shorter sequence, until no pair occurs ``least`` times. A rule
    takes two symbols and four bytes of the file and saves a symbol an occurrence, so with symbols of two bytes it pays
    from five occurrences on. A pair that is rare once stays rare, and a new pair has a new symbol; so after the first
    round only places of frequent pairs and those beside a new symbol are counted. ``last`` marks symbols at the end of a
    document; no pair starts there. -> sequence, its marks, rules (R, 2)."""
    rules: list[np.ndarray] = []
    symbols, ends = base, np.flatnonzero(last)
    live = np.flatnonzero(~last[:-1])
    while len(live):
        width, bits = (np.uint32, 16) if symbols + a_round < 0xFFFF else (np.uint64, 32)
        pairs = seq[live].astype(width)
        pairs <<= width(bits)
        pairs |= seq[live + 1].astype(width)
        ordered = np.sort(pairs)
        edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
        counts, values = np.diff(edges), ordered[edges[:-1]]
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        frequent = values[often]
        if len(often) > a_round:
            often = often[np.argpartition(-counts[often], a_round - 1)[:a_round]]
        chosen = np.sort(values[often])
        # a small table by hash gives each pair's number; of two that share a slot one waits for the next round
        slot = lambda p: (p * width(2654435761) >> width(12)) & width(0xFFFFF)  # noqa: B023, E731
        table = np.zeros(1 << 20, dtype=np.uint16)
        table[slot(frequent)] = len(chosen) + 1  # frequent, but not in this round
        table[slot(chosen)] = np.arange(1, len(chosen) + 1)
        number = table[slot(pairs)]
        good = np.flatnonzero(number - np.uint16(1) < len(chosen))
        rank = number[good].astype(np.int32) - 1
        same = chosen[rank] == pairs[good]
        places, rank = live[good[same]], rank[same]
        # overlapping places form runs: every other one of a run is taken
        run_start = np.concatenate(([True], np.diff(places) > 1))[: len(places)]
        at = np.arange(len(places), dtype=np.int32)
        taken = (at - np.maximum.accumulate(np.where(run_start, at, np.int32(0)))) & 1 == 0
        places, rank = places[taken], rank[taken]
        worth = np.bincount(rank, minlength=len(chosen)) >= 2
        keep = worth[rank]
        places, rank = places[keep], rank[keep]
        if not len(places):
            break
        fresh = np.cumsum(worth) - 1
        made = chosen[worth]
        rules.append(np.stack([made >> width(bits), made & width((1 << bits) - 1)], axis=1).astype(np.uint32))
        gone = places + 1
        left = np.ones(len(seq), dtype=bool)
        left[gone] = False
        again = np.zeros(len(seq), dtype=bool)
        again[live[number > 0]] = True
        again[places] = True
        before = np.maximum(places - 1, 0)
        again[before - ~left[before]] = True  # the symbol before may be a new one too
        ends = ends - ~left[ends]
        again[ends] = again[gone] = False
        live, ends = np.flatnonzero(again[left]), ends - np.searchsorted(gone, ends)
        seq = seq.copy()
        seq[places] = symbols + fresh[rank]
        seq = seq[left]
        symbols += len(made)
    last = np.zeros(len(seq), dtype=bool)
    last[ends] = True
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)


def encode(docs: list[bytes], **options) -> bytes:
    """One shard of documents, each unsigned 32-bit ids with at least one id."""
    ids = np.frombuffer(b"".join(docs), dtype="<u4")
    counts = np.array([len(d) // 4 for d in docs], dtype=np.uint32)
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(counts, dtype=np.int64) - 1] = True
    present = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=bool)
    present[ids] = True
    alphabet = np.flatnonzero(present).astype("<u4")
    to_symbol = np.cumsum(present, dtype=np.uint32) - 1 if len(present) else np.zeros(0, np.uint32)
    seq, last, rules = repair(to_symbol[ids].astype(np.uint32), last, len(alphabet), **options)
    ends = np.flatnonzero(last) + 1
    offsets = np.concatenate(([0], ends[:-1])).astype("<u4") if len(docs) else np.zeros(0, "<u4")
    lengths = np.ones(len(alphabet) + len(rules), dtype="<u4")
    for a, b in _stretches(rules, len(alphabet)):
        lengths[len(alphabet) + a : len(alphabet) + b] = lengths[rules[a:b]].sum(axis=1)
    wide = 2 if len(alphabet) + len(rules) <= 0x10000 else 4
    kind = f"<u{wide}"
    head = struct.pack("<4s5I", MAGIC, len(alphabet), len(rules), len(docs), len(seq), wide)
    return b"".join([head, alphabet.tobytes(), rules.astype(kind).tobytes(), lengths[len(alphabet) :].tobytes(), offsets.tobytes(), counts.astype("<u4").tobytes(), seq.astype(kind).tobytes()])


class Shard:
    """A shard that has been read back."""

    def __init__(self, blob: bytes):
        magic, base, n_rules, n_docs, n, wide = struct.unpack_from("<4s5I", blob)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = 24

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(blob, dtype=kind, count=count, offset=at)
            at += got.nbytes
            return got

        self.alphabet = take(base, "<u4")
        self.rules = take(2 * n_rules, f"<u{wide}").reshape(-1, 2).astype(np.int64)
        self.lengths = np.concatenate([np.ones(base, dtype=np.int64), take(n_rules, "<u4").astype(np.int64)])
        self.offsets = take(n_docs, "<u4").astype(np.int64)
        self.counts = take(n_docs, "<u4").astype(np.int64)
        self.seq = take(n, f"<u{wide}").astype(np.int64)
        # all expansions one after another; rules refer to earlier symbols, stretch by stretch
        self.at = np.cumsum(self.lengths) - self.lengths
        self.flat = np.zeros(int(self.lengths.sum()), dtype=np.uint32)
        self.flat[self.at[:base]] = self.alphabet
        for first, end in _stretches(self.rules, base):
            own = np.arange(first, end)
            for side in (0, 1):
                part = self.rules[own, side]
                to = self.at[base + own] + (self.lengths[self.rules[own, 0]] if side else 0)
                self.flat[_ranges(to, self.lengths[part])] = self.flat[_ranges(self.at[part], self.lengths[part])]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[_ranges(self.at[symbols], self.lengths[symbols])]

    def document(self, d: int) -> np.ndarray:
        end = self.offsets[d + 1] if d + 1 < len(self.offsets) else len(self.seq)
        return self.expand(self.seq[self.offsets[d] : end])

    def id_at(self, d: int, place: int) -> int:
        """The id at a place of a document: expansion lengths lead down the rules."""
        end = self.offsets[d + 1] if d + 1 < len(self.offsets) else len(self.seq)
        own = self.seq[self.offsets[d] : end]
        ends = np.cumsum(self.lengths[own])
        k = int(np.searchsorted(ends, place, side="right"))
        symbol, place = int(own[k]), place - int(ends[k] - self.lengths[own[k]])
        while symbol >= len(self.alphabet):
            a, b = self.rules[symbol - len(self.alphabet)]
            symbol, place = (int(a), place) if place < self.lengths[a] else (int(b), place - int(self.lengths[a]))
        return int(self.alphabet[symbol])

    def documents(self):
        """Token bytes of each document, in order, from one expansion of a few megabytes at a time."""
        ends = np.concatenate([self.offsets[1:], [len(self.seq)]]) if len(self.offsets) else np.zeros(0, np.int64)
        d = 0
        while d < len(self.offsets):
            upto = max(d + 1, int(np.searchsorted(ends, self.offsets[d] + (1 << 18), side="right")))
            data = self.expand(self.seq[self.offsets[d] : ends[upto - 1]]).astype("<u4").tobytes()
            at = 0
            for k in range(d, upto):
                yield data[at : at + 4 * int(self.counts[k])]
                at += 4 * int(self.counts[k])
            d = upto


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text", out: str | None = None) -> DataFrame:
    """The ids of all rows, each with the end id, as shard files in ascending doc_id order (nulls first, equal ids by
    text): a table part, part_start (tokens of the task before the shard), n_tokens, doc_ids, blob, each blob a file of
    the format above. It is written to ``out``, which stays and which ``read_shards(spark.read.parquet(out))`` reads at
    any time, or else to the shared folder for the time of the session. One shuffle by ranges of doc_id and text; a
    shard ends once it has ``shard_tokens`` tokens. A null or empty text is the end id alone, rows that repeat stay,
    further columns are ignored, and no row gives no shard."""
    path = path or tokens.default_path()
    schema = pa.schema([("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("blob", pa.binary())])
    last = end_id.to_bytes(4, "little")

    def run(batches):
        part, at, own, size, names = TaskContext.get().partitionId(), 0, [], 0, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, at, size // 4, names, encode(own)), schema, strict=True)], schema=schema)

        for doc_id, ids in tokens.encoded(batches, path):
            ids += last
            own.append(ids)
            names.append(doc_id)
            size += len(ids)
            if size >= 4 * shard_tokens:
                yield done()
                at, own, size, names = at + size // 4, [], 0, []
        if own:
            yield done()

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = ordered.mapInArrow(run, "part int, part_start long, n_tokens long, doc_ids array<long>, blob binary")
    return common.stored(made, "shards", out)


def read_shards(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids
    (binary, unsigned 32-bit little-endian). A blob that isn't of the format is an error; no shard gives no row."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = common.small(common.running_offsets(totals, ["part"], "n"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches):
        out = common.Rows(schema)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                get = lambda n: row.column(row.schema.get_field_index(n))[0].as_py()  # noqa: B023, E731
                at = get("first")
                for doc_id, ids in zip(get("doc_ids"), Shard(get("blob")).documents(), strict=True):
                    yield from out.add((doc_id, at, len(ids) // 4, zlib.crc32(ids), *[ids] * with_ids), 32 + len(ids) * with_ids)
                    at += len(ids) // 4
        yield from out.rest()

    placed = shards.join(offsets, "part").select("doc_ids", "blob", (F.col("before") + F.col("part_start")).alias("first"))
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op6_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, compressed, written, read back and expanded; see :func:`write_shards`."""
    return read_shards(write_shards(common.corpus(spark, sf_dir)), with_ids=False)
