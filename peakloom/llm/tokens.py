"""Token ids of whole texts with a public tokenizer file: texts are cut into pieces that the tokenizer never merges
across, many texts at a time. The distinct words among them are merged together, as columns of one table; any other
distinct piece is encoded once and kept in a bounded cache.

The tokenizer drops white space, makes capitals small and takes letters, digits and marks apart, so the ids of a text
are those of its runs of one kind. That is shown on probes; files for which it doesn't hold encode texts whole.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Kinds of lower-case Latin-1 characters: white space, letter, mark, digit, other (apostrophes too: they begin endings).
_SPACE, _LETTER, _MARK, _DIGIT, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_KIND[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = _MARK
_KIND[[*b"0123456789"]] = _DIGIT
_KIND[[*b" \t\n\r"]] = _SPACE
#: Whether a piece begins at a character of kind b after one of kind a, at 8 * a + b.
_BEGINS = np.array([b < 5 and b != _SPACE and (a == _SPACE or (a != b and _OTHER not in (a, b))) for a in range(8) for b in range(8)])
#: Characters of texts that are encoded at a time.
TOGETHER = 2_000_000
#: Printable stand-ins of bytes, as byte-level vocabularies have them.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_caches: dict[str, ChunkIds] = {}


def shared(path: str) -> ChunkIds:
    """The worker process's own cache for a file; later tasks of the process find it filled."""
    if path not in _caches:
        _caches[path] = ChunkIds(path)
    return _caches[path]


class _Kept(dict):
    """key -> made(key), in two generations of at most ``limit`` short keys each."""

    def __init__(self, made: Callable, limit: int):
        super().__init__()
        self.made, self.limit, self.old = made, limit, {}

    def __missing__(self, key: str | bytes) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.made(key)
        if len(key) <= 40:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Merges:
    """The merges of a byte-pair model, applied to many short words at once: words are columns of a table of symbols, and
    each step merges in every column the leftmost pair of the lowest rank, until no column has a pair to merge."""

    #: Bytes of the longest word, and words of one table.
    LONGEST, TABLE = 40, 1 << 14
    #: Key of no merge; else 64 * rank + row, whose least in a column is the next merge.
    NONE = np.iinfo(np.int32).max

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in merges)}
        self.none = max(vocab.values()) + 1  # a symbol without merges
        self.made = np.zeros(len(merges) + 1, np.int32)
        self.base = np.array([vocab[_BYTES[b]] for b in range(256)] + [vocab[_BYTES[b] + suffix] for b in range(256)], np.int32)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << self.bits, -1, np.int64)
        left, right = np.array(list(pairs), np.uint64).reshape(-1, 2).T
        ranks, made = np.array(list(pairs.values()), np.int64).reshape(-1, 2).T
        self.made[ranks] = made
        keys = left << np.uint64(32) | right
        slots = self.slots(keys)
        while len(keys):  # a pair whose slot is taken goes to the next one
            free = self.ranks[slots] < 0
            _, first = np.unique(slots[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], ranks[put]
            keys, ranks, slots = np.delete(keys, put), np.delete(ranks, put), (np.delete(slots, put) + 1) % len(self.keys)
        self.first = self.key(np.repeat(self.base, 512), np.tile(self.base, 512), np.int64(0))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def key(self, left: np.ndarray, right: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Keys of pairs of symbols whose left one is in a row."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slots = self.slots(keys)
        rank = self.ranks[slots]
        strange = np.flatnonzero(self.keys[slots] != keys)
        other = strange[rank[strange] >= 0]
        rank[strange] = -1
        while len(other):
            slots[other] = (slots[other] + 1) % len(self.keys)
            here = self.keys[slots[other]] == keys[other]
            rank[other[here]] = self.ranks[slots[other[here]]]
            other = other[~here & (self.ranks[slots[other]] >= 0)]
        return np.where(rank >= 0, (rank << 6) + row, self.NONE).astype(np.int32)

    def of(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each of ``lengths`` (1 to LONGEST) bytes of ``data`` from ``starts`` on -> the ids of all words in
        turn, and how many each has."""
        order = np.argsort(lengths, kind="stable")
        counts, parts = np.zeros(len(order), np.int64), []
        for at in range(0, len(order), self.TABLE):
            own = order[at : at + self.TABLE]
            ids, counts[own] = self.table(data, starts[own], lengths[own])
            parts.append(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        first = np.zeros(len(order), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return flat[_spread(first, counts)].astype("<u4"), counts

    def table(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, rows = len(starts), int(lengths.max())
        row, beyond = np.arange(rows)[:, None], np.int32(rows * words)
        at = np.minimum(starts + row, len(data) - 1)
        code = data[at].astype(np.int32)
        code[lengths - 1, np.arange(words)] += 256
        # one more row stands for what is before and after a word
        symbols = np.full((rows + 1) * words, self.none, np.int32)
        symbols[:beyond] = np.where(row < lengths, self.base[code], -1).ravel()
        keys = np.full((rows + 1, words), self.NONE, np.int32)
        pair = self.first[(code[:-1] << 9) + code[1:]]
        keys[: rows - 1] = np.where((row[1:] < lengths) & (pair != self.NONE), pair + row[:-1].astype(np.int32), self.NONE)
        place = np.arange((rows + 1) * words, dtype=np.int32)
        after, before = place + np.int32(words), place - np.int32(words)
        before[:words] = beyond
        after[(lengths - 1) * words + np.arange(words)] = beyond
        flat = keys.ravel()
        while True:
            least = keys[:rows].min(axis=0)
            word = np.flatnonzero(least < self.NONE)
            if not len(word):
                break
            least = least[word]
            here = (least & 63) * words + word
            made = self.made[least >> 6]
            gone = after[here]
            then, prior = after[gone], before[here]
            symbols[here], symbols[gone], flat[gone] = made, -1, self.NONE
            after[here], before[then] = then, here
            new = self.key(np.concatenate([made, symbols[prior]]), np.concatenate([symbols[then], made]), np.concatenate([least & 63, prior // words]))
            flat[here], flat[prior] = new[: len(word)], new[len(word) :]
        found = symbols[:beyond].reshape(rows, words).T
        kept = found >= 0
        return found[kept], kept.sum(axis=1)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start, ``lengths`` many."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _merges(tokenizer) -> Merges | None:
    """The merges of a file whose words are merged byte by byte and by nothing else; else None."""
    model = json.loads(tokenizer.to_str())["model"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
        return None
    suffix = model.get("end_of_word_suffix") or ""
    if any(c + end not in model["vocab"] for c in _BYTES.values() for end in ("", suffix)):
        return None
    return Merges(model["vocab"], model["merges"], suffix)


class ChunkIds:
    """Ids of texts as little-endian unsigned 32-bit bytes, through caches of pieces of at most ``limit`` keys a
    generation."""

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_chunk = _splits_at_space(self.tokenizer)
        kinds = self.encode("ab.,12cd(e)f3") == b"".join(map(self.encode, ("ab", ".,", "12", "cd", "(", "e", ")", "f", "3")))
        self.by_word = self.by_chunk and kinds and all(self.bare(w.lower()) == self.encode(w) for w in ("Word", "theing", "É", "straße", "ÖÄÜñ", "çeuxeau", "a", "ÿø", "zzyqxw"))
        self.merges = _merges(self.tokenizer) if self.by_word else None
        self.pieces = _Kept(self.piece, limit)
        self.chunks = _Kept(self.encode, limit // 2)

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def bare(self, word: str) -> bytes:
        """A lower-case word of Latin letters, by the model alone: normal forms and splits can't change it."""
        if not word.isascii():
            word = "".join(map(_BYTES.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def piece(self, piece: bytes) -> bytes:
        text = piece.decode("latin-1")
        return self.bare(text) if text.isalpha() else self.encode(text)

    def of(self, text: str | None) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts; none for null and empty ones."""
        latin = [self.by_word and bool(t) and _is_latin(t) for t in texts]
        made = iter(self.latin([t for t, own in zip(texts, latin, strict=True) if own]))
        return [next(made) if own else self.other(t) for t, own in zip(texts, latin, strict=True)]

    def other(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk:
            return self.encode(text)
        return b"".join([self.chunks[c] for c in text.replace("\n", " ").split(" ") if c])

    def latin(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        lower = [t.lower().encode("latin-1") for t in texts]
        data = np.frombuffer(b" " + b" ".join(lower), dtype=np.uint8)
        kinds = _KIND[data]
        begins = np.flatnonzero(_BEGINS[(kinds[:-1] << 3) | kinds[1:]])
        solid = kinds[1:] != _SPACE
        place = np.cumsum(solid, dtype=np.int32)
        starts = np.append(place[begins] - 1, place[-1]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(starts), pa.py_buffer(data[1:][solid])]).dictionary_encode()
        flat, first, counts = self.distinct(pieces.dictionary)
        which = pieces.indices.to_numpy()
        own = counts[which]
        ends = np.cumsum(own)
        ids = flat[_spread(first[which], own)]
        upto = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in lower]) - 1)
        cuts = np.concatenate([[0], ends])[upto].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *cuts], cuts, strict=False)]


    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, where those of each begin, and how many it has. Words of letters alone are merged together."""
        n = len(pieces)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, ends, data = pieces.buffers()
        ends = np.frombuffer(ends, np.int32, n + 1).astype(np.int64)
        data = np.frombuffer(data, np.uint8, int(ends[-1]))
        starts, ends = ends[:-1], ends[1:]
        # a Latin letter beyond ASCII has two bytes, of which 0xC3 is the first
        wide = data >= 0x80
        shift = np.concatenate([[0], np.cumsum(wide)])
        lengths = ends - starts + shift[ends] - shift[starts]
        word = np.add.reduceat(_KIND[data] != _LETTER, starts, dtype=np.int64) == 0
        word &= (lengths <= Merges.LONGEST) & (self.merges is not None)
        counts, own, rest = np.zeros(n, np.int64), np.flatnonzero(word), np.flatnonzero(~word)
        parts = [np.zeros(0, "<u4")]
        if len(own):
            spelled = np.repeat(data, 1 + wide)
            second = np.flatnonzero(wide) + shift[1:][wide]
            spelled[second - 1] = 0xC3
            spelled[second] -= 0x40
            ids, counts[own] = self.merges.of(spelled, starts[own] + shift[starts[own]], lengths[own])
            parts.append(ids)
        if len(rest):
            raw = data.tobytes()
            made = [self.pieces[raw[a:b]] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            counts[rest] = np.fromiter(map(len, made), np.int64, len(made)) // 4
            parts.append(np.frombuffer(b"".join(made), "<u4"))
        order, first = np.concatenate([own, rest]), np.zeros(n, np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(parts), first, counts


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of the rows of Arrow batches (doc_id, text), encoded TOGETHER characters at a time."""
    from . import common

    cache, ids, texts, size = shared(path), [], [], 0
    for doc_id, text in common.rows_of(batches, "doc_id", "text"):
        ids.append(doc_id)
        texts.append(text)
        size += len(text or "")
        if size >= TOGETHER or len(ids) >= 10_000:
            yield from zip(ids, cache.many(texts), strict=True)
            ids, texts, size = [], [], 0
    yield from zip(ids, cache.many(texts), strict=True)


def _is_latin(text: str) -> bool:
    """Whether all code points are below 256, so that small letters don't depend on their neighbours and combining marks
    are out, and no special token can occur."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


def _splits_at_space(tokenizer) -> bool:
    """Whether chunks can be encoded on their own: shown on a probe that mixes marks, case, accents and specials."""
    probe = "It's a étude,\nİstanbul <|endoftext|>x 12ab ÉTÉ don't ... ́x"
    whole = tokenizer.encode(probe, add_special_tokens=False).ids
    parts = [i for c in probe.replace("\n", " ").split(" ") if c for i in tokenizer.encode(c, add_special_tokens=False).ids]
    cased = [tokenizer.encode(w, add_special_tokens=False).ids for w in ("Word,", "word", ",")]
    return whole == parts and cased[0] == cased[1] + cased[2]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
