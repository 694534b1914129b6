"""Packing and the grammar files: exact ids of the tokenizer, gapless places, exact round trips."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import grammar, packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_cache_gives_the_tokenizers_ids(tokenizer, documents):
    cache = tokens.ChunkIds(tokens.default_path(), limit=50)  # small, so that it is emptied often
    assert cache.by_chunk and cache.by_word
    more = ["It's İ ẞ ﬁ <|endoftext|> a<|startoftext|>b don't 12ab3 é́ ​ x y\r\nz", "ÀÉ,Ö. ß!? 'sa 're", "Ŝalom naïve日本語テキスト мир", "\x1c\x85 a　b"]
    for text in [t for _, t in documents] + more:
        assert np.frombuffer(cache.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_texts_together(tokenizer, documents):
    rng = np.random.default_rng(5)
    pool = [*"abcdeZXY  \n.,!?'\"|<>()#_-0123\t\r\x00\x1c\x85\xa0\xadªºµßÀÉéöÿ×÷Σσİ’́​日ﬁ", "<|endoftext|>", "'s", "don't", "Word.,", "  "]
    texts = ["".join(rng.choice(pool, size=rng.integers(0, 14))) for _ in range(3000)] + [None, "", " "] + [t for _, t in documents]
    cache = tokens.ChunkIds(tokens.default_path(), limit=50)
    for text, own in zip(texts, cache.many(texts), strict=True):
        assert np.frombuffer(own, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_are_merged_together(tokenizer, monkeypatch):
    """No distinct word of letters is handed to the model on its own, up to LONGEST bytes, and the ids are its own."""
    rng = np.random.default_rng(6)
    letters = [*"abcdefghijklmnopqrstuvwxyzéßÀøÿ", "the", "tion", "aa", "lll", "ing"]
    words = ["".join(rng.choice(letters, size=rng.integers(1, 14))) for _ in range(20_000)] + ["a" * k for k in range(1, 60)] + ["é" * k for k in range(1, 30)]
    cache = tokens.ChunkIds(tokens.default_path())
    monkeypatch.setattr(cache, "bare", lambda word: pytest.fail(word) if len(word.encode()) <= 40 else tokens.ChunkIds.bare(cache, word))
    for text in (" ".join(words), words[0], " ".join(words[-95:])):
        assert np.frombuffer(cache.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_later_rounds_count_few_places(monkeypatch):
    """Rounds after the first sort only places of frequent pairs and of new symbols, and miss no frequent pair."""
    rng = np.random.default_rng(9)
    words = [rng.integers(0, 40, rng.integers(2, 9)).astype("<u4") for _ in range(30_000)]
    docs = [np.concatenate([words[i] for i in rng.integers(0, len(words), 60)]).tobytes() for _ in range(4000)]
    sizes, sort = [], np.sort
    monkeypatch.setattr(grammar.np, "sort", lambda x, *a, **k: sizes.append(len(x)) or sort(x, *a, **k))
    shard = grammar.Shard(grammar.encode(docs))
    monkeypatch.undo()
    n = sum(map(len, docs)) // 4
    assert list(shard.documents()) == docs
    ends = np.zeros(len(shard.seq), bool)
    ends[shard.offsets[1:] - 1] = ends[-1] = True
    pairs = np.stack([shard.seq[:-1], shard.seq[1:]], axis=1)[~ends[:-1]]
    assert np.unique(pairs, axis=0, return_counts=True)[1].max() < 5
    assert sum(sizes) < 2.5 * n, (sum(sizes) / n, len(sizes))


def test_pack(spark, odd, none, tokenizer):
    rows = packing.pack(odd, window=64).orderBy("sequence_id", "offset").collect()
    assert [(r.sequence_id, r.offset) for r in rows][0] == (0, 0)
    at = 0
    for r in rows:
        assert r.sequence_id * 64 + r.offset == at and r.length == len(r.ids) // 4 and zlib.crc32(r.ids) == r.ids_crc32
        at += r.length
    whole = {}
    for r in rows:
        whole.setdefault((r.doc_id, r.sequence_id * 64 + r.offset - r.start), {})[r.start] = bytes(r.ids)
    made = sorted((str(d), b"".join(p[k] for k in sorted(p))) for (d, _), p in whole.items())
    assert made == sorted((str(r.doc_id), ids(tokenizer, r.text, 2).tobytes()) for r in odd.select("doc_id", "text").collect())
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    top = [4, 300, 70_000, 2**31][seed]
    docs = [rng.integers(0, top, rng.integers(1, 400)).astype("<u4").tobytes() for _ in range(60)] + [np.array([7] * 999 + [1], "<u4").tobytes()] * 3
    shard = grammar.Shard(grammar.encode(docs))
    assert list(shard.documents()) == docs
    for d in (0, 17, 62):
        own = np.frombuffer(docs[d], "<u4")
        assert (shard.document(d) == own).all()
        assert all(shard.id_at(d, k) == own[k] for k in (0, len(own) // 2, len(own) - 1))
    assert len(grammar.encode([docs[-1]] * 50)) < 50 * len(docs[-1]) / 20
    with pytest.raises(ValueError):
        grammar.Shard(b"x" * 40)


def test_more_symbols_than_two_bytes_hold():
    """Rules go on beyond 65,536 symbols, and until no pair is frequent."""
    rng = np.random.default_rng(8)
    words = [rng.integers(0, 2**31, 3).astype("<u4") for _ in range(30_000)]
    docs = [np.concatenate([words[i] for i in rng.integers(0, len(words), 60)]).tobytes() for _ in range(4000)]
    blob = grammar.encode(docs)
    assert int.from_bytes(blob[20:24], "little") == 4
    shard = grammar.Shard(blob)
    assert list(shard.documents()) == docs
    ends = np.zeros(len(shard.seq), bool)
    ends[shard.offsets[1:] - 1] = ends[-1] = True
    pairs = np.stack([shard.seq[:-1], shard.seq[1:]], axis=1)[~ends[:-1]]
    assert np.unique(pairs, axis=0, return_counts=True)[1].max() < 5 and len(blob) < 0.75 * sum(map(len, docs))


def test_shards(spark, odd, none, tokenizer, tmp_path):
    kept = str(tmp_path / "kept")
    grammar.write_shards(odd, shard_tokens=40, out=kept)
    out = grammar.read_shards(spark.read.parquet(kept)).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    text = {r.doc_id: r.text for r in odd.collect()}
    at = 0
    for r in out:
        own = ids(tokenizer, text[r.doc_id], 1)
        assert (r.start, r.n_tokens, bytes(r.ids), r.ids_crc32) == (at, len(own), own.tobytes(), zlib.crc32(own.tobytes()))
        at += len(own)
    assert grammar.read_shards(grammar.write_shards(none)).count() == 0


def test_queries(spark, sf):
    pieces = packing.op3_pack_sequences(spark, sf)
    assert pieces.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.groupBy("doc_id").agg((F.sum("length") == F.min("doc_tokens")).alias("ok")).where("not ok").count() == 0
    assert grammar.op6_repair_shards(spark, sf).count() == 200
