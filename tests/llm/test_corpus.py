"""Fingerprints, shards, near duplicates, quality and the pipeline."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from peakloom.llm import common, decontaminate, fingerprints, nearduplicates, pii, quality, sharding


def test_sketches():
    a, b = " ".join(map(str, range(3000))), " ".join(map(str, range(1000, 4000)))
    x, y = fingerprints.Sketch.of(a, 512), fingerprints.Sketch.of(b, 512)
    assert fingerprints.Sketch.parse(str(x)).hashes.tolist() == x.hashes.tolist()
    assert x.distinct() == pytest.approx(2996, rel=0.15) and x.resemblance(y) == pytest.approx(0.5, abs=0.08)
    assert fingerprints.Sketch.of(" ".join(map(str, range(1500))), 512).containment(x) == pytest.approx(1, abs=0.1)
    halves = fingerprints.Sketch.of(" ".join(map(str, range(1502))), 512).merge(fingerprints.Sketch.of(" ".join(map(str, range(1498, 3000))), 512))
    assert str(halves) == str(x)
    empty = fingerprints.Sketch.of(None)
    assert empty.resemblance(empty) == 1 and empty.resemblance(x) == 0 and empty.distinct() == 0
    assert fingerprints.Sketch.of("A b").resemblance(fingerprints.Sketch.of("a  B")) == 1


def test_merged_groups(spark):
    rows = [(g, str(fingerprints.Sketch.of(f"{i} a b c d e"))) for g in range(2) for i in range(40)]
    out = fingerprints.merged(spark.createDataFrame(rows, "g int, fingerprint string"), ["g"]).collect()
    assert len(out) == 2 and fingerprints.Sketch.parse(out[0].fingerprint).distinct() == 41  # 40 first shingles and the common one


def test_many_groups_are_merged_whole(spark):
    """70,000 groups of two parts in one partition: each comes out once; null keys and null sketches have a result."""
    a, b = (str(fingerprints.Sketch.of(t)) for t in ("a b c d e f", "g h i j k l"))
    rows = spark.range(70_000).select(F.when(F.col("id") > 0, F.col("id")).alias("g"), F.explode(F.array(F.lit(a), F.lit(b), F.lit(None).cast("string"))).alias("fingerprint"))
    more = spark.createDataFrame([(70_001, None), (70_001, None)], "g long, fingerprint string")
    out = fingerprints.merged(rows.unionByName(more).orderBy(F.xxhash64("g", "fingerprint")).coalesce(1), ["g"]).collect()
    both = str(fingerprints.Sketch.parse(a).merge(fingerprints.Sketch.parse(b)))
    assert len(out) == 70_001 and {r.fingerprint for r in out if r.g != 70_001} == {both}
    assert [r.fingerprint for r in out if r.g == 70_001] == [str(fingerprints.Sketch.of(None))] and sum(r.g is None for r in out) == 1


def test_a_shared_id_is_parted(spark):
    """A third of all rows without an id: the ranges stay even, and each row is followed by the next of the order."""
    rows = [(None if k % 3 == 0 else k, f"text {k} " + "w " * (k % 50)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text")
    own = fingerprints.with_next(df, each_bytes=4000).select(F.spark_partition_id().alias("p"), "*").collect()
    sizes = {}
    for r in own:
        sizes[r.p] = sizes.get(r.p, 0) + 1
    assert len(own) - sum(r.ctx for r in own) == 3000 and max(sizes.values()) < 4 * np.median(list(sizes.values()))
    out = fingerprints.compare_edited(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.count() == 3000 and out.where("doc_id is null").count() == 1000


@pytest.mark.parametrize("n", [1, 2, 40])
def test_edited(spark, documents, n):
    rows = [*documents[:n], (10**6, None)] if n > 1 else documents[:1]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in fingerprints.compare_edited(df).collect()}
    ids = sorted(out, reverse=True)
    text = {i: t or "" for i, t in rows}
    for k, i in enumerate(ids):
        after = text[ids[(k + 1) % len(ids)]]
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + after[:half]
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[i].n_chars == len(text[i])
        a, b = (set(fingerprints.shingle_hashes(t).tolist()) for t in (text[i], edited))
        assert out[i].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.15)  # the sketch's own error is about 0.044
        assert out[i].near_next == fingerprints.Sketch.of(text[i]).resemblance(fingerprints.Sketch.of(after))


def test_edited_odd(odd, none):
    out = fingerprints.compare_edited(odd).collect()
    assert len(out) == 11 and len({r.fingerprint for r in out if r.doc_id in (5, 6)}) == 1 and sum(r.doc_id is None for r in out) == 1
    assert fingerprints.compare_edited(none).count() == 0


class Folded(sharding.Stretches):
    """Groups behind stretches of up to five, which part into single ones."""

    def __init__(self, groups):
        self.groups = groups
        parts = [groups[i : i + 5] for i in range(0, len(groups), 5)]
        super().__init__([(p[0][0], sum(s for _, s in p), max(s for _, s in p), len(p)) for p in parts])

    def refine(self, wanted):
        kept = [r for i, r in enumerate(self.rows) if i not in wanted]
        for i in wanted:
            at = next(k for k, g in enumerate(self.groups) if g[0] == self.rows[i][0])
            kept += [(k, s, s, 1) for k, s in self.groups[at : at + self.rows[i][3]]]
        self._set(kept)


@pytest.mark.parametrize("seed", range(60))
def test_minimax(seed):
    """The capacity and the largest shard of the final cuts are those of the best of all partitions."""
    rng = random.Random(seed)
    n, k = rng.randint(1, 12), rng.randint(1, 5)
    groups = [(f"{i:04d}", rng.choice([rng.randint(1, 20), rng.randint(1, 3), 60 if rng.random() < 0.2 else 5])) for i in range(n)]
    shards = lambda c: [sum(s for _, s in groups[x:y]) for x, y in zip((0, *c), (*c, n), strict=True)]
    best = min(max(shards(c)) for c in itertools.combinations(range(1, n), min(k, n) - 1))
    for make in (sharding.Listed, Folded):
        capacity, _ = sharding.minimax(make(groups), k)
        assert capacity == best
        keys = sharding.balanced(make(groups), k)
        assert len(keys) < k and keys == sorted(set(keys))
        assert max(shards([int(x) for x in keys])) == best


def test_cuts_of_many_groups(spark):
    """Groups of a table, refined by digits, are cut as the whole list would be, with ties and one hot group too."""
    for hot in (0, 40_000):
        rows = [(hashlib.md5(str(i).encode()).hexdigest(), 1 + i % 7) for i in range(20_000)]
        rows += [(hashlib.md5(b"hot").hexdigest(), hot)] if hot else []
        df = spark.createDataFrame(rows, "key string, bytes long")
        for digits in (1, 3):
            own = sharding.Ordered(df, digits)
            assert sharding.balanced(own, 8) == own_keys(sorted(rows), own)
        assert len(own.rows) < 5000


def own_keys(rows, own):
    """First keys of the stretches of one group, or the whole keys that begin with them."""
    cuts = sharding.balanced(sharding.Listed(rows), 8)
    firsts = [r[0] for r in own.rows]
    return [next(f for f in firsts if c.startswith(f)) for c in cuts]


def test_shards(spark, odd, none, documents):
    df = spark.createDataFrame([*documents, *[(1000 + i, "hot text " * 2000) for i in range(20)], (5000, None), (5001, "")], "doc_id long, text string").repartition(4)
    rows = sharding.shard(df).collect()
    text = {r.doc_id: r.text or "" for r in df.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 1 for r in rows)
    of = {}
    for r in rows:
        of.setdefault(text[r.doc_id], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    for s in range(8):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = sorted(sum(r.size for r in rows if r["shard"] == s) for s in range(8))
    largest = max(len(t.encode()) for t in text.values()) + 1
    assert sizes[-2] - sizes[0] < 2 * largest  # the hot text has a shard of its own
    assert sharding.shard(odd).count() == 11 and sharding.shard(none).count() == 0


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for k in rng.choice(len(words), rng.integers(0, edits), replace=False):
            words[k] = f"w{rng.integers(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("chunk", [nearduplicates.CHUNK, 300])
def test_near_duplicates(spark, documents, monkeypatch, chunk):
    monkeypatch.setattr(nearduplicates, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    base = [f"v{k}" for k in rng.integers(0, 10**6, 90)]
    texts = near_copies(rng, base, 120, 11) + [" ".join(base)] * 15 + [t for _, t in documents] + ["", None, "one", "one", "ONE", "two words", "two  words", "three short words"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nearduplicates.near_duplicates(df).collect()}
    assert found == nearduplicates.brute_force(rows)


def test_near_duplicates_odd(odd, none):
    out = nearduplicates.near_duplicates(odd).collect()
    assert len(out) == 11 and {(r.component_id, r.kept) for r in out if r.doc_id in (5, 6)} == {(5, True), (5, False)}
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]
    assert nearduplicates.near_duplicates(none).count() == 0
    left = nearduplicates.keep_one(odd)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]


def test_texts_of_one_id_and_rows_without_ids(spark):
    """Different texts under one id are classes of their own; near copies among rows without an id are linked too."""
    base = [f"v{k}" for k in range(60)]
    near = " ".join([*base[:-2], "x", "y"])
    other = " ".join(f"u{k}" for k in range(40))
    rows = [(7, " ".join(base)), (7, other), (7, other), (3, near), (None, near + " z"), (None, other), (None, "lone words without an id"), (None, "lone words without an id"), (9, "a b c"), (9, None), (9, None), (12, "q " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in nearduplicates.near_duplicates(df).collect()), key=str)
    assert found == sorted([(7, 59, 3, False), (7, 39, 7, True), (7, 39, 7, True), (3, 59, 3, True), (0, 60, 3, False), (0, 39, 7, False), (0, 4, None, True), (0, 4, None, True), (9, 2, 9, True), (9, 0, 9, True), (9, 0, 9, True), (12, 1, 12, True)], key=str)
    left = sorted(((r.doc_id or 0, r.text or "") for r in nearduplicates.keep_one(df, words=2).collect()))
    assert left == sorted([(7, other), (3, near), (0, "lone words without an id"), (9, "a b c"), (9, ""), (9, ""), (12, "q " * 9)])


def test_a_hot_bucket_is_salted(spark, monkeypatch):
    """Joins on keys that many rows share give the rows of a plain join, in parts of bounded size."""
    monkeypatch.setattr(nearduplicates, "HOT_ROWS", 50)
    left = spark.range(3000).select((F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 500)).alias("k"), F.col("id").alias("v"))
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert sorted(map(tuple, nearduplicates.spread(left, right, "k", "v").collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    rng = np.random.default_rng(3)
    base = [f"v{k}" for k in rng.integers(0, 10**6, 90)]
    rows = list(enumerate(near_copies(rng, base, 400, 14) + [" ".join(base)] * 200 + [None] * 200))
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nearduplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == nearduplicates.brute_force(rows)


@pytest.mark.parametrize("together", [5, 9, 10, 20, 60, 300])
def test_recall_of_bands(together):
    """Pairs of sets at a similarity of just 0.8 and above share a key; the smallest ones without exception."""
    rng = np.random.default_rng(together)
    for shared in sorted({-(-8 * together // 10), -(-9 * together // 10)}):
        missed, n = 0, 400
        for _ in range(n):
            own = rng.integers(0, 2**64, together, dtype=np.uint64)
            only_a = rng.integers(0, together - shared + 1)
            a, b = np.delete(own, np.arange(shared, shared + only_a)), own[: shared + only_a]
            missed += not set(nearduplicates.band_keys(np.unique(a)).tolist()) & set(nearduplicates.band_keys(np.unique(b)).tolist())
        assert missed == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    nodes = spark.range(103).withColumnRenamed("id", "node")
    found = {r.node: r.label for r in nearduplicates.components(nodes, links).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_quality(spark, sf, small_dir):
    sf = sf.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in common.corpus(spark, sf, "labels").collect()}
    rows = [r for r in quality.op1_pu_quality(spark, sf).collect()]
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q, _ in held if q], [s for s, q, _ in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([p == q for _, q, p in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.op1_pu_quality(spark, small_dir).count() == 11
    docs = common.corpus(spark, small_dir)
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.where("false"), None).count() == 0


@pytest.mark.parametrize("prior", [None, 0.2, 0.7, 0.95])
def test_risk_and_its_gradient(prior):
    """The risk is its formula written out term by term, and a step goes along its numerical gradient."""
    rng = np.random.default_rng(1)
    for shift in (-3.0, 0.0, 3.0):
        pos, unl = rng.normal(1 + shift, 1, 7), rng.normal(shift, 2, 9)
        plus = [float(np.log(1 + np.exp(-z))) for z in pos]
        minus = [float(np.log(1 + np.exp(z))) for z in pos]
        low = [float(np.log(1 + np.exp(z))) for z in unl]
        bracket = sum(low) / 9 - (prior or 0) * sum(minus) / 7
        expected = sum(plus) / 7 + sum(low) / 9 if prior is None else prior * sum(plus) / 7 + max(0.0, bracket)
        assert quality.pu_risk(pos, unl, prior) == pytest.approx(expected, rel=1e-12)
        goal = (lambda a, b: quality.pu_risk(a, b, prior)) if prior is None or bracket >= 0 else lambda a, b: prior * np.logaddexp(0, a).mean() - np.logaddexp(0, b).mean()
        for own, which in zip(quality.pu_step(pos, unl, prior), (0, 1), strict=True):
            for k in range(len(own)):
                ends = []
                for d in (-1e-5, 1e-5):
                    both = [pos.copy(), unl.copy()]
                    both[which][k] += d
                    ends.append(goal(*both))
                assert own[k] == pytest.approx((ends[1] - ends[0]) / 2e-5, abs=1e-6)


def test_repeated_ids_are_sampled_once(spark, monkeypatch):
    """A labelled id that a third of all rows share reaches the driver as one row."""
    seen = []
    monkeypatch.setattr(quality, "train", lambda pos, unl: seen.append((len(pos), len(unl))))
    rows = [(k if k % 3 else 1, f"text number {k}") for k in range(3000)]
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    assert quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels) is None
    kept = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5}
    assert seen == [(len(kept & {1, 2, 4}), len(kept))]


def test_quality_stage_against_scores(spark, sf):
    """The rows that stay are those, in all their columns, that the model itself scores 0.3 or more, one by one."""
    docs = common.corpus(spark, sf)
    model = quality.fit(docs, common.corpus(spark, sf, "labels"))
    kept = sorted(map(tuple, quality.keep_good(docs, model).collect()))
    assert kept == sorted(tuple(r) for r in docs.collect() if model.scores(quality.features((r.text or "").encode())[None])[0] >= 0.3) and kept


def test_prior_is_found():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (3000, 5)), rng.normal(-2, 1, (1200, 5))
    unlabelled = np.concatenate([good[1200:], bad])
    assert quality.class_prior(good[:1200], unlabelled) == pytest.approx(0.6, abs=0.1)


def test_pipeline_stages(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = common.corpus(spark, sf)
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(common.stored(stage(spark, kept[-1], sf), name))
        assert kept[-1].columns == docs.columns
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept]
    five = nearduplicates.brute_force(list(rows[1].items()), words=5)
    assert set(rows[2]) == {i for i, (_, _, keep) in five.items() if keep}
    items = [(r.item_id, r.text) for r in common.corpus(spark, sf, "benchmark").collect()]
    tables = decontaminate.tables_of([(i, t.encode()) for i, t in items])
    clean = {i for i, t in rows[2].items() if not any(True for table in tables for _ in table.search(decontaminate.words_of(t.encode())))}
    assert set(rows[3]) == clean and 0 < len(clean) < len(rows[2])
    assert rows[4] == {i: pii.redacted(t, pii.spans_of(t)[1]) for i, t in rows[3].items()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf)
    from tokenizers import Tokenizer

    from peakloom.llm import tokens

    tokenizer = Tokenizer.from_file(tokens.default_path())
    own, at = {}, 0
    for r in pieces.orderBy("sequence_id", "offset").collect():
        assert r.sequence_id * 4096 + r.offset == at and r.offset + r.length <= 4096 and zlib.crc32(r.ids) == r.ids_crc32
        at += r.length
        own.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in own.items()} == {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in rows[4].items()}


def test_pipeline_of_odd_rows(spark, small_dir):
    out = corpus_pipeline.run(spark, small_dir)
    assert out.count() > 0 and out.agg(F.sum("length")).first()[0] == out.agg(F.max(F.col("sequence_id") * 4096 + F.col("offset") + F.col("length"))).first()[0]
