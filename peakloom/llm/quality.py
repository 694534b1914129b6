"""Quality scores by positive-unlabelled learning: trusted positives against unlabelled text, with the non-negative
unbiased risk and an estimated class prior. Rows labelled as bad are never used."""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample, and the score from which a text is taken to be good.
MOST_POSITIVE, MOST_UNLABELLED, THRESHOLD = 12_000, 12_000, 0.3

# classes of UTF-8 bytes: small, capital, digit, space, line end, stop, comma, other sentence marks, brackets and
# quotes, symbols, bytes of other letters, control
_CLASSES = 12
_CLASS = np.full(256, 9, dtype=np.uint8)
_CLASS[list(range(97, 123))] = 0
_CLASS[list(range(65, 91))] = 1
_CLASS[list(range(48, 58))] = 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[list(b".")] = 5
_CLASS[list(b",")] = 6
_CLASS[list(b"!?;:")] = 7
_CLASS[list(b"()[]{}'\"")] = 8
_CLASS[128:] = 10
_CLASS[[c for c in range(32) if c not in (9, 10, 13)] + [127]] = 11
N_FEATURES = _CLASSES * _CLASSES + 94 + 11


def features(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of byte-class pairs and ASCII marks, and how much words and lines repeat."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    if not text:
        return out
    data = np.frombuffer(text, dtype=np.uint8)
    kinds = _CLASS[data]
    if len(data) > 1:
        pairs = np.bincount(kinds[:-1] * np.uint8(_CLASSES) + kinds[1:], minlength=_CLASSES**2)
        out[: _CLASSES**2] = np.sqrt(pairs / (len(data) - 1))
    out[_CLASSES**2 : _CLASSES**2 + 94] = np.sqrt(np.bincount(data, minlength=256)[33:127] / len(data))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    distinct, pairs_seen = len(set(words)), len(set(zip(words, words[1:], strict=False)))
    capital = sum(map(bytes.isupper, words))
    out[-11:] = (
        np.log1p(len(data)) / 10, np.log1p(n) / 10, distinct / n, pairs_seen / max(1, n - 1), len(set(lines)) / len(lines),
        min(1.0, len(data) / n / 20), capital / n, min(1.0, len(lines) / n), np.log1p(n / max(1, distinct)) / 5, float(len(words) > 0), sum(map(operator.eq, words, words[1:])) / max(1, n - 1),
    )
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


@dataclass
class Model:
    """One hidden layer over standardised features; ``prior`` is the estimated share of good texts."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x).astype(np.float64))


def _loss(z: np.ndarray) -> np.ndarray:
    """Logistic loss of logits of texts that should score high; of ``-z``, low."""
    return np.logaddexp(0, -z)


def pu_risk(pos: np.ndarray, unl: np.ndarray, prior: float | None) -> float:
    """The non-negative unbiased risk of logits: prior * R(pos, +) + max(0, R(unl, -) - prior * R(pos, -)). With
    ``prior`` None: plain positive-against-unlabelled logistic risk."""
    if prior is None:
        return float(_loss(pos).mean() + _loss(-unl).mean())
    return float(prior * _loss(pos).mean() + max(0.0, _loss(-unl).mean() - prior * _loss(-pos).mean()))


def pu_step(pos: np.ndarray, unl: np.ndarray, prior: float | None) -> tuple[np.ndarray, np.ndarray]:
    """What a step goes down, by the logits of both: the gradient of the risk where the bracket isn't negative; else the
    bracket itself is driven up."""
    sp, su = _sigmoid(pos), _sigmoid(unl)
    if prior is None:
        return (sp - 1) / len(sp), su / len(su)
    if _loss(-unl).mean() - prior * _loss(-pos).mean() >= 0:
        return (prior * (sp - 1) - prior * sp) / len(sp), su / len(su)
    return prior * sp / len(sp), -su / len(su)


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, hidden: int = 24, epochs: int = 30, batch: int = 512, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on :func:`pu_risk`, in batches."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([pos, unl])
    mean, scale = every.mean(0), every.std(0) + 1e-2
    pos, unl = (pos - mean) / scale, (unl - mean) / scale
    p = [rng.normal(0, np.sqrt(2 / pos.shape[1]), (pos.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    steps = max(1, max(len(pos), len(unl)) // batch)
    for _ in range(epochs):
        for _ in range(steps):
            a, b = pos[rng.integers(len(pos), size=batch)], unl[rng.integers(len(unl), size=batch)]
            x = np.concatenate([a, b])
            h = np.maximum(x @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            g = np.concatenate(pu_step(z[:batch], z[batch:], prior))
            back = np.outer(g, p[2]) * (h > 0)
            grads = [x.T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]
            t += 1
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, p[0], p[1], p[2], float(p[3][0]), 0.0 if prior is None else prior)


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among the unlabelled, by the best bin: the score cut above which unlabelled texts are
    rarest relative to positives (with a confidence bound, so that tiny bins don't win), on halves not trained on."""
    model = _fit(pos[::2], unl[::2], None, epochs=12)
    p, u = np.sort(model.logits(pos[1::2])), np.sort(model.logits(unl[1::2]))
    if not len(p) or not len(u):
        return 0.5
    cuts = p[: max(1, int(0.9 * len(p)))]
    q_p = 1 - np.searchsorted(p, cuts) / len(p)
    q_u = 1 - np.searchsorted(u, cuts) / len(u)
    slack = np.sqrt(np.log(40) / 2 / len(u)) + np.sqrt(np.log(40) / 2 / len(p))
    best = int(np.argmin((q_u + slack) / q_p))
    return float(np.clip(q_u[best] / q_p[best], 0.02, 0.98))


def train(pos: np.ndarray, unl: np.ndarray) -> Model | None:
    """None without positives or without unlabelled texts."""
    if len(pos) < 2 or len(unl) < 2:
        return None
    return _fit(pos, unl, class_prior(pos, unl))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 marks held-out rows."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5).cast("int")


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model | None:
    """A model of a sample by hash of the id: at most about ``most_positive`` texts labelled good and
    ``most_unlabelled`` of all texts, both from rows that aren't held out. One pass over the texts. Of rows that share an
    id one counts, so the driver gets at most about as many rows as both bounds allow, whatever repeats. Null ids are
    left out, null and empty texts have features of zeros, and labels without a document, or null, are of no account;
    without positives or without documents there is no model."""
    seen = lambda c: F.coalesce(remainder(c), F.lit(0)) != 0
    share = lambda c, most, n: F.pmod(F.xxhash64(c, F.lit(17)), F.lit(1 << 30)) < int(min(1.0, most / max(1, n)) * (1 << 30))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where(seen(F.col("doc_id"))).distinct()
    good = good.where(share(F.col("doc_id"), most_positive, good.count())).withColumn("good", F.lit(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body")).where(seen(F.col("doc_id")))
    n = docs.agg(F.approx_count_distinct("doc_id", 0.01)).first()[0]
    rows = rows.join(F.broadcast(good), "doc_id", "left")  # at most about most_positive rows
    rows = rows.withColumn("any", share(F.concat_ws("/", "doc_id"), most_unlabelled, n)).where("good = 1 or any")

    def run(batches):
        for batch in batches:
            made = [features(x.as_py()).tobytes() for x in batch.column(batch.schema.get_field_index("body"))]
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([get("doc_id"), get("good"), get("any"), pa.array(made, pa.binary())], names=["doc_id", "good", "any", "x"])

    made = rows.mapInArrow(run, "doc_id long, good int, any boolean, x binary")
    made = made.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("any").alias("any"), F.min("x").alias("x"))
    sample = sorted(((r.doc_id, r.good, r["any"], bytes(r.x)) for r in made.collect()), key=lambda r: (r[0], r[3]))
    matrix = lambda chosen: np.frombuffer(b"".join(chosen), dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    return train(matrix([r[3] for r in sample if r[1]]), matrix([r[3] for r in sample if r[2]]))


def _scores(model: Model | None, bodies: list[bytes | None]) -> np.ndarray:
    if model is None:
        return np.full(len(bodies), 0.5)
    return model.scores(np.stack([features(b) for b in bodies])) if bodies else np.zeros(0)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from ``threshold`` on). Only the text is scored. A null text is
    empty; a null doc_id is held out; without a model (no positives) every score is 0.5; rows that repeat stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                own = _scores(shared.value, batch.column(batch.schema.get_field_index("body")).to_pylist())
                held = [i is None or zlib.crc32(str(i).encode()) % 5 == 0 for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(own), pa.array((own >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``threshold`` or more. One narrow pass. A
    null text is empty; rows that repeat, and null ids, are kept or not like others; without a model all stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for big in batches:
            for first in range(0, big.num_rows, 512):
                batch = big.slice(first, 512)
                bodies = [t.encode("utf-8", "surrogatepass") if t else b"" for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(_scores(shared.value, bodies) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; see :func:`fit` and :func:`score`."""
    docs = common.corpus(spark, sf_dir)
    return score(docs, fit(docs, common.corpus(spark, sf_dir, "labels")))
