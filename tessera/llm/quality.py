"""A quality classifier: hashed word n-gram logistic regression, trained by FTRL.

Features are words, word pairs, word shapes and shape pairs (with whether both
words are the same), hashed into a fixed number of buckets. Training is
follow-the-regularised-leader, one pass after another over a bounded sample of
labelled rows; a score is a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Tokens, as_bytes, fold, hash_all, join_hash, mix, slices

#: Hash buckets as a power of two; labelled rows to learn from at most; updates in all, over as many passes as that takes.
BITS, TRAIN_ROWS, UPDATES = 20, 6000, 18_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_SHAPE = bytes.maketrans(bytes(range(256)), bytes(65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256)))
_TWICE = re.compile(rb"(.)\1+", re.DOTALL)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all texts, their values (unit length a text), and where each text's begin."""
    tokens = Tokens(texts, lower=False)
    words, n = as_bytes(tokens.words), len(texts)
    word = hash_all([w.lower() for w in words], 1)[tokens.ids]
    shape = hash_all([_TWICE.sub(rb"\1", w.translate(_SHAPE)) for w in words], 2)[tokens.ids]
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(tokens.at))
    inner = doc[1:] == doc[:-1]
    same = (word[1:] == word[:-1]).astype(np.uint64)
    hashes = [word, join_hash(word[:-1], word[1:])[inner], mix(shape), join_hash(join_hash(shape[:-1], shape[1:]), same)[inner]]
    docs = [doc, doc[1:][inner], doc, doc[1:][inner]]
    key = np.concatenate([d << np.uint64(bits) | h >> np.uint64(64 - bits) for d, h in zip(docs, hashes, strict=True)])
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, count = key[first], np.diff(np.append(first, len(key)))
    value = np.log1p(count)
    at = np.searchsorted(key >> np.uint64(bits), np.arange(n + 1, dtype=np.uint64))
    norm = np.sqrt(np.maximum(text_sums(value * value, at), 1e-12))
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), value / np.repeat(norm, np.diff(at)), at


def text_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each text's values, whatever texts come with it (empty: 0)."""
    out, some = np.zeros(len(at) - 1), np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(values, at[some])
    return out


@dataclass
class Ftrl:
    """Follow the regularised leader, proximal, one example at a time."""

    bits: int = BITS
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros((1 << self.bits) + 1), np.zeros((1 << self.bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, 1 << self.bits), np.append(x, 1.0)  # the last bucket is the constant
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        squared = gradient * gradient
        self.z[at] += gradient - (np.sqrt(self.n[at] + squared) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += squared


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, updates: int = UPDATES) -> np.ndarray:
    """Weights learnt from the labelled rows outside the held-out fold.

    Of more than `rows` labelled documents, those with the least hash of
    doc_id are taken: that bounds what the driver holds. A doc_id with several
    labels counts with the largest one, and with several texts with that of
    the least hash; null labels and null ids are left out, a null text counts
    as empty. Other columns are not read. Without rows, all weights are 0.
    """
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))  # at most `rows` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at, x, bounds = features(part.column("text"))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v)) for v in (at.astype(np.int32), x.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *lists], ["doc_id", "y", "at", "x"])

    texts = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text").join(chosen, "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # at most `rows` rows
    found = texts.mapInArrow(run, "doc_id long, y int, at array<int>, x array<float>").toArrow()
    model = Ftrl()
    order = np.argsort(hash_all([b"%d" % x for x in found["doc_id"].to_pylist()], 3), kind="stable")
    ids, ys, ats, xs = (found[c].combine_chunks() if found.num_rows else [] for c in ("doc_id", "y", "at", "x"))
    for _ in range(-(-updates // len(order)) if len(order) else 0):
        for i in order:
            model.learn(ats[int(i)].values.to_numpy().astype(np.int64), xs[int(i)].values.to_numpy().astype(float), int(ys[int(i)].as_py() > 0))
    return model.weights()


def probability(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    at, x, bounds = features(texts)
    return 1 / (1 + np.exp(-(text_sums(weights[at] * x, bounds) + weights[-1])))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    An empty or null text gets the score of the constant alone. Repeated or
    null ids give a row each time; other columns are not read. A null id
    counts as not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in slices(batches):
            p = probability(part.column("text"), w)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").withColumn("held_out", F.coalesce(fold() == 0, F.lit(False)))
    return rows.mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores documents by weights that are learnt from the same documents' labels.

    Rows, nulls and empty texts count as in train and score; an empty table of
    documents gives an empty result, one of labels a score of 1/2 for all.
    """
    return score(docs, train(docs, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns; nothing is shuffled.

    Each row is judged by its own text, so repeated and null ids are no
    matter; a null or empty text gets the score of the constant alone. Extra
    columns may have any names. An empty table gives an empty result.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for part in slices(batches):
            yield part.filter(pa.array(probability(part.column("text"), w) >= threshold))

    return docs.mapInArrow(run, docs.schema)
