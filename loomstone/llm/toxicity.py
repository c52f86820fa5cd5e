"""Toxicity scores by FTRL-proximal logistic regression on hashed n-grams.

Features of a text are its distinct words, word bigrams and skip-grams (pairs with one word between),
hashed to ``2**BITS`` indices, lower-cased A-Z, without punctuation. FTRL-proximal gives each coordinate
a learning rate of its own and, by its L1 term, exact zeros for most; the non-zero weights are a small
sorted table that is broadcast for scoring.

Training: at most ``max_train`` labelled documents and ``max_bytes`` of their texts, those of least hash of the id, seen ``epochs`` times
by one task (its memory: the weights' state and the sample's indices). Scoring needs no shuffle.

Defined results: null and empty texts score the bias alone; without labelled rows every score is 0.5;
null labels and null ids are not learned from; an id with several labels is toxic if any says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import by_bytes, id_type, load, remainder, small_batches

BITS = 20
MAX_TRAIN = 16_000
#: Bytes of text after which no further sample is learned.
MAX_BYTES = 256 << 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
THRESHOLD = 0.3


def features(column, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature indices, the text of each, and the number of texts; indices from 1 (0 is the bias); may repeat within a text."""
    b = tv.Batch(column, fold=True)
    starts, ends, owner = b.runs(tv.NOT_LETTER)
    words = b.hashes(starts, ends)
    parts = [tv.ngrams(words, owner, n, gap) for n, gap in ((1, 1), (2, 1), (2, 2))]
    index = np.concatenate([g & np.uint64((1 << bits) - 1) for g, _ in parts]).astype(np.int64) + 1
    return index, np.concatenate([owner[at] if len(at) else at for _, at in parts]), b.n


def _distinct(index: np.ndarray, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((owner.astype(np.int64) << (bits + 1)) | index)
    return both & ((1 << (bits + 1)) - 1), both >> (bits + 1)


class Ftrl:
    """FTRL-proximal logistic regression on sets of indices."""

    def __init__(self, size: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES, epochs: int = EPOCHS, bits: int = BITS) -> dict[int, float]:
    """The non-zero weights by index (0: bias)."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null")
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = sample.groupBy("id", "y").agg(F.min("text").alias("text"))  # rows that repeat an id count once
    sample = sample.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("text", "y")

    def run(batches):
        seen, size = [], 0
        for batch in by_bytes(batches, 0):
            size += batch.nbytes
            if seen and size > max_bytes:
                continue
            index, owner, n = features(batch.column(0), bits)
            index, owner = _distinct(index, owner, bits)
            cuts = np.searchsorted(owner, np.arange(n + 1))
            seen += [(np.append(index[a:b], 0).astype(np.int32), y) for a, b, y in zip(cuts[:-1], cuts[1:], batch.column(1).to_pylist(), strict=True)]
        model = Ftrl((1 << bits) + 1)
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            for k in rng.permutation(len(seen)):
                model.learn(*seen[k])
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    return {r["at"]: r["w"] for r in sample.mapInArrow(run, "at long, w double").collect()}


def score(docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per row: id and ``score`` from 0 to 1."""
    small_batches(docs.sparkSession)
    at = np.array(sorted(weights), dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((at, np.array([weights[k] for k in at.tolist()])))

    def run(batches):
        at, w = shared.value
        dense = np.zeros((1 << bits) + 1)
        dense[at] = w
        for batch in by_bytes(batches, 1):
            index, owner, n = features(batch.column(1), bits)
            held = dense[index] != 0
            index, owner = _distinct(index[held], owner[held], bits)
            total = tv.counts_by(owner, n, dense[index]) + dense[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type(docs, id_col)}, score double")


def op2_toxicity(spark, sf_dir) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    weights = fit(docs, load(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2))
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return score(docs, weights).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
