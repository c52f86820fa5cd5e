"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded from measures of
its surface (shapes, symbols, repetition) and hashed word shapes through a small learned layer; gated
attention weights, learned from document labels alone, say how much each passage counts; the weighted
sum of the encodings is scored. So a document is judged by the passages that decide, however long it is.

Training: at most ``max_train`` labelled documents and ``max_bytes`` of their texts, those of least hash of the id, in one task. Scoring
needs no shuffle; its memory is that of one Arrow batch.

Defined results: null, empty and blank texts are one empty passage; without labelled rows every score is
0.5; null labels and ids are not learned from; an id with several labels takes the least.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import by_bytes, id_type, load, remainder, small_batches

PASSAGE_WORDS = 64
SHAPES = 32
HIDDEN, ATTENTION = 24, 12
MAX_TRAIN = 8_000
#: Bytes of text after which no further sample is learned.
MAX_BYTES = 128 << 20
EPOCHS = 30
THRESHOLD = 0.3

_CLASS = np.full(256, 5, dtype=np.uint8)  # other ASCII
_CLASS[[*range(0x61, 0x7B)]] = 0
_CLASS[[*range(0x41, 0x5B)]] = 1
_CLASS[[*range(0x30, 0x3A)]] = 2
_CLASS[0x80:] = 3
_CLASS[list(b".,;:'\"()-?")] = 4
_CLASS[list(b"!")] = 6
_SHAPE = _CLASS + np.uint8(97)
N_CLASSES = 7


def passages(column) -> tuple[np.ndarray, np.ndarray]:
    """Measures of all passages (a row each), and the first passage of each text with the total at the end."""
    b = tv.Batch(column)
    starts, ends, owner = b.runs(tv.SPACE)
    n_words = tv.counts_by(owner, b.n).astype(np.int64)
    n_pass = np.maximum(-(-n_words // PASSAGE_WORDS), 1)
    first = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(first[-1])
    begin = np.concatenate([[0], np.cumsum(n_words)])
    at = first[owner] + (np.arange(len(owner)) - begin[owner]) // PASSAGE_WORDS if len(owner) else owner
    words = b.hashes(starts, ends)
    lengths = (ends - starts).astype(np.float64)

    def per(weights=None):
        return np.bincount(at, weights=weights, minlength=total)[:total] if len(at) else np.zeros(total)

    count = np.maximum(per(), 1)
    size = np.maximum(per(lengths), 1)
    out = [per() / PASSAGE_WORDS, per(lengths) / count / 10]
    uppers = None
    for c in range(N_CLASSES):
        sums = np.concatenate([[0], np.cumsum(_CLASS[b.bytes] == c)])
        each = sums[ends] - sums[starts]
        out.append(per(each) / size)
        uppers = each if c == 1 else uppers
    out.append(per((uppers == lengths) & (lengths > 1)) / count)
    out += [per(lengths == 1) / count, per(lengths > 14) / count]
    last = _CLASS[b.bytes[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    out += [per(last == 5) / count, per(last == 6) / count, per(last == 4) / count]
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    out.append(per(same) / count)
    again, later = tv.repeated(words, at)
    out.append(per(later) / count)
    for n in (2, 4):
        grams, where = tv.ngrams(words, owner, n)
        _, later = tv.repeated(grams, owner[where] if len(where) else where)
        out.append((np.bincount(at[where], weights=later, minlength=total)[:total] if len(where) else np.zeros(total)) / count)
    breaks = np.concatenate([[0], np.cumsum(b.bytes == 0x0A)])
    gap = np.zeros(len(starts))
    gap[1:] = breaks[starts[1:]] - breaks[ends[:-1]]
    out.append(per(gap) / count)
    out.append((n_pass[np.repeat(np.arange(b.n), n_pass)] > 1).astype(np.float64))
    shaped = tv.Batch.__new__(tv.Batch)
    shaped.bytes, shaped.offsets, shaped.n, shaped._sums = _SHAPE[b.bytes], b.offsets, b.n, None
    # a word's shape: the classes of its first and last two bytes
    shape = shaped.hashes(starts, np.minimum(starts + 2, ends)) * np.uint64(3) + shaped.hashes(np.maximum(ends - 2, starts), ends)
    shape = (tv.mix(shape) % np.uint64(SHAPES)).astype(np.int64)
    bag = np.bincount(at * SHAPES + shape, minlength=total * SHAPES)[: total * SHAPES].reshape(total, SHAPES) if len(at) else np.zeros((total, SHAPES))
    return np.concatenate([np.stack(out, axis=1), bag / count[:, None]], axis=1), first


class AttentionModel:
    """Encoder, gated attention and scorer; parameters in ``p``."""

    NAMES = ("W", "b", "V", "U", "w", "c", "d")

    def __init__(self, n_features: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": draw(n_features, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(n_features), np.ones(n_features)

    def forward(self, x: np.ndarray, first: np.ndarray):
        """Score of each document, and what the gradients need."""
        p, counts = self.p, np.diff(first)
        doc = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[doc])
        a = e / np.add.reduceat(e, first[:-1])[doc]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -35, 35)))
        return y, (doc, h, t, g, a, z)

    def gradients(self, x, first, target):
        p = self.p
        y, (doc, h, t, g, a, z) = self.forward(x, first)
        r = (y - target) / len(target)
        dz = r[:, None] * p["c"]
        through = (dz[doc] * h).sum(axis=1)
        de = a * (through - np.add.reduceat(a * through, first[:-1])[doc])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[doc] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ r, "d": np.array([r.sum()])}

    def train(self, bags: list[np.ndarray], target: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 6) -> None:
        """Adam on the log loss."""
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                x = (np.concatenate([bags[k] for k in part]) - self.mean) / self.scale
                first = np.concatenate([[0], np.cumsum([len(bags[k]) for k in part])])
                step += 1
                for k, g in self.gradients(np.clip(x, -8, 8), first, target[part]).items():
                    g = g + decay * self.p[k]
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def predict(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the texts; the attention of all passages and the first passage of each text."""
        x, first = passages(column)
        if len(first) == 1:
            return np.zeros(0), np.zeros(0), first
        y, (_, _, _, _, a, _) = self.forward(np.clip((x - self.mean) / self.scale, -8, 8), first)
        return y, a, first

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, mean=self.mean, scale=self.scale, **self.p)
        return out.getvalue()

    @classmethod
    def restore(cls, data: bytes | None) -> AttentionModel:
        n = passages(pa.array([""]))[0].shape[1]
        model = cls(n)
        if data is None:
            model.p = {k: np.zeros_like(x) for k, x in model.p.items()}
        else:
            got = np.load(io.BytesIO(data))
            model.p, model.mean, model.scale = {k: got[k] for k in cls.NAMES}, got["mean"], got["scale"]
        return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES, epochs: int = EPOCHS) -> bytes | None:
    """The trained model's parameters; None without labelled rows."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null")
    chosen = chosen.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = sample.groupBy("id", "y").agg(F.min("text").alias("text"))  # rows that repeat an id count once
    sample = sample.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("text", "y")

    def run(batches):
        bags, target, size = [], [], 0
        for batch in by_bytes(batches, 0):
            size += batch.nbytes
            if bags and size > max_bytes:
                continue
            x, first = passages(batch.column(0))
            bags += [x[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            target += batch.column(1).to_pylist()
        if bags:
            model = AttentionModel(bags[0].shape[1])
            model.train(bags, np.array(target), epochs)
            yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], names=["model"])

    got = sample.mapInArrow(run, "model binary").collect()
    return bytes(got[0]["model"]) if got else None


def score(docs: DataFrame, model: bytes | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``score`` and ``attention``, the weights of its passages."""
    small_batches(docs.sparkSession)

    def run(batches):
        m = AttentionModel.restore(model)
        for batch in by_bytes(batches, 1):
            y, a, first = m.predict(batch.column(1))
            attention = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(a))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y), attention], names=[id_col, "score", "attention"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type(docs, id_col)}, score double, attention array<double>")


def op5_quality(spark, sf_dir) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(docs, load(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
