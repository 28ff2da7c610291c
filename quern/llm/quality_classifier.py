"""Quality classifier: supervised subword embeddings.

Each word, each pair of neighbouring words and each character n-gram of a word hashes to a learned vector; so that
repetition shows in an average, each window of one to three words also counts under one of two vectors of its length,
for windows that came before in the text and for new ones. A document is the average of its vectors, and a softmax
layer gives the class. Training is numpy stochastic gradient descent on a bounded sample of labelled documents. The average and the output layer are linear, so to score, each
bucket's vector is multiplied by the output layer once, and a document's logit is the average of its buckets'.

Cases: null and empty texts have no features and get the score of the bias; labels that are null, or of documents
outside the table, are ignored; conflicting labels of a document count as the larger; with only one class, or none,
among the labels, the score is the smoothed share of class 1. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Longest window of words that is looked at for repeats.
REPEATS = 3


@dataclass(frozen=True)
class Settings:
    """bound: labelled documents of each class that training may use (a bounded sample, chosen by hash of the id).

    rate, inner_rate: steps of the output layer, and of the vectors beside it: an average has small gradients.
    """

    buckets: int = 1 << 18
    dim: int = 16
    shortest: int = 3
    longest: int = 5
    epochs: int = 8
    rate: float = 0.4
    inner_rate: float = 30.0
    bound: int = 1_200
    seed: int = 7

    @property
    def size(self) -> int:
        """Vectors: the hashed buckets, and those of the windows that came before or are new."""
        return self.buckets + 2 * REPEATS


class Features:
    """Hashes the words of texts, given as bytes."""

    def __init__(self, s: Settings):
        self.s = s
        self.marks = np.arange(s.buckets, s.size, dtype=np.int32)

    def grams(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the words and of their character n-grams, the word that each belongs to, and the words' hashes.
        Character means code point; < and > mark a word's ends."""
        mask = np.uint32(self.s.buckets - 1)
        hashes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), "<u4")
        of = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(words)))
        owner, bucket, h = [np.arange(len(words))], [hashes & mask], points
        for n in range(2, self.s.longest + 1):
            if len(h) < 2:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ points[n - 1 :]
            if n >= self.s.shortest:
                inside = of[: len(h)] == of[n - 1 :]
                mixed = (h[inside] ^ np.uint32(n)) * np.uint32(0x9E3779B1)
                owner.append(of[: len(h)][inside])
                bucket.append((mixed ^ mixed >> np.uint32(15)) & mask)
        return np.concatenate(bucket).astype(np.int32), np.concatenate(owner), hashes

    def pairs(self, hashes: np.ndarray) -> np.ndarray:
        """Buckets of neighbouring words, from the words' hashes."""
        mixed = (hashes[:-1] * np.uint32(0x9E3779B1) ^ hashes[1:]) * np.uint32(0x85EBCA77)
        return (mixed >> np.uint32(7)) & np.uint32(self.s.buckets - 1)

    def repeats(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets for windows of 1, 2 and 3 words that came before in the text and for those that are new, and how many there are."""
        n, wide = len(hashes), hashes.astype(np.uint64)
        counts = []
        for k in range(REPEATS):
            if k:
                wide = (wide[:-1] ^ wide[:-1] >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + hashes[k:]
            new = len(np.unique(wide))
            counts += [max(0, n - k) - new, new]
        return self.marks, np.array(counts, np.float32)

    def count(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of a text, and how often each occurs."""
        found = text.split()
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        place: dict[bytes, int] = {}
        idx = np.array([place.setdefault(w, len(place)) for w in found])
        bucket, owner, hashes = self.grams(list(place))
        hashes = hashes[idx]
        pairs = self.pairs(hashes)
        ids, at = np.unique(np.concatenate([bucket, pairs.astype(np.int32)]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.bincount(idx)[owner], np.ones(len(pairs))]))
        marks, times = self.repeats(hashes)
        ids, n = np.concatenate([ids, marks]).astype(np.int32), np.concatenate([n, times]).astype(np.float32)
        return ids[n > 0], n[n > 0]


@dataclass
class Model:
    """logit: for each bucket, its vector times the output layer's difference of the classes; bias: of the output layer."""

    settings: Settings
    logit: np.ndarray
    bias: float


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], weight: tuple[float, float], s: Settings = Settings()) -> Model:
    """examples: (buckets, counts, class). weight: of an example of each class. Stochastic gradient descent, one document at a time."""
    rng = np.random.default_rng(s.seed)
    if len({y for _, _, y in examples}) < 2:
        share = (weight[1] + 1) / (weight[0] + weight[1] + 2)
        return Model(s, np.zeros(s.size), float(np.log(share / (1 - share))))
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.size, s.dim)).astype(np.float32)
    out, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    step, steps = 0, s.epochs * len(examples)
    for _ in range(s.epochs):
        for k in rng.permutation(len(examples)):
            ids, n, y = examples[k]
            rate = s.rate * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            share = (n / n.sum())[:, None]
            rows = vectors[ids]
            hidden = (share * rows).sum(0)
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            grad = (weight[y] * rate * p).astype(np.float32)
            down = out @ grad
            out -= np.outer(hidden, grad)
            bias -= grad
            vectors[ids] = rows - s.inner_rate * share * down
    return Model(s, (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts with a model; sums over a word's n-grams are kept for a bounded number of words."""

    KEPT = 300_000

    def __init__(self, m: Model):
        self.m, self.features = m, Features(m.settings)
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.total, self.size, self.hash = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        """Adds words, each once, that aren't known yet."""
        bucket, owner, hashes = self.features.grams(words)
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.total = np.concatenate([self.total, np.bincount(owner, self.m.logit[bucket], len(words))])
        self.size = np.concatenate([self.size, np.bincount(owner, minlength=len(words))])
        self.hash = np.concatenate([self.hash, hashes])

    def scores(self, texts: list[bytes]) -> list[float]:
        cut = [t.split() for t in texts]
        if len(self.at) > self.KEPT:
            self.clear()
        new = list({w for words in cut for w in words if w not in self.at})
        if new:
            self.learn(new)
        return [self.score(words) for words in cut]

    def score(self, words: list[bytes]) -> float:
        """Of a text in known words."""
        z = self.m.bias
        if words:
            idx = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            hashes = self.hash[idx]
            pairs = self.m.logit[self.features.pairs(hashes)]
            marks, times = self.features.repeats(hashes)
            z += (self.total[idx].sum() + pairs.sum() + self.m.logit[marks] @ times) / (self.size[idx].sum() + len(pairs) + times.sum())
        return float(1 / (1 + np.exp(-z)))


def held_out(id_col: str = "doc_id"):
    """True for the fold that is never learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", s: Settings = Settings()) -> Model:
    """Trains on the driver from the bucket counts of at most s.bound documents of each class, counted on the executors over whole texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(~held_out() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    there = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(s.seed)), "doc_id").limit(s.bound) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * bound rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id").dropDuplicates(["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(s)
        for b in batches:
            found = [f.count((t or "").encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], names=["doc_id", "y", "ids", "n"])

    got = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, ids binary, n binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.ids, r.n))
    used = [sum(r.y == y for r in got) for y in (0, 1)]
    all_used = max(1, len(got))
    whole = max(1, sum(there.values()))
    weight = tuple((there.get(y, 0) / whole) / (used[y] / all_used) if used[y] else 0.0 for y in (0, 1))
    if not all(used):
        weight = tuple(float(there.get(y, 0)) for y in (0, 1))
    return train([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.n, np.float32), r.y) for r in got], weight, s)


_scorers: dict[str, Scorer] = {}


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text. The broadcast model has settings.buckets numbers, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = f"{docs.sparkSession.sparkContext.applicationId}-{id(shared)}-{zlib.crc32(model.logit.tobytes())}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        scores = _scorers[key].scores
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                b = batch.slice(lo, 250)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores([(t or "").encode() for t in b.column(1).to_pylist()]), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", s: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5)."""
    scored = score_documents(docs, learn(docs, labels, label_col, s))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
