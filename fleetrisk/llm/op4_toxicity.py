"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features of a text, each once: its words, pairs of neighbours, and pairs with one word between, hashed to 2^BITS places. Words are in lower
case and cut from signs. Each coordinate has its own learning rate; the L1 term holds all but the telling weights at zero, so that the
model is a few thousand weights at most, which are broadcast to score every text where it is read.

The model learns from at most `rows` labelled documents (learning.sample). Null and empty texts have no features: their score is the
bias's, a number from 0 to 1 as any other. Without labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm.common import LOWER, U64, flat, mixed, rolling, texts, word_blocks
from fleetrisk.llm.learning import learned_texts, remainder, sample
from fleetrisk.llm.tokens import PAIRS

BITS = 20
NEXT, SKIP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def places(raw: np.ndarray, at: np.ndarray):
    """Block by block: rows from i to j, the places of all their features, and each one's row (from i)."""
    for i, j, words, _, _, counts in word_blocks(LOWER[raw], at, PAIRS):
        of = np.repeat(np.arange(j - i), counts)
        out, rows = [words], [of]
        if len(words) > 1:
            same = of[1:] == of[:-1]
            out.append(mixed(rolling(words, 2, NEXT))[same])
            rows.append(of[1:][same])
        if len(words) > 2:
            same = of[2:] == of[:-2]
            out.append(mixed(words[:-2] * U64(SKIP) + words[2:] + U64(1))[same])
            rows.append(of[2:][same])
        yield i, j, (np.concatenate(out) >> U64(64 - BITS)).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """FTRL-proximal for 0/1 features; the bias is a coordinate of its own, without L1."""

    def __init__(self, alpha: float = 3.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        all_ = np.arange((1 << BITS) + 1)
        w = self.weights(all_)
        return all_[w != 0], w[w != 0]


def train(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = 20_000, epochs: int = 8, weight: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights other than zero; the last place, 2^BITS, is the bias. weight: how often a document of label 1 counts."""
    def extract(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            features: list[bytes] = []
            for i, j, at, of in places(*flat(t["text"])):
                both = np.unique((of << BITS) | at)
                edges = np.searchsorted(both, np.arange(j - i + 1) << BITS)
                low = (both & ((1 << BITS) - 1)).astype(np.uint32)
                features += [low[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.binary())], ["doc_id", "label", "features"])

    def fit(batches):
        held = [(y, np.frombuffer(x, np.uint32)) for b in batches for y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        model = Ftrl()
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(held)):
                for _ in range(weight if held[k][0] else 1):
                    model.learn(held[k][1].astype(np.int64), held[k][0])
        at, w = model.model() if held else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], ["at", "w"])

    rows_of = learned_texts(docs, sample(labels, label, folds, held_out, rows)).select("doc_id", "label", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ready = rows_of.mapInArrow(extract, f"doc_id {kind}, label int, features binary")
    # The sample is bounded, so one task may hold its features.
    one = ready.repartition(1).sortWithinPartitions("doc_id", "label").select("label", "features")
    found = one.mapInArrow(fit, "at bigint, w double").toPandas()
    return found["at"].to_numpy(np.int64), found["w"].to_numpy(float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], folds: int, held_out: int, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        at, w = known.value
        weights = np.zeros((1 << BITS) + 1)
        weights[at] = w
        telling = weights != 0
        for batch in batches:
            raw, ends = flat(pa.Table.from_batches([batch])["text"])
            total = np.full(len(ends) - 1, weights[-1])
            for i, j, place, of in places(raw, ends):
                hit = np.flatnonzero(telling[place])
                both = np.unique((of[hit] << BITS) | place[hit])
                total[i:j] += np.bincount(both >> BITS, weights[both & ((1 << BITS) - 1)], minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = texts(docs).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    return score(docs, train(docs, labels, "toxic", folds, held_out), folds, held_out)
