"""Quality: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words (its whole text, however long). Every passage is encoded; gated attention, learned from
the documents' labels alone, weighs the passages; the score is a logistic function of the weighted sum of their encodings. So a bad passage
counts for what it is, not for its share of the text.

A passage is described by shares of kinds of bytes, by its words' lengths, ends and repetitions, and by how far its words repeat those of the
passage before. The network is small (numpy, Adam) and is trained in one task on a bounded sample (learning.sample: at most `rows` labelled
documents, of which it holds the features of all passages, 72 bytes for 64 words); it scores all passages of all texts where they are read.

Null and empty texts are one passage without words, told by a feature of its own. Without labels every score is 0.5, and as a filter rejects
nothing.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm.common import U64, flat, texts, word_blocks
from fleetrisk.llm.learning import learned_texts, remainder, sample

PASSAGE = 64
_BYTE = np.arange(256)
_KINDS = [(_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 97) & (_BYTE <= 122), (_BYTE >= 48) & (_BYTE <= 57), np.isin(_BYTE, [44, 46]), np.isin(_BYTE, [33, 63]),
          (_BYTE >= 33) & (_BYTE < 127) & ~np.isin(_BYTE, [33, 39, 44, 46, 63]) & ~((_BYTE >= 48) & (_BYTE <= 57)) & ~((_BYTE >= 65) & (_BYTE <= 90)) & ~((_BYTE >= 97) & (_BYTE <= 122)), _BYTE >= 128, _BYTE == 10]
N_FEATURES = len(_KINDS) + 10


def passages(raw: np.ndarray, at: np.ndarray):
    """Block by block: rows from i to j, the features of all their passages, how many passages each row has."""
    for i, j, words, first, last, counts in word_blocks(raw, at):
        many = np.maximum(1, -(-counts // PASSAGE))
        ends = np.cumsum(counts)
        row = np.repeat(np.arange(j - i), many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        a = (ends - counts)[row] + nth * PASSAGE
        b = np.minimum(a + PASSAGE, ends[row])
        n = b - a
        x = np.zeros((len(row), N_FEATURES), np.float32)
        full = np.flatnonzero(n > 0)
        if len(full):
            a_, b_, m = a[full], b[full], n[full]
            base = at[i]
            begin, stop = first[a_] - base, last[b_ - 1] - base
            part = raw[at[i] : at[j]]
            size = (stop - begin).astype(float)
            for k, kind in enumerate(_KINDS):
                total = np.concatenate(([0], np.cumsum(kind[part], dtype=np.int32)))
                x[full, k] = (total[stop] - total[begin]) / size
            k = len(_KINDS)
            of = np.repeat(np.arange(len(full)), m)
            place = np.repeat(a_ - (np.cumsum(m) - m), m) + np.arange(m.sum())
            share = lambda flag: np.bincount(of, flag, minlength=len(full)) / m
            length = (last - first)[place]
            x[full, k] = share(length) / 10
            x[full, k + 1] = share(length <= 2)
            x[full, k + 2] = share(length >= 15)
            tail, head = raw[last[place] - 1], raw[first[place]]
            x[full, k + 3] = share((tail == 46) | (tail == 44))
            x[full, k + 4] = share((tail < 128) & (tail > 32) & ~np.isin(tail, [39, 44, 46]) & ~((tail | 32) >= 97) & ~((tail >= 48) & (tail <= 57)))
            x[full, k + 5] = share((head >= 65) & (head <= 90))
            h = words[place]
            key = np.sort((of.astype(np.uint64) << U64(40)) | (h >> U64(24)))
            new = np.concatenate(([True], key[1:] != key[:-1]))
            x[full, k + 6] = np.bincount((key[new] >> U64(40)).astype(np.int64), minlength=len(full)) / m
            again = np.zeros(len(h))
            again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
            x[full, k + 7] = share(again)
            x[full, k + 8] = np.log1p(m) / 4
        x[n == 0, N_FEATURES - 1] = 1
        yield i, j, x, many


class Network:
    """Encoder, gated attention and classifier; softmax within bags that lie one behind the other."""

    SHAPES = {"W": (N_FEATURES, 16), "b": (16,), "V": (16, 8), "U": (16, 8), "w": (8,), "o": (16,), "c": (1,)}

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "wo" else np.zeros(s) for k, s in self.SHAPES.items()}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def forward(self, x: np.ndarray, many: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, np.clip((x - self.mean) / self.scale, -8, 8)
        begin, of = np.cumsum(many) - many, np.repeat(np.arange(len(many)), many)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, begin)[of])
        a = e / np.add.reduceat(e, begin)[of]
        z = np.add.reduceat(a[:, None] * h, begin)
        s = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"][0], -50, 50)))
        return {"x": x, "of": of, "begin": begin, "h": h, "v": v, "u": u, "a": a, "z": z, "s": s}

    def gradients(self, f: dict[str, np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, of, a, h, v, u = self.p, f["of"], f["a"], f["h"], f["v"], f["u"]
        d = weight * (f["s"] - y) / weight.sum()
        dz = d[:, None] * p["o"]
        da = (h * dz[of]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, f["begin"])[of])
        dvu = de[:, None] * p["w"]
        dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
        dh = (a[:, None] * dz[of] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "o": f["z"].T @ d, "c": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.01, decay: float = 1e-5) -> None:
        x = np.concatenate(bags)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        weight = np.where(y == 0, max(1.0, min(5.0, (y == 1).sum() / max(1, (y == 0).sum()))), 1.0)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(bags) // batch)
        for epoch in range(epochs):
            order = np.random.default_rng(epoch).permutation(len(bags))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                f = self.forward(np.concatenate([bags[i] for i in own]), np.array([len(bags[i]) for i in own]))
                step += 1
                now = rate * (1 - step / (steps + 1))
                for k, g in self.gradients(f, y[own], weight[own]).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    q[k] = 0.999 * q[k] + 0.001 * g * g
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)


def train(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = 20_000, epochs: int = 12) -> Network | None:
    def extract(batches):
        for batch in batches:
            features: list[bytes] = []
            for _, _, x, many in passages(*flat(pa.Table.from_batches([batch])["text"])):
                features += [own.tobytes() for own in np.split(x, np.cumsum(many)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.binary())], ["doc_id", "label", "features"])

    def fit(batches):
        held = [(y, np.frombuffer(x, np.float32).reshape(-1, N_FEATURES)) for b in batches for y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if held:
            network = Network()
            network.fit([x for _, x in held], np.array([y for y, _ in held], float), epochs)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((network.p, network.mean, network.scale))], pa.binary())], ["model"])

    rows_of = learned_texts(docs, sample(labels, label, folds, held_out, rows)).select("doc_id", "label", "text")
    ready = rows_of.mapInArrow(extract, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, features binary")
    # The sample is bounded, so one task may hold its features.
    found = ready.repartition(1).sortWithinPartitions("doc_id", "label").select("label", "features").mapInArrow(fit, "model binary").collect()
    if not found:
        return None
    network = Network()
    network.p, network.mean, network.scale = pickle.loads(found[0].model)
    return network


def scorer(docs: DataFrame, network: Network | None):
    """A function from a text column (Arrow) to scores, for the tasks."""
    known = docs.sparkSession.sparkContext.broadcast(None if network is None else (network.p, network.mean, network.scale))

    def run(column: pa.ChunkedArray) -> np.ndarray:
        raw, at = flat(column)
        out = np.full(len(at) - 1, 0.5)
        if known.value is not None:
            net = Network()
            net.p, net.mean, net.scale = known.value
            for i, j, x, many in passages(raw, at):
                out[i:j] = net.forward(x, many)["s"]
        return out

    return run


def score(docs: DataFrame, network: Network | None, folds: int, held_out: int, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    of = scorer(docs, network)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(pa.Table.from_batches([batch])["text"]))], ["doc_id", "score"])

    out = texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    return score(docs, train(docs, labels, "quality", folds, held_out), folds, held_out)


def keep(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """Rows of docs, with all their columns, that score threshold or more; learned from the texts in learn_from. Nothing is shuffled.

    Without any label to learn from, all rows stay."""
    network = train(learn_from, labels, "quality", folds, held_out)
    if network is None:
        return docs
    of = scorer(docs, network)

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            good = of(t["text"].fill_null("")) >= threshold
            yield from t.filter(pa.array(good)).to_batches()

    return docs.mapInArrow(run, docs.schema)
