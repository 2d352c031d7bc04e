"""Encoding whole texts with a public word-BPE tokenizer, each different word once.

The tokenizer puts A-Z in lower case, drops white space, and joins neither across it nor between a letter or digit and a sign. So a text's
ids are those of its pieces one after the other. A worker keeps the bytes and ids of the pieces it has met in a table by their 64-bit hash
(bounded: past TABLE pieces or POOL bytes of them it starts anew) and has the tokenizer encode the others. Every piece that is found is
compared with the table's byte by byte; a text in which one differs goes to the tokenizer whole, as does one that holds "<|", which may begin
a special token.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

from fleetrisk.llm.common import LOWER, U64, word_blocks

TABLE, SLOTS, POOL = 1_000_000, 1 << 21, 1 << 26
#: Of ASCII: letters and digits, and signs other than the apostrophe (which may begin "'s" and the like). Other bytes are cut from neither.
ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])
SPECIAL = b"<|"
#: The neighbours that are cut between.
PAIRS = ((ALNUM, SIGN), (SIGN, ALNUM))


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The tokenizer file for all workers (a few megabytes, whatever the corpus). path: default word_bpe_49k.json of the public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


class Encoder:
    """The ids of the word with number i are pool[start[i] : start[i] + size[i]], its bytes letters[begin[i] : begin[i] + length[i]]."""

    def __init__(self, text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.forget()

    def forget(self) -> None:
        self.keys, self.number = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64)
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.begin, self.length, self.letters = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if unknown: open addressing, all words probe together."""
        out = np.full(len(hashes), -1)
        at = (hashes & U64(SLOTS - 1)).astype(np.int64)
        key = self.keys[at]
        hit = key == hashes
        out[hit] = self.number[at[hit]]
        rest = np.flatnonzero(~hit & (key != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (SLOTS - 1)
            key = self.keys[at[rest]]
            hit = key == hashes[rest]
            out[rest[hit]] = self.number[at[rest[hit]]]
            rest = rest[~hit & (key != 0)]
        return out

    def insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        at, left = (hashes & U64(SLOTS - 1)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = hashes[left[free]]
            done = self.keys[at[left]] == hashes[left]
            self.number[at[left[done]]] = numbers[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & (SLOTS - 1)

    def learn(self, raw: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        hashes, at = np.unique(hashes, return_index=True)
        length = last[at] - first[at]
        if len(self.size) + len(hashes) > TABLE or len(self.letters) + length.sum() > POOL:
            self.forget()
        words = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(first[at].tolist(), last[at].tolist())]
        ids = [np.array(e.ids, np.uint32) for k in range(0, len(words), 1000) for e in self.tokenizer.encode_batch(words[k : k + 1000], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.insert(hashes, len(self.size) + np.arange(len(hashes)))
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.pool = np.concatenate((self.pool, *ids))
        self.begin = np.concatenate((self.begin, len(self.letters) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.letters = np.concatenate((self.letters, *[raw[a:b] for a, b in zip(first[at].tolist(), last[at].tolist())]))

    def same(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which pieces have the very bytes of the words with the numbers n."""
        length = last - first
        out = length == self.length[n]
        at = np.flatnonzero(out)
        length, ends = length[at], np.cumsum(length[at])
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
        differ = raw[np.repeat(first[at], length) + step] != self.letters[np.repeat(self.begin[n[at]], length) + step]
        if differ.any():
            out[at[np.unique(np.searchsorted(ends, np.flatnonzero(differ), side="right"))]] = False
        return out

    def numbers(self, raw: np.ndarray, at: np.ndarray):
        """Rows from i to j, the number of each of their pieces, how many pieces each row has, and the rows with a piece that has another's hash."""
        for i, j, hashes, first, last, counts in word_blocks(raw, at, PAIRS):
            hashes = np.maximum(hashes, U64(1))
            n = self.find(hashes)
            while len(lost := np.flatnonzero(n < 0)):  # again where the table began anew
                self.learn(raw, hashes[lost[:TABLE]], first[lost[:TABLE]], last[lost[:TABLE]])
                n = self.find(hashes)
            wrong = np.flatnonzero(~self.same(raw, first, last, n))
            yield i, j, n, counts, i + np.unique(np.searchsorted(np.cumsum(counts), wrong, side="right"))

    def encoded(self, data: np.ndarray) -> np.ndarray:
        return np.array(self.tokenizer.encode(data.tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def whole(self, raw: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
        """The ids of the texts that may hold special tokens."""
        data = raw.tobytes()
        rows, k = set(), data.find(SPECIAL)
        while k >= 0:
            i = int(np.searchsorted(at, k, side="right")) - 1
            rows.add(i)
            k = data.find(SPECIAL, int(at[i + 1]) - 1)
        return {i: self.encoded(raw[at[i] : at[i + 1]]) for i in rows}

    def ids(self, raw: np.ndarray, at: np.ndarray):
        """The ids of each text, in order."""
        odd = self.whole(raw, at)
        for i, _, n, counts, wrong in self.numbers(LOWER[raw], at):
            odd |= {int(k): self.encoded(raw[at[k] : at[k + 1]]) for k in wrong}
            size = self.size[n]
            ends = np.concatenate(([0], np.cumsum(size)))
            flat = self.pool[np.repeat(self.start[n] - ends[:-1], size) + np.arange(ends[-1])]
            edges = ends[np.concatenate(([0], np.cumsum(counts)))]
            for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                yield odd.get(i + k, flat[a:b])

    def lengths(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many ids each text has."""
        out = np.zeros(len(at) - 1, np.int64)
        odd = self.whole(raw, at)
        for i, j, n, counts, wrong in self.numbers(LOWER[raw], at):
            odd |= {int(k): self.encoded(raw[at[k] : at[k + 1]]) for k in wrong}
            ends = np.concatenate(([0], np.cumsum(self.size[n])))
            out[i:j] = np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])
        for i, x in odd.items():
            out[i] = len(x)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: Broadcast) -> Encoder:
    """This worker's encoder; it lives as long as the worker."""
    text = vocabulary.value
    if text not in _encoders:
        _encoders.clear()
        _encoders[text] = Encoder(text)
    return _encoders[text]
