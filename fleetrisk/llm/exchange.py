"""Which keys of a chunk of documents occur in other chunks too: many small keys through few rows.

Documents are dealt to chunks by their id. A chunk sends each of its distinct keys once, as a sorted array of 32-bit values per bucket;
a bucket marks the keys that a second chunk has sent as well and answers with one bit a key, in the order sent. However often a key
occurs, a bucket gets it once from each chunk, so no key is hot. Both numbers follow spark.sql.shuffle.partitions.
32 bits and the bucket can confuse two keys: an answer "yes" is a hint that the next step verifies, an answer "no" is certain.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm.common import U64, partitions, texts

SENT = "chunk int, bucket int, payload binary"


def chunked(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and chunk."""
    n = 2 * partitions(docs.sparkSession)
    return texts(docs, *more).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))


def buckets(docs: DataFrame) -> int:
    return partitions(docs.sparkSession)


def dealt(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit value of 64-bit keys, from different bits."""
    return ((keys >> U64(32)) * U64(n)) >> U64(32), keys.astype(np.uint32)


def in_order(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in the order sent, as (bucket, value) in one number; where each bucket starts; which of them were given twice."""
    both = np.sort(placed(keys, n))
    new = np.concatenate((np.ones(min(1, len(both)), bool), both[1:] != both[:-1]))
    first = np.flatnonzero(new)
    twice = np.diff(np.append(first, len(both))) > 1
    both = both[new]
    return both, np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << U64(32)), twice


def placed(keys: np.ndarray, n: int) -> np.ndarray:
    bucket, value = dealt(keys, n)
    return (bucket << U64(32)) | value.astype(np.uint64)


def members(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in `of`: a bit table rules out nearly all others before the exact test."""
    if not len(of) or not len(values):
        return np.zeros(len(values), bool)
    bits = max(10, int(16 * len(of)).bit_length())
    fold = lambda x: (x * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)
    table = np.zeros(1 << bits, bool)
    table[fold(of)] = True
    out = table[fold(values)]
    at = np.flatnonzero(out)
    ordered = np.sort(of)
    near = np.minimum(np.searchsorted(ordered, values[at]), len(ordered) - 1)
    out[at] = ordered[near] == values[at]
    return out


def repeated(keys: np.ndarray, n: int, answers: pa.Table) -> np.ndarray:
    """For each key: another chunk has it (as far as 32 bits and the bucket tell), or this chunk has it twice."""
    both, starts, twice = in_order(keys, n)
    return members(placed(keys, n), both[answered(answers, starts) | twice])


def sent(chunk: int, both: np.ndarray, starts: np.ndarray) -> pa.Table:
    full = np.flatnonzero(np.diff(starts))
    low = both.astype(np.uint32)
    return pa.table({"chunk": pa.array(np.full(len(full), chunk, np.int32)), "bucket": pa.array(full.astype(np.int32)),
                     "payload": pa.array([low[starts[b] : starts[b + 1]].tobytes() for b in full], pa.binary())})


def answer(group: pa.Table) -> pa.Table:
    """One bucket: a bit for each key of each chunk, set if another chunk has sent the key too."""
    arrays = [np.frombuffer(x, np.uint32) for x in group["payload"].to_pylist()]
    keys = np.concatenate(arrays)
    ordered = np.sort(keys)
    same = ordered[1:] == ordered[:-1]
    twice = members(keys.astype(np.uint64), np.unique(ordered[1:][same]).astype(np.uint64))
    ends = np.cumsum([len(a) for a in arrays])
    bits = [np.packbits(twice[e - len(a) : e]).tobytes() for a, e in zip(arrays, ends)]
    return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "payload": pa.array(bits, pa.binary())})


def answered(answers: pa.Table, starts: np.ndarray) -> np.ndarray:
    """The bits of all buckets of a chunk, in the order sent."""
    out = np.zeros(starts[-1], bool)
    for b, bits in zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist()):
        n = starts[b + 1] - starts[b]
        out[starts[b] : starts[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    return out


def ask(docs: DataFrame, send: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """The answers to what send(documents of a chunk) sends: chunk, bucket, payload."""
    return docs.groupBy("chunk").applyInArrow(send, SENT).groupBy("bucket").applyInArrow(answer, SENT)
