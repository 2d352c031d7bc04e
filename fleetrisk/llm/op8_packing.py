"""Harmonic packing of documents into training sequences.

Lengths fall into classes by the reciprocal of the capacity: class k holds lengths from capacity/(k+1) to capacity/k, and a sequence of
class k takes k pieces, however long. Each worker fills the sequences of its own pieces; no sequence needs a look at another worker.
Since documents may be cut, a length that would leave much of its sequences empty is cut: whole sequences first, then the largest
capacity/k that fits, until what is left fills its class up to `slack` of the capacity or is shorter than `least`. How a document is cut
depends on its length alone, so pieces and their checksums are made where the text is read, and only short rows are shuffled.
Pieces left over from incomplete sequences of a worker are packed together, longest first, each into the first sequence with room.

Null and empty texts are one closing id. Rows that repeat a doc_id are documents of their own. The closing id counts into doc_tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm.common import flat, partitions, texts
from fleetrisk.llm.tokens import encoder, vocabulary

CLOSING = 1


def cuts(n: int, capacity: int, slack: float, least: int) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if n < least or k * n >= capacity * (1 - slack):
            out.append(n)
            break
        piece = capacity // (k + 1)
        out.append(piece)
        n -= piece
    return out


def pieces(docs: DataFrame, capacity: int = 2048, slack: float = 1 / 64, least: int = 24, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: the pieces of every document."""
    known = vocabulary(docs.sparkSession, tokenizer)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, at = flat(pa.Table.from_batches([batch])["text"])
            row, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encoder(known).ids(raw, at)):
                ids = np.append(ids, np.uint32(CLOSING)).astype("<u4")
                a = 0
                for n in cuts(len(ids), capacity, slack, least):
                    row.append(i)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[a : a + n].tobytes()))
                    total.append(len(ids))
                    a += n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts(docs).mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def arrange(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece of a worker, whose pieces are in a fixed order."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    classes = capacity // lengths
    order = np.lexsort((np.arange(len(lengths)), -lengths, classes))
    begin = np.flatnonzero(np.concatenate(([True], np.diff(classes[order]) != 0))) if len(order) else []
    free, rest = 0, []
    for a, b in zip(begin, [*begin[1:], len(order)]):
        k = classes[order[a]]
        full = (b - a) // k
        own = order[a : a + full * k].reshape(full, k)
        sequence[own] = free + np.arange(full)[:, None]
        offset[own] = np.cumsum(lengths[own], axis=1) - lengths[own]
        free += full
        rest += order[a + full * k : b].tolist()
    filled: list[int] = []
    first = 0
    for i in sorted(rest, key=lambda i: (-lengths[i], i)):
        while first < len(filled) and filled[first] == capacity:
            first += 1
        at = next((s for s in range(first, len(filled)) if filled[s] + lengths[i] <= capacity), len(filled))
        if at == len(filled):
            filled.append(0)
        sequence[i], offset[i] = free + at, filled[at]
        filled[at] += int(lengths[i])
    return sequence, offset


def pack(docs: DataFrame, capacity: int = 2048, slack: float = 1 / 64, least: int = 24, tokenizer: str | None = None) -> DataFrame:
    """The pieces with sequence_id and offset. A worker's number is the upper part of its sequences' ids."""
    made = pieces(docs, capacity, slack, least, tokenizer)
    workers = partitions(docs.sparkSession)

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = arrange(group["length"].to_numpy(), capacity)
        worker = group["worker"][0].as_py()
        return group.drop_columns(["worker"]).append_column("sequence_id", pa.array(sequence + (worker << 40))).append_column("offset", pa.array(offset))

    schema = made.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"
    return made.withColumn("worker", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(workers))).groupBy("worker").applyInArrow(place, schema.replace(":", " ").replace(",", ", "))
