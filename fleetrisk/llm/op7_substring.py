"""Removes every word that lies in a word window which occurs anywhere else too.

Rabin-Karp hashes of all fixed-length word windows are counted across the corpus; covered words merge into maximal removal intervals.
The count has two rounds. First each chunk of documents asks which of its window hashes other chunks have (exchange.py: 32 bits a window);
a window that no other place has is out. The rest ask again with 64 bits of a second hash, made anew from the bytes of the words with other
moduli (two primes). A window goes if both say yes, so that about 90 bits of unrelated hashes must agree before a unique word is lost.

Null texts have no words. Fewer words than a window: nothing is removed. All occurrences of a repeated window go, in one document as well.
Rows that repeat a doc_id are documents of their own. A null doc_id is dealt like any other value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetrisk.llm import exchange
from fleetrisk.llm.common import flat, grams, word_hashes

BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def windows(table: pa.Table, width: int, second: bool) -> tuple[np.ndarray, np.ndarray]:
    """The first or second hash of every window of every document, and how many windows each has."""
    words, counts = word_hashes(*flat(table["text"]), second)
    return grams(words, counts, width, BASES[second])


def remove(docs: DataFrame, width: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, spans (array of first and past-the-last word of each maximal run removed), kept (the text left)."""
    n = exchange.buckets(docs)
    dealt = exchange.chunked(docs)

    def send_first(table: pa.Table) -> pa.Table:
        first, _ = windows(table, width, False)
        both, starts, _ = exchange.in_order(first, n)
        return exchange.sent(table["chunk"][0].as_py(), both, starts)

    def send_second(table: pa.Table, answers: pa.Table) -> pa.Table:
        (first, _), (second, _) = windows(table, width, False), windows(table, width, True)
        left = np.unique(second[exchange.repeated(first, n, answers)])
        bucket = exchange.dealt(left, n)[0]
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(n + 1))
        full = np.flatnonzero(np.diff(starts))
        chunk = np.full(len(full), table["chunk"][0].as_py() if len(table) else 0, np.int32)
        return pa.table({"chunk": chunk, "bucket": full.astype(np.int32), "payload": pa.array([left[order[starts[b] : starts[b + 1]]].tobytes() for b in full], pa.binary())})

    def answer_second(group: pa.Table) -> pa.Table:
        """The hashes of each chunk that other chunks have sent too, whole."""
        arrays = [np.frombuffer(x, np.uint64) for x in group["payload"].to_pylist()]
        ordered = np.sort(np.concatenate(arrays))
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        found = [a[exchange.members(a, twice)].tobytes() for a in arrays]
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "payload": pa.array(found, pa.binary())})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        second, many = windows(table, width, True)
        raw, at = flat(table["text"])
        data = raw.tobytes()
        words = [data[at[i] : at[i + 1]].split() for i in range(len(many))]
        known = [np.frombuffer(x, np.uint64) for x in answers["payload"].to_pylist()]
        ordered = np.sort(second)
        here = ordered[1:][ordered[1:] == ordered[:-1]]
        hit = exchange.members(second, np.unique(np.concatenate([here, *known])))
        begin = np.concatenate(([0], np.cumsum(many)))
        removed, spans, kept = [], [], []
        for i, w in enumerate(words):
            starts = np.flatnonzero(hit[begin[i] : begin[i + 1]])
            if len(starts):
                step = np.zeros(len(w) + 1, np.int32)
                step[starts] += 1
                step[starts + width] -= 1
                covered = np.cumsum(step[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
                pairs = edges.reshape(-1, 2)
                left = [b" ".join(w[a:b]) for a, b in zip([0, *pairs[:, 1]], [*pairs[:, 0], len(w)]) if a < b]
                removed.append(int(covered.sum()))
                spans.append([{"first": int(a), "past": int(b)} for a, b in pairs])
                kept.append(b" ".join(left))
            else:
                removed.append(0)
                spans.append([])
                kept.append(b" ".join(w))
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array([len(w) for w in words], pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))), "kept": pa.array([k.decode() for k in kept], pa.string())})

    first = exchange.ask(dealt, send_first)
    second = dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(send_second, exchange.SENT).groupBy("bucket").applyInArrow(answer_second, exchange.SENT)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(second.groupBy("chunk")).applyInArrow(finish, f"doc_id {kind}, n_words bigint, n_removed bigint, spans array<struct<first: bigint, past: bigint>>, kept string")
