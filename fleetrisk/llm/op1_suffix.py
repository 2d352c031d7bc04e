"""Removes the bytes that a document shares with a document of a smaller id, in common strings of a given length or more.

A suffix array over the places that matter. Every string of `length` bytes has an anchor: the piece of ANCHOR bytes in it whose hash is
least. Equal strings have equal anchors, so that only suffixes that begin at an anchor need to be compared.
1. Each chunk of documents asks which of its anchors other chunks have (exchange.py); most occur once in the corpus and are out.
2. The bytes around the others go to the bucket of their anchor, equal surroundings of a chunk once, with the smallest id.
3. A bucket sorts the suffixes that begin at its anchors, and the reversed texts before them, by mergesort. Two suffixes are compared in
   logarithmic time: prefix polynomial hashes and binary search give their common extension. All neighbours' common extensions are
   checked byte by byte afterwards; if a hash collided, the order is made anew from the bytes. Runs of long enough common extensions to
   either side are the classes of equal strings; a string goes if its class has a smaller id.
4. The chunk marks the strings found and cuts them out.

Equal surroundings count once a chunk, so inside a passage that a third of all documents share no anchor is a hot group. Near its ends the
surroundings hold each document's own text, and all rows of such an anchor meet in one bucket: that is a hot group. Matches never cross
documents.
Null texts are empty. A null doc_id counts as larger than all others; equal ids never remove each other's bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm import exchange
from fleetrisk.llm.common import U64, blocks, flat, mixed, rolling

ANCHOR = 24
BASE = 0xD6E8FEB86659FD93
LAST = 2**63 - 1
#: Rows that a bucket sorts at a time, about.
ROWS = 50_000


def sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum or maximum) over every `width` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        values, done = of(values[:-done], values[done:]), 2 * done
    return of(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def anchors(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, document and 64-bit hash of every anchor of every string of `length` bytes within a document."""
    places, of, hashes = [], [], []
    reach = length - ANCHOR + 1
    for i, j in blocks(at):
        part, ends = raw[at[i] : at[j]], at[i + 1 : j + 1] - at[i]
        n = len(part)
        if n < length:
            continue
        h = mixed(rolling(part.astype(np.uint64) + U64(1), ANCHOR, BASE))
        rank = (h >> U64(32)).astype(np.uint32) | np.uint32(1)
        least = sliding(rank, reach, np.minimum)
        whole = np.zeros(n + 1, np.int8)
        starts = np.concatenate(([0], ends[:-1]))
        long = ends - starts >= length
        whole[starts[long]] += 1
        whole[ends[long] - length + 1] -= 1
        least[np.cumsum(whole)[: len(least)] == 0] = 0
        side = np.zeros(reach - 1, np.uint32)
        chosen = np.flatnonzero(sliding(np.concatenate((side, least, side)), reach, np.maximum) == rank)
        places.append(chosen + at[i])
        hashes.append(mixed(h[chosen] + U64(1)))  # anew, as the least hashes are all small
        of.append(np.searchsorted(ends, chosen, side="right") + i)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(of), np.concatenate(hashes)


def shared_here(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hashes that two documents of this chunk with different ids have."""
    order = np.argsort(hashes)
    h, d = hashes[order], ids[order]
    return np.unique(h[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])])


class Surroundings:
    """The distinct surroundings of a chunk's shared anchors, in the order sent: by bucket, then by bytes."""

    def __init__(self, table: pa.Table, answers: pa.Table, length: int, n: int):
        self.raw, self.at = flat(table["text"])
        self.ids = table["doc_id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)
        place, of, hashes = anchors(self.raw, self.at, length)
        both, starts, _ = exchange.in_order(hashes, n)
        wanted = np.concatenate((both[exchange.answered(answers, starts)], exchange.placed(shared_here(hashes, self.ids[of]), n)))
        keep = exchange.members(exchange.placed(hashes, n), wanted)
        self.place, of, hashes = place[keep], of[keep], hashes[keep]
        self.id_of = self.ids[of]
        before = length - ANCHOR
        left = np.minimum(self.place - self.at[of], before)
        right = np.minimum(self.at[of + 1] - self.place, length)
        rows = np.zeros((len(self.place), before + length + 2), np.uint8)
        for k in range(before):
            has = left >= before - k
            rows[has, k] = self.raw[self.place[has] - (before - k)]
        for k in range(length):
            has = right > k
            rows[has, before + k] = self.raw[self.place[has] + k]
        rows[:, -2], rows[:, -1] = left, right
        bucket = exchange.dealt(hashes, n)[0].astype(np.int64)
        text = rows.view(f"S{rows.shape[1]}").ravel() if len(rows) else np.zeros(0, "S1")
        order = np.lexsort((self.id_of, text, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (text[order][1:] != text[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        first = order[new]
        self.place_of = np.empty(len(order), np.int64)
        self.place_of[order] = np.cumsum(new) - 1
        self.rows, self.least, self.bucket = rows[first], self.id_of[first], bucket[first]
        self.left, self.right = left, right

    def starts(self, n: int) -> np.ndarray:
        return np.searchsorted(self.bucket, np.arange(n + 1))


def common(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows a and b, at most `most`: binary search over their prefix hashes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = hashes[a, middle] == hashes[b, middle]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_order(text: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each group (they lie together) in the order of their texts, and each row's common length with the row before it (-1: none).

    Mergesort: runs of one row, of two, of four ... meet; a row's place in the merged run is its own place plus the number of rows of
    the other run that go before it, found by binary search with compared prefix hashes.
    """
    n, width = text.shape
    hashes = np.zeros((n, width + 1), np.uint64)
    for k in range(width):
        hashes[:, k + 1] = hashes[:, k] * U64(BASE) + text[:, k].astype(np.uint64) + U64(1)
    size = size.astype(np.int64)
    begin = np.searchsorted(group, group, side="left")
    end = np.searchsorted(group, group, side="right")
    order, spot = np.arange(n), np.arange(n)

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Row a goes before row b; equal texts do if ties says so."""
        same = common(hashes, a, b, np.minimum(size[a], size[b]))
        one = np.where(same < size[a], text[a, np.minimum(same, width - 1)].astype(np.int64), -1)
        two = np.where(same < size[b], text[b, np.minimum(same, width - 1)].astype(np.int64), -1)
        return (one < two) | ((one == two) & ties)

    run = 1
    while n and run < (end - begin).max():
        active = np.flatnonzero(end - begin > run)
        own = (spot[active] - begin[active]) // run
        other = own ^ 1
        low = np.minimum(begin[active] + other * run, end[active])
        high = np.minimum(low + run, end[active])
        base, ties = low.copy(), other < own
        row = order[active]
        while (open_ := low < high).any():
            at = np.flatnonzero(open_)
            middle = (low[at] + high[at]) // 2
            ahead = before(order[middle], row[at], ties[at])
            low[at], high[at] = np.where(ahead, middle + 1, low[at]), np.where(ahead, high[at], middle)
        target = begin[active] + np.minimum(own, other) * run + (active - begin[active] - own * run) + (low - base)
        fresh = order.copy()
        fresh[target] = row
        order, run = fresh, 2 * run
    a, b = order[:-1], order[1:]
    near = np.concatenate(([-1], np.where(group[1:] == group[:-1], common(hashes, a, b, np.minimum(size[a], size[b])), -1)))[:n]
    exact = np.where((text[a] != text[b]).any(axis=1), (text[a] != text[b]).argmax(axis=1), width)
    exact = np.concatenate(([-1], np.where(group[1:] == group[:-1], np.minimum(exact, np.minimum(size[a], size[b])), -1)))[:n]
    if (exact != near).any():  # two different texts had one hash
        order = np.lexsort((size, np.ascontiguousarray(text).view(f"S{width}").ravel(), group))
        a, b = order[:-1], order[1:]
        differ = text[a] != text[b]
        exact = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        exact = np.concatenate(([-1], np.where(group[1:] == group[:-1], np.minimum(exact, np.minimum(size[a], size[b])), -1)))[:n]
    return order, exact


def found(ids: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far before and after its anchor each row's text is found under a smaller id (0, 0: nowhere)."""
    before = length - ANCHOR
    text = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    order = np.lexsort((ids, text))
    new = np.ones(len(order), bool)
    new[1:] = text[order][1:] != text[order][:-1]
    single = order[new]
    least = np.empty(len(order), np.int64)
    least[order] = ids[single][np.cumsum(new) - 1]
    left, right = np.zeros(len(rows), np.uint8), np.zeros(len(rows), np.uint8)
    later = ids > least
    left[later], right[later] = rows[later, -2], rows[later, -1]
    # One row for each different text goes on, where its anchor has several.
    weights = U64(BASE) ** np.arange(ANCHOR, dtype=np.uint64)
    anchor = mixed((rows[single, before : before + ANCHOR].astype(np.uint64) + U64(1)) @ weights)
    by = np.argsort(anchor, kind="stable")
    _, group, many = np.unique(anchor[by], return_inverse=True, return_counts=True)
    go = many[group] > 1
    mine, group = single[by][go], group[go]
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    at = 0
    while at < len(mine):  # some anchors at a time; one anchor's rows stay together
        later = edges[edges >= at + ROWS]
        to = int(later[0]) if len(later) else len(mine)
        left[mine[at:to]], right[mine[at:to]] = matched(ids[mine[at:to]], rows[mine[at:to]], group[at:to], length)
        at = to
    return left, right


def matched(ids: np.ndarray, rows: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """found() for rows of different texts, where rows with one anchor lie together and have one number in group."""
    before = length - ANCHOR
    size_l, size_r = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    order_r, near_r = suffix_order(np.ascontiguousarray(rows[:, before : before + length]), size_r, group)
    order_l, near_l = suffix_order(np.ascontiguousarray(rows[:, :before][:, ::-1]), size_l, group)
    left, right = np.zeros(len(rows), np.uint8), np.zeros(len(rows), np.uint8)
    class_l, class_r = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for k in range(before + 1):  # strings that begin k bytes before the anchor
        class_r[order_r] = np.cumsum(near_r < length - k)
        class_l[order_l] = np.cumsum(near_l < k)
        fit = np.flatnonzero((size_l >= k) & (size_r >= length - k))
        if len(fit) > 1:
            key = class_r[fit] * (len(rows) + 1) + class_l[fit]
            o = np.argsort(key)
            first = np.flatnonzero(np.concatenate(([True], key[o][1:] != key[o][:-1])))
            smallest = np.repeat(np.minimum.reduceat(ids[fit[o]], first), np.diff(np.append(first, len(o))))
            hit = fit[o][ids[fit[o]] > smallest]
            left[hit] = np.maximum(left[hit], k)
            right[hit] = np.maximum(right[hit], length - k)
    return left, right


def remove(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (first and past-the-last byte of each maximal run removed), kept (the bytes left).

    length: 26 to 229 bytes.
    """
    if not ANCHOR + 2 <= length <= 229:
        raise ValueError("length must be from 26 to 229")
    n, width = exchange.buckets(docs), 2 * length - ANCHOR + 2
    dealt = exchange.chunked(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")))

    def send_anchors(table: pa.Table) -> pa.Table:
        _, _, hashes = anchors(*flat(table["text"]), length)
        both, starts, _ = exchange.in_order(hashes, n)
        return exchange.sent(table["chunk"][0].as_py(), both, starts)

    def send_rows(table: pa.Table, answers: pa.Table) -> pa.Table:
        s = Surroundings(table, answers, length, n)
        starts = s.starts(n)
        full = np.flatnonzero(np.diff(starts))
        chunk = np.full(len(full), table["chunk"][0].as_py() if len(table) else 0, np.int32)
        payload = [s.least[starts[b] : starts[b + 1]].tobytes() + s.rows[starts[b] : starts[b + 1]].tobytes() for b in full]
        return pa.table({"chunk": chunk, "bucket": full.astype(np.int32), "payload": pa.array(payload, pa.binary())})

    def answer_rows(group: pa.Table) -> pa.Table:
        parts = [x.as_buffer() for x in group["payload"]]
        many = [len(p) // (8 + width) for p in parts]
        ids = np.concatenate([np.frombuffer(p, np.int64, m) for p, m in zip(parts, many)])
        rows = np.concatenate([np.frombuffer(p, np.uint8, m * width, 8 * m).reshape(m, width) for p, m in zip(parts, many)])
        left, right = found(ids, rows, length)
        ends = np.cumsum(many)
        payload = [left[e - m : e].tobytes() + right[e - m : e].tobytes() for e, m in zip(ends, many)]
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "payload": pa.array(payload, pa.binary())})

    def finish(table: pa.Table, first: pa.Table) -> pa.Table:
        anchors_known, rows_known = first.filter(pc.equal(first["step"], 1)), first.filter(pc.equal(first["step"], 2))
        s = Surroundings(table, anchors_known, length, n)
        starts = s.starts(n)
        left, right = np.zeros(len(s.rows), np.int64), np.zeros(len(s.rows), np.int64)
        for b, x in zip(rows_known["bucket"].to_pylist(), rows_known["payload"].to_pylist()):
            m = starts[b + 1] - starts[b]
            left[starts[b] : starts[b + 1]] = np.frombuffer(x, np.uint8, m)
            right[starts[b] : starts[b + 1]] = np.frombuffer(x, np.uint8, m, m)
        later = s.id_of > s.least[s.place_of]
        left = np.where(later, s.left, left[s.place_of])
        right = np.where(later, s.right, right[s.place_of])
        hit = right > 0
        step = np.zeros(len(s.raw) + 1, np.int32)
        np.add.at(step, (s.place - left)[hit], 1)
        np.add.at(step, (s.place + right)[hit], -1)
        gone = np.cumsum(step[:-1]) > 0
        removed, spans, kept = [], [], []
        for a, b in zip(s.at[:-1], s.at[1:]):
            g = gone[a:b]
            if g.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                spans.append([{"first": int(x), "past": int(y)} for x, y in edges.reshape(-1, 2)])
                kept.append(s.raw[a:b][~g].tobytes())
            else:
                spans.append([])
                kept.append(s.raw[a:b].tobytes())
            removed.append(int(g.sum()))
        return pa.table({"doc_id": table["doc_id"], "n_bytes": np.diff(s.at), "n_removed": pa.array(removed, pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    known = exchange.ask(dealt, send_anchors)
    rows = dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(send_rows, exchange.SENT).groupBy("bucket").applyInArrow(answer_rows, exchange.SENT)
    both = known.withColumn("step", F.lit(1)).unionByName(rows.withColumn("step", F.lit(2)))
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<first: bigint, past: bigint>>, kept binary")
