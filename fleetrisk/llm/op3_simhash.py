"""SimHash near-dedup: 64-bit fingerprints, linked when at most `radius` bits differ, exactly.

Fingerprints are compared in tiles with numpy exclusive-or and bit counts; tile pairs whose population counts differ beyond the radius are
skipped. All pairs of tiles of the corpus would be quadratic, so the tiles are taken from blocks: the 64 bits fall into radius + 2 pieces;
fingerprints that differ in at most `radius` bits agree on two pieces at least, so each pair meets in the block of some two pieces (10
blocks a fingerprint at radius 3, of about 25 bits each). No pair is lost. Each distinct fingerprint goes through once, however many
documents have it, and a block returns a spanning forest of its links instead of all pairs.

Components of the links: alternating large-star and small-star rounds, each written to the shared folder, until nothing changes.

Words are runs without ASCII white space, A-Z in lower case; shingles of `width` words, repeats included. Fewer words: the whole sequence is the
one shingle. No words (null or empty text): fingerprint zero, linked like any other. Rows without an id, and rows that share an id, are
documents of their own; a null id counts as larger than all others.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.llm.common import LOWER, U64, cut, flat, join_hot, partitions, texts
from fleetrisk.llm.op2_exact import row_key

#: Fingerprints in a tile.
TILE = 2048


def fingerprint(text: bytes, width: int) -> int:
    """text: lower-cased."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 65536):
        b = min(n, a + 65536)
        h = np.fromiter((digest(joined[x:y], 42) for x, y in zip(starts[a:b].tolist(), ends[a + width - 1 : b + width - 1].tolist())), np.uint64, b - a)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in more, fp (the 64 bits as a signed number)."""
    def run(batches):
        for batch in batches:
            raw, at = flat(pa.Table.from_batches([batch])["text"])
            data = LOWER[raw].tobytes()
            fps = np.array([fingerprint(data[a:b], width) for a, b in zip(at[:-1], at[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(fps.view(np.int64))], [*names, "fp"])

    names = ["doc_id", *more]
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in names]
    return texts(docs, *more).mapInArrow(run, ", ".join([*kinds, "fp bigint"]))


def pieces(radius: int) -> list[tuple[int, int]]:
    """First bit and width of each of radius + 2 pieces."""
    n = radius + 2
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_keys(fps: np.ndarray, radius: int) -> list[np.ndarray]:
    """For each choice of two pieces: their bits of each fingerprint, with the choice's number in the upper bits."""
    parts = [(fps >> U64(a)) & U64((1 << w) - 1) for a, w in pieces(radius)]
    widths = [w for _, w in pieces(radius)]
    return [(U64(k) << U64(56)) | (parts[i] << U64(widths[j])) | parts[j] for k, (i, j) in enumerate(combinations(range(radius + 2), 2))]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a block of distinct fingerprints: pairs of places."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    fps = fps[order]
    ones = np.bitwise_count(fps).astype(np.int64)
    root = np.arange(len(fps))
    edges: list[tuple[int, int]] = []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(0, len(fps), TILE):
        for b in range(a, len(fps), TILE):
            if ones[b] - ones[min(a + TILE, len(fps)) - 1] > radius:
                break
            near = np.bitwise_count(fps[a : a + TILE, None] ^ fps[None, b : b + TILE]) <= radius
            if a == b:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            for i, j in zip((x + a).tolist(), (y + b).tolist()):
                u, v = top(i), top(j)
                if u != v:
                    root[v] = u
                    edges.append((int(order[i]), int(order[j])))
    return edges


def linked(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within blocks (equal keys): of blocks of two all at once, of larger ones by tiles."""
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    many = np.diff(np.append(begin, len(keys)))
    two = begin[many == 2]
    two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
    left, right = [fps[two]], [fps[two + 1]]
    for b, m in zip(begin[many > 2], many[many > 2]):
        own = fps[b : b + m]
        if edges := forest(own, radius):
            x, y = np.array(edges).T
            left.append(own[x])
            right.append(own[y])
    return np.concatenate(left), np.concatenate(right)


def links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """a, b: links between the distinct fingerprints in column fp, enough of them to connect all that all links connect."""
    n = partitions(classes.sparkSession)

    def deal(batches):
        """Fingerprints with their keys, packed per bucket of keys."""
        held = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        fps = np.concatenate(held).view(np.uint64) if held else np.zeros(0, np.uint64)
        if not len(fps):
            return
        keys = block_keys(fps, radius)
        fps, keys = np.tile(fps, len(keys)), np.concatenate(keys)
        bucket = ((keys * U64(0x9E3779B97F4A7C15)) >> U64(32)) * U64(n) >> U64(32)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(n + 1))
        full = np.flatnonzero(np.diff(starts))
        rows = [np.concatenate((keys[o := order[starts[b] : starts[b + 1]]], fps[o])).tobytes() for b in full]
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "payload"])

    def meet(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in group["payload"].to_pylist()]
        keys = np.concatenate([p[: len(p) // 2] for p in parts])
        fps = np.concatenate([p[len(p) // 2 :] for p in parts])
        a, b = linked(keys, fps, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return classes.select("fp").mapInArrow(deal, "bucket int, payload binary").groupBy("bucket").applyInArrow(meet, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of the edges (columns a, b, numbers) and the least node of its component.

    Large-star and small-star, alternating: each round hangs neighbours below the least of them; the edges never become more. A node with
    many neighbours is aggregated before the shuffle and its edges are joined with skew handling on.
    """
    now = cut(edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct())
    if now.isEmpty():
        return now.selectExpr("u node", "v root")
    while True:
        both = now.unionByName(now.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v u", "m v")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").selectExpr("v u", "m v").unionByName(small_least.selectExpr("u", "m v"))
        after = cut(small.where("u <> v").distinct())
        # Done when no node hangs below two others and no root hangs below another.
        roots = after.select("v").distinct()
        more = after.groupBy("u").count().where("count > 1").select("u").unionByName(after.join(roots.withColumnRenamed("v", "u"), "u", "left_semi").select("u"))
        now = after
        if more.isEmpty():
            # A root hangs below nothing: it is its own row.
            return now.selectExpr("u node", "v root").unionByName(now.selectExpr("v node", "v root").distinct())


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach from the row, itself included; null if they reach none."""
    rows = cut(fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), width))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    # Nodes are fingerprints, as ids may be missing or repeated; the ids only name the components found.
    found = components(links(classes, radius))
    names = found.join(classes.selectExpr("fp node", "least"), "node").groupBy("root").agg(F.min("least").alias("name"), F.count("*").alias("nodes"))
    named = join_hot(found, names, "root", "nodes", F.xxhash64("node"))
    label = classes.join(named, F.col("fp") == F.col("node"), "left").select("fp", "n", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("name")).alias("component_id"))
    return join_hot(rows, label, "fp", "n", F.xxhash64("doc_id")).select("doc_id", "fp", "component_id")


def keep(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """One document of each group of near duplicates, with all columns of docs: that with the smallest id (null ids last), of those the one
    with the smallest fingerprint, then with the smallest SHA-256 of the text.

    Rows that repeat both doc_id and text are one document: one of them stays.
    """
    key = row_key(F.col("doc_id").cast("bigint"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key_")
    rows = fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", key), width, ("key_",))
    # The digest comes first in key_, so that among rows of one id and fingerprint it decides.
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "fp", "key_")
    classes = cut(rows.groupBy("fp").agg(F.min(first).alias("first")))
    found = components(links(classes, radius))
    grouped = classes.join(found, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("group_"))
    stay = grouped.agg(F.min("first").alias("first")).select("first.key_")
    left = docs.select(F.struct(*docs.columns).alias("row_"), key).join(stay, "key_", "left_semi")
    return left.withColumn("nth_", F.row_number().over(Window.partitionBy("key_").orderBy("key_"))).where("nth_ = 1").select("row_.*")
