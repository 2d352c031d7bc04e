"""Exact dedup against an index of known texts: a minimal perfect hash over their distinct SHA-256 digests.

The index (build) is a table, one row per bucket of the digest space: seeds of the minimal perfect hash, and slots that hold each full
digest with its winner (the largest doc_id of that text, and which row that is) and how many rows have it. New texts are grouped by digest first,
so that a text however frequent is one row; a lookup hashes a digest to its one slot and compares all 32 bytes: equal bytes make it a repeat,
anything else is a nonmember, which is a group of its own. Only digests and ids are shuffled, never texts. Bucket size is fixed, their number
follows the rows, so an index of any size is spread.

dedup() looks new documents up in an index of earlier ones, whose winners stay. duplicates() has one table only: about half of it, chosen by a
hash of the ids, is the history that the index is built from; the other half is looked up; where a repeat has a larger id than the winner, the
slot takes it over, and nonmembers add their own winners.

Rows meet the winner of their text again by digest; texts with over a thousandth of all rows (fewer than 1000 at any size) by a broadcast.
A null text is empty. A null doc_id loses against any other; of several rows with the winning id (or of rows with null ids only) exactly
one is kept. Empty tables give no rows. Very long texts are only hashed. Other columns are ignored, and kept by keep().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.llm.common import U64, cut, join_hot, mixed, texts

#: Digests in a bucket, about; keys per seed of the perfect hash.
BUCKET, LOAD = 4_000, 2
INDEX = "bucket bigint, n bigint, seeds binary, digests binary, winners binary, places binary, sizes binary"
SLOTS = {"seeds": np.uint32, "digests": np.uint64, "winners": np.int64, "places": np.int64, "sizes": np.int64}
NONE = -(2**63)


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """A seed for each group of keys, so that all keys (n x 2 numbers of 64 bits, distinct) have different slots 0..n-1.

    Largest groups first, each tries seeds until its keys fall on free slots; all groups of one size try together.
    """
    n = len(keys)
    groups = max(1, -(-n // LOAD))
    group = (keys[:, 0] % U64(groups)).astype(np.int64)
    many = np.bincount(group, minlength=groups)
    seeds, taken = np.zeros(groups, np.uint32), np.zeros(n, bool)
    order = np.argsort(group, kind="stable")
    begin = np.concatenate(([0], np.cumsum(many)))
    for size in range(int(many.max(initial=0)), 0, -1):
        open_ = np.flatnonzero(many == size)
        members = order[begin[open_][:, None] + np.arange(size)]
        if size == 1:  # the rest take the free slots: seed 2^31 + slot
            seeds[open_] = np.flatnonzero(~taken)[: len(open_)].astype(np.uint32) | np.uint32(1 << 31)
            break
        seed = 0
        while len(open_):
            seed += 1
            slots = place(keys[members.ravel()], np.full(members.size, seed, np.uint32), n).reshape(members.shape)
            ordered = np.sort(slots, axis=1)
            good = ~(ordered[:, 1:] == ordered[:, :-1]).any(axis=1) & ~taken[slots].any(axis=1)
            # of groups that want one slot, the first gets it
            flat, who = slots[good].ravel(), np.repeat(np.flatnonzero(good), size)
            _, first = np.unique(flat, return_index=True)
            lost = np.ones(len(flat), bool)
            lost[first] = False
            good[who[lost]] = False
            taken[slots[good].ravel()] = True
            seeds[open_[good]] = seed
            open_, members = open_[~good], members[~good]
    return seeds


def place(keys: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    hashed = (mixed(keys[:, 1] + seed.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) % U64(n)).astype(np.int64)
    return np.where(seed >> np.uint32(31), (seed & np.uint32(2**31 - 1)).astype(np.int64), hashed)


def slot(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(place(keys, seeds[(keys[:, 0] % U64(len(seeds))).astype(np.int64)], n), n - 1)


def halves(digests: pa.ChunkedArray) -> np.ndarray:
    """32-byte digests as rows of four numbers."""
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 4)


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, id (a null one as the least number), digest (32 bytes) of the text in UTF-8, row (a number of its own). Written, as the numbers
    must not change."""
    doc_id = F.col("doc_id").cast("bigint")
    return cut(texts(docs).select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NONE)).alias("id"), F.unhex(F.sha2("text", 256)).alias("digest"), F.monotonically_increasing_id().alias("row")))


def grouped(rows: DataFrame) -> DataFrame:
    """digest, winner, place, size of each distinct text: partial aggregates, so that no text is a hot key."""
    best = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("size"))
    return best.select("digest", F.col("best.id").alias("winner"), F.col("best.row").alias("place"), "size")


def bucket_of(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n))


def buckets(rows: int) -> int:
    return max(1, -(-rows // BUCKET))


def build(rows: DataFrame, n: int) -> DataFrame:
    """The index over the distinct texts of rows (of digested()), in n buckets."""
    def index(group: pa.Table) -> pa.Table:
        keys = halves(group["digest"])
        seeds = perfect_hash(keys)
        at = slot(keys, seeds, len(keys))
        held = {"seeds": seeds, "digests": np.empty_like(keys), **{k: np.empty(len(keys), np.int64) for k in ("winners", "places", "sizes")}}
        held["digests"][at] = keys
        for name, column in (("winners", "winner"), ("places", "place"), ("sizes", "size")):
            held[name][at] = group[column].to_numpy()
        return pa.table({"bucket": group["bucket"][:1], "n": pa.array([len(keys)], pa.int64()), **{k: pa.array([held[k].tobytes()], pa.binary()) for k in SLOTS}})

    return grouped(rows).withColumn("bucket", bucket_of(n)).groupBy("bucket").applyInArrow(index, INDEX)


def looked_up(new: DataFrame, index: DataFrame, n: int, merge: bool) -> DataFrame:
    """digest, winner, place, size, known, times (rows of the new table) of each distinct new text, after a lookup in the index.

    Not merge: a known text has the index's winner and size. merge: sizes are added and the larger winner stays, and the texts that only the
    index has are returned too."""
    def run(group: pa.Table, known: pa.Table) -> pa.Table:
        keys = halves(group["digest"])
        own = {c: group[c].to_numpy().copy() for c in ("winner", "place", "size")}
        times, member = own["size"].copy(), np.zeros(len(keys), bool)
        left = np.zeros((0, 4), np.uint64), {c: np.zeros(0, np.int64) for c in own}
        if len(known):
            held = {k: np.frombuffer(known[k][0].as_py(), t) for k, t in SLOTS.items()}
            digests = held["digests"].reshape(-1, 4)
            if len(keys):
                at = slot(keys, held["seeds"], known["n"][0].as_py())
                member = (digests[at] == keys).all(axis=1)
                hit = at[member]
                old, mine = (held["winners"][hit], held["places"][hit]), (own["winner"][member], own["place"][member])
                larger = merge & ((mine[0] > old[0]) | ((mine[0] == old[0]) & (mine[1] > old[1])))
                own["winner"][member], own["place"][member] = np.where(larger, mine[0], old[0]), np.where(larger, mine[1], old[1])
                own["size"][member] = held["sizes"][hit] + (times[member] if merge else 0)
                times[member] += held["sizes"][hit] if merge else 0
            if merge:
                rest = np.ones(len(digests), bool)
                rest[at[member] if len(keys) else []] = False
                left = digests[rest], {"winner": held["winners"][rest], "place": held["places"][rest], "size": held["sizes"][rest]}
        data = np.concatenate((keys, left[0]))
        raw = data.tobytes()
        out = {c: np.concatenate((own[c], left[1][c])) for c in own}
        return pa.table({"digest": pa.array([raw[32 * i : 32 * i + 32] for i in range(len(data))], pa.binary()), **out,
                         "known": np.concatenate((member, np.ones(len(left[0]), bool))), "times": np.concatenate((times, left[1]["size"]))})

    return new.withColumn("bucket", bucket_of(n)).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(run, "digest binary, winner bigint, place bigint, size bigint, known boolean, times bigint")


def answered(rows: DataFrame, found: DataFrame, kept: Column) -> DataFrame:
    out = join_hot(rows, cut(found), "digest", "times", F.col("row"))
    return out.select("doc_id", F.nullif("winner", F.lit(NONE)).alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), "known", F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, earlier: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, known (an earlier document has its text), text_sha256 of every row of docs.

    Repeats of a known text go: keep_id and group_size are those of the earlier documents. Nonmembers are grouped among themselves: of each
    group the row with the largest id stays."""
    rows, old = digested(docs), digested(earlier)
    n = buckets(old.count())
    return answered(rows, looked_up(grouped(rows), build(old, n), n, merge=False), ~F.col("known") & (F.col("row") == F.col("place")))


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, known (its text is in the history), text_sha256 of every row of docs: of equal texts, the row with the
    largest id stays."""
    rows = digested(docs)
    n = buckets(rows.count())
    past = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(2)) == 0
    found = looked_up(grouped(rows.where(~past)), build(rows.where(past), n), n, merge=True)
    return answered(rows, found, F.col("row") == F.col("place"))


def keep(docs: DataFrame) -> DataFrame:
    """Rows of docs that stay, one for each different text, with all columns of docs.

    Rows that repeat both doc_id and text are one document: one of them stays.
    """
    winners = duplicates(docs).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key_"))
    rows = docs.select(F.struct(*docs.columns).alias("row_"), row_key(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key_"))
    stay = rows.join(winners, "key_", "left_semi")
    return stay.withColumn("nth_", F.row_number().over(Window.partitionBy("key_").orderBy("key_"))).where("nth_ = 1").select("row_.*")


def row_key(doc_id: Column, digest: Column) -> Column:
    return F.concat_ws(":", digest, F.coalesce(doc_id.cast("string"), F.lit("none")))
