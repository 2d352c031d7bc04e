"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns named; a null text is empty. Other columns of the input are ignored, whatever their names."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> None:
    """checkpoint() writes to the folder in spark.checkpoint.dir. Where that is unset, only a local session gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, so that neither its work nor its lineage is repeated."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, salt: Column, salts: int = 64) -> DataFrame:
    """Left join on key, where right has each key once and its column weight counts the rows that left has of it.

    Keys with more than a thousandth of all rows (so fewer than 1000 keys at any size) are joined by a broadcast; in the other join
    their rows are spread by salt over partitions where they match nothing.
    """
    small = right.groupBy().agg(F.sum(weight).alias("all_rows"))
    hot = right.join(F.broadcast(small), F.col(weight) * 1000 > F.col("all_rows")).drop("all_rows")
    cols = [c for c in right.columns if c != key]
    marked = left.join(F.broadcast(hot.select(key, F.struct(*cols).alias("hot_"))), key, "left")
    marked = marked.withColumn("salt_", F.when(F.col("hot_").isNull(), F.lit(0)).otherwise(F.lit(1) + F.pmod(salt, F.lit(salts))))
    rest = right.select(key, F.lit(0).alias("salt_"), F.struct(*cols).alias("cold_"))
    found = F.coalesce("hot_", "cold_")
    return marked.join(rest, [key, "salt_"], "left").select(*left.columns, *[found[c].alias(c) for c in cols])


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column in one array, and where each row starts and ends in it."""
    whole = column.cast(pa.large_binary())
    whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], pa.large_binary())
    if not len(whole):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit hashes over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            grow = lambda x: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64))))
            self.up, self.down = grow(self.base), grow(self.back)
        return self.up[:n], self.down[:n]


class PrimePowers:
    """Powers of a base and of its inverse modulo a prime below 2^31, as far as asked for."""

    def __init__(self, prime: int, base: int):
        self.prime, self.base, self.back = prime, base, pow(base, -1, prime)
        self.up = self.down = np.ones(1, np.int64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * pow(self.base, k, self.prime) % self.prime))
            self.down = np.concatenate((self.down, self.down * pow(self.back, k, self.prime) % self.prime))
        return self.up[:n], self.down[:n]

    def hashes(self, part: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Polynomial hash modulo the prime of each piece of the bytes in part."""
        up, down = self.upto(len(part) + 1)
        # Each summand is below 2^31, so that the sums of up to 2^32 bytes do not overflow.
        sums = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part.astype(np.int64) + 1) * up[:-1] % self.prime, out=sums[1:])
        return ((sums[last] - sums[first]) % self.prime * down[first] % self.prime).astype(np.uint64)


POWERS = Powers(0x9E3779B97F4A7C15)
#: Polynomials modulo 2^64 take some pairs of long words for one (those that follow the Thue-Morse sequence); a prime modulus does not.
PRIMES = [PrimePowers(2147483647, 1_103_515_245), PrimePowers(2147483629, 69_069), PrimePowers(2147483587, 742_938_285)]
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
#: Bytes of text that are hashed at once, so that the arrays stay small; a longer document is one block.
BLOCK = 1 << 19


def blocks(at: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with about BLOCK bytes each."""
    out, i, n = [], 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, side="right")) - 1)
        out.append((i, j))
        i = j
    return out


def word_blocks(raw: np.ndarray, at: np.ndarray, pairs: tuple = (), second: bool = False):
    """Of texts that lie one behind the other, block by block: rows from i to j; 64-bit hash, begin and end of every word (a run without
    ASCII white space); how many words each row has. Polynomial prefix sums over the bytes give each word's hash by one subtraction, modulo
    2^64 and modulo a prime, mixed into one number.

    pairs: two kinds of bytes each (arrays of 256 booleans); words are cut between a byte of the first and one of the second.
    second: another hash instead, of two other primes, which shares nothing with the first."""
    for i, j in blocks(at):
        part, ends_at = raw[at[i] : at[j]], at[i + 1 : j + 1] - at[i]
        gap = SPACE[part]
        inside = ~gap
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= gap[:-1]
        stop[:-1] &= gap[1:]
        for one, two in pairs:
            between = one[part[:-1]] & two[part[1:]]
            begin[1:] |= between
            stop[:-1] |= between
        edge = ends_at[(ends_at < len(part)) & (ends_at > 0)]
        begin[edge] = inside[edge]
        stop[edge - 1] = inside[edge - 1]
        first, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        if second:
            hashes = mixed((PRIMES[1].hashes(part, first, last) << U64(31)) | PRIMES[2].hashes(part, first, last))
        else:
            up, down = POWERS.upto(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + U64(1)) * up[:-1], out=sums[1:])
            hashes = mixed((sums[last] - sums[first]) * down[first] + mixed(PRIMES[0].hashes(part, first, last)))
        yield i, j, hashes, first + at[i], last + at[i], np.diff(np.searchsorted(first, np.concatenate(([0], ends_at))))


def word_hashes(raw: np.ndarray, at: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts, and how many words each text has."""
    parts = list(word_blocks(raw, at, second=second))
    join = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
    return join(2, np.uint64), join(5, np.int64)


def grams(hashes: np.ndarray, counts: np.ndarray, width: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words that lie in one text, and how many each text has."""
    many = np.maximum(counts - width + 1, 0)
    if not many.sum():
        return np.zeros(0, np.uint64), many
    ends = np.cumsum(counts)
    starts = np.repeat(ends - counts - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return mixed(rolling(hashes, width, base))[starts], many


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2^64) of every run of `width` values: runs of doubled length are joined from two neighbours."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    h, done, power = values, 1, base % 2**64
    for bit in bin(width)[3:]:
        h, done, power = h[: len(h) - done] * U64(power) + h[done:], 2 * done, power * power % 2**64
        if bit == "1":
            h, done, power = h[: len(h) - 1] * U64(base) + values[done : done + len(h) - 1], done + 1, power * base % 2**64
    return h
