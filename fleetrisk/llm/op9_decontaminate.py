"""Benchmark decontamination: short test items found inside long documents by MinHash containment search, verified exactly.

Similarity of sets is of no use between 30 shingles and 3000, so containment is searched. Items are partitioned by size, and each has a
signature of its smallest shingle hashes (bottom-k MinHash) as long as its size class needs: an item of n shingles that lies in a document
to a share of t or more misses at most n - ceil(t n) of them, so a signature of one more hash than the class can miss meets every
such document at least once, and no pair is lost.

Documents are never shuffled. Two bit tables, sized by the items' shingles up to 2^MOST_BITS bits, mark the hashes of the signatures and of all
shingles. Where a text is read, its shingles are looked up in the first; a text that meets no signature sends nothing, any other sends the
shingles that the second lets through. Those that meet signatures make the candidates (row, item); only candidates are verified, by counting
the item's shingles that the row holds. Items found in very many documents: what a row sends is distinct, and the join with the signatures
is salted by row.

Words are runs without ASCII white space, A-Z in lower case; shingles are `width` words. Items and documents of fewer words have no shingles:
such items are left out (short_items names them), as a word or two would be found in clean documents; null and empty ones too. Items that
repeat an item_id are one item with all their shingles. Each row is searched by itself, named by doc_id and a digest of its text, also where
rows share an id or have none. Items without an id are left out, as a find could not name them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.llm.common import LOWER, U64, cut, flat, grams, partitions, word_blocks
from fleetrisk.llm.op2_exact import row_key

#: Bits of the tables of hashes: 64 for each shingle of the items, but never over 32 MB.
LEAST_BITS, MOST_BITS = 16, 28
BASE = 0x9E3779B97F4A7C15
SHINGLES = "id {kind}, shingle string, h bigint, probe boolean"


def places(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def shingles(rows: DataFrame, width: int, bits: int = 0, tables=None) -> DataFrame:
    """id, shingle, h, probe: the distinct shingles of each text. tables: bits of the hashes of signatures and of all shingles; then only of texts
    with a hash among the first (a probe), those with a hash among the second."""
    def run(batches):
        signed, every = (np.unpackbits(np.frombuffer(t, np.uint8)).view(bool) for t in tables.value) if tables is not None else (None, None)
        for batch in batches:
            raw, at = flat(pa.Table.from_batches([batch])["text"])
            raw = LOWER[raw]
            row, text, hashes, probes = [], [], [], []
            for i, _, words, first, last, counts in word_blocks(raw, at):
                h, many = grams(words, counts, width, BASE)
                of = np.repeat(np.arange(len(counts)), many)
                start = np.repeat(np.cumsum(counts) - counts - (np.cumsum(many) - many), many) + np.arange(len(h))
                probe = np.zeros(len(h), bool)
                if every is not None:
                    where = places(h, bits)
                    probe = signed[where]
                    met = np.bincount(of[probe], minlength=len(counts)) > 0
                    hit = np.flatnonzero(every[where] & met[of])
                    of, start, h, probe = of[hit], start[hit], h[hit], probe[hit]
                _, one = np.unique(np.stack((of.astype(np.uint64), h)), axis=1, return_index=True)
                for k in one:
                    row.append(i + int(of[k]))
                    text.append(b" ".join(raw[first[x] : last[x]].tobytes() for x in range(start[k], start[k] + width)))
                    hashes.append(int(h[k].view(np.int64)))
                    probes.append(bool(probe[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array([t.decode("utf-8", "replace") for t in text], pa.string()), pa.array(hashes, pa.int64()), pa.array(probes, pa.bool_())], ["id", "shingle", "h", "probe"])

    return rows.select("id", "text").mapInArrow(run, SHINGLES.format(kind=rows.schema["id"].dataType.simpleString()))


def most_missing(n: Column, share: float) -> Column:
    """How many of the n shingles of an item a document may lack."""
    return n - F.ceil(n * F.lit(share) - F.lit(1e-9))


def signatures(items: DataFrame, width: int, share: float) -> DataFrame:
    """item_id, shingle, h, n_shingles, signed: all shingles of the items; signed are those in the item's signature."""
    have = shingles(items.where("item_id IS NOT NULL").select(F.col("item_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), width)
    have = have.select(F.col("id").alias("item_id"), "shingle", "h").distinct().withColumn("n_shingles", F.count("*").over(Window.partitionBy("item_id")))
    # Size classes double; the signature of a class is as long as its largest item needs.
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n_shingles")) + 1) - 1
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("h", "shingle"))
    return have.withColumn("signed", rank <= most_missing(largest, share) + 1)


def short_items(items: DataFrame, width: int = 5) -> DataFrame:
    """Rows of items that cannot be searched: fewer than `width` words, or no id."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    return items.where((words < width) | F.col("item_id").isNull())


def key_of() -> Column:
    """Names a row of docs: rows that agree in it have one id and one text."""
    return row_key(F.col("doc_id").cast("bigint"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key_")


def met(docs: DataFrame, items: DataFrame, width: int, share: float) -> DataFrame:
    """key_, item_id, shared, n_shingles: all pairs where the row's text holds at least `share` of the item's shingles."""
    spark = docs.sparkSession
    have = cut(signatures(items, width, share))
    total = have.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * total).bit_length()))

    def marked(rows: DataFrame) -> bytes:
        """At most 2^bits places, whatever the tables hold."""
        table = np.zeros(1 << bits, bool)
        for batch in rows.select(F.shiftrightunsigned("h", 64 - bits).alias("p")).distinct().toArrow().to_batches():
            table[batch.column(0).to_numpy()] = True
        return np.packbits(table).tobytes()

    tables = spark.sparkContext.broadcast((marked(have.where("signed")), marked(have)))
    rows = docs.select(key_of().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sent = cut(shingles(rows, width, bits, tables).select(F.col("id").alias("key_"), "shingle", "probe").distinct())
    salts = partitions(spark)
    salt = F.pmod(F.xxhash64("key_"), F.lit(salts))
    signed = have.where("signed").select("item_id", "shingle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    candidates = sent.where("probe").withColumn("salt", salt).join(signed, ["shingle", "salt"]).select("key_", "item_id").distinct()
    # The candidates' items with all their shingles, counted where the row holds them.
    wanted = candidates.join(have.select("item_id", "shingle", "n_shingles"), "item_id")
    pairs = wanted.join(sent.select("key_", "shingle"), ["key_", "shingle"]).groupBy("key_", "item_id").agg(F.count("*").alias("shared"), F.max("n_shingles").alias("n_shingles"))
    return pairs.where(F.col("shared") >= F.col("n_shingles") - most_missing(F.col("n_shingles"), share))


def find(docs: DataFrame, items: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """doc_id, item_id, shared, n_shingles, containment: all pairs where a row of that id holds at least `share` of the item's shingles.

    Of rows that share an id, and of those without one, the row that holds most of the item is reported.
    """
    doc_id = F.nullif(F.substring_index("key_", ":", -1), F.lit("none")).cast("bigint").alias("doc_id")
    out = met(docs, items, width, share).groupBy(doc_id, "item_id").agg(F.max("shared").alias("shared"), F.max("n_shingles").alias("n_shingles"))
    return out.select("doc_id", "item_id", "shared", "n_shingles", (F.col("shared") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """Rows of docs, with all their columns, in which no item is found."""
    dirty = met(docs, items, width, share).select("key_").distinct()
    return docs.select(F.struct(*docs.columns).alias("row_"), key_of()).join(dirty, "key_", "left_anti").select("row_.*")
