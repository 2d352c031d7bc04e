"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, without random access.

The documents form an index with one row a document: its length and, of the terms that items ask for, how often it has each. Rows lie where
their texts were read, so a term that every document holds is spread over all tasks. A task reads its rows in shards of a bounded number of
postings. In a shard each term has a list of its documents by falling impact. For an item, all lists of its terms are read in steps from
the top; each document has a lower bound of its score (what was read of it) and an upper one (for each of its terms not yet met, the impact
last read there). A document whose upper bound is below the k-th best lower bound is out. Reading goes on until the bounds of all others
are equal: then membership, ties and scores are exact. The best k so far go on to the task's next shard as its first bound, and the best k
of all tasks are ranked by Spark.

Items are a query set: they are taken in blocks of about `block` bytes of text, whose terms are broadcast. An item is never split, so a block
is at most `block` bytes and one item.

Null and empty texts have no terms; such documents count neither in N nor in L, such items get no rows. Rows that repeat an item_id are one
item with all their terms; rows without one are one item as well, with a null id. Rows that repeat a doc_id are documents of their own; a null
doc_id comes last among equal scores. Very long texts are read in pieces. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.llm.common import cut, texts

#: Runs of ASCII letters and digits and of all that is not ASCII; in UTF-8 the latter are the bytes from 0x80 on.
TERM, OTHER = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
PIECE, SHARD, FIRST_READ = 1 << 20, 2_000_000, 64


def terms(text: bytes):
    """The terms of a text, a piece at a time, with A-Z in lower case."""
    at = 0
    while at < len(text):
        gap = OTHER.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield TERM.findall(text[at:end].lower())
        at = end


def index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), term, tf (arrays): one row for each document that has a term; term holds places in the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        place = {t: i for i, t in enumerate(known.value)}
        for batch in batches:
            rows, size, ids, tfs = [], [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.large_binary())):
                n, found = 0, Counter()
                for piece in terms(text.as_py()):
                    n += len(piece)
                    found.update(map(place.get, piece))
                if n:
                    del found[None]
                    rows.append(row)
                    size.append(n)
                    ids.append(np.fromiter(found.keys(), np.int32, len(found)))
                    tfs.append(np.fromiter(found.values(), np.int64, len(found)))
            lists = lambda parts, kind: pa.array(parts, pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(size, pa.int64()), lists(ids, pa.int32()), lists(tfs, pa.int64())], ["doc_id", "n", "term", "tf"])

    return texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, term array<int>, tf array<bigint>")


class Shard:
    """Impact-sorted lists over some rows of the index. Rows are numbered by doc_id, so that equal scores go by number."""

    def __init__(self, rows: pa.Table, lengths: tuple[int, int], weights: np.ndarray, a: int, b: int):
        rows = rows.sort_by("doc_id")  # nulls at the end
        self.ids = rows["doc_id"]
        n_docs, all_terms = lengths
        # Exact whatever the size of the corpus: Python's integers do not overflow.
        m = np.array([a - b + (b * n * n_docs) // all_terms for n in rows["n"].to_pylist()], np.int64)
        many = pc.list_value_length(rows["term"]).to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(rows.num_rows), many)
        term, tf = (pc.list_flatten(rows[c]).to_numpy() for c in ("term", "tf"))
        part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.argsort((term.astype(np.int64) << 20) - part, kind="stable")
        self.doc, self.impact = doc[order], weights[term[order]] * part[order]
        self.ends = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def best(self, wanted: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of all documents that may be among the best k for the item with these terms. floor: scores of documents
        seen elsewhere."""
        wanted = wanted[self.ends[wanted + 1] > self.ends[wanted]]
        at, end = self.ends[wanted].copy(), self.ends[wanted + 1]
        low, met = np.zeros(len(self.ids), np.int64), np.zeros((len(wanted), len(self.ids)), bool)
        edge = np.zeros(len(wanted))
        left, step = np.arange(len(self.ids)), FIRST_READ
        while len(left) and len(wanted):
            for i in np.flatnonzero(at < end):
                stop = min(at[i] + step, end[i])
                rows = self.doc[at[i] : stop]
                low[rows] += self.impact[at[i] : stop]
                met[i, rows] = True
                at[i] = stop
                # A list that is read to its end holds nothing more.
                edge[i] = self.impact[stop - 1] if stop < end[i] else 0
            step *= 4
            have = np.concatenate((low[left], floor))
            least = max(1, np.partition(have, -k)[-k]) if len(have) >= k else 1
            left = left[low[left] + edge.sum() >= least]
            high = low[left] + edge.sum() - edge @ met[:, left]  # whole numbers below 2^53
            left, high = left[high >= least], high[high >= least]
            if (high == low[left]).all():
                break
        left = left[low[left] > 0]
        return left, low[left]


def merged(best: list[tuple], k: int) -> list[tuple]:
    """The best k of (score, doc_id)."""
    return sorted(best, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]


def searched(rows: DataFrame, asked: list[np.ndarray], weights: np.ndarray, lengths: tuple[int, int], k: int, a: int, b: int) -> DataFrame:
    """item, doc_id, score: of each task the best k documents of each item."""
    known = rows.sparkSession.sparkContext.broadcast((asked, weights))

    def run(batches):
        wanted, weight = known.value
        best: list[list[tuple]] = [[] for _ in wanted]

        def read(held):
            shard = Shard(pa.Table.from_batches(held), lengths, weight, a, b)
            for i, t in enumerate(wanted):
                found, score = shard.best(t, k, np.array([s for s, _ in best[i]], np.int64))
                order = np.argsort(-score, kind="stable")[:k]
                ids = shard.ids.take(pa.array(found[order])).to_pylist()
                best[i] = merged(best[i] + list(zip(score[order].tolist(), ids)), k)

        held, size = [], 0
        for batch in batches:
            # A batch holds few rows (spark.sql.execution.arrow.maxRecordsPerBatch); what they hold together is measured.
            held.append(batch)
            size += len(batch.column(2).flatten()) + batch.num_rows
            if size >= SHARD:
                read(held)
                held, size = [], 0
        if held:
            read(held)
        out = [(i, d, s) for i, rows_ in enumerate(best) for s, d in rows_]
        item, doc, score = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, a: int = 100, b: int = 90, block: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents with the highest scores above 0.

    A term's weight w is floor(1000 ln((2N + 2) / (2df + 1))); a document's m is a - b + (b n N div L); its score sums
    w (10^9 tf div (1000 tf + 8 m)) over the item's terms, each once."""
    one = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = one.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block))
    parts = [searched_block(docs, one.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i), k, a, b) for i in range(blocks)]
    found = reduce(DataFrame.union, parts)
    # Ranked in two steps: a task sees a few rows of each of the 64 deals, not those of all tasks.
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    found = found.withColumn("deal", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))).withColumn("rank", best("item_id", "deal")).where(F.col("rank") <= k)
    return found.withColumn("rank", best("item_id")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def searched_block(docs: DataFrame, items: DataFrame, k: int, a: int, b: int) -> DataFrame:
    """item_id, doc_id, score: candidates of all tasks for one block of items."""
    spark = docs.sparkSession
    # The block's text is bounded.
    asked: dict[int | None, set[bytes]] = {}
    for r in items.toLocalIterator():
        for piece in terms(r.text.encode()):
            asked.setdefault(r.item_id, set()).update(piece)
    vocabulary = sorted(set().union(*asked.values()))
    rows = cut(index(docs, vocabulary))
    n_docs, all_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    place = {t: i for i, t in enumerate(vocabulary)}
    names = list(asked)
    lists = [np.array(sorted(place[t] for t in asked[name]), np.int64) for name in names]
    # A term of weight 0 adds nothing.
    lists = [x[weights[x] > 0] if len(x) else x for x in lists]
    named = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
    return searched(rows, lists, weights, (n_docs, all_terms), k, a, b).join(F.broadcast(named), "item").select("item_id", "doc_id", "score")
