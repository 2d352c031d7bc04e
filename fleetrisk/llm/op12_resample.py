"""Importance resampling towards a target distribution, with the features of each distinct line counted once.

Features are runs of 1 to `longest` words, hashed to `buckets` places. Line feeds cut texts into lines; a line that many documents share is
one row, with its features' places; counts of the corpus are those times its occurrences. Runs that cross lines (only where `longest` is over
1) are made per document from the edges of its lines and added. A bucket's gain says how much commoner it is in the target; a line's weight
sums the gains of its places, once, and goes back to the documents that hold the line. A document's score is its weight plus Gumbel noise from
a hash of its id, so that the highest scores are a sample without replacement, drawn by weight.

Distinct lines are grouped by their whole text; documents meet them again by the first 128 bits of the line's SHA-256. Lines with over a
thousandth of all occurrences (an empty line, a common notice) are joined by a broadcast of fewer than a thousand rows. The ranking is a
range-partitioned sort with the sizes of the partitions before it; no task ranks all.

Null and empty texts are one empty line without words: no features, weight 0. A null doc_id is hashed as an empty text and comes last among
equal scores. Rows that repeat a doc_id are documents of their own, also where the text repeats too. Empty tables: no rows, or, without a
target, gains of an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.llm.common import cut, join_hot, partitions, texts

#: What lies between words: all of ASCII but digits and a-z, after A-Z are put in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    # Cut at the gaps: reading matches one by one copies the whole text for each. Only the first and the last piece can be empty.
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def place(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def shifted(of: str, by: int, k: int) -> Column:
    """The elements of an array column from number `by` on, as many as there are runs of k neighbours."""
    return F.slice(of, by + 1, F.greatest(F.lit(0), F.size(of) - (k - 1)))


def runs(of: str, k: int) -> Column:
    """All runs of k neighbours of an array of words. Arrays that are shifted by one are joined element by element: no array is cut anew for each run."""
    run = shifted(of, 0, k)
    for by in range(1, k):
        run = F.zip_with(run, shifted(of, by, k), lambda x, y: F.concat(x, F.lit(" "), y))
    return run


def digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def lines(rows: DataFrame) -> DataFrame:
    """key, first (1 for the first line of a text), crossed (on the first line), line. key names a document: id, digest of the text, and the
    split it was read from, so that copies of a row stay spread."""
    keyed = rows.select(F.struct("doc_id", digest(F.col("text")).alias("text"), F.spark_partition_id().alias("split")).alias("key"), "crossed", "text")
    each = keyed.select("key", "crossed", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return each.select("key", (F.col("at") == 0).cast("int").alias("first"), F.when(F.col("at") == 0, F.col("crossed")).alias("crossed"), "line")


def segments(rows: DataFrame, buckets: int, longest: int) -> DataFrame:
    """line_key, times, n_words, places: each distinct line once, with the places of the features within it."""
    distinct = rows.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
    found = distinct.select(digest(F.col("line")).alias("line_key"), "times", words(F.col("line")).alias("w"))
    features = F.concat(*[runs("w", k) for k in range(1, longest + 1)]) if longest > 1 else F.col("w")
    return found.select("line_key", "times", F.size("w").alias("n_words"), F.transform(features, lambda x: place(x, buckets)).alias("places"))


def crossing(rows: DataFrame, buckets: int, longest: int) -> DataFrame:
    """doc_id, text, crossed: the places of the runs that lie in more than one line."""
    if longest < 2:
        return rows.withColumn("crossed", F.array().cast("array<int>"))
    edge = longest - 1

    def ends(w: Column, i: Column) -> Column:
        """The words of a line that a crossing run can reach, with its number; a null stands for those between."""
        tagged = lambda part: F.transform(part, lambda x: F.struct(x.alias("word"), i.alias("line")))
        gap = F.array(F.lit(None).cast("struct<word: string, line: int>"))
        return F.when(F.size(w) <= 2 * edge, tagged(w)).otherwise(F.concat(tagged(F.slice(w, 1, edge)), gap, tagged(F.slice(w, -edge, edge))))

    per_line = rows.withColumn("ends", F.transform(F.split("text", "\n", -1), words))
    tagged = per_line.withColumn("ends", F.flatten(F.transform("ends", ends)))

    def across(k: int) -> Column:
        """The runs of k words without a gap whose ends are in different lines."""
        run = F.transform(shifted("ends", 0, k), lambda x: F.struct(x["word"].alias("run"), x["line"].alias("first"), x["line"].alias("last")))
        for by in range(1, k):
            run = F.zip_with(run, shifted("ends", by, k), lambda x, y: F.struct(F.concat(x["run"], F.lit(" "), y["word"]).alias("run"), x["first"].alias("first"), y["line"].alias("last")))
        return F.transform(F.filter(run, lambda x: x["run"].isNotNull() & (x["first"] != x["last"])), lambda x: place(x["run"], buckets))

    kinds = [across(k) for k in range(2, longest + 1)]
    return tagged.select("doc_id", "text", F.concat(*kinds).alias("crossed"))


def histogram(parts: DataFrame, crossed: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket, and so at most `buckets` numbers."""
    each = parts.select(F.explode("places").alias("place"), "times").union(crossed.select(F.explode("crossed"), F.lit(1).cast("bigint")))
    out = [0] * buckets
    for r in each.groupBy("place").agg(F.sum("times").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    buckets, all_s, all_t = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets)))) for s, t in zip(source, target)]


def weighted(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """doc_id, split, n_words, n_features, weight of every row of docs."""
    rows, wanted = (crossing(t, buckets, longest) for t in (texts(docs), target.select(F.lit(0).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))))
    parts = cut(segments(rows, buckets, longest))
    gain = gains(histogram(parts, rows, buckets), histogram(segments(wanted, buckets, longest), wanted, buckets))
    # One constant for all tasks, of `buckets` numbers; it is folded when the plan is made.
    known = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = lambda places: F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, x: acc + known[x])
    weighed = parts.select("line_key", "times", F.col("n_words").cast("bigint").alias("n_words"), F.size("places").cast("bigint").alias("n_features"), total("places").alias("weight"))
    of = lines(rows).select("key", "first", "crossed", digest(F.col("line")).alias("line_key"))
    met = join_hot(of, weighed, "line_key", "times", F.xxhash64("key"))
    more = lambda c, extra: F.sum(F.col(c) + F.when(F.col("first") == 1, extra).otherwise(0)).alias(c)
    sums = met.groupBy("key").agg(F.sum("first").alias("copies"), F.sum("n_words").alias("n_words"), more("n_features", F.size("crossed")), more("weight", total("crossed")))
    # Rows of one split that agree in id and text have equal sums.
    one = sums.select("key", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))), *[F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")])
    return one.select("key.doc_id", "key.split", "n_words", "n_features", "weight")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, seed: str = "2024", buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn. Of the documents with at least `least`
    words, `percent` in a hundred are drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = cut(weighted(docs, target, buckets, longest).withColumn("score", F.col("weight") + noise).withColumn("in_", F.col("n_words") >= least))
    n = partitions(docs.sparkSession)
    order = [F.desc("in_"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.asc("split")]
    # The place in its partition is the lower 33 bits of the number, the partition the upper ones.
    placed = cut(scored.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int").alias("part")
    # One row for each of the n partitions.
    sizes = placed.groupBy(part).agg(F.count("*").alias("rows"), F.sum(F.col("in_").cast("bigint")).alias("able"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before.alias("before"), F.floor(F.sum("able").over(Window.partitionBy()) * percent / 100).alias("draw"))
    ranked = placed.withColumn("part", part).join(F.broadcast(sizes), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1)
    drawn = F.when(F.col("in_") & (F.col("rank") <= F.col("draw")), F.col("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", drawn.alias("rank"))
