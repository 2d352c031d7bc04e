"""Token counts of a corpus for every context limit, from an exact histogram of encoded lengths.

Documents are aggregated by their number of ids; suffix sums over the distinct lengths then answer, for any limit, how many documents are
longer, how many ids they hold, and how many ids are left if every document is cut at the limit. The sums run in two levels, spans of
lengths first, so that no task sees more than one span or one row per span.

Null and empty texts have length 0 and are counted. The ids are the tokenizer's alone, without a closing id.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.llm.common import cut, flat, texts
from fleetrisk.llm.tokens import encoder, vocabulary

SPAN = 1024


def lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """n_tokens of every document."""
    known = vocabulary(docs.sparkSession, tokenizer)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encoder(known).lengths(*flat(pa.Table.from_batches([batch])["text"])))], ["n_tokens"])

    return texts(docs).select("text").mapInArrow(run, "n_tokens bigint")


def histogram(counted: DataFrame) -> DataFrame:
    """One row for each distinct n_tokens, as a context limit: n_docs of that length; docs_over and tokens_over of longer documents;
    docs_to (of that length or less) and share_to of all documents; tokens_whole in documents that fit; tokens_cut if all are cut at it;
    tokens_all."""
    # Small, and read twice below: written once, so that no text is encoded twice.
    sizes = cut(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))).withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    sizes = sizes.withColumn("n", F.col("n_tokens") * F.col("n_docs"))
    # One row a span; how many there are is bounded by the longest text, not by the corpus.
    spans = sizes.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("n").alias("t"))
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    spans = spans.select("span", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
                         F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    longer = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.join(spans, "span").withColumn("docs_over", F.col("d_above") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0)))
    out = out.withColumn("tokens_over", F.col("t_above") + F.coalesce(F.sum("n").over(longer), F.lit(0)))
    return out.select("n_tokens", "n_docs", "docs_over", "tokens_over", (F.col("d_all") - F.col("docs_over")).alias("docs_to"),
                      ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("share_to"), (F.col("t_all") - F.col("tokens_over")).alias("tokens_whole"),
                      (F.col("t_all") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("tokens_cut"), F.col("t_all").alias("tokens_all"))


def at_limits(table: DataFrame, limits: DataFrame) -> DataFrame:
    """For each context_limit: docs_over, tokens_over and tokens_cut, whether or not a document has that length. table: of histogram()."""
    # The largest length that is not over the limit answers it; below the smallest length everything is over.
    steps = table.select(F.col("n_tokens").alias("at"), F.lit(0).alias("kind"), "docs_over", "tokens_over", "tokens_all")
    asked = limits.select(F.col("context_limit").cast("bigint").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("docs_over"), F.lit(None).cast("bigint").alias("tokens_over"), F.lit(None).cast("bigint").alias("tokens_all"))
    # Where no length is that small, all documents are over the limit.
    bottom = table.agg(F.lit(-1).cast("bigint").alias("at"), F.lit(0).alias("kind"), F.sum("n_docs").alias("docs_over"), F.max("tokens_all").alias("tokens_over"), F.max("tokens_all").alias("tokens_all"))
    so_far = Window.partitionBy().orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = bottom.unionByName(steps).unionByName(asked).select("at", "kind", *[F.last(c, True).over(so_far).alias(c) for c in ("docs_over", "tokens_over", "tokens_all")])
    return filled.where("kind = 1").distinct().select(F.col("at").alias("context_limit"), "docs_over", "tokens_over", (F.col("tokens_all") - F.col("tokens_over") + F.col("at") * F.col("docs_over")).alias("tokens_cut"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the least length that at least so many documents do not exceed."""
    return table.agg(*[F.min(F.when(F.col("share_to") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]).select(
        F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])).alias("x")).select("x.*")


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return histogram(lengths(docs, tokenizer))
