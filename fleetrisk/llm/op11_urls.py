"""URL filter: rules by host and path, and for all other URLs the ratio of two character models.

The models are variable-order Markov models of accepted and of rejected URLs (those that a rule allows or blocks): the chance of a character
after the `order` characters before it, smoothed by the chances after shorter contexts as far as these were seen (Witten-Bell). A URL's
log-likelihood difference is the sum over its characters and its end, divided by their number. One in five of the labelled URLs (by hash)
is not learned from; on these the threshold is calibrated that gives the least sum of both error rates.

All in DataFrame functions. Runs of order + 1 characters are counted once for all URLs, with partial sums before the shuffle; shorter ones are
sums of those. A URL is scored once, however many pages have it. Runs that make up over 1/2000 of all (fewer than 2000, so that they may be
broadcast) are added up where the URLs are read; only rarer ones are shuffled to the model. Differences are whole millionths, so
that sums do not depend on their order.

Null URLs are empty ones. Without "://" host and path are empty, and no rule fits; the models judge the whole URL all the same. Without
accepted or without rejected URLs, the threshold is 0 and a score at it is accepted. Very long URLs are read in time that follows their
length. Repeated rows are judged alike; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.llm.common import cut, join_hot, partitions

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
ORDER, FOLDS, HOT = 4, 5, 2000
#: Marks before the first and after the last character.
START, END = "\u0002", "\u0003"
#: A character not seen before is one of so many.
ALPHABET = 65536
#: Scores are counted in steps of 0.01 from -5 to 5.
STEP, STEPS = 10_000, 500


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def runs(urls: DataFrame, order: int) -> DataFrame:
    """urls with a row and its run for each character of a URL and for its end: it and the `order` characters before it."""
    chars = urls.withColumn("chars_", F.split(F.concat(F.lit(START * order), "url", F.lit(END)), ""))
    shifted = lambda j: F.slice("chars_", j + 1, F.size("chars_") - order)
    run = shifted(0)
    for j in range(1, order + 1):
        run = F.zip_with(run, shifted(j), lambda x, y: F.concat(x, y))
    return chars.select(*urls.columns, F.explode(run).alias("run"))


def differences(counted: DataFrame, order: int) -> DataFrame:
    """run, diff: millionths of ln(accepted / rejected) for each counted run. counted: run, yes, no (how often each class has it)."""
    # The last characters of each run, from one to all: contexts of every length in one shuffle.
    longs = counted.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.struct(k.alias("k"), F.right("run", k).alias("part")))).alias("x"), "yes", "no")
    sums = longs.groupBy("x.k", "x.part").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    # A context has as many rows as characters follow it.
    context = Window.partitionBy("k", F.expr("left(part, k - 1)"))
    wide = [F.sum(c).over(context).alias(f"{c}_all") for c in ("yes", "no")] + [F.sum((F.col(c) > 0).cast("bigint")).over(context).alias(f"{c}_kinds") for c in ("yes", "no")]
    table = cut(sums.select("k", "part", "yes", "no", *wide))

    def chance(c: str, shorter: Column) -> Column:
        whole = F.col(f"{c}_all") + F.col(f"{c}_kinds")
        return F.when(whole > 0, (F.col(c) + F.col(f"{c}_kinds") * shorter) / whole).otherwise(shorter)

    known = table.where("k = 1").select("part", *[chance(c, F.lit(1.0 / ALPHABET)).alias(f"p_{c}") for c in ("yes", "no")])
    for k in range(2, order + 2):
        longer = table.where(F.col("k") == k).withColumn("end_", F.right("part", F.lit(k - 1)))
        known = longer.join(known.withColumnRenamed("part", "end_"), "end_").select("part", *[chance(c, F.col(f"p_{c}")).alias(f"p_{c}") for c in ("yes", "no")])
    return known.select(F.col("part").alias("run"), F.round((F.log("p_yes") - F.log("p_no")) * 1_000_000).cast("bigint").alias("diff"))


def model_scores(urls: DataFrame, order: int) -> DataFrame:
    """The columns of urls and score, in millionths for each character. urls: url, n, verdict (null if no rule fits), learned."""
    has = lambda verdict: F.sum(F.when(F.col("learned") & (F.col("verdict") == verdict), F.col("n")).otherwise(0))
    counted = cut(runs(urls, order).groupBy("run").agg(F.count("*").alias("places"), has("allow").alias("yes"), has("block").alias("no")))
    model = cut(differences(counted.select("run", "yes", "no"), order).join(counted.select("run", "places"), "run"))
    every = model.agg(F.sum("places").alias("every"))
    hot = model.join(F.broadcast(every), F.col("places") * HOT > F.col("every")).select("run", "diff")
    met = runs(urls.select("url"), order).join(F.broadcast(hot), "run", "left")
    near = met.groupBy("url").agg(F.coalesce(F.sum("diff"), F.lit(0)).alias("diff"), F.count("*").alias("length"))
    far = met.where("diff IS NULL").select("url", "run").join(model.select("run", F.col("diff").alias("rare")), "run").groupBy("url").agg(F.sum("rare").alias("diff"), F.lit(0).cast("bigint").alias("length"))
    total = near.unionByName(far).groupBy("url").agg((F.sum("diff") / F.sum("length")).alias("mean"))
    return urls.join(total, "url").withColumn("score", F.floor("mean")).drop("mean")


def threshold(scored: DataFrame) -> Column:
    """The step from which URLs are accepted: least sum of the shares of accepted ones below it and rejected ones from it on, among those
    that were not learned from; of equal ones that nearest 0, then the lower."""
    held = scored.where(~F.col("learned") & F.col("verdict").isNotNull()).groupBy(step(F.col("score")).alias("step"))
    sums = held.agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(c) for v, c in (("allow", "yes"), ("block", "no"))])
    # At most one row a step, 1001 in all; a URL at the step before the threshold is rejected, one at it accepted.
    steps = F.broadcast(sums.sparkSession.range(-STEPS, STEPS + 2).select(F.col("id").alias("step")))
    before, on = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = steps.join(sums, "step", "left").select("step", *[F.coalesce(c, F.lit(0)).cast("decimal(38,0)").alias(c) for c in ("yes", "no")])
    zero = F.lit(0).cast("decimal(38,0)")
    lost, kept = F.coalesce(F.sum("yes").over(before), zero), F.sum("no").over(on) - F.coalesce(F.sum("no").over(before), zero)
    rated = filled.select("step", lost.alias("lost"), kept.alias("kept"), F.sum("yes").over(on).alias("yes"), F.sum("no").over(on).alias("no")).where("yes > 0 AND no > 0")
    best = rated.agg(F.min(F.struct((F.col("lost") * F.col("no") + F.col("kept") * F.col("yes")).alias("errors"), F.abs("step").alias("far"), F.col("step"))).alias("x"))
    return best.select(F.coalesce(F.col("x.step"), F.lit(0).cast("bigint"))).scalar()


def step(score: Column) -> Column:
    return F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), F.floor(score / STEP))).cast("bigint")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score of every row of pages."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    urls = rows.groupBy("url").agg(F.count("*").alias("n"))
    urls = urls.select("url", "n", fitting(*parts(F.col("url")), rules)[1].alias("verdict"), (F.crc32("url") % FOLDS != 0).alias("learned"))
    # Many rows are made of each URL, so that few small partitions would be long tasks.
    scored = cut(model_scores(cut(urls.repartition(partitions(pages.sparkSession), "url")), order))
    scored = scored.withColumn("model", F.when(step(F.col("score")) >= threshold(scored), "allow").otherwise("block"))
    host, path = parts(F.col("url"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    out = join_hot(rows, scored.select("url", "n", "model", "score"), "url", "n", F.xxhash64("page_id"))
    out = out.withColumns({"host": host, "path": path})
    return out.select("page_id", "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, "model").alias("verdict"), (F.col("score") / 1_000_000).alias("score"))
