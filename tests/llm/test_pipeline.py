"""The pipeline's stages on the small tables, each against its own input."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from fleetrisk.llm import op2_exact, op3_simhash, op9_decontaminate

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, docs)
        if k < 4:
            assert docs.columns == columns and docs.count() == docs.distinct().count() <= before.count()
    before, after = seen["exact dedup"]
    assert {r.text for r in after.select("text").collect()} == {r.text for r in before.select("text").collect()} and after.count() == before.select("text").distinct().count()
    before, after = seen["SimHash near-dedup"]
    assert after.count() == op3_simhash.near_duplicates(before).select("component_id").distinct().count()
    before, after = seen["benchmark decontamination"]
    dirty = {r.doc_id for r in op9_decontaminate.find(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()} - dirty
    before, after = seen["packing"]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    before, _ = seen["exact dedup"]
    assert op2_exact.keep(before).count() == before.select("text").distinct().count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_whole_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and no labels: the rows that come out are those that plain Python leaves."""
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, "alpha beta gamma delta " * 40), (2, "alpha beta gamma delta " * 40), (3, f"some words before {passage} and some after it"), (4, None), (5, ""), (None, "a text that has no id at all but words enough to stand alone"),
            (6, " ".join(f"w{i}" for i in range(20_000))), (7, "yes"), (7, "yes"), (8, "zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("key_", "row_", "digest", "fp", "chunk"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "yes"), (None, passage), (3, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Of equal texts the largest id stays; the two empty ones are one text; the passage goes, a one-word item harms nobody.
    assert {r.doc_id for r in pieces} == {2, 5, None, 6, 7, 8}
    by_doc = collections.defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for parts in by_doc.values():
        at = 0
        for start, length, whole in sorted(parts):
            assert start == at
            at += length
        assert at == whole
