"""The registered queries of the operators: whole tables, production parameters; digests are derived from the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk.llm import (checks, op1_suffix, op2_exact, op3_simhash, op4_toxicity, op5_html, op6_quality, op7_substring, op8_packing, op9_decontaminate,
                           op10_token_counts, op11_urls, op12_resample, op13_search)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op1_suffix.remove(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_exact.duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op3_simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_html.extract(table(spark, sf_dir, "pages"))


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op7_substring.remove(table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, share=0.8)


def op10_token_length_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least=20, seed="2024", buckets=10_000, longest=1)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10, a=100, b=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_toxicity_scores": op4_toxicity_scores,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality_scores": op6_quality_scores,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_decontamination": op9_decontamination,
    "op10_token_length_counts": op10_token_length_counts,
    "op11_url_filter": op11_url_filter,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_ranked_search": op13_ranked_search,
}

#: DuckDB SQL of the queries that SQL can express on whole tables.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = "SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM (SELECT {id} AS id, regexp_extract_all(" + _LOWER + ", '[^\\x20\\x09-\\x0D]+') AS w FROM {table}) WHERE len(w) >= 5"
SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS body, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                     count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size FROM documents)""",
    "op9_decontamination": f"""
        WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}), b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
             n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
        SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared, any_value(n.n) AS n_shingles, count(*) / any_value(n.n) AS containment
        FROM d JOIN b ON d.s = b.s JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING count(*) >= ceil(0.8 * any_value(n.n) - 1e-9)""",
    "op11_url_filter": checks.urls(),
    "op12_importance_resampling": checks.resample(),
    "op13_ranked_search": checks.search(),
}
