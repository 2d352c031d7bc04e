"""Writing results. Appends carry their date as partition; rewrites go through a new folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def append_scans(scans: DataFrame, path: str) -> None:
    """Scan rows, partitioned by the day of the scan. One file per day and task after coalescing on write."""
    s = scans.withColumn("scan_date", F.to_date("scanned_at"))
    s.repartition("scan_date", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("append").partitionBy("scan_date").parquet(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings bucketed by a hash of repository and path, so one large repository spreads over folders."""
    b = findings.withColumn("bucket", F.pmod(F.xxhash64("repo", F.coalesce("file_path", "package")), F.lit(64)).cast("int"))
    # Eight tasks a folder at most, instead of every task writing into every folder.
    b = b.repartition("bucket", F.pmod(F.xxhash64("repo", "file_path", "line_no", "rule_id", "package"), F.lit(8)))
    b.write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_sarif(documents: DataFrame, path: str) -> None:
    """One text line per SARIF document, in a folder per repository owner."""
    d = documents.withColumn("owner", F.substring_index("repo", "/", 1))
    d.select("owner", F.col("document").alias("value")).write.mode("overwrite").partitionBy("owner").text(path)


def append_scan_events(scans: DataFrame, path: str) -> None:
    """Structured event log: one JSON line per scan with outcome, duration and counts."""
    ok = F.col("risk_score").isNotNull()
    scans.select("id", "owner", "repo", F.col("scanned_at").alias("ts"), ok.alias("ok"), "duration_ms", "files_scanned", "secrets_count",
                 "deps_count", "risk_score").write.mode("append").json(path)
