"""Incremental scans: new file versions and commits in, findings and alerts out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetrisk.operators import calls, diff, iac, onepass, sast, score, secrets
from fleetrisk.operators.gates import scannable_files
from fleetrisk.schemas import FILES

FAMILIES = [secrets.TOKENS, sast.SAST, sast.BIZ, sast.TELLS]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of the files table, as a stream."""
    return spark.readStream.schema(FILES).parquet(path)


def stream_findings(files: DataFrame) -> DataFrame:
    """Stateless rule scan of a files stream."""
    return onepass.to_findings(sast.real_tells(onepass.scan_files(scannable_files(files), FAMILIES)), FAMILIES)


def scan_batch(files: DataFrame, as_of: Column) -> DataFrame:
    """Every content detector on one batch of files: all rule families, framework rules by the manifests in the batch, key/value
    entropy and call sites."""
    readable = scannable_files(files)
    families = [*FAMILIES, sast.FRAMEWORK, *iac.families(as_of)]
    hits = sast.in_framework(sast.real_tells(onepass.scan_files(readable, families)), sast.detect_frameworks(files))
    return score.flatten({"rules": onepass.to_findings(hits, families), "entropy": secrets.entropy_secrets(readable), "calls": calls.call_rules(calls.call_sites(readable))})


def append_scan(files: DataFrame, path: str, checkpoint: str, as_of: Column) -> StreamingQuery:
    """The findings of each micro-batch of files, all detectors; a replayed batch overwrites its own folder only."""
    def write(batch: DataFrame, batch_id: int) -> None:
        scan_batch(batch, as_of).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_findings(findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to a findings table; a replayed batch overwrites its own folder only."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_history(commits: DataFrame, tree: Callable[[], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Secrets of each micro-batch of commits that the current tree does not hold."""
    def write(batch: DataFrame, batch_id: int) -> None:
        secrets.history_secrets(batch, tree()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return commits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alerts(findings: DataFrame, known: Callable[[], DataFrame], path: str, checkpoint: str, ts: str = "seen_at", within: str = "1 day") -> StreamingQuery:
    """New findings against the last snapshot, each fingerprint once within the watermark."""
    fresh = findings.withColumn("fp", diff.fingerprint()).withWatermark(ts, within).dropDuplicatesWithinWatermark(["repo", "fp"])

    def write(batch: DataFrame, batch_id: int) -> None:
        old = known().withColumn("fp", diff.fingerprint()).select("repo", "fp").distinct()
        batch.join(old, ["repo", "fp"], "left_anti").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counters(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Scan events per window: totals, failures, degraded runs, mean duration; late rows fall to the watermark.

    ``events(ts, ok, degraded, duration_ms)``; the same code serves a finished table.
    """
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    g = e.groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("scans"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("degraded").alias("degraded"),
        F.avg("duration_ms").alias("mean_ms"))
    return g.select(F.col("w.start").alias("window_start"), "scans", "failed", "degraded", "mean_ms")
