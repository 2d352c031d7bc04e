"""Usage analytics over the scans table. Plain Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def new_users_per_day(scans: DataFrame) -> DataFrame:
    first = scans.groupBy("user_id").agg(F.min("scanned_at").alias("first_scan_at"))
    return first.groupBy(F.to_date(F.date_trunc("day", "first_scan_at")).alias("day")).agg(F.count(F.lit(1)).alias("new_users"))


def scans_per_day(scans: DataFrame) -> DataFrame:
    return scans.groupBy(F.to_date("scanned_at").alias("day")).agg(
        F.count(F.lit(1)).alias("scans"), F.count_distinct("user_id").alias("distinct_users"))


def _since(scans: DataFrame, now: Column, days: int) -> DataFrame:
    return scans.where(F.col("scanned_at") >= now - F.expr(f"interval {days} days"))


def active_users(scans: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return _since(scans, now, days).agg(F.count_distinct("user_id").alias("active_users_7d"))


def scans_per_user(scans: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return _since(scans, now, days).groupBy("user_id").agg(F.count(F.lit(1)).alias("scans_last_7d"))


def retention(scans: DataFrame, days: int = 7) -> DataFrame:
    """Users who came back on another calendar day within ``days`` of their first scan.

    Two aggregates keyed by user: the first scan, then whether any later scan qualifies.
    """
    first = scans.groupBy("user_id").agg(F.min("scanned_at").alias("first_at"))
    back = (F.to_date("scanned_at") != F.to_date("first_at")) & (F.col("scanned_at") <= F.col("first_at") + F.expr(f"interval {days} days"))
    per = scans.join(first, "user_id").groupBy("user_id").agg(F.bool_or(back).alias("returned"))
    n, r = F.count(F.lit(1)), F.count_if("returned")
    return per.agg(n.alias("total_users"), r.alias("retained_7d_users"),
                   F.when(n > 0, F.round(100.0 * r / n, 1)).alias("retention_7d_pct"))


def top_repos(scans: DataFrame, now: Column, days: int = 30, k: int = 20) -> DataFrame:
    return _since(scans, now, days).groupBy(F.concat("owner", F.lit("/"), "repo").alias("repository")).agg(
        F.count(F.lit(1)).alias("scans"), F.count_distinct("user_id").alias("distinct_users")
    ).orderBy(F.desc("scans"), "repository").limit(k)


def multi_repo_users(scans: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    per = user_breakdown(scans, excluded)
    return per.where(F.col("distinct_repos") >= 2).agg(F.count(F.lit(1)).alias("pull_users_2plus_repos"))


def user_breakdown(scans: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    s = scans.where(~F.col("user_id").isin(excluded)) if excluded else scans
    return s.groupBy("user_id").agg(
        F.count_distinct(F.concat("owner", F.lit("/"), "repo")).alias("distinct_repos"), F.count(F.lit(1)).alias("total_scans"),
        F.min("scanned_at").alias("first_scan"), F.max("scanned_at").alias("last_scan"))


def stabilise_ids(scans: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace legacy user ids; ``mapping(legacy_id, user_id)`` with unmapped ids kept."""
    m = mapping.select(F.col("legacy_id").alias("user_id"), F.col("user_id").alias("_new"))
    return scans.join(m, "user_id", "left").withColumn("user_id", F.coalesce("_new", "user_id")).select(*scans.columns)
