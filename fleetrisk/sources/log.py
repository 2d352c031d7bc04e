"""A table of stored suppressions as commits: additions and deletions are written beside the table and merged when it is read.

Each commit is a folder of its own, written by one ordinary Spark job; the marker file that the job's commit writes last makes it visible.
So a job that dies leaves nothing that readers see, and two writers at once do not meet. A deletion writes its own rows only. Reading takes
the last entry of each (id, user): one aggregation by a key that few rows share. ``compact`` writes the last entries as one folder and names
the commits that it stands for; they may be removed once no reader uses them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetrisk.schemas import SUPPRESSION_ROWS

_ENTRY = SUPPRESSION_ROWS + ", op string, seq bigint, commit string"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return hadoop, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commit(rows: DataFrame, path: str, op: str, seq: int | None, kind: str = "") -> str:
    """Writes rows as one commit and returns its name."""
    seq = time.time_ns() // 1000 if seq is None else seq
    name = f"{seq:020}-{uuid.uuid4().hex}{kind}"
    full = rows.withColumn("op", F.lit(op)).withColumn("seq", F.lit(seq).cast("bigint")).withColumn("commit", F.lit(name))
    have = set(full.columns)
    empty = rows.sparkSession.createDataFrame([], _ENTRY)
    full.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema]).write.mode("errorifexists").parquet(f"{path}/{name}")
    return name


def append(rows: DataFrame, path: str, seq: int | None = None) -> str:
    """Adds rows, or replaces those of the same id and user. seq: the order of commits, by default the time."""
    return _commit(rows, path, "put", seq)


def delete(requests: DataFrame, path: str, seq: int | None = None) -> str:
    """Removes the rows of ``requests(id, user_id)``; a request does nothing to a row of another user."""
    return _commit(requests.select("id", "user_id"), path, "delete", seq)


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of all finished commits, in order."""
    hadoop, fs = _fs(spark, path)
    names = sorted(s.getPath().getParent().getName() for s in fs.globStatus(hadoop.Path(f"{path}/*/_SUCCESS")) or [])
    return [n for n in names if not n.endswith(".of")]


def commits(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders that make up the table now: finished ones, less those that the last compaction stands for."""
    names = finished(spark, path)
    done = [n for n in names if n.endswith("-all")]
    # Its list was finished before it was written.
    covered = {r.value for r in spark.read.text(f"{path}/{done[-1]}.of").collect()} if done else set()
    return [n for n in names if n not in covered]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows that are left, as stored."""
    names = commits(spark, path)
    columns = [f.name for f in spark.createDataFrame([], SUPPRESSION_ROWS).schema]
    if not names:
        return spark.createDataFrame([], SUPPRESSION_ROWS)
    entries = spark.read.schema(_ENTRY).parquet(*[f"{path}/{n}" for n in names])
    return last_entries(entries).where("op <> 'delete'").select(*columns)


def last_entries(entries: DataFrame) -> DataFrame:
    """The last entry of each id and user, deletions included."""
    rest = F.struct(*[c for c in entries.columns if c not in ("id", "user_id")])
    return entries.groupBy("id", "user_id").agg(F.max_by(rest, F.struct("seq", "commit")).alias("last")).select("id", "user_id", "last.*")


def compact(spark: SparkSession, path: str) -> str | None:
    """Writes the last entries of all finished commits as one, deletions too: a commit of an earlier time that finishes later still loses to them."""
    covered, names = finished(spark, path), commits(spark, path)
    if not names:
        return None
    rows = last_entries(spark.read.schema(_ENTRY).parquet(*[f"{path}/{n}" for n in names]))
    # Later than all that it stands for, so that the last compaction is the one to read.
    seq = max(time.time_ns() // 1000, int(covered[-1].split("-")[0]) + 1)
    name = f"{seq:020}-{uuid.uuid4().hex}-all"
    spark.createDataFrame([(n,) for n in covered], "value string").coalesce(1).write.text(f"{path}/{name}.of")
    rows.select(*[f.name for f in spark.createDataFrame([], _ENTRY).schema]).write.parquet(f"{path}/{name}")
    return name
