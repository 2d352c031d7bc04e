"""Per-key quotas with windows anchored at the key's first event.

A window opens at the first event after the last one ended, not on the clock, so it is a
recurrence over a key's events in time order. The state per key is two values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetrisk.plans.materialise import materialise


@dataclass(frozen=True)
class Policy:
    limit: int
    window_ms: int = 3_600_000


#: Events of a key that one row may hold, and times that are folded in one piece.
SMALL, PIECE = 100_000, 300

# Anonymous quotas per address and per repository.
PER_ADDRESS, PER_REPO = Policy(10), Policy(5)
OUT = "id string, key string, ts timestamp, allowed boolean, remaining int, retry_after_s bigint"
_COLUMNS = ["id", "key", "ts", "allowed", "remaining", "retry_after_s"]


def decide(state: tuple[int, int] | None, now_ms: int, policy: Policy) -> tuple[tuple[int, int], bool, int, int]:
    """(state, allowed, remaining, retry_after) for one event; a denied event leaves the state alone."""
    if state is None or now_ms - state[1] >= policy.window_ms:
        state = (0, now_ms)
    count, start = state
    if count + 1 > policy.limit:
        return state, False, 0, max(1, math.ceil((start + policy.window_ms - now_ms) / 1000))
    return (count + 1, start), True, policy.limit - count - 1, 0


def quota(events: DataFrame, policy: Policy, small: int = SMALL) -> DataFrame:
    """Decisions for a finished table ``events(key, ts)``, with its ``id`` when it has one.

    Time is cut into buckets as long as the window, so a bucket holds at most one window start, and an event's window started in its own
    bucket or the one before: events meet their start by two equi-joins on (key, bucket), and are counted inside (key, start). No task
    holds more than a bucket of a key. Events without a time are left out; events of one key and millisecond count in order of time and id.
    """
    e = events.select(_id(events).alias("id"), "key", "ts", _ms(events).alias("ms")).where("ms IS NOT NULL")
    e = e.withColumn("bucket", _bucket(F.col("ms"), policy)).withColumn("k", _named(F.col("key")))
    starts = window_starts(e, policy, small).withColumn("bucket", _bucket(F.col("start"), policy))
    # One row a start for its own bucket and for the next: both starts an event may have, in one join.
    both = F.explode(F.array(F.struct("bucket", F.col("start").alias("own"), F.lit(None).cast("bigint").alias("before")), F.struct((F.col("bucket") + 1).alias("bucket"), F.lit(None).cast("bigint").alias("own"), F.col("start").alias("before"))))
    near = starts.select("k", both.alias("x")).select("k", "x.*")
    near = near.groupBy("k", "bucket").agg(F.max("own").alias("own"), F.max("before").alias("before"))
    e = e.join(near, ["k", "bucket"]).withColumn("start", F.when(F.col("own") <= F.col("ms"), F.col("own")).otherwise(F.col("before")))
    # The events of one window, which is as long as a bucket.
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("k", "start").orderBy("ts", "id")))
    n = F.col("n")
    ok, wait = n <= policy.limit, F.ceil((F.col("start") + policy.window_ms - F.col("ms")) / 1000)
    return e.select("id", "key", "ts", ok.alias("allowed"), F.when(ok, policy.limit - n).otherwise(0).cast("int").alias("remaining"),
                    F.when(ok, 0).otherwise(F.greatest(F.lit(1), wait)).cast("bigint").alias("retry_after_s"))


def _ms(events: DataFrame) -> Column:
    """Milliseconds since 1970; times without a zone count as they are written, whatever the session's zone."""
    if events.schema["ts"].dataType != T.TimestampNTZType():
        return F.floor(F.unix_micros("ts") / 1000)
    span = F.expr("ts - timestamp_ntz'1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), span)
    return F.floor(((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")).cast("bigint") * 60_000 + part("SECOND") * 1000).cast("bigint")


def _bucket(ms: Column, policy: Policy) -> Column:
    return F.floor(ms / policy.window_ms)


def _named(key: Column) -> Column:
    """A key that joins also where it is null."""
    return F.struct(key.isNull().alias("none"), F.coalesce(key.cast("string"), F.lit("")).alias("name"))


def window_starts(events: DataFrame, policy: Policy, small: int = SMALL) -> DataFrame:
    """(k, start): the first event of every window of every key. ``events(k, ms, bucket)``.

    Keys with up to ``small`` events are folded in one row each. Of longer ones, no task takes the whole: each time finds the window
    start that would follow it, in its neighbour bucket or from one row per bucket; then the starts that the key's first event leads to are
    followed by pointer doubling: jumps of 1, 2, 4, ... windows, as many as the longest key has, and from the first event along all of them.
    """
    many = materialise(events.groupBy("k").agg(F.count("*").alias("n"), F.min("ms").alias("first")).where(F.col("n") > small).select("k", "first"))
    if many.isEmpty():
        return _folded(events, policy)
    times = events.select("k", "bucket", "ms").distinct()
    buckets = times.groupBy("k", "bucket").agg(F.min("ms").alias("first"))
    # The keys meet one row a bucket, and times meet those: a long key is many small groups.
    few = buckets.join(many.select("k"), "k", "left_anti").select("k", "bucket")
    return _folded(times.join(few, ["k", "bucket"], "left_semi"), policy).unionByName(_followed(times, buckets, many, policy))


def _folded(times: DataFrame, policy: Policy) -> DataFrame:
    """(k, start) of short keys: a fold over a key's times in order, in pieces, so that no long array is copied for every window."""
    pieces = F.transform(F.sequence(F.lit(1), F.size("ms"), F.lit(PIECE)), lambda i: F.slice(F.col("ms"), i, PIECE))
    state = lambda last, rest: F.struct(last.cast("bigint").alias("last"), rest.alias("starts"))
    one = lambda acc, x: F.when(acc["last"].isNull() | (x >= acc["last"] + policy.window_ms), state(x, F.concat(acc["starts"], F.array(x)))).otherwise(acc)
    none = F.array().cast("array<bigint>")

    def piece(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, state(acc["last"], none), one)
        return F.transform(F.array(done), lambda d: state(d["last"], F.concat(acc["starts"], F.array(d["starts"]))))[0]

    found = F.aggregate(pieces, state(F.lit(None), F.array().cast("array<array<bigint>>")), piece)["starts"]
    gathered = times.groupBy("k").agg(F.sort_array(F.collect_set("ms")).alias("ms"))
    return gathered.select("k", F.explode(F.flatten(found)).alias("start"))


def _followed(times: DataFrame, buckets: DataFrame, many: DataFrame, policy: Policy) -> DataFrame:
    """(k, start) of the keys in ``many(k, first)``."""
    buckets = buckets.join(many.select("k"), "k", "left_semi")
    by_bucket = Window.partitionBy("k").orderBy("bucket")  # one row a bucket
    one, two = (F.lead(F.struct("bucket", "first"), i).over(by_bucket) for i in (1, 2))
    beyond = F.when(one["bucket"] == F.col("bucket") + 1, two["first"]).otherwise(one["first"])
    buckets = buckets.select("k", "bucket", beyond.alias("beyond"))
    own = times.join(buckets, ["k", "bucket"])
    # A time asks in the next bucket for the first time that is no nearer than a window.
    probes = own.select("k", (F.col("bucket") + 1).alias("bucket"), (F.col("ms") + policy.window_ms).alias("at"), F.col("ms").alias("asks"), "beyond")
    stand = own.select("k", "bucket", F.col("ms").alias("at"), F.lit(None).cast("bigint").alias("asks"), F.lit(None).cast("bigint").alias("beyond"))
    later = Window.partitionBy("k", "bucket").orderBy(F.desc("at"), F.asc_nulls_first("asks")).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("asks").isNull(), F.col("at")), ignorenulls=True).over(later)
    jumps = probes.unionByName(stand).withColumn("found", found).where("asks IS NOT NULL")
    jumps = materialise(jumps.select("k", F.col("asks").alias("ms"), F.coalesce("found", "beyond").alias("to")).where("to IS NOT NULL"))
    levels = [jumps]
    # Twice as far each time, until no time has so many windows after it.
    while not levels[-1].isEmpty():
        further = levels[-1].select("k", F.col("ms").alias("to"), F.col("to").alias("next"))
        levels.append(materialise(levels[-1].join(further, ["k", "to"]).select("k", "ms", F.col("next").alias("to"))))
    starts = many.select("k", F.col("first").alias("start"))
    for level in reversed(levels[:-1]):
        starts = materialise(starts.unionByName(starts.join(level.withColumnRenamed("ms", "start"), ["k", "start"]).select("k", F.col("to").alias("start"))))
    return starts


def _id(events: DataFrame) -> Column:
    return (F.col("id") if "id" in events.columns else F.lit(None)).cast("string")


def two_stage(events: DataFrame, address: Policy = PER_ADDRESS, repo: Policy = PER_REPO) -> DataFrame:
    """``events(id, address, repo, ts)`` checked per address, those let through per repository; both must pass."""
    a = quota(events.withColumnRenamed("address", "key"), address)
    through = events.join(a.where("allowed").select("id"), "id", "left_semi")
    b = quota(through.withColumnRenamed("repo", "key"), repo).where("allowed").select("id", F.lit(True).alias("_ok"))
    return events.join(b, "id", "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok")


class QuotaProcessor(StatefulProcessor):
    """The same recurrence over a stream: two values per key, dropped when the window has passed."""

    def __init__(self, policy: Policy):
        self._policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("window", T.StructType([T.StructField("count", T.LongType()), T.StructField("start", T.LongType())]))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        got = self._state.get() if self._state.exists() else None
        state = (int(got[0]), int(got[1])) if got is not None else None
        out = []
        for ts, i in sorted((ts, i) for pdf in rows for ts, i in zip(pdf["ts"], pdf["id"])):
            state, ok, left, wait = decide(state, ts.value // 1_000_000, self._policy)
            out.append((i, key[0], ts, ok, left, wait))
        if out:
            self._state.update(state)
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(state[1] + self._policy.window_ms)
            yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timer_values, expired_timer_info) -> Iterator[pd.DataFrame]:
        self._state.clear()
        return iter([])

    def close(self) -> None:
        pass


def quota_stream(events: DataFrame, policy: Policy, delay: str = "1 minute") -> DataFrame:
    """Streaming ``events(key, ts)``; state of a key expires with its window by event time."""
    return events.select(_id(events).alias("id"), "key", "ts").withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(
        statefulProcessor=QuotaProcessor(policy), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
