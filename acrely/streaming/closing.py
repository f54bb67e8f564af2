"""Streams with an end: a watermark closes windows and sessions, and state shrinks as it moves on.

`lateness` is how far rows may arrive behind the newest one seen. A row within it is counted wherever it
belongs; what is closed leaves the state, is written once and never changes. Rows that come later still
are not part of what was closed: `late_counts` finds them against a job that drops nothing, and
`dropped` says how many groups or rows a job has turned away.

Groups combine before the shuffle, so a hot user or event type is a few rows a task. All three jobs keep their state in
RocksDB when the session is prepared with `disk_state`, and go on from their checkpoint after a failure.

Defined cases: rows without a time belong to no window or session; an empty stream writes no row; a
repeated row counts each time, but for `append_once`, which is there to tell repeats.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acrely.operators import activity
from acrely.sources.tables import typed_events
from acrely.streaming import jobs

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside keep their state on the executors' disks; settings are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _timed(raw: DataFrame, lateness: str) -> DataFrame:
    events = typed_events(raw)
    return events.filter(F.col("ts").isNotNull()).withWatermark("ts", lateness)


# ---- windows ------------------------------------------------------------------
def final_counts(
    raw: DataFrame, sink: str, checkpoint: str, lateness: str, length: str = "1 hour", slide: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Counts per type and window, written once when the watermark has passed the window's end."""
    return jobs.append_log(activity.event_counts(_timed(raw, lateness), length, slide), sink, checkpoint, trigger)


def late_counts(arrived: DataFrame, final: DataFrame, closed_at: str) -> DataFrame:
    """Events per closed window that its final count does not hold: (keys, late), only where there are any.

    `arrived` are the counts of `jobs.event_counts` over the same stream; `closed_at` is `watermark` of the
    finished job.
    """
    closed = arrived.filter(F.col("window_end") <= F.lit(closed_at).cast("timestamp"))
    known = final.select(*jobs.EVENT_KEYS, F.col("events").alias("_final"))
    found = closed.join(known, list(jobs.EVENT_KEYS), "left")
    return found.withColumn("late", F.col("events") - F.coalesce("_final", F.lit(0))).filter("late > 0").select(*jobs.EVENT_KEYS, "late")


# ---- sessions -----------------------------------------------------------------
def closed_sessions(
    raw: DataFrame, sink: str, checkpoint: str, lateness: str, gap_hours: int = activity.SESSION_HOURS, trigger: dict | None = None,
) -> StreamingQuery:
    """Sessions of a user, written once when the watermark is `gap_hours` past the last event.

    Events exactly `gap_hours` apart are two sessions, as in `activity.sessions`.
    """
    gap = F.session_window("ts", f"{gap_hours * 3_600_000_000 - 1} microseconds")  # Spark joins sessions that touch
    closed = _timed(raw, lateness).groupBy(gap, "user_id").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("last_event"), F.count("*").alias("events"))
    return jobs.append_log(closed.select("user_id", "session_start", "last_event", "events"), sink, checkpoint, trigger)


# ---- repeats --------------------------------------------------------------------
def append_once(
    rows: DataFrame, keys: Sequence[str], at: str, sink: str, checkpoint: str, lateness: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Append rows that may be delivered more than once, each key once.

    A key is forgotten when the watermark has passed its time by `lateness`, so the state holds the keys of that
    span and not of all time. A copy that comes later than that is too late to be taken at all.
    """
    once = rows.filter(F.col(at).isNotNull()).withWatermark(at, lateness).dropDuplicatesWithinWatermark(list(keys))
    return jobs.append_log(once, sink, checkpoint, trigger)


# ---- what a job has done ----------------------------------------------------------
def watermark(query: StreamingQuery) -> str | None:
    """How far time is closed for a job that has run: nothing at or before this moment is open."""
    seen = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in (p["eventTime"] or {})]
    return max(seen, default=None)


def dropped(query: StreamingQuery) -> int:
    """Rows (after the map-side combine) that came too late in the recorded batches of a job."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
