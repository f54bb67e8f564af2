"""Structured Streaming jobs over the activity log, inventory edits and arriving listings.

Rows may arrive in any order and however late. No job drops a late row: every micro-batch is reduced to
partial results that can be merged (counts, time slots, distinct keys, last edits) and written to a folder
named after its id, and a reader merges what the batches hold. A batch that runs again after a failure
replaces itself. `compact` folds old batches into one table, so a reader's work follows the number of keys and
not the age of the job.

`trigger` is passed on to the writer; by default a job works through the files present and ends.
`follow` bounds a micro-batch by bytes, or by files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acrely.functions.money import investment_columns
from acrely.operators import activity
from acrely.operators import inventory as inv
from acrely.operators.anomaly import AnomalyDetector
from acrely.operators.features import enrich
from acrely.sources.tables import typed_events

BATCH_BYTES = 8 * 1024 ** 3  # input of one micro-batch
Merge = Callable[[DataFrame], DataFrame]


def follow(
    spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """A stream of the parquet files `name` in `folder`, with the stored schema."""
    pattern = name if "*" in name else f"{name}.parquet"
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    limit = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", batch_bytes)
    return reader.option(*limit).parquet(folder)


def _start(
    stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", trigger: dict | None = None,
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode).foreachBatch(each)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def _write_batches(sink: str, reduce: Merge = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    return write


# ---- what the batches hold ------------------------------------------------
def _finished(spark: SparkSession, folder: str) -> list[int]:
    """Ids of the batch folders below `folder` that were written to the end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = []
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("batch_id=") and fs.exists(done):
            found.append(int(name.removeprefix("batch_id=")))
    return sorted(found)


def stored(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of all batches with their `batch_id`: the last compaction and the batches after it."""
    old = _finished(spark, f"{sink}/_compacted")[-1:]
    new = [i for i in _finished(spark, sink) if not old or i > old[0]]
    parts = [(f"{sink}/_compacted", old), (sink, new)]
    read = [
        spark.read.option("basePath", base).parquet(*[f"{base}/batch_id={i}" for i in ids]) for base, ids in parts if ids]
    if not read:
        raise FileNotFoundError(f"no finished batch in {sink}")
    return read[0] if len(read) == 1 else read[0].unionByName(read[1])


def compact(spark: SparkSession, sink: str, merge: Merge) -> int | None:
    """Fold all finished batches into one table and delete them; the id of the last batch folded.

    The folded table counts from the moment it is complete, and a reader then passes over the batches in
    it, so a failure at any point neither loses nor doubles a row. `merge` must be able to merge its own
    output again; `batch_id` is not part of it.
    """
    ids, before = _finished(spark, sink), _finished(spark, f"{sink}/_compacted")
    if not ids or ids[-1] in before:
        return None
    merge(stored(spark, sink)).write.mode("overwrite").parquet(f"{sink}/_compacted/batch_id={ids[-1]}")
    for folder in [f"{sink}/batch_id={i}" for i in ids] + [f"{sink}/_compacted/batch_id={i}" for i in before]:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return ids[-1]


def latest(keys: Sequence[str]) -> Merge:
    """The row of the last batch that updated each key."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys and c != "batch_id"]
        last = rows.groupBy(*keys).agg(F.max(F.struct("batch_id", *rest)).alias("_last"))
        return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
    return merge


def summed(keys: Sequence[str], counts: Sequence[str]) -> Merge:
    """Counts per key, added up."""
    return lambda rows: rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def current(spark: SparkSession, sink: str, keys: Sequence[str]) -> DataFrame:
    return latest(keys)(stored(spark, sink))


# ---- jobs --------------------------------------------------------------------
EVENT_KEYS = ("window_start", "window_end", "event_type")


def append_log(entries: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append log entries to a table, each exactly once."""
    return (
        entries.writeStream.outputMode("append").format("parquet").option("path", sink)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def event_counts(
    raw: DataFrame, sink: str, checkpoint: str, length: str = "1 hour", slide: str | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Counts per type and window; a late event adds to its window in a later batch."""
    count = _write_batches(sink, lambda batch: activity.event_counts(batch, length, slide))
    return _start(typed_events(raw), checkpoint, count, trigger=trigger)


def counted_events(spark: SparkSession, sink: str) -> DataFrame:
    return summed(EVENT_KEYS, ["events"])(stored(spark, sink))


def login_state(raw: DataFrame, sink: str, checkpoint: str, kind: str = "view", trigger: dict | None = None) -> StreamingQuery:
    """Running login count and last login per user, kept as state."""
    logins = typed_events(raw).filter(F.col("event_type") == kind)
    state = logins.groupBy("user_id").agg(F.count("*").alias("login_count"), F.max("ts").alias("last_login"))
    return _start(state, checkpoint, _write_batches(sink), "update", trigger)


def sessions(
    raw: DataFrame, sink: str, checkpoint: str, gap_hours: int = activity.SESSION_HOURS, trigger: dict | None = None,
) -> StreamingQuery:
    """Time slots of activity per user; a late event joins its slot, and may join two sessions."""
    slots = _write_batches(sink, lambda batch: activity.session_slots(batch, gap_hours))
    return _start(typed_events(raw), checkpoint, slots, trigger=trigger)


def session_table(spark: SparkSession, sink: str, gap_hours: int = activity.SESSION_HOURS) -> DataFrame:
    """All sessions of the events so far, those that are still open included."""
    return activity.sessions_of(activity.merge_slots(stored(spark, sink)), gap_hours)


def booked_keys(edits: DataFrame) -> DataFrame:
    return edits.filter(F.col("status") == "booked").select("property_id", "enquiry_id").distinct()


def bookings(edits: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The enquiries booked in every batch; an enquiry counts once however often it is edited."""
    return _start(edits, checkpoint, _write_batches(sink, booked_keys), trigger=trigger)


def distinct_keys(rows: DataFrame) -> DataFrame:
    return rows.select("property_id", "enquiry_id").distinct()


def booked_inventory(spark: SparkSession, base: DataFrame, sink: str) -> DataFrame:
    counts = distinct_keys(stored(spark, sink)).groupBy("property_id").agg(F.count("*").alias("booked_enquiries"))
    return inv.apply_bookings(base, counts)


def inventory_edits(edits: DataFrame, sink: str, log_sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The last edit per property of every batch, and an audit entry per edit."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        last_edits(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        inv.audit_events(batch).write.mode("overwrite").parquet(f"{log_sink}/batch_id={batch_id}")
        batch.unpersist()

    return _start(edits, checkpoint, write, trigger=trigger)


def last_edits(rows: DataFrame) -> DataFrame:
    return inv.latest(rows.drop("batch_id"), "property_id", ["edited_at", "sequence"])


def edited_inventory(spark: SparkSession, base: DataFrame, sink: str) -> DataFrame:
    """The base with the newest edit of every property; edits that arrive late do not win."""
    return inv.save_edits(base, stored(spark, sink).drop("batch_id"))


def score_listings(
    arriving: DataFrame, detector: AnomalyDetector, sink: str, checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Features, flags and investment figures of arriving listings, with fitted parameters."""
    scored = detector.detect(enrich(arriving)).withColumns(investment_columns())
    return append_log(scored, sink, checkpoint, trigger)


def finish(query: StreamingQuery) -> None:
    """Wait for a job that was started on the files present."""
    query.awaitTermination()
