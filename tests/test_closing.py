import pytest
from pyspark.sql import functions as F

from acrely.operators import activity
from acrely.sources import tables
from acrely.streaming import closing, jobs
from tests.test_streaming import same

SCHEMA = "event_id long, user_id long, event_type string, value double, props string, ts string"


def arrive(spark, inbox, rows):
    """One file of events (user, time)."""
    rows = [(i, user, "view", 1.0, "{}", at) for i, (user, at) in enumerate(rows)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / x) for x in ("in", "out", "state")]


def test_windows_close_and_late_rows_are_told(spark, folders, tmp_path):
    inbox, out, state = folders
    files = [["01 10:10", "01 10:50", "01 11:05"], ["01 10:20", "01 14:00"], ["01 15:30", "01 10:30"], ["01 10:40", "01 18:00"]]
    for times in files:
        arrive(spark, inbox, [(1, f"2024-01-{t}:00") for t in times])
    stream = jobs.follow(spark, inbox, "*.parquet", 1)
    with closing.disk_state(spark):
        done = closing.final_counts(stream, out, state, "2 hours")
        jobs.finish(done)
    jobs.finish(jobs.event_counts(jobs.follow(spark, inbox, "*.parquet", 1), f"{out}-all", f"{state}-all"))
    upto = closing.watermark(done)
    assert upto.startswith("2024-01-01T16:00")
    final, arrived = spark.read.parquet(out), jobs.counted_events(spark, f"{out}-all")
    late = closing.late_counts(arrived, final, upto)
    assert closing.dropped(done) >= 1 and late.count() >= 1
    whole = final.unionByName(late.withColumnRenamed("late", "events"))
    twin = activity.event_counts(tables.typed_events(spark.read.parquet(inbox))).filter(F.col("window_end") <= F.lit(upto).cast("timestamp"))
    same(jobs.summed(jobs.EVENT_KEYS, ["events"])(whole), twin)
    # One row per window: what was closed is never written again.
    assert final.groupBy(*jobs.EVENT_KEYS).count().filter("count > 1").isEmpty()
    hours = {r.window_start.hour: r.events for r in final.collect()}
    assert hours[10] in (3, 4) and hours[11] == 1 and hours[14] == 1 and 18 not in hours


def test_sessions_close_at_the_gap(spark, folders):
    inbox, out, state = folders
    arrive(spark, inbox, [(1, "2024-01-01 00:00:00"), (1, "2024-01-02 12:00:00"), (2, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")])
    arrive(spark, inbox, [(1, "2024-01-01 18:00:00"), (3, "2024-01-04 06:00:00"), (2, "2024-01-02 23:59:59.999999")])
    arrive(spark, inbox, [(4, "2024-01-06 00:00:00"), (4, None)])
    with closing.disk_state(spark):
        jobs.finish(closing.closed_sessions(jobs.follow(spark, inbox, "*.parquet", 1), out, state, "48 hours"))
    got = {(r.user_id, str(r.session_start), str(r.last_event), r.events) for r in spark.read.parquet(out).collect()}
    assert got == {  # user 1's late event joins two sessions; user 2's events a day apart are two; 3 and 4 are open
        (1, "2024-01-01 00:00:00", "2024-01-02 12:00:00", 3), (2, "2024-01-01 00:00:00", "2024-01-01 00:00:00", 1),
        (2, "2024-01-02 00:00:00", "2024-01-02 23:59:59.999999", 2)}


def test_a_restarted_job_goes_on(spark, folders):
    inbox, out, state = folders
    for day in ("01", "03", "05", "07", "09"):
        arrive(spark, inbox, [(1, f"2024-01-{day} 00:00:00"), (2, f"2024-01-{day} 01:00:00")])
        jobs.finish(closing.closed_sessions(jobs.follow(spark, inbox, "*.parquet", 1), out, state, "1 hour"))
    found = spark.read.parquet(out)
    assert found.count() == found.distinct().count() == 8 and found.agg(F.max("events")).first()[0] == 1


def test_copies_are_appended_once_and_forgotten(spark, folders):
    inbox, out, state = folders
    rows = lambda *at: spark.createDataFrame(
        [(k, f"2024-01-{t}:00") for k, t in at], "k string, at string").select("k", F.col("at").cast("timestamp").alias("at"))
    for part in (rows(("a", "01 00:00"), ("a", "01 00:00"), ("b", "01 03:00")), rows(("b", "01 03:00"), ("c", "03 00:00"), (None, "03 00:00")),
                 rows(("c", "03 00:00"), (None, "03 00:00"), ("d", "05 00:00")), rows(("d", "05 00:00"))):
        part.coalesce(1).write.mode("append").parquet(inbox)
    stream = jobs.follow(spark, inbox, "*.parquet", 1)
    done = closing.append_once(stream, ["k"], "at", out, state, "12 hours")
    jobs.finish(done)
    assert sorted((r.k or "-") for r in spark.read.parquet(out).collect()) == ["-", "a", "b", "c", "d"]
    left = done.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert left == 1  # only d can still be repeated


def test_an_empty_stream_writes_no_row(spark, folders):
    inbox, out, state = folders
    arrive(spark, inbox, [(1, None)])
    done = closing.final_counts(jobs.follow(spark, inbox, "*.parquet", 1), out, state, "2 hours")
    jobs.finish(done)
    assert spark.read.schema("events long").parquet(out).isEmpty()
