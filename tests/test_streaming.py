import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from acrely.operators import activity, inventory
from acrely.operators.anomaly import AnomalyDetector
from acrely.sources import tables
from acrely.streaming import jobs


def pieces(df, path, order, n=3):
    """The table as files that arrive one after the other, in event order: one write per file."""
    parts = df.withColumn("_part", F.ntile(n).over(Window.orderBy(order))).persist()
    for i in range(1, n + 1):
        parts.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    parts.unpersist()
    return path


def shuffled(df, path, n=4):
    """The table as files of rows in no order."""
    df.repartition(n, F.xxhash64(*df.columns)).write.parquet(path)
    return path


def same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    a, b = a.select(names), b.select(names)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def events(spark, data, tmp_path_factory):
    return pieces(tables.table(spark, data, "events"), str(tmp_path_factory.mktemp("e") / "events"), "ts")


@pytest.fixture(scope="module")
def unordered(spark, data, tmp_path_factory):
    return shuffled(tables.table(spark, data, "events"), str(tmp_path_factory.mktemp("u") / "events"))


@pytest.mark.parametrize("order", ["events", "unordered"])
@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_event_counts_over_several_batches(spark, data, order, slide, request, tmp_path):
    out, length = str(tmp_path / "out"), "2 hours" if slide else "1 hour"
    raw = jobs.follow(spark, request.getfixturevalue(order), "*.parquet", files_per_batch=1)
    jobs.finish(jobs.event_counts(raw, out, str(tmp_path / "state"), length, slide))
    assert jobs.stored(spark, out).select("batch_id").distinct().count() >= 3
    same(jobs.counted_events(spark, out), activity.event_counts(tables.events(spark, data), length, slide))


@pytest.mark.parametrize("order", ["events", "unordered"])
def test_login_state_over_several_batches(spark, data, order, request, tmp_path):
    out = str(tmp_path / "out")
    raw = jobs.follow(spark, request.getfixturevalue(order), "*.parquet", 1)
    jobs.finish(jobs.login_state(raw, out, str(tmp_path / "state")))
    same(jobs.current(spark, out, ["user_id"]), activity.login_state(tables.events(spark, data)))


@pytest.mark.parametrize("order", ["events", "unordered"])
def test_sessions_over_several_batches(spark, data, order, request, tmp_path):
    out = str(tmp_path / "out")
    jobs.finish(jobs.sessions(jobs.follow(spark, request.getfixturevalue(order), "*.parquet", 1), out, str(tmp_path / "state")))
    same(jobs.session_table(spark, out), activity.sessions(tables.events(spark, data)))


def test_a_late_event_joins_two_sessions(spark, tmp_path):
    arrive = lambda *at: spark.createDataFrame(
        [(i, 1, "view", 1.0, "{}", f"2024-01-{x}") for i, x in enumerate(at)], "event_id long, user_id long, event_type string, value double, props string, ts string")
    out, state, inbox = (str(tmp_path / x) for x in ("out", "state", "in"))
    counts = []
    for days in (("01 00:00:00", "02 12:00:00"), ("01 18:00:00",)):
        arrive(*days).coalesce(1).write.mode("append").parquet(inbox)
        jobs.finish(jobs.sessions(jobs.follow(spark, inbox, "*.parquet", 1), out, state))
        counts.append(sorted(r.events for r in jobs.session_table(spark, out).collect()))
    assert counts == [[1, 1], [3]]


def test_compaction_keeps_every_row(spark, data, tmp_path):
    out, state, inbox = (str(tmp_path / x) for x in ("out", "state", "in"))
    merge, raw = jobs.summed(jobs.EVENT_KEYS, ["events"]), tables.table(spark, data, "events")
    shuffled(raw, inbox)
    for more in (raw.limit(0), raw.filter("event_id % 3 = 0"), raw.filter("event_id % 3 = 1")):
        more.coalesce(1).write.mode("append").parquet(inbox)
        jobs.finish(jobs.event_counts(jobs.follow(spark, inbox, "*.parquet", 2), out, state))
        assert jobs.compact(spark, out, merge) is not None and jobs.compact(spark, out, merge) is None
    everything = raw.unionByName(raw.filter("event_id % 3 < 2"))
    same(jobs.counted_events(spark, out), activity.event_counts(tables.typed_events(everything)))


def test_restart_does_not_count_twice(spark, data, events, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        jobs.finish(jobs.login_state(jobs.follow(spark, events, "*.parquet", 1), out, state))
    same(jobs.current(spark, out, ["user_id"]), activity.login_state(tables.events(spark, data)))


@pytest.fixture(scope="module")
def lines(spark, data, tmp_path_factory):
    return pieces(tables.table(spark, data, "lineitem"), str(tmp_path_factory.mktemp("l") / "lines"), "l_shipdate")


def test_inventory_edits(spark, data, lines, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    stream = tables.inventory_edits(jobs.follow(spark, lines, "*.parquet", 1))
    jobs.finish(jobs.inventory_edits(stream, out, log, str(tmp_path / "state")))
    base, edits = tables.inventory(spark, data), tables.inventory_edits(tables.table(spark, data, "lineitem"))
    same(jobs.edited_inventory(spark, base, out).drop("unit_types", "price_range"),
         inventory.save_edits(base, edits).drop("unit_types", "price_range"))
    assert spark.read.parquet(log).count() == edits.count()


def test_bookings_count_an_enquiry_once(spark, tmp_path):
    rows = [("P1", 1, "booked", "2024-01-01"), ("P1", 1, "booked", "2024-01-02"), ("P1", 2, "lost", "2024-01-02"),
            ("P1", 3, "booked", "2024-01-03"), ("P1", 1, "booked", "2024-01-04")]
    df = spark.createDataFrame(rows, "property_id string, enquiry_id long, status string, at string").withColumn("edited_at", F.col("at").cast("timestamp"))
    folder = pieces(df.drop("at"), str(tmp_path / "edits"), F.desc("edited_at"), 2)
    base = spark.createDataFrame([("P1", 5, 0), ("P2", 3, 0)], "property_id string, available_units int, booked_units int")
    out = str(tmp_path / "out")
    jobs.finish(jobs.bookings(jobs.follow(spark, folder, "*.parquet", 1), out, str(tmp_path / "state")))
    got = {r.property_id: (r.available_units, r.booked_units) for r in jobs.booked_inventory(spark, base, out).collect()}
    assert got == {"P1": (3, 2), "P2": (3, 0)}


def test_scoring_arriving_listings(spark, data, lines, listings, tmp_path):
    out = str(tmp_path / "out")
    detector = AnomalyDetector(use_forest=False).fit(listings)
    arriving = tables.listings(spark, data, jobs.follow(spark, lines, "*.parquet", 1))
    jobs.finish(jobs.score_listings(arriving, detector, out, str(tmp_path / "state")))
    columns = ["property_id", "z_score_price", "anomaly_flag", "anomaly_reason"]
    same(spark.read.parquet(out).select(columns), detector.detect(listings).select(columns))


def test_arriving_files_grow_in_number_not_in_size(spark, data, monkeypatch):
    from acrely.plans import queries
    seen = []
    monkeypatch.setattr(queries, "ARRIVING_ROWS", 500)
    monkeypatch.setattr(queries.jobs, "follow", lambda spark, path, pattern, files_per_batch: seen.append((path, files_per_batch)))
    queries._arriving(spark, data, "lineitem")
    (path, per_batch), = seen
    rows = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    raw = spark.read.parquet(f"{data}/lineitem.parquet")
    assert per_batch == -(-raw.count() // 2000) and max(rows) < 1000
    assert spark.read.parquet(path).exceptAll(raw).count() == 0 and sum(rows) == raw.count()
