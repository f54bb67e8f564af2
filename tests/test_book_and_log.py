from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from acrely.functions import labels
from acrely.functions.sql_functions import register
from acrely.operators import activity, enquiries, inventory

INV = "property_id string, total_units int, available_units int, booked_units int, note string"


@pytest.mark.parametrize("price,label", [
    (12_500_000.0, "1.3Cr"), (10_000_000.0, "1.0Cr"), (9_999_999.0, "100.0L"), (450_000.0, "4.5L"), (100_000.0, "1.0L"),
    (99_999.0, "99,999"), (950.0, "950"), (99_999.6, "99,999.6"), (95_123.45, "95,123.45"), (-20_000_000.0, "-2,00,00,000"),
    (0.0, "0"), (-1234.5678, "-1,234.568"), (1000.0, "1,000"), (-150_000.0, "-1,50,000"), (0.25, "0.25")])
def test_price_label(spark, price, label):
    assert spark.range(1).select(labels.price_label(F.lit(price))).first()[0] == label
    register(spark)
    assert spark.range(1).select(F.call_function("price_label", F.lit(price))).first()[0] == label


def test_date_and_status_labels(spark):
    df = spark.createDataFrame([(date(2024, 3, 5), "booked"), (None, "??"), (None, None)], "d date, s string")
    got = df.select(labels.date_label("d"), labels.status_badge("s")).collect()
    assert [tuple(r) for r in got] == [("05 Mar 2024", "badge-green"), ("—", "badge-gray"), ("—", "badge-gray")]


def test_lists(spark):
    df = spark.createDataFrame([("p", [("a", 1), ("b", 2)])], "property_id string, unit_types array<struct<type:string,available:int>>")
    new = F.struct(F.lit("c").alias("type"), F.lit(3).alias("available"))
    assert [u.type for u in inventory.add_unit(df, new).first().unit_types] == ["a", "b", "c"]
    assert [u.type for u in inventory.remove_unit(df, 0).first().unit_types] == ["b"]
    assert [u.available for u in inventory.set_unit_field(df, 1, "available", F.lit(9)).first().unit_types] == [1, 9]
    assert inventory.set_unit_field(df, 5, "available", F.lit(9)).first() == df.first()
    assert df.select(labels.list_prepend("unit_types", new)).first()[0][0].type == "c"


def test_upsert_and_latest(spark):
    base = spark.createDataFrame([("p1", 10, 5, 1, "x"), ("p2", 20, 6, 2, "y")], INV)
    edits = spark.createDataFrame(
        [("p1", 1, 11, "old"), ("p1", 3, None, "new"), ("p1", 2, 99, "mid"), ("p3", 1, 7, "z")],
        "property_id string, at int, total_units int, note string")
    last = inventory.latest(edits, "property_id", ["at"])
    got = {r.property_id: r for r in inventory.upsert(base, last.drop("at"), "property_id").collect()}
    assert (got["p1"].total_units, got["p1"].note, got["p1"].booked_units) == (10, "new", 1)
    assert got["p2"].note == "y" and got["p3"].total_units == 7 and got["p3"].booked_units is None


def test_bookings_stop_at_zero_and_count_once(spark):
    base = spark.createDataFrame([("p1", 10, 1, 1, "x"), ("p2", 20, 6, 2, "y")], INV)
    edits = spark.createDataFrame(
        [("p1", 1, "booked"), ("p1", 1, "booked"), ("p1", 2, "booked"), ("p1", 3, "lost"), ("p2", 4, "new")],
        "property_id string, enquiry_id long, status string")
    counts = inventory.booking_counts(edits)
    once = {r.property_id: (r.booked_units, r.available_units) for r in inventory.apply_bookings(base, counts).collect()}
    each = {r.property_id: (r.booked_units, r.available_units) for r in inventory.apply_bookings(base, counts, False).collect()}
    assert once == {"p1": (3, 0), "p2": (2, 6)} and each["p1"] == (4, 0)


def test_funnel(spark):
    df = spark.createDataFrame([("p", 28, 14, 2), ("q", 0, None, 1)],
                               "property_id string, enquiries_this_month int, site_visits_this_month int, conversions_this_month int")
    got = [(r.property_id, r.stage, r.value, r.share) for r in inventory.funnel(df).collect()]
    assert got == [("p", "Enquiries", 28, None), ("p", "Site Visits", 14, 0.5), ("p", "Conversions", 2, 2 / 14),
                   ("q", "Enquiries", 0, None), ("q", "Site Visits", 0, None), ("q", "Conversions", 1, None)]


def test_enquiries(spark):
    book = spark.createDataFrame([("p", 1, date(2024, 1, 1), "A", "9", date(2024, 1, 3))],
                                 "prop_id string, id long, date date, name string, phone string, followup date")
    new = spark.createDataFrame([("p", 2, " B ", "8"), ("p", 3, " ", "8"), ("p", 4, "C", "")], "prop_id string, id long, name string, phone string")
    got = enquiries.log_enquiries(book, new, F.lit("2024-05-01").cast("date")).orderBy("id").collect()
    assert [(r.id, r.name, r.followup) for r in got] == [(1, "A", date(2024, 1, 3)), (2, "B", date(2024, 5, 3))]
    assert enquiries.overdue(book, F.lit("2024-01-03").cast("date")).count() == 0
    assert enquiries.overdue(book, F.lit("2024-01-04").cast("date")).count() == 1


def test_sessions_and_validity(spark):
    at = lambda d, h: datetime(2024, 1, d, h)
    rows = [(1, at(1, 0), "view"), (1, at(1, 23), "click"), (1, at(2, 22), "view"), (1, at(3, 22), "view"), (2, at(5, 1), "view")]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string")
    got = sorted((r.user_id, r.session_start, r.last_event, r.events) for r in activity.sessions(df).collect())
    assert got == [(1, at(1, 0), at(2, 22), 3), (1, at(3, 22), at(3, 22), 1), (2, at(5, 1), at(5, 1), 1)]
    live = {r.user_id: r.is_valid for r in activity.live_sessions(df, F.lit("2024-01-05 02:00:00").cast("timestamp")).collect()}
    assert live == {1: 0, 2: 1}
