"""The activity log: counts per window, logins, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrely.functions.labels import hours_between
from acrely.functions.numeric import rnd

SESSION_HOURS = 24


def event_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per type and window."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"))
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events")


def login_state(events: DataFrame, kind: str = "view") -> DataFrame:
    """Logins and the last one, per user."""
    return events.filter(F.col("event_type") == kind).groupBy("user_id").agg(
        F.count("*").alias("login_count"), F.max("ts").alias("last_login"))


def live_sessions(events: DataFrame, as_of: Column, kind: str = "view") -> DataFrame:
    """Every user's last login before `as_of`, its age in hours, and whether it is still valid."""
    last = login_state(events.filter(F.col("ts") <= as_of), kind)
    age = hours_between(as_of, F.col("last_login"))
    return last.select(
        "user_id", "last_login", rnd(age, 6).alias("age_hours"), (age < SESSION_HOURS).cast("int").alias("is_valid"))


def session_slots(events: DataFrame, gap_hours: int = SESSION_HOURS) -> DataFrame:
    """(user_id, slot, first, last, events): what a session needs to know of a time slot as long as the gap.

    Events of one user inside one slot always share a session, so a user with very many events is as light
    as any other: one row per slot. Slots of several tables are merged by `merge_slots`.
    """
    slot = F.floor(F.unix_micros("ts") / F.lit(gap_hours * 3_600_000_000))
    return events.groupBy("user_id", slot.alias("slot")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"))


def merge_slots(slots: DataFrame) -> DataFrame:
    return slots.groupBy("user_id", "slot").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"))


def sessions_of(slots: DataFrame, gap_hours: int = SESSION_HOURS) -> DataFrame:
    """Sessions from one row per user and slot."""
    in_time = Window.partitionBy("user_id").orderBy("slot")
    quiet = F.unix_micros("first") - F.unix_micros(F.lag("last").over(in_time))
    starts = slots.withColumn("_new", F.coalesce(quiet >= F.lit(gap_hours * 3_600_000_000), F.lit(True)).cast("int"))
    numbered = starts.withColumn("_session", F.sum("_new").over(in_time))
    return numbered.groupBy("user_id", "_session").agg(
        F.min("first").alias("session_start"), F.max("last").alias("last_event"), F.sum("events").alias("events"),
    ).drop("_session")


def sessions(events: DataFrame, gap_hours: int = SESSION_HOURS) -> DataFrame:
    """Runs of activity per user that no gap of that length interrupts."""
    return sessions_of(session_slots(events, gap_hours), gap_hours)


def append_events(log: DataFrame, kind: str, data: Column, at: Column) -> DataFrame:
    """Log entries (type, data, timestamp) made from the rows of a table."""
    return log.select(F.lit(kind).alias("type"), data.alias("data"), at.alias("timestamp"))
