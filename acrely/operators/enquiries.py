"""The enquiry book: logging, follow-ups, offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrely.functions.labels import date_label, default_followup, is_overdue, price_label, status_badge


def log_enquiries(book: DataFrame, new: DataFrame, today: Column | None = None) -> DataFrame:
    """Add new enquiries. Name and phone are required; an absent follow-up is in two days.

    Columns one side lacks are null there.
    """
    today = F.current_date() if today is None else today
    required = [c for c in ("name", "phone") if c in new.columns]
    for c in required:
        new = new.withColumn(c, F.trim(c)).filter(F.col(c) != "")
    given = F.col("followup") if "followup" in new.columns else F.lit(None).cast("date")
    new = new.withColumn("followup", F.coalesce(given, default_followup(today)))
    return book.unionByName(new, allowMissingColumns=True)


def enquiry_table(book: DataFrame, as_of: Column) -> DataFrame:
    """The book as it is shown: labels, badge and whether the follow-up is overdue."""
    return book.select(
        "prop_id", "id", date_label("date").alias("date_label"), "name",
        F.coalesce("email", F.lit("—")).alias("email"), price_label("budget").alias("budget_label"),
        F.coalesce("source", F.lit("—")).alias("source"), "status", status_badge("status").alias("badge"),
        F.coalesce(F.col("followup").cast("string"), F.lit("—")).alias("followup"),
        is_overdue("followup", as_of).cast("int").alias("overdue"))


def overdue(book: DataFrame, as_of: Column) -> DataFrame:
    return book.filter(is_overdue("followup", as_of))


def monthly_counts(book: DataFrame) -> DataFrame:
    """Enquiries per property and month; one counter row per task and key crosses the network."""
    return book.groupBy("prop_id", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("enquiries"))


def add_offer(offers: DataFrame, new: DataFrame) -> DataFrame:
    """Offers need a title; without an end date they are ongoing."""
    ready = new.filter(F.coalesce(F.col("title"), F.lit("")) != "").select(
        "prop_id", "position", "title", F.coalesce("desc", F.lit("")).alias("desc"),
        F.coalesce("valid", F.lit("Ongoing")).alias("valid"))
    return offers.unionByName(ready)


def remove_offers(offers: DataFrame, removed: DataFrame) -> DataFrame:
    return offers.join(removed, ["prop_id", "position"], "left_anti")
