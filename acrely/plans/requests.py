"""Recommendation requests derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrely.schema import CITIES, PROPERTY_TYPES


def newest_per_city_and_type(listings: DataFrame) -> DataFrame:
    """The newest listing of every city and type as a request: at most 50 rows."""
    rest = [c for c in listings.columns if c not in ("city", "property_type", "listed_at", "property_id")]
    newest = F.max(F.struct("listed_at", "property_id", *rest)).alias("n")
    picked = listings.groupBy("city", "property_type").agg(newest)
    city = F.array_position(F.array(*[F.lit(c) for c in CITIES]), F.col("city"))
    kind = F.array_position(F.array(*[F.lit(t) for t in PROPERTY_TYPES]), F.col("property_type"))
    return picked.select(
        (city * 10 + kind).cast("long").alias("request_id"), "city", "property_type",
        *[F.col(f"n.{c}").alias(c) for c in rest])


def customer_requests(customers: DataFrame) -> DataFrame:
    """What every customer looks for: one request each, with a text as its id and a price for most."""
    key = F.col("c_custkey")
    return customers.select(
        F.concat(F.lit("C"), key.cast("string")).alias("request_id"),
        F.element_at(F.array(*[F.lit(c) for c in CITIES]), (key % len(CITIES) + 1).cast("int")).alias("city"),
        F.element_at(F.array(*[F.lit(t) for t in PROPERTY_TYPES]), (key % len(PROPERTY_TYPES) + 1).cast("int")).alias("property_type"),
        (key % 5 + 1).cast("int").alias("bedrooms"), (key % 3 + 1).cast("int").alias("bathrooms"),
        (F.lit(400) + key % 40 * 50).cast("double").alias("area_sqft"), (F.lit(4) + key % 60 / F.lit(10)).cast("double").alias("location_score"),
        (key % 9).cast("int").alias("amenities_count"), (key % 20).cast("double").alias("floor_number"),
        (key % 30).cast("double").alias("age_years"),
        F.when(key % 10 != 0, F.lit(1e6) + key % 97 * F.lit(1e5)).alias("price"))
