"""Listing features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acrely.functions.numeric import col, flag, lookup, ratio, rnd
from acrely.schema import (
    CITY_BASE, CITY_PRICE_INDEX, MAX_AMENITIES, PREMIUM_LOCALITIES, TYPE_FACTORS, UNKNOWN_CITY_INDEX,
)


def amenities_count(amenities: Column | str = "amenities") -> Column:
    """Parts of a |-joined list, empty parts included; null and empty text have none."""
    text = F.coalesce(col(amenities), F.lit(""))
    separators = F.char_length(text) - F.char_length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(separators + 1)


def amenities_score(count: Column | str = "amenities_count") -> Column:
    scaled = col(count).cast("double") / F.lit(float(MAX_AMENITIES)) * F.lit(10.0)
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(10.0))


def bed_bath_ratio(bedrooms: Column | str = "bedrooms", bathrooms: Column | str = "bathrooms") -> Column:
    return ratio(bedrooms, bathrooms, 2)


def floor_ratio(floor: Column | str = "floor_number", total: Column | str = "total_floors") -> Column:
    return ratio(floor, total, 3)


def area_per_bedroom(area: Column | str = "area_sqft", bedrooms: Column | str = "bedrooms") -> Column:
    return ratio(area, bedrooms, 2)


def city_price_index(city: Column | str = "city") -> Column:
    return lookup(city, CITY_PRICE_INDEX, UNKNOWN_CITY_INDEX)


def is_premium_locality(locality: Column | str = "locality") -> Column:
    return flag(col(locality).isin(*PREMIUM_LOCALITIES))


def age_group(age: Column | str = "age_years") -> Column:
    age = col(age)
    return (
        F.when(age.isNull(), "Unknown").when(age <= 3, "New").when(age <= 12, "Mid").otherwise("Old")
    )


def value_score(
    location: Column | str = "location_score",
    amenities: Column | str = "amenities_score",
    age: Column | str = "age_years",
    floor: Column | str = "floor_ratio",
) -> Column:
    """Weighted 0..10 score; rounds first and clips afterwards. A null floor gives a null score."""
    youth = F.lit(1.0) - F.coalesce(col(age), F.lit(15.0)) / F.lit(30.0)
    youth = F.least(F.greatest(youth, F.lit(0.0)), F.lit(1.0)) * F.lit(10.0)
    total = (
        col(location) * F.lit(0.40) + col(amenities) * F.lit(0.30)
        + youth * F.lit(0.20) + col(floor) * F.lit(10.0) * F.lit(0.10)
    )
    rounded = rnd(total, 2)
    return F.when(rounded.isNotNull(), F.least(F.greatest(rounded, F.lit(0.0)), F.lit(10.0)))


def price_per_sqft(price: Column | str = "price", area: Column | str = "area_sqft") -> Column:
    return rnd(F.try_divide(col(price), col(area)), 2)


def fair_price_per_sqft(
    city: Column | str = "city", kind: Column | str = "property_type", age: Column | str = "age_years",
    count: Column | str = "amenities_count", location: Column | str = "location_score",
) -> Column:
    """Rule-based fair rate, truncated to whole rupees; null for an unknown city or type."""
    rate = (
        lookup(city, CITY_BASE) * lookup(kind, TYPE_FACTORS)
        * F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(col(age), F.lit(0.0)) * F.lit(0.01))
        * (F.lit(1.0) + col(count).cast("double") * F.lit(0.02))
        * (F.lit(1.0) + (col(location) - F.lit(5.0)) * F.lit(0.05))
    )
    return rate.cast("long")


def listing_violations(required: tuple[str, ...] = ("city", "locality", "property_type")) -> Column:
    """Names of the intake rules a row breaks, in rule order; empty when the row is valid."""

    def breach(name: str, broken: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.lit(name))

    def outside(name: str, low: float, high: float) -> Column:
        return ~F.col(name).between(low, high)

    rules = [breach(f"{name}_missing", F.col(name).isNull()) for name in required]
    rules += [
        breach("bedrooms_missing", F.col("bedrooms").isNull()),
        breach("bedrooms_range", outside("bedrooms", 1, 10)),
        breach("bathrooms_missing", F.col("bathrooms").isNull()),
        breach("bathrooms_range", outside("bathrooms", 1, 10)),
        breach("area_missing", F.col("area_sqft").isNull()),
        breach("area_not_positive", F.col("area_sqft") <= 0),
        breach("location_range", outside("location_score", 0, 10)),
        breach("price_missing", F.col("price").isNull()),
    ]
    return F.array_compact(F.array(*rules))


def request_violations() -> Column:
    """The limits on a recommendation request: top_n, tolerance and price."""

    def breach(name: str, broken: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.lit(name))

    return F.array_compact(F.array(
        breach("top_n_range", ~F.col("top_n").between(1, 20)),
        breach("tolerance_range", ~F.col("price_tolerance_pct").between(0, 100)),
        breach("price_not_positive", F.col("price") <= 0),
    ))
