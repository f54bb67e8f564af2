"""Listing enrichment: every engineered feature in two projections, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acrely.functions import listing as L
from acrely.functions.numeric import rnd

FEATURES = [
    "amenities_count", "amenities_score", "bed_bath_ratio", "floor_ratio", "area_per_bedroom",
    "city_price_index", "is_premium_locality", "property_age_group", "value_score",
]


def amenities_features(df: DataFrame) -> DataFrame:
    count = L.amenities_count() if "amenities" in df.columns else F.lit(0)
    return df.withColumns({"amenities_count": count, "amenities_score": L.amenities_score(count)})


def ratio_features(df: DataFrame) -> DataFrame:
    floor = F.col("floor_number") if "floor_number" in df.columns else F.lit(0.0)
    total = F.col("total_floors") if "total_floors" in df.columns else F.lit(1.0)
    return df.withColumns({
        "bed_bath_ratio": L.bed_bath_ratio(),
        "floor_ratio": L.floor_ratio(floor, total),
        "area_per_bedroom": L.area_per_bedroom(),
    })


def location_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "city_price_index": L.city_price_index(), "is_premium_locality": L.is_premium_locality()})


def age_group(df: DataFrame) -> DataFrame:
    group = L.age_group() if "age_years" in df.columns else F.lit("Unknown")
    return df.withColumn("property_age_group", group)


def value_score(df: DataFrame) -> DataFrame:
    """Needs `amenities_score` and `floor_ratio`; other absent inputs take their defaults."""
    location = F.col("location_score") if "location_score" in df.columns else F.lit(5.0)
    age = F.col("age_years") if "age_years" in df.columns else F.lit(0.0)
    return df.withColumn("value_score", L.value_score(location=location, age=age))


def enrich(df: DataFrame, has_price: bool = True) -> DataFrame:
    """All features; with a price also the price per square foot at two decimals."""
    for step in (amenities_features, ratio_features, location_features, age_group, value_score):
        df = step(df)
    if has_price and {"price", "area_sqft"} <= set(df.columns):
        df = df.withColumn("price_per_sqft", L.price_per_sqft())
    return df


def fair_price(df: DataFrame) -> DataFrame:
    """Rule-based valuation and how far the asking price is from it."""
    df = df.withColumn("fair_ppsf", L.fair_price_per_sqft(count=L.amenities_count()))
    value = F.col("fair_ppsf").cast("double") * F.col("area_sqft")
    return df.withColumns({
        "fair_price": value.cast("long"), "price_gap": rnd(F.col("price") - value.cast("long").cast("double"), 2)})


def keep_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    return [c for c in after.columns if c not in before.columns]


def align(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Exactly the fitted columns in the fitted order; absent ones are 0."""
    missing = {c: F.lit(0.0) for c in order if c not in df.columns}
    return (df.withColumns(missing) if missing else df).select(*order)


def price_band(df: DataFrame, price: float | None, tolerance_pct: float, city: str | None = None) -> DataFrame:
    """Rows of one city inside an inclusive price band; tolerance 0 or no price means no band."""
    if city is not None:
        df = df.filter(F.col("city") == city)
    if price is not None and tolerance_pct > 0:
        t = tolerance_pct / 100
        df = df.filter(F.col("price").between(price * (1 - t), price * (1 + t)))
    return df
