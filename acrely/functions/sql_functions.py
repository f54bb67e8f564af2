"""The listing formulas as SQL functions, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from acrely.schema import PREMIUM_LOCALITIES

_premium = ", ".join(f"'{name}'" for name in PREMIUM_LOCALITIES)
FUNCTIONS = {
    "amenities_count(a STRING)": (
        "INT", "CASE WHEN coalesce(a, '') = '' THEN 0 ELSE size(split(a, '[|]')) END"),
    "amenities_score(n INT)": ("DOUBLE", "least(greatest(n / 10D * 10D, 0D), 10D)"),
    "property_age_group(age DOUBLE)": (
        "STRING", "CASE WHEN age IS NULL THEN 'Unknown' WHEN age <= 3 THEN 'New' WHEN age <= 12 THEN 'Mid' ELSE 'Old' END"),
    "is_premium_locality(name STRING)": ("INT", f"CASE WHEN name IN ({_premium}) THEN 1 ELSE 0 END"),
    "value_score(location DOUBLE, amenities DOUBLE, age DOUBLE, floor_part DOUBLE)": (
        "DOUBLE",
        "CASE WHEN location + amenities + floor_part IS NOT NULL THEN least(greatest(rint((location * 0.4D + amenities * 0.3D"
        " + least(greatest(1D - coalesce(age, 15D) / 30D, 0D), 1D) * 10D * 0.2D + floor_part * 10D * 0.1D) * 100D) / 100D,"
        " 0D), 10D) END"),
    "price_per_sqft(price DOUBLE, area DOUBLE)": ("DOUBLE", "rint(try_divide(price, area) * 100D) / 100D"),
    "price_label(p DOUBLE)": (
        "STRING",
        "CASE WHEN p >= 10000000D THEN concat(format_string('%.1f', floor(p / 10000000D * 10D + 0.5D) / 10D), 'Cr')"
        " WHEN p >= 100000D THEN concat(format_string('%.1f', floor(p / 100000D * 10D + 0.5D) / 10D), 'L')"
        " ELSE concat(if(p < 0 AND floor(abs(p) * 1000D + 0.5D) > 0, '-', ''),"
        " regexp_replace(CAST(CAST(floor(floor(abs(p) * 1000D + 0.5D) / 1000) AS BIGINT) AS STRING), r'(\\d)(?=(\\d\\d)*\\d{3}$)', '$1,'),"
        " regexp_replace(concat('.', lpad(CAST(CAST(floor(abs(p) * 1000D + 0.5D) AS BIGINT) % 1000 AS STRING), 3, '0')), '[.]?0+$', '')) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions and return their names."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [signature.split("(")[0] for signature in FUNCTIONS]
