"""Market profile: distributions, city statistics, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acrely.functions.listing import amenities_count
from acrely.functions.numeric import rnd
from acrely.operators.features import numeric_columns
from acrely.operators.quantiles import exact_quantiles
from acrely.session import cut

BINS = 60
MILLION = 1e6
LAKH = 1e5


def with_amenities_count(df: DataFrame) -> DataFrame:
    if "amenities" not in df.columns or "amenities_count" in df.columns:
        return df
    return df.withColumn("amenities_count", amenities_count())


def describe(df: DataFrame) -> DataFrame:
    """One row per column: count, distinct values, most frequent value and its count, moments and
    quartiles. Text columns have the first group, numeric ones the second.

    Equal values are counted before anything is compared, so a hot value costs one row per task.
    """
    numbers = numeric_columns(df)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    parts = []
    if texts:
        long = df.unpivot([], texts, "column", "top").filter(F.col("top").isNotNull())
        counted = long.groupBy("column", "top").agg(F.count("*").alias("freq"))
        parts.append(counted.groupBy("column").agg(
            F.sum("freq").alias("count"), F.count("*").alias("unique"), F.max("freq").alias("freq"),
            F.min(F.struct((-F.col("freq")).alias("rank"), "top")).getField("top").alias("top")))
    if numbers:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "column", "value")
        moments = long.groupBy("column").agg(
            F.count("value").alias("count"), rnd(F.avg("value"), 2).alias("mean"),
            rnd(F.stddev_samp("value"), 2).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
        quartiles = exact_quantiles(df, numbers, [0.25, 0.5, 0.75]).select(
            "column", *[rnd(f"q{i}", 4).alias(name) for i, name in enumerate(["p25", "p50", "p75"])])
        parts.append(moments.join(quartiles, "column", "left"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    wanted = {
        "count": "long", "unique": "long", "top": "string", "freq": "long", "mean": "double", "std": "double",
        "min": "double", "p25": "double", "p50": "double", "p75": "double", "max": "double",
    }
    return out.select("column", *[
        (F.col(c) if c in out.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()])


def null_counts(df: DataFrame) -> DataFrame:
    """Columns that have nulls, with how many."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "column", "nulls").filter(F.col("nulls") > 0)


def median_price_by_city(df: DataFrame) -> DataFrame:
    return exact_quantiles(df, ["price"], [0.5], by=["city"]).select(
        "city", rnd("q0", 2).alias("median_price")).orderBy(F.desc("median_price"), "city")


def boxplot_by_city(df: DataFrame) -> DataFrame:
    """Quartiles and the whiskers: the furthest prices within 1.5 interquartile ranges."""
    # Written, so that Spark knows how small it is and does not shuffle the listings by city.
    quartiles = cut(exact_quantiles(df, ["price"], [0.25, 0.5, 0.75], by=["city"]))
    reach = F.lit(1.5) * (F.col("q2") - F.col("q0"))
    inside = F.when(F.col("price").between(F.col("q0") - reach, F.col("q2") + reach), F.col("price"))
    rows = df.select("city", "price").join(quartiles.select("city", "q0", "q1", "q2"), "city")
    return rows.groupBy("city").agg(
        rnd(F.first("q0"), 2).alias("q1"), rnd(F.first("q1"), 2).alias("median"), rnd(F.first("q2"), 2).alias("q3"),
        rnd(F.min(inside), 2).alias("whisker_low"), rnd(F.max(inside), 2).alias("whisker_high"))


def mean_price_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("property_type").agg(
        rnd(F.avg("price") / F.lit(MILLION), 6).alias("mean_price_m")).orderBy(F.desc("mean_price_m"), "property_type")


def city_stats(df: DataFrame) -> DataFrame:
    """Mean, median and count per city, also in lakhs, by falling median."""
    means = df.groupBy("city").agg(F.avg("price").alias("mean"), F.count("price").alias("listings"))
    medians = exact_quantiles(df, ["price"], [0.5], by=["city"]).select("city", F.col("q0").alias("median"))
    return means.join(medians, "city").select(
        "city", rnd("mean", 2).alias("mean_price"), rnd("median", 2).alias("median_price"), "listings",
        rnd(F.col("mean") / F.lit(LAKH), 1).alias("mean_lakhs"),
        rnd(F.col("median") / F.lit(LAKH), 1).alias("median_lakhs"),
    ).orderBy(F.desc("median_price"), "city")


def bedroom_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("bedrooms").agg(F.count("*").alias("listings")).orderBy("bedrooms")


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns (strict lower triangle, long form),
    each over the rows where both are present. One pass; a task shuffles one row per pair."""
    df = with_amenities_count(df)
    names = list(columns or [c for c in numeric_columns(df) if c != "price_per_sqft"])
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    pairs = [x for a, b in combinations(names, 2) for x in (F.lit(b), F.lit(a), F.col(b), F.col(a))]
    long = numbers.select(F.stack(F.lit(len(pairs) // 4), *pairs).alias("row", "col", "y", "x"))
    return long.groupBy("row", "col").agg(rnd(F.corr("y", "x"), 6).alias("corr"))


def histogram(df: DataFrame, value: Column, bins: int = BINS) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, the last one closed; empty bins stay."""
    values = df.select(value.cast("double").alias("value"))
    low, high = values.agg(F.min("value"), F.max("value")).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, low double, high double, count long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((F.col("value") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = values.filter(F.col("value").isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("count"))
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counted, "bin", "left").select(
        "bin", rnd(F.lit(low) + F.col("bin") * F.lit(width), 6).alias("low"),
        rnd(F.lit(low) + (F.col("bin") + 1) * F.lit(width), 6).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"))


def price_histogram(df: DataFrame) -> DataFrame:
    return histogram(df, F.col("price") / F.lit(MILLION))


def log_price_histogram(df: DataFrame) -> DataFrame:
    return histogram(df, F.log1p("price"))


def location_trend(df: DataFrame) -> DataFrame:
    """Least-squares line of price in millions on the location score, and the range of the score."""
    y, x = F.col("price") / F.lit(MILLION), F.col("location_score")
    return df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"))


def trend_points(df: DataFrame, points: int = 100) -> DataFrame:
    """Evenly spaced points on that line."""
    at = F.col("x_min") + F.col("i") * (F.col("x_max") - F.col("x_min")) / F.lit(float(points - 1))
    line = location_trend(df).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return line.select("i", rnd(at, 6).alias("x"), rnd(F.col("slope") * at + F.col("intercept"), 6).alias("y"))


def area_price_series(df: DataFrame) -> DataFrame:
    return df.select(
        "property_id", "area_sqft", rnd(F.col("price") / F.lit(MILLION), 6).alias("price_m"), "bedrooms", "location_score")


def area_price_grid(df: DataFrame, area_step: float = 100.0, price_step_m: float = 1.0) -> DataFrame:
    """The scatter as a 2-D count, which stays small whatever the table's size."""
    return df.groupBy(
        (F.floor(F.col("area_sqft") / F.lit(area_step)) * F.lit(area_step)).alias("area_from"),
        (F.floor(F.col("price") / F.lit(MILLION) / F.lit(price_step_m)) * F.lit(price_step_m)).alias("price_from_m"),
        "bedrooms").agg(F.count("*").alias("listings"))


def run_all(df: DataFrame) -> dict[str, DataFrame]:
    """The whole profile of a listing table. Persist `df` first when reading it is expensive."""
    df = with_amenities_count(df)
    return {
        "summary": describe(df),
        "price_histogram": price_histogram(df),
        "log_price_histogram": log_price_histogram(df),
        "price_by_city": boxplot_by_city(df),
        "price_by_type": mean_price_by_type(df),
        "correlations": correlations(df),
        "area_price": area_price_grid(df),
        "bedrooms": bedroom_counts(df),
        "location_trend": location_trend(df),
    }
