"""Raw tables and the listing-domain tables that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrely.functions.listing import price_per_sqft
from acrely.session import spread
from acrely.schema import AMENITIES, CITIES, ENQUIRY_STATUSES, PROPERTY_TYPES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values: list[str], position: Column) -> Column:
    """The value at a zero-based position of a constant list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def listings(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """Every line item as a property listing (see FIXTURES.md, section 3).

    `lines` replaces the stored line items, for instance by a stream of them.

    `part` and `supplier` grow with the data, so no broadcast is forced: Spark picks one only
    below its own size threshold and otherwise splits skewed partitions at run time.
    """
    needed = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]
    if lines is None:
        line = spread(table(spark, folder, "lineitem").select(*needed), "l_orderkey", "l_linenumber")
    else:
        line = lines.select(*needed)
    part = table(spark, folder, "part").select("p_partkey", "p_size")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        supplier, F.col("l_suppkey") == F.col("s_suppkey"))

    cities = list(CITIES)
    localities = [name for _, _, names in CITIES.values() for name in names]
    ci = F.col("s_nationkey") % 10
    li = F.col("l_suppkey") % 5
    bedrooms = (F.lit(1) + F.col("l_linenumber") % 5).cast("int")
    amenity_list = F.slice(F.array(*[F.lit(a) for a in AMENITIES]), F.lit(1), (F.lit(2) + F.col("p_size") % 9).cast("int"))
    markup = F.when(F.col("l_partkey") % 40 == 0, F.lit(800.0)).otherwise(F.lit(100.0))
    return rows.select(
        F.concat(F.lit("L"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("property_id"),
        _pick(cities, ci).alias("city"),
        _pick(localities, ci * 5 + li).alias("locality"),
        _pick(PROPERTY_TYPES, F.col("p_size") % 5).alias("property_type"),
        bedrooms.alias("bedrooms"),
        F.least(bedrooms + F.col("l_partkey") % 2, F.lit(5)).cast("int").alias("bathrooms"),
        (F.lit(300.0) + F.col("l_quantity") * F.lit(40.0)).alias("area_sqft"),
        F.when(F.col("l_orderkey") % 33 != 0, (F.col("l_orderkey") % 30).cast("double")).alias("age_years"),
        F.when(F.col("l_partkey") % 50 != 0, (F.col("l_partkey") % 25).cast("double")).alias("floor_number"),
        (F.col("l_partkey") % 25 + 1 + F.col("l_suppkey") % 9).cast("double").alias("total_floors"),
        F.when(F.col("l_partkey") % 97 != 0, F.array_join(amenity_list, "|")).alias("amenities"),
        (F.lit(4.0) + (F.col("l_suppkey") % 60).cast("double") / F.lit(10.0)).alias("location_score"),
        ((F.col("l_extendedprice") + F.lit(10000.0)) * markup).alias("price"),
        F.col("l_shipdate").cast("date").alias("listed_at"),
    ).withColumn("price_per_sqft", price_per_sqft())


def intake(spark: SparkSession, folder: str) -> DataFrame:
    """Listings as they might arrive: some with missing, zero or out-of-range fields."""
    day = F.dayofmonth("listed_at")
    month = F.month("listed_at")
    rows = listings(spark, folder)
    return rows.select(
        "property_id",
        F.when(day != 1, F.col("city")).alias("city"),
        "locality", "property_type",
        F.when(day == 2, F.lit(0)).when(day == 3, F.lit(11)).otherwise(F.col("bedrooms")).alias("bedrooms"),
        F.when(day != 4, F.col("bathrooms")).alias("bathrooms"),
        F.when(day == 5, F.lit(0.0)).otherwise(F.col("area_sqft")).alias("area_sqft"),
        F.when(month == 2, F.lit(11.0)).otherwise(F.col("location_score")).alias("location_score"),
        F.when(day != 6, F.col("price")).alias("price"),
    )


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """One catalogue document per part, with its nested members."""
    key = F.col("p_partkey")
    cities = list(CITIES)
    localities = [name for _, _, names in CITIES.values() for name in names]
    return table(spark, folder, "part").select(
        F.concat(F.lit("P"), key.cast("string")).alias("id"),
        F.col("p_name").alias("title"),
        _pick(cities, key % 10).alias("city"),
        _pick(localities, (key % 10) * 5 + F.col("p_size") % 5).alias("locality"),
        _pick(PROPERTY_TYPES, F.col("p_size") % 5).alias("property_type"),
        (F.lit(1) + F.col("p_size") % 5).cast("int").alias("bedrooms"),
        F.col("p_brand").alias("builder"),
        F.round(F.col("p_retailprice") * 10000).cast("long").alias("price"),
        F.slice(F.array(*[F.lit(a) for a in AMENITIES]), F.lit(1), (F.lit(2) + F.col("p_size") % 9).cast("int")).alias("amenities"),
        F.struct(
            F.concat(F.lit("School "), (key % 9).cast("string"), F.lit("km")).alias("school"),
            F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("Metro "), (key % 7).cast("string"), F.lit("km"))).alias("metro"),
        ).alias("nearby"),
    )


def _unit(i: int) -> Column:
    """The i-th unit type of a property, as inventory files nest it."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return F.struct(
        F.lit(f"{i} BHK").alias("type"),
        (F.lit(300 + 400 * i) + size).cast("int").alias("area"),
        (F.round(F.col("p_retailprice") * 10000) * i).cast("long").alias("price"),
        F.concat(F.lit("1-"), (size + i).cast("string")).alias("floor_range"),
        (key % (i + 2)).cast("int").alias("available"),
        (key % (i + 2) + i).cast("int").alias("total"),
    )


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Unit counts per property; parts of type ECONOMY have no inventory record."""
    key, size = F.col("p_partkey"), F.col("p_size")
    total = F.lit(12) + size % 40
    units = F.slice(F.array(_unit(1), _unit(2), _unit(3)), F.lit(1), (key % 4).cast("int"))
    return table(spark, folder, "part").filter(F.col("p_type") != "ECONOMY").select(
        F.concat(F.lit("P"), key.cast("string")).alias("property_id"),
        total.cast("int").alias("total_units"),
        (total - key % 7 - size % 5).cast("int").alias("available_units"),
        (key % 7).cast("int").alias("booked_units"),
        (size % 5).cast("int").alias("sold_units"),
        F.lit("2024-04-01").alias("last_updated"),
        F.when(size % 6 != 0, F.struct(
            F.round(F.col("p_retailprice") * 10000).cast("long").alias("min"),
            F.round(F.col("p_retailprice") * 12000).cast("long").alias("max"),
        )).alias("price_range"),
        units.alias("unit_types"),
        F.when(key % 4 != 0, F.lit("Under Construction")).alias("construction_status"),
        F.when(size % 5 != 0, F.lit("2026-06-30")).alias("rera_validity"),
        F.when(key % 3 != 0, F.concat(F.lit("note "), key.cast("string"))).alias("manager_notes"),
        (key % 30).cast("int").alias("enquiries_this_month"),
        (key % 13).cast("int").alias("site_visits_this_month"),
        F.when(size % 4 != 0, (key % 4).cast("int")).alias("conversions_this_month"),
    )


def enquiries(spark: SparkSession, folder: str) -> DataFrame:
    """One enquiry per order, about the property that carries the customer's number."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name")
    day = F.col("o_orderdate").cast("date")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("prop_id"),
        F.col("o_orderkey").alias("id"),
        day.alias("date"),
        F.col("c_name").alias("name"),
        F.when(F.col("o_orderkey") % 5 != 0, F.lower(F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit(".")), F.lit("@mail.example")))).alias("email"),
        (F.col("o_totalprice") * F.lit(100.0)).alias("budget"),
        F.col("o_orderpriority").alias("source"),
        _pick(ENQUIRY_STATUSES + ["archived"], F.col("o_orderkey") % 7).alias("status"),
        F.when(F.col("o_orderkey") % 4 != 0, F.date_add(day, 2)).alias("followup"),
    )


def status_edits(lines: DataFrame, *keep: str) -> DataFrame:
    """Every line item as one edit of an enquiry's status; columns in `keep` stay."""
    status = (
        F.when(F.col("l_returnflag") == "R", "booked")
        .when(F.col("l_returnflag") == "A", "negotiation").otherwise("contacted")
    )
    return lines.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("property_id"),
        F.col("l_orderkey").alias("enquiry_id"),
        status.alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("edited_at"),
        *keep,
    )


def inventory_edits(lines: DataFrame) -> DataFrame:
    """Every line item as one saved edit of a property's unit counts."""
    return lines.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("property_id"),
        F.col("l_shipdate").cast("timestamp").alias("edited_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sequence"),
        (F.lit(20) + F.col("l_quantity")).cast("int").alias("total_units"),
        F.col("l_quantity").cast("int").alias("available_units"),
        F.when(F.col("l_linestatus") == "F", F.lit("Ready to Move")).alias("construction_status"),
        F.concat(F.lit("mgr"), F.col("l_suppkey").cast("string")).alias("last_updated_by"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The activity log with an event-time column Spark can put a watermark on."""
    return typed_events(table(spark, folder, "events"))


def typed_events(raw: DataFrame) -> DataFrame:
    return raw.select(
        "event_id", "user_id", "event_type", "value", "props", F.col("ts").cast("timestamp").alias("ts"))


def signups(spark: SparkSession, folder: str) -> DataFrame:
    """One signup form per customer; some forms break a rule."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("form_id"),
        F.when(key % 17 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.split("c_name", "#")[0])).alias("first_name"),
        F.split("c_name", "#")[1].alias("last_name"),
        F.concat(F.lit(" User"), key.cast("string"), F.when(key % 11 == 0, F.lit(".at.")).otherwise(F.lit("@")), F.lit("Mail.Example ")).alias("email"),
        (F.lit(3) + key % 9).cast("int").alias("password_length"),
    )


def known_users(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of users that already signed up, from the activity log."""
    return table(spark, folder, "events").filter(F.col("event_type") == "signup").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@mail.example")).alias("email"))


def listing_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing as the markup of a result card, the way a listing site shows it."""
    rows = listings(spark, folder)
    area = F.when(F.dayofmonth("listed_at") % 10 == 0, F.format_number("area_sqft", 0)).otherwise(F.col("area_sqft").cast("long").cast("string"))
    return rows.select(
        F.col("property_id").alias("card_id"),
        F.concat(
            F.lit('<div class="listing-card"><h2 class="listing-title"> '), F.col("bedrooms").cast("string"),
            F.lit(" BHK "), F.col("property_type"), F.lit(" in "), F.col("locality"),
            F.lit(' </h2><span class="price">₹'), F.format_number("price", 0),
            F.lit('</span><span class="area">'), area,
            F.lit(' sqft</span><span class="locality"> '), F.col("locality"), F.lit(" </span></div>"),
        ).alias("html"),
    )
