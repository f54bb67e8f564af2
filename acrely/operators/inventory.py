"""Unit counts per property: joins with defaults, saved edits, bookings, unit types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrely.functions.labels import list_append, list_remove_at, list_set_field, price_label, short_title

COUNTERS = [
    "total_units", "available_units", "booked_units", "sold_units",
    "enquiries_this_month", "site_visits_this_month", "conversions_this_month",
]
DEFAULT_STATUS = "Ready to Move"


def property_view(catalogue: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every property with its unit counts; a property without a record gets the defaults."""
    joined = catalogue.join(inventory, catalogue["id"] == inventory["property_id"], "left")
    bounds = F.concat(
        F.lit("₹"), price_label(F.col("price_range.min")), F.lit(" – ₹"), price_label(F.col("price_range.max")))
    return joined.select(
        "id", short_title("title").alias("title"), "city", "locality",
        F.coalesce("builder", F.lit("—")).alias("builder"),
        F.coalesce("nearby.metro", F.lit("—")).alias("metro"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS],
        F.coalesce("construction_status", F.lit(DEFAULT_STATUS)).alias("construction_status"),
        F.coalesce("rera_validity", F.lit("")).alias("rera_validity"),
        F.coalesce("manager_notes", F.lit("")).alias("manager_notes"),
        F.coalesce(bounds, F.lit("")).alias("price_label"),
    )


def find_property(view: DataFrame, property_id: str, key: str = "id") -> DataFrame:
    return view.filter(F.col(key) == property_id)


def unit_types(inventory: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per unit type with its position; optional members take their defaults."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    flat = inventory.select("property_id", explode("unit_types").alias("position", "unit"))
    fields = flat.schema["unit"].dataType.names
    def member(name: str, default: str) -> Column:
        return F.coalesce(F.col(f"unit.{name}"), F.lit(default)) if name in fields else F.lit(default)
    return flat.select(
        "property_id", "position", F.col("unit.type").alias("type"), F.col("unit.area").alias("area"),
        F.col("unit.price").alias("price"), F.col("unit.available").alias("available"),
        F.col("unit.total").alias("total"), member("floor_range", "").alias("floor_range"),
        member("facing", "").alias("facing"), member("parking", "Included").alias("parking"))


def add_unit(inventory: DataFrame, unit: Column) -> DataFrame:
    return inventory.withColumn("unit_types", list_append("unit_types", unit))


def remove_unit(inventory: DataFrame, position: int) -> DataFrame:
    return inventory.withColumn("unit_types", list_remove_at("unit_types", position))


def set_unit_field(inventory: DataFrame, position: int, name: str, value: Column) -> DataFrame:
    return inventory.withColumn("unit_types", list_set_field("unit_types", position, name, value))


def remove_units(units: DataFrame, removed: DataFrame) -> DataFrame:
    """Exploded unit rows without those named by `(property_id, position)`."""
    return units.join(removed, ["property_id", "position"], "left_anti")


def latest(edits: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row per key. Tasks keep one row per key before the shuffle, so a key with very
    many edits costs no more than any other."""
    rest = [c for c in edits.columns if c != key]
    newest = F.max(F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in rest]).alias("_row")))
    return edits.groupBy(key).agg(newest.alias("_n")).select(key, *[F.col(f"_n._row.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changed fields replace stored ones, fields the change leaves out stay, new keys are added."""
    fresh = changes.select(*[F.col(c).alias(f"_n_{c}") for c in changes.columns])
    joined = base.join(fresh, base[key] == fresh[f"_n_{key}"], "full_outer")
    old, new = set(base.columns), set(changes.columns)
    names = list(base.columns) + [c for c in changes.columns if c not in old]
    return joined.select(*[
        F.coalesce(f"_n_{c}", c).alias(c) if c in old and c in new
        else (F.col(f"_n_{c}") if c in new else F.col(c)).alias(c) for c in names])


def save_edits(inventory: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply the last saved edit of every property and stamp it."""
    last = latest(edits, "property_id", ["edited_at", "sequence"]).select(
        "property_id", "total_units", "available_units", "construction_status", "last_updated_by",
        F.date_format("edited_at", "yyyy-MM-dd").alias("last_updated"))
    return upsert(inventory, last, "property_id")


def audit_events(edits: DataFrame) -> DataFrame:
    """One `inventory_update` log entry per saved edit."""
    return edits.select(
        F.lit("inventory_update").alias("type"),
        F.create_map(F.lit("prop_id"), F.col("property_id"), F.lit("manager"), F.col("last_updated_by")).alias("data"),
        F.col("edited_at").alias("timestamp"))


def booking_counts(edits: DataFrame) -> DataFrame:
    """Bookings per property: every time the status is set, and once per enquiry."""
    booked = edits.filter(F.col("status") == "booked")
    per_enquiry = booked.groupBy("property_id", "enquiry_id").agg(F.count("*").alias("edits"))
    return per_enquiry.groupBy("property_id").agg(
        F.sum("edits").alias("booked_edits"), F.count("*").alias("booked_enquiries"))


def apply_bookings(inventory: DataFrame, counts: DataFrame, once_per_enquiry: bool = True) -> DataFrame:
    """Each booking moves one unit from available to booked; available stops at zero."""
    moved = F.coalesce(F.col("booked_enquiries" if once_per_enquiry else "booked_edits"), F.lit(0))
    joined = inventory.join(counts, "property_id", "left")
    return joined.withColumns({
        "booked_units": (F.coalesce("booked_units", F.lit(0)) + moved).cast("int"),
        "available_units": F.greatest(F.coalesce("available_units", F.lit(0)) - moved, F.lit(0)).cast("int"),
    }).select(*inventory.columns)


def funnel(inventory: DataFrame) -> DataFrame:
    """Enquiries, visits and conversions as rows, with the share of the step before."""
    counts = [F.coalesce(c, F.lit(0)) for c in COUNTERS[-3:]]
    share = [F.lit(None).cast("double")] + [
        F.try_divide(b.cast("double"), a.cast("double")) for a, b in zip(counts, counts[1:])]
    steps = zip(["Enquiries", "Site Visits", "Conversions"], counts, share)
    rows = [
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), count.alias("value"), part.alias("share"))
        for i, (name, count, part) in enumerate(steps)
    ]
    return inventory.select("property_id", F.inline(F.array(*rows)))
