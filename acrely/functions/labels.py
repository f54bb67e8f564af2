"""Display labels, dates and list edits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acrely.functions.numeric import col, lookup
from acrely.schema import STATUS_BADGES


def _one_decimal(x: Column) -> Column:
    """One decimal with ties rounded up, as browsers print it."""
    return F.format_string("%.1f", F.floor(x * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0))


def _grouped(x: Column) -> Column:
    """Up to three decimals and Indian digit groups: the last three digits, then pairs."""
    thousandths = F.floor(F.abs(x) * F.lit(1000.0) + F.lit(0.5)).cast("long")
    whole = F.regexp_replace((F.floor(thousandths / F.lit(1000))).cast("long").cast("string"), r"(\d)(?=(\d\d)*\d{3}$)", "$1,")
    part = F.regexp_replace(F.lpad((thousandths % 1000).cast("string"), 3, "0"), "0+$", "")
    return F.concat(
        F.when((x < 0) & (thousandths > 0), "-").otherwise(""), whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))


def price_label(price: Column | str) -> Column:
    """12500000 -> 1.3Cr, 450000 -> 4.5L, 95000 -> 95,000, -20000000 -> -2,00,00,000."""
    p = col(price).cast("double")
    return (
        F.when(p >= 1e7, F.concat(_one_decimal(p / F.lit(1e7)), F.lit("Cr")))
        .when(p >= 1e5, F.concat(_one_decimal(p / F.lit(1e5)), F.lit("L")))
        .otherwise(_grouped(p))
    )


def date_label(day: Column | str) -> Column:
    return F.coalesce(F.date_format(col(day), "dd MMM yyyy"), F.lit("—"))


def default_followup(as_of: Column) -> Column:
    return F.date_add(as_of, 2)


def is_overdue(followup: Column | str, as_of: Column) -> Column:
    return F.coalesce(col(followup) < as_of, F.lit(False))


def status_badge(status: Column | str) -> Column:
    return lookup(status, STATUS_BADGES, "badge-gray")


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)).cast("double") / F.lit(3.6e9)


def model_slug(name: Column | str) -> Column:
    return F.replace(F.lower(col(name)), F.lit(" "), F.lit("_"))


def short_title(title: Column | str, length: int = 45) -> Column:
    return F.substring(col(title), 1, length)


# ---- ordered lists held in one row --------------------------------------
def list_append(items: Column | str, item: Column) -> Column:
    return F.array_append(col(items), item)


def list_prepend(items: Column | str, item: Column) -> Column:
    return F.array_prepend(col(items), item)


def list_remove_at(items: Column | str, position: int) -> Column:
    return F.filter(col(items), lambda _, i: i != position)


def list_set_field(items: Column | str, position: int, field: str, value: Column) -> Column:
    """Replace one field of the struct at `position`; a position past the end changes nothing."""
    return F.transform(
        col(items), lambda x, i: F.when(i == position, x.withField(field, value)).otherwise(x)
    )
