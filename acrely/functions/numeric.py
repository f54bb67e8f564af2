"""Rounding, safe division and small lookups as native expressions."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(x: Column | str, digits: int) -> Column:
    """Round half to even after scaling, the rule array libraries use; never yields -0.0."""
    scale = F.lit(float(10 ** digits))
    return F.rint(col(x) * scale) / scale + F.lit(0.0)


def zero_to_one(x: Column | str) -> Column:
    x = col(x)
    return F.when(x == 0, F.lit(1.0)).otherwise(x.cast("double"))


def ratio(a: Column | str, b: Column | str, digits: int) -> Column:
    """a / b with a zero divisor read as one; null when either side is null."""
    return rnd(col(a).cast("double") / zero_to_one(b), digits)


def lookup(key: Column | str, table: Mapping[str, object], default: object = None) -> Column:
    """Constant-table lookup; unknown and null keys give `default`."""
    entries = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    found = F.try_element_at(entries, F.coalesce(col(key), F.lit("")))
    return found if default is None else F.coalesce(found, F.lit(default))


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def nan_to_null(x: Column | str) -> Column:
    return F.when(~F.isnan(col(x)), col(x))


def number_or_zero(text: Column | str) -> Column:
    """Form-field coercion: empty text is 0, text that is not a number is null."""
    trimmed = F.trim(col(text))
    return F.when(trimmed == "", F.lit(0.0)).otherwise(trimmed.try_cast("double"))


def at_least_zero(x: Column | str) -> Column:
    return F.greatest(F.lit(0), col(x))
