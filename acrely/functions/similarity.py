"""Cosine similarity as native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from acrely.functions.numeric import col


def _total(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def cosine_of_columns(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Cosine of two vectors held in plain columns, which stays inside generated code."""
    dot = _total([x * y for x, y in zip(a, b, strict=True)])
    norms = F.sqrt(_total([x * x for x in a])) * F.sqrt(_total([y * y for y in b]))
    return F.when(norms > 0, dot / norms).otherwise(F.lit(0.0))


def array_norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_of_arrays(a: Column | str, b: Column | str) -> Column:
    """Cosine of two double arrays; a zero vector is similar to nothing."""
    products = F.zip_with(col(a), col(b), lambda x, y: x * y)
    dot = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    norms = array_norm(a) * array_norm(b)
    return F.when(norms > 0, dot / norms).otherwise(F.lit(0.0))
