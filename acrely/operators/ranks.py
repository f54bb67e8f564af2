"""Ordinals and splits by rank, without ordering a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrely.operators.quantiles import value_at_rank
from acrely.session import cut

FEW_CATEGORIES = 10_000
FEW_KEYS = 65_536  # hashed ids of an open cell that are counted one by one


def ordinals(df: DataFrame, columns: Sequence[str], few: int = FEW_CATEGORIES) -> DataFrame:
    """(column, category, code): alphabetical zero-based codes; null is the category 'nan'."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in columns])
    found = cut(text.unpivot([], list(columns), "column", "category").distinct())
    if found.count() <= few:
        order = Window.partitionBy("column").orderBy("category")
        return found.withColumn("code", F.row_number().over(order) - 1)
    # Too many for one task: sort by range, number inside every range, add the ranges in front.
    placed = cut(found.orderBy("column", "category").withColumn("at", F.monotonically_increasing_id()))
    block = F.shiftrightunsigned("at", 33)
    sizes = placed.groupBy("column", block.alias("block")).agg(F.count("*").alias("size"), F.min("at").alias("first"))
    before = Window.partitionBy("column").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    return placed.withColumn("block", block).join(starts, ["column", "block"]).select(
        "column", "category", (F.col("offset") + F.col("at") - F.col("first")).cast("int").alias("code"))


def split_key(key: str, seed: int) -> Column:
    """A uniform 52-bit number from the row's id, equal in every engine."""
    digest = F.md5(F.concat(F.col(key), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def split_column(key: str = "property_id", seed: int = 42) -> str:
    """The name under which a table may hold the number of `split_key`."""
    return f"_split_{key}_{seed}"


def with_split_key(df: DataFrame, key: str = "property_id", seed: int = 42) -> DataFrame:
    """Add the hashed id as a column, for a table that is written once and split several times."""
    return df.withColumn(split_column(key, seed), split_key(key, seed))


def _held_key(df: DataFrame, key: str, seed: int) -> Column:
    held = split_column(key, seed)
    return F.col(held) if held in df.columns else split_key(key, seed)


def holdout_limit(df: DataFrame, key: str = "property_id", fraction: float = 0.2, seed: int = 42) -> int:
    """The hashed id that the ceil(fraction * n) smallest ones end with: one number per table."""
    hashed = df.select(_held_key(df, key, seed).alias("_split"))
    limit = value_at_rank(hashed, "_split", lambda n: ceil(fraction * n) - 1, (0, 16 ** 13 - 1), FEW_KEYS)
    return -1 if limit is None else limit


def holdout(
    df: DataFrame, key: str = "property_id", fraction: float = 0.2, seed: int = 42, limit: int | None = None,
) -> DataFrame:
    """Add `is_test`: the ceil(fraction * n) rows whose hashed id is smallest.

    The limit is found by rank selection, or given; rows are then marked in place. Rows with the
    same id always fall on the same side.
    """
    limit = holdout_limit(df, key, fraction, seed) if limit is None else limit
    return df.withColumn("is_test", _held_key(df, key, seed) <= F.lit(limit).cast("long"))


def holdout_by_share(df: DataFrame, key: str = "property_id", fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """The same without reading the table first: about `fraction` of the rows, by hash alone."""
    return df.withColumn("is_test", split_key(key, seed) < F.lit(int(fraction * 16 ** 13)))
