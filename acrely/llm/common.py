"""Helpers that several of the training-data operators use."""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. Pure ASCII takes the short way."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def hot_groups(counted: DataFrame, keys: Sequence[str], size: str, rows: int, share: float = 0.001) -> DataFrame:
    """The groups of `counted` that hold more than `share` of all `rows`: at most 1 / share of them."""
    return counted.filter(F.col(size) > F.lit(max(1.0, rows * share))).select(*keys, size)


def append(
    df: DataFrame, text: str, start: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]], schema: str,
    into: str = "_found", keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add the struct column `into`, derived from the whole texts of each Arrow batch.

    `start` runs once per task and returns the function that maps a batch of UTF-8 texts to one array
    per field of `schema`. Columns in `keep` (all by default) pass through as they are; an input column
    named like `into` gives way.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != into]
    fields = StructType.fromDDL(schema)
    names = [f.name for f in fields]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias("_text_bytes"))
    out = StructType([*source.schema.fields[:-1], StructField(into, fields)])

    def run(batches):
        work = start()
        for batch in batches:
            found = work(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.StructArray.from_arrays(found, names=names)], names=[*kept, into])

    return source.mapInArrow(run, out)


def sampled(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """About `most` rows of a larger table, drawn by a hash of `key`; the whole of a smaller one."""
    n = rows.count()
    if n <= most:
        return rows
    chance = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rows.filter(chance < most / n)
