"""Sharding by a k-d tree over document metadata.

A node that is to become k shards is split at the weighted quantile that gives k // 2 of k parts of its
bytes to the left, along the dimension in which its values spread widest (relative to the whole
table). All nodes of a level are split together. The quantile is searched by counting bytes in a
thousand cells of the node's range, then in a thousand cells of the cell that holds it, and so on
until one row is left; equal values are told apart by a hash of the row. What reaches the driver is
a thousand sums per open node; the tree itself has fewer nodes than two per shard.

A row finds its shard by coming down the tree, a join with the few splits of each level. Slots are
numbered in blocks of a bounded number of rows, whose offsets are running counts.

Dimensions may be numbers, dates, times, truth values or texts. Texts are ordered by their first seven bytes, and those
that agree in them by the hash.

Defined cases: a null text has 16 bytes and checksum 0; null metadata and NaN come before all texts and before zero among
numbers, dates and times; infinities come last and first; a dimension without an order (a list, a map, a struct) is an
error; rows equal in all dimensions, identifier and text stay together; an empty table gives no rows; further columns pass
through, one named like the result gives way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, BooleanType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, TimestampNTZType, TimestampType,
)

from acrely.session import cut

CELLS = 1024           # cells a range of values is cut into
ROW_BYTES = 16         # added to the bytes of every text
SLOT_ROWS = 4096       # rows of a block that is numbered in one task
TIE = "tie"
RESULT = "_shard"
_BOUND = 2 ** 61       # keys are kept within, so that differences fit a long


@dataclass
class Search:
    """A node that is to become `leaves` shards from `first` on: the cell in which its quantile lies,
    the bytes in front of it, and at the end the split: keys up to (at, tie) go to the lower half."""

    first: int
    leaves: int
    target: float
    dim: int                    # number of the dimension; the hash counts as one more
    lo: int
    hi: int
    on_tie: bool                # whether the hash is searched, which tells equal values apart
    below: float = 0.0
    value: int | None = None    # the value of the dimension, once it is known
    tie: int = 0
    done: bool = False

    @property
    def width(self) -> int:
        return max(1, -(-(self.hi - self.lo + 1) // CELLS))


def _key(docs: DataFrame, name: str) -> Column:
    """A whole number that orders the values of a column."""
    column, kind = F.col(f"`{name}`"), docs.schema[name].dataType
    if isinstance(kind, (StringType, BinaryType)):
        head = F.rpad(F.hex(F.substring(column.cast("binary"), 1, 7)), 14, "0")
        number = F.conv(head, 16, 10).cast("long")
    elif isinstance(kind, (DoubleType, FloatType, DecimalType)):
        number = _fraction_key(column.cast("double"))
    elif isinstance(kind, DateType):
        number = F.unix_date(column).cast("long")
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        number = F.unix_micros(column.cast("timestamp"))
    elif isinstance(kind, BooleanType):
        number = column.cast("long")
    elif isinstance(kind, IntegralType):
        number = column.cast("long")
    else:
        raise ValueError(f"{name} is of type {kind.simpleString()}, which has no order to split at")
    return F.greatest(F.least(F.coalesce(number, F.lit(-1)), F.lit(_BOUND)), F.lit(-_BOUND))


def _fraction_key(x: Column) -> Column:
    """A long that rises with the double: the exponent in front of 49 bits of the fraction, as floating point itself is laid
    out, mirrored below zero. NaN has none."""
    size = F.abs(x)
    exponent = F.floor(F.log2(size))
    place = ((exponent + 1076) * (1 << 49)).cast("long") + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * (1 << 49)).cast("long")
    finite = F.when(size == float("inf"), F.lit(_BOUND)).when(size == 0, F.lit(0)).otherwise(place)
    return F.when(F.isnan(x), None).otherwise(F.when(x < 0, -finite).otherwise(finite)).cast("long")


def keyed(docs: DataFrame, dims: Sequence[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows as `_row`, with size, crc32, the key of every dimension (`k0`, `k1`...) and the tie-breaking hash."""
    body = F.col(f"`{text}`").cast("binary")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != RESULT]).alias("_row"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("crc32"),
        F.col(f"`{doc_id}`").alias("id"), *[_key(docs, d).alias(f"k{i}") for i, d in enumerate(dims)],
    ).withColumn(TIE, F.shiftrightunsigned(F.xxhash64("id", "crc32"), 2))


def _few(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A broadcast table of fewer rows than shards, all of them numbers, truth values or null."""
    names = [x.split()[0] for x in schema.split(", ")]
    cells = ", ".join("(" + ", ".join("null" if v is None else str(v).lower() for v in row) + ")" for row in rows)
    local = spark.sql(f"SELECT * FROM VALUES {cells} AS t({', '.join(names)})")
    return F.broadcast(local.selectExpr(*[f"CAST({x.split()[0]} AS {x.split()[1]})" for x in schema.split(", ")]))


def _value(dims: Sequence[str]) -> Column:
    """The key of the dimension numbered `dim`; the hash comes after the dimensions."""
    return F.coalesce(*[F.when(F.col("dim") == i, F.col(k)) for i, k in enumerate((*dims, TIE))])


def _down(rows: DataFrame, splits: Sequence[tuple], dims: Sequence[str]) -> DataFrame:
    """One level further: `_node` becomes the first shard of the half a row falls in."""
    split = _few(rows.sparkSession, splits, "_node int, dim int, at long, at_tie long, high int")
    key, tie = _value(dims), F.col(TIE)
    beyond = F.when(F.col("dim") == len(dims), tie > F.col("at_tie")).otherwise(
        (key > F.col("at")) | ((key == F.col("at")) & (tie > F.col("at_tie"))))
    return rows.join(split, "_node", "left").withColumn(
        "_node", F.when(beyond, F.col("high")).otherwise(F.col("_node"))).drop("dim", "at", "at_tie", "high")


def descend(rows: DataFrame, levels: Sequence[Sequence[tuple]], dims: Sequence[str]) -> DataFrame:
    """`rows` with `_node`, the shard they come down to."""
    out = rows.withColumn("_node", F.lit(0))
    for splits in levels:
        out = _down(out, splits, dims)
    return out


def _advance(search: Search, cells: list) -> None:
    """Move to the cell that holds the target, or settle the split."""
    at = search.below
    for c in cells:
        if at + c.bytes < search.target and c is not cells[-1]:
            at += c.bytes
            continue
        search.below = at
        if c.lo < c.hi:
            search.lo, search.hi = c.lo, c.hi
        elif not search.on_tie and c.rows > 1:
            search.value, search.on_tie = c.lo, True
            search.lo, search.hi = c.tie_lo, c.tie_hi
            if c.tie_lo == c.tie_hi:
                _settle(search, at, c.bytes, c.tie_lo)
        elif search.on_tie:
            _settle(search, at, c.bytes, c.lo)
        else:
            search.value = c.lo
            _settle(search, at, c.bytes, c.tie_lo)
        return
    search.done = True


def _settle(search: Search, below: float, bytes_: float, tie: int) -> None:
    """The last cell goes to the side that leaves the bytes nearer to the target."""
    search.tie = tie if below + bytes_ / 2 <= search.target else tie - 1
    search.done = True


def grow(rows: DataFrame, dims: Sequence[str], shards: int) -> tuple[list[list[tuple]], DataFrame]:
    """The splits of every level, and the keyed rows with the shard `_node` they come down to. The rows are read several
    times per level."""
    ends = [f(d).alias(f"{n}_{i}") for i, d in enumerate((*dims, TIE)) for n, f in (("lo", F.min), ("hi", F.max))]
    whole = rows.agg(*ends).first()
    if whole is None or whole[f"lo_{len(dims)}"] is None:
        return [], rows.withColumn("_node", F.lit(0))
    spans = [max(1, whole[f"hi_{i}"] - whole[f"lo_{i}"]) for i in range(len(dims))]
    levels, open_, rows = [], {0: shards} if shards > 1 else {}, rows.withColumn("_node", F.lit(0))
    while open_:
        # A level is written, so all levels run the same generated code.
        rows = cut(_down(rows, levels[-1], dims) if levels else rows)
        searches = []
        for s in rows.groupBy("_node").agg(F.sum("size").alias("bytes"), *ends).collect():  # a row per node
            if (leaves := open_.get(s["_node"])) is None:
                continue
            width, dim = max(((s[f"hi_{i}"] - s[f"lo_{i}"]) / spans[i], -i) for i in range(len(dims)))
            dim = -dim if width > 0 else len(dims)
            searches.append(Search(
                s["_node"], leaves, s["bytes"] * (leaves // 2) / leaves, dim, s[f"lo_{dim}"], s[f"hi_{dim}"], dim == len(dims)))
        while running := [s for s in searches if not s.done]:
            _count_cells(rows, running, dims)
        levels.append([(s.first, s.dim, s.value or 0, s.tie, s.first + s.leaves // 2) for s in searches])
        halves = [(f, n) for s in searches for f, n in ((s.first, s.leaves // 2), (s.first + s.leaves // 2, s.leaves - s.leaves // 2))]
        open_ = {f: n for f, n in halves if n > 1}
    return levels, cut(_down(rows, levels[-1], dims)) if levels else rows


def _count_cells(rows: DataFrame, running: list[Search], dims: Sequence[str]) -> None:
    """One pass: the bytes in the cells of every search's range. Rows of other nodes fall out in the same join."""
    wanted = _few(
        rows.sparkSession, [(s.first, s.dim, s.on_tie, s.value, s.lo, s.hi, s.width) for s in running],
        "_node int, dim int, on_tie boolean, value long, lo long, hi long, width long")
    searched = rows.join(wanted, "_node").withColumn("_key", F.when(F.col("on_tie"), F.col(TIE)).otherwise(_value(dims)))
    inside = searched.filter(
        F.col("_key").between(F.col("lo"), F.col("hi")) & (F.col("value").isNull() | (_value(dims) == F.col("value"))))
    counted = inside.groupBy("_node", F.expr("(_key - lo) div width").alias("_cell")).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("_key").alias("lo"), F.max("_key").alias("hi"),
        F.min(TIE).alias("tie_lo"), F.max(TIE).alias("tie_hi")).collect()
    by_node: dict[int, list] = {}
    for c in sorted(counted, key=lambda c: c["_cell"]):
        by_node.setdefault(c["_node"], []).append(c)
    for s in running:
        _advance(s, by_node.get(s.first, []))


def kd_shards(
    docs: DataFrame, dims: Sequence[str] = ("lang", "source", "n_chars", "doc_id"), shards: int | None = 40,
    target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """`docs` with the struct column `_shard`: size, crc32, shard and slot (gapless from 0 in each shard).

    Give `shards`, or `target_bytes` for as many shards as hold about that many bytes each.
    """
    keys = [f"k{i}" for i in range(len(dims))]
    rows = keyed(docs, dims, doc_id, text)
    narrow = cut(rows.drop("_row", "id", "crc32"))
    if target_bytes:
        shards = max(1, ceil((narrow.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    tree, fallen = grow(narrow, keys, shards)

    counts = fallen.groupBy(F.col("_node").alias("shard")).count().collect()  # one row per shard
    blocks = F.lit(1)
    for c in counts:
        if c["count"] > SLOT_ROWS:
            blocks = F.when(F.col("shard") == c["shard"], ceil(c["count"] / SLOT_ROWS)).otherwise(blocks)

    def in_blocks(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("_node", "shard").withColumn("_block", F.pmod(F.col(TIE), blocks).cast("int"))

    sizes = in_blocks(fallen).groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    order = Window.partitionBy("shard", "_block").orderBy("id", "crc32", TIE)
    slot = F.col("_offset") + F.row_number().over(order) - 1
    placed = in_blocks(descend(rows, tree, keys)).join(offsets, ["shard", "_block"])
    return placed.select("_row.*", F.struct("size", "crc32", "shard", slot.cast("long").alias("slot")).alias("_shard"))
