"""Exact quantiles and ranks that never gather a column in one task.

The rows per group are counted first, then equal values, which collapses hot values on the map side.
Groups that a task can order: the distinct values fall into equal cells, and only the cells that
hold a wanted rank are ordered. Larger groups: one pass with a fixed-size sketch gives a bracket around every
wanted rank, a second pass counts the values inside the brackets, and cell counts shrink a bracket further until
one task can order it. Both find the values on the two sides of a position and interpolate between
them in the same way, so an answer does not depend on the way it was found.
Whole tables (`table_quantiles`) are counted in cells of all columns at once, a row at a time as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrely.session import cut

SORTABLE_VALUES = 2_000_000  # distinct values one task is trusted with
GRID = 2_000                 # bracket candidates per sketch
SKETCH_ACCURACY = 20_000     # the sketch's rank error is total/SKETCH_ACCURACY, below one grid step
CELLS = 4_096                # cells a range of values is cut into
FEW_GROUPS = 10_000          # group rows that may be sent to every task
SPAN_CELLS = 8_192           # cells a pass over a whole table counts per column and wanted rank


def _long(df: DataFrame, columns: Sequence[str], by: Sequence[str], kind: str) -> DataFrame:
    """(by..., column, value) without nulls."""
    wide = df.select(*by, *[F.col(c).cast(kind).alias(c) for c in columns])
    return wide.unpivot(list(by), list(columns), "column", "value").filter(F.col("value").isNotNull())


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null group matches a null group; `right` loses its keys."""
    right = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def _pick_ranks(
    counted: DataFrame, keys: list[str], below: Column, targets: Sequence[tuple[str, Column]],
) -> DataFrame:
    """Values at zero-based ranks, from (keys, value, n) rows; `below` values lie in front of them."""
    ordered = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_upto", below + F.sum("n").over(ordered)).withColumn("_from", F.col("_upto") - F.col("n"))
    hits = [
        F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_upto")), F.col("value"))).alias(name)
        for name, rank in targets
    ]
    return placed.groupBy(*keys).agg(*hits)


def _between(low: str, high: str, position: Column) -> Column:
    fraction = position - F.floor(position)
    return F.col(low) + (F.col(high) - F.col(low)) * fraction


def _cell(value: str, low: str, high: str) -> Column:
    """Which of the equal cells of [low, high] a value is in; one value alone is in the first."""
    low, high = F.col(low).cast("double"), F.col(high).cast("double")
    share = F.coalesce(F.try_divide(F.col(value).cast("double") - low, high - low), F.lit(0.0))
    return F.least(F.floor(share * CELLS), F.lit(CELLS - 1))


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _counted_cells(values: DataFrame, sizes: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """(keys, cell, value, n), one row per distinct value."""
    placed = _join(values, _small(sizes.select(*keys, "lo", "hi"), few), keys)
    return placed.groupBy(*keys, _cell("value", "lo", "hi").alias("cell"), "value").agg(F.count("*").alias("n"))


def _pick_from_cells(
    counted: DataFrame, sizes: DataFrame, keys: list[str], positions: Sequence[Column], few: bool,
) -> DataFrame:
    """(keys, total, _lo0, _hi0, _lo1, ...): the values on both sides of every position."""
    targets = {f"_{side}{i}": f(at) for i, at in enumerate(positions) for side, f in (("lo", F.floor), ("hi", F.ceil))}
    cells = counted.groupBy(*keys, "cell").agg(F.sum("n").alias("in_cell"))
    in_order = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("before", F.sum("in_cell").over(in_order) - F.col("in_cell"))
    cells = _join(cells, _small(sizes.select(*keys, "total"), few), keys)
    wanted = F.lit(False)
    for rank in targets.values():
        wanted = wanted | ((F.col("before") <= rank) & (rank < F.col("before") + F.col("in_cell")))
    chosen = cells.filter(wanted).drop("in_cell")
    open_cells = _join(counted, _small(chosen, few), [*keys, "cell"])
    in_order = Window.partitionBy(*keys, "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = open_cells.withColumn("_upto", F.col("before") + F.sum("n").over(in_order)).withColumn(
        "_from", F.col("_upto") - F.col("n"))
    return placed.groupBy(*keys).agg(F.max("total").alias("total"), *[
        F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_upto")), F.col("value"))).alias(name)
        for name, rank in targets.items()])


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = (),
    bound: int = SORTABLE_VALUES,
) -> DataFrame:
    """Linear-interpolated quantiles: one row per group and column, columns `q0`, `q1`, ... in the
    order of `probabilities`, and `total`, the number of values. Nulls are ignored."""
    keys = [*by, "column"]
    values = _long(df, columns, by, "double")
    positions = [(F.col("total") - 1) * F.lit(float(p)) for p in probabilities]
    sizes = cut(values.groupBy(*keys).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("total")))
    groups, largest = sizes.agg(F.count("*"), F.max("total")).first()
    if (largest or 0) <= bound:
        few = groups <= FEW_GROUPS
        picked = _pick_from_cells(_counted_cells(values, sizes, keys, few), sizes, keys, positions, few)
        return picked.select(*keys, "total", *[
            _between(f"_lo{i}", f"_hi{i}", at).alias(f"q{i}") for i, at in enumerate(positions)])

    ranks = sizes.select(*keys, F.explode(F.array_distinct(F.array(*[
        side(at) for at in positions for side in (F.floor, F.ceil)]))).alias("rank"))
    few = groups * 2 * len(probabilities) <= FEW_GROUPS
    found = values_at_ranks(values, keys, ranks, bound, few)
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    answers = _join(sizes, by_rank, keys)
    for i, at in enumerate(positions):
        answers = answers.withColumn(f"_lo{i}", F.col("at")[F.floor(at)]).withColumn(f"_hi{i}", F.col("at")[F.ceil(at)])
    return answers.select(*keys, "total", *[
        _between(f"_lo{i}", f"_hi{i}", at).alias(f"q{i}") for i, at in enumerate(positions)])


def values_at_ranks(values: DataFrame, keys: list[str], ranks: DataFrame, bound: int, few: bool) -> DataFrame:
    """(keys, rank, value) for every (keys, rank) of `ranks`, over the rows (keys, value).

    `few` says that `ranks` may be sent to every task; then no value is shuffled before it is counted.
    """
    slot = [*keys, "rank"]
    sketch = values.groupBy(*keys).agg(
        F.count("*").alias("size"),
        F.percentile_approx("value", [i / GRID for i in range(GRID + 1)], SKETCH_ACCURACY).alias("grid"))
    cell = F.floor(F.col("rank") / F.greatest(F.col("size") - 1, F.lit(1)) * GRID).cast("int")
    brackets = cut(_join(ranks, sketch, keys).select(
        *slot,
        F.when(cell > 1, F.element_at("grid", F.greatest(cell, F.lit(1)))).alias("lo"),
        F.when(cell < GRID - 2, F.element_at("grid", F.least(cell + 3, F.lit(GRID)))).alias("hi")))
    reached = _join(values, _small(brackets, few), keys).filter(F.col("hi").isNull() | (F.col("value") <= F.col("hi")))
    inside = F.when(F.col("lo").isNull() | (F.col("value") >= F.col("lo")), F.col("value")).alias("value")
    counted = cut(reached.groupBy(*slot, inside).agg(F.count("*").alias("n")))
    front = counted.filter(F.col("value").isNull()).select(*slot, F.col("n").alias("below"))
    state = _join(brackets.select(*slot), front, slot, "left").select(*slot, F.coalesce("below", F.lit(0)).alias("below"))
    open_values = counted.filter(F.col("value").isNotNull())

    while (open_values.groupBy(*slot).count().agg(F.max("count")).first()[0] or 0) > bound:
        span = open_values.groupBy(*slot).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        celled = _join(open_values, _small(span, few), slot).select(*slot, "value", "n", _cell("value", "lo", "hi").alias("cell"))
        cells = celled.groupBy(*slot, "cell").agg(F.sum("n").alias("n"))
        ordered = Window.partitionBy(*slot).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.col("below") + F.col("before") + F.col("n")
        chosen = cut(
            _join(cells.withColumn("before", F.sum("n").over(ordered) - F.col("n")), state, slot)
            .filter((F.col("below") + F.col("before") <= F.col("rank")) & (F.col("rank") < upto))
            .select(*slot, "cell", (F.col("below") + F.col("before")).alias("below")))
        open_values = cut(_join(celled, _small(chosen.drop("below"), few), [*slot, "cell"]).select(*slot, "value", "n"))
        state = chosen.drop("cell")

    counted = _join(open_values, state, slot)
    return _pick_ranks(counted, slot, F.col("below"), [("value", F.col("rank"))])


def value_at_rank(
    df: DataFrame, column: str, rank: Callable[[int], int], within: tuple[int, int] | None = None, few: int = CELLS,
) -> int | None:
    """The integer at a zero-based rank of the sorted column; null when there is no such rank.

    `rank` gets the number of rows, which the first pass counts; `within` spares looking for the
    smallest and largest value. Every pass counts the rows in equal cells of the open range, at most
    `CELLS` numbers, and goes on with the cell that holds the rank, until that cell has few rows.
    """
    low, high = within or df.agg(F.min(column), F.max(column)).first()
    size, left = None, 0
    while low is not None and (size is None or low < high):
        step = 1 if size is not None and size <= few else (high - low) // CELLS + 1
        # Rows outside share one group instead of being filtered, so the column is derived once.
        place = F.expr(f"CASE WHEN `{column}` BETWEEN {low}L AND {high}L THEN (`{column}` - {low}L) div {step}L END")
        counts = df.select(place.alias("cell")).groupBy("cell").count().collect()
        cells = [(cell, n) for cell, n in counts if cell is not None]
        if size is None:
            size = sum(n for _, n in cells)
            left = rank(size)
            if not 0 <= left < size:
                return None
        for cell, size in sorted(cells):
            if left < size:
                break
            left -= size
        low, high = low + cell * step, min(high, low + (cell + 1) * step - 1)
    return low


def _ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles: nothing is below the smallest infinity or above NaN, zeros are equal."""
    values = values + 0.0
    values[np.isnan(values)] = np.nan
    bits = values.view(np.int64)
    return (((bits >> 63) | np.int64(-2 ** 63)) ^ bits).view(np.uint64)


def _double(ordered: int) -> float:
    bits = np.array([ordered], np.uint64)
    return float(np.where(bits >> np.uint64(63), bits & np.uint64(2 ** 63 - 1), ~bits).view(np.float64)[0])


def _count_in_cells(spans: Sequence[tuple[int, int, int, int]], cells: int) -> Callable:
    """A task's share of `_cells_of`: dense counters of every span, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(spans), cells), np.int64)
        low, high = np.full((len(spans), cells), 2 ** 64 - 1, np.uint64), np.zeros((len(spans), cells), np.uint64)
        for batch in batches:
            found = {}
            for i, (at, first, last, shift) in enumerate(spans):
                if at not in found:
                    column = batch.column(at)
                    column = column.drop_null() if column.null_count else column
                    found[at] = np.unique(_ordered(column.to_numpy(zero_copy_only=False)), return_counts=True)
                keys, copies = found[at]
                inside = slice(np.searchsorted(keys, np.uint64(first)), np.searchsorted(keys, np.uint64(last), "right"))
                keys, copies = keys[inside], copies[inside]
                if len(keys):
                    cell = ((keys - np.uint64(first)) >> np.uint64(shift)).astype(np.int64)
                    starts = np.flatnonzero(np.diff(cell, prepend=-1))
                    ends, cell = np.append(starts[1:], len(keys)) - 1, cell[starts]
                    n[i, cell] += np.add.reduceat(copies, starts)
                    low[i, cell] = np.minimum(low[i, cell], keys[starts])
                    high[i, cell] = np.maximum(high[i, cell], keys[ends])
        span, cell = np.nonzero(n)
        signed = [(x[span, cell] ^ np.uint64(1 << 63)).view(np.int64) for x in (low, high)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (span.astype(np.int32), cell.astype(np.int32), n[span, cell], *signed)],
            names=["span", "cell", "n", "low", "high"])

    return run


def _cells_of(wide: DataFrame, spans: Sequence[tuple[int, int, int]], cells: int) -> list[list[tuple[int, int, int]]]:
    """(rows, smallest, largest) of the filled cells of every (column, first, last), in order: at most `cells` each."""
    bits = cells.bit_length() - 1
    read = sorted({at for at, _, _ in spans})
    shifted = [(read.index(at), first, last, max((last - first).bit_length() - bits, 0)) for at, first, last in spans]
    parts = wide.select(*[wide.columns[at] for at in read]).mapInArrow(
        _count_in_cells(shifted, cells), "span int, cell int, n long, low long, high long")
    rows = parts.groupBy("span", "cell").agg(F.sum("n"), F.min("low"), F.max("high")).collect()
    out = [[] for _ in spans]
    for span, _, n, low, high in sorted(rows):
        out[span].append((n, low + 2 ** 63, high + 2 ** 63))
    return out


def table_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], bound: int = SPAN_CELLS,
) -> dict[str, tuple]:
    """Whole-table quantiles as fitted parameters: column -> one value per probability; columns without values are left out.

    The rows stay as wide as they are. A pass counts the values of every open span of every column in at most `bound` equal
    cells of the doubles' order; the cell that holds a wanted rank, between its smallest and largest value, is the span of the
    next pass, until it is one value. Doubles have 64 bits, so the passes are few, whatever the values.
    """
    cells = 1 << (max(2, min(bound, SPAN_CELLS)).bit_length() - 1)
    wide = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    sizes = wide.agg(*[f(c) for c in wide.columns for f in (F.count, F.min, F.max)]).first() if columns else []
    totals, known, asked = {}, {}, {}
    for i in range(len(columns)):
        total, *ends = sizes[3 * i:3 * i + 3]
        if total:
            totals[i] = total
            first, last = (int(x) for x in _ordered(np.array(ends, np.float64)))
            places = [(total - 1) * float(p) for p in probabilities]
            asked[i, first, last] = {(r, r) for at in places for r in (floor(at), ceil(at))}  # the rank, and that in the span
    while asked:
        narrower: dict[tuple[int, int, int], set] = {}
        for (i, first, last), ranks in list(asked.items()):
            if first == last:
                known |= {(i, rank): _double(first) for rank, _ in ranks}
                del asked[i, first, last]
        for (i, _, _), ranks, filled in zip(asked, asked.values(), _cells_of(wide, list(asked), cells) if asked else []):
            before = 0
            for n, low, high in filled:
                for rank, left in ranks:
                    if before <= left < before + n:
                        narrower.setdefault((i, low, high), set()).add((rank, left - before))
                before += n
        asked = narrower

    def value(i: int, p: float) -> float:
        at = (totals[i] - 1) * float(p)
        low, high = known[i, floor(at)], known[i, ceil(at)]
        return low + (high - low) * (at - floor(at))

    return {columns[i]: tuple(value(i, p) for p in probabilities) for i in totals}
