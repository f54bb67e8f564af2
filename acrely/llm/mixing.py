"""Mixing sources to target weights by entropy balancing.

Every document gets the rate closest in relative entropy to one copy, such that the rates meet the
token targets of the sources and no rate exceeds the limit: min(limit, exp(lambda * tokens)) with
one multiplier per source. The multipliers are the solution of the convex dual. Distributed Newton
iterations find it: each sums the tilted tokens and their derivative over (source, size) counts,
takes a Newton step, and halves the bracket where the step would leave it. The bracket has no ends of its own: a side
is open until a multiplier beyond the target is found. A source that misses its target is an error. Sums are exact
decimals, so reruns agree bit for bit.

Rates become copies by error diffusion: within a source the cells are walked from the largest size to
the smallest and what rounding leaves is owed to the next cell, so a source misses its target by
about its smallest documents only. Inside a cell the extra copies go to the documents with the
smallest hash of the identifier. Cells that hold a large share of all rows are cut into blocks by the hash.

Defined cases: a null or wordless text has size 0, takes nothing and keeps one copy; a null source is
a source of its own, after all others; repeated rows count as rows of their own; an empty table
gives no rows; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrely.llm.common import append, hot_groups
from acrely.session import cut

WEIGHTS = (5, 2, 1)     # by position of the source, repeating
LIMIT = 3               # most copies of a document, and most of a source
ITERATIONS = 60
CLOSE = 1e-7            # relative distance from the target at which a source is solved
FIXED_POINT = 2 ** 40   # rates are summed as whole numbers of this fraction
SPLIT_ROWS = 20_000     # rows of a hot cell that are ranked together
REACH = 60.0            # a step to an open side ends at eight times the multiplier and this


def sized(docs: DataFrame, text: str = "text", source: str = "source", keep: Sequence[str] | None = None) -> DataFrame:
    """`docs` with the struct column `_mix`: key (of the source) and size (words)."""

    def start():
        return lambda texts: [pa.array([len(t.split()) if t else 0 for t in texts], pa.int64())]

    found = append(docs, text, start, "size long", "_mix", keep)
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    return found.withColumn("_mix", F.struct(key.alias("key"), F.col("_mix.size").alias("size")))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(key, source_size) -> target: the sources share all words by weight, none above `limit` times its own.

    What a capped source leaves is shared by weight among the others. Both fill up to one common level
    of words per unit of weight, so the capped ones are the first in the order of their cap by weight.
    One row per source goes through the windows.
    """
    place = F.row_number().over(Window.orderBy(F.col("key") == "", "key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    weighed = sources.withColumn("_weight", weight).withColumn("_cap", limit * F.col("source_size").cast("double"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), "key")
    after, every = by_cap.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    before = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(every) - before) / F.sum("_weight").over(after)
    filled = weighed.withColumn("_level", level).withColumn(
        "_level", F.max(F.when(F.col("_level") < F.col("_cap") / F.col("_weight"), F.col("_level"))).over(every))
    return filled.select(
        "key", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_weight"), "_cap")).alias("target"))


def _rate(limit: int):
    tilted = F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))
    return F.when(F.col("full"), float(limit)).otherwise(F.least(F.lit(float(limit)), tilted))


def solve(cells: DataFrame, goals: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(key, size, n) counts and (key, source_size, target) -> the multiplier `lam` per source."""
    scales = cells.groupBy("key").agg(
        (F.sum((F.col("n") * F.col("size") * F.col("size")).cast("decimal(38,0)")).cast("double")
         / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1)).cast("double")).alias("scale"))
    state = cut(goals.join(scales, "key").select(
        "*", (F.col("target") >= limit * F.col("source_size") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(False).alias("solved")))
    for _ in range(ITERATIONS):
        fixed = F.round(_rate(limit) * FIXED_POINT).cast("decimal(20,0)")
        words = (F.col("n") * F.col("size")).cast("decimal(18,0)")
        slope = F.round(_rate(limit) * F.col("size") / F.col("scale") * FIXED_POINT).cast("decimal(20,0)")
        free = F.col("lam") * F.col("size") / F.col("scale") < F.log(F.lit(float(limit)))
        sums = cells.join(state, "key").groupBy("key").agg(
            (F.sum(words * fixed).cast("double") / FIXED_POINT).alias("taken"),
            (F.sum(F.when(free, words * slope).otherwise(0)).cast("double") / FIXED_POINT).alias("slope"))
        off = F.col("taken") - F.col("target")
        stepped = (
            state.join(sums, "key")
            .withColumn("lo", F.when(off < 0, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(off > 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("_next", F.col("lam") - off / F.when(F.col("slope") > 0, F.col("slope")))
            .withColumn("solved", F.col("full") | (F.abs(off) <= F.greatest(CLOSE * F.col("target"), F.col("source_size") / FIXED_POINT))))
        reach = 8 * F.abs("lam") + REACH
        low, high = F.greatest(F.col("lo"), -reach), F.least(F.col("hi"), reach)
        inside = (F.col("_next") > F.col("lo")) & (F.col("_next") < F.col("hi")) & (F.abs("_next") <= reach)
        moved = (
            F.when(F.col("solved"), F.col("lam")).when(inside, F.col("_next"))
            .when(F.col("hi") == float("inf"), high).when(F.col("lo") == float("-inf"), low).otherwise((F.col("lo") + F.col("hi")) / 2))
        state = cut(stepped.withColumn("lam", moved).select(state.columns))
        if state.filter(~F.col("solved")).isEmpty():
            return state
    missed = [r.key for r in state.filter(~F.col("solved")).select("key").limit(10).collect()]
    raise RuntimeError(f"no multiplier meets the target of the sources {missed} after {ITERATIONS} steps")


def _diffuse(limit: int):
    def walk(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["size", "block"], ascending=[False, True])
        owed, copies = 0.0, []
        for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist()):
            if size == 0:
                copies.append(n)
                continue
            want = n * rate * size + owed
            given = min(limit * n, max(0, int(want / size + 0.5)))
            owed = want - given * size
            copies.append(given)
        return cells.assign(copies=copies)[["key", "size", "block", "n", "copies", "source_size", "target"]]
    return walk


def mix(
    rows: DataFrame, doc_id: str = "doc_id", weights: Sequence[int] = WEIGHTS, limit: int = LIMIT,
) -> DataFrame:
    """`rows` made by `sized`, with `_mix`: size, source_size, target and copies (0 to `limit`)."""
    narrow = cut(rows.select(F.col(doc_id).alias("doc_id"), "_mix.key", "_mix.size"))
    cells = cut(narrow.groupBy("key", "size").agg(F.count("*").alias("n")))
    sources = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    state = solve(cells, targets(sources, weights, limit), limit)

    total = cells.agg(F.sum("n")).first()[0] or 0
    hot = hot_groups(cells, ["key", "size"], "n", max(total, 1000 * SPLIT_ROWS)).select(
        "key", "size", F.ceil(F.col("n") / SPLIT_ROWS).cast("int").alias("_blocks"))
    hot = F.broadcast(hot)  # at most a thousand cells, see hot_groups

    def in_blocks(df: DataFrame, id_: str) -> DataFrame:
        block = F.coalesce(F.pmod(F.xxhash64(F.col(id_)), F.col("_blocks")).cast("int"), F.lit(0))
        return df.join(hot, ["key", "size"], "left").withColumn("block", block).drop("_blocks")

    parts = in_blocks(narrow, "doc_id").groupBy("key", "size", "block").agg(F.count("*").alias("n"))
    plan = parts.join(state, "key").select("key", "size", "block", "n", _rate(limit).alias("rate"), "source_size", "target")
    dealt = plan.groupBy("key").applyInPandas(
        _diffuse(limit), "key string, size long, block int, n long, copies long, source_size long, target double")

    payload = [c for c in rows.columns if c != "_mix"]
    flat = rows.select(F.struct(*[F.col(f"`{c}`") for c in payload]).alias("_row"), "_mix.key", "_mix.size")
    flat = in_blocks(flat, f"_row.`{doc_id}`")
    order = Window.partitionBy("key", "size", "block").orderBy(F.xxhash64(F.col(f"_row.`{doc_id}`"), F.lit(9)), f"_row.`{doc_id}`")
    placed = flat.join(dealt, ["key", "size", "block"]).withColumn("_rank", F.row_number().over(order))
    extra = F.when(F.col("_rank") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    copies = (F.floor(F.col("copies") / F.col("n")) + extra).cast("int")
    return placed.select("_row.*", F.struct("size", "source_size", "target", copies.alias("copies")).alias("_mix"))


def repeat(mixed: DataFrame) -> DataFrame:
    """The rows as often as the mix takes them."""
    times = F.when(F.col("_mix.copies") > 0, F.sequence(F.lit(1), F.col("_mix.copies")))
    return mixed.withColumn("_copy", F.explode(times)).drop("_mix", "_copy")
