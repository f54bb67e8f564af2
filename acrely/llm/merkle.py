"""Merkle manifest of a table, proven row by row with octopus multiproofs.

Every row is a leaf, the SHA-256 of its columns. Within a group (a language) the leaves ascend by
identifier; every `FAN` consecutive nodes become their hash until one is left, the group's subroot. The
subroots, in order of the groups, make the root in the same way. A manifest can tell for any later copy of
the table which rows are still the same.

The leaves are ranged into leaf partitions of about `LEAF_ROWS` neighbours. Each partition hashes the
complete subtrees it holds and hands on only those no other node of its own covers, about fourteen a
level; they and their ancestors, the nodes that span partitions, are the shared table of nodes, a few hundred rows a
partition. To prove its rows a partition lists the minimal union of coordinates that it can neither
hold nor derive: at each level the members of its first and its last run that lie outside it. That list is
arithmetic on its first and last position; one join fetches it, interiors above the partition's own leaves
are derived once for all rows below them, and each row's proof is read off locally.

Only identifiers and digests move. Texts are read where they lie and never shuffled; no task holds more
than a leaf partition, no group is gathered.

Defined cases: a null column hashes as `-`, an empty text as `0:`, so they differ; the null group comes first;
null identifiers come first in their group; repeated identifiers are leaves of their own, ordered by
their digest; repeated rows are equal leaves side by side; a group of one row is its own subroot and a table
of one group its own root, whose proof is empty; an empty table has no rows and no root; further columns are ignored
unless named in `fields`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrely.session import cut

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEAF_ROWS = 100_000   # rows of a leaf partition, about
TOP = -1              # the tree of the subroots; the groups' trees are numbered from 0


def _sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def leaf_hash(fields: Sequence[Column]) -> Column:
    """H of the columns one after the other: `-` for null, else byte count, colon, value."""
    parts = []
    for c in fields:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def depth(n: int) -> int:
    """Levels above the leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def widths(n: int) -> list[int]:
    """Nodes on each level, leaves first."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def missing(low: int, high: int, n: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the nodes that leaves low..high of n need from elsewhere: the minimal union over all of them."""
    for level, width in enumerate(widths(n)[:-1]):
        first, last = low // FAN * FAN, min((high // FAN + 1) * FAN, width)
        yield from ((level, i) for i in range(first, low))
        yield from ((level, i) for i in range(high + 1, last))
        low, high = low // FAN, high // FAN


def complete(hashes: list[bytes], low: int, n: int) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, hash) of the largest complete subtrees over neighbouring leaves from position `low` on."""
    for level, width in enumerate(widths(n)):
        if not hashes:
            return
        if width == 1:
            yield level, 0, hashes[0]
            return
        high = low + len(hashes)
        first = -(-low // FAN)                                     # first parent whose run begins here
        past = -(-high // FAN) if high == width else high // FAN   # the last run may be short
        if first >= past:
            yield from ((level, low + i, h) for i, h in enumerate(hashes))
            return
        inner_low, inner_high = first * FAN, min(past * FAN, width)
        yield from ((level, i, hashes[i - low]) for i in range(low, inner_low))
        yield from ((level, i, hashes[i - low]) for i in range(inner_high, high))
        hashes = [_sha("".join(h.hex() for h in hashes[i - low:min(i + FAN, inner_high) - low]).encode())
                  for i in range(inner_low, inner_high, FAN)]
        low = first


@dataclass
class Manifest:
    """`leaves`: (pid, pos, key, grp, leaf, later), ranged; `segments`: (pid, grp, tree, low, size, n, trees), one row for each
    group that a leaf partition holds rows of; `nodes`: (tree, level, idx, h), what partitions share, subroots and root included."""

    leaves: DataFrame
    segments: DataFrame
    nodes: DataFrame


def _ranged(rows: DataFrame) -> DataFrame:
    """Leaves in order: pid, the partition they were ranged to, and pos, their place in it."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, ceil(rows.count() / LEAF_ROWS))
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    # `tie` only spreads equal rows over partitions; their leaves are equal, so the tree is the same.
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return cut(placed.drop("tie").select(
        F.shiftright(at, 33).cast("int").alias("pid"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"), "*"))


def _segments(ranged: DataFrame) -> DataFrame:
    counted = cut(ranged.groupBy("pid", "grp").agg(F.min("pos").alias("from_pos"), F.count("*").alias("size")))
    in_group = Window.partitionBy("grp").orderBy("pid")
    # A group holds at most one row a partition here, and partitions are few; groups are numbered by the partition they begin in.
    placed = counted.select(
        "*", (F.sum("size").over(in_group) - F.col("size")).alias("low"), F.sum("size").over(Window.partitionBy("grp")).alias("n"),
        (F.row_number().over(in_group) == 1).cast("int").alias("begins"))
    within = placed.withColumn("rank", F.sum("begins").over(Window.partitionBy("pid").orderBy(F.col("grp").asc_nulls_first())))
    starts = placed.groupBy("pid").agg(F.sum("begins").alias("new"))
    before = starts.select(
        "pid", (F.sum("new").over(Window.orderBy("pid")) - F.col("new")).alias("earlier"),
        F.sum("new").over(Window.partitionBy()).alias("trees"))
    return cut(within.join(before, "pid").select(
        "pid", "grp", (F.col("earlier") + F.col("rank") - 1).alias("tree"), "from_pos", "low", "size", "n", "trees"))


def _local_subtrees(ranged: DataFrame, segments: DataFrame) -> DataFrame:
    """(tree, level, idx, n, h): the largest complete subtrees of every leaf partition."""
    def hashed(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        leaves = rows.sort_values("pos")["leaf"].tolist()
        made = [(s.tree, level, idx, s.n, h) for s in parts.itertuples()
                for level, idx, h in complete(leaves[s.from_pos:s.from_pos + s.size], s.low, s.n)]
        return pd.DataFrame(made, columns=["tree", "level", "idx", "n", "h"])

    return ranged.select("pid", "pos", "leaf").groupBy("pid").cogroup(segments.drop("grp").groupBy("pid")).applyInPandas(
        hashed, "tree long, level int, idx long, n long, h binary")


def _climb(known: DataFrame) -> DataFrame:
    """All nodes from `known` (tree, level, idx, n, h) upward, whose subtrees cover their trees."""
    spark = known.sparkSession
    levels = depth(known.agg(F.max("n")).first()[0] or 0)
    found, derived = known, None
    roots = F.array(*[F.lit(FAN ** i) for i in range(levels + 1)])
    height = F.size(F.filter(roots, lambda w: w < F.col("n")))
    for level in range(levels):
        here = known.filter(F.col("level") == level)
        here = here if derived is None else here.unionByName(derived)
        run = F.array_sort(F.collect_list(F.struct("idx", F.lower(F.hex("h")).alias("hex"))))
        derived = cut(here.filter(height > level).groupBy("tree", "n", F.floor(F.col("idx") / FAN).alias("up")).agg(run.alias("run")).select(
            "tree", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), "n",
            F.unhex(F.sha2(F.array_join(F.transform("run", lambda x: x["hex"]), "").cast("binary"), 256)).alias("h")))
        found = found.unionByName(derived)
    return found


def build(
    docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, later: Column | None = None,
) -> Manifest:
    """The manifest of `docs`. `later`: a digest per row to be checked against the manifest (null: the row's own)."""
    digest = leaf_hash([F.col(f"`{c}`") for c in fields])
    rows = cut(docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").cast("string").alias("grp"), digest.alias("leaf"),
        (F.lit(None).cast("binary") if later is None else later).alias("later")))
    ranged = _ranged(rows)
    segments = _segments(ranged)
    subtrees = _climb(cut(_local_subtrees(ranged, segments)))
    nodes = cut(subtrees)
    height = F.size(F.filter(F.array(*[F.lit(FAN ** i) for i in range(21)]), lambda w: w < F.col("n")))
    trees = segments.agg(F.max("trees")).first()[0] or 0
    subroots = nodes.filter(F.col("level") == height).select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(trees).alias("n"), "h")
    return Manifest(ranged, segments, cut(nodes.unionByName(_climb(cut(subroots)))))


def _requests(segments: DataFrame) -> DataFrame:
    """(pid, tree, level, idx): what each leaf partition has to fetch, each coordinate once."""
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wanted = [(s.pid, s.tree, *at) for s in batch.itertuples() for at in missing(s.low, s.high, s.n)]
            yield pd.DataFrame(wanted, columns=["pid", "tree", "level", "idx"])

    own = segments.select("pid", "tree", "low", (F.col("low") + F.col("size") - 1).alias("high"), "n")
    top = segments.groupBy("pid").agg(F.min("tree").alias("low"), F.max("tree").alias("high"), F.max("trees").alias("n"))
    return own.unionByName(top.select("pid", F.lit(TOP).cast("long").alias("tree"), "low", "high", "n")).mapInPandas(
        listed, "pid int, tree long, level int, idx long")


class _Tree:
    """The nodes a partition knows of one tree: its own from `low` to `high`, what is above them, and what it fetched."""

    def __init__(self, leaves: dict[int, str], n: int, fetched: dict[tuple[int, int], str]):
        self.widths = widths(n)
        self.levels = [leaves]
        low, high = min(leaves), max(leaves)
        for level, width in enumerate(self.widths[:-1]):
            here = self.levels[level]
            for i in [*range(low // FAN * FAN, low), *range(high + 1, min((high // FAN + 1) * FAN, width))]:
                here[i] = fetched[level, i]
            low, high = low // FAN, high // FAN
            self.levels.append({up: hashlib.sha256("".join(
                here[i] for i in range(up * FAN, min(up * FAN + FAN, width))).encode()).hexdigest() for up in range(low, high + 1)})

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def proof(self, idx: int) -> list[tuple[str, str]]:
        """Per level the siblings before and after the node above leaf `idx`."""
        steps = []
        for level, width in enumerate(self.widths[:-1]):
            here, first = self.levels[level], idx // FAN * FAN
            run = [here[i] for i in range(first, min(first + FAN, width))]
            steps.append(("".join(run[:idx - first]), "".join(run[idx - first + 1:])))
            idx //= FAN
        return steps


def fold(leaf: str, steps: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its proof lead to."""
    for before, after in steps:
        leaf = hashlib.sha256((before + leaf + after).encode()).hexdigest()
    return leaf


def prove(manifest: Manifest, steps_too: bool = False) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) per row; digests in lowercase hex.

    With `steps_too` also `proof`: from the leaf to the root, the siblings before and after, each a
    concatenation of digests. The proof is the manifest's; it is folded from the row's later digest where it has one.
    """
    nodes = manifest.nodes
    fetched = _requests(manifest.segments).join(nodes, ["tree", "level", "idx"]).select("pid", "tree", "level", "idx", "h")
    # Segments and fetched nodes reach a partition as one small table.
    known = manifest.segments.select("pid", "tree", "from_pos", "low", "size", "n", "trees").withColumns(
        {"level": F.lit(None).cast("int"), "idx": F.lit(None).cast("long"), "h": F.lit(None).cast("binary")}).unionByName(
        fetched.withColumns({c: F.lit(None).cast("long") for c in ("from_pos", "low", "size", "n", "trees")}))
    key_type = manifest.leaves.schema["key"].dataType
    columns = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["proof"] * steps_too]
    schema = ", ".join(f"{c} {'boolean' if c == 'verified' else 'array<array<string>>' if c == 'proof' else 'string'}" for c in columns)

    def proven(rows: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        at: dict[int, dict] = {}
        for f in facts[facts["h"].notna()].itertuples():
            at.setdefault(f.tree, {})[int(f.level), int(f.idx)] = f.h.hex()
        keys, leaves, later = rows["key"].tolist(), [x.hex() for x in rows["leaf"]], rows["later"].tolist()
        segments = [tuple(map(int, s)) for s in facts.loc[facts["h"].isna(), ["tree", "from_pos", "low", "size", "n", "trees"]].sort_values(
            "tree").to_numpy().tolist()]
        trees = {tree: _Tree(dict(zip(range(low, low + size), leaves[start:start + size])), n, at.get(tree, {}))
                 for tree, start, low, size, n, _ in segments}
        top = _Tree({tree: t.root for tree, t in trees.items()}, segments[0][5], at.get(TOP, {}))
        out = []
        for tree, start, low, size, _, _ in segments:
            above = top.proof(tree)
            for i in range(size):
                steps = trees[tree].proof(low + i) + above
                mine = later[start + i]
                folded = fold(leaves[start + i] if mine is None else mine.hex(), steps)
                out.append((keys[start + i], leaves[start + i], trees[tree].root, top.root,
                            hashlib.sha256("".join(a + b for a, b in steps).encode()).hexdigest(), folded, folded == top.root,
                            *[[list(s) for s in steps]] * steps_too))
        return pd.DataFrame(out, columns=columns)

    # Identifiers travel as text: pandas would turn whole numbers beside a null into floating point.
    rows = manifest.leaves.select("pid", "pos", F.col("key").cast("string").alias("key"), "leaf", "later")
    return rows.groupBy("pid").cogroup(known.groupBy("pid")).applyInPandas(proven, schema).withColumn("key", F.col("key").cast(key_type))
