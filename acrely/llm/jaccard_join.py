"""N-gram Jaccard join: documents whose sets of word 5-grams overlap by four fifths or more.

Prefix filtering (PPJoin+, Xiao et al.): the shingles of every set are put in one global order, rare ones
first. Two sets of the wanted similarity share a shingle among the first fifth of each. Only those
prefix shingles are shuffled. Pairs that meet on one are filtered by length, by the prefix of the
smaller set, by position and by suffix (with sets cut at common pivots, the overlap is at most the sum of
the smaller parts), and what is left is verified once per pair on the whole texts.

The order is by a count sketch over the shingles of all documents, a table of fixed size, then by
the shingle's hash. The answer is the same for any order; a good one keeps frequent shingles out
of the prefixes.

Sets that are equal form one class from the start, so copies cost nothing. Links are searched in
rounds, and what is linked becomes one component whose members are not compared any more. First every class
proposes one class it meets. Then every pair that meets in a small crowd is verified. In a large crowd,
where one shingle is common to many classes, a task proposes a forest over the components of a block of the crowd, dealt
anew each round; after a few such rounds blocks are compared with blocks, except inside the crowd's most frequent component, and
every pair that is left is named. No task holds more than about two blocks. So a group of near copies is linked by about as many
pairs as it has members, no crowd is multiplied out into a table, and no link between components is missed.

Shingles are 64-bit hashes of their words, classes are known by their size and a 64-bit hash of their set.

Defined cases: a null, empty or blank text has no shingles and stays alone; a text of fewer words
than a shingle is one shingle; repeated rows are members of their class; rows without an identifier take part
but name no component; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from acrely.llm.common import append
from acrely.llm.graph import merge
from acrely.session import cut

SHINGLE = 5
SKETCH_BITS = 20        # each of the two rows of the sketch has 2 ** SKETCH_BITS counters
MERGE = 32              # sketches that one task adds up
PIVOTS = 256            # parts a set is cut into for the suffix filter, a power of two
BITMAP_BITS = 23        # log2 of the bits that mark the identifiers whose texts are wanted
OUT_ROWS = 200_000      # prefix shingles per Arrow batch
CROWD = 16              # classes on a shingle up to which all their pairs are rows of a table
BLOCK = 16_384          # rows of a large crowd that one task compares with each other, or with as many others
BAND = 1.26             # sets of the wanted similarity are in the same or neighbouring bands of size, a factor over 5/4 each
ROUNDS = 2              # of forests in large crowds, before all remaining pairs are verified
LENGTHS = 1.1           # sets whose sizes differ by less may have a common first class

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_OTHER = np.uint64(0xE7037ED1A0B428DB)
_PIVOT_SHIFT = np.uint64(64 - (PIVOTS - 1).bit_length())
_FULL = 255             # largest size of a part that is told apart


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct word 5-grams; words are separated by ASCII white space, A-Z is lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join([b"", *words]))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = len(words) - SHINGLE + 1
    total = np.zeros(last, np.uint64)
    for i in range(SHINGLE):
        total += hashes[i:i + last] * _FACTORS[i]
    return np.unique(total)


def set_hash(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def part_sizes(found: np.ndarray) -> bytes:
    """Sizes of the set between the pivots, a byte each; all full if any is larger, which bounds nothing."""
    sizes = np.bincount((found >> _PIVOT_SHIFT).astype(np.int64), minlength=PIVOTS)
    return (sizes if sizes.max(initial=0) <= _FULL else np.full(PIVOTS, _FULL)).astype(np.uint8).tobytes()


def _overlap_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Most that sets with these parts have in common: the sum of the smaller parts (unknown: a huge number)."""
    most = np.minimum(x, y).sum(axis=-1, dtype=np.int64)
    return np.where(most == _FULL * PIVOTS, np.iinfo(np.int64).max // 16, most)


def _places(found: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return (found >> shift).astype(np.int64), ((found * _OTHER) >> shift).astype(np.int64)


# ---- the two passes over the texts -------------------------------------------

def _profile(docs: DataFrame, doc_id: str, text: str, bits: int) -> DataFrame:
    """A row (doc_id, n, fp, parts) per document, and a row with the task's sketch. Written, then read by both uses.

    `parts` are the sizes of the set between common pivots.
    """
    id_type = docs.schema[doc_id].dataType
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    names = ["doc_id", "n", "fp", "parts", "sketch"]

    def run(batches):
        counts, pending, held, schema = np.zeros((2, 1 << bits), np.int32), [], 0, None

        def add():
            for row, place in zip(counts, _places(np.concatenate(pending), bits)):
                row += np.bincount(place, minlength=1 << bits).astype(np.int32)

        for batch in batches:
            n, fp, parts = [], [], []
            for body in batch.column(1).to_pylist():
                found = shingles(body)
                n.append(len(found))
                fp.append(set_hash(found))
                parts.append(part_sizes(found))
                pending.append(found)
                held += len(found)
                if held > 2_000_000:
                    add()
                    pending, held = [], 0
            schema = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(parts, pa.binary()),
                 pa.nulls(len(n), pa.binary())], names=names)
        if schema is not None:
            if pending:
                add()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, schema), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([_pack(counts)], pa.binary())], names=names)

    return cut(source.mapInArrow(run, f"doc_id {id_type.simpleString()}, n long, fp long, parts binary, sketch binary"))


def _pack(counts: np.ndarray) -> bytes:
    return pa.compress(counts.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, bits: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, (2 << bits) * 4, codec="zstd", asbytes=True), np.int32).reshape(2, 1 << bits)


def _sketch(profile: DataFrame, bits: int) -> np.ndarray:
    """The sum of all tasks' sketches, added up level by level; counters stop at the largest int."""

    def add(batches):
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += _unpack(packed, bits)
        yield pa.RecordBatch.from_arrays([pa.array([_pack(np.minimum(total, 2 ** 31 - 1).astype(np.int32))], pa.binary())], names=["sketch"])

    parts = profile.filter(F.col("sketch").isNotNull()).select("sketch")
    n = parts.count()
    while n > MERGE:
        n = -(-n // MERGE)
        parts = cut(parts.repartition(n).mapInArrow(add, "sketch binary"))
    total = np.zeros((2, 1 << bits), np.int64)
    for row in parts.toLocalIterator():  # a sketch at a time
        total += _unpack(row.sketch, bits)
    return np.minimum(total, 2 ** 31 - 1).astype(np.int32)


def _prefixes(docs: DataFrame, text: str, sketch: np.ndarray, bits: int) -> DataFrame:
    """(h, n, fp, pos): the rarest shingles of every set, as many as a similar set must share one of."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # of fixed size

    def run(batches):
        counts, seen, out, held = shared.value, set(), [], 0
        for batch in batches:
            for body in batch.column(0).to_pylist():
                found = shingles(body)
                n = len(found)
                if not n or (key := (n, set_hash(found))) in seen:
                    continue
                seen.add(key)
                a, b = _places(found, bits)
                order = np.argsort(np.minimum(counts[0][a], counts[1][b]), kind="stable")[:n - (4 * n + 4) // 5 + 1]
                out.append((found[order].view(np.int64), n, key[1]))
                held += len(order)
                if held > OUT_ROWS:
                    yield rows(out)
                    out, held = [], 0
        if out:
            yield rows(out)

    def rows(out):
        sizes = [len(h) for h, _, _ in out]
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([h for h, _, _ in out])), pa.array(np.repeat(np.array([n for _, n, _ in out], np.int32), sizes)),
            pa.array(np.repeat(np.array([f for _, _, f in out], np.int64), sizes)),
            pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]))], names=["h", "n", "fp", "pos"])

    return docs.select(F.col(text).cast("binary").alias("body")).mapInArrow(run, "h long, n int, fp long, pos int")


def _meetings(prefixes: DataFrame) -> DataFrame:
    """The prefix shingles that two classes or more of fitting sizes have: (h, n, fp, pos), one row per class.

    A class without a neighbour in size that fits has no class that fits. Rows come sorted by shingle, then by size. They stream through; a task keeps the last row only.
    """
    ordered = prefixes.repartition("h").sortWithinPartitions("h", "n", "fp")

    def run(batches):
        last, told = None, False  # the last row, and whether it has been sent on
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if last is not None:
                columns = [np.concatenate(([x], c)) for x, c in zip(last, columns)]
            h, n, fp, pos = columns
            same = (h[1:] == h[:-1])
            fresh = np.concatenate(([True], ~(same & (n[1:] == n[:-1]) & (fp[1:] == fp[:-1]))))
            h, n, fp, pos = (c[fresh] for c in (h, n, fp, pos))
            follows = np.concatenate(([False], (h[1:] == h[:-1]) & (n[:-1].astype(np.int64) * 5 >= n[1:].astype(np.int64) * 4)))
            precedes = np.concatenate((follows[1:], [False]))
            emit = follows | precedes
            if last is not None and told:
                emit[0] = False
            told = bool(emit[-1]) or (told and len(h) == 1 and last is not None)
            last = [c[-1] for c in (h, n, fp, pos)]
            at = np.flatnonzero(emit)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (h, n, fp, pos)], names=["h", "n", "fp", "pos"])

    return cut(ordered.mapInArrow(run, "h long, n int, fp long, pos int"))


# ---- candidates and verification ------------------------------------------------

def _possible(n: Column, pos: Column, n0: Column, pos0: Column) -> Column:
    """Length, prefix and position filters for a set and one not larger that meet on a shingle.

    They hold wherever a similar pair meets first, so every similar pair passes at least once.
    """
    n, n0 = n.cast("long"), n0.cast("long")
    overlap = F.ceil((n + n0) * 4 / F.lit(9))
    index_prefix = n0 - F.ceil(n0 * 8 / F.lit(9)) + 1
    return (n0 * 5 >= n * 4) & (pos0 < index_prefix) & (F.least(n - pos, n0 - pos0) >= overlap)


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets overlap by at least 80 in 100 of their union, with that overlap."""
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    wanted = texts.join(ids, "id", "left_semi")

    def run(batches):
        for batch in batches:
            common, keep = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = shingles(x), shingles(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
                common.append(both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(common, pa.int64())], names=["a", "b", "common"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select(F.col("a").alias("id"), "a", "b").join(wanted, "id").select(
        F.col("b").alias("id"), "a", "b", F.col("body").alias("body_a")).join(wanted, "id")
    return cut(joined.select("a", "b", "body_a", "body").mapInArrow(run, "a long, b long, common long"))


def _named_in(ids: DataFrame, column: str, name: Column) -> Column:
    """Whether the hash of `name` is among those of the ids: a bitmap of fixed size, looked up row by row, that keeps
    most other rows out of a join."""
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(1 << BITMAP_BITS))
    words = ids.select(place.alias("p")).groupBy(F.expr("CAST(p div 64 AS INT) AS w")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("bits")).toArrow()  # of fixed size, not a Python object per word
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bitmap[words["w"].to_numpy()] = words["bits"].to_numpy()
    whole = pa.ListArray.from_arrays(pa.array([0, len(bitmap)], pa.int32()), pa.array(bitmap))
    held = ids.sparkSession.createDataFrame(pa.table({"bits": whole}))
    here = F.pmod(F.xxhash64(name), F.lit(1 << BITMAP_BITS))
    word = F.element_at(held.scalar(), (F.floor(here / 64) + 1).cast("int"))
    return F.getbit(word, (here % 64).cast("int")) == 1


def _texts(docs: DataFrame, doc_id: str, text: str, classes: DataFrame) -> DataFrame:
    """(id, body): a text of every class, found by the identifier that stands for the class.

    Classes of rows without an identifier are found by their sets.
    """
    some = docs.select(F.col(doc_id).alias("rep"), F.col(text).alias("body"))
    keys = classes.select("rep", F.col("n").alias("_n"), F.col("fp").alias("_fp"), "id")
    named = some.filter(_named_in(classes.filter(F.col("rep").isNotNull()).select("rep").distinct(), "rep", F.col("rep")))
    found = _of_their_class(named.join(keys.filter(F.col("rep").isNotNull()), "rep"))

    def start():
        def work(bodies):
            sets = [shingles(b) for b in bodies]
            return [pa.array([len(s) for s in sets], pa.int32()), pa.array([set_hash(s) for s in sets], pa.int64())]
        return work

    nameless = append(some.filter(F.col("rep").isNull()), "body", start, "n int, fp long", "_set", ["body"]).select("body", "_set.*")
    nameless = nameless.join(classes.filter(F.col("rep").isNull()).select("n", "fp", "id"), ["n", "fp"])
    return cut(found.unionByName(nameless.select("id", F.col("body").cast("binary").alias("body")).dropDuplicates(["id"])))


def _of_their_class(rows: DataFrame) -> DataFrame:
    """(id, body) of the rows whose text has the set of the class they were joined with, once per task."""

    def run(batches):
        seen = set()
        for batch in batches:
            n, fp, ids, bodies = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i in range(len(ids)):
                found = shingles(bodies[i]) if ids[i] not in seen else ()
                keep.append(len(found) == n[i] and set_hash(found) == fp[i])
                if keep[-1]:
                    seen.add(ids[i])
            yield batch.select(["id", "body"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("_n", "_fp", "id", F.col("body").cast("binary").alias("body")).mapInArrow(run, "id long, body binary")


def _identified(met: DataFrame, reps: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes with an `id`, and the meetings by id. The id is a hash of size and set, under the first
    seed for which no two classes share one."""
    classes = cut(met.select("n", "fp").distinct().join(reps, ["n", "fp"]).join(parts, ["n", "fp"]))
    seed = 0
    while not classes.groupBy(F.xxhash64("n", "fp", F.lit(seed))).count().filter("count > 1").isEmpty():
        seed += 1
    name = F.xxhash64("n", "fp", F.lit(seed)).alias("id")
    return classes.select("*", name), met.select("h", name, "n", "pos")


def _like_parts(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Suffix filter: the overlap of (a, b) is at most the sum of the smaller parts."""
    a = classes.select(F.col("id").alias("a"), F.col("parts").alias("pa"), F.col("n").alias("na"))
    b = classes.select(F.col("id").alias("b"), F.col("parts").alias("pb"), F.col("n").alias("nb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, PIVOTS) for i in (2, 3))
                both = batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy()
                keep = _overlap_bound(x, y) * 9 >= both * 4
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return cut(pairs.join(a, "a").join(b, "b").select("a", "b", "pa", "pb", "na", "nb").mapInArrow(run, "a long, b long"))


def _proposals(meetings: DataFrame) -> DataFrame:
    """At most one pair (a, b) for every class a: of the classes in front of it on its prefix shingles (the last one, and
    the first one of about its size), the one it meets most often. One pass over the rows in order."""
    in_order = Window.partitionBy("h").orderBy("n", "id")
    here = F.struct("id", "n", "pos")
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(LENGTHS)))
    seen = meetings.withColumn("_last", F.lag(here).over(in_order)).withColumn("_size", size).withColumn(
        "_first", F.first(here).over(
            Window.partitionBy("h", "_size").orderBy("n", "id").rowsBetween(Window.unboundedPreceding, 0)))
    both = seen.select("id", "n", "pos", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("o"))
    near = both.filter(
        F.col("o").isNotNull() & (F.col("o.id") != F.col("id")) & _possible(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos")))
    often = near.groupBy(F.col("id").alias("a"), F.col("o.id").alias("b")).agg(F.count("*").alias("c"))
    return often.groupBy("a").agg(F.max(F.struct("c", "b")).alias("s")).select("a", "s.b")


def _open(meetings: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows on shingles where classes of different components meet, with the number of rows there.

    Only classes that were linked have a label worth joining.
    """
    linked = labels.filter(F.col("component") != F.col("id")).withColumnRenamed("component", "_c")
    held = meetings.join(linked, "id", "left").select("h", "id", "n", "pos", F.coalesce("_c", "id").alias("component"))
    held = cut(held)
    # Counted with map-side sums and joined back, so that no task buffers the rows of a shingle; Spark splits a join's hot keys.
    met = held.groupBy("h").agg(F.count("*").alias("crowd"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    return cut(held.join(met.filter(F.col("_lo") != F.col("_hi")).select("h", "crowd"), "h"))


def _small_crowds(rows: DataFrame, tried: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components that meet in a small crowd, pass the filters and were not tried."""
    few = rows.filter(F.col("crowd") <= CROWD).select("h", "id", "n", "pos", "component")
    other = few.select("h", *[F.col(c).alias(f"{c}_") for c in ("id", "n", "pos", "component")])
    larger = (F.col("n") > F.col("n_")) | ((F.col("n") == F.col("n_")) & (F.col("id") > F.col("id_")))
    met = few.join(other, "h").filter(
        larger & (F.col("component") != F.col("component_")) & _possible(F.col("n"), F.col("pos"), F.col("n_"), F.col("pos_")))
    pairs = cut(met.select(F.col("id").alias("a"), F.col("id_").alias("b")).distinct())
    return pairs.join(tried, ["a", "b"], "left_anti")


def _dealt(rows: DataFrame, turn: int | None) -> DataFrame:
    """The rows of large crowds with the group `g` of the crowd they are compared in, and their `side`: rows of
    one side are not compared with each other, but rows of side -1 are with all.

    In a turn a crowd is dealt into blocks by a hash of id and turn. Without a turn, the blocks of a crowd of more than
    one meet in pairs, a group each: those of the same or neighbouring bands of size, unless both are of the crowd's
    most frequent component.
    """
    alone = F.lit(-1).alias("side")
    if turn is not None:
        block = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("crowd") / BLOCK))
        return rows.select("h", block.alias("g"), alone, "id", "n", "pos", "component")
    few = rows.filter(F.col("crowd") <= BLOCK).select("h", F.lit(-1).cast("long").alias("g"), alone, "id", "n", "pos", "component")
    many = rows.filter(F.col("crowd") > BLOCK)
    if many.isEmpty():
        return few

    # A row per crowd, and per band and side of it; there are at most as many crowds as rows by BLOCK.
    often = many.groupBy("h", "component").count().groupBy("h").agg(F.max(F.struct("count", "component")).alias("s"))
    placed = many.join(F.broadcast(often.select("h", F.col("s.component").alias("_most"))), "h").withColumns({
        "band": F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))), "most": F.col("component") == F.col("_most")})
    cells = cut(placed.groupBy("h", "band", "most").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    placed = placed.join(F.broadcast(cells), ["h", "band", "most"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))

    same = (F.col("band") == F.col("band_")) & (F.col("most") == F.col("most_"))
    meet = F.when(F.col("band") == F.col("band_"), ~F.col("most")).otherwise(
        (F.col("band_") == F.col("band") + 1) & ~(F.col("most") & F.col("most_")))
    pairs = cells.join(cells.select("h", *[F.col(c).alias(f"{c}_") for c in ("band", "most", "blocks")]), "h").filter(meet)
    pairs = pairs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.withColumn("block_", F.explode(F.sequence(F.when(same, F.col("block")).otherwise(0), F.col("blocks_") - 1)))
    itself = same & (F.col("block") == F.col("block_"))
    pairs = cut(pairs.withColumn("itself", itself).withColumn("g", F.monotonically_increasing_id()))
    groups = pairs.select("h", "band", "most", "block", "g", F.when(F.col("itself"), -1).otherwise(0).alias("side")).unionByName(
        pairs.filter(~F.col("itself")).select(
            "h", F.col("band_").alias("band"), F.col("most_").alias("most"), F.col("block_").alias("block"), "g", F.lit(1).alias("side")))
    met = placed.join(groups, ["h", "band", "most", "block"])
    return few.unionByName(met.select("h", "g", "side", "id", "n", "pos", "component"))


def _large_crowds(rows: DataFrame, classes: DataFrame, turn: int | None) -> DataFrame:
    """Pairs (a, b) of different components in large crowds that pass all filters: a forest over the components of
    each crowd, another one every `turn`, or all pairs without a turn.

    The rows of a group come together in one task with the parts of their sets, a few hundred bytes each. The
    task compares one class with all others at a time.
    """
    many = _dealt(rows.filter(F.col("crowd") > CROWD), turn).join(classes.select("id", "parts"), "id")
    ordered = many.select("h", "g", "id", "n", "pos", "component", "side", "parts").repartition("h", "g").sortWithinPartitions(
        "h", "g", "n", "id")

    def crowd(ids, n, pos, component, side, parts):
        """Walks over the classes; those that hash low in this turn go first and are preferred as partners."""
        keys = (ids.view(np.uint64) + np.uint64(1 + (turn or 0)) * _FACTORS[0]) * _FACTORS[1]
        rank = np.argsort((keys ^ (keys >> np.uint64(31))) * _FACTORS[2], kind="stable")
        ids, n, pos, component, side, parts = (c[rank] for c in (ids, n, pos, component, side, parts))
        out_a, out_b, held = [], [], 0
        for i in range(len(ids)):
            if turn is None:
                apart = (component[i + 1:] != component[i]) & ((side[i + 1:] != side[i]) | (side[i] < 0))
                others = np.flatnonzero(apart) + i + 1
            else:
                others = np.flatnonzero(component != component[i])
            if not len(others):
                if turn is not None:
                    break  # one component is left
                continue
            big = (n[others] < n[i]) | ((n[others] == n[i]) & (ids[others] < ids[i]))
            large, small = np.where(big, n[i], n[others]), np.where(big, n[others], n[i])
            left_l, left_s = np.where(big, n[i] - pos[i], (n - pos)[others]), np.where(big, (n - pos)[others], n[i] - pos[i])
            need = -(-(large + small) * 4 // 9)
            fits = (small * 5 >= large * 4) & (left_s > -(-small * 8 // 9) - 1) & (np.minimum(left_l, left_s) >= need)
            others, need = others[fits], need[fits]
            keep = _overlap_bound(parts[others], parts[i]) >= need
            others = others[keep]
            if turn is not None and len(others):
                others = others[np.unique(component[others], return_index=True)[1]]
                component[np.isin(component, component[others])] = component[i]
            first = (n[others] > n[i]) | ((n[others] == n[i]) & (ids[others] > ids[i]))
            out_a.append(np.where(first, ids[others], ids[i]))
            out_b.append(np.where(first, ids[i], ids[others]))
            held += len(others)
            if held > OUT_ROWS:
                yield found(out_a, out_b)
                out_a, out_b, held = [], [], 0
        if out_a:
            yield found(out_a, out_b)

    def found(out_a, out_b):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    def columns(batch):
        h, g, ids, n, pos, component, side = (batch.column(i).to_numpy() for i in range(7))
        parts = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, PIVOTS)
        return [h, g, ids, n.astype(np.int64), pos.astype(np.int64), component, side, parts]

    def run(batches):
        held = None  # the rows of the group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = columns(batch)
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            starts = np.flatnonzero(np.concatenate(([True], (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]))))
            for a, b in zip(starts[:-1], starts[1:]):
                yield from crowd(*[c[a:b].copy() for c in now[2:]])
            held = [c[starts[-1]:] for c in now]
        if held is not None:
            yield from crowd(*[c.copy() for c in held[2:]])

    return cut(ordered.mapInArrow(run, "a long, b long").distinct())


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    return labels if links.isEmpty() else merge(labels, links)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest identifier reachable over links."""
    return _grouped(docs, doc_id, text, sketch_bits).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("name").alias("component_id"))


def _grouped(docs: DataFrame, doc_id: str, text: str, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n, fp, component, name) per document: its class, the key of its component, and the component's name. Two
    components may have one name, where identifiers repeat; the key tells them apart. It is null without shingles."""
    profile = _profile(docs, doc_id, text, sketch_bits)
    members = profile.filter(F.col("n").isNotNull()).select("doc_id", F.col("n").cast("int").alias("n"), "fp")
    met = _meetings(_prefixes(docs, text, _sketch(profile, sketch_bits), sketch_bits))

    reps = members.filter(F.col("n") > 0).groupBy("n", "fp").agg(F.min("doc_id").alias("rep"))
    parts = profile.filter(F.col("n") > 0).select(F.col("n").cast("int").alias("n"), "fp", "parts").dropDuplicates(["n", "fp"])
    classes, meetings = _identified(met, reps, parts)
    texts = _texts(docs, doc_id, text, classes)

    tried = cut(_proposals(meetings))
    labels = classes.select("id", F.col("id").alias("component"))
    labels = _joined(labels, _verify(_like_parts(tried, classes), texts))
    rows = _open(meetings, labels)
    labels = _joined(labels, _verify(_like_parts(_small_crowds(rows, tried), classes), texts))
    for turn in [*range(ROUNDS), None]:
        rows = _open(rows.filter(F.col("crowd") > CROWD).select("h", "id", "n", "pos"), labels)
        if rows.isEmpty():
            break
        pairs = _large_crowds(rows, classes, turn).join(tried, ["a", "b"], "left_anti")
        labels = _joined(labels, _verify(cut(pairs), texts))
        tried = tried.unionByName(pairs)

    grouped = classes.select("id", "n", "fp", "rep").join(labels, "id")
    names = grouped.groupBy("component").agg(F.min("rep").alias("name"))
    named = grouped.join(names, "component").select("n", "fp", "component", "name")
    # A class that meets no other is its own component, known by its size and hash; the others by 0 and their number.
    linked = F.struct(F.lit(0).alias("n"), F.col("component").alias("fp"))
    own = F.when(F.col("component").isNotNull(), linked).otherwise(F.struct("n", "fp"))
    of_class = reps.join(named, ["n", "fp"], "left").select(
        "n", "fp", own.alias("component"), F.coalesce("name", "rep").alias("name"))
    found = members.filter(F.col("n") > 0).join(of_class, ["n", "fp"]).select("doc_id", "n", "fp", "component", "name")
    alone = members.filter(F.col("n") == 0).select(
        "doc_id", "n", "fp", F.lit(None).cast("struct<n:int,fp:long>").alias("component"), F.col("doc_id").alias("name"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of every component: that of the smallest identifier, among rows with this identifier that of the
    smallest class. Rows are known by identifier and class, so a repeated identifier with another text is another document.

    Documents without shingles are alone and all stay, rows without an identifier cannot be told apart and stay.
    """
    found = cut(_grouped(docs, doc_id, text).drop("name").filter(F.col("doc_id").isNotNull()))
    best = found.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("doc_id", "n", "fp")).alias("k"))
    keepers = cut(best.select("k.*").unionByName(found.filter(F.col("component").isNull()).select("doc_id", "n", "fp").distinct()))
    # Only rows whose identifier repeats have to be asked for their class again.
    repeated = cut(found.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id"))
    row = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*row).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("body"))
    without_id, named = whole.filter(F.col("doc_id").isNull()), whole.filter(F.col("doc_id").isNotNull())
    single = named.join(repeated, "doc_id", "left_anti").join(keepers, "doc_id", "left_semi")
    doubtful = named.join(repeated, "doc_id", "left_semi")

    def classed(batches):
        for batch in batches:
            sets = [shingles(b) for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int32()), pa.array([set_hash(x) for x in sets], pa.int64())],
                names=["row", "doc_id", "n", "fp"])

    schema = StructType([*doubtful.schema.fields[:2], StructField("n", IntegerType()), StructField("fp", LongType())])
    chosen = doubtful.mapInArrow(classed, schema).join(keepers, ["doc_id", "n", "fp"], "left_semi")
    once = chosen.filter("n > 0").dropDuplicates(["doc_id", "n", "fp"]).unionByName(chosen.filter("n = 0"))
    return single.select("row").unionByName(once.select("row")).unionByName(without_id.select("row")).select("row.*")
