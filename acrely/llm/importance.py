"""Target-distribution importance resampling: draw the documents that look most like a target corpus.

Words come from bytes: one 256-byte table lower-cases A-Z and blanks every separator of the UTF-8 text,
and `bytes.split` yields the words. A feature is a run of 1 to `runs` words joined by one space; its hash
is chained, crc32 of a run being crc32 of its last word seeded with that of the run before it, so longer
runs cost one step each. Counters reduce the texts of a task to distinct features and those to counts per bucket;
a task hands on at most `buckets` rows, so the corpus model is a table of fixed size however large the
corpus is.

A bucket's gain is the logarithm of the target's smoothed share over the corpus' share, in thousandths,
rounded down. A document weighs the mean gain of its features. A Gumbel draw, made from a hash of seed and
identifier, is added, and the best scores are drawn: sampling without replacement in proportion to the
weights, the same in every run.

Ranks come from counts per score. Scores are whole numbers within a range that depends on the buckets'
counts only through a logarithm, so their table is small and one task may add it up; documents of one
score, a thin slice because every identifier has its own noise, are numbered among themselves.

Defined cases: a null, empty or wordless text has no features, weight 0, and is never drawn when
`least_words` is above 0; every row counts, repeated rows too; rows of equal score and identifier get
successive ranks in no particular order; a null identifier draws its noise from the seed alone and comes first among
equal scores; an empty corpus or target gives gains from the smoothing alone; very long texts are read
whole; further columns pass through, one named like the result gives way.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrely.llm.common import append
from acrely.session import cut

RUNS = 2                # longest run of words that is a feature
BUCKETS = 10_000
DISTINCT = 1 << 18      # distinct features a task counts before it reduces them to buckets
MAX_SEED = 4294967296   # crc32 and the noise's hash are below this


def _byte_table() -> bytes:
    """A-Z to a-z; digits, a-z and all bytes of characters beyond ASCII stay; every other byte is a blank."""
    kept = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    lower = bytes(range(256)).lower()
    return bytes(b if b in kept else 32 for b in lower)


TABLE = _byte_table()


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def run_hashes(words: Sequence[bytes], longest: int) -> Iterator[list[int]]:
    """crc32 of every run of 1, 2 ... `longest` words, a list for each length. A run's hash is that of the run without
    its last word, carried on over a blank and that word: the shorter hash is the seed."""
    hashes = list(map(crc32, words))
    yield hashes
    for n in range(2, longest + 1):
        hashes = list(map(crc32, words[n - 1:], map(crc32, repeat(b" "), hashes)))
        yield hashes


def feature_counts(texts: DataFrame, text: str = "text", longest: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often the features of all texts fall in each bucket; buckets without any are left out."""

    def run(batches):
        counts, seen = Counter(), Counter()

        def reduce_seen() -> None:
            for value, n in seen.items():
                counts[value % buckets] += n
            seen.clear()

        for batch in batches:
            for body in batch.column(0).to_pylist():
                for hashes in run_hashes(words_of(body), longest):
                    seen.update(hashes)
                if len(seen) > DISTINCT:
                    reduce_seen()
        reduce_seen()
        if counts:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(counts.keys(), pa.int32()), "n": pa.array(counts.values(), pa.int64())})

    made = texts.select(F.col(f"`{text}`").cast("binary").alias("b")).mapInArrow(run, "bucket int, n long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Gains:
    """What every bucket adds to a document, in thousandths of a logarithm."""

    table: tuple[int, ...]
    longest: int = RUNS


def fit(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = RUNS, buckets: int = BUCKETS) -> Gains:
    """Count both corpora whole. The driver gets one number per bucket of each."""
    held = [dict.fromkeys(range(buckets), 0), dict.fromkeys(range(buckets), 0)]
    for counts, corpus in zip(held, (docs, target)):
        counts.update((r["bucket"], r["n"]) for r in feature_counts(corpus, text, longest, buckets).collect())
    ours, theirs = held
    all_ours, all_theirs = float(sum(ours.values()) + buckets), float(sum(theirs.values()) + buckets)
    return Gains(tuple(
        math.floor(1000 * math.log((theirs[b] + 1) * all_ours / ((ours[b] + 1) * all_theirs))) for b in range(buckets)), longest)


def weigh(docs: DataFrame, gains: Gains, text: str = "text", into: str = "_weight", keep: Sequence[str] | None = None) -> DataFrame:
    """Add `into`: (n_words, n_features, weight) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def start():
        table, longest = np.array(sent.value.table, dtype=np.int64), sent.value.longest

        def work(texts):
            n_words, n_features, weights = [], [], []
            for body in texts:
                words = words_of(body)
                n, gained = 0, 0
                for hashes in run_hashes(words, longest):
                    n += len(hashes)
                    gained += int(table[np.array(hashes, dtype=np.int64) % len(table)].sum())
                n_words.append(len(words))
                n_features.append(n)
                weights.append(gained // n if n else 0)
            return [pa.array(x, pa.int64()) for x in (n_words, n_features, weights)]

        return work

    return append(docs, text, start, "n_words long, n_features long, weight long", into, keep)


def noise(key: str, seed: int) -> Column:
    """A standard Gumbel draw in thousandths, rounded down, from a hash of seed and identifier."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / float(MAX_SEED)))).cast("long")


def resample(
    docs: DataFrame, gains: Gains, key: str = "doc_id", text: str = "text", percent: int = 25, least_words: int = 20,
    seed: int = 7, into: str = "_drawn", keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add `into`: (n_words, n_features, weight, score, rank); rank counts from 1 and is null where not drawn.

    Of the N rows with `least_words` or more, floor(percent * N / 100) are drawn: the highest scores, among
    equal ones the smallest identifiers.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != into]
    weighed = weigh(docs.withColumn("_key", F.col(f"`{key}`")), gains, text, "_w", [*kept, "_key"])
    scored = cut(weighed.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("_key").alias("key"), "_w.*",
        (F.col("_w.weight") + noise("_key", seed)).alias("score")))
    enough = scored.filter(F.col("n_words") >= least_words)
    per_score = enough.groupBy("score").agg(F.count("*").alias("here"))
    better = Window.orderBy(F.desc("score"))  # one row per score: thousandths of a logarithm, tens of thousands at most
    slices = per_score.select(
        F.col("score").alias("at"), (F.sum("here").over(better) - F.col("here")).alias("before"),
        F.sum("here").over(Window.partitionBy()).alias("all"))
    wanted = F.floor(F.lit(percent) * F.col("all") / 100).cast("long")
    drawn = slices.filter(F.col("before") < wanted).select("at", "before", wanted.alias("wanted"))
    eligible = F.when(F.col("n_words") >= least_words, F.col("score"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("slice").orderBy(F.col("key").asc_nulls_first()))
    # Rows outside every drawn slice never enter the numbering.
    marked = scored.withColumn("slice", eligible).join(F.broadcast(drawn), F.col("slice") == F.col("at"), "left")
    figures = ["n_words", "n_features", "weight", "score"]
    inside = marked.filter(F.col("at").isNotNull()).select(
        "row", *figures, F.when(place <= F.col("wanted"), place).cast("long").alias("rank"))
    outside = marked.filter(F.col("at").isNull()).select("row", *figures, F.lit(None).cast("long").alias("rank"))
    return inside.unionByName(outside).select("row.*", F.struct(*figures, "rank").alias(into))
