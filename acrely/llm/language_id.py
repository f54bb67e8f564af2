"""Language identification with error-correcting output codes.

Every language has a codeword. Each bit of the codewords is predicted by a binary classifier over
hashed character 1- to 3-grams (the log odds of the n-grams under the languages with and without the bit).
Decoding compares a document's margins with every codeword: each bit costs the logistic loss of its
signed margin, weighted by how well its classifier did on rows kept aside from the fit; the
codeword with the smallest weighted loss wins. A runner-up almost as near makes the answer ambiguous.

The fit reads a sample of `PER_LANGUAGE` labelled rows (expected) of every language, drawn by a hash of the
identifier; whole texts are read, and prediction reads every row.

Defined cases: a null text and a text without letters is `und` with score 0; without any labelled
row everything is; with one language that language is certain; a language is learnt from one row if it has no
more; rows with a null identifier are in fold 0; repeated rows are predicted one by one; further columns pass through, one
named like the result gives way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrely.llm.common import append, fold

PER_LANGUAGE = 2_000    # labelled rows of a language the fit reads
BUCKETS = 1 << 16       # of hashed n-grams
ORDERS = (1, 2, 3)
EXHAUSTIVE = 7          # languages up to which every way to halve them is a bit
CHUNK = 200_000         # characters that are scored at a time
LOOKUP = 8192           # n-grams whose weights are looked up at a time
LANES = 32              # of count tables that are added up first
MOST_LANGUAGES = 2_000  # a table with more labels than this is refused
AMBIGUOUS = 0.02         # distance between the best two scores below which an answer is flagged
FIELDS = "lang_pred string, score double, ambiguous boolean"
UNKNOWN = "und"

_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), bool, 0x110000)


def characters(text: bytes | None) -> np.ndarray:
    """The lower-cased letters of the text as code points; whatever is between them becomes one blank."""
    if not text:
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    keep = letter | np.concatenate(([True], letter[:-1]))
    clean = np.where(letter, points, np.uint32(32))[keep]
    return np.concatenate(([np.uint32(32)], clean)) if letter.any() else np.empty(0, np.uint32)


def buckets(points: np.ndarray) -> np.ndarray:
    """Hash buckets of all n-grams."""
    found, code = [], np.zeros(len(points), np.uint32)
    for n in ORDERS:
        if len(points) < n:
            break
        code = (code[:len(points) - n + 1] + points[n - 1:] * _MIX[n - 1]) * np.uint32(0x9E3779B1)
        found.append((code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 per language; every bit tells some languages from the others."""
    if n <= EXHAUSTIVE:
        halves = [(1, *rest) for rest in product((1, -1), repeat=max(0, n - 1)) if -1 in rest]
        return np.array(halves, np.float32).T.reshape(n, len(halves))
    length, rng, best = 15 * int(np.ceil(np.log2(n))), np.random.default_rng(7), (-1, None)
    for _ in range(50):
        code = rng.choice((1.0, -1.0), size=(n, length)).astype(np.float32)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * length).min()
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray        # languages x bits
    weights: np.ndarray     # buckets x bits: log odds
    scale: np.ndarray       # per bit: what a usual margin is divided by
    trust: np.ndarray       # per bit: weight of its loss

    def margins(self, text: bytes | None) -> np.ndarray | None:
        """Mean log odds per n-gram and bit, or None without a letter."""
        points = characters(text)
        if not len(points):
            return None
        total, seen = np.zeros(self.code.shape[1]), 0
        for at in range(0, len(points), CHUNK):
            grams = buckets(points[at:at + CHUNK])
            for i in range(0, len(grams), LOOKUP):
                total += self.weights[grams[i:i + LOOKUP]].sum(axis=0, dtype=np.float64)
            seen += len(grams)
        return total / seen

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        signed = self.code * (margins / self.scale)
        loss = (np.logaddexp(0.0, -3.0 * signed) * self.trust).sum(axis=1) / self.trust.sum()
        chance = np.exp(-4.0 * (loss - loss.min()))
        chance /= chance.sum()
        order = np.argsort(-chance, kind="stable")
        return self.languages[order[0]], float(chance[order[0]]), bool(chance[order[0]] - chance[order[1]] < AMBIGUOUS)

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        margins = self.margins(text) if self.languages else None
        return (UNKNOWN, 0.0, False) if margins is None else self.decode(margins)


def _log_odds(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Buckets x bits, from languages x buckets; every language weighs the same."""
    shares = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True)
    ones, zeros = (code > 0).astype(np.float64), (code < 0).astype(np.float64)
    return (np.log(shares.T @ ones / ones.sum(axis=0)) - np.log(shares.T @ zeros / zeros.sum(axis=0))).astype(np.float32)


def _count(sample: DataFrame) -> dict[str, np.ndarray]:
    """N-gram counts per language: the driver receives one row of fixed size per language."""

    def local(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                into = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                into += np.bincount(buckets(characters(text)), minlength=BUCKETS)
        names = sorted(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([held[k].tobytes() for k in names], pa.binary())], names=["lang", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS, np.int64)
        for part in rows["counts"]:
            total += np.frombuffer(part, np.int64)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "counts": [total.tobytes()]})

    parts = sample.select("lang", "body").mapInArrow(local, "lang string, counts binary")
    # Lanes first: a table of fixed size comes from every task, and no task adds up those of all tasks.
    lanes = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES))).groupBy("lang", "lane").applyInPandas(add, "lang string, counts binary")
    return {r.lang: np.frombuffer(r.counts, np.int64) for r in lanes.groupBy("lang").applyInPandas(add, "lang string, counts binary").collect()}


def fit(
    docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> Model:
    """Learn from the rows for which `learn` holds and the language is known."""
    # Only what is needed, under names of its own: the table may have columns of any name.
    known = docs.filter(learn & F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").cast("binary").alias("body"))
    counts = known.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("rate"))
    rates = counts.limit(MOST_LANGUAGES + 1).collect()
    if len(rates) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    shares = F.broadcast(docs.sparkSession.createDataFrame(rates, counts.schema))
    chance = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(shares, "lang").filter(chance < F.col("rate")).select(
        "lang", "body", (F.pmod(F.xxhash64("id", F.lit(11)), F.lit(5)) == 0).alias("aside"))
    counted = _count(sample.filter(~F.col("aside")))
    # A language whose rows are all among those set aside is learnt from these.
    if rare := sorted({r["lang"] for r in rates} - set(counted)):
        counted |= _count(sample.filter(F.col("lang").isin(rare)))
    languages = sorted(counted)
    code = codewords(len(languages))
    model = Model(languages, code, np.zeros((BUCKETS, 0), np.float32), np.ones(code.shape[1]), np.ones(code.shape[1]))
    if len(languages) > 1:
        model.weights = _log_odds(np.stack([counted[k] for k in languages]).astype(np.float64), code)
        _weigh(model, sample.filter(F.col("aside")))
    return model


def _weigh(model: Model, aside: DataFrame) -> None:
    """Scale and trust of every bit, from rows the counts have not seen."""
    bits, place = model.code.shape[1], {k: i for i, k in enumerate(model.languages)}
    shared = aside.sparkSession.sparkContext.broadcast(model)

    def local(batches):
        model_ = shared.value
        rows, right, size = 0, np.zeros(bits), np.zeros(bits)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                margins = model_.margins(text)
                if margins is not None and lang in place:
                    signed = model_.code[place[lang]] * margins
                    rows, right, size = rows + 1, right + (signed > 0), size + np.abs(margins)
        yield pa.RecordBatch.from_pylist([{"rows": rows, "right": list(right), "size": list(size)}], pa.schema(
            [("rows", pa.int64()), ("right", pa.list_(pa.float64())), ("size", pa.list_(pa.float64()))]))

    parts = aside.select("lang", "body").mapInArrow(local, "rows long, right array<double>, size array<double>")
    sums = parts.select("rows", F.posexplode(F.arrays_zip("right", "size"))).groupBy("pos").agg(
        F.sum("rows"), F.sum("col.right"), F.sum("col.size")).collect()
    for bit, rows, right, size in sums:
        if rows:
            wrong = min(max(1 - right / rows, 0.002), 0.49)
            model.trust[bit] = np.log((1 - wrong) / wrong)
            model.scale[bit] = max(size / rows, 1e-6)


def identify(
    docs: DataFrame, model: Model, text: str = "text", into: str = "_lang", keep: Sequence[str] | None = None,
) -> DataFrame:
    """`docs` with the struct column `into`: lang_pred, score (0 to 1), ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model_ = shared.value

        def work(texts):
            found = [model_.predict(t) for t in texts]
            return [
                pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                pa.array([x[2] for x in found], pa.bool_())]
        return work

    return append(docs, text, start, FIELDS, into, keep)


def rejected(into: str = "_lang") -> Column:
    """No letters, or two languages about equally near."""
    return (F.col(f"{into}.lang_pred") == UNKNOWN) | F.col(f"{into}.ambiguous")


def training_rows(doc_id: str = "doc_id") -> Column:
    return fold(doc_id, 4) != 2
