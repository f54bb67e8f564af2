"""Toxicity by weak supervision.

Many weak voters look at a text: a short lexicon of insults, patterns around its words, and words or word
beginnings mined from labelled texts (significant by their likelihood ratio). A voter fires or
abstains; one more says that nothing fired. A generative label model estimates by expectation maximisation how much
likelier each voter fires on toxic texts, and how voters are correlated given the class: a voter's
evidence is divided among those that fire with it. A label is one more voter. The posterior labels train a
linear classifier over voters and further mined words, which scores every text.

The fit reads bounded samples, `LABELLED` and `UNLABELLED` rows (expected), whole texts; scoring
reads every row.

Defined cases: null and empty texts fire nothing and are scored like any text without a hit; without labels
the lexicon and patterns alone vote; labels of unknown documents are ignored, repeated ones count once;
further columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrely.llm.common import append, fold, sampled

LABELLED = 20_000
UNLABELLED = 10_000
MOST_VOTERS = 400       # mined voters
MOST_WORDS = 4_000      # mined features of the classifier
SURE = 20.0             # likelihood ratio statistic a mined voter needs
LIKELY = 10.0           # and a feature of the classifier
FEWEST = 3              # toxic texts a mined word occurs in
BEGINNINGS = range(3, 8)
ROUNDS = 25             # of expectation maximisation
CACHED = 300_000        # words whose features a task remembers

LEXICON = tuple(w.encode() for w in (
    "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown jerk fool imbecile garbage filth vermin "
    "bastard retard freak creep coward liar pig rat ugly useless brainless "
    "dummkopf trottel abschaum arschloch vollidiot miststück "
    "connard crétin débile ordure abruti salaud "
    "estúpido imbécil idiota basura escoria cabrón").split())
ADDRESS = {b"you", b"your", b"youre", b"du", b"dich", b"ihr", b"tu", b"vous", b"te", b"eres", b"usted"}
PATTERNS = ("obfuscated", "spelled out", "addressed", "repeated", "shouted", "dense")

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LEET = bytes({48: 111, 49: 105, 51: 101, 52: 97, 53: 115, 55: 116, 64: 97, 36: 115, 33: 105}.get(b, _LETTERS[b]) for b in range(256))
_SPELLED = re.compile(rb"(?<![a-z])(?:[a-z][ .\-_*]){3,}[a-z](?![a-z])")
_WORDS = frozenset(LEXICON)


def words(text: bytes) -> list[bytes]:
    """Runs of letters, A-Z in lower case; bytes of other scripts count as letters."""
    return text.translate(_LETTERS).split()


def patterns(text: bytes, found: list[bytes], distinct: set[bytes]) -> list[int]:
    """Numbers of the patterns that fire."""
    fired = []
    if any(w in _WORDS and w not in distinct for w in set(text.translate(_LEET).split())):
        fired.append(0)
    if sum(len(w) == 1 for w in distinct) > 2:
        low = text.lower()
        if any(re.sub(rb"[^a-z]", b"", m.group()) in _WORDS for m in _SPELLED.finditer(low)):
            fired.append(1)
    if distinct & _WORDS:
        places = [i for i, w in enumerate(found) if w in _WORDS]
        if any(ADDRESS.intersection(found[max(0, i - 3):i + 4]) for i in places):
            fired.append(2)
        if len(places) > 1:
            fired.append(3)
        if any(w.upper() in text for w in distinct & _WORDS):
            fired.append(4)
        if len(places) * 100 > len(found):
            fired.append(5)
    return fired


def beginnings(word: bytes) -> list[bytes]:
    """The word itself (marked at its end) and its first letters."""
    return [word + b"$", *[word[:n] for n in BEGINNINGS if n <= len(word)]]


class Reader:
    """Numbers of the features of a text: lexicon words, patterns, then mined words and beginnings."""

    def __init__(self, mined: Sequence[bytes]) -> None:
        self.numbers = {w + b"$": i for i, w in enumerate(LEXICON)}
        first = len(LEXICON) + len(PATTERNS)
        for i, w in enumerate(mined):
            self.numbers.setdefault(w, first + i)
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def _of(self, word: bytes) -> tuple[int, ...]:
        if len(self.cache) > CACHED:
            self.cache.clear()
        numbers = self.numbers
        out = self.cache[word] = tuple(numbers[x] for x in beginnings(word) if x in numbers)
        return out

    def read(self, text: bytes | None) -> list[int]:
        found = words(text) if text else []
        distinct = set(found)
        cache, fired = self.cache, set()
        for w in distinct:
            hit = cache.get(w)
            if hit is None:
                hit = self._of(w)
            if hit:
                fired.update(hit)
        fired.update(len(LEXICON) + i for i in patterns(text or b"", found, distinct))
        return sorted(fired)


# ---- label model and classifier, on the sample's fired voters ----------------------

@dataclass
class Votes:
    """Fired features per row, flattened; `label` is 1, 0 or -1 for unknown."""

    rows: np.ndarray
    columns: np.ndarray
    label: np.ndarray

    def kept(self, below: int) -> Votes:
        keep = self.columns < below
        return Votes(self.rows[keep], self.columns[keep], self.label)


@dataclass
class LabelModel:
    prior: float = 0.1
    evidence: np.ndarray = field(default_factory=lambda: np.zeros(0))     # log likelihood ratio of firing, per voter
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))        # part of it that is the voter's own
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def _posterior(model: LabelModel, votes: Votes, silent: float, said: np.ndarray) -> np.ndarray:
    n = len(votes.label)
    odds = np.full(n, np.log(model.prior / (1 - model.prior)))
    odds += np.bincount(votes.rows, weights=(model.evidence * model.share)[votes.columns], minlength=n)
    odds[np.bincount(votes.rows, minlength=n) == 0] += silent
    odds += np.where(votes.label == 1, said[0], np.where(votes.label == 0, said[1], 0.0))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _correlations(votes: Votes, p: np.ndarray, fires: np.ndarray, voters: int) -> np.ndarray:
    """Correlation of the voters given the class, over the rows on which any of them fires."""
    at, rows = np.unique(votes.rows, return_inverse=True)
    v = np.zeros((len(at), voters), np.float32)
    v[rows, votes.columns] = 1.0
    n = len(votes.label)
    q = p[at].astype(np.float32)
    total = np.zeros((voters, voters))
    for weight, rate in ((q, fires[0]), (1 - q, fires[1])):
        mass = max(float((p if weight is q else 1 - p).sum()), 1e-9)
        total += (v * weight[:, None]).T @ v - mass * np.outer(rate, rate)
    spread = np.sqrt(np.maximum(np.diag(total), 1e-9))
    out = total / np.outer(spread, spread)
    np.fill_diagonal(out, 1.0)
    return np.clip(out, -1, 1) if n else out


def fit_labels(votes: Votes, voters: int) -> tuple[LabelModel, np.ndarray]:
    """The label model and the posterior of every row."""
    n, known = len(votes.label), votes.label >= 0
    model = LabelModel(evidence=np.zeros(voters), share=np.ones(voters), correlation=np.eye(voters))
    if not n:
        return model, np.zeros(0)
    silent = np.bincount(votes.rows, minlength=n) == 0
    p = np.where(known, np.where(votes.label == 1, 0.95, 0.05), np.where(silent, 0.05, 0.5))
    for turn in range(ROUNDS):
        toxic, clean = p.sum(), (1 - p).sum()
        fires = [
            (np.bincount(votes.columns, weights=w[votes.rows], minlength=voters) + 0.1) / (m + 1.0) for w, m in ((p, toxic), (1 - p, clean))]
        model.prior = float(np.clip(toxic / n, 0.005, 0.6))
        model.evidence = np.clip(np.log(fires[0] / fires[1]), -6, 6)
        if turn % 5 == 0:
            model.correlation = _correlations(votes, p, fires, voters)
            near = np.where(model.correlation > 0.2, model.correlation, 0.0)
            model.share = 1 / np.maximum(1.0, near.sum(axis=1))
        quiet = float(np.log(((p * silent).sum() + 0.5) / (toxic + 1)) - np.log((((1 - p) * silent).sum() + 0.5) / (clean + 1)))
        said = np.zeros(2)
        if known.any():
            right = (p * (votes.label == 1)).sum() + 1, ((1 - p) * (votes.label == 1)).sum() + 1
            wrong = (p * (votes.label == 0)).sum() + 1, ((1 - p) * (votes.label == 0)).sum() + 1
            seen = (p * known).sum() + 2, ((1 - p) * known).sum() + 2
            said = np.clip([np.log(right[0] / seen[0] / (right[1] / seen[1])), np.log(wrong[0] / seen[0] / (wrong[1] / seen[1]))], -6, 6)
        p = _posterior(model, votes, quiet, said)
    return model, p


def fit_linear(votes: Votes, posterior: np.ndarray, size: int, steps: int = 800, shrink: float = 5e-5) -> tuple[np.ndarray, float]:
    """Logistic regression of the posterior labels on the fired features."""
    w, bias, n = np.zeros(size), float(np.log((posterior.mean() + 1e-3) / (1 - posterior.mean() + 1e-3))) if len(posterior) else -2.0, len(posterior)
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1 if n else 1):
        f = np.bincount(votes.rows, weights=w[votes.columns], minlength=n) + bias
        r = 1 / (1 + np.exp(-np.clip(f, -30, 30))) - posterior
        g = np.bincount(votes.columns, weights=r[votes.rows], minlength=size) / n + shrink * w
        gb = r.mean()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        bias -= 0.05 * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.999 ** t)) + 1e-8)
    return w, float(bias)


# ---- Spark ---------------------------------------------------------------------------

@dataclass
class Model:
    mined: list[bytes]
    voters: int
    labels: LabelModel
    weights: np.ndarray
    bias: float


def mine(rows: DataFrame) -> list[tuple[bytes, float]]:
    """Words and beginnings that toxic texts hold more often, the most significant first.

    `rows` is the labelled sample (toxic, body); tasks count their rows, and the sums are ranked.
    """

    def local(batches):
        counts = (Counter(), Counter())
        for batch in batches:
            for toxic, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update({x for w in set(words(body or b"")) for x in beginnings(w)})
        names = list(counts[0] | counts[1])
        for at in range(0, len(names), 50_000):
            part = names[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([
                pa.array(part, pa.binary()), pa.array([counts[1][x] for x in part], pa.int64()),
                pa.array([counts[0][x] for x in part], pa.int64())], names=["word", "toxic", "clean"])

    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    a, b = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not a or not b:
        return []
    counted = rows.select("toxic", "body").mapInArrow(local, "word binary, toxic long, clean long").groupBy("word").agg(
        F.sum("toxic").cast("double").alias("t"), F.sum("clean").cast("double").alias("c"))
    t, c = F.col("t"), F.col("c")
    base = (t + c) / (a + b)

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = 2 * (term(t, base * a) + term(c, base * b) + term(a - t, (1 - base) * a) + term(b - c, (1 - base) * b))
    best = counted.filter((t >= FEWEST) & (t / a > 3 * c / b)).select("word", g.alias("g")).filter(F.col("g") >= LIKELY)
    best = best.orderBy(F.desc("g"), "word").limit(MOST_WORDS).collect()
    return [(bytes(r.word), r.g) for r in best]


def training_rows(doc_id: str = "doc_id") -> Column:
    return fold(doc_id, 5) != 0


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    labelled: int = LABELLED, unlabelled: int = UNLABELLED,
) -> Model:
    """Learn from labels of rows for which `learn` holds, and from unlabelled rows among them."""
    known = labels.filter(learn & F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.max(label).cast("int").alias("_label"))
    known = F.broadcast(sampled(known, doc_id, labelled, 2))  # bounded by the sample
    body = F.col(text).cast("binary").alias("body")
    with_label = docs.select(doc_id, body).join(known, doc_id).select(doc_id, "body", F.col("_label").alias("toxic"))
    mined = mine(with_label)
    voters = len(LEXICON) + len(PATTERNS) + sum(g >= SURE for _, g in mined[:MOST_VOTERS])
    names = [w for w, _ in mined]
    others = sampled(docs.filter(learn).select(doc_id, body), doc_id, unlabelled, 5).withColumn("toxic", F.lit(-1))
    rows = with_label.unionByName(others)

    def start():
        reader = Reader(names)
        return lambda texts: [pa.array([reader.read(t) for t in texts], pa.list_(pa.int32()))]

    read = append(rows, "body", start, "fired array<int>", "_v", [doc_id, "toxic"]).select(doc_id, "toxic", "_v.fired").toPandas()
    read = read.sort_values([doc_id, "toxic"], kind="stable")
    sizes = read["fired"].map(len).to_numpy(dtype=np.int64)
    votes = Votes(
        np.repeat(np.arange(len(read)), sizes), np.concatenate([np.asarray(x, np.int64) for x in read["fired"]] or [np.empty(0, np.int64)]),
        read["toxic"].to_numpy(dtype=np.int64))
    model, posterior = fit_labels(votes.kept(voters), voters)
    size = len(LEXICON) + len(PATTERNS) + len(names)
    return Model(names, voters, model, *fit_linear(votes, posterior, size))


def score(
    docs: DataFrame, model: Model, text: str = "text", into: str = "_toxicity", keep: Sequence[str] | None = None,
) -> DataFrame:
    """`docs` with the struct column `into`: score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.mined, model.weights.tolist(), model.bias))

    def start():
        mined, weights, bias = shared.value
        reader = Reader(mined)

        def work(texts):
            sums = [bias + sum(weights[i] for i in reader.read(t)) for t in texts]
            return [pa.array(1 / (1 + np.exp(-np.clip(sums, -30, 30))), pa.float64())]
        return work

    return append(docs, text, start, "score double", into, keep)
