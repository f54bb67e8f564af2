"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled good; everything else is unlabelled web text. No text labelled bad is
ever used. The share of good texts among the unlabelled is estimated from how the scores of a
positive-against-unlabelled classifier are distributed in both (the ratio of the two tails), and a
classifier is trained on the non-negative unbiased risk (Kiryo et al.): where the estimated
risk on bad texts falls below zero, the step climbs back instead.

Features are counts over the whole text: kinds of characters, words, repetition, lines. The fit reads bounded
samples of feature rows, `POSITIVES` and `UNLABELLED`; scoring reads every row.

Defined cases: null, empty and blank texts have all counts zero and are scored like any other; without
positives or unlabelled rows every score is 0.5; labels of unknown documents are ignored; repeated labels
count once; further columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrely.llm.common import append, fold, sampled

POSITIVES = 10_000      # labelled rows the fit reads (expected)
UNLABELLED = 20_000     # unlabelled rows the fit reads (expected)
STEPS = 1_500
BATCH = 1_024
RATE = 0.02
SHRINK = 1e-4

_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "other_letter": range(128, 256),
    "stop": b".,;:'\"-?", "loud": b"!", "markup": b"<>{}[]=|\\/_^~`", "sign": b"#$%&*+@()",
}
_COUNTERS = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES.values()):
    _COUNTERS[list(_members), _i] = 1.0
FEATURES = 27


def features(text: bytes | None) -> list[float]:
    """Shares and logarithms, none of which depends on the length of the text alone but the first three."""
    words = text.split() if text else []
    if not words:
        return [0.0] * FEATURES
    n, size = len(words), len(text)
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _COUNTERS
    lower, upper, digit, other, stop, loud, markup, sign = kinds.tolist()
    counted = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    top = counted.most_common(1)[0][1]
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_kinds = Counter(lines)
    again = sum(map(bytes.__eq__, words, words[1:]))
    letters = max(1.0, lower + upper + other)
    shape = Counter((w.isalpha() or w.isalnum(), w.isupper() and len(w) > 1) for w in counted)
    lengths = np.fromiter(map(len, words), np.float64, n)
    return [
        np.log1p(n), np.log1p(size), np.log1p(len(lines)),
        lower / size, upper / letters, digit / size, other / letters, stop / n, loud / n, markup / n, sign / n,
        min(lengths.mean(), 40.0), min(lengths.std(), 40.0), min(lengths.max(), 200.0) / 20.0,
        len(counted) / n, top / n, (pairs.most_common(1)[0][1] / (n - 1)) if pairs else 0.0,
        len(pairs) / max(1, n - 1), again / n,
        1 - len(line_kinds) / len(lines), (sum(len(x) for x in line_kinds) / max(1, sum(map(len, lines)))),
        np.log1p(n / len(lines)), sum(x.rstrip().endswith((b".", b"!", b"?", b":")) for x in lines) / len(lines),
        sum(v for (plain, _), v in shape.items() if plain) / len(counted),
        sum(v for (_, caps), v in shape.items() if caps) / len(counted),
        text.count(b".") / n, (text.count(b"http") + text.count(b"@")) / n,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float = 0.5

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        """Standardised features, their squares and a constant."""
        x = np.clip((rows - self.centre) / self.spread, -5.0, 5.0)
        return np.concatenate([x, x * x / 5.0, np.ones((len(x), 1))], axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(self.inputs(rows) @ self.weights)


class _Adam:
    def __init__(self, size: int) -> None:
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0

    def step(self, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient ** 2
        return rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from classifier scores of rows kept out of its fit.

    Above any threshold the unlabelled hold at least that share of what the positives hold. The ratio is
    taken at the threshold where its upper confidence bound is lowest (Garg et al.).
    """
    slack = np.sqrt(np.log(20.0) / (2 * len(positive))) + np.sqrt(np.log(20.0) / (2 * len(unlabelled)))
    bound, share = np.inf, 1.0
    for c in np.quantile(positive, np.linspace(0.0, 0.95, 96)):
        in_p, in_u = (positive >= c).mean(), (unlabelled >= c).mean()
        if (in_u + slack) / in_p < bound:
            bound, share = (in_u + slack) / in_p, in_u / in_p
    return float(np.clip(share, 0.02, 0.98))


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int) -> np.ndarray:
    """Non-negative risk for a given prior; plain positive against unlabelled without one."""
    rng, w, adam = np.random.default_rng(seed), np.zeros(p.shape[1]), _Adam(p.shape[1])
    for step in range(STEPS):
        bp = p[rng.integers(0, len(p), min(BATCH, 4 * len(p)))]
        bu = u[rng.integers(0, len(u), min(BATCH, 4 * len(u)))]
        sp, su = _sigmoid(bp @ w), _sigmoid(bu @ w)
        as_good = -(bp * (1 - sp)[:, None]).mean(axis=0)      # gradient of the loss of positives as good
        u_bad = (bu * su[:, None]).mean(axis=0)               # of the unlabelled as bad
        if prior is None:
            gradient = as_good + u_bad
        else:
            p_bad = (bp * sp[:, None]).mean(axis=0)
            bad_risk = np.logaddexp(0, bu @ w).mean() - prior * np.logaddexp(0, bp @ w).mean()
            gradient = prior * as_good + u_bad - prior * p_bad if bad_risk >= 0 else prior * p_bad - u_bad
        w = w - adam.step(gradient + SHRINK * w, RATE * (1 - step / STEPS))
    return w


def fit_rows(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> Model:
    """The whole fit on feature rows."""
    both = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, FEATURES))
    model = Model(both.mean(axis=0), both.std(axis=0) + 1e-6, np.zeros(2 * FEATURES + 1))
    if not len(positive) or not len(unlabelled):
        return model
    p, u = model.inputs(positive), model.inputs(unlabelled)
    odd_p, odd_u = np.arange(len(p)) % 2 == 1, np.arange(len(u)) % 2 == 1
    scored_p, scored_u = [], []
    for side in (True, False):  # each half is scored by what the other half taught
        w = _train(p[odd_p == side], u[odd_u == side], None, seed) if (odd_p == side).any() and (odd_u == side).any() else model.weights
        scored_p.append(p[odd_p != side] @ w)
        scored_u.append(u[odd_u != side] @ w)
    model.prior = estimate_prior(np.concatenate(scored_p), np.concatenate(scored_u))
    model.weights = _train(p, u, model.prior, seed)
    # The decision at one half calls as many of the unlabelled good as the prior says there are.
    model.weights[-1] -= np.quantile(u @ model.weights, 1 - model.prior)
    return model


def _start():
    def work(texts):
        return [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]
    return work


def _collected(docs: DataFrame, doc_id: str, text: str) -> np.ndarray:
    """Feature rows of a bounded sample, in the order of the identifier."""
    rows = append(docs, text, _start, "x array<double>", "_x", [doc_id]).select(doc_id, "_x.x").toPandas()
    rows = rows.sort_values(doc_id, kind="stable")
    return np.array(rows["x"].tolist(), np.float64).reshape(-1, FEATURES)


def training_rows(doc_id: str = "doc_id") -> Column:
    return fold(doc_id, 3) != 1


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> Model:
    """Learn from labels of rows for which `learn` holds, and from unlabelled rows among them."""
    good = labels.filter(learn & (F.col(label) == 1)).select(doc_id).distinct()
    good = F.broadcast(sampled(good, doc_id, positives, 2))  # bounded by the sample
    rows = docs.filter(learn).select(doc_id, text)
    return fit_rows(
        _collected(rows.join(good, doc_id, "left_semi"), doc_id, text), _collected(sampled(rows, doc_id, unlabelled, 5), doc_id, text))


def score(
    docs: DataFrame, model: Model, text: str = "text", into: str = "_quality", keep: Sequence[str] | None = None,
) -> DataFrame:
    """`docs` with the struct column `into`: score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model_ = shared.value

        def work(texts):
            rows = np.array([features(t) for t in texts], np.float64).reshape(-1, FEATURES)
            return [pa.array(model_.score(rows), pa.float64())]
        return work

    return append(docs, text, start, "score double", into, keep)
