import math
import random

import pytest
from pyspark.sql import functions as F

from acrely.llm import mixing
from tests.llm.conftest import prose


def brute_targets(sizes):
    """Shares by weight with the excess handed on until no source is above its limit."""
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in fixed]
        if not free:
            return fixed
        rest, all_ = total - sum(fixed.values()), sum(weight[k] for k in free)
        share = {k: rest * weight[k] / all_ for k in free}
        over = [k for k in free if share[k] > 3 * sizes[k]]
        if not over:
            return {**fixed, **share}
        fixed |= {k: 3.0 * sizes[k] for k in over}


def brute_rate(sizes, target):
    """The multiplier of one source by bisection: returns words taken at unrounded rates per size."""
    scale = sum(s * s for s in sizes) / max(1, sum(sizes))
    lo, hi = -60.0, 60.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(s * min(3.0, math.exp(min(50, mid * s / scale))) for s in sizes) < target:
            lo = mid
        else:
            hi = mid
    return lo


def run(docs):
    return mixing.mix(mixing.sized(docs))


def summary(mixed):
    rows = mixed.select("source", "_mix.*").collect()
    out = {}
    for r in rows:
        x = out.setdefault(r.source, {"size": 0, "taken": 0, "target": r.target, "source_size": r.source_size})
        x["size"] += r["size"]
        x["taken"] += r["size"] * r.copies
        assert 0 <= r.copies <= 3
    return out


def corpus(seed, sources=("a", "b", "c", "é", None), n=400):
    rng = random.Random(seed)
    chance = [0.45, 0.1, 0.02, 0.3, 0.13][:len(sources)]
    return [(i, prose(rng, rng.choice((1, 2, 3, 5, 8, 30, 80))), "xx", rng.choices(sources, chance)[0]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_are_met(frame, seed):
    found = summary(run(frame(corpus(seed))))
    want = brute_targets({k: x["source_size"] for k, x in found.items()})
    for source, x in found.items():
        assert x["size"] == x["source_size"]
        assert x["target"] == pytest.approx(want[source], rel=1e-9)
        assert abs(x["taken"] - x["target"]) <= 2


def test_the_multiplier_solves_the_dual(spark):
    rng = random.Random(3)
    sizes = {"=a": [rng.randint(1, 400) for _ in range(300)], "=b": [rng.randint(1, 30) for _ in range(200)], "=c": [7] * 50}
    cells = spark.createDataFrame([(k, s) for k, v in sizes.items() for s in v], "key string, size long").groupBy("key", "size").agg(F.count("*").alias("n"))
    goals = {"=a": 0.3, "=b": 2.6, "=c": 3.0}
    frame_ = spark.createDataFrame([(k, sum(v), goals[k] * sum(v)) for k, v in sizes.items()], "key string, source_size long, target double")
    state = {r.key: r for r in mixing.solve(cells, frame_).collect()}
    for k in ("=a", "=b"):
        assert state[k].solved and state[k].lam == pytest.approx(brute_rate(sizes[k], goals[k] * sum(sizes[k])), rel=1e-4)
    assert state["=c"].full


@pytest.mark.parametrize("share", [0.3, 2.6])
def test_many_short_texts_beside_a_huge_one(spark, share):
    sizes = [(100, 40_000), (1_000_000, 1)]
    whole = sum(s * n for s, n in sizes)
    cells = spark.createDataFrame([("=a", s, n) for s, n in sizes], "key string, size long, n long")
    goals = spark.createDataFrame([("=a", whole, share * whole)], "key string, source_size long, target double")
    state = mixing.solve(cells, goals).first()
    taken = sum(s * n * min(3.0, math.exp(min(50, state.lam * s / state.scale))) for s, n in sizes)
    assert taken == pytest.approx(share * whole, rel=1e-6)


def test_a_hot_source_with_a_huge_text(frame):
    rows = [(0, "w " * 100_000, "xx", "c")] + [(i, "a b c d e f g h i j", "xx", "c") for i in range(1, 8001)]
    rows += [(20_000 + i, "k l m n o p q r s t", "xx", "ab"[i % 2]) for i in range(16_000)]
    found = summary(run(frame(rows, clashing=False)))
    assert all(abs(x["taken"] - x["target"]) <= 20 for x in found.values())


def test_a_missed_target_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ITERATIONS", 1)
    cells = spark.createDataFrame([("=a", 3, 10), ("=a", 50, 2)], "key string, size long, n long")
    goals = spark.createDataFrame([("=a", 130, 40.0)], "key string, source_size long, target double")
    with pytest.raises(RuntimeError, match="=a"):
        mixing.solve(cells, goals)


def test_reruns_and_partitions_agree(frame):
    docs = frame(corpus(4))
    pick = lambda df: sorted((r.doc_id, r.copies) for r in run(df).select("doc_id", "_mix.copies").collect())
    assert pick(docs) == pick(docs.repartition(7))


def test_hot_cells_are_cut(frame, monkeypatch):
    monkeypatch.setattr(mixing, "SPLIT_ROWS", 5)
    monkeypatch.setattr(mixing, "hot_groups", lambda cells, keys, size, rows, **_: cells.filter(F.col(size) > 5).select(*keys, size))
    rows = [(i, "a b c", "xx", "s") for i in range(200)] + [(300 + i, "d " * (i + 1), "xx", "t") for i in range(40)]
    found = summary(run(frame(rows)))
    assert all(abs(x["taken"] - x["target"]) <= 3 for x in found.values())


def test_odd_rows(frame, odd_rows):
    docs = frame(odd_rows)
    mixed = run(docs)
    assert mixed.drop("_mix").columns == docs.columns and mixed.count() == len(odd_rows)
    for r in mixed.filter("trim(coalesce(text, '')) = ''").select("_mix.size", "_mix.copies").collect():
        assert (r["size"], r.copies) == (0, 1)
    taken = sum(r._mix.copies for r in mixed.collect())
    assert mixing.repeat(mixed).count() == taken


def test_empty_table(frame):
    assert run(frame([])).count() == 0
