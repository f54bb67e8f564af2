import numpy as np
import pytest
from pyspark.sql import functions as F

from acrely.operators import quantiles
from acrely.operators.quantiles import exact_quantiles, table_quantiles, value_at_rank
from acrely.operators.ranks import holdout, holdout_limit, ordinals, split_column, with_split_key

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]


def frame(spark, kind, n=4000, seed=7):
    rng = np.random.default_rng(seed)
    x = {
        "smooth": rng.normal(size=n),
        "hot": np.where(rng.random(n) < 0.4, 5.0, rng.normal(size=n) * 100),
        "skewed": np.exp(rng.normal(size=n) * 8),
        "equal": np.full(n, 3.25),
        "few": rng.integers(0, 4, n).astype(float),
    }[kind]
    g = np.where(rng.random(n) < 0.5, "a", np.where(rng.random(n) < 0.9, "b", None))
    rows = [(None if v is None else str(v), float(u) if i % 50 else None) for i, (v, u) in enumerate(zip(g, x))]
    return rows, spark.createDataFrame(rows, "g string, x double").repartition(5)


@pytest.mark.parametrize("kind", ["smooth", "hot", "skewed", "equal", "few"])
@pytest.mark.parametrize("bound", [1_000_000, 40])
def test_quantiles_equal_brute_force(spark, kind, bound):
    rows, df = frame(spark, kind)
    want = np.quantile([v for _, v in rows if v is not None], PROBS)
    got = table_quantiles(df, ["x"], PROBS, bound=bound)["x"]
    np.testing.assert_allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("bound", [1_000_000, 25])
def test_grouped_quantiles_keep_null_groups(spark, bound):
    rows, df = frame(spark, "hot")
    got = {r["g"]: r for r in exact_quantiles(df, ["x"], [0.25, 0.9], by=["g"], bound=bound).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        values = [v for k, v in rows if k == g and v is not None]
        assert r["total"] == len(values)
        np.testing.assert_allclose([r["q0"], r["q1"]], np.quantile(values, [0.25, 0.9]), rtol=1e-12)


def test_answers_do_not_depend_on_the_way_or_the_partitions(spark):
    _, df = frame(spark, "smooth")
    answers = [table_quantiles(x, ["x"], PROBS, bound=b)["x"] for x in (df, df.repartition(3)) for b in (1_000_000, 40)]
    assert len(set(answers)) == 1


def test_tiny_bound_still_finishes(spark):
    rows, df = frame(spark, "smooth", n=500)
    want = float(np.quantile([v for _, v in rows if v is not None], 0.5))
    assert table_quantiles(df, ["x"], [0.5], bound=1)["x"][0] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("bound", [8_192, 3, 1])
def test_whole_table_counts_rows_as_wide_as_they_are(spark, monkeypatch, bound):
    inf, nan = float("inf"), float("nan")
    rows = [(nan, -0.0, None, 1), (inf, 0.0, None, 2), (-inf, -5e-324, None, None), (1.0, 1e308, None, 4), (2.5, -1e308, None, 4)] * 3
    df = spark.createDataFrame(rows + [(7.0, 1.0, None, 9)], "a double, b double, c double, d int").repartition(3)
    want = {r["column"]: tuple(r[f"q{i}"] for i in range(len(PROBS))) for r in exact_quantiles(df, df.columns, PROBS).collect()}
    monkeypatch.delattr(quantiles, "_long")  # a row per value would be as many times the rows as there are columns
    got = table_quantiles(df, df.columns, PROBS, bound=bound)
    assert list(got) == ["a", "b", "d"] and {c: repr(v) for c, v in got.items()} == {c: repr(v) for c, v in want.items()}


@pytest.mark.parametrize("few", [4_096, 5])
def test_value_at_rank(spark, few):
    rng = np.random.default_rng(3)
    values = rng.integers(-2 ** 62, 2 ** 62, 3000)
    df = spark.createDataFrame([(int(v),) for v in values], "h long")
    ordered = np.sort(values)
    for rank in (0, 599, 2999):
        assert value_at_rank(df, "h", lambda n: rank, few=few) == ordered[rank]
    hot = spark.createDataFrame([(7,)] * 50 + [(i,) for i in range(60)], "h long")
    assert [value_at_rank(hot, "h", lambda n: r, few=few) for r in (0, 6, 7, 57, 58, 109, 110)] == [0, 6, 7, 7, 8, 59, None]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "x double")
    assert table_quantiles(empty, ["x"], [0.5]) == {}
    assert value_at_rank(spark.createDataFrame([], "h long"), "h", lambda n: 0) is None


@pytest.mark.parametrize("few", [10_000, 3])
def test_ordinals_both_ways(spark, few):
    rows = [(f"c{i % 23:02d}", None if i % 7 == 0 else f"t{i % 5}") for i in range(400)]
    df = spark.createDataFrame(rows, "city string, kind string").repartition(6)
    got = {(r["column"], r["category"]): r["code"] for r in ordinals(df, ["city", "kind"], few=few).collect()}
    for column, i in (("city", 0), ("kind", 1)):
        names = sorted({r[i] or "nan" for r in rows})
        assert {k[1]: v for k, v in got.items() if k[0] == column} == {c: n for n, c in enumerate(names)}


def test_holdout_is_exact_and_independent_of_partitions(spark):
    df = spark.createDataFrame([(f"L{i}",) for i in range(1003)], "property_id string")
    first = {r.property_id for r in holdout(df).filter("is_test").collect()}
    second = {r.property_id for r in holdout(df.repartition(7)).filter("is_test").collect()}
    assert len(first) == 201 and first == second  # ceil(0.2 * 1003)


def test_holdout_by_a_held_key_is_the_same(spark):
    df = spark.createDataFrame([(f"L{i % 900}",) for i in range(1003)] + [(None,)], "property_id string")
    held = with_split_key(df)
    assert holdout_limit(held) == holdout_limit(df)
    assert sorted(map(str, holdout(held).drop(split_column()).collect())) == sorted(map(str, holdout(df).collect()))
    zero = held.withColumn(split_column(), F.lit(0).cast("long"))
    assert holdout(zero, limit=0).filter("is_test").count() == 1004  # the column is read, not hashed again
