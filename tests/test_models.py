import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from acrely.operators import features, models, prep, ranks
from acrely.operators import network as net
from acrely.plans import queries


def matrix(spark, n=400, k=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k))
    x = (x - x.mean(0)) / x.std(0)
    y = 5e6 + x @ np.array([1e6, -5e5, 2e5, 0.0])[:k] + rng.normal(size=n) * 1e5
    rows = [(f"L{i}", Vectors.dense(a), float(b), 1000.0) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, ["property_id", "features", "label", "area_sqft"]).repartition(4).persist()


def test_linear_equals_normal_equations(spark):
    x, y, df = matrix(spark)
    model = models.linear().fit(df)
    want = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
    np.testing.assert_allclose([*model.coefficients, model.intercept], want, rtol=1e-8, atol=1e-3)


def test_ridge_equals_closed_form(spark):
    x, y, df = matrix(spark)
    model = models.ridge(df, alpha=10.0).fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(x.shape[1]), xc.T @ yc)
    np.testing.assert_allclose(model.coefficients.toArray(), want, rtol=1e-6, atol=1e-2)


def test_trainer_compares_stores_and_predicts(spark, tmp_path):
    _, _, df = matrix(spark)
    train, test = df.filter(F.hash("property_id") % 5 != 0), df.filter(F.hash("property_id") % 5 == 0)
    trainer = models.ModelTrainer({
        "Linear Regression": lambda t: models.linear(), "Ridge Regression": lambda t: models.ridge(t),
        "Random Forest": lambda t: models.forest(trees=5, depth=4), "Gradient Boosting": lambda t: models.boosted(rounds=5)})
    table = trainer.train(train, test)
    assert table.count() == 4 and table.first().model == trainer.best_name
    folder = str(tmp_path / "models")
    trainer.save(spark, folder)
    again = models.ModelTrainer.load(spark, folder)
    assert again.best_name == trainer.best_name and set(again.models) == set(trainer.models)
    a = trainer.predict(test).orderBy("property_id").select("prediction").collect()
    assert a == again.predict(test, "no such model").orderBy("property_id").select("prediction").collect()
    active = models.active_model(spark.read.parquet(f"{folder}/registry")).first()
    assert active.best_model == trainer.best_name and active.folder == models.slug(trainer.best_name)
    assert models.evaluate_all(again, test).count() == 4
    importance = models.feature_importance(trainer.models["Random Forest"], ["a", "b", "c", "d"], spark).first()
    assert importance.feature == "a"
    assert models.feature_importance(trainer.models["Ridge Regression"], ["a", "b", "c", "d"], spark).first().feature == "a"


def test_predict_needs_training(spark):
    with pytest.raises(RuntimeError):
        models.ModelTrainer().predict(spark.range(1))


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    y, p = rng.normal(size=50) * 10 + 100, rng.normal(size=50) * 10 + 40
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "label double, prediction double")
    got = models.regression_metrics(df).first()
    assert got.r2 == pytest.approx(1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-4)
    assert got.rmse == pytest.approx(np.sqrt(((p - y) ** 2).mean()), abs=0.01)
    assert got.mape == pytest.approx(np.abs((y - p) / (y + 1e-9)).mean() * 100, abs=0.01)
    negative = df.withColumn("prediction", -F.col("prediction"))
    assert models.evaluation_metrics(negative).first().mape == 100.0


def test_best_model_ties(spark):
    table = spark.createDataFrame([(1, "b", 0.9), (0, "a", 0.9), (2, "c", 0.1)], "position int, model string, r2 double")
    assert models.best_model(table).first().model == "a"


def test_robust_needs_a_scaled_label(spark):
    _, _, df = matrix(spark)
    scored = models.predict_robust(models.fit_robust(df), df)
    assert models.regression_metrics(scored).first().r2 > 0.95
    assert models.training_history(models.fit_robust(df), spark).count() > 1


def test_preprocessor(spark, listings, tmp_path):
    rows = features.enrich(listings.drop("listed_at"))
    fitted = prep.ListingPreprocessor()
    train, test = fitted.fit_transform(rows)
    n = rows.count()
    assert (train.count(), test.count()) == (n - -(-n // 5), -(-n // 5))
    assert "price" not in fitted.feature_columns and "property_age_group" not in fitted.feature_columns
    x = np.array([r[0] for r in train.select(vector_to_array("features")).collect()])
    np.testing.assert_allclose(x.mean(0), 0, atol=1e-9)
    np.testing.assert_allclose(x.std(0)[x.std(0) > 0], 1, atol=1e-9)
    fitted.save(spark, str(tmp_path / "p"))
    again = prep.ListingPreprocessor.load(spark, str(tmp_path / "p"))
    request = rows.drop("price", "value_score").filter(F.col("property_id") == rows.first().property_id)
    assert again.transform(request).select("features").collect() == fitted.transform(request).select("features").collect()


def test_encoding_of_unseen_and_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "city string")
    codes = ranks.ordinals(df, ["city"])
    other = spark.createDataFrame([("a",), ("b",), (None,), ("zzz",)], "city string")
    for few in (10_000, 0):
        got = {r.k: r.city for r in prep.encode(other.withColumn("k", F.col("city")), codes, ["city"], few).collect()}
        assert got == {"a": 0.0, "b": 1.0, None: 2.0, "zzz": 0.0}


def test_impute_and_constant_scaling(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0), (4, 5.0)], "a int, b double")
    assert prep.medians(df, ["a", "b"]) == {"a": 2.5, "b": 5.0}
    scaled = prep.standard_scale(prep.impute(df, {"b": 5.0}), prep.standard_params(prep.impute(df, {"b": 5.0}), ["a", "b"]))
    assert [r.b for r in scaled.collect()] == [0.0] * 4


def steps_of(layers, flat, parts, salt):
    """The sums of every phase of a step over several shards."""
    phases = [net.step_sums(layers, flat, *p, salt) for p in parts]
    known = [sum(next(p) for p in phases)]
    while len(known[-1]) != layers.size + 3:
        known.append(sum(p.send(known[-1]) for p in phases))
    return known


@pytest.mark.parametrize("normalised, dropout", [((False,), (0.0,)), ((True, False), (0.0, 0.0)), ((True, True), (0.4, 0.3))])
def test_network_gradient_matches_differences(normalised, dropout):
    rng = np.random.default_rng(0)
    x, y, keys = rng.normal(size=(9, 3)), rng.normal(size=9), rng.integers(0, 1 << 60, 9)
    layers = net.Layers(3, net.Settings(hidden=(5, 4), normalised=normalised, dropout=dropout))
    flat = layers.start() + rng.normal(size=layers.size) * 0.1

    def loss(w):
        return steps_of(layers, w, [(x, y, keys)], 7)[-1][-2]

    g = steps_of(layers, flat, [(x, y, keys)], 7)[-1][:-3]
    for i in range(layers.size):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-4)


def test_shards_add_up_to_the_whole_batch():
    rng = np.random.default_rng(1)
    x, y, keys = rng.normal(size=(40, 3)), rng.normal(size=40), rng.integers(0, 1 << 60, 40)
    layers = net.Layers(3, net.Settings(hidden=(6, 4), normalised=(True, False), dropout=(0.2, 0.0)))
    flat = layers.start()
    whole = steps_of(layers, flat, [(x, y, keys)], 3)
    parts = steps_of(layers, flat, [(x[a:b], y[a:b], keys[a:b]) for a, b in ((0, 13), (13, 13), (13, 40))], 3)
    for a, b in zip(whole, parts):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


def test_dropout_is_by_row_unit_and_step():
    keys = np.arange(5_000, dtype=np.int64)
    mask = net.kept(keys, 20, 0.3, 1)
    assert abs(mask.mean() - 0.7) < 0.01 and abs(mask.mean(axis=0) - 0.7).max() < 0.05
    assert (net.kept(keys[::-1], 20, 0.3, 1)[::-1] == mask).all() and (net.kept(keys, 20, 0.3, 65) != mask).any()


def test_network_learns_and_is_stored(spark, tmp_path):
    _, _, df = matrix(spark, n=600)
    train, test = df.filter(F.hash("property_id") % 5 != 0), df.filter(F.hash("property_id") % 5 == 0)
    fitted = net.PriceNetwork(net.Settings(hidden=(16, 8), normalised=(False,), dropout=(0.0,), epochs=25, batch=16, rate=5e-3)).fit(train, test)
    assert models.regression_metrics(fitted.predict(test)).first().r2 > 0.9
    history = fitted.history_table(spark)
    losses = [r.value for r in history.filter("metric = 'loss'").orderBy("epoch").collect()]
    assert losses[-1] < losses[0] / 5
    fitted.save(spark, str(tmp_path / "n"))
    again = net.PriceNetwork.load(spark, str(tmp_path / "n"))
    assert again.settings == fitted.settings and again.history == fitted.history
    assert again.predict(test).select("prediction").collect() == fitted.predict(test).select("prediction").collect()


def test_weights_do_not_depend_on_partitions_or_shards(spark):
    _, _, df = matrix(spark, n=200)
    fits = [net.PriceNetwork(net.Settings(hidden=(4, 3), epochs=2, steps=2, shard_rows=rows)).fit(x, df)
            for x, rows in ((df, 1000), (df.repartition(7), 1000), (df, 90))]
    assert (fits[0].weights == fits[1].weights).all()
    np.testing.assert_allclose(fits[0].weights, fits[2].weights, rtol=1e-3, atol=1e-4)
    np.testing.assert_allclose([h[2] for h in fits[0].history], [h[2] for h in fits[2].history], rtol=1e-3)


def test_early_stop(spark):
    _, _, df = matrix(spark, n=60)
    noise = df.withColumn("label", F.rand(1))
    fitted = net.PriceNetwork(net.Settings(hidden=(8,), epochs=60, rate=5e-2, patience=2)).fit(noise, noise.withColumn("label", F.rand(9)))
    assert len(fitted.history) < 60 * 3


def test_registered_models_have_the_default_sizes(spark):
    forest = queries.CANDIDATES["Random Forest"](None)
    boosted = queries.CANDIDATES["Gradient Boosting"](None)
    forest, boosted = forest.settings, boosted.settings
    assert (forest.trees, forest.depth, boosted.rounds, boosted.depth) == (200, 15, 300, 6)


def test_rows_are_dealt_once_an_epoch(spark):
    """Every row is in one step of the epoch, in the order in which its shard's batches have it; empty steps are there."""
    _, _, df = matrix(spark, n=60)
    fitted = net.PriceNetwork(net.Settings(shard_rows=25))
    blocks = net._blocks(df, 60, False, fitted)
    dealt = net._dealt(blocks, 42, 3, 40)
    parts = dealt.collect()
    assert len(parts) == 40 * blocks.count() and sum(p.n for p in parts) == 60 and min(p.n for p in parts) == 0
    for block in blocks.collect():
        rows = net.Batches(*net._rows(block), 42)
        wanted = {rows.take(3, step, 40)[2].tobytes() for step in range(40)}
        assert wanted <= {bytes(p.h) for p in parts}
    assert all(net._rows(p)[0].shape == (p.n, p.inputs) for p in parts)
    dealt.unpersist()
