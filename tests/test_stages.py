import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from acrely.operators.prep import ListingPreprocessor
from acrely.operators.stages import ListingPreparation, ListingPreparationModel

SCHEMA = "property_id string, city string, property_type string, bedrooms int, area_sqft double, price double, features string, note string"


def rows(n=60):
    for i in range(n):
        area = 400.0 + 37 * i % 900
        yield (
            f"L{i:03}", ["Pune", "Mumbai", None][i % 3], ["Flat", "Villa"][i % 2], None if i % 7 == 0 else i % 5 + 1, area,
            None if i == 5 else 1e6 + 2000 * area + 3e5 * (i % 2) + i % 11, "given", "kept")


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(rows()), SCHEMA).coalesce(2).persist()


def by_id(df, *columns):
    return {r.property_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_the_model_keeps_all_columns_and_agrees_with_the_preprocessor(table):
    model = ListingPreparation().fit(table)
    found = model.transform(table)
    plain = ListingPreprocessor().fit(table.drop("features"))
    wanted = plain.transform(plain.split(table.drop("features")))
    assert set(found.columns) == {*table.columns, "label", "is_test"}
    assert by_id(found, "features", "label", "is_test") == by_id(wanted, "features", "label", "is_test")
    assert by_id(found, "note", "price") == by_id(table, "note", "price")


def test_without_test_rows_the_scaling_sees_every_row(table):
    found = ListingPreparation(testFraction=0.0).fit(table).transform(table).collect()
    x = np.array([r.features.toArray() for r in found])
    assert not any(r.is_test for r in found)
    np.testing.assert_allclose(x.mean(axis=0), 0, atol=1e-9)
    np.testing.assert_allclose(x.std(axis=0), 1, atol=1e-9)


def test_a_stored_pipeline_predicts_the_same(table, tmp_path):
    stages = Pipeline(stages=[ListingPreparation(testFraction=0.0, handleInvalid="skip"), LinearRegression(solver="normal")])
    stages.write().overwrite().save(str(tmp_path / "stages"))
    again = Pipeline.load(str(tmp_path / "stages"))
    first = again.getStages()[0]
    assert first.getOrDefault("testFraction") == 0.0 and first.getOrDefault("handleInvalid") == "skip"
    model = again.fit(table)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert isinstance(loaded.stages[0], ListingPreparationModel) and loaded.stages[0].uid == first.uid
    one, other = by_id(model.transform(table), "prediction"), by_id(loaded.transform(table), "prediction")
    assert one == other and len(one) == 59  # the row without a price is skipped
    served = loaded.transform(table.drop("price", "features"))
    assert served.count() == 60 and "label" not in served.columns


def test_cross_validation_sees_the_stage_as_any_other(table):
    line = LinearRegression(solver="normal", standardization=False)
    search = CrossValidator(
        estimator=Pipeline(stages=[ListingPreparation(testFraction=0.0, handleInvalid="skip"), line]),
        estimatorParamMaps=ParamGridBuilder().addGrid(line.regParam, [0.0, 1e9]).build(), evaluator=RegressionEvaluator(), numFolds=2, seed=3)
    found = search.fit(table)
    assert found.avgMetrics[0] < 0.5 * found.avgMetrics[1]
    assert found.bestModel.stages[1].getOrDefault("regParam") == 0.0


def test_odd_tables(spark, table):
    model = ListingPreparation().fit(table)
    new = spark.createDataFrame([("N1", "Atlantis", None, None)], "property_id string, city string, property_type string, price double")
    row = model.transform(new).first()
    assert row.label is None and len(row.features) == len(model.feature_columns) and row.city == "Atlantis"
    assert model.transform(table.limit(0)).count() == 0
    assert "is_test" not in model.transform(table.drop("property_id")).columns
    with pytest.raises(ValueError):
        ListingPreparation(handleInvalid="drop").fit(table)


def test_an_empty_table_fits(table):
    empty = table.limit(0)
    assert ListingPreparation().fit(empty).transform(empty).count() == 0
