"""Stored models are used again while the input is the same, and fitted anew when it changes."""

import os

from acrely.plans.stored import LineUp
from acrely.operators import features, models, ranks
from acrely.operators.prep import ListingPreprocessor


def test_line_up(spark, listings, tmp_path):
    path = str(tmp_path / "in")
    features.enrich(listings.drop("listed_at")).limit(400).write.parquet(path)
    fitted = []

    def linear(train):
        fitted.append(train.count())
        return models.linear()

    def line(label="a"):
        return LineUp(spark, [path], lambda: spark.read.parquet(path), {"Linear Regression": linear, "Ridge Regression": models.ridge}, label)

    first = line()
    trainer, metrics = first.trainer(["Linear Regression"])
    assert list(trainer.models) == ["Linear Regression"] == list(metrics) and len(fitted) == 1
    again, both = line().trainer()
    assert len(fitted) == 1 and both["Linear Regression"] == metrics["Linear Regression"]
    assert again.best_name == max(both, key=lambda m: both[m]["r2"])
    assert again.models["Linear Regression"].coefficients == trainer.models["Linear Regression"].coefficients
    assert line().test.count() == 80 and line().prepared.feature_columns == first.prepared.feature_columns
    line("b").model("Linear Regression")
    assert len(fitted) == 2
    features.enrich(listings.drop("listed_at")).limit(100).write.mode("append").parquet(path)
    line().model("Linear Regression")
    assert len(fitted) == 3 and line().train.count() + line().test.count() == 500


def test_both_parts_are_written_in_one_pass(spark, listings, tmp_path):
    path, seen = str(tmp_path / "in"), []
    ranks.with_split_key(features.enrich(listings.drop("listed_at")).limit(300)).write.parquet(path)

    def linear(train):
        seen.append(train.storageLevel.useMemory)
        return models.linear()

    line = LineUp(spark, [path], lambda: spark.read.parquet(path), {"Linear Regression": linear}, "parts")
    line.trainer()
    folder = line._tables.removeprefix("file:")
    assert sorted(x for x in os.listdir(folder) if not x.startswith((".", "_"))) == ["prepared", "rows"]
    assert (line.train.count(), line.test.count()) == (240, 60) and line.train.columns == line.test.columns
    assert ranks.split_column() not in line.prepared.feature_columns
    assert seen == [False]  # stored tables are not kept in memory beside their files
    plain = ListingPreprocessor()
    train, test = plain.fit_transform(spark.read.parquet(path).drop(ranks.split_column()))
    assert plain.feature_columns == line.prepared.feature_columns
    assert {c: plain.fill[c] for c in line.prepared.fill} == line.prepared.fill
    assert plain.split_limit == line.prepared.split_limit
    assert {r.property_id for r in test.collect()} == {r.property_id for r in line.test.collect()}
