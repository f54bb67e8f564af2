"""What the planner makes of the operators: no needless shuffles, pruned scans, no cross products."""

import re

import pytest

from acrely.operators import activity, anomaly, features, invest, profile, ranks
from acrely.operators.prep import CATEGORICAL, encode
from acrely.plans.queries import QUERIES
from acrely.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, listings, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "listings")
    listings.write.partitionBy("city").parquet(path)
    return spark.read.parquet(path)


def test_row_functions_do_not_shuffle(stored):
    detector = anomaly.AnomalyDetector(use_forest=False).fit(stored)
    for df in (features.enrich(stored), features.fair_price(stored), invest.analyze(stored), detector.detect(stored),
               ranks.holdout_by_share(stored)):
        assert "Exchange" not in plan(df)


def test_scans_read_only_what_is_needed(stored):
    text = plan(profile.mean_price_by_type(stored))
    assert re.search(r"ReadSchema: struct<property_type:string,price:double>", text)


def test_city_filter_prunes_partitions_and_price_filter_is_pushed(stored):
    text = plan(features.price_band(stored, 5e6, 30.0, "Pune"))
    assert "PartitionFilters: [isnotnull(city" in text and "GreaterThanOrEqual(price" in text


def test_aggregates_combine_before_the_shuffle(stored, spark, data):
    text = plan(profile.bedroom_counts(stored))
    assert text.count("HashAggregate") == 2
    assert "partial_count" in plan(activity.event_counts(tables.events(spark, data)))


def test_small_fitted_tables_are_not_joined_by_shuffle(stored):
    assert "SortMergeJoin" not in plan(profile.boxplot_by_city(stored))
    assert "SortMergeJoin" not in plan(encode(stored, ranks.ordinals(stored, CATEGORICAL), CATEGORICAL))


@pytest.mark.parametrize("name", ["recommend_batch", "recommend_no_city", "recommend_unfiltered", "embedding_topk", "boxplot_by_city",
                                  "anomaly_summary", "inventory_upsert", "enquiry_table", "investment_city_yields", "minmax_scale"])
def test_no_cross_products(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
