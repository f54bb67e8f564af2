import pytest
from pyspark.sql import functions as F

from acrely.functions.sql_functions import register
from acrely.operators import features, validate
from acrely.sources.files import from_records
from acrely.schema import REQUEST

# city, locality, type, bed, bath, area, age, floor, total, location, amenities -> expected features
GOLDEN = {
    "G1": (("Pune", "Koregaon Park", "Apartment", 3, 2, 1350.0, 4.0, 6.0, 14.0, 8.5, "Gym|Pool|Parking|Security|Lift|CCTV", None),
           (6, 6.0, 1.5, 0.429, 450.0, 0.36, 1, "Mid", 7.36)),
    "G2": (("Mumbai", "Bandra", "Penthouse", 4, 4, 2800.0, 2.0, 20.0, 22.0, 9.5, "Gym|Pool|Parking|Security|Lift|Club House|CCTV", None),
           (7, 7.0, 1.0, 0.909, 700.0, 1.0, 1, "New", 8.68)),
    "G3": (("Jaipur", "Vaishali Nagar", "Villa", 4, 3, 2200.0, 8.0, 0.0, 2.0, 7.2, "Garden|Parking|Security|Power Backup", None),
           (4, 4.0, 1.33, 0.0, 550.0, 0.24, 0, "Mid", 5.55)),
    "G4": (("Goa", "Nowhere", "Studio", 2, 0, 900.0, None, 3.0, 0.0, 5.0, "", None),
           (0, 0.0, 2.0, 3.0, 450.0, 0.5, 0, "Unknown", 6.0)),
    "G5": (("Pune", "Baner", "Studio", 1, 1, 400.0, 13.0, None, 5.0, 6.0, None, None),
           (0, 0.0, 1.0, None, 400.0, 0.36, 0, "Old", None)),
    "G6": (("Mumbai", "Worli", "Villa", 5, 5, 5000.0, 30.0, 4.0, 5.0, 10.0, "a||b|", None),
           (4, 4.0, 1.0, 0.8, 1000.0, 1.0, 1, "Old", 6.0)),
    "G7": (("Mumbai", "Bandra", "Villa", 3, 3, 2000.0, 0.0, 9.0, 9.0, 10.0, "a|b|c|d|e|f|g|h|i|j|k", None),
           (11, 10.0, 1.0, 1.0, 666.67, 1.0, 1, "New", 10.0)),
}


@pytest.fixture(scope="module")
def enriched(spark):
    rows = from_records(spark, [row for row, _ in GOLDEN.values()], REQUEST)
    return features.enrich(rows, has_price=False).select(*features.FEATURES).collect()


@pytest.mark.parametrize("name", list(GOLDEN))
def test_golden_features(enriched, name):
    assert tuple(enriched[list(GOLDEN).index(name)]) == GOLDEN[name][1]


def test_enrich_without_optional_columns(spark):
    rows = spark.createDataFrame([("Pune", "Baner", 2, 1, 800.0)], "city string, locality string, bedrooms int, bathrooms int, area_sqft double")
    got = features.enrich(rows).first()
    assert (got.amenities_count, got.floor_ratio, got.property_age_group) == (0, 0.0, "Unknown")
    assert got.value_score == 4.0  # location 5.0 and full marks for age


def test_price_per_sqft_replaces_the_given_one(spark):
    rows = from_records(spark, [GOLDEN["G1"][0][:-1] + (8_500_000.0,)], REQUEST).withColumn("price_per_sqft", F.lit(1.0))
    assert features.enrich(rows).first().price_per_sqft == 6296.3


def test_new_columns_and_alignment(spark):
    rows = from_records(spark, [GOLDEN["G1"][0]], REQUEST)
    added = features.new_columns(rows, features.enrich(rows, has_price=False))
    assert added == features.FEATURES
    assert features.align(rows, ["bedrooms", "missing"]).first() == (3, 0.0)


def test_fair_price(spark):
    rows = spark.createDataFrame(
        [("Pune", "Apartment", 10.0, "a|b", 5.0, 1000.0, 9e6), ("Goa", "Villa", 1.0, "a", 5.0, 1000.0, 9e6)],
        "city string, property_type string, age_years double, amenities string, location_score double, area_sqft double, price double")
    known, unknown = features.fair_price(rows).collect()
    assert known.fair_ppsf == int(9000 * 1.0 * 0.9 * 1.04) and known.fair_price == known.fair_ppsf * 1000
    assert unknown.fair_ppsf is None


def test_price_band_edges(spark):
    rows = spark.createDataFrame([("Pune", 70.0), ("Pune", 130.0), ("Pune", 131.0), ("Surat", 100.0)], "city string, price double")
    assert features.price_band(rows, 100.0, 30.0, "Pune").count() == 2
    assert features.price_band(rows, 100.0, 0.0, "Pune").count() == 3
    assert features.price_band(rows, None, 30.0).count() == 4


def test_violations_and_split(spark):
    rows = spark.createDataFrame(
        [("Pune", "Baner", "Villa", 3, 2, 900.0, 7.0, 1e6), (None, "Baner", "Villa", 0, 11, 0.0, 10.5, None),
         ("Pune", "Baner", "Villa", 10, 1, 0.1, None, 1.0)],
        "city string, locality string, property_type string, bedrooms int, bathrooms int, area_sqft double, location_score double, price double")
    good, bad = validate.split_valid(validate.check_listings(rows))
    assert good.count() == 2
    assert bad.first().violations == [
        "city_missing", "bedrooms_range", "bathrooms_range", "area_not_positive", "location_range", "price_missing"]


def test_signups(spark):
    forms = spark.createDataFrame(
        [(1, " Asha ", "Rao", " A@X.in ", 6), (2, " ", "Rao", "b@x.in", 9), (3, "C", "D", "no-at", 9), (4, "E", "F", "e@x.in", 5),
         (5, "G", "H", None, 9), (6, "I", "J", "known@x.in", 9),
         (7, "Later", "Rao", "a@x.in", 9)],
        "form_id long, first_name string, last_name string, email string, password_length int")
    known = spark.createDataFrame([("known@x.in",), ("known@x.in",), (None,)], "email string")
    checked = validate.check_signups(forms)
    assert [r.problem for r in checked.orderBy("form_id").collect()] == [None, "name", "email", "password", "email", None, None]
    assert [(r.form_id, r.email) for r in validate.accept_signups(checked, known).collect()] == [(1, "a@x.in")]


def test_sql_functions(spark):
    assert "value_score" in register(spark)
    row = spark.sql("SELECT amenities_count('a||b|'), property_age_group(NULL), price_label(12500000D), value_score(10D, 10D, 0D, 1D), "
                    "is_premium_locality('Bandra')").first()
    assert tuple(row) == (4, "Unknown", "1.3Cr", 10.0, 1)
